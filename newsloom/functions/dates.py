"""Dates in texts and URLs, as naive UTC. The session time zone is expected to be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names without diacritics; three letters of a name are enough.
MONTHS = {
    "ocak": 1, "subat": 2, "mart": 3, "nisan": 4, "mayis": 5, "haziran": 6, "temmuz": 7, "agustos": 8, "eylul": 9, "ekim": 10, "kasim": 11, "aralik": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}


def _part(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match, null where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _stamp(y: Column, m: Column, d: Column, hh: Column | None = None, mm: Column | None = None, ss: Column | None = None) -> Column:
    """A timestamp from strings of digits, null where they make none."""
    zero = F.lit(0)
    number = lambda c: zero if c is None else F.coalesce(c.cast("int"), zero)
    return F.try_make_timestamp(y.cast("int"), m.cast("int"), d.cast("int"), number(hh), number(mm), number(ss).cast("decimal(16,6)"))


def try_parse(text: Column, months: dict[str, int] | None = None) -> Column:
    """ISO date and time (an offset is applied), else its date alone, else D.M.Y, else D month Y; null if none."""
    text = F.trim(text)
    iso = r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{1,2}):(\d{2})(?::(\d{2}))?"
    whole = F.regexp_extract(text, r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?$", 0)
    exact = F.try_to_timestamp(F.when(whole != "", F.regexp_replace(F.regexp_replace(F.replace(whole, F.lit(" "), F.lit("T")), r"([+-]\d{2})(\d{2})$", "$1:$2"), "Z$", "+00:00")))
    parts = lambda pattern, groups: _stamp(*[_part(text, pattern, g) for g in groups])
    # Day.month.year and day, month name, year, as articles write them.
    dot = r"(\d{1,2})\.(\d{1,2})\.(\d{4})(?:\s+(\d{1,2}):(\d{1,2}))?"
    word = r"(?iu)(\d{1,2})\s+([a-zA-ZğüşıöçĞÜŞİÖÇ]+)\s+(\d{4})(?:\s+(\d{1,2}):(\d{1,2}))?"
    table = F.create_map(*[F.lit(x) for kv in (months or MONTHS).items() for x in kv])
    name = F.translate(F.lower(F.regexp_extract(text, word, 2)), "ğşıöüç", "gsiouc")
    month = F.coalesce(F.try_element_at(table, name), F.try_element_at(table, F.substring(name, 1, 3)))
    named = _stamp(_part(text, word, 3), month.cast("string"), _part(text, word, 1), _part(text, word, 4), _part(text, word, 5))
    return F.coalesce(exact, parts(iso, range(1, 7)), parts(r"^(\d{4})-(\d{2})-(\d{2})", range(1, 4)), parts(dot, (3, 2, 1, 4, 5)), named)


def date_from_url(url: Column) -> Column:
    """/Y/M/D as a path, else D-M-Y or D.M.Y with a year from 2000 on."""
    path, dashed = r"/(\d{4})/(\d{1,2})/(\d{1,2})(?:/|$)", r"[/_-](\d{1,2})[.\-](\d{1,2})[.\-](\d{4})(?:[/_\-]|\.html|$)"
    first = _stamp(*[_part(url, path, g) for g in (1, 2, 3)])
    second = _stamp(*[_part(url, dashed, g) for g in (3, 2, 1)])
    return F.coalesce(first, F.when(_part(url, dashed, 3).cast("int") >= 2000, second))


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")
