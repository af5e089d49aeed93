"""Rule-based scoring of texts into categories.

Keywords count as beginnings of words (up to a longest suffix) or as phrases of whole words. A lexicon of (category,
keyword, weight) rows up to a checked number is looked up word by word, and only what is found leaves a text. For a longer
one both are equi-joins: words are exploded with their beginnings of lengths that keywords have, runs of single-spaced
words as they are. Either way the cost is linear in the text and does not depend on the lexicon's size. Rules add to
scores by guards over the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import py_trim, tr_lower
from newsloom.profiles import Profile, Rule

BROADCAST_KEYWORDS = 200_000
BROADCAST_ANCHORS = 10_000


def _tokens(text: Column, letters: str) -> Column:
    """Runs of letters; a lone | stands where anything but one space lies between two of them."""
    marked = F.regexp_replace(text, f"[^{letters} ]| {{2,}}", " | ")
    return F.array_remove(F.split(marked, " +"), "")


def _lookup(keywords: Broadcast, letters: str, longest: int):
    """A column function: the keywords (k, never) of a lower-cased text as (k, n), n times each."""

    @F.pandas_udf("array<struct<k:string,n:long>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        single = {k: never for k, never in keywords.value if " " not in k}
        lengths = sorted({len(k) for k in single})
        phrases: dict[str, list[tuple[str, list[str]]]] = {}
        for k, _ in keywords.value:
            if " " in k:
                phrases.setdefault(k.split()[0], []).append((k, k.split()))
        breaks = re.compile(f"[^{letters} ]| {{2,}}")
        known: dict[str, list[str]] = {}

        def of(word: str) -> list[str]:
            begun = [word[:n] for n in lengths if n <= len(word) <= n + longest]
            return [k for k in begun if k in single and not (single[k] is not None and word.startswith(single[k]))]

        def one(text: str) -> list[dict]:
            runs, hits = [r.split() for r in breaks.split(text)], Counter()
            for word, n in Counter([w for r in runs for w in r]).items():
                ks = known.get(word)
                if ks is None:
                    if len(known) >= 1_000_000:
                        known.clear()
                    ks = known[word] = of(word)
                for k in ks:
                    hits[k] += n
            for r in runs if phrases else ():
                for i, word in enumerate(r):
                    for k, ws in phrases.get(word, ()):
                        if r[i : i + len(ws)] == ws:
                            hits[k] += 1
            return [{"k": k, "n": n} for k, n in hits.items()]

        for batch in batches:
            yield pd.Series([one(t) for t in batch], dtype=object)

    return find


def keyword_hits(docs: DataFrame, lexicon: DataFrame, profile: Profile, id_col: str = "doc_id", title_col: str = "title", body_col: str = "body") -> DataFrame:
    """id, category, keyword, weight, n_title, n_body: the keywords found, as often as they occur.

    Keywords are trimmed and lower-cased to be matched but stay apart by their written form; empty ones match nothing.
    Keywords that hold other characters than the profile's letters and single spaces (digits, hyphens, apostrophes) are
    looked for at every place that no letter precedes.
    """
    lex = lexicon.select("category", "keyword", F.col("weight").cast("long").alias("weight"), tr_lower(py_trim(F.col("keyword"))).alias("k")).where("k <> ''")
    plain = F.col("k").rlike(f"^[{profile.letters}]+( [{profile.letters}]+)*$")
    odd = lex.where(~plain).withColumn("phrase", F.contains("k", F.lit(" ")))
    odd_shapes = sorted((r.phrase, r.len) for r in odd.select("phrase", F.length("k").alias("len")).distinct().collect())
    lex = lex.where(plain).withColumn("words", F.size(F.split("k", " ")))
    shapes = lex.select("words", F.length("k").alias("len")).distinct().collect()  # a few small numbers
    lengths = sorted({r.words for r in shapes})
    sizes = F.array(*[F.lit(n) for n in sorted({r.len for r in shapes if r.words == 1})]).cast("array<int>")
    never = F.create_map(*[F.lit(x) for kv in profile.never.items() for x in kv]) if profile.never else F.lit(None).cast("map<string,string>")
    lex = lex.withColumn("never", F.try_element_at(never, F.col("k")))
    small = lexicon.count() <= BROADCAST_KEYWORDS
    if small:
        lex, odd = F.broadcast(lex), F.broadcast(odd)
    texts = F.array(*[F.struct(F.lit(f).alias("field"), tr_lower(F.col(c)).alias("text")) for f, c in (("title", title_col), ("body", body_col))])
    whole = docs.select(F.col(id_col).alias("id"), F.explode(texts).alias("t")).select("id", "t.*")
    words = whole.select("id", "field", _tokens(F.col("text"), profile.letters).alias("ws"))
    found = []
    for phrase, length in odd_shapes:
        suffix = "" if phrase else f"[{profile.letters}]{{0,{profile.longest_suffix}}}"
        at = rf"(?s)(?<![{profile.letters}])(?=(.{{{length}}}){suffix}(?![{profile.letters}]))"
        grams = whole.select("id", "field", "text", F.explode_outer(F.array_distinct(F.regexp_extract_all("text", F.lit(at), 1))).alias("k"))
        hits = grams.join(odd.where((F.col("phrase") == phrase) & (F.length("k") == length)), "k")
        # What is found somewhere is counted by one expression over the text.
        whole_word = F.concat(F.lit(rf"(?<![{profile.letters}])\Q"), F.col("k"), F.lit(rf"\E{suffix}(?![{profile.letters}])"))
        found.append(hits.select("id", "category", "keyword", "weight", "field", F.regexp_count("text", whole_word).alias("n")))
    if small:
        keywords = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in lex.select("k", "never").distinct().collect()])  # a checked number
        listed = _lookup(keywords, profile.letters, profile.longest_suffix)(F.col("text"))
        hits = whole.select("id", "field", F.explode_outer(listed).alias("h")).select("id", "field", "h.k", "h.n").join(lex, "k")
        found.append(hits.select("id", "category", "keyword", "weight", "field", "n"))
    for n in [] if small else lengths or [1]:
        if n == 1:
            grams = words.select("id", "field", F.explode_outer("ws").alias("token")).where("token <> '|'")
            fits = F.filter(sizes, lambda n: (n <= F.length("token")) & (n >= F.length("token") - profile.longest_suffix))
            grams = grams.select("id", "field", "token", F.explode_outer(fits).alias("len"))
            grams = grams.select("id", "field", "token", F.expr("substring(token, 1, len)").alias("k"))
        else:
            # Runs grow by one word a projection; a slice for each position would copy the whole text each time.
            runs = words.withColumn("run", F.col("ws"))
            for k in range(1, n):
                runs = runs.withColumn("run", F.zip_with("run", F.slice("ws", k + 1, F.size("ws")), lambda x, y: F.concat(x, F.lit(" "), y)))
            grams = runs.select("id", "field", F.lit("").alias("token"), F.explode_outer("run").alias("k"))
        hits = grams.join(lex.where(F.col("words") == n), "k").where(F.col("never").isNull() | ~F.startswith(F.col("token"), F.col("never")))
        found.append(hits.select("id", "category", "keyword", "weight", "field", F.lit(1).alias("n")))
    hits = reduce(DataFrame.unionByName, found)
    of = lambda f: F.sum(F.when(F.col("field") == f, F.col("n")).otherwise(0)).cast("long").alias(f"n_{f}")
    return hits.groupBy("id", "category", "keyword", "weight").agg(of("title"), of("body"))


def keyword_scores(hits: DataFrame, profile: Profile) -> DataFrame:
    """id, category, score: weights times occurrences, those in titles counted ``title_factor`` times."""
    return hits.groupBy("id", "category").agg(F.sum(F.col("weight") * (profile.title_factor * F.col("n_title") + F.col("n_body"))).alias("score"))


def keyword_matches(hits: DataFrame) -> DataFrame:
    """id, category, n, keywords: the keywords found, sorted."""
    return hits.groupBy("id", "category").agg(F.count_distinct("keyword").alias("n"), F.sort_array(F.collect_set("keyword")).alias("keywords"))


#: Characters that mean something in a pattern.
_SPECIAL = "\\.[]{}()*+?|^$"


def _close(pattern: str, at: int) -> int:
    """The place of the parenthesis or bracket that closes the one at ``at``."""
    if pattern[at] == "[":
        return pattern.index("]", at + 2)
    depth = 0
    while True:
        if pattern[at] == "\\":
            at += 1
        elif pattern[at] == "[":
            at = _close(pattern, at)
        else:
            depth += (pattern[at] == "(") - (pattern[at] == ")")
        if not depth:
            return at
        at += 1


def needed(pattern: str) -> list[str] | None:
    """Literals of which any match of the pattern holds at least one; None if that can't be told."""
    runs: list[list[str]] = [[]]  # of each alternative, the choices of literals that a match of it needs
    run, at, out = "", 0, []

    def end(choice: list[str] | None = None) -> None:
        nonlocal run
        if run:
            runs[-1].append([run])
        if choice:
            runs[-1].append(choice)
        run = ""

    while at < len(pattern):
        c = pattern[at]
        if c == "|":
            end()
            runs.append([])
            at += 1
            continue
        inner: list[str] | None = None
        stop = at
        if c == "(":
            stop = _close(pattern, at)
            body = pattern[at + 1 : stop]
            inner = None if body[:2] in ("?=", "?!", "?<") else needed(body.removeprefix("?:"))
        elif c == "[":
            stop = _close(pattern, at)
        elif c == "\\":
            stop = at + 1
        after = pattern[stop + 1 : stop + 2]
        optional = after in ("?", "*") or pattern[stop + 1 : stop + 3] == "{0"
        if c in _SPECIAL or optional:
            end(None if optional else inner)
        else:
            run += c
        at = stop + 1
        if after in ("?", "*", "+"):
            end()
            at += 1
        elif after == "{":
            end()
            at = pattern.index("}", at) + 1
    end()
    for choices in runs:
        best = max(choices, key=lambda x: min(map(len, x)), default=None)
        if best is None:
            return None
        out += best
    return out


def rule_deltas(docs: DataFrame, rules: tuple[Rule, ...], categories: tuple[str, ...], id_col: str = "doc_id", title_col: str = "title", body_col: str = "body", url_col: str | None = None) -> DataFrame:
    """id, delta_<i> and reset_<i> for each category.

    A graph of guards: each distinct pattern is one guard, however many rules name it; a guard's pattern runs only on texts
    that hold one of the literals it needs, and all texts are asked once for all literals. Rules are conjunctions of guards,
    and a category's delta is the sum over its column of the matrix of rules and categories.
    """
    empty = F.lit("")
    base = docs.select(
        F.col(id_col).alias("id"),
        tr_lower(F.concat_ws(" ", F.coalesce(F.col(title_col), empty), F.coalesce(F.col(body_col), empty))).alias("text"),
        tr_lower(F.col(title_col)).alias("title"),
        (tr_lower(F.col(url_col)) if url_col else empty).alias("url"),
    )
    guards: dict[tuple[str, str], int] = {}
    number = lambda field, pattern: guards.setdefault((field, pattern), len(guards))
    wanted = [([number(r.field, p) for p in r.must], [number(r.field, p) for p in r.must_not], [(number("text", a), number("text", b)) for a, b in r.unless]) for r in rules]
    need = {g: needed(g[1]) or [] for g in guards if g[0] == "text"}
    every = sorted({x for xs in need.values() for x in xs}, key=lambda x: (len(x), x))
    # Of two literals the one within the other says enough, unless it is so short that most texts hold it.
    short = {x: next(y for y in every if y == x or (len(y) > 3 and y in x)) for x in every}
    literals: dict[str, int] = {}
    asked = {g: sorted({literals.setdefault(short[x], len(literals)) for x in need.get(g, [])}) for g in guards}
    held = F.filter(F.transform(F.array(*[F.lit(x) for x in literals]).cast("array<string>"), lambda x, i: F.when(F.contains(F.col("text"), x), i)), lambda i: i.isNotNull())
    tests = []
    for (field, pattern), near in asked.items():
        match = F.coalesce(F.col(field).rlike("(?dU)" + pattern), F.lit(False))
        tests.append(F.arrays_overlap("held", F.array(*[F.lit(i) for i in near])) & match if near else match)
    guarded = base.withColumn("held", held).select("id", F.array(*tests).cast("array<boolean>").alias("guard"))
    on: list[Column] = []
    for i, (must, must_not, unless) in enumerate(wanted):
        guard = lambda g: F.get("guard", F.lit(g))
        terms = [guard(g) for g in must] + [~guard(g) for g in must_not] + [~(guard(a) & ~guard(b)) for a, b in unless]
        terms += [~on[j] for j in range(i) if rules[i].group and rules[j].group == rules[i].group]
        on.append(reduce(lambda a, b: a & b, terms, F.lit(True)))
    ruled = guarded.select("id", F.array(*on).cast("array<boolean>").alias("on"))
    out = []
    for c, category in enumerate(categories):
        row = F.array(*[F.lit(sum(d for name, d in r.deltas if name == category)).cast("long") for r in rules]).cast("array<long>")
        resets = [F.get("on", F.lit(i)) for i, r in enumerate(rules) if category in r.reset]
        total = F.aggregate(F.zip_with("on", row, lambda x, d: F.when(x, d).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a + b)
        out += [total.alias(f"delta_{c}"), reduce(lambda a, b: a | b, resets, F.lit(False)).alias(f"reset_{c}")]
    return ruled.select("id", *out)


def rules_from(table: DataFrame) -> tuple[Rule, ...]:
    """Rules of a table (ord, name, field, must, must_not, category, delta, group), a row for each category of a rule.

    ``must`` and ``must_not`` are arrays of patterns. A rule set is small by nature: it becomes part of the plan.
    """
    rows: dict[tuple, list] = {}
    for r in table.orderBy("ord").collect():
        rows.setdefault((r.ord, r.name, r.field or "text", tuple(r.must or ()), tuple(r.must_not or ()), r.group or ""), []).append((r.category, r.delta))
    return tuple(Rule(name, must, tuple(deltas), must_not, field, group) for (_, name, field, must, must_not, group), deltas in rows.items())


def classify(docs: DataFrame, lexicon: DataFrame, profile: Profile, bonus: DataFrame | None = None, weight: int = 0, **columns) -> DataFrame:
    """id, category (null below the threshold), score and one column ``score_<i>`` for each category.

    Keyword scores plus rule deltas, resets, no score under 0; the largest wins, of equals the first of
    ``profile.categories``. ``bonus`` (id, category, similarity) adds ``weight`` times the similarity, rounded half to
    even, to texts that reached the threshold or not alike; ids are unique.
    """
    hits = keyword_hits(docs, lexicon, profile, **{k: v for k, v in columns.items() if k != "url_col"})
    scores = keyword_scores(hits, profile).groupBy("id").pivot("category", list(profile.categories)).agg(F.first("score"))
    scores = scores.toDF("id", *[f"kw_{i}" for i in range(len(profile.categories))])
    out = rule_deltas(docs, profile.rules + profile.context, profile.categories, **columns).join(scores, "id", "left")
    if bonus is not None and weight:
        near = bonus.groupBy("id").pivot("category", list(profile.categories)).agg(F.max("similarity"))
        out = out.join(near.toDF("id", *[f"sim_{i}" for i in range(len(profile.categories))]), "id", "left")
    names = []
    for i in range(len(profile.categories)):
        total = F.coalesce(F.col(f"kw_{i}"), F.lit(0)) + F.col(f"delta_{i}")
        total = F.greatest(F.when(F.col(f"reset_{i}"), 0).otherwise(total), F.lit(0))
        if bonus is not None and weight:
            total = total + F.bround(F.coalesce(F.col(f"sim_{i}"), F.lit(0.0)) * weight).cast("long")
        out = out.withColumn(f"score_{i}", total)
        names.append(f"score_{i}")
    top = F.greatest(*names, F.lit(0)) if len(names) > 1 else F.col(names[0])
    winner = F.coalesce(*[F.when(F.col(n) == F.col("score"), F.lit(c)) for n, c in zip(names, profile.categories, strict=True)])
    out = out.withColumn("score", top).withColumn("category", F.when(F.col("score") >= profile.threshold, winner))
    return out.select("id", "category", "score", *names)


def anchor_similarity(vectors: DataFrame, anchors: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """id, category, similarity: for each category the largest product with one of its anchors, between 0 and 1.

    Anchors are a few vectors for each category; they are gathered into one row for each category before the join.
    """
    from newsloom.functions.similarity import dot

    if anchors.count() > BROADCAST_ANCHORS:
        raise ValueError(f"anchors are examples of a category, {BROADCAST_ANCHORS} at most in all")
    grouped = F.broadcast(anchors.groupBy("category").agg(F.collect_list("embedding").alias("anchors")))
    best = F.array_max(F.transform("anchors", lambda a: dot(a, F.col("embedding"))))
    pairs = vectors.where("embedding is not null").select(F.col(id_col).alias("id"), "embedding").join(grouped)
    return pairs.select("id", "category", F.least(F.greatest(best, F.lit(0.0)), F.lit(1.0)).alias("similarity"))


def display_name(category: Column, profile: Profile) -> Column:
    if not profile.display:
        return category
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in profile.display.items() for x in kv]), category), category)
