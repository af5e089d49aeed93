"""Token ids in fixed-width bit packing, written to and read from binary shard files.

Texts become ids with a public tokenizer; every id takes the least number of bits that holds the vocabulary. Documents
are in ascending id order over the shards: a shard is a range of ids, so its files are sorted without one global sort.

Shard file (little endian):
    header   8s magic, u32 version, u32 bits, u32 ids per block, u64 documents, u64 ids, u64 blocks
    docs     documents x (i64 id, u8 has id, u64 first id of the document in this shard)
    offsets  (blocks + 1) x u64, byte offset of each block in the payload
    payload  blocks; each holds its ids, least significant bits first, padded to a whole byte
A block holds a multiple of 8 ids, so any width ends on a byte and any block can be read alone: ``ShardFile.read`` finds
the blocks of a range by the offsets and unpacks them with numpy.

Files are written under an attempt's own name and renamed when complete, so a task that runs again after a lost
executor leaves one whole file. A manifest of one row per shard goes back to the driver and carries the counts.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import common

MAGIC, VERSION = b"NLTOKENS", 1
_HEAD = struct.Struct("<8sIIIQQQ")
_LEAST = -(1 << 63)
_DOC = np.dtype([("id", "<i8"), ("has", "u1"), ("first", "<u8")])


def width(vocabulary: int) -> int:
    """Bits for ids 0 .. vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    digits = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(digits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of packed bytes: one gather of 8-byte windows, one shift and one mask."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    at = np.arange(n, dtype=np.int64) * bits
    raw = np.frombuffer(data + b"\0" * 8, np.uint8)
    words = np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        words |= raw[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((words >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def encode_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: int, block: int = 4096) -> Iterator[bytes]:
    """The bytes of a shard file, in pieces."""
    if block % 8:
        raise ValueError("a block holds a multiple of 8 ids")
    blocks = -(-len(ids) // block)
    docs = np.zeros(len(doc_ids), _DOC)
    docs["id"] = [d or 0 for d in doc_ids]
    docs["has"] = [d is not None for d in doc_ids]
    docs["first"][1:] = np.cumsum(lengths)[:-1]
    last = len(ids) - (blocks - 1) * block if blocks else 0
    offsets = np.arange(blocks + 1, dtype=np.uint64) * np.uint64(block * bits // 8)
    if blocks:
        offsets[-1] = (blocks - 1) * (block * bits // 8) + -(-last * bits // 8)
    yield _HEAD.pack(MAGIC, VERSION, bits, block, len(doc_ids), len(ids), blocks)
    yield docs.tobytes()
    yield offsets.astype("<u8").tobytes()
    step = 64 * block
    for i in range(0, len(ids), step):
        yield pack(ids[i : i + step], bits)


class ShardFile:
    """Random access to one shard through any seekable binary file."""

    def __init__(self, file):
        self._file = file
        magic, version, self.bits, self.block, self.documents, self.ids, blocks = _HEAD.unpack(self._read(0, _HEAD.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard of this version")
        at = _HEAD.size
        self.docs = np.frombuffer(self._read(at, self.documents * _DOC.itemsize), _DOC)
        at += self.documents * _DOC.itemsize
        self.offsets = np.frombuffer(self._read(at, 8 * (blocks + 1)), "<u8")
        self._payload = at + 8 * (blocks + 1)

    def _read(self, at: int, n: int) -> bytes:
        self._file.seek(at)
        data = self._file.read(n)
        if len(data) != n:
            raise ValueError("the shard is cut short")
        return bytes(data)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start .. stop - 1 of the shard; reads only the blocks that hold them."""
        if start >= stop:
            return np.empty(0, np.uint32)
        a, b = start // self.block, -(-stop // self.block)
        data = self._read(self._payload + int(self.offsets[a]), int(self.offsets[b] - self.offsets[a]))
        first = a * self.block
        return unpack(data, min(b * self.block, self.ids) - first, self.bits)[start - first : stop - first]

    def document(self, i: int) -> np.ndarray:
        stop = int(self.docs["first"][i + 1]) if i + 1 < self.documents else self.ids
        return self.read(int(self.docs["first"][i]), stop)


def bytes_to_letters() -> list[str]:
    """The printable letter that byte-level tokenizers write for each byte: itself where it prints, else 256 and up."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


#: A word of Latin-1 letters and the punctuation after it. Such letters are composed already and lower-case one by one.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")
_BYTE_LETTERS = {b: c for b, c in enumerate(bytes_to_letters())}


class _ChunkIds(dict):
    """Chunk -> its ids as bytes, remembered up to ``limit`` chunks.

    A plain word goes to the library's own model without normaliser and splitter, which change nothing in it but its
    case; everything else goes through the whole tokenizer.
    """

    def __init__(self, tokenizer, kind: np.dtype, plain: bool, limit: int):
        super().__init__()
        self._tokenizer, self._model, self._kind, self._plain, self._limit = tokenizer, tokenizer.model, kind, plain, limit
        self._tails: dict[str, bytes] = {"": b""}

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, self._kind).tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        plain = self._plain and len(text) <= 64 and _PLAIN.fullmatch(text)
        if plain:
            head, tail = plain.groups()
            if tail not in self._tails:
                if len(self._tails) > 10_000:
                    self._tails = {"": b""}
                self._tails[tail] = self._whole(tail)
            letters = head.lower().encode().decode("latin-1").translate(_BYTE_LETTERS)
            ids = np.array([t.id for t in self._model.tokenize(letters)], self._kind).tobytes() + self._tails[tail]
        else:
            ids = self._whole(text)
        if len(self) >= self._limit:
            self.clear()
        self[chunk] = ids
        return ids


#: How a tokenizer writes its pieces whose splitter drops white space and whose words are lower-cased bytes.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def splits_at_white_space(path: str) -> bool:
    """Whether a tokenizer's own file says that its ids of a text are those of the text's chunks between white space.

    Only the one form of files is known for which this was tested; of any other the answer is no.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = {"type": "Split", "pattern": {"Regex": _WORD_SPLIT}, "behavior": "Removed", "invert": True}
    letters = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    return letters and steps[0] == split and (spec.get("normalizer") or {}).get("normalizers") == _WORD_NORMALISER and spec.get("post_processor") is None and spec["model"].get("type") == "BPE"


class Encoder:
    """Ids of a text through the tokenizers library.

    Without ``by_chunk`` and ``plain`` the tokenizer's own file decides; set, they are refused where it does not allow them.
    ``by_chunk`` is for tokenizers of which no token spans white space and white space itself has no token: the
    ids of a text are then those of its chunks, one after another. Chunks split at ASCII white space only; any other
    white space stays inside a chunk, for the library to see. ``plain`` is for those that, too, lower-case,
    keep runs of letters and runs of punctuation apart and map bytes to letters.
    """

    def __init__(self, path: str, by_chunk: bool | None, end_id: int, plain: bool | None = None, limit: int = 700_000):
        from tokenizers import Tokenizer

        fit = splits_at_white_space(path)
        if (by_chunk or plain) and not fit:
            raise ValueError(f"{path} doesn't say that its ids are those of chunks between white space")
        by_chunk, plain = (fit if x is None else x for x in (by_chunk, plain))

        self._tokenizer = Tokenizer.from_file(path)
        self.vocabulary = max(self._tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self._end = np.array([end_id], self.dtype).tobytes()
        self._ids = _ChunkIds(self._tokenizer, self.dtype, plain, limit) if by_chunk else None

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids and the end id, as bytes of ``dtype``."""
        if self._ids is None:
            found = self._tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
            return [np.array(e.ids, self.dtype).tobytes() + self._end for e in found]
        get = self._ids.__getitem__
        return [b"".join(map(get, t.encode().split())) + self._end if t else self._end for t in texts]


def _filesystem(uri: str):
    """The file system and path of a folder that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def _write_shards(folder: str, block: int, file_ids: int):
    """Encoded documents of one shard, sorted -> its files, each closed at ``file_ids`` ids, and their manifest rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids: list[int | None] = []
        pieces: list[bytes] = []
        system, root = _filesystem(folder)
        shard, part, held, bits, wide = 0, 0, 0, 0, 2

        def close() -> pa.RecordBatch:
            lengths = np.array([len(p) // wide for p in pieces], np.int64)
            ids = np.frombuffer(b"".join(pieces), f"<u{wide}")
            name, draft = f"shard-{shard:06d}-{part:04d}.tok", f"{root}/.{shard:06d}-{part:04d}-{uuid.uuid4().hex}"
            with system.open_output_stream(draft) as out:
                for piece in encode_shard(doc_ids, lengths, ids, bits, block):
                    out.write(piece)
            system.move(draft, f"{root}/{name}")
            row = [pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([name]), pa.array([len(doc_ids)], pa.int64()), pa.array([len(ids)], pa.int64())]
            doc_ids.clear()
            pieces.clear()
            return pa.RecordBatch.from_arrays(row, ["shard", "part", "file", "documents", "ids"])

        for batch in batches:
            if not batch.num_rows:
                continue
            system.create_dir(root, recursive=True)
            shard, bits, wide = (batch.column(i)[0].as_py() for i in (0, 3, 4))
            for doc_id, ids in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                doc_ids.append(doc_id)
                pieces.append(ids)
                held += len(ids) // wide
                if held >= file_ids:
                    yield close()
                    part, held = part + 1, 0
        if doc_ids:
            yield close()

    return run


def _encode_batches(tokenizer: str, by_chunk: bool | None, end_id: int, bounds: list[int], cut: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(tokenizer, by_chunk, end_id)
        bits, wide = width(encoder.vocabulary), encoder.dtype.itemsize
        cuts = np.array(bounds, np.int64)
        for whole in batches:
            for i in range(0, whole.num_rows, cut):
                batch = whole.slice(i, cut)
                ids = encoder.encode(batch.column(1).to_pylist())
                n = batch.num_rows
                shard = np.searchsorted(cuts, batch.column(0).fill_null(_LEAST).to_numpy(), "left").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0), pa.array(ids, pa.binary()), pa.array([bits] * n, pa.int32()), pa.array([wide] * n, pa.int32())], ["shard", "doc_id", "ids", "bits", "wide"])

    return run


def _read_shards(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_file(f"{root}/{name}") as file:
                    f = ShardFile(file)
                    starts = np.append(f.docs["first"], f.ids).astype(np.int64)
                    for a in range(0, f.documents, 2048):
                        b = min(a + 2048, f.documents)
                        ids = f.read(int(starts[a]), int(starts[b])).astype("<u4")
                        own = starts[a : b + 1] - starts[a]
                        crc = [zlib.crc32(ids[own[i] : own[i + 1]]) for i in range(b - a)]
                        has = f.docs["has"][a:b].astype(bool)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(f.docs["id"][a:b], mask=~has), pa.array(starts[a:b] + first), pa.array(np.diff(starts[a : b + 1])), pa.array(crc, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return run


def shard_bounds(docs: DataFrame, shards: int) -> list[int]:
    """At most shards - 1 ids that cut the documents into ranges of about equal numbers; reads the id column alone."""
    if shards < 2:
        return []
    cuts = docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [i / shards for i in range(1, shards)], 0.25 / shards)
    return sorted({int(c) for c in cuts})


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    end_id: int = 1,
    by_chunk: bool | None = None,
    shards: int | None = None,
    block: int = 4096,
    file_ids: int = 1 << 25,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> list[tuple[int, int, str, int, int]]:
    """Write ``docs`` as token shards into a shared folder, ascending by id; the manifest (shard, part, file, documents, ids).

    Null and empty texts have the end id alone. Null ids come first. Rows that repeat an id are all written, in the
    order of their ids' bytes. An empty table writes no file. Other columns are ignored. The manifest has one row per
    file; a writing task holds one file's ids at a time.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bounds = shard_bounds(base, shards or common.partitions(docs.sparkSession))
    encoded = base.mapInArrow(_encode_batches(tokenizer, by_chunk, end_id, bounds), "shard int, doc_id long, ids binary, bits int, wide int")
    dealt = encoded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    manifest = dealt.mapInArrow(_write_shards(folder, block, file_ids), "shard int, part int, file string, documents long, ids long")
    return sorted(tuple(r) for r in manifest.collect())


def read_tokens(spark: SparkSession, folder: str, manifest: list[tuple[int, int, str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files of a manifest."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)
    rows, first = [], 0
    for _, _, name, _, ids in manifest:
        rows.append((name, first))
        first += ids
    listed = spark.createDataFrame(rows, "file string, first long").repartition(len(rows))
    return listed.mapInArrow(_read_shards(folder), schema)


def tokens_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, by_chunk: bool | None = None, **options) -> DataFrame:
    """Write to a new folder in the shared one, then read the files back."""
    folder = common.scratch_path(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, folder, write_tokens(docs, tokenizer, folder, end_id, by_chunk, **options))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as ids of the public word tokenizer, which drops white space, so chunks are encoded alone."""
    return tokens_round_trip(common.table(spark, sf_dir, "documents"), tokenizer_path())
