"""Token-ID files: independent zstandard frames, a trailing seek table and per-frame checksums.

A shard file holds one frame for each document (its ids as little-endian unsigned 32-bit integers), a skippable
frame with the documents' ids and lengths, and the seek table of the zstandard seekable format: a skippable
frame with each frame's compressed and decompressed size and the low 32 bits of the xxHash64 of its content,
ended by the table's magic number. Readers decompress the frames of requested documents only.

Shards are made in parallel over ranges of doc_id and written by Spark's text writer: one row is one file, and
the line separator that ends it is the seek table's magic number.

``write_index`` lists each shard's documents from first to last, so that a reader opens those shards only that may hold
the requested ones.

Defined cases: a null or empty text is empty and has the end id alone; a very long text is one frame; a null doc_id comes
first; rows that share a doc_id are stored each, in any order among themselves; an empty table writes no shard and reads
back as no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedscope.llm.common import lean, materialise, scratch_path, slices

END_ID = 1
#: Fixed values of the zstandard seekable format: skippable frames of the table and of our index, its end.
SEEK_FRAME, INDEX_FRAME, MAGIC = 0x184D2A5E, 0x184D2A5D, b"\xb1\xea\x92\x8f"
#: Compressed bytes and documents of a shard, and the distinct words that a worker remembers.
SHARD_BYTES, SHARD_DOCS, REMEMBERED = 4_000_000, 20_000, 250_000
_SKIP = struct.Struct("<II")
#: The characters that stand for bytes in byte-level vocabularies: printable Latin-1 stands for itself, the other
#: bytes in order for the characters from U+0100 on.
BYTES = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b))}


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Remembered(dict):
    """Ids by string, made when first asked for; in two generations, so that frequent strings stay."""

    def __init__(self, make) -> None:
        self.make, self.old = make, {}

    def __missing__(self, w: str) -> bytes:
        v = self.old.get(w)
        if v is None:
            v = self.make(w)
        self[w] = v
        return v

    def turn(self) -> None:
        """When the young generation is full, it becomes the old one."""
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Ids of whole texts by the tokenizers library, where it allows word by word with a memory of words.

    A tokenizer that lower-cases, splits by one pattern, drops what lies between and marks the end of words gives
    each match of the pattern ids of its own, and no match crosses white space. What stands between white space is
    remembered with its ids; new stretches are cut by the pattern, and distinct new matches are encoded by
    the tokenizer's model. Texts with characters beyond U+024F, where normalisation or letter tables could matter, with separators
    that are white space to Python only, or with "<|" (added tokens) are encoded as they are.
    """

    def __init__(self, path: str) -> None:
        import json

        self.tok, self.memory = _tokenizer(path), _Remembered(self._stretch)
        spec = json.loads(self.tok.to_str())
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        norm = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers") or []]
        suffix = spec["model"].get("end_of_word_suffix")
        words = pre[0].get("type") == "Split" and pre[0].get("behavior") == "Removed" and pre[0].get("invert") and [p.get("type") for p in pre[1:]] == ["ByteLevel"]
        self.pattern = regex.compile(pre[0]["pattern"]["Regex"]) if words and norm == ["NFC", "Replace", "Lowercase"] and suffix else None
        self.plain = re.compile("[\x00-\x1b\x20-\x84\x86-ɏ]*")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, match: str) -> bytes:
        plain = match.isascii() and match.isprintable()
        return array("I", [t.id for t in self.tok.model.tokenize(match if plain else match.encode().decode("latin-1").translate(BYTES))]).tobytes()

    def _stretch(self, w: str) -> bytes:
        """Ids of what stands between white space; of letters alone it is a match itself, and others share matches."""
        if w.isalpha():
            return self._ids(w)
        parts, known = [], self.memory
        for m in self.pattern.findall(w):
            parts.append(known[m] if m != w else self._ids(m))
        return b"".join(parts)

    def encode(self, texts: Sequence[str]) -> Iterator[bytes]:
        get = self.memory.__getitem__
        for text in texts:
            if self.pattern is None or "<|" in text or not self.plain.fullmatch(text):
                yield self._whole(text)
            else:
                yield b"".join(map(get, text.lower().split()))
                self.memory.turn()


_encoders: dict[str, Encoder] = {}


def seal(frames: list[bytes], sizes: list[int], sums: list[int], docs: list[int | None], order: tuple[int, int]) -> bytes:
    """A shard's bytes without the magic number at its end; documents without an id are its first."""
    index = struct.pack("<III", *order, docs.count(None)) + np.array([d or 0 for d in docs], "<i8").tobytes() + np.array(sizes, "<u8").tobytes()
    table = b"".join(struct.pack("<III", len(f), n, s) for f, n, s in zip(frames, sizes, sums, strict=True))
    foot = struct.pack("<IB", len(frames), 0x80)
    return b"".join((*frames, _SKIP.pack(INDEX_FRAME, len(index)), index, _SKIP.pack(SEEK_FRAME, len(table) + len(foot) + 4), table, foot))


def _shards(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = _encoders.setdefault(path, Encoder(path))
    z = zstandard.ZstdCompressor(level=1, write_content_size=True)
    task, number, held = TaskContext.get().partitionId(), 0, 0
    part: tuple[list, list, list, list] = ([], [], [], [])
    stop = struct.pack("<I", END_ID)
    for b in slices(batches):
        docs = b.column("doc_id").to_pylist()
        for doc, data in zip(docs, enc.encode([t or "" for t in b.column("text").to_pylist()]), strict=True):
            data += stop
            frame = z.compress(data)
            for c, v in zip(part, (frame, len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF, doc), strict=True):
                c.append(v)
            held += len(frame)
            if held >= SHARD_BYTES or len(part[0]) >= SHARD_DOCS:
                yield pa.record_batch([pa.array([seal(*part, (task, number))], pa.binary())], names=["value"])
                part, held, number = ([], [], [], []), 0, number + 1
    if part[0]:
        yield pa.record_batch([pa.array([seal(*part, (task, number))], pa.binary())], names=["value"])


def write_shards(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encode every whole text and write shard files in ascending doc_id order below ``path``."""
    tie = F.monotonically_increasing_id().alias("tie")  # rows without an id, or with the same one, are split like others
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tie)
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    shards = rows.mapInArrow(lambda it: _shards(it, tokenizer), "value binary").select(F.col("value").cast("string").alias("value"))
    with lean(docs.sparkSession):
        shards.write.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


class Shard:
    """Reads a shard's tables; decompresses single documents."""

    def __init__(self, data: bytes) -> None:
        if data[-4:] != MAGIC:
            raise ValueError("no seek table")
        n, flags = struct.unpack("<IB", data[-9:-4])
        table = np.frombuffer(data, "<u4", 3 * n, len(data) - 9 - 12 * n).reshape(n, 3)
        if not flags & 0x80:
            raise ValueError("no checksums")
        self.data, self.sizes, self.sums = data, table[:, 1], table[:, 2]
        self.stops = np.cumsum(table[:, 0].astype(np.int64))
        at = int(self.stops[-1]) if n else 0
        kind, length = _SKIP.unpack_from(data, at)
        if kind != INDEX_FRAME or length != 12 + 16 * n:
            raise ValueError("no index")
        *self.order, self.n_null = struct.unpack_from("<III", data, at + 8)
        self.docs = np.frombuffer(data, "<i8", n, at + 20)
        self._z = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.docs)

    def raw(self, k: int) -> bytes:
        """The bytes of the k-th document's ids, checked."""
        start = int(self.stops[k - 1]) if k else 0
        data = self._z.decompress(self.data[start : int(self.stops[k])])
        if len(data) != self.sizes[k] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def ids(self, k: int) -> np.ndarray:
        return np.frombuffer(self.raw(k), "<u4")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column("content"):
            s = Shard(content.as_py())
            n = (s.sizes // 4).astype(np.int64)
            crc = [zlib.crc32(s.raw(k)) for k in range(len(s))]
            docs = [None] * s.n_null + s.docs[s.n_null :].tolist()
            size = len(s)
            yield pa.record_batch([pa.array([s.order[0]] * size, pa.int64()), pa.array([s.order[1]] * size, pa.int64()), pa.array(docs, pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], names=["task", "number", "doc_id", "within", "n_tokens", "ids_crc32"])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every stored document, every frame's checksum verified."""
    rows = _files(spark, path).mapInArrow(_digests, "task long, number long, doc_id long, within long, n_tokens long, ids_crc32 long")
    rows = materialise(rows, "digests")  # the shards are read once
    # running sums over the shards of a task and over the tasks: a task's shards and the tasks are few
    totals = rows.groupBy("task", "number").agg(F.sum("n_tokens").alias("n"))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inner = totals.withColumn("inner", F.coalesce(F.sum("n").over(up_to(Window.partitionBy("task").orderBy("number"))), F.lit(0))).drop("n")
    outer = totals.groupBy("task").agg(F.sum("n").alias("n")).withColumn("outer", F.coalesce(F.sum("n").over(up_to(Window.orderBy("task"))), F.lit(0))).drop("n")
    offsets = inner.join(outer, "task").select("task", "number", (F.col("inner") + F.col("outer")).alias("offset"))
    return rows.join(offsets, ["task", "number"]).select("doc_id", (F.col("offset") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
            s = Shard(content.as_py())
            some = len(s) > s.n_null
            yield pa.record_batch([pa.array([path]), pa.array([len(s)], pa.int64()), pa.array([int(s.docs[s.n_null]) if some else None], pa.int64()), pa.array([int(s.docs[-1]) if some else None], pa.int64())], names=["path", "n_docs", "first", "last"])


def write_index(spark: SparkSession, path: str, index: str) -> None:
    """A table of the shards: path, n_docs, first and last doc_id."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    files.mapInArrow(_ranges, "path string, n_docs long, first long, last long").write.parquet(index)


def read_documents(spark: SparkSession, path: str, doc_ids: Sequence[int], index: str | None = None) -> DataFrame:
    """doc_id and ids of requested documents; other frames stay compressed, and with an index other shards unread.

    The list of ids is the caller's; the shards that are opened are at most as many as they reach into.
    """
    wanted = np.array(sorted(set(doc_ids)), np.int64)
    schema = "doc_id long, ids array<long>"

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                s = Shard(content.as_py())
                held = np.isin(s.docs, wanted)
                held[: s.n_null] = False
                for k in np.nonzero(held)[0]:
                    yield pa.record_batch([pa.array([int(s.docs[k])], pa.int64()), pa.array([s.ids(int(k)).tolist()], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    if index is None:
        return _files(spark, path).mapInArrow(pick, schema)
    asked = F.array(*[F.lit(int(d)) for d in wanted]) if len(wanted) else F.array().cast("array<bigint>")
    hit = spark.read.parquet(index).where(F.exists(asked, lambda d: d.between(F.col("first"), F.col("last"))))
    paths = [r["path"] for r in hit.select("path").collect()]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(pick, schema)


def shard_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the documents' shards to the shared folder and tell what reading them back gives."""
    path = scratch_path(docs.sparkSession, "shards")
    write_shards(docs, path, tokenizer)
    return read_digests(docs.sparkSession, path)
