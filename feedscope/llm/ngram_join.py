"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles; two documents are linked if the Jaccard similarity of their sets is 0.8 or
more. Rows with the same set form a text class, which one row stands for, whatever their doc_ids. Representatives meet
in MinHash bands (32 of four values: a pair at the threshold is missed with a chance of 5e-8). Inside a band's
bucket, pairs compare their MinHash values in steps; a pair is dropped once the posterior probability of
reaching the threshold, under a uniform prior, is below the tolerance; the others are verified exactly.

A bucket is never gathered whole: it is cut into blocks, bounded in members and in bytes, and a task sees two blocks at
most. First only the MinHash values travel there; the sets follow for those members of which a pair survived the
pruning. Pairs stay inside the task, which returns one row for each member it saw: its number of linked documents and
the smallest member it is connected with. Buckets with the same members are worked once, and a pair only in the first
band it shares.

Defined cases: a text without words (or null) links with nothing and is its own class; a text of one to four
words is one shingle; very long texts are sets like others; repeated rows count as copies, and a doc_id with several
texts has a row for each of its rows, each with the links of its own text; ties take the smallest doc_id; rows with a
null doc_id count as copies and links of others, but can't stand for a class in the result and have no row of their
own; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedscope.llm.common import drop_written, keyed, materialise, may_hold, slices, written, written_since

SHINGLE, SIMILARITY, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEPS = (16, 32, 64, 128)
#: Members in a block and bytes of their sets, on average: a task holds two blocks.
BLOCK, BLOCK_BYTES = 1024, 32_000_000
_WORD = re.compile(r"\w+")
_SIGNED = "row long, doc_id long, text_hash long, set_hash binary, n int, sig binary"
_PLACE = [("bkey", pa.int64()), ("bi", pa.int32()), ("bj", pa.int32()), ("band", pa.int32()), ("own", pa.int32()), ("rep", pa.int64()), ("copies", pa.int64()), ("n", pa.int32()), ("sig", pa.binary())]
_MEMBER, _GROUP = pa.schema(_PLACE), pa.schema([*_PLACE, ("sh", pa.binary())])
_MEMBER_SQL = "bkey long, bi int, bj int, band int, own int, rep long, copies long, n int, sig binary"


class _Words(dict):
    """Hashes of words, computed once; emptied when it has grown large."""

    def __missing__(self, w: str) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's five-word shingles."""
    found = _WORD.findall(text.lower()) if text else []
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    n = max(1, len(w) - SHINGLE + 1)
    h = w[:n].copy()
    for k in range(1, min(SHINGLE, len(w))):
        h = h * np.uint64(0x100000001B3) + w[k : k + n]
    return np.unique(_mix(h))


@lru_cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240101)
    return (r.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1))[:, None], r.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]


def signature(sh: np.ndarray) -> np.ndarray:
    """MinHash values of a set of shingle hashes; not for an empty set."""
    a, b = _multipliers()
    low = (sh >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        best = np.minimum(best, (low[None, at : at + 4096] * a + b).min(axis=1))
    return best


@lru_cache
def least_matches(t: float, tolerance: float) -> dict[int, int]:
    """For each step n, the fewest equal MinHash values with which a pair stays.

    With a uniform prior, the similarity after m matches of n has a Beta(m + 1, n - m + 1) posterior, and the
    probability that it reaches t is that of at most m successes in n + 1 trials at t.
    """
    from math import comb

    least = {}
    for n in STEPS:
        p, m = 0.0, 0
        for m in range(n + 1):
            p += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if p >= tolerance:
                break
        least[n] = m
    return least


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.binary(), pa.int32(), pa.binary())
    for b in slices(batches, 256):
        out: list[list] = [[] for _ in types]
        for text in b.column("text").to_pylist():
            sh = shingles(text)
            row = (xxhash.xxh128_digest(sh.tobytes()), len(sh), signature(sh).tobytes()) if len(sh) else (None, 0, None)
            for c, v in zip(out, row, strict=True):
                c.append(v)
        kept = [b.column(c) for c in ("row", "doc_id", "text_hash")]
        yield pa.record_batch([*kept, *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=["row", "doc_id", "text_hash", "set_hash", "n", "sig"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def text_classes(docs: DataFrame) -> DataFrame:
    """A row for each row: a key of its own, doc_id, the hash of its text, and its set's hash, size and MinHash values (null without words)."""
    rows = _texts(docs).withColumn("row", F.monotonically_increasing_id())
    return materialise(rows.mapInArrow(_signed, _SIGNED), "signed")


def band_keys(sig: Column) -> Column:
    """A hash of each band's MinHash values, read off the packed ones."""
    width = 4 * ROWS
    return F.array(*[F.xxhash64(F.substring(sig, 1 + width * k, width), F.lit(k)) for k in range(BANDS)])


def _shared_buckets(reps: DataFrame, block: int) -> DataFrame:
    """(bkey, band, n_blocks) of the buckets that two or more representatives share; equal ones once.

    Two buckets with the same count, the same xor of hashed members and the same smallest and largest member are
    the same set; the lowest band stands for all.
    """
    rows = reps.select("rep", "n", F.posexplode(band_keys(F.col("sig"))).alias("band", "bkey"))
    held = F.sum(F.col("n").cast("long") * 8).alias("held")
    by = rows.groupBy("bkey", "band").agg(F.count(F.lit(1)).alias("n"), held, F.bit_xor(F.xxhash64("rep")).alias("x"), F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    kept = by.where("n > 1").groupBy("n", "held", "x", "lo", "hi").agg(F.min(F.struct("band", "bkey")).alias("b"))
    return kept.select("b.bkey", "b.band", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("held") / BLOCK_BYTES)).cast("int").alias("n_blocks"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The members of each pair of blocks, from sorted rows."""
    group: list[tuple] = []
    for b in slices(batches):
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if group and row[:3] != group[0][:3]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def candidates(group: list[tuple], t: float, tolerance: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): the pairs of a pair of blocks that the pruning leaves and that share no earlier band."""
    _, bi, bj, band = group[0][:4]
    n = len(group)
    sig = np.frombuffer(b"".join(r[8] for r in group), np.uint32).reshape(n, HASHES)
    sizes, own = np.array([r[7] for r in group]), np.array([r[4] for r in group])
    least = least_matches(t, tolerance)
    for i in range(n - 1):
        if bi == bj:
            js = np.arange(i + 1, n)
        else:  # across two blocks only
            js = np.nonzero(own[i + 1 :] != own[i])[0] + i + 1
        # sets whose sizes alone rule the threshold out
        js = js[np.minimum(sizes[js], sizes[i]) >= t * np.maximum(sizes[js], sizes[i]) - 1e-9]
        at, m = 0, np.zeros(len(js), np.int64)
        for step in STEPS:
            if not len(js):
                break
            m = m + (sig[js, at:step] == sig[i, at:step]).sum(axis=1)
            stay = m >= least[step]
            js, m, at = js[stay], m[stay], step
        if band and len(js):  # pairs that share an earlier band are worked there
            earlier = (sig[js, : band * ROWS] == sig[i, : band * ROWS]).reshape(len(js), band, ROWS).all(axis=2).any(axis=1)
            js = js[~earlier]
        if len(js):
            yield i, js


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of representatives, from texts; a text whose hash is another one's by chance is passed over."""
    for b in slices(batches, 256):
        reps, out = [], []
        for rep, text, want in zip(*(b.column(c).to_pylist() for c in ("rep", "text", "set_hash")), strict=True):
            data = shingles(text).tobytes()
            if xxhash.xxh128_digest(data) == want:
                reps.append(rep)
                out.append(data)
        yield pa.record_batch([pa.array(reps, pa.int64()), pa.array(out, pa.binary())], names=["rep", "sh"])


def _surviving(batches: Iterator[pa.RecordBatch], t: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    """The members that are in any pair left: a row each, not one for each pair."""
    for group in _groups(batches):
        stay = np.zeros(len(group), bool)
        for i, js in candidates(group, t, tolerance):
            stay[i] = True
            stay[js] = True
        rows = [r for r, s in zip(group, stay, strict=True) if s]
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MEMBER, strict=True)], schema=_MEMBER)


def _linked(batches: Iterator[pa.RecordBatch], t: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    out: list[list] = [[], [], []]

    def rows() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["rep", "n_linked", "low"])

    for group in _groups(batches):
        for row in verify(group, t, tolerance):
            for c, v in zip(out, row, strict=True):
                c.append(v)
        if len(out[0]) > 5000:
            yield rows()
            out = [[], [], []]
    yield rows()


def verify(group: list[tuple], t: float = SIMILARITY, tolerance: float = TOLERANCE) -> Iterator[tuple[int, int, int]]:
    """(rep, documents linked, smallest rep connected) of the members of a pair of blocks that have links."""
    n = len(group)
    reps, copies = [r[5] for r in group], np.array([r[6] for r in group])
    sets = [np.frombuffer(r[9], np.uint64) for r in group]
    root = list(range(n))
    n_linked = np.zeros(n, np.int64)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, js in candidates(group, t, tolerance):
        for j in js:
            a, b = sets[i], sets[j]
            if len(a) > len(b):
                a, b = b, a
            where = np.searchsorted(b, a)
            both = int((b[np.minimum(where, len(b) - 1)] == a).sum())
            if both >= t * (len(a) + len(b) - both) - 1e-9:
                n_linked[i] += copies[j]
                n_linked[j] += copies[i]
                x, y = find(i), find(int(j))
                if x != y:
                    root[max(x, y, key=reps.__getitem__)] = min(x, y, key=reps.__getitem__)
    for i in range(n):
        if n_linked[i]:
            yield reps[i], int(n_linked[i]), reps[find(i)]


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, root) for the ends of (a, b) edges: root is the smallest id that a node is connected with.

    Large-star and small-star rounds by joins and minima, until a round changes nothing.
    """
    same = ["a", "b"]
    now = materialise(edges.where("a <> b").select(F.greatest(*same).alias("a"), F.least(*same).alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        now = materialise(small.where("a <> b").distinct(), "small")
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("root"))


def _classes(docs: DataFrame, signed: DataFrame, similarity: float, tolerance: float, block: int) -> DataFrame:
    """set_hash, text_id, class_id (smallest doc_ids of the set and of its component; null where none has one), n_links.

    The tables on the way are deleted as soon as nothing reads them.
    """
    spark, start = docs.sparkSession, written()
    first = F.min(F.struct(F.col("row").alias("rep"), F.col("doc_id").alias("rep_doc"), "text_hash")).alias("r")
    classes = signed.where(F.col("set_hash").isNotNull()).groupBy("set_hash").agg(first, F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("text_id"))
    classes = materialise(classes.select("set_hash", "r.*", "copies", "text_id"), "classes")
    reps = signed.select(F.col("row").alias("rep"), "n", "sig").join(classes.select("rep", "copies"), "rep")
    after_classes = written()
    shared = materialise(_shared_buckets(reps, block), "shared")
    places = reps.select("rep", "copies", F.posexplode(band_keys(F.col("sig"))).alias("band", "bkey"))
    places = may_hold(places, shared, "bkey", 1 << 18).join(shared, ["bkey", "band"])
    places = materialise(places.select("rep", "copies", "band", "bkey", "n_blocks"), "places")

    # MinHash values go to every pair of blocks that their block is in
    own = F.pmod(F.xxhash64("rep"), F.col("n_blocks").cast("long")).cast("int")
    values = may_hold(signed.select(F.col("row").alias("rep"), "n", "sig"), places, "rep")
    placed = values.join(places, "rep").withColumn("own", own)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    members = placed.select("bkey", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "band", "own", "rep", "copies", "n", "sig")
    key = ["bkey", "bi", "bj"]
    pruned = members.repartition(*key).sortWithinPartitions(*key).mapInArrow(lambda it: _surviving(it, similarity, tolerance), _MEMBER_SQL)
    pruned = materialise(pruned, "pruned")

    # the sets of those that are left are made from one text each, and follow
    wanted = pruned.select("rep").distinct().join(classes.select("rep", "rep_doc", "text_hash", "set_hash"), "rep").withColumnRenamed("text_hash", "wanted_hash")
    texts = may_hold(_texts(docs), wanted.select(F.col("wanted_hash").alias("text_hash")), "text_hash")
    texts = texts.join(wanted, (F.col("text_hash") == F.col("wanted_hash")) & F.col("doc_id").eqNullSafe(F.col("rep_doc"))).select("rep", "set_hash", "text").dropDuplicates(["rep"])
    sets = texts.mapInArrow(_sets, "rep long, sh binary")
    whole = pruned.join(sets, "rep").select(*_MEMBER.names, "sh").repartition(*key).sortWithinPartitions(*key)
    links = materialise(whole.mapInArrow(lambda it: _linked(it, similarity, tolerance), "rep long, n_linked long, low long"), "links")
    drop_written(spark, written_since(after_classes)[:-1])

    counts = links.groupBy("rep").agg(F.sum("n_linked").alias("n_linked"))
    roots = components(links.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    known = classes.join(counts, "rep", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    known = materialise(known.select("set_hash", "text_id", "root", (F.col("copies") - 1 + F.coalesce("n_linked", F.lit(0))).alias("n_links")), "known")
    drop_written(spark, written_since(start)[:-1])
    lowest = known.groupBy("root").agg(F.min("text_id").alias("class_id"))
    return known.join(lowest, "root")


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """A row for each row with a doc_id: doc_id, text_id (the smallest doc_id with its exact set), class_id (the smallest
    doc_id that it is connected with by links) and n_links (rows that it is linked with)."""
    signed = text_classes(docs)
    known = _classes(docs, signed, similarity, tolerance, block).select("set_hash", "text_id", "class_id", "n_links")
    out = signed.where(F.col("doc_id").isNotNull()).select("doc_id", "set_hash").join(known, "set_hash", "left")
    return out.select("doc_id", F.coalesce("text_id", "doc_id").alias("text_id"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def distinct_documents(docs: DataFrame, similarity: float = SIMILARITY, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """One row of each group of similar ones: one with the smallest doc_id, null being the largest; all its own columns.

    Rows are compared, not ids: copies under one doc_id or without one are copies like others.
    """
    rows, key = keyed(docs)
    found = similar_documents(rows.select(F.col(f"`{key}`").alias("doc_id"), "text"), similarity, tolerance, block).select(F.col("doc_id").alias(key), F.col("class_id").alias("class"))
    pairs = rows.select(F.col(key), F.col("doc_id").alias("doc")).join(found, key)
    first = F.min(F.struct(F.col("doc").isNull(), F.col("doc"), F.col(key))).getField(key)
    kept = materialise(pairs.groupBy("class").agg(first.alias(key)).select(key), "kept")  # so that the shuffles it took are gone before texts are shuffled
    return rows.join(kept.hint("merge"), key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
