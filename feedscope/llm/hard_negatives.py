"""Hard negatives of anchor rows by exact integer scores, with angular triangle filtering.

Each row stores its norm and its angles to a few reference directions. The angle between two rows lies between the
largest difference of their angles to a reference and the smallest sum, so its cosine lies in an interval, and the
norms turn that into bounds of the score. Bounds are widened by what rounding can move them, and whole numbers beside
them. Of a tile of anchors and rows only the pairs whose bounds overlap a window that is asked for are scored, in
integers: for positives, the window opens at the anchor's fifth largest lower bound; for negatives the windows are
those of its positives' scores, 80 % to 100 % of each.

Rows are dealt out by a key of their own to groups of bounded size (GROUP on average), and a copy of the anchors goes to
each group, where they stream past the group's rows, TILE anchors at a time. A group gives the best few of each anchor;
these meet by anchor and are ranked. So no task holds more than a group's rows and a tile, and no pair becomes a row
unless it is among the best of its group. The anchors, a stated query set, are never gathered.

The reference directions are centres of a spherical k-means over SAMPLE rows with the smallest hashes. They only decide how
many pairs are scored, never which rows are returned.

Defined cases: rows with a null label or vector, or null or non-finite entries, take no part; a null vec_id is an id that
stands after all others and is no anchor; rows that share a vec_id are rows like others, anchors each for itself; a shorter
vector counts as ending in zeros; an anchor without positives, or a positive without negatives in its window (as for scores
below 0), gives no row; an empty table gives an empty result; scores that don't fit a long are an error; columns other
than vec_id, embedding and label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedscope.llm.common import materialise, slices
from feedscope.llm.vectors import blobs, floored, matrix, widened

SCALE = 256
POSITIVES = NEGATIVES = 5
#: A negative's score is this share of its positive's at least.
LEAST_PERCENT = 80
REFERENCES, SAMPLE, TURNS = 24, 2048, 8
#: Rows of a group on average, and at least where there are few; anchors of a tile.
GROUP, LEAST_GROUP, TILE = 16_384, 512, 128
#: What rounding of angles to single precision and of their cosines may move an angle (radians) and a score (its share).
ANGLE_SLACK, SCORE_SLACK = 1e-5, 1e-9
PAIRS = 1 << 16

_PREPARED = "vec_id long, label long, x binary, norm double, angles binary"


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 4096):
        _, x = floored(b.column("embedding"), SCALE)
        yield pa.record_batch([blobs(x)], names=["x"])


def references(embeddings: DataFrame) -> tuple[int, np.ndarray]:
    """(width of the longest vector, unit reference directions as columns) from a sample of bounded size."""
    width = max(0, embeddings.agg(F.max(F.size("embedding"))).first()[0] or 0)  # the size of null may be -1
    some = embeddings.where(F.col("embedding").isNotNull()).select("embedding", F.xxhash64("vec_id", "embedding").alias("h")).orderBy("h").limit(SAMPLE).select("embedding")
    rows = [np.frombuffer(x, np.int64).astype(float) for x in some.mapInArrow(_sample, "x binary").toArrow()["x"].to_pylist()]
    x = np.array([np.pad(r, (0, width - len(r))) for r in rows]).reshape(len(rows), width)
    size = np.linalg.norm(x, axis=1)
    x = x[size > 0] / size[size > 0, None]
    if not len(x):
        return width, np.zeros((width, 0))
    centres = x[np.random.default_rng(11).permutation(len(x))[:REFERENCES]]
    for _ in range(TURNS):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.array([x[nearest == k].sum(axis=0) for k in range(len(centres))])
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-9, sums / np.where(length > 1e-9, length, 1), centres)
    return width, centres.T


def prepare(embeddings: DataFrame) -> tuple[DataFrame, int, int]:
    """(the rows that take part with norms and angles, written once; width; number of references)."""
    width, refs = references(embeddings)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.where(F.col("label").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), moved.cast("long").alias("label"), "embedding")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            fine, x = floored(b.column("embedding"), SCALE)
            x, b = widened(x, width), b.filter(pa.array(fine))
            f = x.astype(np.float64)
            norm = np.linalg.norm(f, axis=1)
            cosine = (f @ refs) / np.where(norm > 0, norm, 1)[:, None]
            angles = np.arccos(np.clip(cosine, -1, 1)).astype(np.float32)
            yield pa.record_batch([b.column("vec_id"), b.column("label"), blobs(x), pa.array(norm), blobs(angles)], names=["vec_id", "label", "x", "norm", "angles"])

    found = rows.mapInArrow(work, _PREPARED).withColumn("row", F.monotonically_increasing_id())
    return materialise(found, "vectors"), width, refs.shape[1]


class Rows:
    """Vectors with what is stored of them."""

    def __init__(self, batches: list[pa.RecordBatch], width: int, n_refs: int) -> None:
        b = pa.Table.from_batches(batches).combine_chunks()
        ids = b["vec_id"].combine_chunks()
        self.no_id = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.row, self.label, self.norm = (b[c].to_numpy() for c in ("row", "label", "norm"))
        self.x = matrix(b["x"], np.int64, width)
        self.angles = matrix(b["angles"], np.float32, n_refs)
        self.scores = b["scores"].to_pylist()
        self.most = int(np.abs(self.x).max(initial=0))


def score_bounds(a: Rows, b: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of each row of ``a`` with each of ``b``, safe against rounding."""
    least, most = np.zeros((len(a.x), len(b.x)), np.float32), np.full((len(a.x), len(b.x)), np.pi, np.float32)
    for k in range(a.angles.shape[1]):
        p, q = a.angles[:, k, None], b.angles[None, :, k]
        np.maximum(least, np.abs(p - q), out=least)
        total = p + q
        np.minimum(most, np.minimum(total, np.float32(2 * np.pi) - total), out=most)
    size = a.norm[:, None] * b.norm[None, :]
    slack = SCORE_SLACK * size + 1
    high = np.cos(np.maximum(least - np.float32(ANGLE_SLACK), 0).astype(np.float64)) * size + slack
    low = np.cos(np.minimum(most + np.float32(ANGLE_SLACK), np.pi).astype(np.float64)) * size - slack
    return low, high


def exact_scores(a: Rows, b: Rows, wanted: np.ndarray) -> np.ndarray:
    """Integer inner products of the wanted pairs of a tile, in the order of ``np.nonzero``."""
    i, j = np.nonzero(wanted)
    bound = a.most * b.most * max(1, a.x.shape[1])
    if bound < 2**53 and 8 * len(i) > wanted.size:  # doubles hold all partial sums, so that this is exact as well
        return (a.x.astype(np.float64) @ b.x.T.astype(np.float64))[i, j].astype(np.int64)
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), PAIRS):
        p, q = a.x[i[at : at + PAIRS]], b.x[j[at : at + PAIRS]]
        if bound < 2**63:
            out[at : at + PAIRS] = np.einsum("ij,ij->i", p, q)
        else:  # OverflowError where a score doesn't fit
            out[at : at + PAIRS] = [sum(int(u) * int(v) for u, v in zip(s, t, strict=True)) for s, t in zip(p, q, strict=True)]
    return out


def _best(scores: np.ndarray, b: Rows, j: np.ndarray) -> np.ndarray:
    """The order of pairs: highest score, smallest id, rows without an id last."""
    return np.lexsort((b.ids[j], b.no_id[j], -scores))


def near_ones(a: Rows, b: Rows) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, 0, score, row) of the best rows with the anchor's label, the anchor itself among them."""
    low, high = score_bounds(a, b)
    same, keep = a.label[:, None] == b.label[None, :], POSITIVES + 1
    low = np.where(same, low, -np.inf)
    floor = np.partition(low, -keep, axis=1)[:, -keep] if low.shape[1] >= keep else np.full(len(low), -np.inf)
    wanted = same & (high >= floor[:, None])
    scores, (i, j) = exact_scores(a, b, wanted), np.nonzero(wanted)
    ends = np.searchsorted(i, np.arange(len(a.x) + 1))
    for k in range(len(a.x)):
        s, c = scores[ends[k] : ends[k + 1]], j[ends[k] : ends[k + 1]]
        for o in _best(s, b, c)[:keep]:
            yield k, 0, s[o], c[o]


def window(score: int) -> tuple[int, int]:
    """The least and the largest score of a negative; empty for scores below 0."""
    return -(-LEAST_PERCENT * score // 100), score


def near_misses(a: Rows, b: Rows) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, number of its positive, score, row) of the best rows of another label in each positive's window."""
    low, high = score_bounds(a, b)
    asked = [[window(p) for p in scores] for scores in a.scores]
    wanted = np.zeros(low.shape, bool)
    for k, windows in enumerate(asked):
        for least, most in windows:
            if least <= most:
                wanted[k] |= (high[k] >= least) & (low[k] <= most)
    wanted &= a.label[:, None] != b.label[None, :]
    scores, (i, j) = exact_scores(a, b, wanted), np.nonzero(wanted)
    ends = np.searchsorted(i, np.arange(len(a.x) + 1))
    for k, windows in enumerate(asked):
        s, c = scores[ends[k] : ends[k + 1]], j[ends[k] : ends[k + 1]]
        inside = (s >= min((w[0] for w in windows), default=0)) & (s <= max((w[1] for w in windows), default=-1))
        s, c = s[inside], c[inside]
        order = _best(s, b, c)
        s, c = s[order], c[order]
        for number, (least, most) in enumerate(windows):
            first = int(np.searchsorted(-s, -most))
            for o in range(first, min(first + NEGATIVES, len(s))):
                if s[o] >= least:
                    yield k, number, s[o], c[o]


def _met(batches: Iterator[pa.RecordBatch], find, width: int, n_refs: int) -> Iterator[pa.RecordBatch]:
    """Rows of a group, then the anchors: the anchors stream past the rows."""
    group, rows, held = None, [], None
    for batch in batches:
        g = batch.column("g").to_numpy()
        kind = batch.column("kind").to_numpy()
        cuts = np.flatnonzero(np.diff(g) | np.diff(kind)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(g)], strict=True):
            if start == end:
                continue
            part = batch.slice(start, end - start)
            if g[start] != group:
                group, rows, held = g[start], [], None
            if kind[start] == 0:
                rows.append(part)
                continue
            if not rows and held is None:
                continue
            held, rows = held or Rows(rows, width, n_refs), []
            for at in range(0, part.num_rows, TILE):
                a = Rows([part.slice(at, TILE)], width, n_refs)
                found = list(find(a, held))
                k, number, score, j = (np.array(c, np.int64) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 4
                yield pa.record_batch([pa.array(a.row[k]), pa.array(number.astype(np.int32)), pa.array(score), pa.array(held.ids[j], mask=held.no_id[j])], names=["anchor", "number", "score", "vec_id"])


def meet(rows: DataFrame, anchors: DataFrame, find, width: int, n_refs: int) -> DataFrame:
    """anchor, number, score, vec_id: the best rows of every group for each anchor, by ``find``."""
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = rows.count()  # of a written table: read from its footers
    groups = max(1, min(max(4 * tasks, -(-n // GROUP)), n // LEAST_GROUP))
    cols = ("g", "kind", "row", "vec_id", "label", "x", "norm", "angles", "scores")
    dealt = rows.select(F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("kind"), "row", "vec_id", "label", "x", "norm", "angles", F.array().cast("array<long>").alias("scores"))
    copies = anchors.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("kind", F.lit(1))
    both = dealt.select(*cols).unionByName(copies.select(*cols)).repartition(min(tasks, groups), "g").sortWithinPartitions("g", "kind")
    return both.mapInArrow(lambda it: _met(it, find, width, n_refs), "anchor long, number int, score long, vec_id long")


def _ranked(df: DataFrame, by: list[str], most: int, name: str) -> DataFrame:
    order: list[Column] = [F.desc("score"), F.asc_nulls_last("vec_id")]
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= most)


def mine(embeddings: DataFrame, is_anchor: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``is_anchor`` reads vec_id and label."""
    rows, width, n_refs = prepare(embeddings)
    anchors = rows.where(F.col("vec_id") % 100 == 0 if is_anchor is None else is_anchor)
    near = meet(rows, anchors.withColumn("scores", F.array().cast("array<long>")), near_ones, width, n_refs)
    best = _ranked(near, ["anchor"], POSITIVES + 1, "k")
    # the anchor itself is one of the rows with its id and the score of its own length: one of these goes
    own = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "x")
    own = own.mapInArrow(_with_own_score(width), "anchor long, anchor_id long, self long")
    best = best.join(own, "anchor").withColumn("itself", (F.col("vec_id") == F.col("anchor_id")) & (F.col("score") == F.col("self")))
    once = F.row_number().over(Window.partitionBy("anchor", "itself").orderBy("k"))
    others = best.withColumn("once", once).where(~F.coalesce("itself", F.lit(False)) | (F.col("once") > 1))
    positives = _ranked(others.select("anchor", "anchor_id", "score", "vec_id"), ["anchor"], POSITIVES, "k")
    positives = materialise(positives.select("anchor", "anchor_id", (F.col("k") - 1).alias("number"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    lists = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("number", "positive_score")))["positive_score"].alias("scores"))
    seekers = anchors.join(lists.withColumnRenamed("anchor", "row"), "row")
    misses = _ranked(meet(rows, seekers, near_misses, width, n_refs), ["anchor", "number"], NEGATIVES, "rank")
    out = misses.join(positives, ["anchor", "number"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _with_own_score(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            x = matrix(b.column("x"), np.int64, width)
            fits = int(np.abs(x).max(initial=0)) ** 2 * max(1, width) < 2**63
            own = (x * x).sum(axis=1) if fits else [sum(int(c) ** 2 for c in r) for r in x]
            yield pa.record_batch([b.column("anchor"), b.column("anchor_id"), pa.array(own, pa.int64())], names=["anchor", "anchor_id", "self"])

    return work


ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * c::DOUBLE) FOR c IN embedding] AS x, row_number() OVER () AS r
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
s AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, a.label = e.label AS same, e.vec_id, list_inner_product(a.x, e.x)::BIGINT AS score
  FROM e AS a JOIN e ON a.r <> e.r WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS k FROM s WHERE same QUALIFY k <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.k ORDER BY s.score DESC, s.vec_id) AS rank,
    s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score QUALIFY rank <= 5)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n
"""
