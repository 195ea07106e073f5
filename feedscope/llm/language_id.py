"""Language identification by string kernels.

The blended-spectrum presence kernel of two texts counts the character n-grams (one to three) that both hold,
divided by the root of the product of their numbers of n-grams. Nystroem landmarks give the kernel a finite
form, one-versus-rest kernel ridge regression a score for each language. Texts are scored in batches by matrix
products: the landmarks' presence times the coefficients is taken once, so that presence times that product is the same
as presence by landmarks, then kernel values by coefficients.

The classifier is fitted on a bounded sample of labelled documents: SAMPLE for each language at most (by the
hash of doc_id), of those whose crc32(doc_id) mod 4 is not 2, and TOTAL of all languages, of which the TOTAL_LANDMARKS
with most rows are learnt. Executors find the sample by
a histogram of hashes and turn it into n-gram sets, each of BINS bits at most; these are all that is gathered. The
model that is sent to the executors has a number for each bin and language. Prediction reads texts alone, whole.

Defined cases: a text that is null or has no letter is ``und`` with score 0; very long texts are sets of n-grams like
others; a table without labelled rows gives ``und`` for all; ties take the language first in code point order; rows that
share a doc_id are sampled and predicted one by one, each by its own text and label, and rows without one are predicted
but not learnt from; an empty table gives
an empty result; columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedscope.llm.common import materialise, slices

#: Labelled rows and landmarks of a language, and of all languages together; bins of the n-gram hash.
SAMPLE, LANDMARKS, BINS = 400, 40, 1 << 18
TOTAL, TOTAL_LANDMARKS = 8000, 800
#: Buckets of the histogram of hashes: of each language, the sample is looked for among rows of the first buckets.
HISTOGRAM = 1 << 16
RIDGE = 1e-2
#: A text in a known language has this part of the share of known n-grams that all but a few sample rows have.
KNOWN_SLACK, KNOWN_QUANTILE = 0.9, 0.05
NGRAMS = (1, 2, 3)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for at in range(0, 0x110000, 0x1000):
        table[at : at + 0x1000] = [chr(c).isalpha() for c in range(at, at + 0x1000)]
    return table


def grams(text: str | None) -> np.ndarray:
    """The sorted distinct bins of a text's n-grams over lower-case letters and single gaps; empty without letters."""
    if not text:
        return np.empty(0, np.int64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return np.empty(0, np.int64)
    c = np.where(letter, c, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of other characters, the first stays as a gap
    c = np.concatenate(([np.uint32(32)], c[keep], [np.uint32(32)])).astype(np.uint32)
    here = np.zeros(BINS, bool)
    h = np.zeros(len(c), np.uint32)
    for n in NGRAMS:
        h = (h[: len(c) - n + 1] + c[n - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        here[(h * np.uint32(0x85EBCA6B)) >> np.uint32(14)] = True
    return np.nonzero(here)[0]


class Model:
    """Landmark sets over their joint n-grams, and the coefficients of the languages."""

    def __init__(self, langs: list[str], landmarks: list[np.ndarray]) -> None:
        self.langs = langs
        bins = np.unique(np.concatenate(landmarks)) if landmarks else np.empty(0, np.int64)
        self.column = np.full(BINS, -1, np.int32)
        self.column[bins] = np.arange(len(bins))
        self.marks = np.zeros((len(landmarks), len(bins)), np.float32)
        for row, g in zip(self.marks, landmarks, strict=True):
            row[self.column[g]] = 1 / np.sqrt(len(g))
        self.weights: np.ndarray | None = None
        self.least_known = 0.0

    def known(self, g: np.ndarray) -> float:
        """The share of a set's n-grams that a landmark holds."""
        return float((self.column[g] >= 0).mean()) if len(g) else 0.0

    def times(self, sets: list[np.ndarray], right: np.ndarray) -> np.ndarray:
        """The sets' normalised presence over the joint n-grams times a matrix, some sets at a time."""
        out = np.zeros((len(sets), right.shape[1]), np.float32)
        for at in range(0, len(sets), 128):
            some = sets[at : at + 128]
            x = np.zeros((len(some), len(right)), np.float32)
            for row, g in zip(x, some, strict=True):
                c = self.column[g]
                row[c[c >= 0]] = 1
            norm = np.sqrt([max(1, len(g)) for g in some]).astype(np.float32)
            out[at : at + 128] = (x @ right) / norm[:, None]
        return out

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Normalised kernel values of n-gram sets with the landmarks."""
        return self.times(sets, self.marks.T)

    def settle(self, coef: np.ndarray) -> None:
        """Take the coefficients; only their product with the landmarks is kept."""
        self.weights = self.marks.T @ coef.astype(np.float32)
        self.marks = self.marks[:0]

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        return self.times(sets, self.weights)


def train(langs: list[str], sets: list[np.ndarray]) -> Model:
    """Fit on (language, n-gram set) rows; the first LANDMARKS of each language are the landmarks."""
    names = sorted(set(langs))
    each = max(1, min(LANDMARKS, TOTAL_LANDMARKS // max(1, len(names))))
    firsts = [[g for x, g in zip(langs, sets, strict=True) if x == name][:each] for name in names]
    model = Model(names, [g for f in firsts for g in f])
    if not names:
        return model
    mm = model.kernel([g for f in firsts for g in f]).astype(np.float64)
    values, vectors = np.linalg.eigh((mm + mm.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = model.kernel(sets).astype(np.float64) @ root
    y = np.array([[1.0 if x == name else -1.0 for name in names] for x in langs])
    share = np.array([1 / langs.count(x) for x in langs])[:, None]  # languages count alike
    a = phi.T @ (phi * share) + RIDGE / len(phi) * np.eye(phi.shape[1])
    held = (model.marks > 0).sum(axis=0)  # a landmark's own n-grams count where another one holds them too
    own = {id(g) for f in firsts for g in f}
    shares = [float((held[model.column[g]] > 1).mean()) if id(g) in own else model.known(g) for g in sets]
    model.least_known = KNOWN_SLACK * float(np.quantile(shares, KNOWN_QUANTILE))
    model.settle(root @ np.linalg.solve(a, phi.T @ (y * share)))
    return model


def packed(g: np.ndarray) -> bytes:
    """A set as its bins, or as a bit for each bin where that is shorter: BINS / 8 bytes at most."""
    if 4 * len(g) < BINS // 8:
        return g.astype("<i4").tobytes()
    here = np.zeros(BINS, bool)
    here[g] = True
    return np.packbits(here).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if len(data) < BINS // 8:
        return np.frombuffer(data, "<i4").astype(np.int64)
    return np.nonzero(np.unpackbits(np.frombuffer(data, np.uint8)))[0]


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 64):
        sets = [packed(grams(t)) for t in b.column("text").to_pylist()]
        yield pa.record_batch([b.column("lang"), b.column("h"), b.column("doc_id"), pa.array(sets, pa.binary())], names=["lang", "h", "doc_id", "grams"])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labelled documents that aren't held out: ``sample`` of each language at most.

    The rows of a language are counted in buckets of their hash, before any is moved; only those up to the bucket in
    which the sample is full, a few more than the sample, are turned into sets and ranked.
    """
    h = F.xxhash64("doc_id")
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang", h.alias("h"))
    rows = rows.withColumn("bucket", F.pmod(F.shiftright("h", 24), F.lit(HISTOGRAM)))
    counts = rows.groupBy("lang", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full = F.max(F.when(F.col("before") < sample, F.col("bucket"))).alias("last")
    cuts = counts.withColumn("before", before).groupBy("lang").agg(full, F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(TOTAL_LANDMARKS)
    cuts = materialise(cuts.select("lang", "last"), "cuts")
    n_langs = cuts.count()
    most = max(1, min(sample, TOTAL // max(1, n_langs)))
    near = rows.join(F.broadcast(cuts), "lang").where(F.col("bucket") <= F.col("last"))  # TOTAL_LANDMARKS rows at most
    sets = near.select("lang", (F.col("bucket") * (1 << 40) + F.pmod("h", F.lit(1 << 40))).alias("h"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_gram_rows, "lang string, h long, doc_id long, grams binary")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "grams"))
    got = sets.withColumn("k", first).where(F.col("k") <= most).select("lang", "k", "grams").toArrow()
    got = got.sort_by([("lang", "ascending"), ("k", "ascending")])
    pairs = [(x, unpacked(g)) for x, g in zip(got["lang"].to_pylist(), got["grams"].to_pylist(), strict=True) if g]
    return train([x for x, _ in pairs], [g for _, g in pairs])


def _judged(texts: pa.Array, model: Model) -> Iterator[tuple[str, float, float]]:
    """Language, score and share of known n-grams of each text."""
    for at in range(0, len(texts), 256):
        sets = [grams(t.as_py()) for t in texts[at : at + 256]]
        if not model.langs:
            sets = [s[:0] for s in sets]
        values = model.scores(sets) if model.langs else np.zeros((len(sets), 1), np.float32)
        for s, v in zip(sets, values, strict=True):
            k = int(v.argmax())
            yield (model.langs[k], float(min(1.0, max(0.0, (v[k] + 1) / 2))), model.known(s)) if len(s) else ("und", 0.0, 0.0)


def _predicted(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = list(_judged(b.column("text"), model))
        yield pa.record_batch([b.column("doc_id"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], names=["doc_id", "lang_pred", "score"])


def _kept(batches: Iterator[pa.RecordBatch], model: Model, least: float) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        keep = [lang != "und" and score >= least and known >= model.least_known for lang, score, known in _judged(b.column("text"), model)]
        yield b.filter(pa.array(keep, pa.bool_()))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of each whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(lambda it: _predicted(it, shared.value), "doc_id long, lang_pred string, score double")


def predict_languages(docs: DataFrame) -> DataFrame:
    out = identify(docs, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: Documents whose best score is lower are rejected by the filter.
LEAST_SCORE = 0.3


def in_known_language(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents with a language, row by row: not ``und``, with a score of ``least`` or more; all their columns.

    A text that shares nothing with the landmarks scores near 0.5, so the score alone rejects few: the share of
    its n-grams that landmarks hold must also come near that of the sample's rows (KNOWN_SLACK).
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    return docs.mapInArrow(lambda it: _kept(it, shared.value, least), docs.schema)
