"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

1. Windows as long as an item are laid in the documents that hold enough of the item's shingles (by weight, wherever they
   stand; no window can hold more). A shared shingle says where the item would begin. A best window begins at one of
   these places or between two neighbouring ones, since up to the next place it loses nothing by moving, so windows are laid
   at them, and at all places between neighbours that one window can span. That drops no pair that step 4 could accept.
2. Each window, and each item, gets a fingerprint of BLOCKS blocks of 16 bits: in each block, the weighted shingles
   vote for the bits (SimHash). The weights of a block are drawn anew and heavily skewed, so that the bits of a block
   change together: two texts at the threshold differ in many bits of a few blocks, not in a few bits of every block.
3. The Hamming distance of two fingerprints is the number of blocks that differ. Two that are within ``radius``, of
   BLOCKS - 1 at most, agree in BLOCKS - radius blocks, so that an index of each block finds all of them; its keys have
   16 bits and the length. Texts that have nothing in common meet with a chance of BLOCKS / 65536.
4. The pairs are verified exactly: the share of the item's shingle weight (letters in the shingle) that the
   window holds must reach the threshold.

Words are lower-case runs of letters and digits. Defined cases: null or wordless texts and items match nothing;
an item of one to four words is one shingle, and is found wherever its words stand one after another; a text of one to
four words is one shingle; very long texts are searched whole; equal items each get their rows; of several places the
most similar and then the first is reported; repeated rows of a doc_id count as one document; ``contaminated`` leaves
out rows without a doc_id, ``clean`` judges them like others; an empty table on either side gives an empty result;
columns other than doc_id, text, item_id are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedscope.llm.common import keyed, let, materialise, may_hold, terms

SHINGLE, SIMILARITY = 5, 0.8
#: Blocks of a fingerprint, the bits of each, and how skewed the weights of a block are.
BLOCKS, BITS, SKEW = 16, 16, 4.0
#: In so many blocks two fingerprints may differ. Pairs at the threshold share a block's heaviest shingle, and so the
#: block, with a chance of 0.6; in all of 16 blocks they differ with one of 4e-7.
RADIUS = BLOCKS - 1
#: The benchmark's shingles are broadcast up to so many rows (16 bytes each), else joined by a shuffle behind a bitmap.
BROADCAST_ROWS = 1_000_000


def _shingles(ws: Column, size: int = SHINGLE) -> Column:
    """Hashes of the runs of ``size`` words; of fewer words one hash of them all."""
    at = F.sequence(F.lit(0), F.greatest(F.size(ws) - size, F.lit(0)))
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(size)]))
    return F.when(F.size(ws) > 0, hashes).otherwise(F.array().cast("array<bigint>"))


def _runs(text: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` words of a longer text; one of so many words is a shingle already."""
    return let(terms(text), lambda ws: F.when(F.size(ws) > size, _shingles(ws, size)).otherwise(F.array().cast("array<bigint>")))


def _weighted(ws: Column) -> Column:
    """Distinct shingles in order of hash, with their weight: the letters in them."""
    at = F.sequence(F.lit(0), F.greatest(F.size(ws) - SHINGLE, F.lit(0)))
    one = F.transform(at, lambda i: F.struct(F.xxhash64(*[F.get(ws, i + k) for k in range(SHINGLE)]).alias("h"), F.length(F.array_join(F.slice(ws, i + 1, SHINGLE), "")).alias("w")))
    return F.sort_array(F.array_distinct(one))


def fingerprints(sets: DataFrame, key: Sequence[str], weighted: str) -> DataFrame:
    """key, block and bits: BLOCKS rows for each distinct key, from its array of (h, w)."""
    each = sets.select(*key, F.explode(weighted).alias("s")).select(*key, "s.*", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    each = each.withColumn("r", F.xxhash64("h", "block"))
    u = (F.shiftrightunsigned("r", BITS) + 1) / F.lit(float(1 << (64 - BITS)))
    each = each.select(*key, "block", "r", (F.col("w") * F.pow(u, F.lit(-SKEW))).alias("v"))
    votes = [F.sum(F.when(F.col("r").bitwiseAND(1 << b) != 0, F.col("v")).otherwise(-F.col("v"))).alias(f"b{b}") for b in range(BITS)]
    bits = F.lit(0)
    for b in range(BITS):
        bits = bits.bitwiseOR(F.when(F.col(f"b{b}") > 0, 1 << b).otherwise(0))
    return each.groupBy(*key, "block").agg(*votes).select(*key, "block", bits.alias("bits"))


def within_radius(left: DataFrame, right: DataFrame, radius: int = RADIUS, small: bool = True) -> DataFrame:
    """All (window, n, item_id, hamming) of equal length whose fingerprints differ in ``radius`` blocks at most.

    left has window, n, block, bits, right item_id, n, block, bits.
    """
    if not 0 <= radius < BLOCKS:
        raise ValueError(f"the radius must be below {BLOCKS}, the number of blocks")
    met = left.join(F.broadcast(right) if small else right, ["n", "block", "bits"])
    return met.groupBy("window", "n", "item_id").agg((F.lit(BLOCKS) - F.count(F.lit(1))).cast("int").alias("hamming")).where(F.col("hamming") <= radius)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start, n_words, hamming, similarity): items that stand in documents, at their best place."""
    items = benchmark.select("item_id", terms(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    items = items.select("item_id", F.size("ws").alias("n"), _shingles(F.col("ws")).alias("sh"), _weighted(F.col("ws")).alias("wsh"))
    items = materialise(items, "items")
    weight = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["w"])
    seeds = items.select("item_id", "n", weight(F.col("wsh")).alias("whole"), F.map_from_entries(F.transform("wsh", lambda x: F.struct(x["h"], x["w"]))).alias("w"), F.posexplode("sh").alias("off", "shingle"))
    seeds = seeds.select("item_id", "n", "whole", "off", "shingle", F.try_element_at("w", F.col("shingle")).cast("long").alias("w"))
    counted = items.agg(F.coalesce(F.sum("n"), F.lit(0)), *[F.max((F.col("n") == k).cast("int")) for k in range(1, SHINGLE)]).first()
    small, short = counted[0] <= BROADCAST_ROWS, [k for k in range(1, SHINGLE) if counted[k]]
    hint = F.broadcast if small else lambda x: x

    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    placed = texts.select("doc_id", F.posexplode(let(terms(F.col("text")), lambda ws: _shingles(ws))).alias("pos", "shingle"))
    for k in short:  # items of fewer words than a shingle are met by runs of their own length
        placed = placed.union(texts.select("doc_id", F.posexplode(_runs(F.col("text"), k)).alias("pos", "shingle")))
    if not small:  # most of the corpus's shingles end at a bitmap, and what is left is joined by a shuffle
        slots = 1 << min(21, max(16, (counted[0] // 8).bit_length()))
        placed = may_hold(placed, seeds, "shingle", slots)
    met = placed.join(hint(seeds), "shingle")
    by_shingle = met.groupBy("doc_id", "item_id", "n", "whole", "shingle").agg(F.first("w").alias("w"), F.collect_set(F.col("pos") - F.col("off")).alias("at"))
    pairs = by_shingle.groupBy("doc_id", "item_id", "n", "whole").agg(F.sum("w").alias("shared"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"))
    pairs = pairs.where(F.col("shared") >= similarity * F.col("whole") - 1e-9)
    after = lambda i: F.get("at", i + 1)
    filled = F.transform("at", lambda a, i: F.when((after(i) - a > 1) & (after(i) - a <= 2 * F.col("n")), F.sequence(a, after(i) - 1)).otherwise(F.array(a)))
    starts = materialise(pairs.select("doc_id", "n", F.explode(F.flatten(filled)).alias("start")).select("doc_id", F.greatest("start", F.lit(0)).alias("start"), "n").distinct(), "starts")

    # texts of the few documents with a seed: a bounded bitmap first, so that the exact join shuffles few texts
    seeded = may_hold(texts, starts, "doc_id")
    by_doc = starts.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n")).alias("at"))
    laid = seeded.join(by_doc, "doc_id").select("doc_id", let(terms(F.col("text")), lambda ws: F.transform("at", lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"), F.slice(ws, x["start"] + 1, x["n"]).alias("ws")))).alias("at"))
    windows = laid.select("doc_id", F.inline("at")).where(F.size("ws") > 0)
    windows = windows.select("doc_id", "start", "n", F.md5(F.array_join("ws", " ")).alias("window"), _weighted(F.col("ws")).alias("have"))
    windows = materialise(windows, "windows")

    # equal windows are fingerprinted, searched and compared once
    contents = windows.groupBy("window", "n").agg(F.min("have").alias("have"))
    near = within_radius(fingerprints(contents, ["window", "n"], "have"), fingerprints(items, ["item_id", "n"], "wsh"), radius, small)
    pairs = near.join(contents, ["window", "n"]).join(hint(items.select("item_id", "wsh")), "item_id")
    pairs = pairs.withColumn("similarity", weight(F.array_intersect("wsh", "have")) / weight(F.col("wsh")))
    pairs = pairs.where(F.col("similarity") >= similarity).select("window", "n", "item_id", "hamming", "similarity")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), (-F.col("hamming")).alias("h"), "n")).alias("b")
    found = windows.select("doc_id", "start", "n", "window").join(pairs, ["window", "n"]).groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", (-F.col("b.s")).alias("start"), F.col("b.n").alias("n_words"), (-F.col("b.h")).alias("hamming"), F.col("b.similarity").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows that hold no benchmark item, each judged by its own text, whatever its doc_id."""
    rows, key = keyed(docs)
    hit = contaminated(rows.select(F.col(key).alias("doc_id"), "text"), benchmark, **how).select(F.col("doc_id").alias(key)).distinct()
    hit = materialise(hit, "hit")  # its size is known: where it is small, no text is shuffled
    return rows.join(hit, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
