"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words; a document's expected copies are its source's target over its
source's size. Within a source, expected copies are summed along the rows, one offset is added, and a copy is
emitted for every integer boundary crossed. Rows run by size, so that the words taken stay near the target. The
offset is drawn from a source's name and a seed, so that reruns agree and other seeds draw other mixes.

Rows of a source run by size class, then by a hash of doc_id and text. The running sum needs no task that holds a whole source
or a hot id: rows are dealt to tasks by ranges of that order, counted inside a task, and go on from the counts of the
tasks before, so that the mix depends on the rows alone, not on how many there are.

Defined cases: a null text counts 0 words; null sources form one source, the last; a source without words has
target 0 and is not taken; repeated rows are rows of their own (equal rows take any order, which changes
no total); targets are found in one task, from a row for each source, so sources may be many thousands, not billions; rows without a doc_id count and are taken like others; an empty or a very long text is one of
its size; an empty table gives an empty result; columns other than doc_id, text and source are carried by ``mix``
and never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedscope.llm.common import WORD, free_name, keyed, materialise

#: Sources by code point weigh so, repeating; the mix takes so much of all sizes; a source at most so often.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2


def source_key(source: Column) -> Column:
    """Sorts by code point with null last, and is never null."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), source))


def fraction(value: Column) -> Column:
    """A number from 0 up to 1 that depends on the value alone."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(skey, source_size, target) from rows of (skey, size): shares by weight, stopped at ``most`` times a size.

    Filling sources in rising order of cap over weight, a source is capped while its cap is within its share
    of what is left; from the first that isn't, all get the same words a weight.
    """
    by = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy("skey")
    weighed = by.withColumn("k", (F.row_number().over(every) - 1) % len(weights)).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") + 1).cast("int")))
    capped = weighed.withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("ratio", "skey")
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("double") * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    found = capped.withColumn("level", level).withColumn("full", F.col("ratio") <= F.col("level"))
    line = F.min(F.when(~F.col("full"), F.struct("ratio", "skey", "level"))).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["level"]
    return found.select("skey", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * line).alias("target"))


def allot(docs: DataFrame, seed: str = "", key: str | None = None, **weighing) -> DataFrame:
    """One row for each row: doc_id, size, source_size, target and ``copies``; with ``key``, that column as ``row``."""
    n = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    carry = ["row"] if key else []
    named = [F.col(key).alias("row")] if key else []
    mark = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))))
    sizes = docs.select(*named, "doc_id", source_key(F.col("source")).alias("skey"), n.alias("size"), F.conv(F.substring(mark, 1, 15), 16, 10).cast("long").alias("h"), F.monotonically_increasing_id().alias("tie"))
    sizes = sizes.withColumn("e", F.length(F.bin("size"))).withColumn("class", F.col("e") * 8 + F.expr("cast(shiftright(size * 8, e - 1) & 7 as int)"))
    order = ["class", "h", "size", "doc_id", *carry, "tie"]
    # written with the number of the task that a row's range has come to, and read again from there
    rows = materialise(sizes.repartitionByRange("skey", *order).withColumn("part", F.spark_partition_id()), "sizes")
    counts = rows.groupBy("skey", "part").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0))).drop("n")
    goal = targets(rows, **weighing)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("skey", "part").orderBy(*order)))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = ranked.join(before.join(goal, "skey"), ["skey", "part"])
    out = out.withColumn("x", expected).withColumn("at", F.col("before") + F.col("rank")).withColumn("u", fraction(F.concat("skey", F.lit(seed))))
    copies = F.floor(F.col("at") * F.col("x") + F.col("u")) - F.floor((F.col("at") - 1) * F.col("x") + F.col("u"))
    return out.select(*carry, "doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix_digest(docs: DataFrame) -> DataFrame:
    return allot(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows as the mix takes them: each as often as it is copied itself, with its own columns."""
    rows, key = keyed(docs)
    n, copy = free_name(rows, "__n"), free_name(rows, "__copy")
    copies = allot(rows, key=key, **how).where("copies > 0").select(F.col("row").alias(key), F.col("copies").alias(n))
    copies = materialise(copies, "copies")  # so that the shuffles it took are gone before texts are shuffled
    taken = rows.join(copies.hint("merge"), key)  # a row for nearly each one of the table: never broadcast, at any size
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH s AS (SELECT doc_id, text, CASE WHEN source IS NULL THEN 'n' ELSE concat('a', source) END AS skey,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
b AS (SELECT skey, sum(size)::BIGINT AS source_size FROM s GROUP BY skey),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::INT]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS cap FROM b),
r AS (SELECT *, cap / weight AS ratio FROM w),
v AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5 - coalesce(sum(cap) OVER (ORDER BY ratio, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY ratio, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
line AS (SELECT arg_min(level, (ratio, skey)) AS line FROM v WHERE ratio > level),
t AS (SELECT skey, source_size, CASE WHEN ratio <= level THEN cap ELSE weight * line END AS target FROM v, line),
c AS (SELECT s.*, length(bin(size)) * 8 + (((size * 8) >> (length(bin(size)) - 1)) & 7) AS class,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM s),
p AS (SELECT c.*, row_number() OVER (PARTITION BY skey ORDER BY class, h, size, doc_id) AS pos FROM c),
x AS (SELECT p.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS x,
    ('0x' || substr(md5(p.skey), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u FROM p JOIN t USING (skey))
SELECT doc_id, size, source_size, target, (size * (floor(pos * x + u) - floor((pos - 1) * x + u))::BIGINT)::BIGINT AS taken FROM x
"""
