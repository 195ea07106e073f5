"""Ranks, running counts and states inside keys of any size, and slugs of their own by them.

A window over a key puts the key's rows into one task. Here rows are dealt to tasks by ranges of (key, order), so that a key
with a third of all rows takes a third of the tasks; what a task counts goes on from the counts of the tasks before it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from feedscope.operators.shared import written


def counted_before(df: DataFrame, key: str, order: Sequence[str], flag: str, name: str = "before") -> DataFrame:
    """The rows with ``name``: how many rows of the key with a ``flag`` of 1 stand before them by ``order``.

    Rows that ``order`` doesn't tell apart stand in one order or another, the same for whoever reads the result. The
    ranges are drawn by a hash of the key and by ``order``, so no long key is sampled.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("__h", F.xxhash64(key)).repartitionByRange(tasks, "__h", *order).sortWithinPartitions("__h", key, *order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            out = []
            for k, f in zip(b.column(key).to_pylist(), b.column(flag).to_pylist(), strict=True):
                if k != at:
                    at, n = k, 0
                out.append(n)
                n += f
            yield pa.record_batch([*b.columns, pa.array([part] * len(out), pa.int32()), pa.array(out, pa.int64())], names=[*b.schema.names, "__part", "__local"])

    schema = StructType([*dealt.schema.fields, StructField("__part", IntegerType()), StructField("__local", LongType())])
    rows = written(dealt.mapInArrow(count, schema))
    totals = rows.groupBy(key, "__part").agg(F.sum(flag).alias("n"))
    by = Window.partitionBy(key)
    earlier = F.sum("n").over(by.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    # only a task's first and last keys can go on in another task: two rows a task at most
    offsets = totals.withColumn("__parts", F.count(F.lit(1)).over(by)).where("__parts > 1").select(F.col(key).alias("__k"), F.col("__part").alias("__p"), F.coalesce(earlier, F.lit(0)).alias("__offset"))
    joined = rows.join(F.broadcast(offsets), F.col(key).eqNullSafe(F.col("__k")) & (F.col("__part") == F.col("__p")), "left")
    return joined.withColumn(name, F.col("__local") + F.coalesce("__offset", F.lit(0))).drop("__h", "__part", "__local", "__k", "__p", "__offset")


def states(events: DataFrame, key: str, order: Sequence[str], symbol: str, table: Mapping[tuple[str, str], str], start: str) -> DataFrame:
    """The events with ``before`` and ``after``, the key's state around each of them, and ``legal``, whether it may happen then.

    ``table`` gives the state that a state and a symbol lead to; where it has no entry the event is illegal and changes
    nothing. A null symbol is illegal. What a run of events does is a function from states to states, and functions
    compose, so a task folds its events from every state they may find, and what a key's earlier tasks did is
    applied afterwards: no key is bound to a task.
    """
    names = list(dict.fromkeys([start, *(s for s, _ in table), *table.values()]))
    place = {s: k for k, s in enumerate(names)}
    steps = {c: [place.get(table.get((s, c)), k) for k, s in enumerate(names)] for c in {c for _, c in table}}
    stay = list(range(len(names)))
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = events.withColumn("__h", F.xxhash64(key)).repartitionByRange(tasks, "__h", *order).sortWithinPartitions("__h", key, *order)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, now, row = TaskContext.get().partitionId(), None, stay, 0
        for b in batches:
            before, after, rows = [], [], []
            for k, c in zip(b.column(key).to_pylist(), b.column(symbol).to_pylist(), strict=True):
                if k != at or row == 0:
                    at, now = k, stay
                before.append(now)
                step = steps.get(c, stay)
                now = [step[s] for s in now]
                after.append(now)
                rows.append(row)
                row += 1
            yield pa.record_batch([*b.columns, pa.array([part] * len(rows), pa.int32()), pa.array(rows, pa.int64()), pa.array(before, pa.list_(pa.int32())), pa.array(after, pa.list_(pa.int32()))], names=[*b.schema.names, "__part", "__at", "__before", "__after"])

    whole = ArrayType(IntegerType())
    schema = StructType([*dealt.schema.fields, StructField("__part", IntegerType()), StructField("__at", LongType()), StructField("__before", whole), StructField("__after", whole)])
    rows = written(dealt.mapInArrow(fold, schema))
    runs = rows.groupBy(key, "__part").agg(F.max_by("__after", "__at").alias("f"))
    by = Window.partitionBy(key)
    earlier = F.transform(F.array_sort(F.collect_list(F.struct("__part", "f")).over(by.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))), lambda x: x["f"])  # a row a task at most
    found = F.aggregate(earlier, F.lit(place[start]), lambda s, f: F.get(f, s))
    starts = runs.withColumn("__parts", F.count(F.lit(1)).over(by)).withColumn("__start", found).where("__parts > 1").select(F.col(key).alias("__k"), F.col("__part").alias("__p"), "__start")
    out = rows.join(F.broadcast(starts), F.col(key).eqNullSafe(F.col("__k")) & (F.col("__part") == F.col("__p")), "left").withColumn("__s", F.coalesce("__start", F.lit(place[start])))
    called = F.array(*map(F.lit, names))
    name = lambda c: F.get(called, F.get(c, F.col("__s")))
    pairs = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(c).alias("c")) for s, c in table])
    out = out.withColumn("before", name("__before")).withColumn("after", name("__after"))
    legal = F.coalesce(F.exists(pairs, lambda p: (p["s"] == F.col("before")) & (p["c"] == F.col(symbol))), F.lit(False))
    return out.select(*events.columns, "before", "after", legal.alias("legal"))


def _claimed(kids: DataFrame) -> DataFrame:
    """kids (parent, child, k, arrived, bare: whether the parent's first row has the bare name) with ``got``, whether the child's
    first row gets its bare name, and ``at``, from which of the parent's numbered rows on that name is skipped.

    A number k is gone if the parent has reached it before the child comes. How far the parent has come depends on how many
    numbers below k were taken by other children, so the children of a parent are worked in order of k, as a stream.
    """
    rows = kids.select("parent", "child", "k", "arrived", "bare").repartition("parent").sortWithinPartitions("parent", "k")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, taken = None, 0
        for b in batches:
            got, skip = [], []
            for parent, k, arrived, bare in zip(*(b.column(c).to_pylist() for c in ("parent", "k", "arrived", "bare")), strict=True):
                if parent != at:
                    at, taken = parent, 0
                free = max(0, arrived - bare) + taken < k - 1
                taken += free
                got.append(free)
                skip.append(k - taken)
            yield pa.record_batch([b.column("parent"), b.column("child"), pa.array(got, pa.bool_()), pa.array(skip, pa.int64())], names=["parent", "child", "got", "at"])

    return rows.mapInArrow(fold, "parent string, child string, got boolean, at long")


def _claims(kids: DataFrame) -> DataFrame:
    """``_claimed`` for kids of kids as well, one generation after another: a parent's bare name is settled before its kids'."""
    known = None
    rest = kids.withColumn("bare", F.lit(True)).join(kids.select(F.col("child").alias("parent")), "parent", "left_anti")
    while True:
        now = written(_claimed(rest))
        if now.isEmpty():
            return now if known is None else known
        known = now if known is None else known.unionByName(now)
        rest = kids.join(now.select(F.col("child").alias("parent"), F.col("got").alias("bare")), "parent")


def unique_slugs(df: DataFrame, base: str, order: str) -> DataFrame:
    """The rows with a slug of their own: the base, or the first of base-2, base-3 ... that no earlier row has.

    Rows come by ``order`` and base. A name base-k can only be given to a row of that base, or be the base of another row, its
    kid. So a row's number is its rank among the rows of its base, and one more for each number below it that a kid came to
    first. Ranks are counted over ranges of rows, so that no base is bound to a task; only kids, a row for each distinct
    base of that form, are worked parent by parent. A null base has no slug.
    """
    names, named = df.columns, df.where(F.col(base).isNotNull())
    form = r"^(?s)(.+)-([2-9]|[1-9][0-9]+)$"
    bases = named.groupBy(F.col(base).alias("child")).agg(F.min(F.struct(F.col(order).alias("t"))).alias("first"))
    kids = bases.select("child", F.col("first.t").alias("__t"), F.regexp_extract("child", form, 1).alias("parent"), F.regexp_extract("child", form, 2).try_cast("long").alias("k")).where("parent <> '' AND k IS NOT NULL")
    kids = written(kids.join(bases.select(F.col("child").alias("parent")), "parent", "left_semi"))
    rows = named.select(*names, F.col(base).alias("__stream"), F.col(order).alias("__t"), F.col(base).alias("__base"), F.lit(1).alias("__row"))
    come = kids.select(F.col("parent").alias("__stream"), "__t", F.col("child").alias("__base"), F.lit(0).alias("__row"), "k")
    seen = counted_before(rows.unionByName(come, allowMissingColumns=True), "__stream", ["__t", "__base"], "__row")
    claims = _claims(seen.where("__row = 0").select(F.col("__stream").alias("parent"), F.col("__base").alias("child"), "k", F.col("before").alias("arrived")))
    lost = claims.where("NOT got").select(F.col("child").alias("__stream"), F.lit(1).alias("__lost"))
    number = (F.col("before") + F.coalesce("__lost", F.lit(0))).alias("__m")  # 0: the bare name
    rows = seen.where("__row = 1").join(lost, "__stream", "left").select(*names, "__stream", number)
    gaps = claims.where("got").select(F.col("parent").alias("__stream"), F.col("at").alias("__m"), F.lit(1).alias("__gap"))
    with_gaps = gaps.select("__stream").distinct()
    plain = rows.join(with_gaps, "__stream", "left_anti").withColumn("skipped", F.lit(0))
    both = rows.join(with_gaps, "__stream", "left_semi").withColumn("__gap", F.lit(0)).unionByName(gaps, allowMissingColumns=True)
    both = both.withColumn("__after", 1 - F.col("__gap"))
    found = plain if kids.isEmpty() else plain.unionByName(counted_before(both, "__stream", ["__m", "__after"], "__gap", "skipped").where("__gap = 0").select(*plain.columns))
    slug: Column = F.when(F.col("__m") == 0, F.col("__stream")).otherwise(F.concat("__stream", F.lit("-"), (F.col("__m") + 1 + F.col("skipped")).cast("string")))
    return found.select(*names, slug.alias("slug")).unionByName(df.where(F.col(base).isNull()).withColumn("slug", F.lit(None).cast("string")))
