"""An archive in a folder for each month: batches are merged into the months they touch, others aren't read or written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedscope.operators.ranks import states
from feedscope.operators.shared import written

#: An item's statuses and what may happen to it. A promoted item that is retracted is dismissed.
STATUSES = {("radar", "promoted"): "promoted", ("radar", "dismissed"): "dismissed", ("promoted", "dismissed"): "dismissed"}


def month_of(at: str) -> Column:
    return F.date_format(at, "yyyy-MM")


def read_months(spark: SparkSession, path: str, months: Sequence[str], schema: str) -> DataFrame:
    """The archive's rows of some months, with ``month``; no rows where there is none yet."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], f"{schema}, month string")
    return spark.read.schema(f"{schema}, month string").parquet(path).where(F.col("month").isin(*months))


def merge_months(batch: DataFrame, path: str, refreshed: Sequence[str], key: str = "id", at: str = "seen_at", changes: bool = False) -> DataFrame:
    """Merge a batch into the archive at ``path`` and return the touched months with ``change``: inserted, refreshed or kept.

    A key that its month has gets the incoming values of the ``refreshed`` columns and keeps the others; a new one is
    inserted. Of a key's rows in a batch the first (by ``at``) is inserted and the last refreshes it. Months are folders,
    of which only the touched ones are read and replaced. Rows without a date or key are left out. ``changes`` writes
    nothing. The batch's months are the only thing gathered.
    """
    spark = batch.sparkSession
    names = batch.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields)
    rows = batch.where(F.col(at).isNotNull() & F.col(key).isNotNull()).withColumn("month", month_of(at))
    others = [c for c in names if c != key]
    fresh = [c for c in others if c in refreshed]
    order = F.struct(F.col(at), *[F.col(c) for c in others if c != at])
    one = rows.groupBy("month", key).agg(F.min(F.struct(F.col(at).alias("__at"), F.struct(*others).alias("r"))).alias("first"), F.max_by(F.struct(*fresh), order).alias("last"))
    first = {c: F.col("last")[c] if c in fresh else F.col("first")["r"][c] for c in others}
    incoming = written(one.select("month", F.col(key), *[first[c].alias(c) for c in others]))
    months = [r[0] for r in incoming.select("month").distinct().collect()]
    a, b = read_months(spark, path, months, schema).alias("a"), incoming.alias("b")
    joined = a.join(b, (F.col("a.month") == F.col("b.month")) & (F.col(f"a.{key}") == F.col(f"b.{key}")), "full_outer")
    new, gone = F.col(f"a.{key}").isNull(), F.col(f"b.{key}").isNull()
    value = lambda c: F.when(gone, F.col(f"a.{c}")).when(new | F.lit(c in fresh), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    merged = written(joined.select(*map(value, names), value("month"), F.when(new, "inserted").when(gone, "kept").otherwise("refreshed").alias("change")))
    if not changes and months:
        out = merged.drop("change").repartition("month", F.pmod(F.xxhash64(key), F.lit(8)))  # a month over eight tasks
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    return merged


def statuses(events: DataFrame, key: str = "id", order: Sequence[str] = ("at", "seq"), status: str = "status") -> DataFrame:
    """Status events with the item's status before and after, and whether they were legal; items start on the radar."""
    return states(events, key, order, status, STATUSES, "radar")


def current_statuses(events: DataFrame, key: str = "id", order: Sequence[str] = ("at", "seq"), status: str = "status") -> DataFrame:
    """(key, status, n, illegal): where each item's events have led, and how many of them were and weren't legal."""
    told = statuses(events, key, order, status)
    last = F.max_by("after", F.struct(*order))
    return told.groupBy(key).agg(last.alias("status"), F.count(F.lit(1)).alias("n"), F.count_if(~F.col("legal")).alias("illegal"))


def expiries(pruned: DataFrame, key: str = "key") -> DataFrame:
    """A rejection of class budget for each queue row (channel, key, state) that waited too long or was tried too often."""
    reason = F.when(F.col("state") == "expired", "queue_expired").otherwise("publish_attempts_exhausted")
    return pruned.where(F.col("state").isin("expired", "exhausted")).select("channel", F.col(key).alias("item"), reason.alias("reason"), F.lit("budget").alias("class"))
