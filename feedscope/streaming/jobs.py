"""Streaming jobs; each has the batch job of the same semantics as its test."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from feedscope.operators.aggs import topic_signal


def novel(stream: DataFrame, key: str = "id", late: str = "30 days") -> DataFrame:
    """Each key once, as long as it recurs within the watermark."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, every: str = "1 day", length: str = "7 days", late: str = "1 day") -> DataFrame:
    """Events by kind in sliding windows."""
    return stream.withWatermark("at", late).groupBy(F.window("at", length, every).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def counted_batches(stream: DataFrame, path: str, checkpoint: str, every: str = "1 day", length: str = "7 days") -> DataFrame:
    """Events by kind in sliding windows, however late they come: (start, kind, n) of all that was worked off so far.

    There is no watermark that drops a late event, and no state. Each batch writes its own counts by window and kind to a
    folder of its number, so that a batch that runs twice replaces its own; readers sum over batches.
    """

    def write(batch: DataFrame, k: int) -> None:
        counts = batch.groupBy(F.window("at", length, every)["start"].alias("start"), "kind").agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={k}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return corrected_counts(stream.sparkSession, path)


def corrected_counts(spark, path: str) -> DataFrame:
    """What ``counted_batches`` has written below ``path``, summed over batches."""
    return spark.read.schema("start timestamp, kind string, n long, batch long").parquet(path).groupBy("start", "kind").agg(F.sum("n").alias("n"))


def feedback_windows(stream: DataFrame, items: DataFrame, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, source, topic, observations, net) of reactions by day: a stream of (item, topic, kind, at) with the items' source.

    Reactions to items that aren't known count under the source "missing".
    """
    known = stream.withWatermark("at", late).join(items.select("item", "source"), "item", "left").withColumn("source", F.coalesce("source", F.lit("missing")))
    return topic_signal(known.withColumn("start", F.window("at", every)["start"]), ["start", "source", "topic"])


def queue_expiry(stream: DataFrame, days: int = 7, late: str = "1 day") -> DataFrame:
    """(key, queued_at, score, puts) of each queue entry when it has waited ``days``; key, at, score come in.

    A put of a waiting key refreshes its score and keeps its place; one after the expiry starts a new entry. State is a
    row for each waiting key, dropped by the watermark's timer. Times count in whole milliseconds, the nearest; puts of the
    same one stay in their order.
    """
    ttl = days * 86_400_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, entry = [], state.getOption

        def gone(e: tuple) -> tuple:
            return (key[0], pd.Timestamp(e[0], unit="ms"), e[1], e[2])

        if state.hasTimedOut:
            out.append(gone(entry))
            state.remove()
        else:
            rows = pd.concat(batches).sort_values(["exact", "score"], kind="stable")
            for at, score in zip(rows["at"].astype("datetime64[ns]").astype("int64") // 1_000_000, rows["score"], strict=True):
                if entry is not None and at > entry[0] + ttl:
                    out.append(gone(entry))
                    entry = None
                entry = (int(at), float(score), 1) if entry is None else (min(entry[0], int(at)), float(score), entry[2] + 1)
            if entry[0] + ttl <= state.getCurrentWatermarkMs():
                out.append(gone(entry))
                state.remove()
            else:
                state.update(entry)
                state.setTimeoutTimestamp(entry[0] + ttl - 1)  # timers go off behind their time, entries at it
        if out:
            yield pd.DataFrame(out, columns=["key", "queued_at", "score", "puts"])

    shape = "key long, queued_at timestamp, score double, puts long"
    exact = F.unix_micros("at")
    puts = stream.select("key", F.timestamp_micros(F.round(exact, -3)).alias("at"), exact.alias("exact"), "score")
    return puts.withWatermark("at", late).groupBy("key").applyInPandasWithState(step, shape, "queued long, score double, puts long", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Work off what is there and give the result as a table, written as Parquet; a complete result replaces the one before."""
    spark = df.sparkSession
    if mode == "append":
        out = f"{checkpoint}/{name}-out"
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{checkpoint}/{name}-state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(out)
    out = f"{checkpoint}/{name}-{uuid.uuid4().hex}"

    def replace(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    df.writeStream.foreachBatch(replace).outputMode(mode).option("checkpointLocation", f"{checkpoint}/{name}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)
