"""Aggregations over items, feedback, ratings and spend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a reaction weighs and whether it speaks about the topic or the item alone.
FEEDBACK = {"interesting": (1, "item"), "not_useful": (-1, "item"), "not_my_topic": (-3, "topic"), "deep_dive": (3, "topic"), "retract": (-3, "item")}


def _weights(kind: Column, scope: str | None = None) -> Column:
    w = F.lit(0)
    for name, (v, s) in FEEDBACK.items():
        if scope in (None, s):
            w = F.when(kind == name, v).otherwise(w)
    return w


def gate_statistics(scores: DataFrame, gate: float) -> DataFrame:
    p = F.percentile("quality", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(0.9)))
    s = scores.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") >= gate).alias("passed"), F.min("quality").alias("least"), F.max("quality").alias("most"), p.alias("p"))
    return s.select("n", "passed", "least", *[F.col("p")[k].alias(a) for k, a in enumerate(("p25", "median", "p75", "p90"))], "most")


def topic_signal(feedback: DataFrame, keys: Sequence[str] = ("topic",)) -> DataFrame:
    """Per topic: observations count every reaction, net sums the weights of those about the topic."""
    return feedback.groupBy(*keys).agg(F.count(F.lit(1)).alias("observations"), F.sum(_weights(F.col("kind"), "topic")).alias("net"))


def item_signal(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("item").agg(F.sum(_weights(F.col("kind"))).alias("signal"), F.count(F.lit(1)).alias("n"))


def proposals(signal: DataFrame, n_strong: int, least: int = 10, up: int = 8, down: int = -8, floor: int = 5) -> DataFrame:
    """withhold, promote, demote or hold each topic; demotions in topic order stop where few strong topics remain."""
    wants = (F.col("observations") >= least) & (F.col("net") <= down)
    before = F.sum(wants.cast("int")).over(Window.orderBy("topic"))  # a row for each topic of a closed vocabulary
    d = F.when(F.col("observations") < least, "withheld").when(F.col("net") >= up, "promote").when(wants & (before <= n_strong - floor), "demote").when(wants, "floor").otherwise("dead_band")
    return signal.withColumn("decision", d)


def rolling(log: DataFrame, as_of: Column, caps: dict[str, int], total: int, a_day: int) -> DataFrame:
    """Use of each section in seven days, of all in seven days and one, and what remains."""
    week = F.col("at") >= as_of - F.expr("INTERVAL 7 DAYS")
    by = log.groupBy("section").agg(F.count_if(week).alias("used"))
    every = log.agg(F.count_if(week).alias("used_all"), F.count_if(F.col("at") >= as_of - F.expr("INTERVAL 1 DAY")).alias("used_day"))
    cap = F.lit(0)
    for name, n in caps.items():
        cap = F.when(F.col("section") == name, n).otherwise(cap)
    left = F.greatest(F.lit(0), F.least(cap - F.col("used"), F.lit(total) - F.col("used_all"), F.lit(a_day) - F.col("used_day")))
    return by.withColumn("one", F.lit(1)).join(F.broadcast(every.withColumn("one", F.lit(1))), "one").select("section", "used", "used_all", "used_day", left.cast("long").alias("remaining"))


def rating_report(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy(F.coalesce("bucket", F.lit("unmatched")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("total"), (F.sum("rating") / F.count(F.lit(1))).alias("average"))


def cooccurrence(posts: DataFrame) -> DataFrame:
    """How many posts carry both topics of a pair; pairs are made inside a row, of at most a few topics."""
    pairs = F.flatten(F.transform("topics", lambda a: F.transform(F.filter("topics", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return posts.select(F.inline(pairs)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def topic_counts(posts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Posts of each topic of the vocabulary, and the newest."""
    by = posts.select("id", "published", F.explode("topics").alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.max_by("id", F.struct("published", "id")).alias("newest"))
    return vocabulary.join(by, "topic", "left").select("topic", F.coalesce("n", F.lit(0)).alias("n"), "newest")


def source_health(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """source, status, n, newest, dated, regression: every source of the registry with what it landed.

    registry has source, kind (feed, page, probe or another), verified, entries source, published. OK: entries came; FAIL:
    none did; PROBE: nothing reads such a source yet; SKIP: its kind is unknown. A regression was verified and fails now.
    """
    by = entries.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("published").alias("newest"), F.count("published").alias("dated"))
    x = registry.join(by, "source", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("dated", F.coalesce("dated", F.lit(0)))
    status = F.when(F.col("kind") == "probe", "PROBE").when(~F.col("kind").isin("feed", "page"), "SKIP").when(F.col("n") > 0, "OK").otherwise("FAIL")
    x = x.withColumn("status", status)
    return x.select("source", "status", "n", "newest", "dated", (F.col("verified") & (F.col("status") == "FAIL")).alias("regression"))


def trigger_score(fired: DataFrame, threshold: int) -> DataFrame:
    """One row: the sum of the fired events' weights, their number, and whether they are worth a roundup."""
    total = F.coalesce(F.sum("weight"), F.lit(0)).cast("long")
    return fired.agg(F.count(F.lit(1)).alias("n"), total.alias("total"), (total >= threshold).alias("enough"))


def attributions(readings: DataFrame) -> DataFrame:
    """The distinct credits of readings: their attribution, or their publisher."""
    return readings.select(F.coalesce(F.nullif("attribution", F.lit("")), "publisher").alias("credit")).where("credit IS NOT NULL").distinct()


def digest_header(picks: DataFrame, buckets: Sequence[str]) -> DataFrame:
    """bucket, n: the picks of each bucket, 0 where there are none, and of all as "total"; picks has bucket."""
    by = picks.groupBy(F.coalesce("bucket", F.lit("unmatched")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    names = picks.sparkSession.createDataFrame([(b,) for b in (*buckets, "unmatched")], "bucket string")
    listed = names.join(by, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
    return listed.union(listed.agg(F.lit("total"), F.sum("n")))


def recent(log: DataFrame, as_of: Column, days: int, at: str = "at") -> DataFrame:
    """The log's rows of the last days; rows without a readable time are dropped."""
    return log.where(F.col(at).cast("timestamp") >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def rating_extremes(ratings: DataFrame, k: int = 10) -> DataFrame:
    """part, id, rating, bucket: the k best unmatched ones rated 4 or more, and the k worst matched ones rated 2 or less."""
    best = ratings.where("bucket IS NULL AND rating >= 4").orderBy(F.desc("rating"), "id").limit(k).select(F.lit("unmatched_best").alias("part"), "id", "rating", "bucket")
    worst = ratings.where("bucket IS NOT NULL AND rating <= 2").orderBy("rating", "id").limit(k).select(F.lit("matched_worst").alias("part"), "id", "rating", "bucket")
    return best.union(worst)
