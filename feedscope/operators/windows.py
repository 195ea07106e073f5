"""Windows, top-k and cuts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from feedscope.operators.ranks import unique_slugs  # noqa: F401  (a cut like the others)


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    return top(df, keys, order, 1).drop("rank")


def top(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def quota_top(df: DataFrame, bucket: str, quotas: dict[str, int], score: str, tie: str, cap: int) -> DataFrame:
    """The best ``cap`` rows by score, of which each bucket's best ``quota`` are reserved (in the quotas' order).

    Only rows that can be taken are ranked together: each bucket's best ``cap`` rows.
    """
    best = top(df, [bucket], [F.desc(score), tie], cap)
    quota, order = F.lit(0), F.lit(len(quotas))
    for k, (name, n) in enumerate(quotas.items()):
        quota = F.when(F.col(bucket) == name, n).otherwise(quota)
        order = F.when(F.col(bucket) == name, k).otherwise(order)
    kept = best.withColumn("__out", (F.col("rank") > quota).cast("int")).withColumn("__ord", F.when(F.col("__out") == 0, order).otherwise(0))
    picked = kept.orderBy("__out", "__ord", F.desc(score), tie).limit(cap)
    return picked.drop("rank", "__out", "__ord")


def capped_by(df: DataFrame, key: str, each: int, score: str, tie: str, cap: int, floor: float) -> DataFrame:
    """Rows of ``floor`` or more: the best ``each`` of a key, then the best ``cap``."""
    return top(df.where(F.col(score) >= floor), [key], [F.desc(score), tie], each).drop("rank").orderBy(F.desc(score), tie).limit(cap)


def current(measurements: DataFrame, identity: Sequence[str]) -> DataFrame:
    """The newest reading of each identity."""
    rest = [c for c in measurements.columns if c not in identity]
    newest = measurements.groupBy(*identity).agg(F.max_by(F.struct(*rest), F.struct("measured_at", "id")).alias("m"))
    return newest.select(*identity, "m.*")


def upsert(batch: DataFrame, store: DataFrame, identity: Sequence[str], tolerance: float = 1e-3) -> DataFrame:
    """What a batch does to the store: id, action (new, superseding, unchanged) and what it supersedes.

    The readings of an identity are folded in batch order, carrying the reading that holds: a value within the
    tolerance of it changes nothing, another one is accepted and supersedes it; an id that was accepted before
    changes nothing either. The fold runs over sorted rows: only the reading that holds is kept, and the accepted ids
    of those that an identity's readings repeat.
    """
    held = current(store, identity).select(*identity, F.col("id").cast("string").alias("__held"), F.col("value").cast("double").alias("__held_value"))
    known = store.select(F.col("id").alias("known")).distinct()
    batch = batch.join(known, F.col("id") == F.col("known"), "left").withColumn("__again", F.col("known").isNotNull())
    repeated = batch.groupBy(*identity, "id").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).select(*[F.col(c).alias(f"__{k}") for k, c in enumerate(identity)], F.col("id").alias("__id"))
    same = [F.col(c).eqNullSafe(F.col(f"__{k}")) for k, c in enumerate(identity)]
    rows = batch.join(repeated, [*same, F.col("id") == F.col("__id")], "left").select(*identity, "seq", F.col("id").cast("string").alias("id"), F.col("value").cast("double").alias("value"), "__again", F.col("__id").isNotNull().alias("__repeated"))
    rows = rows.join(held, list(identity), "left").repartition(*identity).sortWithinPartitions(*identity, "seq", "id", "value")
    keys = list(identity)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cur, val, accepted = None, None, None, set()
        for b in batches:
            columns = [b.column(c).to_pylist() for c in (*keys, "id", "value", "__again", "__repeated", "__held", "__held_value")]
            actions, before = [], []
            for *key, i, v, again, more, held, held_value in zip(*columns, strict=True):
                key = ["nan" if x != x else x for x in key]
                if key != at:
                    at, cur, val, accepted = key, held, held_value, set()
                near = cur is not None and v is not None and val is not None and abs(v - val) < tolerance
                if again or near or i in accepted:
                    actions.append("unchanged")
                    before.append(None)
                    continue
                actions.append("new" if cur is None else "superseding")
                before.append(cur)
                cur, val = i, v
                if more:
                    accepted.add(i)
            yield pa.record_batch([*(b.column(c) for c in keys), b.column("id"), pa.array(actions, pa.string()), pa.array(before, pa.string())], names=[*keys, "id", "action", "supersedes"])

    schema = StructType([*(rows.schema[c] for c in keys), *(StructField(c, StringType()) for c in ("id", "action", "supersedes"))])
    return rows.mapInArrow(fold, schema)


def leaderboard(readings: DataFrame, k: int) -> DataFrame:
    """The best k models of each benchmark by their best reading (higher is better)."""
    best = readings.groupBy("benchmark", "model").agg(F.max("value").alias("value"))
    return top(best, ["benchmark"], [F.desc("value"), "model"], k)


def leader_events(readings: DataFrame, benchmarks: DataFrame, weights: tuple[int, int] = (4, 2), k: int = 5) -> DataFrame:
    """(event, benchmark, model, id, value, rank, weight): new readings that lead their benchmark or stand among its best k.

    readings has benchmark, model, id, value, is_new, benchmarks benchmark, higher_is_better; readings of other benchmarks
    don't count. Ties go to the smaller id.
    """
    x = readings.join(benchmarks, "benchmark").withColumn("__by", F.when(F.col("higher_is_better"), -F.col("value")).otherwise(F.col("value")))
    best = top(x, ["benchmark"], ["__by", "id"], k).where("is_new")
    lead = F.col("rank") == 1
    return best.select(F.when(lead, "new_leader").otherwise("new_top_entrant").alias("event"), "benchmark", "model", "id", "value", "rank", F.when(lead, weights[0]).otherwise(weights[1]).alias("weight"))


def positions(members: DataFrame) -> DataFrame:
    """index, total, prev and next of the members of a thread that exist; members has thread, ord, id."""
    w = Window.partitionBy("thread").orderBy("ord", "id")
    return members.select("thread", "id", F.row_number().over(w).cast("long").alias("index"), F.count(F.lit(1)).over(Window.partitionBy("thread")).alias("total"), F.lag("id").over(w).alias("prev"), F.lead("id").over(w).alias("next"))


def members(threads: DataFrame, posts: DataFrame) -> DataFrame:
    """(thread, ord, id) of the posts in the threads' ordered lists; threads has thread, ids. Ids that are no post's are left
    out; of an id that a list names twice the first place counts."""
    each = threads.select("thread", F.posexplode("ids").alias("ord", "id"))
    return each.join(posts.select("id").distinct(), "id", "left_semi").groupBy("thread", "id").agg(F.min("ord").alias("ord")).select("thread", "ord", "id")


def listing(posts: DataFrame, sections: DataFrame, k: int) -> DataFrame:
    """The newest k published posts of each section, in the sections' order of depth, with their place: featured, next two, listed.

    posts has section, id, at, draft, sections section, depth; sections without posts have no row.
    """
    newest = top(posts.where(~F.coalesce("draft", F.lit(False))), ["section"], [F.desc("at"), "id"], k).withColumnRenamed("rank", "pos")
    place = F.when(F.col("pos") == 1, "featured").when(F.col("pos") <= 3, "next").otherwise("listed")
    return newest.join(sections, "section").select("depth", "section", "id", "pos", place.alias("place"))


def queue_state(events: DataFrame, as_of: Column, days: int = 7, k: int = 3) -> DataFrame:
    """The newest score of each key of a channel, expired after ``days``; the best k that are alive."""
    last = events.groupBy("channel", "key").agg(F.max_by("score", F.struct("at", "seq")).alias("score"), F.max("at").alias("at"), F.count(F.lit(1)).alias("puts"))
    alive = last.where(F.col("at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    return top(alive, ["channel"], [F.desc("score"), "key"], k).select("channel", "key", "score", "puts", "rank")


def budgeted(ranked: DataFrame, usage: DataFrame, limits: Sequence[str], attempts: int = 8) -> DataFrame:
    """(section, id, outcome, reason): a section's rows are tried by score until a limit refuses one or the attempts end.

    ranked has section, id, score, ok, usage section and what is left by each limit, in the order they are asked (null:
    no limit). A row that isn't ok fails and uses up an attempt, not the budget. The rest is queued with the reason
    of the stop; limits are asked before attempts are counted, also for the row after the last attempt. Only the rows
    that can be asked are walked.
    """
    before = F.coalesce(F.sum(F.col("ok").cast("int")).over(Window.partitionBy("section").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = top(ranked, ["section"], [F.desc("score"), "id"], attempts + 1).withColumn("before", before).join(usage, "section", "left")
    head = head.withColumn("refusal", F.coalesce(*[F.when(F.col("before") >= F.col(c), F.lit(c)) for c in limits], F.when(F.col("rank") > attempts, F.lit("attempts"))))
    stop = head.where("refusal IS NOT NULL").groupBy("section").agg(F.min_by("refusal", "rank").alias("stop"))
    tried = head.where("refusal IS NULL").select("section", "id", F.when(F.col("ok"), "published").otherwise("failed").alias("outcome"))
    out = ranked.select("section", "id").join(tried, ["section", "id"], "left").join(stop, "section", "left")
    return out.select("section", "id", F.coalesce("outcome", F.lit("queued")).alias("outcome"), F.when(F.col("outcome").isNull(), F.col("stop")).alias("reason"))


def pruned_queue(queue: DataFrame, as_of: Column, days: int = 7, most: int = 3) -> DataFrame:
    """The queue's rows with ``state``: waiting, expired (older than ``days``, or without a date) or exhausted (``most`` attempts)."""
    late = F.col("queued_at").isNull() | (F.col("queued_at") < as_of - F.expr(f"INTERVAL {days} DAYS"))
    return queue.withColumn("state", F.when(late, "expired").when(F.col("attempts") >= most, "exhausted").otherwise("waiting"))


def matched_and_sampled(df: DataFrame, matched: Column, score: str, key: str, k: int, n: int, seed: str) -> DataFrame:
    """The best k matched rows, and n others by the hash of key and seed."""
    best = df.where(matched).orderBy(F.desc(score), key).limit(k).withColumn("part", F.lit("matched"))
    drawn = df.where(~F.coalesce(matched, F.lit(False))).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(n)
    return best.unionByName(drawn.withColumn("part", F.lit("sampled")))
