"""Joins: duplicates, name resolution, coverage, ranges, references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedscope.functions.text import squash


def unseen(items: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    """Items whose key isn't in the cursor."""
    return items.join(seen.select(key).distinct(), key, "left_anti")


def resolve_names(names: DataFrame, registry: DataFrame) -> DataFrame:
    """names(name) with ``model``: by id, by alias, by squashed alias, else null. The first registry row wins an alias.

    registry has ord, id, aliases.
    """
    alias = registry.select("ord", "id", F.explode("aliases").alias("alias"))
    first = lambda df, key: df.groupBy(key).agg(F.min_by("id", "ord").alias("m"))
    ids = registry.select(F.col("id").alias("k1"), F.col("id").alias("m1"))
    exact = first(alias, "alias").select(F.col("alias").alias("k2"), F.col("m").alias("m2"))
    loose = first(alias.withColumn("s", squash(F.col("alias"))), "s").select(F.col("s").alias("k3"), F.col("m").alias("m3"))
    out = names.join(ids, F.col("name") == F.col("k1"), "left").join(exact, F.col("name") == F.col("k2"), "left").join(loose, squash(F.col("name")) == F.col("k3"), "left")
    return out.select(*names.columns, F.coalesce("m1", "m2", "m3").alias("model"))


def claims_outside(measurements: DataFrame, gap: float = 5.0) -> DataFrame:
    """Vendor claims that lie outside the range of independent readings by ``gap`` or more, in one pass over the readings.

    The newest claim counts. A claim is held against readings in its own unit where measurements have ``unit``; where they
    have ``is_new``, only pairs with a new side come out. ``refs`` cites claim, nearest, lowest and highest reading.
    """
    key = ["benchmark", "model", *[c for c in ("unit",) if c in measurements.columns]]
    new = F.col("is_new") if "is_new" in measurements.columns else F.lit(True)
    vendor = F.col("measured_by") == "vendor"
    other = F.when(~vendor, F.struct("value", "id"))
    by = measurements.groupBy(*key).agg(
        F.max_by(F.struct("id", "value", new.alias("new"), "measured_at"), F.when(vendor, F.struct("measured_at", "id"))).alias("c"), F.min(other).alias("lo"), F.max(other).alias("hi"),
        F.count_if(~vendor).alias("n"), F.bool_or(~vendor & new).alias("new_reading"), F.max(F.when(vendor, F.lit(1))).alias("claimed"),
    )
    # the newest claim of a model, whatever its unit
    newest = F.row_number().over(Window.partitionBy("benchmark", "model").orderBy(F.desc("c.measured_at"), F.desc("c.id")))
    by = by.where("claimed = 1").withColumn("k", newest).where("k = 1 and n > 0")
    claim, low, high = F.col("c.value"), F.col("lo.value"), F.col("hi.value")
    nearest = F.when(claim > high, F.col("hi.id")).otherwise(F.col("lo.id"))
    refs = F.array_distinct(F.array(F.col("c.id"), nearest, F.col("lo.id"), F.col("hi.id")))
    out = by.withColumn("gap", F.greatest(low - claim, claim - high)).where((F.col("gap") >= gap) & (F.col("c.new") | F.col("new_reading")))
    return out.select(*key, F.col("c.id").alias("claim_id"), claim.alias("claim"), low.alias("low"), high.alias("high"), "n", "gap", refs.alias("refs"))


def coverage_decision(candidates: DataFrame, covered: DataFrame, material: list[str], cooldown_days: int = 10) -> DataFrame:
    """publish, update (a new material fact within the cooldown) or drop, by entity key; covered has key, at, facts."""
    known = covered.select("key", F.col("at").alias("covered_at"), F.col("facts").alias("old"))
    out = candidates.join(known, "key", "left")
    recent = F.col("covered_at").isNotNull() & (F.datediff("at", "covered_at") <= cooldown_days)
    fresh = F.size(F.array_except(F.array_intersect("facts", F.array(*map(F.lit, material))), F.coalesce("old", F.array().cast("array<string>"))))
    return out.withColumn("decision", F.when(~recent, "publish").when(fresh > 0, "update").otherwise("drop")).drop("old", "covered_at")


def related(posts: DataFrame, most: int = 3, threads: DataFrame | None = None) -> DataFrame:
    """Posts of a post's threads, in the threads' order; then posts that share a topic: those of another kind first, then the
    same kind, then recency; ``most`` each.

    posts has id, kind, topics, published, threads thread, ord, id (members that aren't posts don't count; threads come by
    name). Whoever is among a post's best is among the best of its topic and kind, so posts meet only the newest
    ``most`` + 1 of each topic and kind, not all that share a topic, and of a thread only the first ``most`` + 1.
    """
    one = posts.select("id", "kind", F.explode("topics").alias("t"))
    two = posts.select(F.col("id").alias("other"), F.col("kind").alias("k2"), F.col("published").alias("p2"), F.explode("topics").alias("t"))
    newest = F.row_number().over(Window.partitionBy("t", "k2").orderBy(F.desc("p2"), "other"))
    two = two.withColumn("k", newest).where(F.col("k") <= most + 1).drop("k")
    met = one.join(two, "t").where("id <> other").groupBy("id", "other", "p2").agg(F.min(F.when(F.col("kind") != F.col("k2"), 1).otherwise(2)).alias("priority"))
    if threads is not None:
        member = threads.join(posts.select("id"), "id", "left_semi").groupBy("thread", "id").agg(F.min("ord").alias("ord"))
        place = F.row_number().over(Window.partitionBy("thread").orderBy("ord", "id"))
        first = member.withColumn("place", place).where(F.col("place") <= most + 1).select("thread", F.col("id").alias("other"), "place")
        mates = member.select("thread", "id").join(first, "thread").where("id <> other").groupBy("id", "other").agg(F.min(F.struct("thread", "place")).alias("at"))
        met = met.withColumn("at", F.lit(None).cast(mates.schema["at"].dataType)).unionByName(mates.withColumn("p2", F.lit(None).cast(posts.schema["published"].dataType)).withColumn("priority", F.lit(0)))
        met = met.groupBy("id", "other").agg(F.max("p2").alias("p2"), F.min("priority").alias("priority"), F.min("at").alias("at"))
    order = ["priority", *(["at"] if threads is not None else []), F.desc("p2"), "other"]
    rank = F.row_number().over(Window.partitionBy("id").orderBy(*order))
    return met.withColumn("rank", rank).where(F.col("rank") <= most).select("id", "other", "priority", F.col("rank").cast("long").alias("rank"))


def dangling(refs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return refs.join(ids.select(key), key, "left_anti")


def merge_registries(existing: DataFrame, seeded: DataFrame) -> DataFrame:
    """Full outer by id: existing values win, aliases are united. Both have id, vendor, aliases."""
    a, b = existing.alias("a"), seeded.alias("b")
    empty = F.array().cast("array<string>")
    united = F.array_sort(F.array_union(F.coalesce("a.aliases", empty), F.coalesce("b.aliases", empty)))
    return a.join(b, F.col("a.id") == F.col("b.id"), "full_outer").select(F.coalesce("a.id", "b.id").alias("id"), F.coalesce("a.vendor", "b.vendor").alias("vendor"), united.alias("aliases"))


def superseded_by(posts: DataFrame) -> DataFrame:
    """Posts with the title and url of the post that covers them better; posts has id, title, url, better (an id or null)."""
    other = posts.select(F.col("id").alias("better"), F.col("title").alias("better_title"), F.col("url").alias("better_url"))
    return posts.join(other, "better", "left").select("id", "better", "better_title", "better_url")


def grown_cursor(seen: DataFrame, fetched: DataFrame, key: Sequence[str] = ("id",)) -> DataFrame:
    """The cursor after a run: what was seen and what was fetched, each once."""
    return seen.select(*key).union(fetched.select(*key)).distinct()


def overlay(existing: DataFrame, pending: DataFrame, key: str = "id") -> DataFrame:
    """Existing rows that no pending one has the key of, and the pending ones."""
    return existing.join(pending.select(key), key, "left_anti").select(*existing.columns).unionByName(pending)


def not_superseded(rows: DataFrame, key: str = "id", by: str = "supersedes") -> DataFrame:
    """Rows that no row supersedes."""
    gone = rows.where(F.col(by).isNotNull()).select(F.col(by).alias(key)).distinct()
    return rows.join(gone, key, "left_anti").select(*rows.columns)


def novel_with_baseline(items: DataFrame, seen: DataFrame, sources: DataFrame) -> DataFrame:
    """Unseen items with ``baseline``: those of a source that the cursor doesn't know are only recorded, not ranked.

    seen has id, sources source; with an empty cursor all is baseline.
    """
    known = sources.select("source").distinct().withColumn("__known", F.lit(True))
    return unseen(items, seen).join(known, "source", "left").withColumn("baseline", F.col("__known").isNull()).drop("__known")
