"""Archives and entities: collapse, upsert, merged facts, registries, costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapse(sightings: DataFrame, key: str) -> DataFrame:
    """One winner for each entity: primary sources first, then the earliest; the others are counted, facts united.

    sightings has id, source, tier, published, facts. Counts and sets are made map-side; no group is gathered.
    """
    order = F.struct((F.col("tier") != "primary").cast("int"), F.coalesce("published", F.lit("9999-12-31").cast("date")), "id")
    by = sightings.groupBy(key).agg(F.min_by(F.struct("id", "source", "published"), order).alias("w"), F.count(F.lit(1)).alias("sightings"), F.count_distinct("source").alias("sources"))
    facts = sightings.select(key, F.explode("facts").alias("f")).distinct().groupBy(key).agg(F.array_sort(F.collect_list("f")).alias("facts"))
    return by.join(facts, key, "left").select(key, "w.*", "sightings", "sources", F.coalesce("facts", F.array().cast("array<string>")).alias("facts"))


def upsert_archive(archive: DataFrame, incoming: DataFrame, refreshed: Sequence[str], key: str = "id") -> DataFrame:
    """Known ids get the incoming values of ``refreshed`` columns and keep the others; unknown ids are inserted."""
    a, b = archive.alias("a"), incoming.alias("b")
    first = lambda c: (F.coalesce(f"b.{c}", f"a.{c}") if c in refreshed else F.coalesce(f"a.{c}", f"b.{c}")).alias(c)
    change = F.when(F.col(f"a.{key}").isNull(), "inserted").when(F.col(f"b.{key}").isNull(), "kept").otherwise("refreshed")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*map(first, archive.columns), change.alias("change"))


def starved(topics: DataFrame, vocabulary: DataFrame, as_of: Column, bonus) -> DataFrame:
    """Every topic of the vocabulary with its last day and bonus; topics has topic, published."""
    last = topics.groupBy("topic").agg(F.max("published").alias("last"))
    return vocabulary.join(last, "topic", "left").withColumn("bonus", bonus(F.col("last"), as_of))


def starved_first(topics: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Topics without a post for ``days``, those never published first, then the longest starved: with ``pos`` in that order."""
    late = topics.where(F.col("last").isNull() | (F.datediff(as_of, "last") >= days))
    return late.withColumn("pos", F.row_number().over(Window.orderBy(F.asc_nulls_first("last"), "topic")).cast("long"))  # a closed vocabulary


def build_registry(catalogue: DataFrame, tracked: DataFrame | None = None) -> DataFrame:
    """Group catalogue rows (group, vendor, alias, released, open, seq) into registry entries.

    With ``tracked`` (alias) only groups of which an alias is tracked are built, and ``aliases`` unites a group's names.
    """
    if tracked is not None:
        wanted = catalogue.join(tracked.select("alias").distinct(), "alias", "left_semi").select("group").distinct()
        catalogue = catalogue.join(wanted, "group", "left_semi")
        names = catalogue.where(F.col("alias").isNotNull()).groupBy("group").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
        return build_registry(catalogue).join(names, "group", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    return catalogue.groupBy("group").agg(F.min_by("vendor", "seq").alias("vendor"), F.min("released").alias("released"), F.bool_or("open").alias("open"), F.count_distinct("alias").alias("n_aliases"))


def costs(calls: DataFrame, prices: DataFrame, default_in: int = 4000, default_out: int = 1500) -> DataFrame:
    """usd of each model: calls (model, tokens_in, tokens_out) at prices (model, usd_in, usd_out) a million tokens.

    Missing usage counts as the defaults; an unknown model costs what the dearest by output price does.
    """
    dearest = prices.agg(F.max_by(F.struct("usd_in", "usd_out"), F.struct("usd_out", "usd_in")).alias("d")).withColumn("one", F.lit(1))
    known = calls.join(prices, "model", "left").withColumn("one", F.lit(1)).join(F.broadcast(dearest), "one")
    each = F.coalesce("tokens_in", F.lit(default_in)) * F.coalesce("usd_in", "d.usd_in") + F.coalesce("tokens_out", F.lit(default_out)) * F.coalesce("usd_out", "d.usd_out")
    return known.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), (F.sum(each) / 1e6).alias("usd"), F.count_if(F.col("tokens_in").isNull()).alias("estimated"))


def replay(log: DataFrame, cursor: DataFrame, reasons: Sequence[str] = (), since: Column | None = None, channels: Sequence[str] = (), urls: Sequence[str] = ()) -> DataFrame:
    """(item, reason, at, state): the last logged row of each item that was dropped for one of the reasons since then, in one
    of the channels and for one of the urls, where these are given; a reason or a url must be.

    state is in_cursor or absent; log has item, reason, at, seq (channel, url), cursor item. Rows without an item come
    apart, as no_id.
    """
    if not (reasons or urls):
        raise ValueError("name a reason or a url, so that the whole log isn't replayed by accident")
    kept = log.where(F.col("at") >= since) if since is not None else log
    for column, values in (("reason", reasons), ("channel", channels), ("url", urls)):
        kept = kept.where(F.col(column).isin(*values)) if values else kept
    last = kept.where("item IS NOT NULL").groupBy("item").agg(F.max_by(F.struct("reason", "at"), F.struct("at", "seq")).alias("l")).select("item", "l.*")
    known = cursor.select("item", F.lit("in_cursor").alias("state")).distinct()
    found = last.join(known, "item", "left").withColumn("state", F.coalesce("state", F.lit("absent")))
    return found.unionByName(kept.where("item IS NULL").select("item", "reason", "at", F.lit("no_id").alias("state")))


def offered_again(cursor: DataFrame, replayed: DataFrame) -> DataFrame:
    """The cursor without the items that ``replay`` found in it, so that the next run meets them as new."""
    return cursor.join(replayed.where("state = 'in_cursor'").select("item").distinct(), "item", "left_anti").select(*cursor.columns)


def requests(replies: DataFrame, cached: DataFrame, placeholders: Sequence[str] = ("none", "-", "")) -> DataFrame:
    """(message, item, kind, instruction): a reply to a cached message asks for its item, any other one stands alone.

    replies has message, reply_to, text, cached message, item; placeholder texts are no instruction.
    """
    known = cached.select(F.col("message").alias("reply_to"), "item")
    text = F.trim("text")
    said = F.when(~F.lower(F.coalesce(text, F.lit(""))).isin(*placeholders), text)
    return replies.join(known, "reply_to", "left").select("message", "item", F.when(F.col("item").isNull(), "standalone").otherwise("item").alias("kind"), said.alias("instruction"))


def post_facts(ledger: DataFrame, posts: DataFrame, fields: Sequence[str], hot: float = 85.0) -> DataFrame:
    """Ledger rows with the post's fields before the ledger's; both have slug and the fields, relevance among them."""
    p = posts.select("slug", *[F.col(c).alias(f"post_{c}") for c in fields])
    both = ledger.join(p, "slug", "left").select("slug", *[F.coalesce(f"post_{c}", c).alias(c) for c in fields])
    return both.withColumn("hot", F.coalesce(F.col("relevance") >= hot, F.lit(False)))
