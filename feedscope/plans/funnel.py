"""The ranked funnel: duplicates, exclusion, topics, gate and rank in one pass with a reason for every drop."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedscope.functions.rules import starvation
from feedscope.functions.score import Interests, QualityRules, any_in, matched, quality_total, relevance, with_vocabulary
from feedscope.functions.text import first_match, topic_labels
from feedscope.operators.windows import quota_top


@dataclass(frozen=True)
class Profile:
    topics: Sequence[tuple[str, str]]
    sections: Sequence[tuple[str, str]]
    exclude: Sequence[tuple[str, str]]
    quality: QualityRules
    interests: Interests
    section: str
    #: Each topic's own words, which are matched like the item's; None: not.
    vocabulary: Mapping[str, str] | None = None


#: What class a reason belongs to; unknown reasons count as quality.
REASON_CLASS = {"duplicate": "quality", "excluded": "exclusion", "no_topic": "quality", "below_gate": "quality", "publish_attempts_exhausted": "budget"}


def once(df: DataFrame, **features: Column) -> DataFrame:
    """The rows with features that are computed once a row: they come from a generator, which filters above it don't repeat."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in features.items()]))))


def reason_sentence(strong: Column, medium: Column, section: Column, topics: Column, most: int = 200) -> Column:
    """Why an item is relevant: its interests, and where it is filed."""
    why = F.when(F.size(strong) > 0, F.concat(F.lit("Strong interest: "), F.array_join(strong, ", "))).when(F.size(medium) > 0, F.concat(F.lit("Near an interest: "), F.array_join(medium, ", "))).otherwise("No interest matched")
    filed = F.concat(F.lit(". Filed under "), section, F.lit(": "), F.coalesce(F.nullif(F.array_join(topics, ", "), F.lit("")), F.lit("no topic")), F.lit("."))
    return F.substring(F.concat(why, filed), 1, most)


#: What ``score_items`` adds to an item, and what each of these is made from.
OUTPUTS = {"topics": (), "section": (), "exclusion": (), "quality": (), "relevance": ("match",), "bucket": ("match",), "why": ("match",), "reason": ("exclusion", "topics", "quality"), "match": ("topics", "section")}


def score_items(
    items: DataFrame, seen: DataFrame, profile: Profile, as_of: Column, extra_reject: Column | None = None, activity: DataFrame | None = None,
    scorer: Callable[[DataFrame], DataFrame] | None = None, told: DataFrame | None = None, wanted: Sequence[str] | None = None, survivors: bool = False,
) -> DataFrame:
    """Items with topics, section, exclusion, quality, relevance, bucket, why and reason (null for survivors), or those ``wanted``.

    The first failing stage names the reason: duplicate, excluded, ``extra_reject``, no_topic, below_gate. A duplicate's url
    was seen, or its id stands in ``told`` (its title tells an old story). The profile's words on an item's topics are
    matched with its own text. ``activity`` (topic, last) gives the starvation bonus: that of the most starved topic;
    without it there is none. ``scorer`` replaces the quality score: it takes the items that no cheaper stage drops and
    gives (id, quality). With ``survivors`` only items that pass come out, and each stage works on those the stages before
    it have left, the cheap ones first. The text is put together once and each feature made only if something asks for it.
    What is made from the text is made before items meet urls and ids, so that texts travel only if they are wanted or for
    a ``scorer``.
    """
    need = set(wanted or [k for k in OUTPUTS if k != "match"]) | ({"reason"} if survivors else set())
    for _ in OUTPUTS:
        need |= {x for k in need for x in OUTPUTS[k]}
    txt, low = F.col("__txt"), F.col("__low")
    out = once(items, __txt=F.concat("title", F.lit("\n"), "summary"))
    if "exclusion" in need:
        out = once(out, exclusion=first_match(profile.exclude, txt))
    if "reason" in need:
        extra = extra_reject if extra_reject is not None else F.lit(None).cast("string")
        out = once(out, __early=F.coalesce(F.when(F.col("exclusion").isNotNull(), "excluded"), extra))
        out = out.where(F.col("__early").isNull()) if survivors else out
    if "topics" in need:
        out = once(out, topics=topic_labels(txt, profile.topics))
    if "reason" in need:
        out = out.withColumn("__early", F.coalesce("__early", F.when(F.size("topics") == 0, "no_topic")))
        out = out.where(F.col("__early").isNull()) if survivors else out
    below = F.when(F.col("quality") < profile.quality.gate, "below_gate")
    if "quality" in need and scorer is None:
        c = {k: F.col(k) for k in ("title", "summary", "source", "tier", "published", "url")} | {"text": txt}
        out = once(out, quality=quality_total(c, profile.quality, as_of))
        out = out.where(below.isNull()) if survivors else out
    if "section" in need:
        out = once(out, section=F.coalesce(first_match(profile.sections, txt), F.lit("research")))
    if "match" in need:
        bonus = F.lit(0)
        if activity is not None:  # a closed vocabulary: one row with a map of its topics
            last = activity.agg(F.map_from_entries(F.collect_list(F.struct("topic", "last"))).alias("__last"))
            out = out.join(F.broadcast(last), F.lit(True))
            bonus = F.coalesce(F.array_max(F.transform("topics", lambda t: starvation(F.try_element_at("__last", t), as_of))), F.lit(0.0))
        enriched = txt if profile.vocabulary is None else F.concat(txt, F.lit(" "), with_vocabulary(F.col("topics"), profile.vocabulary))
        likes = profile.interests
        out = once(out, __low=F.lower(enriched))
        out = once(out, __strong=matched(low, likes.strong), __medium=matched(low, likes.medium), __is_low=any_in(low, likes.low), __deep=F.coalesce(txt.rlike(profile.quality.mechanism), F.lit(False)))
        r = relevance(F.col("__strong"), F.col("__medium"), F.col("__is_low"), F.col("topics"), F.col("section") == profile.section, F.col("__deep"), bonus)
        out = once(out, __r=r)
        why = reason_sentence(F.col("__strong"), F.col("__medium"), F.col("section"), F.col("topics"))
        out = out.withColumn("relevance", F.col("__r.total")).withColumn("bucket", F.col("__r.bucket")).withColumn("why", why)
    out, early = out.drop("__txt", "__low"), F.lit(None).cast("string")
    if "reason" in need:  # no anti join for survivors: Spark would move it below what is made from the text
        out = out.join(seen.select("url").distinct().withColumn("__dup", F.lit(True)), "url", "left")
        dup = F.col("__dup")
        if told is not None:
            out, dup = out.join(told.select("id").distinct().withColumn("__told", F.lit(True)), "id", "left"), F.coalesce("__dup", "__told")
        out = out.where(dup.isNull()) if survivors else out
        early = F.coalesce(F.when(dup, "duplicate"), "__early")
    if "quality" in need and scorer is not None:
        given = scorer(out.where(early.isNull())).select("id", F.coalesce("quality", F.lit(0.0)).alias("quality"))
        out = out.join(given, "id", "left").withColumn("quality", F.coalesce("quality", F.lit(0.0)))
        out = out.where(below.isNull()) if survivors else out
    if "reason" in need:
        out = out.withColumn("reason", F.coalesce(early, below))
    return out.select(*items.columns, *[k for k in OUTPUTS if k in need and k != "match"])


def rejections(scored: DataFrame) -> DataFrame:
    """Counts by class and reason."""
    kind = F.lit("quality")
    for reason, name in REASON_CLASS.items():
        kind = F.when(F.col("reason") == reason, name).otherwise(kind)
    return scored.where("reason IS NOT NULL").groupBy(kind.alias("class"), "reason").agg(F.count(F.lit(1)).alias("n"))


def ranked(scored: DataFrame, bucket: str, quotas: dict[str, int], cap: int) -> DataFrame:
    return quota_top(scored.where("reason IS NULL"), bucket, quotas, "relevance", "id", cap)
