"""Checks of drafts against what they cite: entities, versions, figures; claims in prose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedscope.functions.text import number_value, numbers, squash, stated, ungrounded


def spelled_in(name: Column, text: Column) -> Column:
    """The name's letters and digits stand in the text's; an empty name doesn't count."""
    return (squash(name) != "") & F.contains(squash(text), squash(name))


def version_in(version: Column, text: Column) -> Column:
    """The version stands alone: what is left and right of some place where it occurs doesn't carry the number on."""
    around = F.split(F.lower(text), F.concat(F.lit(r"\Q"), F.lower(version), F.lit(r"\E")))
    alone = F.zip_with(F.slice(around, 1, F.size(around) - 1), F.slice(around, 2, F.size(around)), lambda left, right: ~left.rlike("[0-9.]$") & ~right.rlike("^[0-9.%]"))
    return F.exists(alone, lambda x: x)


def entity_grounding(releases: DataFrame, sources: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, missing): "family" if neither it nor a spelling of it stands in the source, "version" if that doesn't.

    releases has id, family, version, sources id, text, registry family, names (array). Without a source all is missing.
    """
    names = registry.select("family", "names")
    x = releases.join(names, "family", "left").join(sources.select("id", "text"), "id", "left")
    text = F.coalesce("text", F.lit(""))
    spelled = F.exists(F.concat(F.array("family"), F.coalesce("names", F.array().cast("array<string>"))), lambda n: spelled_in(n, text))
    version = F.coalesce("version", F.lit(""))
    gone = F.array_compact(F.array(F.when(~F.coalesce(spelled, F.lit(False)), "family"), F.when((version != "") & ~version_in(version, text), "version")))
    return x.select("id", gone.alias("missing"))


def figures(text: Column) -> Column:
    """Numbers outside names that read as scores: with a percent sign, decimals, a unit, or four digits and more."""
    return F.array_distinct(F.filter(stated(text, names=False), lambda x: x.rlike(r"[%A-Za-z]|\d\.\d") | (F.length(F.regexp_replace(x, ",", "")) >= 4)))


def reference_integrity(drafts: DataFrame, measurements: DataFrame) -> DataFrame:
    """(id, n_refs, dangling, untraced): cited ids that don't exist, and figures that no cited value explains.

    drafts has id, body, refs, measurements id, value. A figure may be a value, its hundredth or hundredfold.
    """
    refs = drafts.select("id", F.explode(F.array_distinct("refs")).alias("ref"))
    known = refs.join(measurements.select(F.col("id").alias("ref"), "value", F.lit(True).alias("there")), "ref", "left")
    cited = known.groupBy("id").agg(F.count(F.lit(1)).alias("n_refs"), F.array_sort(F.collect_list(F.when(F.col("there").isNull(), F.col("ref")))).alias("dangling"), F.collect_set(F.round("value", 6)).alias("values"))
    near = lambda v: F.array(v, F.round(v / 100, 6), F.round(v * 100, 6))
    explained = F.flatten(F.transform("values", near))  # made once a draft, not once for each figure
    traced = lambda x: F.exists(F.array(number_value(x)), lambda v: F.arrays_overlap(near(v), F.col("values")))
    out = drafts.join(cited, "id", "left").withColumn("values", explained)
    untraced = F.array_sort(F.filter(figures(F.col("body")), lambda x: ~F.coalesce(traced(x), F.lit(False))))
    return out.select("id", F.coalesce("n_refs", F.lit(0)).alias("n_refs"), F.coalesce("dangling", F.array().cast("array<string>")).alias("dangling"), untraced.alias("untraced"))


#: Fixed value: how prose writes a score.
SCORE = r"\d{1,3}(?:\.\d+)?\s?%|\b\d{1,3}\.\d\b"


def claims(posts: DataFrame, benchmarks: Sequence[tuple[str, str]], untracked: str, attribution: str) -> DataFrame:
    """(id, sentence, benchmark, value, skip): the scores that sentences claim, or why a named benchmark gives none.

    posts has id, body, url, model (null where unresolved). The k-th benchmark named takes the k-th figure, if there are
    as many of both; untracked benchmarks take a place too. Reasons, in order: untracked, no_figure, no_source,
    no_attribution, no_model, count_mismatch.
    """
    one = posts.select("id", "url", "model", F.posexplode(F.split(F.regexp_replace("body", r"\s+", " "), r"(?<=[.!?])\s+")).alias("sentence", "s"))
    first = [F.struct(F.regexp_instr(F.col("s"), F.lit(f"(?i){p}")).alias("pos"), F.lit(b).alias("b")) for b, p in benchmarks]
    scores = F.regexp_extract_all("s", F.lit(SCORE), F.lit(0))
    # an untracked name's place: the length of what stands before its k-th occurrence
    cut = F.split("s", f"(?i)(?:{untracked})")
    names = F.regexp_extract_all("s", F.lit(f"(?i)(?:{untracked})"), F.lit(0))
    before = lambda k: F.aggregate(F.slice(cut, 1, k + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice(names, 1, k), F.lit(0), lambda a, x: a + F.length(x))
    others = F.transform(names, lambda n, k: F.struct((before(k) + 1).alias("pos"), F.lit(None).cast("string").alias("b")))
    named = F.array_sort(F.concat(F.filter(F.array(*first), lambda x: x["pos"] > 0), others))
    x = one.withColumn("named", named).where("size(named) > 0").withColumn("scores", scores)
    x = x.select("*", F.posexplode("named").alias("k", "n"))
    b, some = F.col("n.b"), F.size("scores") > 0
    skip = (
        F.when(b.isNull(), "untracked").when(~some, "no_figure").when(F.coalesce("url", F.lit("")) == "", "no_source").when(~F.col("s").rlike(attribution), "no_attribution")
        .when(F.col("model").isNull(), "no_model").when(F.size("named") != F.size("scores"), "count_mismatch")
    )
    value = F.regexp_extract(F.try_element_at("scores", F.col("k") + 1), r"[\d.]+", 0).try_cast("double")
    x = x.where(b.isNotNull() | some).withColumn("skip", skip)  # an untracked name without a figure claims nothing
    return x.select("id", "model", F.col("sentence").cast("long").alias("sentence"), b.alias("benchmark"), F.when(F.col("skip").isNull(), value).alias("value"), "skip")


def numeric_grounding(drafts: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, n, offending): the numbers of a draft that its source doesn't hold; names' digits are no numbers of a draft.

    drafts has id, body, sources id, text. A draft without a source has no number in it.
    """
    x = drafts.select("id", "body").join(sources.select("id", "text"), "id", "left")
    x = x.select("id", stated(F.col("body"), names=False).alias("draft"), numbers(F.col("text")).alias("source"))
    return x.select("id", F.size("draft").cast("long").alias("n"), ungrounded(F.col("draft"), F.col("source")).alias("offending"))


def checked(drafts: DataFrame, numeric: DataFrame, entity: DataFrame, references: DataFrame, reasons: Sequence[tuple[str, str]]) -> DataFrame:
    """(id, gate, reason, offending): the first check that a draft fails, in the order G1, G2, G5; nulls where it passes all.

    drafts has id, is_release, has_refs: only releases are asked for their entity, only drafts with references for those.
    The others are what the three checks give; a draft that a check has no row for passes it. ``reasons`` names each gate's.
    """
    x = drafts.join(numeric.select("id", F.col("offending").alias("g1")), "id", "left").join(entity.select("id", F.col("missing").alias("g2")), "id", "left")
    both = references.select("id", F.concat("dangling", "untraced").alias("g5"))
    x = x.join(both, "id", "left")
    asked = {"G1": F.lit(True), "G2": F.col("is_release"), "G5": F.col("has_refs")}
    fails = [F.when(asked[g] & (F.size(F.col(g.lower())) > 0), F.struct(F.lit(g).alias("gate"), F.lit(r).alias("reason"), F.col(g.lower()).alias("offending"))) for g, r in reasons]
    return x.select("id", F.coalesce(*fails).alias("f")).select("id", "f.gate", "f.reason", F.coalesce("f.offending", F.array().cast("array<string>")).alias("offending"))
