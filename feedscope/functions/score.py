"""Quality and relevance scores in thousandths, so that totals are exact whatever the order of addition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class QualityRules:
    mechanism: str
    result: str
    number: str
    verifiable: str
    #: The weights of the components and the gate.
    weights: tuple[int, int, int, int] = (40, 25, 20, 15)
    gate: float = 65.0
    tiers: dict = field(default_factory=lambda: {"primary": 1000, "corroborating": 620, "community": 450})
    roundups: tuple[str, ...] = ()


def tenths(milli: Column) -> Column:
    """Thousandths rounded to one decimal, halves up."""
    return F.floor((milli + 50) / 100).cast("double") / 10


def quality_total(item: dict[str, Column], rules: QualityRules, as_of: Column) -> Column:
    """The gate's total from title, summary, source, tier, published and url columns; ``text`` is title and summary, if at hand."""
    text = item["text"] if "text" in item else F.concat(item["title"], F.lit("\n"), item["summary"])
    hit = lambda p, v: F.when(text.rlike(p), v).otherwise(0)
    substance = hit(rules.mechanism, 500) + hit(rules.result, 300) + hit(rules.number, 300)
    substance = F.least(F.lit(1000.0), F.when(F.length(item["summary"]) < 120, substance * 0.55).otherwise(substance * 1.0)).cast("long")
    tier = F.lit(500)
    for name, v in rules.tiers.items():
        tier = F.when(item["tier"] == name, v).otherwise(tier)
    source = F.when(item["source"].isin(*rules.roundups), F.least(tier, F.lit(350))).otherwise(tier) if rules.roundups else tier
    age = F.datediff(as_of, item["published"])
    novelty = F.when(age.isNull(), 1000).when(age <= 2, 1000).when(age <= 7, 800).when(age <= 21, 500).otherwise(200)
    verifiable = F.least(F.lit(1000), F.lit(350) + hit(rules.verifiable, 400) + F.when(item["url"].startswith("https://"), 150).otherwise(0))
    return tenths(sum(w * c for w, c in zip(rules.weights, (substance, source, novelty, verifiable), strict=True)))


@dataclass(frozen=True)
class Interests:
    strong: Sequence[tuple[str, Sequence[str]]]
    medium: Sequence[tuple[str, Sequence[str]]]
    low: Sequence[str]


def with_vocabulary(topics: Column, words: Mapping[str, str]) -> Column:
    """What a vocabulary says about an item's topics; topics that it lacks say nothing."""
    known = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.array_join(F.transform(topics, lambda t: F.coalesce(F.try_element_at(known, t), F.lit(""))), " ")


def matched(text: Column, tier: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Interests of which any signal is in the text."""
    return F.array_compact(F.array(*[F.when(any_in(text, signals), F.lit(name)) for name, signals in tier]))


def relevance(strong_ones: Column, medium_ones: Column, is_low: Column, topics: Column, in_section: Column, deep: Column, starvation: Column) -> Column:
    """struct(total, bucket): matches, fit, depth, starvation bonus and low-interest penalty. ``strong_ones`` and
    ``medium_ones`` are the interests ``matched``; give them as columns, as each is read several times."""
    n_strong, n_medium = F.size(strong_ones), F.size(medium_ones)
    share = lambda n: F.least(F.lit(1000), 700 + 150 * (n - 1))
    strong = F.when(n_strong > 0, 45 * share(n_strong)).otherwise(0)
    medium = F.when((n_strong == 0) & (n_medium > 0), 20 * share(n_medium)).otherwise(0)
    fit = 15 * (F.when(in_section, 500).otherwise(0) + F.when(F.size(topics) > 0, 250 + 125 * F.least(F.lit(2), F.size(topics) - 1)).otherwise(0))
    total = strong + medium + fit + F.when(deep, 10000).otherwise(0) + 1000 * starvation + F.when(is_low, -25000).otherwise(0)
    bucket = F.when(n_strong > 0, "strong").when(n_medium > 0, "adjacent").otherwise("serendipity")
    return F.struct(tenths(F.greatest(total, F.lit(0))).alias("total"), bucket.alias("bucket"))


def any_in(text: Column, signals: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, signals)), lambda s: F.contains(text, s))
