"""Profiles as rules: a parsed profile becomes the columns that the funnel and the digests are built from."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column

from feedscope.functions.score import Interests, QualityRules
from feedscope.functions.text import keyword_score
from feedscope.plans.funnel import Profile


def parse(text: str) -> dict:
    """A profile's text: YAML where the library is there, JSON (which is YAML) anywhere."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def interest_profile(rules: Mapping) -> Profile:
    """topics, sections, exclude: name -> pattern, in order; only the excluded names under ``active`` can fire, if it is given.

    quality: the patterns and, if wanted, gate and weights; strong, medium: lists of {topic, signals}, where a topic without
    signals is its own; low: words; section; vocabulary: topic -> words.
    """
    tier = lambda rows: tuple((r["topic"], tuple(r.get("signals") or [r["topic"]])) for r in rows or ())
    low = lambda rows: tuple((n, tuple(s.lower() for s in ws)) for n, ws in rows)
    q = dict(rules["quality"])
    if "weights" in q:
        q["weights"] = tuple(q["weights"])
    if "roundups" in q:
        q["roundups"] = tuple(q["roundups"])
    active = rules.get("active")
    exclude = tuple((n, p) for n, p in (rules.get("exclude") or {}).items() if active is None or n in active)
    interests = Interests(low(tier(rules.get("strong"))), low(tier(rules.get("medium"))), tuple(w.lower() for w in rules.get("low") or ()))
    return Profile(tuple(rules["topics"].items()), tuple(rules["sections"].items()), exclude, QualityRules(**q), interests, rules["section"], rules.get("vocabulary"))


def reading_score(text: Column, rules: Mapping) -> Column:
    """struct(score, bucket) by a reading profile: buckets {name: {weight, keywords}}, penalize {factor, keywords}, exclude."""
    lower = lambda ws: tuple(w.lower() for w in ws or ())
    buckets = {n: (float(b.get("weight", 1.0)), lower(b["keywords"])) for n, b in rules["buckets"].items()}
    penalty = rules.get("penalize") or {}
    return keyword_score(text, buckets, (float(penalty.get("factor", 1.0)), lower(penalty.get("keywords")) or ("\0",)), lower(rules.get("exclude")) or ("\0",))


def quotas(rules: Mapping) -> dict[str, int]:
    return {n: int(b.get("min_per_digest", 0)) for n, b in rules["buckets"].items()}
