"""Constraints as data: each a rule with a severity and perhaps a cutover, all evaluated in one pass over the rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Constraint:
    """Rows that ``broken`` (SQL) is true of break the rule; unknown isn't broken.

    Rows dated before ``since`` are grandfathered: they are reported as such, not failed. Rows without a date are new.
    """

    name: str
    broken: str
    severity: str = "error"
    since: str | None = None


def _state(rule: Constraint, day: Column) -> Column:
    """``rule.severity`` or "grandfathered" where the rule is broken, else null."""
    old = day < F.lit(rule.since).cast("date") if rule.since is not None else F.lit(False)
    return F.when(F.expr(rule.broken), F.when(old, F.lit("grandfathered")).otherwise(F.lit(rule.severity)))


def violations(rows: DataFrame, rules: Sequence[Constraint], key: str, day: str, totals: Observation | None = None) -> DataFrame:
    """(rule, severity, key): a row for each rule that a row breaks; severity is the rule's or grandfathered.

    ``totals`` is filled as the violations are read, by the same scan: rows, and for each rule the broken and grandfathered ones.
    """
    named = {r.name: _state(r, F.col(day)) for r in rules}
    judged = rows.select(F.col(key).alias(key), *[c.alias(n) for n, c in named.items()])
    if totals is not None:
        counts = [f(F.coalesce(F.col(n) == "grandfathered", F.lit(False)), F.col(n)).alias(f"{n}:{k}") for n in named for k, f in (("broken", lambda old, c: F.count_if(c.isNotNull() & ~old)), ("grandfathered", lambda old, c: F.count_if(old)))]
        judged = judged.observe(totals, F.count(F.lit(1)).alias("rows"), *counts)
    each = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("rule"), F.col(n).alias("severity"))) for n in named]))
    return judged.select(F.inline(each), key)


def report(rows: DataFrame, rules: Sequence[Constraint], day: str) -> DataFrame:
    """(rule, severity, broken, grandfathered, rows) of every rule, also of those that no row breaks."""
    named = {r.name: _state(r, F.col(day)) for r in rules}
    judged = rows.select(*[c.alias(n) for n, c in named.items()])
    counts = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.count_if(F.col(r.name) != "grandfathered").alias("broken"), F.count_if(F.col(r.name) == "grandfathered").alias("grandfathered"), F.count(F.lit(1)).alias("rows")) for r in rules]
    return judged.agg(F.array(*counts).alias("r")).select(F.inline("r"))
