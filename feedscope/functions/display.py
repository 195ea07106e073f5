"""Texts shown to readers; the wording is the caller's."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def value_text(value: Column, unit: Column) -> Column:
    one = F.format_string("%.1f", value)
    return (
        F.when(unit == "percent", F.concat(one, F.lit("%"))).when(unit == "elo", F.floor(value + 0.5).cast("long").cast("string"))
        .when(unit == "usd", F.format_string("$%.2f", value)).when(unit == "seconds", F.concat(one, F.lit("s"))).otherwise(one)
    )


def cut(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, with an ellipsis where it was cut."""
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit)), F.lit("…"))).otherwise(text)


def summary(parts: Sequence[tuple[str, Column]], between: str = " · ") -> Column:
    """Labelled values in one line, in order; blank values, and their labels, are left out."""
    shown = [F.when(F.trim(v.cast("string")) != "", F.concat(F.lit(label), v.cast("string"))) for label, v in parts]
    return F.concat_ws(between, *shown)


def disclosure(kind: Column, clauses: Mapping[str, Sequence[tuple[Column, Column]]], between: str = "; ") -> Column:
    """One sentence a kind: the clauses whose condition holds, in order, and a full stop; null for an unknown kind."""
    line = F.lit(None).cast("string")
    for name, listed in clauses.items():
        said = F.concat(F.concat_ws(between, *[F.when(F.coalesce(c, F.lit(False)), text) for c, text in listed]), F.lit("."))
        line = F.when(kind == name, said).otherwise(line)
    return line
