"""What a model's name says besides the model, and what a message's text says of the item it showed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedscope.functions.text import squash

#: Settings of effort that names carry. They are conditions of a reading, not other models.
EFFORTS = (
    "none", "minimal", "low", "medium", "high", "xhigh", "max", "ultra", "unknown", "unknown thinking", "think", "nothink", "thinking", "non-thinking", "reasoning", "default",
)
_SPACE = " \t\n\x0b\f\r"


def effort_of(name: Column, efforts: Sequence[str] = EFFORTS) -> Column:
    """The setting in the name's first brackets, else after its last underscore; null if that is none."""
    text = F.btrim(F.coalesce(name, F.lit("")), F.lit(_SPACE))
    inside = F.btrim(F.lower(F.regexp_extract(text, r"\(([^)]*)\)", 1)), F.lit(_SPACE))
    tail = F.when(F.contains(text, F.lit("_")), F.lower(F.btrim(F.substring_index(text, "_", -1), F.lit(_SPACE))))
    return F.when(inside.isin(*efforts), inside).when(tail.isin(*efforts), tail)


def bare_name(name: Column, efforts: Sequence[str] = EFFORTS) -> Column:
    """The form in which names are compared, without the setting that they end with (the longest one, in brackets or not)."""
    low = F.lower(F.btrim(F.coalesce(name, F.lit("")), F.lit(_SPACE)))
    open_end = F.when(F.endswith(low, F.lit(")")) | F.endswith(low, F.lit("]")), F.substring(low, F.lit(1), F.length(low) - 1)).otherwise(low)
    sizes = F.array(*[F.when(F.endswith(open_end, F.lit(e)), F.lit(len(e))).otherwise(F.lit(0)) for e in efforts])
    size = F.array_max(sizes)
    return squash(F.when(size > 0, F.substring(open_end, F.lit(1), F.length(open_end) - size)).otherwise(low))


def message_facts(text: Column) -> Column:
    """struct(title, bucket, score) that a message's text tells: the title in its first line, "[bucket · score 1.5]" in the
    second. Without such a line, or a bucket or number in it, bucket is null and score 0."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85  ]")
    tag = F.btrim(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), F.lit("[] \n"))
    told = F.contains(tag, F.lit("·"))
    bucket = F.nullif(F.btrim(F.substring_index(tag, "·", 1), F.lit(_SPACE)), F.lit(""))
    rest = F.btrim(F.substring(tag, F.position(F.lit("·"), tag) + 1, F.length(tag)), F.lit(_SPACE))
    score = F.element_at(F.split(rest, r"\s+"), -1).try_cast("double")
    title = F.btrim(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), F.lit(_SPACE))
    return F.struct(title.alias("title"), F.when(told, bucket).alias("bucket"), F.when(told, F.coalesce(score, F.lit(0.0))).otherwise(0.0).alias("score"))
