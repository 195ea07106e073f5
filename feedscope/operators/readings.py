"""Readings as one state: the table of each benchmark, who leads it, and models that are measured for the first time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedscope.operators.joins import not_superseded
from feedscope.operators.shared import written
from feedscope.operators.windows import top


def boards(readings: DataFrame, benchmarks: DataFrame, tier_one: DataFrame, k: int = 25, lead: int = 5) -> DataFrame:
    """(part, benchmark, id, model, value, rank, total) of the readings that no other one supersedes.

    part ``table``: the best ``k`` of each benchmark in its own direction, ties to the newest; ``total`` counts all of them.
    ``new_leader`` and ``new_top_entrant``: new readings that are first, or among the best ``lead``, of those by others
    than the vendor. ``first_measurement``: of each vendor of ``tier_one``, new readings of a model of which none was
    held before, the earliest of each model.

    readings has benchmark, id, model, vendor, value, measured_at, measured_by, is_new, supersedes; benchmarks has benchmark and
    higher_is_better, others aren't read; tier_one has vendor. The readings are read twice for who supersedes whom, then
    written once, narrow, and all parts come from that table. Nulls: a reading without a value stands last.
    """
    live = not_superseded(readings).join(benchmarks, "benchmark").select(
        "benchmark", "id", "model", "vendor", "value", "measured_at", (F.col("measured_by") == "vendor").alias("claimed"), "is_new",
        F.when(F.col("higher_is_better"), -F.col("value")).otherwise(F.col("value")).alias("by"),
    )
    live = written(live)
    total = live.groupBy("benchmark").agg(F.count(F.lit(1)).alias("total"))
    order = [F.asc_nulls_last("by"), F.desc_nulls_last("measured_at"), F.col("id")]
    names = ["part", "benchmark", "id", "model", "value", "rank"]
    table = top(live, ["benchmark"], order, k).withColumn("part", F.lit("table")).select(*names)
    leaders = top(live.where("NOT claimed"), ["benchmark"], [F.asc_nulls_last("by"), F.col("id")], lead).where("is_new")
    leaders = leaders.withColumn("part", F.when(F.col("rank") == 1, "new_leader").otherwise("new_top_entrant")).select(*names)
    known = live.where("NOT is_new").select("model").distinct()
    new = live.where("is_new").join(known, "model", "left_anti").join(tier_one.select("vendor").distinct(), "vendor", "left_semi")
    firsts = top(new, ["model"], [F.asc_nulls_last("measured_at"), F.col("id")], 1).withColumn("part", F.lit("first_measurement")).select(*names)
    return table.unionByName(leaders).unionByName(firsts).join(total, "benchmark").select("part", "benchmark", "id", "model", "value", "rank", "total")
