"""A registry of adapters: functions that each give readings and the names they couldn't resolve."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Adapter = Callable[[], tuple[DataFrame, DataFrame]]


def collect(spark: SparkSession, adapters: Mapping[str, Adapter], path: str) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
    """(rows, unresolved, failures) of all adapters, each with its name in ``adapter``.

    An adapter's rows are written below ``path`` at once, so that one that fails while it reads is left out, with its
    error, and the others stand. Columns that an adapter lacks are null.
    """
    rows, parked, failures = [], [], []
    for name, adapter in adapters.items():
        try:
            found = []
            for part, df in zip(("rows", "unresolved"), adapter(), strict=True):
                df.write.mode("overwrite").parquet(f"{path}/{part}/{name}")
                found.append(spark.read.schema(df.schema).parquet(f"{path}/{part}/{name}").withColumn("adapter", F.lit(name)))
        except Exception as e:  # noqa: BLE001  (whatever an adapter raises is its failure alone)
            failures.append((name, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"))
        else:
            rows.append(found[0])
            parked.append(found[1])
    united = lambda dfs: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs) if dfs else None
    return united(rows), united(parked), spark.createDataFrame(failures, "adapter string, error string")
