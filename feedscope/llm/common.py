"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import threading
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


class Memory:
    """Two generations of remembered values: when the young one is full, it becomes the old one."""

    def __init__(self, most: int) -> None:
        self.most, self.now, self.old = most, {}, {}  # plain dicts: sets compare with them by key

    def lacks(self, keys: set[str]) -> list[str]:
        """The keys that must be made; the others are in ``now`` afterwards."""
        if len(self.now) + len(keys) > self.most:
            self.now, self.old = {}, self.now
        new = keys.difference(self.now)
        back = [k for k in new if k in self.old]
        self.now.update((k, self.old[k]) for k in back)
        return list(new.difference(back))


def slices(batches, rows: int = 512):
    """Record batches cut into smaller ones, so that few rows are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return sc.getCheckpointDir()


class _Folders(threading.local):
    """Folders of tables that this thread wrote and hasn't dropped; runs in other threads have lists of their own."""

    def __init__(self) -> None:
        self.made: list[str] = []


_folders = _Folders()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for one run of one operator."""
    root = f"{shared_dir(spark).rstrip('/')}/feedscope-{uuid.uuid4().hex}"
    _folders.made.append(root)
    return f"{root}/{name}"


_lean_lock, _lean_inside = threading.Lock(), {"n": 0, "before": "false"}


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind: who reads the table needs them no more.

    The setting is the session's; it goes back when the last of several writes at a time ends. A job that runs
    meanwhile loses its shuffle files when it ends, too, and makes them again should it be run again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with _lean_lock:
        if not _lean_inside["n"]:
            _lean_inside["before"] = spark.conf.get(key, "false")
            spark.conf.set(key, "true")
        _lean_inside["n"] += 1
    try:
        yield
    finally:
        with _lean_lock:
            _lean_inside["n"] -= 1
            if not _lean_inside["n"]:
                spark.conf.set(key, _lean_inside["before"])


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it, which cuts lineage and outlives executors."""
    path = scratch_path(df.sparkSession, name)
    with lean(df.sparkSession):
        df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many folders this thread has; a place for ``written_since`` to go back to."""
    return len(_folders.made)


def written_since(start: int) -> list[str]:
    return _folders.made[start:]


def drop_written(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders of tables that nobody reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for root in folders:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(conf).delete(path, True)
        if root in _folders.made:
            _folders.made.remove(root)


def drop_with(df: DataFrame, folders: list[str]) -> DataFrame:
    """The same DataFrame; the folders that it reads are deleted when it is gone, not when the process ends."""
    weakref.finalize(df, drop_written, df.sparkSession, list(folders)).atexit = False
    return df


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table doesn't have, whatever its letters' case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def keyed(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key of their own and the key's name: written once, so that it is the same whenever they are read."""
    key = free_name(df, "__row")
    return materialise(df.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def may_hold(df: DataFrame, ids: DataFrame, key: str, slots: int = 1 << 16) -> DataFrame:
    """Rows of ``df`` whose key may be among ``ids``: a cheap filter ahead of an exact join.

    A bitmap of 64 bits in each of ``slots`` slots is built by bit_or and broadcast; its size is bounded by
    ``slots`` whatever the data. It never loses a row; when it fills up, it only lets more rows through.
    """
    h = F.xxhash64(F.col(key))
    slot, bit = F.pmod(h, F.lit(slots)), f"shiftleft(1L, cast(pmod(shiftright(xxhash64(`{key}`), 32), 64) as int))"
    at, bits = free_name(df, "__slot"), free_name(df, "__bits")
    table = ids.select(slot.alias(at), F.expr(bit).alias(bits)).groupBy(at).agg(F.bit_or(bits).alias(bits))
    joined = df.withColumn(at, slot).join(F.broadcast(table), at)
    return joined.where(F.col(bits).bitwiseAND(F.expr(bit)) != 0).drop(at, bits)
