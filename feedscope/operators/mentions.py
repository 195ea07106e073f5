"""Which names occur in which texts, by a dictionary automaton; corroboration and the longest known name.

The dictionary is cut into shards of SHARD_BYTES of names, by hash. One shard after another is sent to all tasks, each of
which walks its texts once with it; the only rows made are hits. A shard's automaton is built once in a worker.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

#: Bytes of names that are sent to all tasks at a time; their automaton takes some forty times that.
SHARD_BYTES = 2 << 20
#: Rows of a batch that are worked at a time.
ROWS = 256

_built: dict[str, ahocorasick.Automaton] = {}


def _shards(needles: DataFrame) -> list[tuple[str, Broadcast]]:
    """The distinct needles in shards of bounded size, each with a key; only a shard at a time passes the driver."""
    names = needles.where(F.length("needle") > 0).select("needle").distinct()
    size = names.agg(F.sum(F.octet_length("needle"))).first()[0] or 0
    n, sc = -(-size // SHARD_BYTES), needles.sparkSession.sparkContext
    part = lambda k: names.where(F.pmod(F.xxhash64("needle"), F.lit(n)) == k).toArrow()["needle"].to_pylist()
    return [(uuid.uuid4().hex, sc.broadcast(shard)) for shard in map(part, range(n)) if shard]


def _automaton(key: str, shard: Broadcast) -> ahocorasick.Automaton:
    if key not in _built:
        _built.clear()  # a worker has one at a time
        a = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for name in shard.value:
            a.add_word(name)
        a.make_automaton()
        _built[key] = a
    return _built[key]


def _first_places(a: ahocorasick.Automaton, text: str | None) -> dict[str, int]:
    """Each name in the text with the place of its first letter, from 1, where it stands first."""
    found: dict[str, int] = {}
    for end, n in a.iter(text or ""):
        found.setdefault(text[end - n + 1 : end + 1], end - n + 2)
    return found


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def occurrences(texts: DataFrame, needles: DataFrame, width: int = 4) -> DataFrame:
    """(id, needle, pos) wherever a needle is a substring of a text; pos counts from 1 and is the first.

    texts has id, text, needles has needle, both in the case to compare in. Needles shorter than ``width`` are
    left out, and so are null texts.
    """
    rows, schema = texts.select("id", "text"), StructType([texts.schema["id"], StructField("needle", StringType()), StructField("pos", LongType())])

    def search(key: str, shard: Broadcast):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _sliced(batches):
                a, at, names, places = _automaton(key, shard), [], [], []
                for k, text in enumerate(b.column("text").to_pylist()):
                    found = _first_places(a, text)
                    at += [k] * len(found)
                    names += found
                    places += found.values()
                yield pa.record_batch([b.column("id").take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(places, pa.int64())], names=["id", "needle", "pos"])

        return rows.mapInArrow(work, schema)

    return _union([search(*s) for s in _shards(needles.where(F.length("needle") >= width))], texts, schema)


def _union(parts: list[DataFrame], texts: DataFrame, schema: StructType) -> DataFrame:
    out = parts[0] if parts else texts.sparkSession.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def longest_known(texts: DataFrame, names: DataFrame, least: int = 4) -> DataFrame:
    """(id, model): the longest name in a text, then the earliest, then the first of the registry; ``least`` letters at least.

    texts has id, text and perhaps title: then a name in the title wins over all in the text, as the headline names the
    subject and the body what it is compared with. names has ord, model, name. Case doesn't count. Texts without a
    name have no row. Each shard gives the best name of a text, and the best of these wins.
    """
    title = F.lower("title") if "title" in texts.columns else F.lit(None).cast("string")
    rows = texts.select("id", title.alias("title"), F.lower("text").alias("text"))
    low = names.where(F.length("name") >= least).select("ord", "model", F.lower("name").alias("needle"))
    schema = StructType([texts.schema["id"], StructField("in_title", BooleanType()), StructField("needle", StringType()), StructField("pos", LongType())])

    def search(key: str, shard: Broadcast):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _sliced(batches):
                a, out = _automaton(key, shard), []
                for k, (head, body) in enumerate(zip(b.column("title").to_pylist(), b.column("text").to_pylist(), strict=True)):
                    inside = _first_places(a, head)
                    found = inside or _first_places(a, body)
                    if found:
                        name = max(found, key=lambda x: (len(x), -found[x]))
                        out.append((k, bool(inside), name, found[name]))
                at, first, best, pos = zip(*out, strict=True) if out else ((), (), (), ())
                yield pa.record_batch([b.column("id").take(pa.array(at, pa.int64())), pa.array(first, pa.bool_()), pa.array(best, pa.string()), pa.array(pos, pa.int64())], names=["id", "in_title", "needle", "pos"])

        return rows.mapInArrow(work, schema)

    hits = _union([search(*s) for s in _shards(low)], texts, schema)
    best = hits.groupBy("id").agg(F.max_by("needle", F.struct("in_title", F.length("needle"), -F.col("pos"))).alias("needle"))
    return best.join(low.groupBy("needle").agg(F.min_by("model", "ord").alias("model")), "needle").select("id", "model")


def corroborate(candidates: DataFrame, items: DataFrame, as_of, hours: int = 48) -> DataFrame:
    """(candidate, id): recent or undated items that hold all parts of a candidate's family; parts under three letters don't count.

    candidates has candidate, family ("gpt-astra"), items has id, text, published. Items are searched once for all parts. A
    candidate meets only the items of its rarest part; the other parts are looked up there. Families without a part match
    nothing.
    """
    recent = items.where(F.col("published").isNull() | (F.col("published").cast("timestamp") >= as_of - F.make_dt_interval(hours=F.lit(hours)))).select("id", F.lower("text").alias("text"))
    parts = candidates.select("candidate", F.array_distinct(F.filter(F.split(F.lower("family"), "-"), lambda p: F.length(p) > 2)).alias("parts")).where("size(parts) > 0")
    each = parts.select("candidate", F.explode("parts").alias("needle"))
    hits = occurrences(recent, each, 3).select("id", "needle")
    counted = each.join(hits.groupBy("needle").agg(F.count(F.lit(1)).alias("n")), "needle")  # a part that no item holds has no row
    rarest = counted.groupBy("candidate").agg(F.min_by("needle", F.struct("n", "needle")).alias("needle"))
    met = rarest.join(parts, "candidate").join(hits, "needle").join(recent, "id")
    return met.where(F.forall("parts", lambda p: F.contains(F.col("text"), p))).select("candidate", "id")
