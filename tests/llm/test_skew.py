"""Hot keys, split partitions, late reads and cases that earlier rounds missed."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedscope.llm import decontam, license_scan, source_mix, token_shards, warc
from feedscope.llm.queries import tokenizer_path
from test_operators import brute_contaminated

SPLIT = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "500KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1MB"}


def test_warc_of_a_split_hot_page(spark, tmp_path):
    """2,400 equal pages, one page_id, of several segments each, over partitions that Spark splits."""
    html = "".join(random.Random(1).choices("abcdefghij <>", k=24_000))
    hot = spark.range(0, 2400, 1, 12).select(F.lit(7).cast("long").alias("page_id"), F.lit("http://x/hot").alias("url"), F.lit(html).alias("html"))
    rest = spark.range(600).select((F.col("id") + 100).alias("page_id"), F.concat(F.lit("http://x/"), F.col("id")).alias("url"), F.when(F.col("id") % 3 == 0, F.lit(html)).otherwise(F.repeat(F.concat(F.col("id").cast("string"), F.lit(" ")), 5000)).alias("html"))
    path = str(tmp_path / "pages")
    hot.unionByName(rest).write.parquet(path)
    before = {k: spark.conf.get(k, None) for k in SPLIT}
    try:
        for k, v in SPLIT.items():
            spark.conf.set(k, v)
        got = warc.archive_digest(spark.read.parquet(path)).groupBy("record_type", "refers_to", "error").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("payload_digest").alias("d"), F.min("payload_bytes").alias("least")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert sorted((r.record_type, r.refers_to, r.error, r.n, r.d) for r in got) == [("response", None, None, 2400 + 400, 401), ("revisit", 7, None, 200, 1)]


def test_unpacking_is_linear():
    data = b"".join(warc._member(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 1500\r\n\r\n" + bytes(random.Random(k).choices(range(256), k=1500))) for k in range(8000))
    began = time.time()
    records = [r for m in warc.members(data) for r in warc.parse(m)]
    assert len(records) == 8000 and all(block is not None for _, block in records) and time.time() - began < 2.5


def test_shards_and_mixes_split_rows_without_an_id(spark, tmp_path):
    """Two fifths of the rows have no id, and half of those are equal."""
    rng = random.Random(2)
    rows = [(None if k % 5 < 2 else k, "the same text" if k % 5 == 0 else " ".join(rng.choices(["a", "bb", "ccc"], k=rng.randint(1, 30))), "s1" if k % 3 else None) for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    path = str(tmp_path / "docs")
    df.write.parquet(path)
    docs = spark.read.parquet(path)
    got = source_mix.mix_digest(docs)
    assert got.count() == len(rows)
    by = got.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") / F.greatest("size", F.lit(1))).alias("most")).collect()
    assert all(abs(r.taken - r.target) < 0.02 * r.target + 60 and r.most <= 2 for r in by)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, source_mix.mix_digest(docs).collect()))
    shards = token_shards.shard_digest(docs, tokenizer_path("word_bpe_49k.json")).orderBy("start").collect()
    assert len(shards) == len(rows) and [r.doc_id for r in shards] == [None] * 2400 + sorted(r[0] for r in rows if r[0] is not None)
    at = 0
    for r in shards:
        assert r.start == at
        at += r.n_tokens
    ranged = docs.select("doc_id", F.monotonically_increasing_id().alias("tie")).repartitionByRange(8, "doc_id", "tie")
    sizes = [r[1] for r in ranged.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 1.5 * len(rows) / 8


def edited(rng, words, places):
    out = list(words)
    for at in sorted(places, reverse=True):
        out.insert(at, rng.choice(["zig", "zag", "zog"]))
    return out


def test_windows_between_alignments(spark):
    """Two words put into an item four words apart, and long words near its ends: the best window begins between alignments."""
    rng = random.Random(3)
    items, docs = [], []
    for k in range(150):
        n = rng.randint(40, 60)
        words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 6))) for _ in range(n)]
        words[5], words[n - 6] = "x" * 60 + str(k), "y" * 60 + str(k)
        at = rng.choice([2, 3, n // 2, n - 8])
        items.append((k, " ".join(words)))
        docs.append((k, " ".join([*(["pad"] * rng.randrange(4)), *edited(rng, words, (at, at + 4)), "end"])))
        docs.append((1000 + k, " ".join(words[n // 2 :] + words[: n // 2])))  # halves changed round
    got = {r[:2]: r for r in map(tuple, decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect())}
    want = brute_contaminated(docs, items)
    assert set(got) == set(want) and len(want) > 100


def test_results_of_the_pipeline_last(spark, sf):
    one = corpus_pipeline.run(spark, sf)
    two = corpus_pipeline.run(spark, sf)
    rows = sorted(map(repr, one.collect()))
    assert rows and rows == sorted(map(repr, two.collect()))
    stage = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert stage.count() > 0  # a stage run meanwhile takes nothing from it
    assert sorted(map(repr, one.collect())) == rows


def test_two_pipelines_at_a_time(spark, sf):
    found, wrong = {}, []

    def work(name):
        try:
            found[name] = sorted(map(repr, corpus_pipeline.run(spark, sf).collect()))
        except Exception as e:  # noqa: BLE001  (told by the test)
            wrong.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not wrong and found[0] == found[1]


def test_near_misses_of_notices_are_cheap():
    """A megabyte of what begins like several notices and is none of them."""
    text = "licensed under the apache " * 40_000
    began = time.time()
    assert license_scan.scan(text)[5] == [] and time.time() - began < 5


def test_edits_are_never_overcounted():
    rng = random.Random(7)

    def edits(notice, text):
        row = [0] * (len(text) + 1)
        for i, a in enumerate(notice, 1):
            last, row = row, [i]
            for j, b in enumerate(text, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (a != b)))
        return min(row)

    for i, (notice, _) in enumerate(license_scan.NOTICES):
        texts = []
        for _ in range(12):
            t = list(notice)
            for _ in range(rng.randrange(12)):
                at = rng.randrange(len(t))
                t[at : at + rng.randrange(2)] = rng.choice(["", "x", "é", " "])
            texts.append("".join(rng.choices("abc é", k=rng.randrange(9))) + "".join(t))
        bare = "".join(texts)
        ends = [0]
        for t in texts:
            ends.append(ends[-1] + len(t))
        import numpy as np

        codes = np.frombuffer(bare.encode("utf-32-le"), np.uint32)
        got = license_scan.least_edits(i, codes, np.array(list(zip(ends, ends[1:], strict=False))))
        assert got.tolist() == [edits(notice[:64], t) for t in texts]
