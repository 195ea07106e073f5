"""Landed JSON endpoints, hub listings, leaderboards and CSV bundles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Marks of derivative uploads in a repository's name.
DERIVATIVE = "(?i)gguf|awq|gptq|int4|int8|fp8|bnb|4bit|8bit|mlx|onnx|openvino|-quantized|-quant|-exl2|-ggml"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(source, payload): one landed response a file; the file's name is the source."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("source"), F.col("value").alias("payload"))


def objects(payloads: DataFrame, limit: int | None = None) -> DataFrame:
    """The other columns, and ``extra``: each object of an array as JSON, or the single object; the rest is skipped."""
    text = F.ltrim("payload")
    many = F.when(F.startswith(text, F.lit("[")), F.from_json(text, "array<string>")).when(F.startswith(text, F.lit("{")), F.array(text))
    kept = F.slice(many, 1, limit) if limit else many
    rest = [c for c in payloads.columns if c != "payload"]
    return payloads.select(*rest, F.explode(kept).alias("extra")).where(F.startswith(F.ltrim("extra"), F.lit("{")))


def _when(text: Column) -> Column:
    return F.try_to_timestamp(text)


def endpoint_items(payloads: DataFrame, limit: int | None = None) -> DataFrame:
    """(source, id, title, url, published, extra): id is id, _id or title; title falls back to it, url to the source's."""
    row = F.from_json("extra", "id string, _id string, title string, url string, publishedAt string, createdAt string")
    filled = lambda *names: F.coalesce(*[F.nullif(F.col(f"r.{n}"), F.lit("")) for n in names])
    x = objects(payloads, limit).withColumn("r", row).withColumn("id", F.coalesce(filled("id", "_id", "title"), F.lit("")))
    return x.select("source", "id", F.coalesce(filled("title"), "id").alias("title"), F.coalesce(filled("url"), "source").alias("url"), _when(filled("publishedAt", "createdAt")).alias("published"), "extra")


def hub_items(payloads: DataFrame, base: str, prefix: str = "hub:", limit: int | None = None, derivative: str = DERIVATIVE) -> DataFrame:
    """(source, id, title, url, published, tags): a listing's repositories without derivative uploads."""
    row = F.from_json("extra", "modelId string, id string, createdAt string, tags array<string>")
    x = objects(payloads, limit).withColumn("r", row).withColumn("repo", F.coalesce(F.nullif("r.modelId", F.lit("")), "r.id"))
    x = x.where((F.col("repo") != "") & ~F.col("repo").rlike(derivative))
    return x.select("source", F.concat(F.lit(prefix), "repo").alias("id"), F.col("repo").alias("title"), F.concat(F.lit(base), "repo").alias("url"), _when(F.col("r.createdAt")).alias("published"), F.coalesce("r.tags", F.array().cast("array<string>")).alias("tags"))


def board_value(raw: Column, percent: Column) -> Column:
    """Percentages to two places, where up to 1 is a fraction; other values to three."""
    return F.when(percent, F.round(F.when(raw <= 1, raw * 100).otherwise(raw), 2)).otherwise(F.round(raw, 3))


def board_claims(payloads: DataFrame, base: str, percent: Column) -> DataFrame:
    """(source, model, value, notes): rows a model's own page states; not pending, not external, with a number."""
    row = F.from_json("extra", "modelId string, value string, notes string, pullRequest string, source struct<url:string,isExternal:boolean>")
    x = objects(payloads).withColumn("r", row).withColumn("model", F.trim("r.modelId"))
    own = F.col("r.pullRequest").isNull() & ~F.coalesce("r.source.isExternal", F.lit(False)) & (F.col("model") != "") & (F.col("r.source.url") == F.concat(F.lit(base), "model"))
    notes = F.nullif(F.trim("r.notes"), F.lit(""))
    x = x.where(own).withColumn("value", board_value(F.col("r.value").try_cast("double"), percent)).where("value IS NOT NULL")
    return x.select("source", "model", "value", F.coalesce(F.concat(F.lit("stated by the model's page: "), notes), F.lit("stated by the model's page; conditions unknown")).alias("notes"))


@dataclass(frozen=True)
class BundleFile:
    """One CSV of a bundle: which benchmark it measures, and where the score stands. raw * scale is a fraction."""

    name: str
    benchmark: str
    score: str
    scale: float = 1.0
    percent: bool = True
    internal: bool = True
    variant: str = ""
    evaluator: str = "unknown"


def filled(df: DataFrame, names: Sequence[str], pattern: str | None = None) -> Column:
    """The first of these columns that isn't blank (and matches the pattern); columns a file lacks are passed over."""
    there = [F.trim(F.col(f"`{n}`").cast("string")) for n in names if n in df.columns]
    good = [F.when((c != "") & (c.rlike(pattern) if pattern else F.lit(True)), c) for c in there]
    return F.coalesce(*good, F.lit(None).cast("string"))


def read_bundle(spark: SparkSession, path: str, files: Sequence[BundleFile], dates: Sequence[str], links: Sequence[str], version: str, since: str) -> DataFrame:
    """(benchmark, version, value, measured_at, url, variant, evaluator, measured_by) of a folder of CSV files.

    Each file is read with its own header; files that aren't there are skipped. Rows need a date from ``since`` on, a
    number and a version. Internal files are third-party readings, others those of the community.
    """
    names = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+\.csv)(?:/|$)", 1)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(names.alias("n")).where(F.col("n").isin([f.name for f in files])).distinct()
    there = {r["n"] for r in listed.collect()}  # one name for each configured file at most

    def rows(f: BundleFile) -> DataFrame:
        df = spark.read.option("header", True).csv(f"{path}/{f.name}")
        raw = filled(df, [f.score]).try_cast("double") * f.scale
        return df.select(
            F.lit(f.benchmark).alias("benchmark"), filled(df, [version]).alias("version"), F.round(raw * 100, 2).alias("value") if f.percent else F.round(raw, 3).alias("value"),
            F.substring(filled(df, dates), 1, 10).try_cast("date").alias("measured_at"), filled(df, links, "^https?://").alias("url"),
            F.lit(f.variant).alias("variant"), F.lit(f.evaluator).alias("evaluator"), F.lit("thirdparty" if f.internal else "community").alias("measured_by"),
        ).where((F.col("measured_at") >= F.lit(since).cast("date")) & F.col("value").isNotNull() & F.col("version").isNotNull())

    found = [rows(f) for f in files if f.name in there]
    if not found:
        raise FileNotFoundError(f"none of the bundle's files is in {path}")
    return reduce(DataFrame.unionByName, found)
