"""Landed registries and logs: tolerant scans and append-only sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedscope.functions.text import timestamp

SOURCE = "naam string, name string, url string, type string, tier string, vendor string, verified boolean, role string, note string, inScope boolean, in_scope boolean"


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """A source registry: a bare list, or one under "feeds" or "sources"; rows without a name are dropped.

    Defaults: rss, primary, vendor "-", in scope; both spellings of in_scope count.
    """
    rows = spark.read.text(path, wholetext=True)
    listed = F.when(F.trim("value").startswith("["), F.from_json("value", f"array<struct<{_struct()}>>"))
    under = F.from_json("value", f"struct<feeds:array<struct<{_struct()}>>,sources:array<struct<{_struct()}>>>")
    one = rows.select(F.explode(F.coalesce(listed, under["feeds"], under["sources"])).alias("s")).select("s.*")
    name = F.coalesce("naam", "name")
    return one.where(name.isNotNull() & (name != "")).select(
        name.alias("name"), "url", F.coalesce("type", F.lit("rss")).alias("type"), F.coalesce("tier", F.lit("primary")).alias("tier"), F.coalesce("vendor", F.lit("-")).alias("vendor"),
        F.coalesce("verified", F.lit(False)).alias("verified"), "role", "note", F.coalesce("inScope", "in_scope", F.lit(True)).alias("in_scope"),
    )


def _struct() -> str:
    return ",".join(x.strip().replace(" ", ":") for x in SOURCE.split(","))


def append_log(rows: DataFrame, path: str) -> None:
    """One JSON line for each event; nothing is rewritten."""
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank and malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_archive(rows: DataFrame, path: str, at: str) -> None:
    """Parquet by month of ``at``; only months that occur in the rows are replaced."""
    rows.withColumn("month", F.date_format(at, "yyyy-MM")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def read_items_xml(spark: SparkSession, path: str, limit: int | None = None, most: int | None = None) -> DataFrame:
    """The items of RSS and entries of Atom files: (file, id, title, url, summary, published).

    id is the guid or id, else the link or title; published falls back to updated; the summary is cut at ``most``
    characters, and the first ``limit`` of a file are taken (None: whole, all).
    """
    file = F.col("_metadata.file_path").alias("file")
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).select("*", file, F.monotonically_increasing_id().alias("seq"))
    rss = read("item", "guid string, link string, title string, description string, pubDate string, updated string")
    link = "array<struct<_href:string,_rel:string>>"
    atom = read("entry", f"id string, link {link}, title string, summary string, content string, published string, updated string")
    main = F.get(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))
    href = F.coalesce(main["_href"], F.get("link", F.lit(0))["_href"])
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    one = rss.select("file", "seq", F.coalesce(blank("guid"), blank("link"), blank("title")).alias("id"), "title", blank("link").alias("url"), F.col("description").alias("summary"), F.coalesce(timestamp(F.col("pubDate")), timestamp(F.col("updated"))).alias("published"))
    two = atom.select("file", "seq", F.coalesce(blank("id"), href, blank("title")).alias("id"), "title", href.alias("url"), F.coalesce("summary", "content").alias("summary"), F.coalesce(timestamp(F.col("published")), timestamp(F.col("updated"))).alias("published"))
    rows = one.unionByName(two)
    if limit is not None:
        rows = rows.withColumn("k", F.expr("row_number() over (partition by file order by seq)")).where(F.col("k") <= limit)
    return rows.select("file", "id", "title", "url", F.substring("summary", 1, most).alias("summary") if most is not None else F.col("summary"), "published")


#: Fixed value: the form of a paper's address, with its number and version.
PAPER = "arxiv[.]org/abs/([0-9]{4}[.][0-9]{4,5})(?:v([0-9]+))?"


def papers(items: DataFrame, revisions: tuple[str, ...] = ("replace", "replace-cross")) -> DataFrame:
    """(id, title, abstract, link, announce_type) of feed items (title, url, summary): first appearances only.

    The id is the archive's number in the link; the type stands in the text, else a version above one is a revision.
    """
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    whole = F.coalesce("summary", F.lit(""))
    low = F.lower(whole)
    after = F.ltrim(F.regexp_replace(F.get(F.split(low, "announce type:"), F.lit(1)), r"\s", " "))
    said = F.get(F.split(after, "[^a-z0-9_-]"), F.lit(0))
    version = F.regexp_extract("url", PAPER, 2).try_cast("int")
    kind = F.coalesce(F.nullif(said, F.lit("")), F.when(version > 1, "replace"), F.lit("new"))
    label = F.lit("abstract:")
    at = F.position(label, low)
    abstract = F.when(at > 0, F.substring(whole, at + F.length(label), F.length(whole))).otherwise(whole)
    x = items.select(F.regexp_extract("url", PAPER, 1).alias("id"), flat(F.col("title")).alias("title"), flat(abstract).alias("abstract"), F.col("url").alias("link"), kind.alias("announce_type"))
    return x.where((F.col("id") != "") & ~F.col("announce_type").isin(*revisions))


def read_fixture(spark: SparkSession, path: str) -> DataFrame:
    """Recorded items, each with a source of its own: (id, title, url, summary, published, source, tier, vendor)."""
    item = "id string, title string, url string, summary string, published string, source struct<naam:string,name:string,url:string,type:string,tier:string,vendor:string>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"items array<struct<{_fields(item)}>>")["items"]).alias("i")).select("i.*")
    blank = F.lit("")
    return rows.select(
        "id", F.coalesce("title", blank).alias("title"), F.coalesce("url", blank).alias("url"), F.coalesce("summary", blank).alias("summary"), timestamp(F.col("published")).alias("published"),
        F.coalesce("source.naam", "source.name", blank).alias("source"), F.coalesce("source.tier", F.lit("primary")).alias("tier"), F.coalesce("source.vendor", F.lit("-")).alias("vendor"),
    )


def _fields(schema: str) -> str:
    return ",".join(x.strip().replace(" ", ":", 1) for x in schema.split(", "))


def feed_rows(posts: DataFrame) -> DataFrame:
    """(scope, name, id, title, description, published, link, author, categories): the whole site's feed, one for each section
    and one for each topic; posts has id, title, description, published, url, author, section, format, topics."""
    filed = F.concat(F.array(F.concat_ws(" — ", "section", "format")), "topics")
    row = posts.select("id", "title", "description", "published", F.col("url").alias("link"), "author", filed.alias("categories"), "section", "topics")
    scopes = F.concat(
        F.array(F.struct(F.lit("site").alias("scope"), F.lit(None).cast("string").alias("name")), F.struct(F.lit("section").alias("scope"), F.col("section").alias("name"))),
        F.transform("topics", lambda t: F.struct(F.lit("topic").alias("scope"), t.alias("name"))),
    )
    return row.select(F.inline(scopes), "id", "title", "description", "published", "link", "author", "categories")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files with flat front matter: title, kind, format, topics, body; files without a title are dropped."""
    rows = spark.read.text(path, wholetext=True)
    head, body = F.regexp_extract("value", r"(?s)^---\n(.*?)\n---", 1), F.regexp_replace("value", r"(?s)^---\n.*?\n---\n?", "")
    field = lambda k: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(head, rf"(?m)^{k}:[ \t]*(.*)$", 1), "^[\"']|[\"']$", "")), F.lit(""))
    topics = F.filter(F.transform(F.split(F.regexp_replace(field("topics"), r"[\[\]\"']", ""), ","), lambda t: F.trim(t)), lambda t: t != "")
    out = rows.select(field("title").alias("title"), F.coalesce(field("kind"), F.lit("research")).alias("kind"), F.coalesce(field("format"), F.lit("news")).alias("format"), F.coalesce(topics, F.array().cast("array<string>")).alias("topics"), body.alias("body"))
    return out.where("title IS NOT NULL")


def stem(name: Column | str = "_metadata.file_name") -> Column:
    """A file's name up to its last dot."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def front_matter(text: Column) -> Column:
    """The fields of a file's front matter as a map: flat ones by name, those of an object by "object.name".

    An object is a name without a value and the indented lines under it; a later field replaces an earlier one of its
    name. A text without front matter has no fields.
    """
    lines = F.split(F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1), "\n")
    entry = "struct<k:string,v:string>"
    start = F.struct(F.lit("").alias("object"), F.array().cast(f"array<{entry}>").alias("rows"))

    def step(acc: Column, line: Column) -> Column:
        key, value = F.trim(F.split_part(line, F.lit(":"), F.lit(1))), F.trim(F.when(F.contains(line, F.lit(":")), F.substring(line, F.position(F.lit(":"), line) + 1, F.length(line))).otherwise(""))
        inner = F.startswith(line, F.lit("  ")) & (acc["object"] != "")
        row = F.struct(F.when(inner, F.concat(acc["object"], F.lit("."), key)).otherwise(key).alias("k"), F.btrim(value, F.lit('"')).alias("v"))
        named = F.when(inner, acc["object"]).when(value == "", key).otherwise(F.lit(""))
        rows = F.when(inner | (value != ""), F.concat(acc["rows"], F.array(row))).otherwise(acc["rows"])
        return F.struct(named.alias("object"), rows.alias("rows"))

    rows = F.aggregate(lines, start, step)["rows"]
    last = F.filter(rows, lambda r, i: ~F.exists(F.slice(rows, i + 2, F.size(rows)), lambda later: later["k"] == r["k"]))
    return F.map_from_entries(last)


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """(slug, title, pub_date, kind, format, topics, source_url, front, body) of Markdown files; those without a title are dropped."""
    rows = spark.read.text(path, wholetext=True).select(stem().alias("slug"), "value").withColumn("front", front_matter(F.col("value")))
    field = lambda k: F.nullif(F.try_element_at("front", F.lit(k)), F.lit(""))
    listed = F.split(F.regexp_extract("value", r"(?m)^topics:\s*\[(.*?)\]\s*$", 1), ",")
    topics = F.transform(F.filter(listed, lambda t: F.trim(t) != ""), lambda t: F.btrim(F.trim(t), F.lit('"')))
    out = rows.select("slug", field("title").alias("title"), F.coalesce(field("pubDate"), F.lit("")).alias("pub_date"), F.coalesce(field("kind"), F.lit("research")).alias("kind"), F.coalesce(field("format"), F.lit("news")).alias("format"), topics.alias("topics"), F.coalesce(field("source.url"), F.lit("")).alias("source_url"), "front", F.regexp_replace("value", r"(?s)^---\n.*?\n---\n?", "").alias("body"))
    return out.where("title IS NOT NULL")


def read_records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(id, record, broken): one JSON record a file, as a variant, whatever its nesting; the file's stem is its id.

    What doesn't parse has a null record and is ``broken``; who reads the collection filters or counts these. With
    ``lines`` each line is a record, so that large collections need few files; a file's records share its stem.
    """
    rows = spark.read.text(path, wholetext=not lines).select(stem().alias("id"), F.try_parse_json("value").alias("record"))
    return rows.withColumn("broken", F.col("record").isNull())
