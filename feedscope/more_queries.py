"""Further registered queries: predicates, rubrics, archives, costs and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedscope import queries as Q
from feedscope.functions import rules
from feedscope.operators import archive, windows
from feedscope.sources import logs

_DAY = "2024-02-10"


@Q.query(f"""WITH {Q._ITEMS} SELECT id, source FROM items WHERE (published IS NULL OR DATE '{_DAY}' - published <= 14)
  AND CASE source WHEN 'src1' THEN contains(summary, 'tion') WHEN 'src2' THEN contains(summary, 'keit') OR contains(summary, 'ment') ELSE true END AND tier <> 'community'""")
def release_intake(spark, d):
    x = Q.items(spark, d)
    keep = rules.not_older(F.col("published"), F.lit(_DAY).cast("date"), 14) & rules.wanted_volume(F.col("source"), F.col("summary"), {"src1": ("tion",), "src2": ("keit", "ment")})
    return x.where(keep & (F.col("tier") != "community")).select("id", "source")


@Q.query(f"""WITH {Q._ITEMS}, h AS (SELECT *, contains(title, 'tion') AS a, contains(summary, 'keit') AS b, published >= DATE '2024-02-01' AS c, tier = 'primary' AS e FROM items)
SELECT id, (a::INT * 4 + b::INT * 2 + c::INT * 3 - e::INT)::BIGINT AS score, concat_ws(',', CASE WHEN a THEN 'new_model' END, CASE WHEN b THEN 'capability' END, CASE WHEN c THEN 'recent' END, CASE WHEN e THEN 'primary' END) AS reasons FROM h""")
def release_rubric(spark, d):
    r = rules.rubric((("new_model", 4, F.contains("title", F.lit("tion"))), ("capability", 2, F.contains("summary", F.lit("keit"))), ("recent", 3, F.col("published") >= "2024-02-01"), ("primary", -1, F.col("tier") == "primary")))
    return Q.items(spark, d).select("id", r.alias("r")).select("id", "r.score", F.array_join("r.reasons", ",").alias("reasons"))


@Q.query(f"""WITH {Q._ITEMS}, s AS (SELECT lang || '/' || (id % 50)::VARCHAR AS entity, *, ['f' || (id % 3)::VARCHAR, 'g' || (id % 2)::VARCHAR] AS facts FROM items),
f AS (SELECT entity, array_to_string(list_sort(list_distinct(flatten(list(facts)))), ',') AS facts, count(*) AS sightings, count(DISTINCT source) AS sources FROM s GROUP BY entity)
SELECT s.entity, s.id, s.source, s.published, f.sightings, f.sources, f.facts FROM s JOIN f USING (entity) QUALIFY row_number() OVER (PARTITION BY s.entity ORDER BY tier <> 'primary', published, id) = 1""")
def entity_collapse(spark, d):
    x = Q.items(spark, d).withColumn("entity", F.concat_ws("/", "lang", (F.col("id") % 50).cast("string")))
    x = x.withColumn("facts", F.array(F.concat(F.lit("f"), (F.col("id") % 3).cast("string")), F.concat(F.lit("g"), (F.col("id") % 2).cast("string"))))
    return archive.collapse(x, "entity").withColumn("facts", F.array_join("facts", ","))


@Q.query(f"""WITH {Q._SCORED}, old AS (SELECT id, 0.0::DOUBLE AS relevance, 'dismissed' AS status, published FROM scored WHERE tier <> 'primary'), fresh AS (SELECT id, relevance, 'radar' AS status, published + 1 AS published FROM scored WHERE tier <> 'community')
SELECT coalesce(old.id, fresh.id) AS id, coalesce(fresh.relevance, old.relevance) AS relevance, coalesce(old.status, fresh.status) AS status, coalesce(old.published, fresh.published)::DATE AS published,
  CASE WHEN old.id IS NULL THEN 'inserted' WHEN fresh.id IS NULL THEN 'kept' ELSE 'refreshed' END AS change FROM old FULL JOIN fresh ON old.id = fresh.id""")
def archive_upsert(spark, d):
    x = Q.scored(spark, d, "relevance")
    old = x.where("tier <> 'primary'").select("id", F.lit(0.0).alias("relevance"), F.lit("dismissed").alias("status"), "published")
    new = x.where("tier <> 'community'").select("id", "relevance", F.lit("radar").alias("status"), F.date_add("published", 1).alias("published"))
    return archive.upsert_archive(old, new, ["relevance"])


@Q.query(f"""WITH {Q._SCORED}, v AS (SELECT unnest([{", ".join(f"'{t}'" for t, _ in Q.TOPICS)}, 'none']) AS topic), t AS (SELECT unnest(topics) AS topic, published - 14 AS published FROM scored),
l AS (SELECT topic, max(published) AS last FROM t GROUP BY topic) SELECT topic, last, CASE WHEN last IS NULL THEN 10.0 ELSE least(10.0, greatest(0.0, (DATE '{_DAY}' - last - 10) * 1.0)) END::DOUBLE AS bonus FROM v LEFT JOIN l USING (topic)""")
def starved_topics(spark, d):
    vocab = spark.createDataFrame([(t,) for t, _ in Q.TOPICS] + [("none",)], "topic string")
    x = Q.scored(spark, d, "topics").select(F.explode("topics").alias("topic"), F.date_sub("published", 14).alias("published"))
    return archive.starved(x, vocab, F.lit(_DAY).cast("date"), rules.starvation)


@Q.query(f"""WITH {Q._MEAS} SELECT id, lower(regexp_replace(benchmark, '[^A-Za-z0-9]+', '-', 'g')) || '--' || model::VARCHAR || '--' || measured_at::VARCHAR || '--' ||
  substr(sha256('{{"notes": "' || conditions || '", "shots": ' || (seq % 5)::VARCHAR || ', "tools": ' || (seq % 2 = 0)::VARCHAR || '}}'), 1, 4) AS stem FROM m""")
def measurement_ids(spark, d):
    digest = rules.conditions_digest([("shots", F.col("seq") % 5), ("notes", F.col("conditions")), ("harness", F.lit(None).cast("string")), ("tools", F.col("seq") % 2 == 0)])
    name = F.lower(F.regexp_replace("benchmark", "[^A-Za-z0-9]+", "-"))
    return Q.measurements(spark, d).select("id", F.concat_ws("--", name, F.col("model").cast("string"), F.col("measured_at").cast("string"), digest).alias("stem"))


@Q.query("""SELECT p_brand AS "group", arg_min(p_type, p_partkey) AS vendor, min(p_retailprice) AS released, bool_or(p_size > 45) AS open, count(DISTINCT p_name) AS n_aliases FROM part GROUP BY p_brand""")
def registry_build(spark, d):
    p = Q._t(spark, d, "part")
    return archive.build_registry(p.select(F.col("p_brand").alias("group"), F.col("p_type").alias("vendor"), F.col("p_name").alias("alias"), F.col("p_retailprice").alias("released"), (F.col("p_size") > 45).alias("open"), F.col("p_partkey").alias("seq")))


@Q.query("""WITH p(model, usd_in, usd_out) AS (VALUES ('click', 1, 2), ('view', 2, 8), ('error', 5, 3)), c AS (SELECT event_type AS model, CASE WHEN event_id % 7 <> 0 THEN user_id END AS ti, CASE WHEN event_id % 7 <> 0 THEN user_id * 2 END AS tout FROM events)
SELECT c.model, count(*) AS calls, sum(coalesce(ti, 4000) * coalesce(usd_in, 2) + coalesce(tout, 1500) * coalesce(usd_out, 8))::DOUBLE / 1e6 AS usd, count(*) FILTER (ti IS NULL) AS estimated FROM c LEFT JOIN p USING (model) GROUP BY c.model""")
def call_costs(spark, d):
    prices = spark.createDataFrame([("click", 1, 2), ("view", 2, 8), ("error", 5, 3)], "model string, usd_in long, usd_out long")
    usage = F.when(F.col("event_id") % 7 != 0, F.col("user_id"))
    return archive.costs(Q._t(spark, d, "events").select(F.col("event_type").alias("model"), usage.alias("tokens_in"), (usage * 2).alias("tokens_out")), prices)


@Q.query("""WITH c AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'rr:' || (event_id % 7)::VARCHAR || ':' || user_id::VARCHAR WHEN 1 THEN event_type WHEN 2 THEN event_type || ':' || user_id::VARCHAR ELSE 'bad:' || user_id::VARCHAR END AS data FROM events)
SELECT event_id, CASE WHEN regexp_matches(data, '^rr:[1-5]:.+$') THEN 'rate' ELSE split_part(data, ':', 1) END AS action, CASE WHEN regexp_matches(data, '^rr:[1-5]:.+$') THEN split_part(data, ':', 3) ELSE split_part(data, ':', 2) END AS id,
  CASE WHEN regexp_matches(data, '^rr:[1-5]:.+$') THEN split_part(data, ':', 2)::INT END AS rating FROM c WHERE regexp_matches(data, '^rr:[1-5]:.+$') OR regexp_matches(data, '^(click|view|purchase):.+$')""")
def callbacks(spark, d):
    e, user = Q._t(spark, d, "events"), F.col("user_id").cast("string")
    k = F.col("event_id") % 4
    data = F.when(k == 0, F.concat_ws(":", F.lit("rr"), (F.col("event_id") % 7).cast("string"), user)).when(k == 1, F.col("event_type")).when(k == 2, F.concat_ws(":", "event_type", user)).otherwise(F.concat_ws(":", F.lit("bad"), user))
    return e.select("event_id", rules.callback(data, ("click", "view", "purchase")).alias("c")).where("c IS NOT NULL").select("event_id", "c.*")


@Q.query(f"""WITH {Q._SCORED} SELECT published AS day, section, count(*) AS n, min(id) AS first_id FROM scored WHERE reason IS NULL GROUP BY ALL""")
def day_groups(spark, d):
    return Q.passed(spark, d, "section").groupBy(F.col("published").alias("day"), "section").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@Q.query(f"""WITH {Q._SCORED} SELECT unnest(topics) AS topic, id, title, url, array_to_string(list_concat([section], topics), ',') AS categories FROM scored WHERE reason IS NULL""")
def topic_feeds(spark, d):
    x = Q.passed(spark, d, "topics", "section")
    return x.select(F.explode("topics").alias("topic"), "id", "title", "url", F.array_join(F.concat(F.array("section"), "topics"), ",").alias("categories"))


@Q.query(f"""WITH {Q._SCORED} SELECT section, id, row_number() OVER (PARTITION BY section ORDER BY CASE WHEN id % 4 = 0 THEN id % 16 END NULLS LAST, published, id) AS pos FROM scored WHERE reason IS NULL QUALIFY pos <= 10""")
def reading_path(spark, d):
    x = Q.passed(spark, d, "section").withColumn("o", F.when(F.col("id") % 4 == 0, F.col("id") % 16))
    return windows.top(x, ["section"], [F.asc_nulls_last("o"), "published", "id"], 10).select("section", "id", F.col("rank").alias("pos"))


@Q.query("SELECT event_type AS reason, count(*) AS n, max(value) AS most FROM events GROUP BY event_type")
def log_round_trip(spark, d):
    path = f"{Q._stream_dir(spark)}/log"
    logs.append_log(Q._t(spark, d, "events").select(F.col("event_type").alias("reason"), "value", "ts"), path)
    return logs.read_log(spark, path, "reason string, value double").groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))


@Q.query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, sum(o_custkey)::BIGINT AS keys FROM orders GROUP BY ALL")
def monthly_archive(spark, d):
    path = f"{Q._stream_dir(spark)}/archive"
    logs.write_archive(Q._t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), path, "o_orderdate")
    return spark.read.parquet(path).groupBy(F.col("month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("keys"))
