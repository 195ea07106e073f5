"""The registered queries of the engine on the driver's tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedscope.functions import text as T
from feedscope.functions.score import Interests, QualityRules
from feedscope.operators import aggs, grounding, joins, shared, titles, windows
from feedscope.plans import funnel
from feedscope.sources import html
from feedscope.streaming import jobs

#: Word rules over the driver's invented prose; a user gives rules over their own vocabulary.
TOPICS = (("tion", "tion"), ("ing", "ing "), ("ment", "ment"), ("keit", "keit"), ("cion", "ción"), ("ble", "ble "), ("the", "the "))
PROFILE = funnel.Profile(
    topics=TOPICS,
    sections=(("security", "disgust|scum"), ("benchmark", "[0-9][0-9]"), ("release", "aux ")),
    exclude=(("symbols", "[*]{3}|%%%"), ("shouting", "!! ")),
    quality=QualityRules(mechanism="ation|heit|eaux", result="ing |ment |lich", number="[0-9]", verifiable="ble|schaft"),
    interests=Interests(strong=(("ions", ("tion the", "tion of")), ("ings", ("ing and", "ing in"))), medium=(("heits", ("heit der", "keit die")), ("ments", ("ment de", "ment la"))), low=("trash", "worthless")),
    section="research",
)
GATE = 65.0


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def items(spark: SparkSession, d: str) -> DataFrame:
    """Documents as feed items: the first sentence is the title, the whole text the summary."""
    n = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    page = F.col("doc_id") - F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)  # one in eleven shares its neighbour's page
    url = F.concat(F.when(page % 2 == 0, "https://x/").otherwise("http://x/"), page.cast("string"))
    return _t(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.regexp_extract("text", r"^[^.!?\n]*", 0).alias("title"), F.col("text").alias("summary"), url.alias("url"), "source", "lang",
        F.element_at(F.array(F.lit("primary"), F.lit("corroborating"), F.lit("community")), n % 3 + 1).alias("tier"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 40).cast("int")).alias("published"),
    )


_ITEMS = r"""items AS (SELECT doc_id AS id, regexp_extract(text, '^[^.!?\n]*') AS title, text AS summary, source, lang,
  (CASE WHEN (doc_id - CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END) % 2 = 0 THEN 'https://x/' ELSE 'http://x/' END) || (doc_id - CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END)::VARCHAR AS url,
  ['primary', 'corroborating', 'community'][regexp_extract(source, '([0-9]+)', 1)::INT % 3 + 1] AS tier, DATE '2024-01-01' + (doc_id % 40)::INT AS published FROM documents)"""


def seen_urls(spark: SparkSession, d: str) -> DataFrame:
    """Posts already published: one in eleven of the documents' neighbours."""
    return items(spark, d).where("id % 11 = 10").select("url")


def scored(spark: SparkSession, d: str, *wanted: str) -> DataFrame:
    """The items with the funnel's outputs, or those wanted."""
    return funnel.score_items(items(spark, d), seen_urls(spark, d), PROFILE, F.lit("2024-02-10").cast("date"), wanted=wanted)


def passed(spark: SparkSession, d: str, *wanted: str) -> DataFrame:
    """The items that pass the funnel."""
    return funnel.score_items(items(spark, d), seen_urls(spark, d), PROFILE, F.lit("2024-02-10").cast("date"), wanted=wanted, survivors=True)


def _topics_sql(alias: str) -> str:
    rows = " UNION ALL ".join(f"SELECT id, {k} AS k, '{t}' AS t, len(regexp_extract_all(txt, '{p}')) AS n FROM {alias}" for k, (t, p) in enumerate(TOPICS))
    return f"SELECT id, list(t ORDER BY n DESC, k)[1:3] AS topics FROM ({rows}) WHERE n > 0 GROUP BY id"


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_Q, _I = PROFILE.quality, PROFILE.interests
_SCORED = f"""{_ITEMS},
txt AS (SELECT *, title || chr(10) || summary AS txt FROM items),
tp AS ({_topics_sql("txt")}),
dup AS (SELECT DISTINCT url FROM items WHERE id % 11 = 10),
a AS (SELECT txt.*, coalesce(tp.topics, []) AS topics, dup.url IS NOT NULL AS dup,
  CASE WHEN regexp_matches(txt, 'disgust|scum') THEN 'security' WHEN regexp_matches(txt, '[0-9][0-9]') THEN 'benchmark' WHEN regexp_matches(txt, 'aux ') THEN 'release' ELSE 'research' END AS section,
  regexp_matches(txt, '[*][*][*]|%%%') OR regexp_matches(txt, '!! ') AS excluded, regexp_matches(txt, '{_Q.mechanism}') AS mech,
  {" + ".join(f"{_any('lower(txt)', s)}::INT" for _, s in _I.strong)} AS ns, {" + ".join(f"{_any('lower(txt)', s)}::INT" for _, s in _I.medium)} AS nm, {_any("lower(txt)", _I.low)} AS low
  FROM txt LEFT JOIN tp USING (id) LEFT JOIN dup ON txt.url = dup.url),
b AS (SELECT *, least(1000.0, (mech::INT * 500 + regexp_matches(txt, '{_Q.result}')::INT * 300 + regexp_matches(txt, '{_Q.number}')::INT * 300) * CASE WHEN length(summary) < 120 THEN 0.55 ELSE 1.0 END) AS sub,
  CASE tier WHEN 'primary' THEN 1000 WHEN 'corroborating' THEN 620 ELSE 450 END AS src, DATE '2024-02-10' - published AS age,
  least(1000, 350 + regexp_matches(txt, '{_Q.verifiable}')::INT * 400 + starts_with(url, 'https://')::INT * 150) AS ver FROM a),
c AS (SELECT *, floor((40 * floor(sub)::BIGINT + 25 * src + 20 * CASE WHEN age <= 2 THEN 1000 WHEN age <= 7 THEN 800 WHEN age <= 21 THEN 500 ELSE 200 END + 15 * ver + 50) / 100.0)::DOUBLE / 10 AS quality,
  floor((greatest(0, CASE WHEN ns > 0 THEN 45 * least(1000, 700 + 150 * (ns - 1)) ELSE 0 END + CASE WHEN ns = 0 AND nm > 0 THEN 20 * least(1000, 700 + 150 * (nm - 1)) ELSE 0 END
    + 15 * ((section = 'research')::INT * 500 + CASE WHEN len(topics) > 0 THEN 250 + 125 * least(2, len(topics) - 1) ELSE 0 END) + mech::INT * 10000 - low::INT * 25000) + 50) / 100.0)::DOUBLE / 10 AS relevance,
  CASE WHEN ns > 0 THEN 'strong' WHEN nm > 0 THEN 'adjacent' ELSE 'serendipity' END AS bucket FROM b),
scored AS (SELECT *, CASE WHEN dup THEN 'duplicate' WHEN excluded THEN 'excluded' WHEN len(topics) = 0 THEN 'no_topic' WHEN quality < {GATE} THEN 'below_gate' END AS reason FROM c)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


QUOTAS = {"en": 5, "fr": 3, "de": 3, "es": 3}
_QUOTA = "CASE lang " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in QUOTAS.items()) + " ELSE 0 END"
_ORD = "CASE lang " + " ".join(f"WHEN '{k}' THEN {n}" for n, k in enumerate(QUOTAS)) + f" ELSE {len(QUOTAS)} END"


@query(f"""WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY relevance DESC, id) > {_QUOTA} AS out FROM scored WHERE reason IS NULL)
SELECT id, lang, bucket, quality, relevance FROM r ORDER BY out, CASE WHEN out THEN 0 ELSE {_ORD} END, relevance DESC, id LIMIT 40""")
def ranked_funnel(spark, d):
    return funnel.ranked(passed(spark, d, "bucket", "quality", "relevance"), "lang", QUOTAS, 40).select("id", "lang", "bucket", "quality", "relevance")


@query(f"WITH {_SCORED} SELECT CASE reason WHEN 'excluded' THEN 'exclusion' ELSE 'quality' END AS class, reason, count(*) AS n FROM scored WHERE reason IS NOT NULL GROUP BY ALL")
def rejections_by_reason(spark, d):
    return funnel.rejections(scored(spark, d, "reason"))


@query(f"WITH {_SCORED} SELECT id, array_to_string(topics, ',') AS topics, section FROM scored")
def topic_labels(spark, d):
    return scored(spark, d, "topics", "section").select("id", F.array_join("topics", ",").alias("topics"), "section")


@query(f"WITH {_SCORED} SELECT id, quality, relevance, bucket FROM scored")
def item_scores(spark, d):
    return scored(spark, d, "quality", "relevance", "bucket").select("id", "quality", "relevance", "bucket")


@query(f"""WITH {_SCORED} SELECT count(*) AS n, count(*) FILTER (quality >= {GATE}) AS passed, min(quality) AS least, quantile_cont(quality, 0.25) AS p25, quantile_cont(quality, 0.5) AS median,
  quantile_cont(quality, 0.75) AS p75, quantile_cont(quality, 0.9) AS p90, max(quality) AS most FROM scored""")
def gate_statistics(spark, d):
    return aggs.gate_statistics(scored(spark, d, "quality"), GATE)


@query(f"WITH {_SCORED} SELECT bucket, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM scored WHERE reason IS NULL) AS share FROM scored WHERE reason IS NULL GROUP BY bucket")
def discovery_mix(spark, d):
    by = passed(spark, d, "bucket").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return by.select("bucket", "n", (F.col("n") / F.sum("n").over(windows.Window.partitionBy())).alias("share"))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(f"""WITH {_ITEMS}, k AS (SELECT id, published, unnest(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+'))) AS t FROM items),
k2 AS (SELECT * FROM k WHERE (length(t) > 1 OR regexp_matches(t, '[0-9]')) AND t NOT IN ({_STOP})), n AS (SELECT id, count(*) AS n FROM k2 GROUP BY id),
p AS (SELECT a.id, b.id AS post_id, count(*) AS shared FROM k2 a JOIN k2 b ON a.t = b.t WHERE a.id <> b.id AND b.published <= a.published AND a.published - b.published <= 7 GROUP BY a.id, b.id HAVING count(*) >= 2)
SELECT p.id, post_id, shared, shared::DOUBLE / least(x.n, y.n) AS containment FROM p JOIN n x ON p.id = x.id JOIN n y ON p.post_id = y.id
WHERE shared >= 3 AND shared::DOUBLE / least(x.n, y.n) >= 0.4 OR shared::DOUBLE / least(x.n, y.n) >= 0.5""")
def title_near_duplicates(spark, d):
    x = items(spark, d)
    return titles.near_titles(x, x)


@query(f"WITH {_ITEMS} SELECT id, source FROM items WHERE id % 2 = 1")
def novel_items(spark, d):
    x = items(spark, d)
    return joins.unseen(x, x.where("id % 2 = 0")).select("id", "source")


_BUCKETS = {"a": (1.0, ("tion", "ing", "thre")), "b": (0.75, ("keit", "heit", "lich")), "c": (1.0, ("eau", "ment"))}


def _hits(words) -> str:
    return "(" + " + ".join(f"contains(low, '{w}')::INT" for w in words) + ")"


@query(f"""WITH {_ITEMS}, l AS (SELECT *, lower(title) AS low FROM items),
s AS (SELECT id, low, {", ".join(f"{_hits(ws)} * {w}::DOUBLE AS s{b}" for b, (w, ws) in _BUCKETS.items())}, CASE WHEN contains(low, 'trash') THEN 0.5 ELSE 1.0 END::DOUBLE AS pen FROM l),
m AS (SELECT *, greatest(sa, sb, sc) AS s FROM s), b AS (SELECT id, CASE WHEN s <= 0 OR contains(low, '***') THEN 0 ELSE s * pen END::DOUBLE AS score, CASE WHEN s <= 0 OR contains(low, '***') THEN NULL WHEN sa = s THEN 'a' WHEN sb = s THEN 'b' ELSE 'c' END AS bucket FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, id) > CASE bucket WHEN 'a' THEN 2 WHEN 'b' THEN 3 WHEN 'c' THEN 4 ELSE 0 END AS out FROM b)
SELECT id, score, bucket FROM r ORDER BY out, CASE WHEN out THEN 0 ELSE CASE bucket WHEN 'a' THEN 0 WHEN 'b' THEN 1 ELSE 2 END END, score DESC, id LIMIT 30""")
def bucket_quota_topk(spark, d):
    s = T.keyword_score(F.col("title"), _BUCKETS, (0.5, ("trash",)), ("***",))
    x = items(spark, d).select("id", s.alias("s")).select("id", "s.score", "s.bucket")
    return windows.quota_top(x, "bucket", {"a": 2, "b": 3, "c": 4}, "score", "id", 30)


@query(f"""WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY quality DESC, id) AS k FROM scored WHERE quality >= 55)
SELECT id, source, quality FROM r WHERE k <= 3 ORDER BY quality DESC, id LIMIT 20""")
def per_source_cap(spark, d):
    return windows.capped_by(scored(spark, d, "quality"), "source", 3, "quality", "id", 20, 55.0).select("id", "source", "quality")


def _names(spark, d):
    n = _t(spark, d, "customer").join(F.broadcast(_t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 4
    return n.select("c_custkey", F.when(k == 0, F.lower("n_name")).when(k == 1, F.concat(F.lit("The "), "n_name")).when(k == 2, F.concat(F.lit(" "), F.upper("n_name"), F.lit("."))).otherwise(F.col("n_name")).alias("name"))


_NAMES = """n AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN 'The ' || n_name WHEN 2 THEN ' ' || upper(n_name) || '.' ELSE n_name END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
reg AS (SELECT n_nationkey AS ord, 'nation-' || n_nationkey::VARCHAR AS id, n_name AS alias, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS s FROM nation),
res AS (SELECT n.*, (SELECT arg_min(id, ord) FROM reg WHERE reg.alias = n.name OR reg.s = regexp_replace(lower(n.name), '[^a-z0-9]', '', 'g')) AS model FROM n)"""


def _registry(spark, d):
    return _t(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("id"), F.array("n_name").alias("aliases"))


@query(f"WITH {_NAMES} SELECT c_custkey, name, model FROM res WHERE model IS NOT NULL")
def resolved_names(spark, d):
    return joins.resolve_names(_names(spark, d), _registry(spark, d)).where("model IS NOT NULL")


@query(f"WITH {_NAMES} SELECT name, min(c_custkey) AS first_seen, count(*) AS n FROM res WHERE model IS NULL GROUP BY name")
def unresolved_names(spark, d):
    return joins.resolve_names(_names(spark, d), _registry(spark, d)).where("model IS NULL").groupBy("name").agg(F.min("c_custkey").alias("first_seen"), F.count(F.lit(1)).alias("n"))


def measurements(spark, d):
    return _t(spark, d, "lineitem").join(_t(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.col("p_brand").alias("benchmark"), F.col("l_suppkey").alias("model"),
        F.col("l_returnflag").alias("conditions"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("value"), F.col("l_shipdate").cast("date").alias("measured_at"),
        F.when(F.col("l_linestatus") == "F", "vendor").otherwise("thirdparty").alias("measured_by"), F.col("l_orderkey").alias("seq"),
    )


_MEAS = """m AS (SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS id, p_brand AS benchmark, l_suppkey AS model, l_returnflag AS conditions, l_extendedprice / l_quantity AS value,
  l_shipdate::DATE AS measured_at, CASE WHEN l_linestatus = 'F' THEN 'vendor' ELSE 'thirdparty' END AS measured_by, l_orderkey AS seq FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query(f"WITH {_MEAS} SELECT benchmark, model, conditions, id, value, measured_at FROM m QUALIFY row_number() OVER (PARTITION BY benchmark, model, conditions ORDER BY measured_at DESC, id DESC) = 1")
def measurement_current(spark, d):
    return windows.current(measurements(spark, d), ["benchmark", "model", "conditions"]).select("benchmark", "model", "conditions", "id", "value", "measured_at")


@query()
def measurement_upsert(spark, d):
    m = measurements(spark, d)
    return windows.upsert(m.where("seq % 4 = 0"), m.where("seq % 4 <> 0"), ["benchmark", "model", "conditions"])


@query(f"WITH {_MEAS}, b AS (SELECT benchmark, model, max(value) AS value FROM m WHERE measured_by <> 'vendor' GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY value DESC, model) AS rank FROM b QUALIFY rank <= 5")
def leaderboard_top5(spark, d):
    return windows.leaderboard(measurements(spark, d).where("measured_by <> 'vendor'"), 5)


@query(f"WITH {_MEAS} SELECT benchmark, id, model, value, count(*) OVER (PARTITION BY benchmark) AS total, row_number() OVER (PARTITION BY benchmark ORDER BY value DESC, measured_at DESC, id) AS rank FROM m QUALIFY rank <= 25")
def tracker_table(spark, d):
    m = measurements(spark, d)
    total = m.groupBy("benchmark").agg(F.count(F.lit(1)).alias("total"))
    return windows.top(m, ["benchmark"], [F.desc("value"), F.desc("measured_at"), "id"], 25).join(total, "benchmark").select("benchmark", "id", "model", "value", "total", "rank")


@query(f"""WITH {_MEAS}, u AS (SELECT *, CASE WHEN conditions = 'N' THEN 'percent' ELSE 'elo' END AS unit, seq % 4 <> 0 AS is_new FROM m), c AS (SELECT benchmark, model, arg_max(struct_pack(id := id, value := value, unit := unit, is_new := is_new), (measured_at, id)) AS c FROM u WHERE measured_by = 'vendor' GROUP BY ALL),
o AS (SELECT benchmark, model, unit, min(value) AS low, max(value) AS high, count(*) AS n, arg_min(id, (value, id)) AS low_id, arg_max(id, (value, id)) AS high_id, bool_or(is_new) AS is_new FROM u WHERE measured_by <> 'vendor' GROUP BY ALL),
j AS (SELECT benchmark, model, unit, c.id AS claim_id, c.value AS claim, low, high, n, greatest(low - c.value, c.value - high) AS gap, [c.id, CASE WHEN c.value > high THEN high_id ELSE low_id END, low_id, high_id] AS r, c.is_new OR o.is_new AS is_new FROM c JOIN o USING (benchmark, model) WHERE o.unit = c.unit)
SELECT benchmark, model, unit, claim_id, claim, low, high, n, gap, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), ',') AS refs FROM j WHERE gap >= 5 AND is_new""")
def claim_outside_range(spark, d):
    m = measurements(spark, d).withColumn("unit", F.when(F.col("conditions") == "N", "percent").otherwise("elo")).withColumn("is_new", F.col("seq") % 4 != 0)
    return joins.claims_outside(m).withColumn("refs", F.array_join("refs", ","))


@query(f"WITH {_MEAS} SELECT model, id, measured_at FROM m WHERE model IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) QUALIFY row_number() OVER (PARTITION BY model ORDER BY measured_at, id) = 1")
def first_measurements(spark, d):
    tier_one = _t(spark, d, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("model"))
    return windows.first_of(measurements(spark, d).join(tier_one, "model", "left_semi"), ["model"], ["measured_at", "id"]).select("model", "id", "measured_at")


@query(f"WITH {_MEAS} SELECT benchmark, measured_by, count(*) AS n FROM m GROUP BY ROLLUP (benchmark, measured_by)")
def collection_composition(spark, d):
    return measurements(spark, d).rollup("benchmark", "measured_by").agg(F.count(F.lit(1)).alias("n"))


_KINDS = {"signup": "interesting", "error": "not_useful", "click": "not_my_topic", "view": "deep_dive", "purchase": "retract"}


def feedback(spark, d):
    kind = F.lit(None).cast("string")
    for a, b in _KINDS.items():
        kind = F.when(F.col("event_type") == a, b).otherwise(kind)
    k = F.get_json_object("props", "$.k").cast("long")
    return _t(spark, d, "events").select("event_id", F.col("ts").alias("at"), F.col("user_id").alias("item"), kind.alias("kind"), (k % 13).alias("topic"), (F.floor("value").cast("long") % 5 + 1).alias("rating"))


_FEED = "f AS (SELECT event_id, ts, user_id AS item, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _KINDS.items()) + " END AS kind, (props->>'$.k')::BIGINT % 13 AS topic, floor(value)::BIGINT % 5 + 1 AS rating FROM events)"
_NET = "sum(CASE kind WHEN 'not_my_topic' THEN -3 WHEN 'deep_dive' THEN 3 ELSE 0 END)::BIGINT"


@query(f"WITH {_FEED} SELECT topic, count(*) AS observations, {_NET} AS net FROM f GROUP BY topic")
def topic_feedback_signal(spark, d):
    return aggs.topic_signal(feedback(spark, d))


@query(f"WITH {_FEED} SELECT item, sum(CASE kind WHEN 'interesting' THEN 1 WHEN 'not_useful' THEN -1 WHEN 'not_my_topic' THEN -3 WHEN 'deep_dive' THEN 3 WHEN 'retract' THEN -3 ELSE 0 END)::BIGINT AS signal, count(*) AS n FROM f GROUP BY item")
def item_signal(spark, d):
    return aggs.item_signal(feedback(spark, d))


@query(f"""WITH {_FEED}, s AS (SELECT topic, count(*) AS observations, {_NET} AS net FROM f GROUP BY topic), w AS (SELECT *, observations >= 10 AND net <= -8 AS wants, sum((observations >= 10 AND net <= -8)::INT) OVER (ORDER BY topic) AS run FROM s)
SELECT topic, observations, net, CASE WHEN observations < 10 THEN 'withheld' WHEN net >= 8 THEN 'promote' WHEN wants AND run <= 2 THEN 'demote' WHEN wants THEN 'floor' ELSE 'dead_band' END AS decision FROM w""")
def profile_proposals(spark, d):
    return aggs.proposals(aggs.topic_signal(feedback(spark, d)), n_strong=7)


@query(f"WITH {_FEED} SELECT CASE WHEN topic > 9 THEN 'unmatched' ELSE 'b' || (topic % 3)::VARCHAR END AS bucket, count(*) AS n, sum(rating)::BIGINT AS total, sum(rating)::DOUBLE / count(*) AS average FROM f GROUP BY ALL")
def rating_report(spark, d):
    bucket = F.when(F.col("topic") <= 9, F.concat(F.lit("b"), (F.col("topic") % 3).cast("string")))
    return aggs.rating_report(feedback(spark, d).withColumn("bucket", bucket))


_CAPS = {"interesting": 100, "not_useful": 5000, "not_my_topic": 800, "deep_dive": 400, "retract": 0}


@query(f"""WITH {_FEED}, a AS (SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS used_all, count(*) FILTER (ts >= TIMESTAMP '2024-01-30') AS used_day FROM f),
s AS (SELECT kind AS section, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS used FROM f GROUP BY kind)
SELECT section, used, used_all, used_day, greatest(0, least(CASE section {" ".join(f"WHEN '{k}' THEN {n}" for k, n in _CAPS.items())} END - used, 100000 - used_all, 20000 - used_day)) AS remaining FROM s, a""")
def rolling_budget(spark, d):
    log = feedback(spark, d).withColumnRenamed("kind", "section")
    return aggs.rolling(log, F.lit("2024-01-31").cast("timestamp"), _CAPS, 100_000, 20_000)


@query("""WITH p AS (SELECT ts::DATE AS day, event_type AS model, count(*) AS calls, sum(floor(value)::BIGINT) AS units FROM events GROUP BY ALL)
SELECT day, model, calls, sum(units) OVER (PARTITION BY model ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)::BIGINT AS week, sum(units) OVER (PARTITION BY model ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)::BIGINT AS month FROM p""")
def spend_windows(spark, d):
    day = F.to_date("ts")
    by = _t(spark, d, "events").groupBy(day.alias("day"), F.col("event_type").alias("model")).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.floor("value").cast("long")).alias("units"))
    at = F.unix_date("day")
    w = windows.Window.partitionBy("model").orderBy(at)
    return by.select("day", "model", "calls", F.sum("units").over(w.rangeBetween(-6, 0)).alias("week"), F.sum("units").over(w.rangeBetween(-29, 0)).alias("month"))


@query(f"""WITH {_FEED}, l AS (SELECT kind AS channel, item % 50 AS key, arg_max(rating, (ts, event_id)) AS score, max(ts) AS ts, count(*) AS puts FROM f GROUP BY ALL)
SELECT channel, key, score, puts, row_number() OVER (PARTITION BY channel ORDER BY score DESC, key) AS rank FROM l WHERE ts >= TIMESTAMP '2024-01-24' QUALIFY rank <= 3""")
def queue_state(spark, d):
    e = feedback(spark, d).select(F.col("kind").alias("channel"), (F.col("item") % 50).alias("key"), F.col("rating").alias("score"), "at", F.col("event_id").alias("seq"))
    return windows.queue_state(e, F.lit("2024-01-31").cast("timestamp"))


@query("""SELECT conv_id AS thread, conv_id::VARCHAR || '/' || turn::VARCHAR AS id, row_number() OVER w AS index, count(*) OVER (PARTITION BY conv_id) AS total, lag(conv_id::VARCHAR || '/' || turn::VARCHAR) OVER w AS prev,
  lead(conv_id::VARCHAR || '/' || turn::VARCHAR) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, conv_id::VARCHAR || '/' || turn::VARCHAR)""")
def thread_positions(spark, d):
    c = _t(spark, d, "conversations")
    return windows.positions(c.select(F.col("conv_id").alias("thread"), F.col("turn").alias("ord"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id")))


@query(f"WITH {_SCORED}, t AS (SELECT id, unnest(topics) AS t FROM scored) SELECT x.t AS a, y.t AS b, count(*) AS n FROM t x JOIN t y ON x.id = y.id AND x.t < y.t GROUP BY ALL")
def topic_cooccurrence(spark, d):
    return aggs.cooccurrence(scored(spark, d, "topics"))


@query(f"""WITH {_SCORED}, v AS (SELECT unnest([{", ".join(f"'{t}'" for t, _ in TOPICS)}, 'none']) AS topic), t AS (SELECT id, published, unnest(topics) AS topic FROM scored)
SELECT topic, count(id) AS n, arg_max(id, (published, id)) AS newest FROM v LEFT JOIN t USING (topic) GROUP BY topic""")
def topic_counts(spark, d):
    vocab = spark.createDataFrame([(t,) for t, _ in TOPICS] + [("none",)], "topic string")
    return aggs.topic_counts(scored(spark, d, "topics"), vocab)


@query("SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 10 <> 0)")
def dangling_references(spark, d):
    return joins.dangling(_t(spark, d, "labels"), _t(spark, d, "documents").where("doc_id % 10 <> 0"), "doc_id").select("doc_id", "quality")


@query()
def numeric_grounding(spark, d):
    """Numbers of each document's second half that don't stand in its first half."""
    x = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.expr("cast(length(text) / 2 as int)").alias("h"))
    return grounding.numeric_grounding(x.select("id", F.expr("substring(text, h + 1)").alias("body")), x.select("id", F.expr("substring(text, 1, h)").alias("text")))


@query("""WITH c AS (SELECT o_orderkey, o_totalprice <= 0 AS r1, c_acctbal < 0 AND o_orderstatus = 'O' AS r2, o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderpriority = '1-URGENT' AS r3, c_custkey IS NULL AS r4 FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
SELECT * FROM (SELECT 'price' AS rule, 'error' AS severity, o_orderkey AS id FROM c WHERE r1 UNION ALL SELECT 'balance', 'warning', o_orderkey FROM c WHERE r2 UNION ALL SELECT 'late_urgent', 'warning', o_orderkey FROM c WHERE r3 UNION ALL SELECT 'customer', 'error', o_orderkey FROM c WHERE r4)""")
def constraint_violations(spark, d):
    o = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    rules = (("price", "error", "o_totalprice <= 0"), ("balance", "warning", "c_acctbal < 0 AND o_orderstatus = 'O'"), ("late_urgent", "warning", "o_orderdate >= timestamp '1998-01-01' AND o_orderpriority = '1-URGENT'"), ("customer", "error", "c_custkey IS NULL"))
    broken = F.array_compact(F.array(*[F.when(F.expr(e), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, s, e in rules]))
    return o.select(F.inline(broken), F.col("o_orderkey").alias("id"))


@query()
def page_items(spark, d):
    return html.page_items(_t(spark, d, "pages"))


@query()
def page_text(spark, d):
    return html.page_text(_t(spark, d, "pages"))


@query(f"""WITH {_ITEMS}, r AS (SELECT 'src' || s_suppkey::VARCHAR AS source, ['feed', 'page', 'probe', 'other'][s_nationkey % 4 + 1] AS kind, s_acctbal > 0 AS verified FROM supplier),
e AS (SELECT source, CASE WHEN id % 6 > 0 THEN published END AS published FROM items), n AS (SELECT source, count(*) AS n, max(published) AS newest, count(published) AS dated FROM e GROUP BY source),
j AS (SELECT r.*, coalesce(n, 0) AS n, newest, coalesce(dated, 0) AS dated FROM r LEFT JOIN n USING (source)), s AS (SELECT *, CASE WHEN kind = 'probe' THEN 'PROBE' WHEN kind NOT IN ('feed', 'page') THEN 'SKIP' WHEN n > 0 THEN 'OK' ELSE 'FAIL' END AS status FROM j)
SELECT source, status, n, newest, dated, verified AND status = 'FAIL' AS regression FROM s""")
def source_health(spark, d):
    kinds = F.array(*map(F.lit, ("feed", "page", "probe", "other")))
    registry = _t(spark, d, "supplier").select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("source"), F.get(kinds, F.col("s_nationkey") % 4).alias("kind"), (F.col("s_acctbal") > 0).alias("verified"))
    return aggs.source_health(registry, items(spark, d).select("source", F.when(F.col("id") % 6 > 0, F.col("published")).alias("published")))


@query(f"""WITH RECURSIVE {_ITEMS}, b AS (SELECT id, CASE WHEN s = '' THEN 'post' ELSE s END AS base FROM (SELECT id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM items)),
o AS (SELECT id, base, row_number() OVER (ORDER BY id) AS k FROM b), r AS (SELECT 0::BIGINT AS k, ''::VARCHAR AS slug, []::VARCHAR[] AS taken
UNION ALL SELECT k, slug, list_append(taken, slug) FROM (SELECT o.k, r.taken, CASE WHEN NOT list_contains(r.taken, o.base) THEN o.base ELSE o.base || '-' || list_filter(range(2, o.k + 2), lambda n: NOT list_contains(r.taken, o.base || '-' || n::VARCHAR))[1]::VARCHAR END AS slug FROM r JOIN o ON o.k = r.k + 1))
SELECT id, base, slug FROM o JOIN r USING (k)""")
def unique_slugs(spark, d):
    return windows.unique_slugs(items(spark, d).select("id", T.slug("title").alias("base")), "base", "id").select("id", "base", "slug")


@query("""WITH p AS (SELECT s_suppkey, s_nationkey FROM supplier), x AS (SELECT coalesce(n_nationkey, s_nationkey) AS id, coalesce(n_name, 'seeded') AS vendor, n_nationkey IS NULL AS only_seed, s_suppkey FROM (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) FULL JOIN p ON n_nationkey = s_nationkey)
SELECT id::BIGINT AS id, vendor, array_to_string(list_sort(list_distinct(list_concat(coalesce(list(vendor) FILTER (NOT only_seed), []), coalesce(list(s_suppkey::VARCHAR) FILTER (s_suppkey IS NOT NULL), [])))), ',') AS aliases FROM x GROUP BY id, vendor""")
def registry_merge(spark, d):
    mine = _t(spark, d, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("vendor"), F.array("n_name").alias("aliases"))
    seed = _t(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("id")).agg(F.lit("seeded").alias("vendor"), F.collect_set(F.col("s_suppkey").cast("string")).alias("aliases"))
    return joins.merge_registries(mine, seed).select("id", "vendor", F.array_join("aliases", ",").alias("aliases"))


@query(f"WITH {_ITEMS} SELECT id, greatest(1, floor((len(list_filter(string_split_regex(summary, '[ \\t\\n]+'), lambda w: w <> '')) + 100) / 200.0))::BIGINT AS minutes FROM items")
def reading_minutes(spark, d):
    return items(spark, d).select("id", T.reading_minutes(F.col("summary")).alias("minutes"))


@query(f"WITH {_SCORED} SELECT id, floor((row_number() OVER (PARTITION BY source ORDER BY relevance DESC, id) - 1) / 20)::BIGINT AS batch, source FROM scored WHERE reason IS NULL QUALIFY batch < 2")
def batch_assignment(spark, d):
    x = windows.top(passed(spark, d, "relevance"), ["source"], [F.desc("relevance"), "id"], 40)
    return x.select("id", F.floor((F.col("rank") - 1) / 20).cast("long").alias("batch"), "source")


@query(f"WITH {_ITEMS} SELECT url, id, source FROM items QUALIFY row_number() OVER (PARTITION BY url ORDER BY published, id) = 1")
def first_occurrence(spark, d):
    return windows.first_of(items(spark, d), ["url"], ["published", "id"]).select("url", "id", "source")


@query(f"WITH {_FEED}, r AS (SELECT f.*, i.source FROM f LEFT JOIN (SELECT doc_id, source FROM documents WHERE doc_id % 3 <> 0) i ON f.item = i.doc_id) SELECT coalesce(source, 'missing') AS source, kind, count(*) AS n FROM r GROUP BY ALL")
def feedback_enriched(spark, d):
    i = _t(spark, d, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("item"), "source")
    return feedback(spark, d).join(i, "item", "left").groupBy(F.coalesce("source", F.lit("missing")).alias("source"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_SCORED}, t AS (SELECT id, section, published, unnest(topics) AS t FROM scored WHERE reason IS NULL), p AS (SELECT x.id, y.id AS other, y.published AS p2, min(CASE WHEN x.section <> y.section THEN 1 ELSE 2 END) AS priority FROM t x JOIN t y ON x.t = y.t AND x.id <> y.id GROUP BY ALL)
SELECT id, other, priority, row_number() OVER (PARTITION BY id ORDER BY priority, p2 DESC, other) AS rank FROM p QUALIFY rank <= 3""")
def related_items(spark, d):
    # read from both sides of the join: the narrow rows are written once, the texts scored once
    return joins.related(shared.written(passed(spark, d, "section", "topics").select("id", F.col("section").alias("kind"), "topics", "published")))


def _stream_dir(spark: SparkSession) -> str:
    return f"{shared.folder(spark)}/stream-{uuid.uuid4().hex}"


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    return spark.readStream.schema(_t(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query(f"WITH {_FEED} SELECT item, min(event_id) > 0 OR min(event_id) = 0 AS seen FROM f GROUP BY item")
def stream_novel_items(spark, d):
    s = _event_stream(spark, d).select(F.col("user_id").alias("item"), F.col("ts").cast("timestamp").alias("at"))
    return jobs.run_once(jobs.novel(s, "item", "60 days"), "novel", _stream_dir(spark)).select("item", F.lit(True).alias("seen"))


@query("SELECT w AS start, event_type AS kind, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts) - INTERVAL (k) DAY FOR k IN range(7)]) AS w FROM events) GROUP BY ALL")
def stream_window_counts(spark, d):
    s = _event_stream(spark, d).select(F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("at"))
    return jobs.run_once(jobs.windowed_counts(s), f"counts_{uuid.uuid4().hex[:8]}", _stream_dir(spark), "complete")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
