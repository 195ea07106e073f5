"""Further registered queries: rejects, classification, relevance as it is used, checks, cursors, reports, listings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedscope import queries as Q
from feedscope.functions import release, rules
from feedscope.functions import text as T
from feedscope.operators import aggs, archive, grounding, joins, windows
from feedscope.plans import funnel, profile
from feedscope.sources import adapters, logs
from feedscope.streaming import jobs

_DAY = "2024-02-10"
_VOCAB = ("tion", "ing", "ment", "the")


@Q.query(f"""WITH {Q._ITEMS} SELECT id, CASE WHEN source IN ('src3', 'src4') THEN 'roundup_only_source' WHEN source IN ('src5', 'src6', 'src7') AND (regexp_matches(title, '^[ ]*v?[0-9]+([.][0-9]+)+[A-Za-z0-9_.-]*[ ]*$') OR NOT regexp_matches(title || chr(10) || summary, 'tion |keit ')) THEN 'no_product_angle' END AS reason FROM items""")
def source_rejects(spark, d):
    tools = rules.no_product_angle(F.col("source"), F.col("title"), F.concat("title", F.lit("\n"), "summary"), ("src5", "src6", "src7"), "tion |keit ")
    return Q.items(spark, d).select("id", F.coalesce(rules.roundup_only(F.col("source"), ("src3", "src4")), tools).alias("reason"))


@Q.query(f"""WITH {Q._SCORED}, f AS (SELECT *, CASE WHEN source = 'src2' OR regexp_matches(title || chr(10) || summary, 'eaux') THEN 'paper' WHEN section = 'benchmark' THEN 'benchmark' ELSE 'news' END AS format FROM scored)
SELECT id, format, CASE WHEN section IN ('research', 'benchmark', 'security') THEN section ELSE 'research' END AS filed, CASE WHEN format IN ('news', 'benchmark') THEN format ELSE 'news' END AS shown, array_to_string(list_filter(topics, lambda t: t IN ('tion', 'ing', 'ment', 'the'))[1:2], ',') AS kept FROM f""")
def filings(spark, d):
    x = Q.scored(spark, d, "topics", "section")
    x = x.withColumn("format", rules.format_of(F.col("source"), F.concat("title", F.lit("\n"), "summary"), F.col("section"), "^src2$", "eaux"))
    section = rules.coerced_section(F.col("section"), ("research", "benchmark", "security", "release"), ("release",))
    shown = rules.coerced_format(F.col("format"), F.col("section"), ("news", "benchmark"))
    return x.select("id", "format", section.alias("filed"), shown.alias("shown"), F.array_join(T.known_only(F.col("topics"), _VOCAB, 2), ",").alias("kept"))


#: An archive that ends a fortnight before the newest items, so that topics have starved meanwhile.
_LAST = f"last AS (SELECT t AS topic, max(published) - 14 AS last FROM (SELECT published, unnest(topics) AS t FROM scored WHERE tier = 'primary') GROUP BY t)"
_WORDS = {"tion": "tion the", "keit": "heit der"}


@Q.query(f"""WITH {Q._SCORED}, {_LAST},
e AS (SELECT c.*, lower(title || chr(10) || summary || ' ' || array_to_string(list_transform(topics, lambda t: CASE t {" ".join(f"WHEN '{k}' THEN '{w}'" for k, w in _WORDS.items())} ELSE '' END), ' ')) AS low2,
  coalesce((SELECT max(CASE WHEN l.last IS NULL THEN 10.0 ELSE least(10.0, greatest(0.0, (DATE '{_DAY}' - l.last - 10) * 1.0)) END) FROM (SELECT unnest(c.topics) AS t) u LEFT JOIN last l ON l.topic = u.t), 0.0) AS bonus FROM c),
h AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {Q._any('low2', s)} THEN '{n}' END" for n, s in Q._I.strong)}], lambda x: x IS NOT NULL) AS s1, list_filter([{", ".join(f"CASE WHEN {Q._any('low2', s)} THEN '{n}' END" for n, s in Q._I.medium)}], lambda x: x IS NOT NULL) AS m1, {Q._any("low2", Q._I.low)} AS low1 FROM e)
SELECT id, floor((greatest(0, CASE WHEN len(s1) > 0 THEN 45 * least(1000, 700 + 150 * (len(s1) - 1)) ELSE 0 END + CASE WHEN len(s1) = 0 AND len(m1) > 0 THEN 20 * least(1000, 700 + 150 * (len(m1) - 1)) ELSE 0 END
  + 15 * ((section = 'research')::INT * 500 + CASE WHEN len(topics) > 0 THEN 250 + 125 * least(2, len(topics) - 1) ELSE 0 END) + mech::INT * 10000 + 1000 * bonus - low1::INT * 25000) + 50) / 100.0)::DOUBLE / 10 AS relevance,
  substr(CASE WHEN len(s1) > 0 THEN 'Strong interest: ' || array_to_string(s1, ', ') WHEN len(m1) > 0 THEN 'Near an interest: ' || array_to_string(m1, ', ') ELSE 'No interest matched' END || '. Filed under ' || section || ': ' || CASE WHEN len(topics) > 0 THEN array_to_string(topics, ', ') ELSE 'no topic' END || '.', 1, 200) AS why,
  CASE WHEN dup THEN 'duplicate' WHEN excluded THEN 'excluded' WHEN source = 'src9' THEN 'paused_source' WHEN len(topics) = 0 THEN 'no_topic' WHEN quality < {Q.GATE} THEN 'below_gate' END AS reason FROM h""")
def starved_relevance(spark, d):
    """The funnel with the topics' own words, the starvation bonus and a caller's reject."""
    x = Q.scored(spark, d, "topics").where("tier = 'primary'")
    activity = x.select(F.explode("topics").alias("topic"), "published").groupBy("topic").agg(F.date_sub(F.max("published"), 14).alias("last"))
    rich = funnel.Profile(**{**Q.PROFILE.__dict__, "vocabulary": _WORDS})
    out = funnel.score_items(Q.items(spark, d), Q.seen_urls(spark, d), rich, F.lit(_DAY).cast("date"), F.when(F.col("source") == "src9", "paused_source"), activity)
    return out.select("id", "relevance", "why", "reason")


@Q.query(f"""WITH {Q._ITEMS}, s AS (SELECT id, contains(lower(title), 'tion')::INT + contains(lower(title), 'ing')::INT AS a, contains(lower(title), 'keit')::INT AS b FROM items)
SELECT id, CASE WHEN a > 0 OR b > 0 THEN greatest(a * 1.0, b * 0.75) ELSE 0 END::DOUBLE AS score, CASE WHEN a = 0 AND b = 0 THEN NULL WHEN a >= b * 0.75 THEN 'a' ELSE 'b' END AS bucket, least(90.0, 40 + 8 * CASE WHEN a > 0 OR b > 0 THEN greatest(a * 1.0, b * 0.75) ELSE 0 END)::DOUBLE AS triage FROM s""")
def triage_scores(spark, d):
    reading = profile.parse('{"buckets": {"a": {"weight": 1.0, "keywords": ["tion", "ING"]}, "b": {"weight": 0.75, "keywords": ["keit"]}}}')
    x = Q.items(spark, d).select("id", profile.reading_score(F.col("title"), reading).alias("s")).select("id", "s.*")
    return x.select("id", "score", "bucket", rules.triage_score(F.col("score")).alias("triage"))


@Q.query(f"""WITH {Q._ITEMS} SELECT id, array_to_string(list_filter([CASE WHEN id % 3 = 0 OR contains(summary, 'tion the') THEN 'ga_date' END, CASE WHEN contains(summary, '$') THEN 'pricing' END, CASE WHEN id % 2 = 0 THEN 'open_weights' END,
  CASE WHEN contains(summary, 'ment') AND regexp_matches(summary, '[0-9]+([.][0-9]+)?[ \\t\\n]?%|\\b[0-9]+[.][0-9]+\\b|(?i:\\bELO\\b)') THEN 'benchmark_claim' END, CASE WHEN id % 3 = 1 THEN 'deprecation' END], lambda x: x IS NOT NULL), ',') AS facts FROM items""")
def material_facts(spark, d):
    n, body = F.col("id"), F.col("summary")
    event = F.when(n % 3 == 0, "availability").when(n % 3 == 1, "deprecation").otherwise("none")
    facts = rules.material_facts(event, body, n % 2 == 0, "tion the", "[$]", release.claims_a_score(body, "ment"))
    return Q.items(spark, d).select("id", F.array_join(facts, ",").alias("facts"))


@Q.query("""SELECT l_orderkey * 10 + l_linenumber AS id, concat_ws('; ', CASE WHEN l_linenumber % 2 = 0 THEN 'variant ' || l_linenumber::VARCHAR END, 'agent: ' || l_returnflag, CASE WHEN l_discount * 1000 % 20 < 10 THEN 'stderr 0.0' || (l_linenumber + 10)::VARCHAR END, CASE WHEN l_linestatus = 'F' THEN 'own run' END) AS notes FROM lineitem""")
def conditions_notes(spark, d):
    k = F.col("l_linenumber")
    error = F.when(F.col("l_discount") * 1000 % 20 < 10, F.concat(F.lit("0.0"), (k + 10).cast("string"), F.lit("0004")))
    note = rules.conditions_note(F.when(k % 2 == 0, F.concat(F.lit("variant "), k.cast("string"))), [("agent", F.col("l_returnflag")), ("note", F.lit(" "))], [F.lit("none"), error], F.when(F.col("l_linestatus") == "F", "own run"), F.lit("not published"))
    return Q._t(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + k).alias("id"), note.alias("notes"))


@Q.query("""SELECT p_partkey AS id, regexp_replace(lower(split_part(p_type, ' ', 1)), '[^a-z0-9]+', '-', 'g') || '-model' AS family, CASE p_partkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'known' ELSE 'maker-' || (p_partkey % 7)::VARCHAR END AS vendor, p_size > 25 AS open FROM part""")
def registry_slugs(spark, d):
    k = F.col("p_partkey")
    group = F.concat(F.split_part("p_type", F.lit(" "), F.lit(1)), F.lit("-V"), (k % 9).cast("string"), F.lit(".2 Model "), (k % 5).cast("string"))
    maker = F.when(k % 4 == 0, " ").when(k % 4 == 1, "Known Maker, Other").otherwise(F.concat(F.lit("Maker "), (k % 7).cast("string"), F.lit(",x")))
    open_ = rules.weights_open(F.when(F.col("p_size") > 25, "Open weights (restricted)").when(k % 2 == 0, "API access"))
    return Q._t(spark, d, "part").select(k.alias("id"), rules.family_slug(group).alias("family"), rules.vendor_slug(maker, {"known maker": "known"}).alias("vendor"), open_.alias("open"))


@Q.query("""SELECT doc_id AS id, 'r' || substr(sha256(lower(trim(CASE WHEN doc_id % 3 = 0 THEN 'T ' || doc_id::VARCHAR ELSE 'HTTP://X/' || doc_id::VARCHAR END))), 1, 15) AS archive_id, substr(sha256(text), 1, 16) AS text_id FROM documents""")
def stable_ids(spark, d):
    n = F.col("doc_id").cast("string")
    url = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit(" HTTP://X/"), n)).otherwise(" ")
    return Q._t(spark, d, "documents").select(F.col("doc_id").alias("id"), T.archive_id(url, F.concat(F.lit("T "), n)).alias("archive_id"), T.stable_id(F.col("text")).alias("text_id"))


@Q.query("""SELECT event_id AS id, epoch_ms(date_trunc('second', ts))::BIGINT // 1000 AS at FROM events WHERE event_id % 4 < 3 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 4 = 3""")
def feed_timestamps(spark, d):
    k, at = F.col("event_id") % 4, F.col("ts").cast("timestamp")
    mail = F.concat(F.date_format(at, "EEE"), F.lit(", "), F.date_format(at, "dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    text = F.when(k == 0, mail).when(k == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 2, F.concat(F.date_format(at + F.expr("INTERVAL 2 HOURS"), "d MMM yyyy HH:mm:ss"), F.lit(" +0200"))).otherwise("last week")
    return Q._t(spark, d, "events").select(F.col("event_id").alias("id"), F.unix_seconds(T.timestamp(text)).alias("at"))


@Q.query("""WITH x AS (SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS is_release, o_orderkey % 3 = 0 AS has_refs, o_orderkey % 5 = 0 AS f1, o_orderkey % 7 = 0 AS f2, o_orderkey % 4 = 0 AS f5 FROM orders)
SELECT id, CASE WHEN f1 THEN 'G1' WHEN is_release AND f2 THEN 'G2' WHEN has_refs AND f5 THEN 'G5' END AS gate, CASE WHEN f1 THEN 'numeric_grounding' WHEN is_release AND f2 THEN 'entity_grounding' WHEN has_refs AND f5 THEN 'reference_integrity' END AS reason,
  CASE WHEN f1 THEN (id + 0.5)::DECIMAL(18, 1)::VARCHAR WHEN is_release AND f2 THEN 'family' WHEN has_refs AND f5 THEN 'gone' ELSE '' END AS offending FROM x""")
def check_sequence(spark, d):
    o, n, k = Q._t(spark, d, "orders"), F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    drafts = o.select(n.alias("id"), (n % 2 == 0).alias("is_release"), (n % 3 == 0).alias("has_refs"))
    body = F.concat(F.lit("Model "), k, F.lit(" scores"), F.when(n % 5 == 0, F.concat(F.lit(" "), k, F.lit(".5"))).otherwise(""))
    numeric = grounding.numeric_grounding(o.select(n.alias("id"), body.alias("body")), o.select(n.alias("id"), F.concat(F.lit("model "), k).alias("text")))
    family = F.when(n % 7 == 0, "zz").otherwise("model")
    entity = grounding.entity_grounding(o.select(n.alias("id"), family.alias("family"), F.lit("").alias("version")), o.select(n.alias("id"), F.lit("a Model").alias("text")), spark.createDataFrame([], "family string, names array<string>"))
    refs = grounding.reference_integrity(o.select(n.alias("id"), F.lit("").alias("body"), F.when(n % 4 == 0, F.array(F.lit("gone"))).otherwise(F.array(F.lit("there"))).alias("refs")), spark.createDataFrame([("there", 1.0)], "id string, value double"))
    out = grounding.checked(drafts, numeric, entity, refs, (("G1", "numeric_grounding"), ("G2", "entity_grounding"), ("G5", "reference_integrity")))
    return out.withColumn("offending", F.array_join("offending", ","))


_BETTER = "CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey + 32 END"


@Q.query(f"""WITH p AS (SELECT o_orderkey AS id, 'Order ' || o_orderkey::VARCHAR AS title, {_BETTER} AS better FROM orders) SELECT p.id, p.better, b.title AS better_title, '/o/' || b.id::VARCHAR AS better_url FROM p LEFT JOIN p b ON p.better = b.id""")
def superseded_by(spark, d):
    n = F.col("o_orderkey")
    posts = Q._t(spark, d, "orders").select(n.alias("id"), F.concat(F.lit("Order "), n.cast("string")).alias("title"), F.concat(F.lit("/o/"), n.cast("string")).alias("url"), F.when(n % 7 == 0, n + 32).alias("better"))
    return joins.superseded_by(posts)


@Q.query(f"""WITH {Q._ITEMS}, seen AS (SELECT id, source FROM items WHERE id % 3 = 0 AND source <> 'src4') SELECT id, source, source NOT IN (SELECT source FROM seen) AS baseline FROM items WHERE id NOT IN (SELECT id FROM seen)""")
def novel_by_source(spark, d):
    x = Q.items(spark, d)
    seen = x.where("id % 3 = 0 AND source <> 'src4'")
    return joins.novel_with_baseline(x.select("id", "source"), seen, seen)


@Q.query(f"""WITH {Q._MEAS}, a AS (SELECT id, value, CASE WHEN seq % 3 = 0 THEN (seq + 1)::VARCHAR || '-1' END AS supersedes FROM m), b AS (SELECT id, value + 1 AS value, NULL::VARCHAR AS supersedes FROM m WHERE seq % 5 = 0),
o AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.id = a.id) UNION ALL SELECT * FROM b) SELECT id, value FROM o WHERE NOT EXISTS (SELECT 1 FROM o AS n WHERE n.supersedes = o.id)""")
def pending_overlay(spark, d):
    m, n = Q.measurements(spark, d), F.col("seq")
    stored = m.select("id", "value", F.when(n % 3 == 0, F.concat((n + 1).cast("string"), F.lit("-1"))).alias("supersedes"))
    pending = m.where("seq % 5 = 0").select("id", (F.col("value") + 1).alias("value"), F.lit(None).cast("string").alias("supersedes"))
    return joins.not_superseded(joins.overlay(stored, pending)).select("id", "value")


@Q.query("SELECT user_id AS id FROM events WHERE event_type = 'view' UNION SELECT c_custkey FROM customer")
def grown_cursor(spark, d):
    return joins.grown_cursor(Q._t(spark, d, "customer").select(F.col("c_custkey").alias("id")), Q._t(spark, d, "events").where("event_type = 'view'").select(F.col("user_id").alias("id")))


_LEAD = f"""{Q._MEAS}, b AS (SELECT DISTINCT p_brand AS benchmark, right(p_brand, 1) <> '3' AS up FROM part), r AS (SELECT m.*, up, row_number() OVER (PARTITION BY benchmark ORDER BY CASE WHEN up THEN -value ELSE value END, id) AS rank FROM m JOIN b USING (benchmark) WHERE measured_by <> 'vendor'),
fired AS (SELECT CASE WHEN rank = 1 THEN 'new_leader' ELSE 'new_top_entrant' END AS event, benchmark, model, id, value, rank, CASE WHEN rank = 1 THEN 4 ELSE 2 END AS weight FROM r WHERE rank <= 5 AND seq % 4 <> 0)"""


def _fired(spark, d):
    m = Q.measurements(spark, d).where("measured_by <> 'vendor'").withColumn("is_new", F.col("seq") % 4 != 0)
    return windows.leader_events(m, Q._t(spark, d, "part").select(F.col("p_brand").alias("benchmark"), (F.right("p_brand", F.lit(1)) != "3").alias("higher_is_better")).distinct())


@Q.query(f"WITH {_LEAD} SELECT * FROM fired")
def leader_events(spark, d):
    return _fired(spark, d)


@Q.query(f"WITH {_LEAD} SELECT count(*) AS n, coalesce(sum(weight), 0)::BIGINT AS total, coalesce(sum(weight), 0) >= 40 AS enough FROM fired")
def trigger_score(spark, d):
    return aggs.trigger_score(_fired(spark, d), 40)


@Q.query("SELECT DISTINCT coalesce(nullif(CASE WHEN p_size > 40 THEN '' WHEN p_size > 10 THEN p_type END, ''), p_brand) AS credit FROM part")
def attributions(spark, d):
    return aggs.attributions(Q._t(spark, d, "part").select(F.when(F.col("p_size") > 40, "").when(F.col("p_size") > 10, F.col("p_type")).alias("attribution"), F.col("p_brand").alias("publisher")))


@Q.query(f"""WITH {Q._FEED}, p AS (SELECT CASE WHEN topic > 9 THEN 'unmatched' ELSE 'b' || (topic % 3)::VARCHAR END AS bucket FROM f WHERE rating = 5), v AS (SELECT unnest(['b0', 'b1', 'b2', 'b9', 'unmatched']) AS bucket), c AS (SELECT v.bucket, count(p.bucket) AS n FROM v LEFT JOIN p USING (bucket) GROUP BY v.bucket)
SELECT * FROM c UNION ALL SELECT 'total', sum(n)::BIGINT FROM c""")
def digest_header(spark, d):
    bucket = F.when(F.col("topic") <= 9, F.concat(F.lit("b"), (F.col("topic") % 3).cast("string")))
    return aggs.digest_header(Q.feedback(spark, d).where("rating = 5").select(bucket.alias("bucket")), ("b0", "b1", "b2", "b9"))


@Q.query(f"""WITH {Q._FEED}, r AS (SELECT event_id AS id, rating, CASE WHEN topic <= 9 THEN 'b' || (topic % 3)::VARCHAR END AS bucket FROM f)
SELECT * FROM (SELECT 'unmatched_best' AS part, id, rating, bucket FROM r WHERE bucket IS NULL AND rating >= 4 ORDER BY rating DESC, id LIMIT 10) UNION ALL SELECT * FROM (SELECT 'matched_worst', id, rating, bucket FROM r WHERE bucket IS NOT NULL AND rating <= 2 ORDER BY rating, id LIMIT 10)""")
def rating_extremes(spark, d):
    bucket = F.when(F.col("topic") <= 9, F.concat(F.lit("b"), (F.col("topic") % 3).cast("string")))
    return aggs.rating_extremes(Q.feedback(spark, d).select(F.col("event_id").alias("id"), "rating", bucket.alias("bucket")))


@Q.query("""SELECT event_type AS reason, CASE WHEN event_type = 'error' THEN 'budget' ELSE 'quality' END AS class, count(*) AS n FROM events WHERE event_id % 9 > 0 AND ts >= TIMESTAMP '2024-01-24' GROUP BY ALL""")
def weekly_rejections(spark, d):
    at = F.when(F.col("event_id") % 9 > 0, F.col("ts").cast("string")).otherwise("some day")
    log = Q._t(spark, d, "events").select(F.col("event_type").alias("reason"), at.try_cast("timestamp").alias("at"))
    kind = F.when(F.col("reason") == "error", "budget").otherwise("quality")
    return aggs.recent(log, F.lit("2024-01-31").cast("timestamp"), 7).groupBy("reason", kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@Q.query(f"""WITH {Q._FEED}, q AS (SELECT item AS key, count(*) AS attempts, CASE WHEN item % 11 > 0 THEN min(ts) END AS queued_at FROM f WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY item)
SELECT key, attempts, CASE WHEN queued_at IS NULL OR queued_at < TIMESTAMP '2024-01-24' THEN 'expired' WHEN attempts >= 3 THEN 'exhausted' ELSE 'waiting' END AS state FROM q""")
def queue_states(spark, d):
    q = Q.feedback(spark, d).where(F.col("at") >= F.lit("2024-01-20").cast("timestamp_ntz")).groupBy(F.col("item").alias("key")).agg(F.count(F.lit(1)).alias("attempts"), F.min("at").alias("queued_at"))
    q = q.withColumn("queued_at", F.when(F.col("key") % 11 > 0, F.col("queued_at").cast("timestamp")))
    return windows.pruned_queue(q, F.lit("2024-01-31").cast("timestamp")).select("key", "attempts", "state")


@Q.query("""WITH r AS (SELECT c_mktsegment AS section, c_custkey AS id, c_acctbal AS score, CASE WHEN c_acctbal < 0 THEN 'dismissed' ELSE 'radar' END AS status FROM customer)
SELECT status, id, score, row_number() OVER (PARTITION BY status ORDER BY score DESC, id) AS rank FROM r QUALIFY rank <= 20""")
def archive_top(spark, d):
    c = Q._t(spark, d, "customer").select(F.when(F.col("c_acctbal") < 0, "dismissed").otherwise("radar").alias("status"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    return windows.top(c, ["status"], [F.desc("score"), "id"], 20)


@Q.query("""WITH v(section, depth) AS (VALUES ('MACHINERY', 1), ('AUTOMOBILE', 2), ('NONE', 3), ('BUILDING', 4)), p AS (SELECT c_mktsegment AS section, o_orderkey AS id, o_orderdate AS day FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P')
SELECT depth, section, id, row_number() OVER (PARTITION BY section ORDER BY day DESC, id) AS pos, CASE WHEN pos = 1 THEN 'featured' WHEN pos <= 3 THEN 'next' ELSE 'listed' END AS place FROM p JOIN v USING (section) QUALIFY pos <= 6""")
def section_listing(spark, d):
    depth = spark.createDataFrame([("MACHINERY", 1), ("AUTOMOBILE", 2), ("NONE", 3), ("BUILDING", 4)], "section string, depth int")
    o = Q._t(spark, d, "orders").join(Q._t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    posts = o.select(F.col("c_mktsegment").alias("section"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), (F.col("o_orderstatus") == "P").alias("draft"))
    return windows.listing(posts, depth, 6)


@Q.query(f"""WITH {Q._SCORED}, v AS (SELECT unnest([{", ".join(f"'{t}'" for t, _ in Q.TOPICS)}, 'none', 'other']) AS topic), {_LAST}, s AS (SELECT v.topic, last FROM v LEFT JOIN last USING (topic) WHERE last IS NULL OR DATE '{_DAY}' - last >= 15)
SELECT topic, last, row_number() OVER (ORDER BY last NULLS FIRST, topic) AS pos FROM s""")
def starved_order(spark, d):
    vocab = spark.createDataFrame([(t,) for t, _ in Q.TOPICS] + [("none",), ("other",)], "topic string")
    x = Q.scored(spark, d, "topics").where("tier = 'primary'").select(F.explode("topics").alias("topic"), F.date_sub("published", 14).alias("published"))
    return archive.starved_first(archive.starved(x, vocab, F.lit(_DAY).cast("date"), rules.starvation), F.lit(_DAY).cast("date"), 15).select("topic", "last", "pos")


@Q.query(f"""WITH {Q._SCORED}, s AS (SELECT * FROM scored WHERE reason IS NULL) SELECT scope, name, count(*) AS n, max(id) AS last_id, count(DISTINCT categories) AS kinds FROM (
SELECT 'site' AS scope, NULL AS name, id, section || ' — news' || array_to_string(topics, ',') AS categories FROM s UNION ALL SELECT 'section', section, id, section || ' — news' || array_to_string(topics, ',') FROM s UNION ALL SELECT 'topic', unnest(topics), id, section || ' — news' || array_to_string(topics, ',') FROM s) GROUP BY ALL""")
def feed_scopes(spark, d):
    x = Q.passed(spark, d, "section", "topics").select("id", "title", F.col("summary").alias("description"), "published", "url", F.lit("desk").alias("author"), "section", F.lit("news").alias("format"), "topics")
    return logs.feed_rows(x).groupBy("scope", "name").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id"), F.count_distinct("categories").alias("kinds"))


@Q.query("""SELECT 'low' AS adapter, count(*) AS n, sum(p_size)::BIGINT AS total, 0::BIGINT AS parked FROM part WHERE p_size <= 25 UNION ALL SELECT 'high', count(*), sum(p_size)::BIGINT, (SELECT count(DISTINCT p_brand) FROM part WHERE p_size > 45) FROM part WHERE p_size > 25 UNION ALL SELECT 'broken', 0, NULL, NULL""")
def adapter_runs(spark, d):
    p = Q._t(spark, d, "part")
    none = spark.createDataFrame([], "name string")
    found = {
        "low": lambda: (p.where("p_size <= 25").select("p_partkey", "p_size"), none), "high": lambda: (p.where("p_size > 25").select("p_partkey", "p_size", "p_type"), p.where("p_size > 45").select(F.col("p_brand").alias("name")).distinct()),
        "broken": lambda: (p.select("no_such_column"), none),
    }
    rows, parked, failures = adapters.collect(spark, found, f"{Q._stream_dir(spark)}/adapters")
    by = rows.groupBy("adapter").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("total"))
    names = parked.groupBy("adapter").agg(F.count(F.lit(1)).alias("parked"))
    done = by.join(names, "adapter", "left").select("adapter", "n", "total", F.coalesce("parked", F.lit(0)).cast("long").alias("parked"))
    lost = failures.select("adapter", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("total"), F.lit(None).cast("long").alias("parked"))
    return done.union(lost)


@Q.query(f"""WITH {Q._FEED}, i AS (SELECT doc_id AS item, source FROM documents WHERE doc_id % 3 <> 0) SELECT date_trunc('day', f.ts) AS start, coalesce(i.source, 'missing') AS source, topic, count(*) AS observations, {Q._NET} AS net FROM f LEFT JOIN i USING (item) GROUP BY ALL""")
def stream_feedback(spark, d):
    items = Q._t(spark, d, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("item"), "source")
    kind = F.create_map(*[F.lit(x) for kv in Q._KINDS.items() for x in kv])
    e = Q._event_stream(spark, d).select(F.col("user_id").alias("item"), F.try_element_at(kind, F.col("event_type")).alias("kind"), (F.get_json_object("props", "$.k").cast("long") % 13).alias("topic"), F.col("ts").cast("timestamp").alias("at"))
    return jobs.run_once(jobs.feedback_windows(e, items), f"feedback_{uuid.uuid4().hex[:8]}", Q._stream_dir(spark), "complete")


@Q.query(f"""WITH {Q._ITEMS}, p AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'new' WHEN id % 3 = 1 THEN 'cross' ELSE 'replace' END AS kind, id % 4 AS v FROM items) SELECT '2401.' || lpad((id % 100000)::VARCHAR, 5, '0') AS id, CASE WHEN id % 2 = 0 THEN kind ELSE 'new' END AS announce_type FROM p WHERE CASE WHEN id % 2 = 0 THEN kind <> 'replace' ELSE v <= 1 END""")
def paper_feed(spark, d):
    n = F.col("id")
    kind = F.when(n % 3 == 0, "new").when(n % 3 == 1, "cross").otherwise("replace")
    told = F.when(n % 2 == 0, F.concat(F.lit("Announce Type: "), kind, F.lit("\nAbstract: "), "summary")).otherwise(F.col("summary"))
    url = F.concat(F.lit("http://arxiv.org/abs/2401."), F.lpad((n % 100000).cast("string"), 5, "0"), F.lit("v"), (n % 4).cast("string"))
    return logs.papers(Q.items(spark, d).select("title", url.alias("url"), told.alias("summary"))).select("id", "announce_type")
