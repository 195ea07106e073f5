"""Further registered queries: releases, grounding, landed boards, selection under budgets, the expiring queue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedscope import queries as Q
from feedscope.functions import display, release
from feedscope.operators import archive, grounding, joins, mentions, windows
from feedscope.sources import boards
from feedscope.streaming import jobs

_DAY = "2024-02-10"
_EVENTS = release.EventRules(runtime="eaux |keit ", deprecation="lich |isca", introducing="^[A-D]", availability="tion ", capability="ment |ando ")
_HINTS = (("vision", "ing "), ("audio", "heit "), ("video", "ble "))


@Q.query(f"""WITH {Q._ITEMS}, v AS (SELECT *, lang || '-' || (id % 7)::VARCHAR || CASE WHEN id % 2 = 0 THEN '.' || (id % 3)::VARCHAR ELSE 'b' END AS name, id % 3 = 0 AS known, id % 13 = 0 AS hub, DATE '2024-01-01' + (id % 60)::INT AS released FROM items),
x AS (SELECT *, CASE WHEN id % 2 = 0 THEN (id % 7)::VARCHAR || '.' || (id % 3)::VARCHAR ELSE '' END AS version, abs(published - released) <= 14 AS fresh, title || chr(10) || summary AS txt FROM v)
SELECT id, version, version <> '' AS major, CASE WHEN hub THEN 'new_model' WHEN regexp_matches(title, '{_EVENTS.runtime}') THEN 'none' WHEN regexp_matches(txt, '{_EVENTS.deprecation}') THEN 'deprecation' WHEN known AND fresh THEN 'new_model'
  WHEN regexp_matches(title, '{_EVENTS.introducing}') THEN CASE WHEN known AND version <> '' THEN 'version_bump' ELSE 'new_model' END WHEN regexp_matches(title, '{_EVENTS.availability}') THEN 'availability' WHEN regexp_matches(title, '{_EVENTS.capability}') THEN 'capability_update'
  WHEN regexp_matches(summary, '{_EVENTS.availability}') THEN 'availability' WHEN regexp_matches(summary, '{_EVENTS.capability}') THEN 'capability_update' WHEN known AND version <> '' THEN 'version_bump' ELSE 'none' END AS event,
  concat_ws(',', 'text', {", ".join(f"CASE WHEN regexp_matches(txt, '{p}') THEN '{n}' END" for n, p in _HINTS)}) AS modality FROM x""")
def release_events(spark, d):
    n = F.col("id")
    tail = F.when(n % 2 == 0, F.concat(F.lit("."), (n % 3).cast("string"))).otherwise("b")
    x = Q.items(spark, d).withColumn("version", release.version_of(F.concat("lang", F.lit("-"), (n % 7).cast("string"), tail)))
    fresh = release.is_fresh(F.col("published"), F.date_add(F.lit("2024-01-01").cast("date"), (n % 60).cast("int")))
    event = release.release_event(F.col("title"), F.col("summary"), n % 13 == 0, n % 3 == 0, F.col("version"), fresh, _EVENTS)
    kinds = release.modalities(F.concat_ws("\n", "title", "summary"), _HINTS)
    return x.select("id", "version", release.is_major(F.col("version")).alias("major"), event.alias("event"), F.array_join(kinds, ",").alias("modality"))


_NAMES = """n AS (SELECT item_id AS ord, 'm' || item_id::VARCHAR AS model, unnest([split_part(text, ' ', 2), split_part(text, ' ', 3), split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)]) AS name FROM benchmark)"""


@Q.query(f"""WITH {Q._ITEMS}, {_NAMES} SELECT id, model FROM items JOIN n ON length(name) >= 4 AND contains(lower(summary), lower(name))
QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(name) DESC, instr(lower(summary), lower(name)), ord) = 1""")
def known_models(spark, d):
    w = lambda k: F.split_part("text", F.lit(" "), F.lit(k))
    names = Q._t(spark, d, "benchmark").select(F.col("item_id").alias("ord"), F.concat(F.lit("m"), F.col("item_id").cast("string")).alias("model"), F.explode(F.array(w(2), w(3), F.concat_ws(" ", w(1), w(2)))).alias("name"))
    return mentions.longest_known(Q.items(spark, d).select("id", F.col("summary").alias("text")), names)


@Q.query(f"""WITH {Q._ITEMS}, c AS (SELECT item_id, list_distinct(list_filter([regexp_replace(lower(split_part(text, ' ', k)), '[^a-z]', '', 'g') FOR k IN range(1, 4)], lambda p: length(p) > 2)) AS parts FROM benchmark)
SELECT item_id AS candidate, count(*) AS n, min(id) AS first_id FROM c JOIN items ON len(parts) > 0 AND len(list_filter(parts, lambda p: contains(lower(title || chr(10) || summary), p))) = len(parts) WHERE published >= DATE '2024-01-31' GROUP BY item_id""")
def corroborated(spark, d):
    words = [F.regexp_replace(F.lower(F.split_part("text", F.lit(" "), F.lit(k))), "[^a-z]", "") for k in (1, 2, 3)]
    candidates = Q._t(spark, d, "benchmark").select(F.col("item_id").alias("candidate"), F.concat_ws("-", *words).alias("family"))
    items = Q.items(spark, d).select("id", F.concat_ws("\n", "title", "summary").alias("text"), "published")
    met = mentions.corroborate(candidates, items, F.lit(_DAY).cast("timestamp"), 240)
    return met.groupBy("candidate").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@Q.query("""SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 4 WHEN 0 THEN printf('%.1f', v) || '%' WHEN 1 THEN floor(v + 0.5)::BIGINT::VARCHAR WHEN 2 THEN '$' || printf('%.2f', v) ELSE printf('%.1f', v) || 's' END AS shown,
  concat_ws(' · ', CASE WHEN l_returnflag <> 'N' THEN 'effort ' || l_returnflag END, CASE WHEN l_suppkey % 3 = 0 THEN 'zero-shot' ELSE (l_suppkey % 3)::VARCHAR || '-shot' END, CASE WHEN l_partkey % 3 = 0 THEN 'tools' WHEN l_partkey % 3 = 1 THEN 'no tools' END, 'harness ' || l_linestatus) AS conditions
FROM (SELECT *, l_extendedprice / 100 + 0.00003 AS v FROM lineitem)""")
def shown_measurements(spark, d):
    v, k = F.col("l_extendedprice") / 100 + 0.00003, F.col("l_linenumber") % 4
    unit = F.when(k == 0, "percent").when(k == 1, "elo").when(k == 2, "usd").otherwise("seconds")
    tools = F.when(F.col("l_partkey") % 3 == 0, True).when(F.col("l_partkey") % 3 == 1, False)
    shots = F.when(F.col("l_suppkey") % 3 == 0, "zero-shot").otherwise(F.concat((F.col("l_suppkey") % 3).cast("string"), F.lit("-shot")))
    line = display.summary((("effort ", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))), ("", shots), ("", F.when(tools, "tools").when(~tools, "no tools")), ("harness ", F.col("l_linestatus")), ("temp ", F.lit(None).cast("double"))))
    return Q._t(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), display.value_text(v, unit).alias("shown"), line.alias("conditions"))


@Q.query("""WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS s, 'Clerk ' || (o_custkey % 9)::VARCHAR AS a, 'model ' || (o_orderkey % 5)::VARCHAR AS m, o_orderdate::DATE::VARCHAR AS day, o_orderkey % 2 = 0 AS built, o_custkey % 2 = 0 AS checked FROM orders)
SELECT id, CASE s WHEN 'F' THEN 'No one read this' || CASE WHEN built THEN '; made by ' || m ELSE '' END || '; taken from the desk on ' || day || '.' WHEN 'O' THEN a || ' wrote every word.'
  WHEN 'P' THEN concat_ws('; ', a || ' asked for it', CASE WHEN built THEN 'tried it out' END, m || ' wrote a draft', CASE WHEN checked THEN a || ' looked up the claims' END) || '.' END AS line FROM o""")
def credit_lines(spark, d):
    k, c, always = F.col("o_orderkey"), F.col("o_custkey"), F.lit(True)
    author, model = F.concat(F.lit("Clerk "), (c % 9).cast("string")), F.concat(F.lit("model "), (k % 5).cast("string"))
    built, checked = k % 2 == 0, c % 2 == 0
    clauses = {
        "F": ((always, F.lit("No one read this")), (built, F.concat(F.lit("made by "), model)), (always, F.concat(F.lit("taken from the desk on "), F.date_format("o_orderdate", "yyyy-MM-dd")))),
        "O": ((always, F.concat(author, F.lit(" wrote every word"))),),
        "P": ((always, F.concat(author, F.lit(" asked for it"))), (built, F.lit("tried it out")), (always, F.concat(model, F.lit(" wrote a draft"))), (checked, F.concat(author, F.lit(" looked up the claims")))),
    }
    return Q._t(spark, d, "orders").select(k.alias("id"), display.disclosure(F.col("o_orderstatus"), clauses).alias("line"))


_VENDORS = {"supplier one": "s1", "Supplier-2": "s2", "SUPPLIER 3": "s3"}


@Q.query("""SELECT s_suppkey AS id, CASE regexp_replace(lower(n), '[^a-z0-9]', '', 'g') WHEN 'supplierone' THEN 's1' WHEN 'supplier2' THEN 's2' WHEN 'supplier3' THEN 's3' WHEN 'acme' THEN 'Acme' ELSE s_name END AS vendor
FROM (SELECT *, CASE s_suppkey % 5 WHEN 0 THEN 'A.C.M.E' ELSE 'Supplier ' || (s_suppkey % 5)::VARCHAR END AS n FROM supplier)""")
def vendor_names(spark, d):
    k = F.col("s_suppkey") % 5
    name = F.when(k == 0, "A.C.M.E").otherwise(F.concat(F.lit("Supplier "), k.cast("string")))
    return Q._t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), release.vendor_of(name, ["Acme"], _VENDORS, F.col("s_name")).alias("vendor"))


@Q.query("""WITH r AS (SELECT doc_id AS id, split_part(text, ' ', 1) AS w, CASE WHEN doc_id % 5 = 0 THEN 'zz' || doc_id::VARCHAR ELSE split_part(text, ' ', 1) END AS family, (doc_id % 7)::VARCHAR || '.' || (doc_id % 3)::VARCHAR AS version, text || ' v' || (doc_id % 7)::VARCHAR || '.' || (doc_id % 3)::VARCHAR || CASE WHEN doc_id % 4 = 0 THEN '%' ELSE ' is out' END AS body FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, [family] || CASE WHEN id % 10 = 0 THEN [w] ELSE [] END AS names, regexp_replace(lower(body), '[^a-z0-9]', '', 'g') AS b FROM r),
t AS (SELECT *, [regexp_replace(lower(n), '[^a-z0-9]', '', 'g') FOR n IN names] AS k FROM s)
SELECT id, concat_ws(',', CASE WHEN len(list_filter(k, lambda x: x <> '' AND contains(b, x))) = 0 THEN 'family' END, CASE WHEN NOT list_contains(regexp_extract_all(body, '[0-9.]+%?'), version) THEN 'version' END) AS missing FROM t""")
def entity_grounding(spark, d):
    n, word = F.col("doc_id"), F.split_part("text", F.lit(" "), F.lit(1))
    docs = Q._t(spark, d, "documents").where("text IS NOT NULL")
    family, version = F.when(n % 5 == 0, F.concat(F.lit("zz"), n.cast("string"))).otherwise(word), F.concat((n % 7).cast("string"), F.lit("."), (n % 3).cast("string"))
    body = F.concat("text", F.lit(" v"), version, F.when(n % 4 == 0, "%").otherwise(" is out"))
    names = docs.where("doc_id % 10 = 0").select(family.alias("family"), F.array(word).alias("names"))
    found = grounding.entity_grounding(docs.select(n.alias("id"), family.alias("family"), version.alias("version")), docs.select(n.alias("id"), body.alias("text")), names)
    return found.select("id", F.array_join("missing", ",").alias("missing"))


@Q.query("""WITH l AS (SELECT l_orderkey AS o, unnest(CASE WHEN l_orderkey % 17 = 0 AND l_linenumber = 1 THEN [l_orderkey::VARCHAR || '-1', l_orderkey::VARCHAR || '-x'] ELSE [l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR] END) AS ref FROM lineitem),
m AS (SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS ref, l_extendedprice::DECIMAL(18, 2)::DOUBLE AS v FROM lineitem), r AS (SELECT DISTINCT o, ref FROM l),
g AS (SELECT o, count(*) AS n_refs, coalesce(array_to_string(list(ref ORDER BY ref) FILTER (v IS NULL), ','), '') AS dangling, list(v) FILTER (v IS NOT NULL) AS vs FROM r LEFT JOIN m USING (ref) GROUP BY o),
f AS (SELECT o_orderkey AS id, unnest(list_distinct([(SELECT min(v) FROM m WHERE m.ref = o_orderkey::VARCHAR || '-1')::DECIMAL(18, 2), o_totalprice::DECIMAL(18, 2)])) AS f FROM orders),
c AS (SELECT id, f::VARCHAR AS f, list_has_any([f::DOUBLE, round(f::DOUBLE / 100, 6), round(f::DOUBLE * 100, 6)], flatten([[v, round(v / 100, 6), round(v * 100, 6)] FOR v IN coalesce(vs, [])])) AS ok FROM f LEFT JOIN g ON id = o WHERE f IS NOT NULL)
SELECT o_orderkey AS id, coalesce(any_value(n_refs), 0)::BIGINT AS n_refs, coalesce(any_value(dangling), '') AS dangling, coalesce(string_agg(c.f, ',' ORDER BY c.f) FILTER (NOT coalesce(c.ok, false)), '') AS untraced FROM orders LEFT JOIN g ON o_orderkey = o LEFT JOIN c ON c.id = o_orderkey GROUP BY o_orderkey""")
def reference_integrity(spark, d):
    line = Q._t(spark, d, "lineitem")
    key = F.col("l_orderkey").cast("string")
    ref, price = F.concat_ws("-", key, F.col("l_linenumber").cast("string")), F.col("l_extendedprice").cast("decimal(18,2)")
    cited = F.when((F.col("l_orderkey") % 17 == 0) & (F.col("l_linenumber") == 1), F.array(ref, F.concat(key, F.lit("-x")))).otherwise(F.array(ref))
    drafts = line.groupBy(F.col("l_orderkey").alias("id")).agg(F.flatten(F.collect_list(cited)).alias("refs"), F.min(F.when(F.col("l_linenumber") == 1, price)).alias("p"))
    o = Q._t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"))
    body = F.concat_ws(" ", F.lit("Scores of"), F.col("p").cast("string"), F.lit("and"), F.col("total").cast("string"), F.lit("on tier 4"))
    drafts = o.join(drafts, "id", "left").select("id", body.alias("body"), "refs")
    out = grounding.reference_integrity(drafts, line.select(ref.alias("id"), price.cast("double").alias("value")))
    return out.select("id", F.col("n_refs").cast("long").alias("n_refs"), F.array_join("dangling", ",").alias("dangling"), F.array_join("untraced", ",").alias("untraced"))


CLAIMED = (("tion", "tion the"), ("heit", "heit"), ("ment", "ment"))


@Q.query()
def claims_in_prose(spark, d):
    n = F.col("id")
    told = F.concat(F.lit(". The desk reports tion the "), (n % 90).cast("string"), F.lit(".5% and heit at 71.2%. It says ment and Zork at "), (n % 50).cast("string"), F.lit("% and 9.1! Some ment at 4.4."))
    posts = Q.items(spark, d).select("id", F.concat("summary", told).alias("body"), F.when(n % 6 > 0, F.col("url")).alias("url"), F.when(n % 5 > 0, F.concat(F.lit("m"), (n % 5).cast("string"))).alias("model"))
    return grounding.claims(posts, CLAIMED, "Zork", "(?i)reports|says")


_LIMITS = (("research", 50, 3, 5), ("benchmark", 2, 4, 5), ("security", None, 6, 9))


@Q.query(f"""WITH {Q._SCORED}, u(section, hard_cap, per_run, per_day) AS (VALUES ('research', 50, 3, 5), ('benchmark', 2, 4, 5), ('security', NULL, 6, 9)),
r AS (SELECT s.section, s.id, s.relevance, coalesce(l.quality = 1, false) AS ok, row_number() OVER (PARTITION BY section ORDER BY relevance DESC, id) AS rank FROM scored s LEFT JOIN labels l ON l.doc_id = s.id WHERE reason IS NULL),
bf AS (SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY section ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r LEFT JOIN u USING (section)),
x AS (SELECT *, CASE WHEN before >= hard_cap THEN 'hard_cap' WHEN before >= per_run THEN 'per_run' WHEN before >= per_day THEN 'per_day' END AS refusal FROM bf),
y AS (SELECT *, CASE WHEN refusal IS NULL AND rank > 8 THEN 'attempts' ELSE refusal END AS why FROM x), s AS (SELECT section, arg_min(why, rank) FILTER (why IS NOT NULL) AS stop, min(rank) FILTER (why IS NOT NULL) AS first FROM y GROUP BY section)
SELECT section, id, CASE WHEN first IS NULL OR rank < first THEN CASE WHEN ok THEN 'published' ELSE 'failed' END ELSE 'queued' END AS outcome, CASE WHEN rank >= first THEN stop END AS reason FROM y JOIN s USING (section)""")
def budgeted_selection(spark, d):
    usage = spark.createDataFrame(list(_LIMITS), "section string, hard_cap int, per_run int, per_day int")
    good = Q._t(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("good"))
    ranked = Q.passed(spark, d, "section", "relevance").select("section", "id", F.col("relevance").alias("score")).join(good, "id", "left")
    return windows.budgeted(ranked.select("section", "id", "score", F.coalesce("good", F.lit(False)).alias("ok")), usage, ["hard_cap", "per_run", "per_day"])


@Q.query("""WITH l AS (SELECT CASE WHEN event_id % 19 > 0 THEN user_id END AS item, event_type AS reason, ts AS "at", event_id AS seq FROM events WHERE event_type IN ('error', 'view') AND ts >= TIMESTAMP '2024-01-10'), c AS (SELECT DISTINCT c_custkey AS item FROM customer WHERE c_nationkey < 12)
SELECT l.item, reason, "at", CASE WHEN c.item IS NULL THEN 'absent' ELSE 'in_cursor' END AS state FROM l LEFT JOIN c USING (item) WHERE l.item IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l.item ORDER BY "at" DESC, seq DESC) = 1
UNION ALL SELECT item, reason, "at", 'no_id' FROM l WHERE item IS NULL""")
def replay_selection(spark, d):
    log = Q._t(spark, d, "events").select(F.when(F.col("event_id") % 19 > 0, F.col("user_id")).alias("item"), F.col("event_type").alias("reason"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    cursor = Q._t(spark, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("item"))
    return archive.replay(log, cursor, ["error", "view"], F.lit("2024-01-10").cast("timestamp_ntz"))


@Q.query(f"""WITH {Q._ITEMS}, x AS (SELECT id, lang || '/' || (id % 50)::VARCHAR AS key, published AS day, ['f' || (id % 3)::VARCHAR, 'g' || (id % 2)::VARCHAR] AS facts FROM items), c AS (SELECT key, min(day) AS day, arg_min(facts, (day, id)) AS facts FROM x GROUP BY key)
SELECT x.id, x.key, CASE WHEN x.day - c.day > 10 THEN 'publish' WHEN len(list_filter(x.facts, lambda f: f IN ('f1', 'f2') AND NOT list_contains(c.facts, f))) > 0 THEN 'update' ELSE 'drop' END AS decision FROM x JOIN c USING (key)""")
def coverage_decisions(spark, d):
    n = F.col("id")
    facts = F.array(F.concat(F.lit("f"), (n % 3).cast("string")), F.concat(F.lit("g"), (n % 2).cast("string")))
    x = Q.items(spark, d).select("id", F.concat_ws("/", "lang", (n % 50).cast("string")).alias("key"), F.col("published").alias("at"), facts.alias("facts"))
    covered = x.groupBy("key").agg(F.min("at").alias("at"), F.min_by("facts", F.struct("at", "id")).alias("facts"))
    return joins.coverage_decision(x, covered, ["f1", "f2"]).select("id", "key", "decision")


@Q.query("""SELECT u.conv_id * 1000 + u.turn AS message, a.conv_id AS item, CASE WHEN a.conv_id IS NULL THEN 'standalone' ELSE 'item' END AS kind, CASE WHEN lower(trim(coalesce(u.text, ''))) NOT IN ('none', '-', '') THEN length(trim(u.text)) END AS n
FROM conversations u LEFT JOIN (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'assistant') a ON a.conv_id = u.conv_id AND a.turn = u.turn - 1 WHERE u.role = 'user'""")
def reply_requests(spark, d):
    c = Q._t(spark, d, "conversations")
    message = F.col("conv_id") * 1000 + F.col("turn")
    cached = c.where("role = 'assistant'").select(message.alias("message"), F.col("conv_id").alias("item")).distinct()
    replies = c.where("role = 'user'").select(message.alias("message"), (message - 1).alias("reply_to"), "text")
    return archive.requests(replies, cached).select("message", "item", "kind", F.length("instruction").cast("long").alias("n"))


@Q.query(f"""WITH {Q._SCORED} SELECT l.id AS slug, coalesce(p.relevance, l.relevance) AS relevance, coalesce(p.section, l.section) AS section, coalesce(p.relevance, l.relevance) >= 30 AS hot FROM scored l LEFT JOIN (SELECT id, quality AS relevance, lang AS section FROM scored WHERE tier = 'primary') p USING (id)""")
def post_facts(spark, d):
    x = Q.scored(spark, d, "quality", "relevance", "section")
    posts = x.where("tier = 'primary'").select(F.col("id").alias("slug"), F.col("quality").alias("relevance"), F.col("lang").alias("section"))
    return archive.post_facts(x.select(F.col("id").alias("slug"), "relevance", "section"), posts, ["relevance", "section"], 30.0)


@Q.query(f"""WITH {Q._SCORED}, s AS (SELECT id, bucket, relevance FROM scored WHERE reason IS NULL)
SELECT * FROM (SELECT id, bucket, relevance, 'matched' AS part FROM s WHERE bucket <> 'serendipity' ORDER BY relevance DESC, id LIMIT 10) UNION ALL SELECT * FROM (SELECT id, bucket, relevance, 'sampled' AS part FROM s WHERE bucket = 'serendipity' ORDER BY md5(id::VARCHAR || 'a'), id LIMIT 5)""")
def matched_and_sampled(spark, d):
    x = Q.passed(spark, d, "bucket", "relevance").select("id", "bucket", "relevance")
    return windows.matched_and_sampled(x, F.col("bucket") != "serendipity", "relevance", "id", 10, 5, "a")


@Q.query(f"""WITH {Q._SCORED} SELECT s.id, s.relevance, l.quality AS external FROM scored s JOIN labels l ON l.doc_id = s.id WHERE s.reason IS NULL""")
def score_join_back(spark, d):
    sent = Q.passed(spark, d, "relevance").select("id", "relevance")
    return sent.join(Q._t(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("external")), "id")


def _payloads(rows, page, value):
    """Pages of at most a hundred objects, each a JSON array."""
    return rows.groupBy(page.alias("source")).agg(F.concat(F.lit("["), F.concat_ws(",", F.transform(F.array_sort(F.collect_list(value)), lambda x: F.to_json(x))), F.lit("]")).alias("payload"))


@Q.query("""SELECT 'p' || (p_partkey // 100)::VARCHAR AS source, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_partkey::VARCHAR END AS id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'https://x/' || p_partkey::VARCHAR ELSE 'p' || (p_partkey // 100)::VARCHAR END AS url FROM part""")
def endpoint_items(spark, d):
    k = F.col("p_partkey")
    value = F.struct(F.format_string("%06d", k % 100).alias("n"), F.when(k % 3 == 1, k.cast("string")).alias("id"), F.when(k % 3 == 2, k.cast("string")).alias("_id"), F.col("p_name").alias("title"), F.when(k % 2 == 0, F.concat(F.lit("https://x/"), k.cast("string"))).alias("url"))
    pages = _payloads(Q._t(spark, d, "part"), F.concat(F.lit("p"), F.floor(k / 100).cast("string")), value)
    return boards.endpoint_items(pages, 100).select("source", "id", "title", "url")


@Q.query("""SELECT 'hub:org/m' || p_partkey::VARCHAR || CASE p_size % 5 WHEN 1 THEN '-base' ELSE '' END AS id, p_brand AS tag FROM part WHERE p_size % 5 < 3""")
def hub_listing(spark, d):
    k = F.col("p_partkey")
    tail = F.element_at(F.array(*map(F.lit, ("", "-base", "", "-GGUF", "-int4"))), F.col("p_size") % 5 + 1)
    value = F.struct(F.concat(F.lit("org/m"), k.cast("string"), tail).alias("modelId"), F.array("p_brand").alias("tags"))
    pages = _payloads(Q._t(spark, d, "part"), F.floor(k / 100).cast("string"), value)
    return boards.hub_items(pages, "https://hub/", limit=100).select("id", F.element_at("tags", 1).alias("tag"))


@Q.query("""SELECT 'm' || p_partkey::VARCHAR AS model, CASE WHEN p_partkey % 2 = 0 THEN round(p_size::DOUBLE, 2) ELSE round(p_size / 64.0 * 100, 2) END::DOUBLE AS value FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 11 <> 0""")
def board_claims(spark, d):
    k = F.col("p_partkey")
    model = F.concat(F.lit("m"), k.cast("string"))
    size = F.col("p_size").cast("double")
    raw = F.when(k % 2 == 0, F.when(size == 1, 0.01).otherwise(size)).otherwise(size / 64)
    source = F.struct(F.when(k % 11 == 0, "https://else/").otherwise(F.concat(F.lit("https://hub/"), model)).alias("url"), (k % 5 == 0).alias("isExternal"))
    value = F.struct(model.alias("modelId"), raw.alias("value"), F.when(k % 7 == 0, 3).alias("pullRequest"), source.alias("source"))
    return boards.board_claims(_payloads(Q._t(spark, d, "part"), F.floor(k / 100).cast("string"), value), "https://hub/", F.lit(True)).select("model", "value")


@Q.query("""SELECT 'low' AS benchmark, p_name AS version, round(p_size / 64.0 * 100, 2)::DOUBLE AS value, DATE '2025-01-01' + (p_partkey % 100)::INT AS measured_at, NULL::VARCHAR AS url, 'thirdparty' AS measured_by FROM part WHERE p_size <= 25
UNION ALL SELECT 'high', p_name, round(p_size, 3)::DOUBLE, DATE '2025-01-01' + (p_partkey % 100)::INT, 'https://x/' || p_partkey::VARCHAR, 'community' FROM part WHERE p_size > 25 AND p_partkey % 100 >= 0""")
def csv_bundle(spark, d):
    path, k = f"{Q._stream_dir(spark)}/bundle", F.col("p_partkey")
    day = F.date_add(F.lit("2025-01-01").cast("date"), (k % 100).cast("int")).cast("string")
    p = Q._t(spark, d, "part").select("p_partkey", "p_name", "p_size")
    p.where("p_size <= 25").select(F.col("p_name").alias("Model version"), (F.col("p_size") / 64).alias("Best score"), day.alias("Release date")).write.option("header", True).csv(f"{path}/low.csv")
    p.where("p_size > 25").select(F.col("p_name").alias("Model version"), F.col("p_size").alias("Elo"), F.lit(" ").alias("Release date"), day.alias("Started at"), F.concat(F.lit("https://x/"), k.cast("string")).alias("Link")).write.option("header", True).csv(f"{path}/high.csv")
    files = (boards.BundleFile("low.csv", "low", "Best score"), boards.BundleFile("high.csv", "high", "Elo", percent=False, internal=False), boards.BundleFile("gone.csv", "gone", "Score"))
    return boards.read_bundle(spark, path, files, ["Release date", "Started at"], ["Link"], "Model version", "2025-01-01").drop("variant", "evaluator")


@Q.query("""WITH RECURSIVE e AS (SELECT user_id AS key, epoch_ms(ts) AS a, ts, value FROM events), w AS (SELECT max(a) - 86400000 AS w FROM e),
s AS (SELECT key, min(a) AS q FROM e GROUP BY key UNION ALL SELECT key, (SELECT min(e.a) FROM e WHERE e.key = s.key AND e.a > s.q + 604800000) AS q FROM s WHERE q IS NOT NULL),
x AS (SELECT s.key, s.q, arg_max(e.value, (e.ts, e.value)) AS score, count(*) AS puts FROM s JOIN e ON e.key = s.key AND e.a BETWEEN s.q AND s.q + 604800000 WHERE s.q IS NOT NULL GROUP BY s.key, s.q)
SELECT key, (q // 1000)::BIGINT AS queued_at, score, puts FROM x, w WHERE q + 604800000 <= w OR EXISTS (SELECT 1 FROM e WHERE e.key = x.key AND e.a > x.q + 604800000)""")
def stream_queue_expiry(spark, d):
    s = Q._event_stream(spark, d).select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("score"))
    out = jobs.run_once(jobs.queue_expiry(s), f"expiry_{uuid.uuid4().hex[:8]}", Q._stream_dir(spark))
    return out.select("key", F.unix_seconds("queued_at").alias("queued_at"), "score", "puts")
