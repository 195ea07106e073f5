"""Scans and sinks on landed files."""

import datetime
import json

from pyspark.sql import functions as F

from feedscope.functions import rules
from feedscope.sources import html, logs


def test_source_registry(spark, tmp_path):
    rows = [{"naam": "A", "url": "u", "in_scope": False}, {"name": "B", "type": "atom", "tier": "community", "inScope": True}, {"url": "nameless"}]
    for name, doc in (("list", rows), ("feeds", {"feeds": rows}), ("sources", {"sources": rows})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
        got = {r.name: r for r in logs.read_sources(spark, str(tmp_path / f"{name}.json")).collect()}
        assert set(got) == {"A", "B"}
        assert (got["A"].type, got["A"].tier, got["A"].vendor, got["A"].in_scope) == ("rss", "primary", "-", False)
        assert (got["B"].type, got["B"].tier, got["B"].in_scope) == ("atom", "community", True)


def test_log_skips_malformed_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in logs.read_log(spark, str(tmp_path / "l.jsonl"), "a int").where("a IS NOT NULL").collect()) == [1, 2]


def test_rss(spark, tmp_path):
    item = "<item><guid>g{0}</guid><title>T{0}</title><link>http://x/{0}</link><description>{1}</description><pubDate>Fri, 05 Jan 2024 10:00:00 +0100</pubDate></item>"
    (tmp_path / "f.xml").write_text("<rss><channel>" + "".join(item.format(k, "d" * 3000) for k in range(5)) + "</channel></rss>")
    got = logs.read_items_xml(spark, str(tmp_path / "f.xml"), limit=3).orderBy("id").collect()
    assert [r.id for r in got] == ["g0", "g1", "g2"] and len(got[0].summary) == 2000
    assert got[0].published.replace(tzinfo=None) == datetime.datetime(2024, 1, 5, 9)


def test_markdown(spark, tmp_path):
    (tmp_path / "a.md").write_text('---\ntitle: "Hello"\ntopics: [llms, agents]\n---\nBody text\n')
    (tmp_path / "b.md").write_text("---\nkind: x\n---\nno title\n")
    (r,) = logs.read_markdown(spark, str(tmp_path)).collect()
    assert (r.title, r.kind, r.format, r.topics, r.body.strip()) == ("Hello", "research", "news", ["llms", "agents"], "Body text")


def test_archive_replaces_only_its_months(spark, tmp_path):
    s = "id int, at date"
    path = str(tmp_path / "a")
    logs.write_archive(spark.createDataFrame([(1, datetime.date(2024, 1, 5)), (2, datetime.date(2024, 2, 5))], s), path, "at")
    logs.write_archive(spark.createDataFrame([(3, datetime.date(2024, 2, 6))], s), path, "at")
    assert {r.id for r in spark.read.parquet(path).collect()} == {1, 3}


def test_digest_matches_its_rule(spark):
    import hashlib

    # names that recorded readings have: the last part is the digest of their conditions
    recorded = {"f86b": (True, None, "edit format: diff"), "69ec": (True, "unknown", "agent: Droid; stderr 0.0247"), "cfb2": (True, None, "agent: Codex CLI; stderr 0.0266"), "6c27": (True, None, "agent: Terminus 2; stderr 0.028"), "c676": (None, None, "Self-reported in the model card; conditions not stated")}
    df = spark.createDataFrame([(k, *v) for k, v in recorded.items()], "want string, tools boolean, effort string, notes string")
    digest = rules.conditions_digest([("tools", F.col("tools")), ("reasoningEffort", F.col("effort")), ("notes", F.col("notes"))])
    assert all(r.want == r.got for r in df.select("want", digest.alias("got")).collect())
    typed = rules.conditions_digest([("b", F.lit(0)), ("a", F.lit(0.5)), ("c", F.lit('x "y"\n'))])
    assert spark.range(1).select(typed).first()[0] == hashlib.sha256(json.dumps({"a": 0.5, "b": 0, "c": 'x "y"\n'}).encode()).hexdigest()[:4]
    got = spark.range(1).select(rules.conditions_digest([("shots", F.lit("5")), ("notes", F.lit("a é")), ("x", F.lit("")), ("y", F.lit(None).cast("string"))])).first()[0]
    assert got == hashlib.sha256('{"notes": "a é", "shots": "5"}'.encode()).hexdigest()[:4]


def test_publisher_about_itself(spark):
    rows = spark.createDataFrame([("Acme Weekly", "Acme opens a newsroom"), ("Acme Weekly", "Acme ships"), ("AI", "AI newsroom")], "s string, t string")
    assert [r[0] for r in rows.select(rules.about_itself(F.col("s"), F.col("t"), "newsroom|editor")).collect()] == [True, False, False]


def test_atom_and_papers(spark, tmp_path):
    entry = '<entry><id>http://arxiv.org/abs/2401.0000{0}v{1}</id><title>A\n  title {0}</title><link href="http://arxiv.org/abs/2401.0000{0}v{1}" rel="alternate" type="text/html"/><link href="http://pdf/{0}" rel="related"/><summary>Words  of\n{0}</summary><updated>2024-01-0{1}T10:00:00Z</updated></entry>'
    (tmp_path / "a.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>' + "".join(entry.format(k, v) for k, v in ((1, 1), (2, 3), (3, 1))) + "</feed>")
    rss = "<item><link>http://arxiv.org/abs/2402.0000{0}v2</link><title>R{0}</title><description>arXiv:2402 Announce Type: {1} \nAbstract: of {0}</description></item>"
    (tmp_path / "r.xml").write_text("<rss><channel>" + "".join(rss.format(k, t) for k, t in ((1, "new"), (2, "replace-cross"), (3, "cross"))) + "<item><title>no paper</title><link>http://else</link></item></channel></rss>")
    rows = logs.read_items_xml(spark, str(tmp_path), None, None)
    got = {r.id: r for r in rows.collect()}
    assert got["http://arxiv.org/abs/2401.00001v1"].url == "http://arxiv.org/abs/2401.00001v1" and got["http://arxiv.org/abs/2401.00002v3"].published.replace(tzinfo=None) == datetime.datetime(2024, 1, 3, 10)
    papers = {r.id: (r.title, r.abstract, r.announce_type) for r in logs.papers(rows).collect()}
    assert papers == {"2401.00001": ("A title 1", "Words of 1", "new"), "2401.00003": ("A title 3", "Words of 3", "new"), "2402.00001": ("R1", "of 1", "new"), "2402.00003": ("R3", "of 3", "cross")}


def test_fixture(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"items": [{"id": "1", "title": "A", "published": "2024-01-02T00:00:00Z", "source": {"naam": "S", "tier": "community"}}, {"id": "2", "source": {"name": "T"}}]}))
    assert sorted((r.id, r.title, r.source, r.tier, r.vendor, r.published is None) for r in logs.read_fixture(spark, str(tmp_path)).collect()) == [("1", "A", "S", "community", "-", False), ("2", "", "T", "primary", "-", True)]


def test_profile(spark):
    from feedscope.plans import profile

    rules_ = {
        "topics": {"t": "x"}, "sections": {"s": "y"}, "exclude": {"a": "1", "b": "2"}, "active": ["b"], "quality": {"mechanism": "m", "result": "r", "number": "[0-9]", "verifiable": "v", "gate": 50.0},
        "strong": [{"topic": "Deep Nets", "signals": []}], "medium": [{"topic": "k", "signals": ["One", "two"]}], "low": ["Robots"], "section": "s",
    }
    p = profile.interest_profile(profile.parse(json.dumps(rules_)))
    assert p.exclude == (("b", "2"),) and p.quality.gate == 50.0 and p.interests.strong == (("Deep Nets", ("deep nets",)),) and p.interests.medium == (("k", ("one", "two")),) and p.interests.low == ("robots",)
    assert profile.quotas({"buckets": {"a": {"keywords": [], "min_per_digest": 3}, "b": {"keywords": []}}}) == {"a": 3, "b": 0}


def test_own_scorer(spark):
    """A scorer sees only what no cheaper stage drops, and what it leaves out fails the gate."""
    from feedscope import queries as Q
    from feedscope.plans import funnel

    seen = []

    def scorer(df):
        seen.append({r.id for r in df.select("id").collect()})
        return df.where("id % 2 = 0").select("id", F.lit(99.0).alias("quality"))

    sf = "/root/testdata/sf0.001"
    out = funnel.score_items(Q.items(spark, sf), Q.seen_urls(spark, sf), Q.PROFILE, F.lit("2024-02-10").cast("date"), scorer=scorer).select("id", "quality", "reason").collect()
    early = {r.id for r in out if r.reason in ("duplicate", "excluded", "no_topic")}
    assert seen[0] == {r.id for r in out} - early
    assert all((r.reason is None) == (r.id % 2 == 0) for r in out if r.id not in early)


def test_posts_with_nested_front_matter(spark, tmp_path):
    (tmp_path / "a.v1.md").write_text('---\ntitle: "Hello: world"\npubDate: 2024-01-01\ntopics: [llms, "agents", ]\nsource:\n  name: "X"\n  url: https://x/1\nkind: release\nscout:\n  score: 7\ntitle: Again\n---\nBody\n---\nmore')
    (tmp_path / "b.md").write_text("---\nkind: x\n---\nno title\n")
    (tmp_path / "c.md").write_text("no front matter")
    (r,) = logs.read_posts(spark, str(tmp_path)).collect()
    assert (r.slug, r.title, r.pub_date, r.kind, r.format, r.topics, r.source_url, r.body) == ("a.v1", "Again", "2024-01-01", "release", "news", ["llms", "agents"], "https://x/1", "Body\n---\nmore")
    assert r.front["scout.score"] == "7" and r.front["source.name"] == "X" and "source" not in r.front


def test_records_as_variants(spark, tmp_path):
    (tmp_path / "gpt-4.1.json").write_text('{"value": 3.5, "conditions": {"shots": 2, "tools": [true]}}')
    (tmp_path / "bad.json").write_text('{"value": ')
    (tmp_path / "list.json").write_text("[1, 2]")
    rows = logs.read_records(spark, str(tmp_path)).selectExpr("id", "broken", "try_variant_get(record, '$.conditions.shots', 'int') AS shots", "try_variant_get(record, '$.value', 'double') AS value")
    assert {tuple(r) for r in rows.collect()} == {("gpt-4.1", False, 2, 3.5), ("bad", True, None, None), ("list", False, None, None)}


def test_records_by_lines(spark, tmp_path):
    (tmp_path / "all.json").write_text('{"value": 3.5, "note": "two\\nlines"}\n{"value": \n[1, 2]\n')
    rows = logs.read_records(spark, str(tmp_path), lines=True).selectExpr("id", "broken", "try_variant_get(record, '$.value', 'double') AS value")
    assert sorted(map(tuple, rows.collect()), key=repr) == [("all", False, 3.5), ("all", False, None), ("all", True, None)]


def test_landed_records_need_few_files(spark, sf, tmp_path, monkeypatch):
    from feedscope import story_queries

    spark.range(500).selectExpr("id AS s_suppkey", "int(id % 25) AS s_nationkey", "double(id - 10) AS s_acctbal").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(story_queries.shared, "folder", lambda spark: str(tmp_path / "landed"))
    assert story_queries.landed_records(spark, str(tmp_path)).count() == 490
    assert len(list((tmp_path / "landed").rglob("part-*"))) <= 4


def test_few_pages_are_objects_at_a_time(spark):
    import pyarrow as pa

    class Batches:
        """Stands for a DataFrame whose rows come to a task in one batch."""

        select = lambda self, *_: self

        def mapInArrow(self, f, schema):
            n = 1000
            one = pa.record_batch([pa.array(range(n)), pa.array(["http://x/"] * n), pa.array(["<h1>A heading of a page</h1>"] * n)], names=["page_id", "url", "html"])
            return [b.num_rows for b in f(iter([one]))]

    for scan in (html.page_text, html.page_items):
        rows = scan(Batches())
        assert sum(rows) == 1000 and max(rows) <= 64
