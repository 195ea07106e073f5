"""Releases, mentions, grounding, claims, display, landed scans, budgets and the expiring queue against plain Python."""

import datetime
import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedscope.functions import display, release
from feedscope.operators import archive, grounding, mentions, windows
from feedscope.sources import boards
from feedscope.streaming import jobs


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(
    ("name", "version", "major"),
    [("Astra 6", "6", True), ("GPT-6.1", "6.1", True), ("gpt-4o-2024-08-13", "2024-08-13", False), ("Ministral-2512", "2512", False), ("nothing", "", False), ("a 1.05 million", "1.05", True), ("Model-3b", "", False)],
)
def test_versions(spark, name, version, major):
    v = release.version_of(F.lit(name))
    assert one(spark, v, release.is_major(v)) == [version, major]


def test_release_ladder_order(spark):
    rules = release.EventRules("(?i)ollama", "(?i)deprecat", "(?i)introducing", "(?i)now available", "(?i)tool use")
    cases = [
        (("x", "", True, False, "", False), "new_model"), (("Ollama 0.4", "deprecated", False, True, "4", True), "none"), (("Farewell", "is deprecated", False, True, "4", True), "deprecation"),
        (("Hello", "", False, True, "", True), "new_model"), (("Introducing Y", "", False, True, "5", False), "version_bump"), (("Introducing Y", "", False, False, "5", False), "new_model"),
        (("Y now available with tool use", "", False, True, "5", False), "availability"), (("Y", "tool use", False, True, "5", False), "capability_update"), (("Y 5", "", False, True, "5", False), "version_bump"), (("Y", "", False, False, "", False), "none"),
    ]
    df = spark.createDataFrame([(*c, want) for c, want in cases], "title string, body string, hub boolean, known boolean, version string, fresh boolean, want string")
    got = df.select(release.release_event(*(F.col(c) for c in ("title", "body", "hub", "known", "version", "fresh")), rules).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_fresh_and_claims(spark):
    day = lambda x: F.lit(x).cast("date")
    assert one(spark, release.is_fresh(day("2024-01-15"), day("2024-01-01")), release.is_fresh(day("2024-01-16"), day("2024-01-01")), release.is_fresh(day(None), day("2024-01-01"))) == [True, False, False]
    texts = ("98% on FrontierMath", "74.2 on FrontierMath", "beats FrontierMath", "costs 20% less")
    assert one(spark, *[release.claims_a_score(F.lit(t), "(?i)frontiermath") for t in texts]) == [True, True, False, False]


WORDS = ["gpt", "astra", "alpha", "ab", "opus", "opusx", "zeta", "é", "alphabet"]


def test_occurrences_and_longest(spark):
    rng = random.Random(3)
    texts = [(k, " ".join(rng.choices(WORDS, k=rng.randrange(0, 7)))) for k in range(80)] + [(98, None), (99, "")]
    names = [(0, "m0", "Astra"), (1, "m1", "Opus"), (2, "m2", "OpusX"), (3, "m3", "alpha"), (4, "m4", "alpha"), (5, "m5", "gpt"), (6, "m6", "alpha opus")]
    got = {r["id"]: r["model"] for r in mentions.longest_known(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(names, "ord int, model string, name string")).collect()}
    want = {}
    for k, t in texts:
        hits = [(len(n), -t.find(n.lower()), -o, m) for o, m, n in names if t and len(n) >= 4 and n.lower() in t]
        if hits:
            want[k] = max(hits)[3]
    assert got == want


def test_corroborate(spark):
    rng = random.Random(5)
    old, new = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 2, 1)
    items = [(k, " ".join(rng.choices(WORDS, k=5)).title(), rng.choice([old, new, None])) for k in range(120)]
    families = ["gpt-astra", "opus", "alpha-zeta-ab", "ab", "", None, "nowhere-opus", "opus-opus"]
    c = spark.createDataFrame(list(enumerate(families)), "candidate int, family string")
    got = mentions.corroborate(c, spark.createDataFrame(items, "id long, text string, published timestamp"), F.lit("2024-02-02").cast("timestamp")).collect()
    want = set()
    for k, f in enumerate(families):
        parts = [p for p in (f or "").split("-") if len(p) > 2]
        want |= {(k, i) for i, t, p in items if p != old and parts and all(x in t.lower() for x in parts)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize(("version", "text", "want"), [("6", "47% less in 6 days", True), ("6", "46 and 6% and 1.6", False), ("4.8", "Opus 4.8 is", True), ("4.8", "4.8.1", False), ("2026-09-03", "on 2026-09-03,", True), ("2026-09-03", "on 2026-09-031", False)])
def test_version_in_text(spark, version, text, want):
    assert one(spark, grounding.version_in(F.lit(version), F.lit(text))) == [want]


def test_entity_grounding(spark):
    r = spark.createDataFrame([(1, "gpt-astra", "6"), (2, "gpt-astra", "7"), (3, "claude", None), (4, "", ""), (5, "x", "1")], "id int, family string, version string")
    s = spark.createDataFrame([(1, "GPT Astra 6 is out"), (2, "Astra-Six beats 47%"), (3, "nothing"), (4, "a")], "id int, text string")
    reg = spark.createDataFrame([("gpt-astra", ["Astra Six"])], "family string, names array<string>")
    assert {x["id"]: x["missing"] for x in grounding.entity_grounding(r, s, reg).collect()} == {1: [], 2: ["version"], 3: ["family"], 4: ["family"], 5: ["family", "version"]}


def test_reference_integrity(spark):
    d = spark.createDataFrame(
        [(1, "scores 91.2% and 0.912 on tier 4", ["a"]), (2, "1,250 points and 3.5", ["a", "b"]), (3, "7.1", ["zz", "a"]), (4, "9.9", []), (5, None, ["a"]), (6, "2k and 5", None)], "id int, body string, refs array<string>"
    )
    m = spark.createDataFrame([("a", 91.2), ("b", 1250.0)], "id string, value double")
    got = {r["id"]: (r["n_refs"], r["dangling"], r["untraced"]) for r in grounding.reference_integrity(d, m).collect()}
    assert got == {1: (1, [], []), 2: (2, [], ["3.5"]), 3: (2, ["zz"], ["7.1"]), 4: (0, [], ["9.9"]), 5: (1, [], []), 6: (0, [], ["2k"])}


def test_a_figure_is_read_once(spark):
    d = spark.createDataFrame([(1, "scores 91.2%", ["a"])], "id int, body string, refs array<string>")
    m = spark.createDataFrame([("a", 91.2)], "id string, value double")
    plan = grounding.reference_integrity(d, m)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map(") <= 1  # the units of a figure's value


BENCH = (("alpha", "Alpha(?:\\s+Pro)?"), ("beta", "Beta"))


def plain_claims(pid, body, url, model):
    rows = []
    for k, s in enumerate(re.split(r"(?<=[.!?])\s+", re.sub(r"\s+", " ", body))):
        named = sorted([(m.start(), b) for b, p in BENCH if (m := re.search(p, s, re.I))] + [(m.start(), None) for m in re.finditer("Zork", s, re.I)], key=lambda x: x[0])
        scores = [re.match(r"[\d.]+", m.group(0)).group(0) for m in re.finditer(grounding.SCORE, s)]
        for i, (_, b) in enumerate(named):
            if b is None and not scores:
                continue
            skip = "untracked" if b is None else "no_figure" if not scores else "no_source" if not url else "no_attribution" if not re.search("reports", s, re.I) else "no_model" if not model else "count_mismatch" if len(named) != len(scores) else None
            rows.append((pid, model, k, b, None if skip else float(scores[i]), skip))
    return rows


def test_claims(spark):
    rng = random.Random(11)
    bits = ["Alpha Pro", "beta", "Zork", "12.5%", "40 %", "7.1", "it reports", "and", "no.", "yes!", "then", "5"]
    posts = [(k, " ".join(rng.choices(bits, k=rng.randrange(1, 14))), rng.choice(["u", None, "u"]), rng.choice(["m", None, "m"])) for k in range(150)] + [(900, "", "u", "m"), (901, "It reports Beta at 12.5% and Alpha at 7.1.", "u", "m")]
    df = spark.createDataFrame(posts, "id long, body string, url string, model string")
    got = [tuple(r) for r in grounding.claims(df, BENCH, "Zork", "(?i)reports").collect()]
    assert sorted(map(repr, got)) == sorted(repr(r) for p in posts for r in plain_claims(*p))
    assert (901, "m", 0, "beta", 12.5, None) in got and (901, "m", 0, "alpha", 7.1, None) in got


def test_display(spark):
    v = lambda x, u: display.value_text(F.lit(x), F.lit(u))
    assert one(spark, v(91.24, "percent"), v(1250.5, "elo"), v(3.14159, "usd"), v(2.04, "seconds"), v(1.04, "other")) == ["91.2%", "1251", "$3.14", "2.0s", "1.0"]
    parts = (("effort ", F.lit("high")), ("", F.lit("zero-shot")), ("temp ", F.lit(0.5)), ("harness ", F.lit(" ")), ("", F.lit(None).cast("string")), ("", display.cut(F.lit("x" * 95), 90)))
    assert one(spark, display.summary(parts), display.summary(parts[3:5])) == ["effort high · zero-shot · temp 0.5 · " + "x" * 90 + "…", ""]
    clauses = {"a": ((F.lit(True), F.lit("One did it")), (F.lit(None).cast("boolean"), F.lit("another")), (F.lit(True), F.lit("two read it")))}
    assert one(spark, display.disclosure(F.lit("a"), clauses), display.disclosure(F.lit("b"), clauses)) == ["One did it; two read it.", None]


def test_scans(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"id": 7, "title": "A", "publishedAt": "2024-01-02T03:04:05Z"}, {"_id": "b", "url": "u"}, "text", {"title": "C"}, {}]))
    (tmp_path / "one.json").write_text(json.dumps({"title": "D"}))
    (tmp_path / "bad.json").write_text("<html>")
    got = {(r["source"], r["id"]): (r["title"], r["url"], r["published"]) for r in boards.endpoint_items(boards.read_payloads(spark, str(tmp_path))).collect()}
    assert got == {("e", "7"): ("A", "e", datetime.datetime(2024, 1, 2, 3, 4, 5)), ("e", "b"): ("b", "u", None), ("e", "C"): ("C", "e", None), ("e", ""): ("", "e", None), ("one", "D"): ("D", "one", None)}
    hub = spark.createDataFrame([("h", json.dumps([{"modelId": "o/a", "tags": ["t"]}, {"id": "o/b-GGUF"}, {"id": "o/c"}, {"id": ""}]))], "source string, payload string")
    assert sorted((r["id"], r["url"], r["tags"]) for r in boards.hub_items(hub, "https://h/").collect()) == [("hub:o/a", "https://h/o/a", ["t"]), ("hub:o/c", "https://h/o/c", [])]
    rows = [
        {"modelId": "m", "value": 0.9444, "source": {"url": "https://h/m"}}, {"modelId": "n", "value": "94.44", "notes": " x ", "source": {"url": "https://h/n", "isExternal": False}}, {"modelId": "o", "value": 1, "pullRequest": 3, "source": {"url": "https://h/o"}},
        {"modelId": "p", "value": 1, "source": {"url": "https://h/q"}}, {"modelId": "q", "value": "?", "source": {"url": "https://h/q"}}, {"modelId": "r", "value": 1, "source": {"url": "https://h/r", "isExternal": True}}, {"value": 2},
    ]
    board = spark.createDataFrame([("b", json.dumps(rows))], "source string, payload string")
    assert sorted((r["model"], r["value"], r["notes"][-10:]) for r in boards.board_claims(board, "https://h/", F.lit(True)).collect()) == [("m", 94.44, "ns unknown"), ("n", 94.44, "l's page: x"[-10:])]


def test_bundle(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Model version,Score,Date,Link\nx,0.5,2025-02-03,see https://no\ny,,2025-02-03,\nz,0.25,2024-01-01,\n,0.1,2025-05-05,\nw,1,,https://l\n")
    (tmp_path / "b.csv").write_text("Model version,Elo,Started\nv,1200.1234,2025-03-04T10:00\n")
    files = [boards.BundleFile("a.csv", "A", "Score"), boards.BundleFile("b.csv", "B", "Elo", percent=False, internal=False), boards.BundleFile("c.csv", "C", "S")]
    got = boards.read_bundle(spark, str(tmp_path), files, ["Date", "Started"], ["Link"], "Model version", "2025-01-01")
    assert sorted((r["benchmark"], r["version"], r["value"], str(r["measured_at"]), r["url"], r["measured_by"]) for r in got.collect()) == [("A", "x", 50.0, "2025-02-03", None, "thirdparty"), ("B", "v", 1200.123, "2025-03-04", None, "community")]
    with pytest.raises(FileNotFoundError):
        boards.read_bundle(spark, str(tmp_path), [files[2]], ["Date"], ["Link"], "Model version", "2025-01-01")


def plain_budget(rows, limits, attempts):
    done, out, stop = 0, {}, None
    for k, (i, _, ok) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0]))):
        if stop is None:
            stop = next((n for n, x in limits if x is not None and done >= x), "attempts" if k >= attempts else None)
        out[i] = ("queued", stop) if stop else ("published" if ok else "failed", None)
        done += ok and not stop
    return out


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.booleans()), min_size=1, max_size=14), st.integers(0, 3), st.integers(0, 4) | st.none(), st.integers(1, 6))
def test_budget(spark, rows, cap, day, attempts):
    rows = [(k, float(s), ok) for k, (s, ok) in enumerate(rows)]
    df = spark.createDataFrame([("s", *r) for r in rows], "section string, id int, score double, ok boolean")
    got = windows.budgeted(df, spark.createDataFrame([("s", cap, day)], "section string, cap int, day int"), ["cap", "day"], attempts)
    assert {r["id"]: (r["outcome"], r["reason"]) for r in got.collect()} == plain_budget(rows, [("cap", cap), ("day", day)], attempts)


def test_replies(spark):
    replies = spark.createDataFrame([(1, 10, " fix it "), (2, 11, "None"), (3, None, None)], "message int, reply_to int, text string")
    got = archive.requests(replies, spark.createDataFrame([(10, "i")], "message int, item string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, "i", "item", "fix it"), (2, None, "standalone", None), (3, None, "standalone", None)]))


def test_queue_expiry_in_batches(spark, tmp_path):
    """Landing the puts in several files gives what one file gives."""
    rng = random.Random(2)
    start = datetime.datetime(2024, 1, 1)
    puts = sorted((start + datetime.timedelta(hours=rng.randrange(24 * 30)), rng.randrange(6), float(k)) for k in range(120))
    schema = "at timestamp, key long, score double"
    results = []
    for n in (1, 4):
        for k in range(n):
            spark.createDataFrame(puts[k * 120 // n : (k + 1) * 120 // n], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{n}"))
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"in{n}"))
        results.append(sorted(map(tuple, jobs.run_once(jobs.queue_expiry(s), f"q{n}", str(tmp_path / f"c{n}")).collect())))
    want = []
    for key in range(6):
        entry = None
        for at, k, score in [*puts, (puts[-1][0] - datetime.timedelta(days=1), key, None)]:
            if k == key and entry and at > entry[0] + datetime.timedelta(days=7):
                want.append((key, *entry))
                entry = None
            if k == key and score is not None:
                entry = (entry[0], score, entry[2] + 1) if entry else (at, score, 1)
    assert results[0] == results[1] == sorted(want)


def test_queue_expiry_to_the_millisecond(spark, tmp_path):
    """Times are rounded, not cut, to milliseconds; an entry whose time ends at the watermark itself has waited long enough."""
    at = datetime.datetime(2024, 1, 1, 12, 0, 0, 999_700)
    second = datetime.datetime(2024, 1, 1, 12, 0, 1)
    puts = [(at, 1, 1.0), (at + datetime.timedelta(microseconds=100), 1, 0.5), (second + datetime.timedelta(days=8), 2, 3.0)]
    schema = "at timestamp, key long, score double"
    spark.createDataFrame(puts, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert list(map(tuple, jobs.run_once(jobs.queue_expiry(s), "q", str(tmp_path / "c")).collect())) == [(1, second, 0.5, 2)]


def test_claims_behind_two_thousand_characters(spark, tmp_path):
    from feedscope import tracking_queries

    text = "word " * 800 + ". It reports heit at 55.5%"
    spark.createDataFrame([(1, text, "en", "src1")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert 55.5 in {r.value for r in tracking_queries.claims_in_prose(spark, str(tmp_path)).collect()}
