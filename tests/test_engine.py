"""The engine: every query against its SQL, and small rules against plain Python."""

import datetime
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from feedscope import feed_queries, more_queries, queries as Q, story_queries, tracking_queries  # noqa: F401
from feedscope.functions import text as T
from feedscope.operators import aggs, joins, windows
from feedscope.sources import html

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6g}"
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, sf, name):
    df = Q.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    if name not in Q.oracle_sql():
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(Q.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    assert got == sorted(repr([norm(dict(zip(names, r, strict=True))[c]) for c in cols]) for r in cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def one(spark, col, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(col).first()[0]


def plain_numbers(text):
    """The numbers of a text by reading it letter by letter: [(as written, value, is a percentage)]."""
    units = {"k": 1e3, "m": 1e6, "mn": 1e6, "b": 1e9, "bn": 1e9, "t": 1e12, "thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}
    word = lambda c: c.isalnum() or c == "_"
    ends = lambda i: not (i < len(text) and (word(text[i]) or text[i] == "." and text[i + 1 : i + 2].isdecimal()))
    out, i = [], 0
    while i < len(text):
        if not text[i].isdecimal() or i and (word(text[i - 1]) or text[i - 1] == "."):
            i += 1
            continue
        stops = []  # where the digits may end, the longest first
        j = i
        while text[j : j + 1].isdecimal():
            j += 1
        grouped, k = [], j
        if j - i <= 3:
            while text[k : k + 1] == "," and len(text[k + 1 : k + 4]) == 3 and text[k + 1 : k + 4].isdecimal():
                k += 4
                grouped.append(k)
        for whole in [*reversed(grouped), *range(j, i, -1)]:
            e = whole
            if text[e : e + 1] == "." and text[e + 1 : e + 2].isdecimal():
                e += 1
                while text[e : e + 1].isdecimal():
                    e += 1
                stops += range(e, whole + 1, -1)
            stops.append(whole)
        for e in stops:
            blank = lambda x: x + len(text[x:]) - len(text[x:].lstrip())
            tails = []
            for u in sorted(units, key=len, reverse=True):
                if text[blank(e) : blank(e) + len(u)].lower() == u:
                    tails.append((blank(e) + len(u), units[u]))
            tails.append((e, 1.0))
            hit = None
            for end, scale in tails:
                if text[blank(end) : blank(end) + 1] == "%" and ends(blank(end) + 1):
                    hit = (blank(end) + 1, scale, True)
                elif ends(end):
                    hit = (end, scale, False)
                if hit:
                    break
            if hit:
                out.append((text[i : hit[0]].strip(), round(float(text[i:e].replace(",", "")) * hit[1], 6), hit[2]))
                i = hit[0]
                break
        else:
            i += 1
    return out


def plain_values(text):
    return {x for _, v, percent in plain_numbers(text) for x in (v, round(v / 100 if percent else v * 100, 6))}


CASES = ["1,050,000 and 1.05M", "12.5% or 12.5 %", "1.5k", "98%", "none v4.5x", "3 billion", "3D and 10th, 3mn, 2t", "up from 61.5% for 2.0.", "GPT-4.1 v2.5 and Opus 4.5", "$ 1.25 1,25 1,0500 12,345.6k 4.5.6", "7 t 8 th 9 %x", ""]


@pytest.mark.parametrize("text", CASES)
def test_numbers(spark, text):
    assert set(one(spark, T.numbers(F.col("t")), t=text)) == plain_values(text)


def test_number_cases(spark):
    cases = {"1,050,000": 1050000.0, "1.05M": 1050000.0, "98%": 0.98, "1.5k": 1500.0, "2.05M": 2050000.0, "3mn": 3e6, "2t": 2e12}
    for text, value in cases.items():
        assert value in one(spark, T.numbers(F.col("t")), t=text)
    assert one(spark, T.numbers(F.col("t")), t="3D 10th") == []
    assert one(spark, T.stated(F.col("t"), names=False), t="GPT-4.1 has v2.5 but Opus 4.5") == ["4.5"]


def test_ungrounded(spark):
    check = T.ungrounded(T.stated(F.col("a"), names=False), T.numbers(F.col("b")))
    assert one(spark, check, a="2.05M and 12.5% and 7, GPT-9", b="a rate of 0.125, and 7") == ["2.05M"]
    source = "The context window is 1,050,000 tokens. Latency fell 12.5%. It costs $1.25."
    for text in ("A 1.05M token window.", "1050000 tokens.", "Latency fell 12.5 %.", "It costs $ 1.25."):
        assert one(spark, check, a=text, b=source) == []


def test_numeric_grounding_on_the_documents(spark, sf):
    """The whole table against reading letter by letter."""
    import re

    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        h = len(r.text) // 2
        source = plain_values(r.text[:h])
        draft = plain_numbers(re.sub(r"[A-Za-z][\w.-]*\d[\w.-]*", " ", r.text[h:]))
        bad = {x for x, v, _ in draft if not {v, round(v / 100, 6), round(v * 100, 6)} & source}
        want[r.doc_id] = (len(draft), sorted(bad))
    assert {r.id: (r.n, r.offending) for r in Q.queries()["numeric_grounding"](spark, sf).collect()} == want


def test_unique_slugs(spark):
    """In order, each row the first free name; also where a given name looks like a numbered one."""
    rng = random.Random(21)
    for bases in (["a", "a", "a-2"], ["a-2", "a", "a", "a"], [rng.choice(["a", "a-2", "a-3", "a-2-2", "b", "a-02", "post"]) for _ in range(200)]):
        want, taken = [], set()
        for b in bases:
            name, n = b, 2
            while name in taken:
                name, n = f"{b}-{n}", n + 1
            taken.add(name)
            want.append(name)
        got = windows.unique_slugs(spark.createDataFrame(list(enumerate(bases)), "id long, base string").repartition(3), "base", "id").orderBy("id").collect()
        assert [r.slug for r in got] == want and len(set(want)) == len(want)


def test_measurement_upsert_on_the_readings(spark, sf):
    m = Q.measurements(spark, sf).collect()
    row = lambda r: (r.seq, r.id, (r.benchmark, r.model, r.conditions), r.value, r.measured_at)
    by = {}
    for r in m:
        by.setdefault((r.benchmark, r.model, r.conditions), []).append(row(r))
    want = [x for rows in by.values() for x in fold([r for r in rows if r[0] % 4 == 0], [r for r in rows if r[0] % 4])]
    got = Q.queries()["measurement_upsert"](spark, sf).collect()
    assert sorted(((r.id, r.action, r.supersedes) for r in got), key=str) == sorted(want, key=str)


def test_source_health(spark):
    reg = spark.createDataFrame([("a", "feed", True), ("b", "feed", True), ("c", "probe", True), ("d", "fax", True), ("e", "page", False)], "source string, kind string, verified boolean")
    day = datetime.date(2024, 1, 2)
    got = aggs.source_health(reg, spark.createDataFrame([("a", day), ("a", None), ("z", day)], "source string, published date")).collect()
    assert {r.source: tuple(r)[1:] for r in got} == {"a": ("OK", 2, day, 1, False), "b": ("FAIL", 0, None, 0, True), "c": ("PROBE", 0, None, 0, False), "d": ("SKIP", 0, None, 0, False), "e": ("FAIL", 0, None, 0, False)}


def test_text_functions(spark):
    assert one(spark, T.slug(F.col("t")), t=" Hello, World! ") == "hello-world" and one(spark, T.slug(F.col("t")), t="--") == "post"
    assert one(spark, T.title_tokens(F.col("t")), t="The GPT-5 of a B 7 gpt") == ["gpt", "5", "7"]
    assert one(spark, T.title_tokens(F.col("t")), t="Introducing the era of we, was and has") == ["we", "was", "has"]
    assert one(spark, T.excerpt(F.col("t"), 12), t="words are cut here") == "words are…"
    assert one(spark, T.reading_minutes(F.col("t")), t="w " * 500) == 3


def test_keyword_score(spark):
    buckets = {"llm": (1.0, ("agent", "rlhf")), "rl": (1.0, ("policy",)), "late": (2.0, ("agent",))}
    s = T.keyword_score(F.col("t"), buckets, (0.35, ("clinical",)), ("survey of",))
    assert tuple(one(spark, s, t="agent rlhf policy")) == (2.0, "llm")
    assert tuple(one(spark, s, t="agent rlhf clinical")) == (0.7, "llm")
    assert tuple(one(spark, s, t="a survey of agent")) == (0.0, None) and tuple(one(spark, s, t="x")) == (0.0, None)


def test_changelog_and_index_pages():
    change = "<h1>Notes</h1><h2>September 22, 2026</h2><ul><li>The first bullet that is long enough to count</li><li>short</li></ul><h2>August 1, 2026</h2><p>Another paragraph that is surely long enough</p>"
    got = html.items_of("https://x/log", change)
    assert [g[2] for g in got] == ["2026-09-22", "2026-08-01"]
    index = "<nav><h2>Navigation heading</h2></nav><h2><a href='/a'>First long headline</a></h2><h3>tiny</h3><a href='b'><h3>Second long headline</h3></a>"
    assert [(g[1], g[2], g[3]) for g in html.items_of("https://x/i/", index)] == [("First long headline", "", "https://x/a"), ("Second long headline", "", "https://x/i/b")]
    assert html.items_of("u", "") == []
    assert [html.heading_date(x) for x in ("Sep 22, 2026", "September 22, 2026 - notes", "Sep 31, 2026", "22 Sep 2026", "Sept 1, 2026")] == ["2026-09-22", "2026-09-22", "", "", "2026-09-01"]
    nested = html.items_of("https://x/log", "<h2 id='d'>Sep 22, 2026</h2><ul><li>Added <p>something that is long enough to be read</p></li><li>A second entry, with <b>bold</b> text and more</li></ul><h3>On this page</h3><p>Not part of any day, so it is left out</p>")
    assert [(g[1], g[3]) for g in nested] == [("Added something that is long enough to be read", "https://x/log#d"), ("something that is long enough to be read", "https://x/log#d"), ("A second entry, with bold text and more", "https://x/log#d")]
    after = html.items_of("https://x/i", "<h2>A headline without a link</h2><p>text</p><a href='/next'>read</a><h2>Another headline here</h2>")
    assert [g[3] for g in after] == ["https://x/next", "https://x/i"]
    long = "A headline of many words " * 20
    assert len({g[0] for g in html.items_of("u", f"<h2>{long}one</h2><h2>{long}two</h2>")}) == 2


def test_pages_against_a_plain_reader(spark, sf):
    """Text and items of all pages, by a reader that keeps a tree of open tags."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.text, self.heads = 0, [], []
            self.inside = False

        def handle_starttag(self, tag, attrs):
            self.depth += tag in ("script", "style", "nav", "header", "footer", "aside", "form")
            if not self.depth and tag in ("h1", "h2", "h3", "h4"):
                self.heads.append([])
                self.inside = True
            if not self.depth and tag in ("li", "p"):
                self.inside = False

        def handle_endtag(self, tag):
            self.depth -= tag in ("script", "style", "nav", "header", "footer", "aside", "form")
            if tag in ("h1", "h2", "h3", "h4"):
                self.inside = False

        def handle_data(self, data):
            if not self.depth:
                self.text.append(data)
                if self.inside:
                    self.heads[-1].append(data)

    text = {r.page_id: r.text for r in Q.queries()["page_text"](spark, sf).collect()}
    items = {}
    for r in Q.queries()["page_items"](spark, sf).orderBy("page_id", "pos").collect():
        items.setdefault(r.page_id, []).append(r.text)
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(text) == len(pages)
    for r in pages:
        p = Plain()
        p.feed(r.html or "")
        p.close()
        assert text[r.page_id] == " ".join(" ".join(p.text).split())
        heads = list(dict.fromkeys(" ".join(" ".join(h).split()) for h in p.heads))
        assert items.get(r.page_id, []) == [h for h in heads if len(h) >= 12]


def test_page_text(spark):
    df = spark.createDataFrame([(1, "<script>no</script><p>a &amp; b&nbsp;<b>c</b></p><!-- x -->"), (2, None)], "page_id long, html string")
    assert {r.page_id: r.text for r in html.page_text(df).collect()} == {1: "a & b c", 2: ""}


def test_long_pages_are_read_whole(spark):
    index = "".join(f"<h2>Headline number {k}</h2>" for k in range(75))
    df = spark.createDataFrame([(1, "u", index), (2, "u", "<p>" + "word " * 9000 + "</p>")], "page_id long, url string, html string")
    assert [r.pos for r in html.page_items(df).orderBy("pos").collect()] == list(range(75)) and html.page_items(df, 30).count() == 30
    assert {r.page_id: len(r.text) for r in html.page_text(df).collect()}[2] == 9000 * 5 - 1
    assert max(len(r.text) for r in html.page_text(df, 500).collect()) == 500


def fold(batch, store):
    """The upsert as a loop."""
    held, ids, out = {}, {i for _, i, _, _, _ in store}, []
    for _, i, k, v, at in sorted(store, key=lambda r: (r[4], r[1])):
        held[k] = (i, v)
    for _, i, k, v, _ in sorted(batch):
        cur = held.get(k)
        if i in ids or cur and abs(cur[1] - v) < 1e-3:
            out.append((i, "unchanged", None))
        else:
            out.append((i, "superseding" if cur else "new", cur[0] if cur else None))
            held[k] = (i, v)
            ids.add(i)
    return out


def test_upsert_is_the_fold(spark):
    random.seed(6)
    row = lambda n, i: (n, f"r{i}", random.choice("abc"), random.choice((1.0, 1.0004, 1.0008, 2.0)), f"2024-01-{n % 28 + 1:02d}")
    store = [row(n, n) for n in range(3)]
    batch = [row(n, random.choice((n, n, 1))) for n in range(3, 60)]
    s = "seq long, id string, k string, value double, measured_at string"
    got = windows.upsert(spark.createDataFrame(batch, s), spark.createDataFrame(store, s), ["k"])
    assert sorted(((r.id, r.action, r.supersedes) for r in got.collect()), key=str) == sorted(fold(batch, store), key=str)


def test_upsert_of_one_large_identity(spark):
    """A third of the rows in one identity, with repeated ids and null keys."""
    rng = random.Random(16)
    row = lambda n: (n, f"r{n if n % 3 else rng.randrange(3, n + 4)}", "big" if n % 3 else rng.choice("xyz"), rng.choice((1.0, 1.0004, 1.0008, 2.0, 3.0)), "2024-01-01")
    store = [(n, f"s{n}", k, 1.0, "2024-01-01") for n, k in enumerate(("big", "x"))]
    seen, batch = {}, []
    for n in range(3, 60_000):  # an id belongs to one identity, as in the fold
        r = row(n)
        batch.append((*r[:2], seen.setdefault(r[1], r[2]), *r[3:]))
    s = "seq long, id string, k string, value double, measured_at string"
    got = windows.upsert(spark.createDataFrame(batch, s), spark.createDataFrame(store, s), ["k"])
    assert sorted(((r.id, r.action, r.supersedes) for r in got.collect()), key=str) == sorted(fold(batch, store), key=str)
    none = spark.createDataFrame([(5, "a", None, 1.0, ""), (6, "b", None, 1.0, ""), (7, "c", None, 2.0, "")], s)
    assert [(r.k, r.id, r.action, r.supersedes) for r in windows.upsert(none, none.limit(0), ["k"]).orderBy("id").collect()] == [(None, "a", "new", None), (None, "b", "unchanged", None), (None, "c", "superseding", "a")]


def test_quota_top_is_the_loop(spark):
    random.seed(8)
    quotas = {"x": 2, "y": 1, "z": 3}
    for cap in (2, 5, 9):
        rows = [(k, random.choice(["x", "y", "z", None]), float(random.randint(0, 6))) for k in range(40)]
        order = sorted(rows, key=lambda r: (-r[2], r[0]))
        want = []
        for b, q in quotas.items():
            want += [r for r in order if r[1] == b][:q][: cap - len(want)]
        want += [r for r in order if r not in want][: cap - len(want)]
        got = windows.quota_top(spark.createDataFrame(rows, "id long, b string, s double"), "b", quotas, "s", "id", cap)
        assert {r.id for r in got.collect()} == {r[0] for r in want}


def test_proposals(spark):
    rows = [("a", 3, 1), ("b", 30, 9), ("c", 9, 12), ("d", 0, 20), ("e", -12, 15), ("f", -12, 15)]
    got = {r.topic: r.decision for r in aggs.proposals(spark.createDataFrame(rows, "topic string, net long, observations long"), n_strong=6).collect()}
    assert got == {"a": "withheld", "b": "withheld", "c": "promote", "d": "dead_band", "e": "demote", "f": "floor"}


def test_claims(spark):
    def gaps(claim, readings):
        rows = [("v", "vendor", float(claim))] + [(f"r{k}", "thirdparty", float(x)) for k, x in enumerate(readings)]
        df = spark.createDataFrame([(i, "b", "m", w, v, "2024-01-01") for i, w, v in rows], "id string, benchmark string, model string, measured_by string, value double, measured_at string")
        return joins.claims_outside(df).count()

    assert (gaps(91.2, [91.86, 71.21]), gaps(75.2, [60.54]), gaps(95, [40, 55])) == (0, 1, 1)


def test_resolution(spark):
    reg = spark.createDataFrame([(1, "gpt-6", ["GPT 6", "G6"]), (2, "other", ["G6", "GPT-6x"])], "ord int, id string, aliases array<string>")
    names = spark.createDataFrame([("gpt-6",), ("G6",), ("gpt6",), ("g-p-t 6 X",), ("gpt-7",)], "name string")
    assert {r.name: r.model for r in joins.resolve_names(names, reg).collect()} == {"gpt-6": "gpt-6", "G6": "gpt-6", "gpt6": "gpt-6", "g-p-t 6 X": "other", "gpt-7": None}


def test_coverage(spark):
    covered = spark.createDataFrame([("k", datetime.date(2024, 1, 1), ["pricing"])], "key string, at date, facts array<string>")
    rows = [(1, "k", datetime.date(2024, 1, 5), ["pricing"]), (2, "k", datetime.date(2024, 1, 5), ["pricing", "ga_date"]), (3, "k", datetime.date(2024, 2, 5), []), (4, "new", datetime.date(2024, 1, 5), [])]
    got = joins.coverage_decision(spark.createDataFrame(rows, "n int, key string, at date, facts array<string>"), covered, ["ga_date", "pricing"])
    assert {r.n: r.decision for r in got.collect()} == {1: "drop", 2: "update", 3: "publish", 4: "publish"}
