"""Near titles against plain Python."""

import datetime
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedscope import queries as Q
from feedscope import story_queries  # noqa: F401  (registers its queries)
from feedscope.functions.text import STOPWORDS
from feedscope.operators import titles
from feedscope.plans import funnel

DAY = datetime.date(2024, 3, 1)
SCHEMA = "id long, title string, published date"


def tokens(title):
    low, out, word = (title or "").lower(), set(), ""
    for c in low + " ":
        if c in "abcdefghijklmnopqrstuvwxyz0123456789":
            word += c
            continue
        if word and word not in STOPWORDS and (len(word) > 1 or word.isdigit()):
            out.add(word)
        word = ""
    return out


def near(a, b, ratio):
    x, y = tokens(a), tokens(b)
    shared, least = len(x & y), min(len(x), len(y))
    if shared >= 3 and shared >= 0.4 * least or shared >= 2 and shared >= 0.5 * least:
        return True
    return ratio is not None and SequenceMatcher(None, (a or "").lower(), (b or "").lower()).ratio() >= ratio


def brute(items, posts, ratio, days=7):
    out = {}
    for i, title, day in items:
        met = [(p, posted) for p, other, posted in posts if day and posted and 0 <= (day - posted).days <= days and near(title, other, ratio)]
        if met:
            out[i] = (min(met, key=lambda m: (-m[1].toordinal(), m[0]))[0], len(met))
    return out


def made(seed, n):
    """Titles of a few stories, told in other words, with letters changed, and odd ones."""
    rng = random.Random(seed)
    words = ["model", "beats", "open", "weights", "agent", "bench", "score", "nine", "labs", "tops", "data", "gpt", "6", "astra", "the", "of", "é", "x1"]
    stories = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 8))) for _ in range(12)]
    out = []
    for k in range(n):
        t = rng.choice(stories)
        kind = rng.randrange(6)
        if kind == 0:
            t = " ".join(rng.sample(t.split(), len(t.split())))
        elif kind == 1:
            t = "".join(c if rng.random() > 0.15 else rng.choice("abcxyz ") for c in t)
        elif kind == 2:
            t = t.upper() + "!"
        elif kind == 3:
            t = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 90)))
        elif kind == 4 and rng.random() < 0.3:
            t = rng.choice([None, "", " ", "a", "long " * 70, "Long " * 69 + "x"])
        out.append((k, t, None if rng.random() < 0.03 else DAY + datetime.timedelta(days=rng.randrange(20))))
    return out


@pytest.mark.parametrize("ratio", [None, 0.72])
def test_told_before(spark, ratio, monkeypatch):
    monkeypatch.setattr(titles, "BLOCK", 16)  # several blocks a stretch
    items, posts = made(1, 260), [(1000 + i, t, d) for i, t, d in made(2, 200)]
    got = titles.told_before(spark.createDataFrame(items, SCHEMA), spark.createDataFrame(posts, SCHEMA), ratio=ratio)
    assert {r.id: (r.nearest, r.n) for r in got.collect()} == brute(items, posts, ratio)


def test_nothing_to_meet(spark):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a title of words", DAY)], SCHEMA)
    assert titles.told_before(none, one).collect() == [] == titles.told_before(one, none).collect()
    got = titles.told_before(spark.createDataFrame([(1, "", DAY), (2, None, DAY)], SCHEMA), spark.createDataFrame([(3, None, DAY)], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == [(1, 3, 1), (2, 3, 1)]


def test_titles_of_the_driver(spark, sf):
    rows = [(r.id, r.title, r.published) for r in Q.items(spark, sf).select("id", "title", "published").collect()]
    items, posts = [r for r in rows if r[0] % 11 != 10], [r for r in rows if r[0] % 11 == 10]
    got = Q.QUERIES["told_before_by_letters"](spark, sf).collect()
    assert {r.id: (r.nearest, r.n) for r in got} == brute(items, posts, 0.72)


def test_equal_titles_are_one_class(spark):
    """A hundred thousand equal titles: linear rows on the way, and no pairs."""
    many = spark.range(100_000).selectExpr("id", "'The same old story, told again' AS title", "date'2024-03-01' AS published")
    posts = many.selectExpr("id + 1000000 AS id", "title", "published")
    out = titles.told_before(many, posts)
    assert out.selectExpr("count(*) AS rows", "min(n) AS a", "max(n) AS b", "min(nearest) AS c", "max(nearest) AS d").first() == (100_000, 100_000, 100_000, 1_000_000, 1_000_000)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnop é"])
def test_alike_misses_none(alphabet):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 30, 63, 64, 65, 130, 200, 300])))
    a = [word() for _ in range(60)]
    b = [word() for _ in range(40)] + ["".join(c if rng.random() > 0.25 else rng.choice(alphabet) for c in t) for t in a]
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if SequenceMatcher(None, x, y).ratio() >= 0.72}
    assert set(titles.alike(a, b)) == want and len(want) > 30


def shuffled(spark):
    """Rows that have been shuffled so far."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_pairs_of_rows_are_not_shuffled(spark):
    """A title many times: pairs of rows come out, all of them, and none travels."""
    x = spark.range(400).selectExpr("id", "concat('Same old story, told again ', id % 2) AS title", "date_add(date'2024-03-01', int(id % 20)) AS published")
    before, day = shuffled(spark), lambda k: k % 20
    got = {(r.id, r.post_id) for r in titles.near_titles(x, x).collect()}
    assert got == {(i, j) for i in range(400) for j in range(400) if i != j and 0 <= day(i) - day(j) <= 7}
    assert len(got) > 50_000 and shuffled(spark) - before < 15_000


def test_near_classes_are_counted_where_they_meet(spark):
    """Different titles that are all near: 90,000 pairs of token sets, of which none travels."""
    items = spark.range(300).selectExpr("id", "concat('alpha beta w', id) AS title", "date'2024-03-08' AS published")
    posts = spark.range(300).selectExpr("id + 1000 AS id", "concat('beta alpha v', id) AS title", "date_add(date'2024-03-01', int(id % 8)) AS published")
    before = shuffled(spark)
    got = titles.told_before(items, posts, ratio=None).collect()
    assert len(got) == 300 and {(r.nearest, r.n) for r in got} == {(1007, 300)} and shuffled(spark) - before < 20_000


def test_busy_tokens_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(titles, "BUSY", 8)
    monkeypatch.setattr(titles, "BLOCK", 8)
    items, posts = made(3, 200), [(1000 + i, t, d) for i, t, d in made(4, 200)]
    a, b = spark.createDataFrame(items, SCHEMA), spark.createDataFrame(posts, SCHEMA)
    assert {r.id: (r.nearest, r.n) for r in titles.told_before(a, b, ratio=None).collect()} == brute(items, posts, None)
    want = {(i, p) for i, t, d in items for p, u, e in posts if d and e and 0 <= (d - e).days <= 7 and near(t, u, None)}
    got = [(r.id, r.post_id) for r in titles.near_titles(a, b).collect()]
    assert len(got) == len(want) and set(got) == want


def test_long_titles_are_told_apart_before_they_are_compared(monkeypatch):
    """Titles of hundreds of letters in the same words: only those that may be alike are compared exactly, and none is lost."""
    compared = []

    class Counted(SequenceMatcher):
        def ratio(self):
            compared.append(1)
            return super().ratio()

    rng = random.Random(8)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    told = lambda n: " ".join(rng.choice(words) if rng.random() < 0.9 else rng.choice("bcdfgk0123456789") for _ in range(n))
    a = [told(rng.randint(60, 500)) for _ in range(40)] + ["x, " * 300, "same beginning " * 40 + told(60), ""]
    changed = lambda t, share: "".join(rng.choice("aeinorstq z") if rng.random() < share else c for c in t)
    b = [changed(t, share) for t in a[:15] for share in (0, 0.003, 0.01, 0.03, 0.1)] + [told(rng.randint(60, 500)) for _ in range(40)] + ["y, " * 300, "x, " * 290, "same beginning " * 40 + told(70), ""]
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if SequenceMatcher(None, x, y).ratio() >= 0.72}
    monkeypatch.setattr(titles, "SequenceMatcher", Counted)
    assert set(titles.alike(a, b)) == want and len(want) > 20
    assert len(compared) < 5 * len(want)  # of over 1,000 with letters enough


def test_near_pairs_are_not_sorted(spark):
    """Pairs of token sets are counted in a hash map: a sort of them would spill with their square."""
    x = spark.range(20).selectExpr("id", "concat('alpha beta w', id) AS title", "date'2024-03-08' AS published")
    out = titles.told_before(x, x.selectExpr("id + 1000 AS id", "title", "published"), ratio=None)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[a#" in plan and "SortAggregate(key=[a#" not in plan
    assert {(r.nearest, r.n) for r in out.collect()} == {(1000, 20)}


def shuffled_bytes(spark):
    """Bytes that have been shuffled so far."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


@pytest.mark.parametrize("survivors", [False, True])
def test_the_funnel_shuffles_no_texts(spark, survivors):
    """Texts of 8 MB meet seen urls and told ids: what is made from them travels, the texts don't."""
    body = "concat_ws('', transform(sequence(1, 300), k -> sha2(concat(id, ' ', k), 256)))"
    kinds = "CASE id % 4 WHEN 0 THEN '%%%' WHEN 1 THEN 'ation ing ment 7 ble' WHEN 2 THEN 'tion' ELSE '' END"
    x = spark.range(400).selectExpr("id", f"concat('w', id, ' story ', {kinds}) AS title", f"{body} AS summary", "concat('https://x/', id) AS url", "'src' AS source", "'primary' AS tier", "date'2024-02-09' AS published")
    seen, told = x.where("id % 10 = 0").select("url"), x.where("id % 10 = 1").select("id")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_bytes(spark)
        out = funnel.score_items(x, seen, Q.PROFILE, F.lit("2024-02-10").cast("date"), told=told, wanted=("reason",), survivors=survivors)
        got = {r.id: r.reason for r in out.select("id", "reason").collect()}
        moved = shuffled_bytes(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    want = {i: "duplicate" if i % 10 < 2 else ("excluded", None, "below_gate", "no_topic")[i % 4] for i in range(400)}
    assert got == ({i: r for i, r in want.items() if r is None} if survivors else want)
    assert moved < 200_000


@pytest.mark.parametrize("words", [40, 600])
def test_sets_met_misses_none(words):
    rng = random.Random(words)
    made = lambda: sorted(rng.sample(range(words), rng.choice([1, 2, 3, 4, 5, 6, 9, 15, 40, words // 2 + 1])))
    a, b = [made() for _ in range(90)], [made() for _ in range(130)]
    a[0], b[0] = list(range(words)), list(range(words))  # over 255 in common
    flat = lambda sets: (np.array([k for z in sets for k in z]) * 7, np.array([len(z) for z in sets]))
    want = set()
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            shared, least = len({*x} & {*y}), min(len(x), len(y))
            if shared >= 3 and shared / least >= 0.4 or shared >= 2 and shared / least >= 0.5:
                want.add((i, j, shared))
    got = [p for piece in titles.sets_met(*flat(a), *flat(b)) for p in zip(*(z.tolist() for z in piece), strict=True)]
    assert len(got) == len(want) > 100 and set(got) == want


def test_sets_that_share_a_token_are_no_rows(spark):
    """2,000 titles share two of many tokens and are near to none: their pairs are counted inside tasks and become no rows of a join."""
    x = spark.range(2000).selectExpr("id", "concat_ws(' ', 'alpha beta', transform(sequence(1, 6), k -> concat('w', id, 'x', k))) AS title", "date'2024-03-08' AS published")
    out = titles.near_titles(x, x)
    assert "array_intersect" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 0


@pytest.mark.parametrize(("kind", "most", "words"), titles.LANES)
def test_subsequences_of_many_titles(kind, most, words):
    """Titles of several lengths take a letter at a time together, and each gets the length that a table gives."""
    rng = random.Random(most)
    made = lambda n: [rng.randrange(5) for _ in range(n)]
    a = [made(rng.randint(0, most)) for _ in range(20)] + [made(most), [0] * most]
    whose = np.repeat(np.arange(len(a)), [len(z) for z in a])
    masks = titles._masks(np.array([k for z in a for k in z]), whose, len(a), 5, words, kind)
    groups = [(made(n), np.array(sorted(rng.sample(range(len(a)), 9)))) for n in (most + 30, most, most, 7, 0)]

    def table(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            last = row
            row = [0]
            for k, d in enumerate(y):
                row.append(last[k] + 1 if c == d else max(row[k], last[k + 1]))
        return row[-1]

    got = titles.subsequences(masks, groups)
    assert [z.tolist() for z in got] == [[table(letters, a[k]) for k in chosen] for letters, chosen in groups]


def test_alike_in_many_letters():
    """More letters than have a mask of their own, titles of one to several words, and a bound by parts that lets few through."""
    rng = random.Random(9)
    letters = [chr(0x4E00 + k) for k in range(500)] + list("abcdefgh ")
    made = lambda: "".join(rng.choice(letters if rng.random() < 0.7 else "abc ") for _ in range(rng.choice([0, 3, 20, 70, 140, 260, 377, 378, 379, 600])))
    a = [made() for _ in range(60)]
    b = ["".join(c if rng.random() > share else rng.choice(letters) for c in t) for t in a for share in (0.1, 0.27)]
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if SequenceMatcher(None, x, y).ratio() >= 0.72}
    assert set(titles.alike(a, b)) == want and len(want) > 60
