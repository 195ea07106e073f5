"""Ranks over ranges, and slugs by them, against plain Python."""

import random

import pytest

from feedscope.operators import ranks


def slugs_in_order(bases):
    """The first free name for each base, one after another."""
    taken, out, after = set(), [], {}  # a base's numbers only rise
    for b in bases:
        name, n = b, after.get(b, 2)
        while name in taken:
            name, n = f"{b}-{n}", n + 1
        after[b] = n
        taken.add(name)
        out.append(name)
    return out


def test_counted_before(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randrange(50), rng.randrange(2)) for k in range(3000)]
    got = ranks.counted_before(spark.createDataFrame(rows, "id long, key string, t long, flag int").repartition(5), "key", ["t", "id"], "flag").collect()
    assert len(got) == len(rows)
    for key in {r[1] for r in rows}:
        n = 0
        for r in sorted((r for r in got if r.key == key), key=lambda r: (r.t, r.id)):
            assert r.before == n
            n += r.flag


@pytest.mark.parametrize("seed", range(6))
def test_slugs_are_those_of_one_pass(spark, seed):
    rng = random.Random(seed)
    pool = ["post", "post-2", "post-3", "post-5", "post-2-2", "post-2-3", "post-02", "post-1", "a", "a-2", "a-2-2", "a-2-2-2", "a-10", "x-9-8", "x-9", "-2", "2", "b-99999999999999999999", "c\n-2", "c\n"]
    bases = [rng.choice(pool[: rng.choice([4, 8, 20])]) for _ in range(rng.choice([10, 60, 250]))]
    df = spark.createDataFrame(list(enumerate(bases)), "id long, base string").repartition(4)
    got = ranks.unique_slugs(df, "base", "id").orderBy("id").collect()
    assert [r.slug for r in got] == slugs_in_order(bases) and [r.base for r in got] == bases


def test_slugs_of_little(spark):
    assert ranks.unique_slugs(spark.createDataFrame([], "id long, base string"), "base", "id").collect() == []
    got = ranks.unique_slugs(spark.createDataFrame([(1, None, "x"), (2, "a", "y"), (3, None, "z")], "id long, base string, slug_of string"), "base", "id").orderBy("id").collect()
    assert [(r.id, r.slug, r.slug_of) for r in got] == [(1, None, "x"), (2, "a", "y"), (3, None, "z")]


def test_one_base_over_many_tasks(spark):
    """A hundred thousand untitled rows and some kids of theirs: every task takes a part."""
    df = spark.range(100_000).selectExpr("id", "CASE WHEN id % 1000 = 7 THEN concat('post-', cast(id DIV 2 + 2 AS string)) ELSE 'post' END AS base")
    out = ranks.unique_slugs(df, "base", "id")
    want = slugs_in_order([f"post-{k // 2 + 2}" if k % 1000 == 7 else "post" for k in range(100_000)])
    assert [r.slug for r in out.orderBy("id").select("slug").collect()] == want
    seen = ranks.counted_before(df.selectExpr("id", "'post' AS base", "1 AS one"), "base", ["id"], "one")
    assert seen.selectExpr("max(before)", "count(distinct before)").first() == (99_999, 100_000)
