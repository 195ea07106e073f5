"""Names in texts by the dictionary automaton, against plain Python."""

import random

import pytest

from feedscope.operators import mentions

TEXTS = "id long, title string, text string"
NAMES = "ord int, model string, name string"


def brute_longest(texts, names, with_title):
    out = {}
    for i, title, text in texts:
        for field in ((title, text) if with_title else (text,)):
            low = (field or "").lower()
            hits = [(len(n), -low.find(n.lower()), -o, m) for o, m, n in names if n and len(n) >= 4 and n.lower() in low]
            if hits:
                out[i] = max(hits)[3]
                break
    return out


@pytest.mark.parametrize("shard", [16, 2 << 20])
def test_title_before_text_and_shards(spark, shard, monkeypatch):
    monkeypatch.setattr(mentions, "SHARD_BYTES", shard)
    rng = random.Random(shard)
    words = ["Gpt", "astra", "Opus", "opus 4", "opus 4.8", "claud", "zeta", "é", "Alphabet", "alpha"]
    say = lambda n: None if rng.random() < 0.1 else " ".join(rng.choices(words, k=rng.randrange(n)))
    texts = [(k, say(4), say(9)) for k in range(300)]
    names = [(k, f"m{k}", n) for k, n in enumerate(["Opus", "opus 4", "Opus 4.8", "Alpha", "alphabet", "gpt", "Astra Opus", "ASTRA", "astra", None, ""])]
    df, known = spark.createDataFrame(texts, TEXTS), spark.createDataFrame(names, NAMES)
    assert {r.id: r.model for r in mentions.longest_known(df, known).collect()} == brute_longest(texts, names, True)
    assert {r.id: r.model for r in mentions.longest_known(df.drop("title"), known).collect()} == brute_longest(texts, names, False)


@pytest.mark.parametrize("shard", [16, 2 << 20])
def test_occurrences_overlap(spark, shard, monkeypatch):
    monkeypatch.setattr(mentions, "SHARD_BYTES", shard)
    texts = [(1, "aaaa"), (2, "abab\U0001f600abab"), (3, None), (4, ""), (5, "xabcx")]
    needles = ["a", "aa", "aaa", "ab", "bab", "\U0001f600a", "abcd", "abc", "bc", ""]
    df = spark.createDataFrame(texts, "id long, text string")
    got = {tuple(r) for r in mentions.occurrences(df, spark.createDataFrame([(n,) for n in [*needles, None, "ab"]], "needle string"), 2).collect()}
    assert got == {(i, n, t.find(n) + 1) for i, t in texts if t for n in needles if len(n) >= 2 and n in t}


def test_nothing_to_find(spark):
    none, one = spark.createDataFrame([], TEXTS), spark.createDataFrame([(1, "t", "some text")], TEXTS)
    names = spark.createDataFrame([(0, "m", "text")], NAMES)
    assert mentions.longest_known(none, names).collect() == [] == mentions.longest_known(one, names.limit(0)).collect()
    assert mentions.longest_known(one, names).collect() == [(1, "m")]
