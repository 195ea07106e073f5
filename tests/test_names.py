"""Names' settings and messages' facts against plain Python."""

import random

from pyspark.sql import functions as F

from feedscope.functions import names


def plain_effort(name):
    text = (name or "").strip()
    if "(" in text and ")" in text[text.index("(") :]:
        inside = text[text.index("(") + 1 :].split(")")[0]
        if "(" not in inside and inside.strip().lower() in names.EFFORTS:
            return inside.strip().lower()
    tail = text.rsplit("_", 1)[-1].strip().lower() if "_" in text else ""
    return tail if tail in names.EFFORTS else None


def plain_bare(name):
    low = (name or "").strip().lower()
    cut = low[:-1] if low[-1:] in (")", "]") and low else low
    ends = [e for e in names.EFFORTS if cut.endswith(e)]
    kept = cut[: len(cut) - max(map(len, ends))] if ends else low
    return "".join(c for c in kept if c in "abcdefghijklmnopqrstuvwxyz0123456789")


def test_efforts_and_bare_names(spark):
    rng = random.Random(1)
    heads = ["GPT-5.1", "gpt-6 astra", "Opus", "slow", "", "a(b", "x_y"]
    tails = ["", " (high)", "_xhigh", "-low", " [max]", " (Unknown Thinking)", "_ medium ", "(high) beta", "_high_", " non-thinking", " HIGH", " (v2)"]
    rows = [(k, rng.choice(heads) + rng.choice(tails)) for k in range(200)] + [(999, None)]
    df = spark.createDataFrame(rows, "id long, name string").select("id", names.effort_of(F.col("name")).alias("e"), names.bare_name(F.col("name")).alias("b"))
    assert {r.id: (r.e, r.b) for r in df.collect()} == {k: (plain_effort(n), plain_bare(n)) for k, n in rows}


def test_message_facts(spark):
    texts = ["A title \n[llm · score 2.5]\nmore", "T\r\n[ · score 3]", "T\n[llm · score none]", "T\nno tag", "T", "", None, "T\n[llm · ]", "T\n[a · b · 7]", " \n[x · 1e2]"]
    want = [("A title", "llm", 2.5), ("T", None, 3.0), ("T", "llm", 0.0), ("T", None, 0.0), ("T", None, 0.0), ("", None, 0.0), ("", None, 0.0), ("T", "llm", 0.0), ("T", "a", 7.0), ("", "x", 100.0)]
    got = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", names.message_facts(F.col("t")).alias("f")).orderBy("id").collect()
    assert [tuple(r.f) for r in got] == want
