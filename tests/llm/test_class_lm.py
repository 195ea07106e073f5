"""The class-based language model against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedscope.llm import class_lm

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "One one ONE two."), (4, "One one ONE two."), (5, "word " * 30000), (6, "x" * 2_500_000), (7, "été ÉTÉ Ω a\x1cb c"), (None, "no id here"), (8, "a b c d e f g"), (9, "a\x0bb\x0cc\rd")]


def words_of(text):
    return [*WORDS.findall((text or "").translate(LOW)), None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute_base(rows):
    """(doc_id, held, n_tokens, n_known, N, base) of each row."""
    counts = Counter(w for i, t in rows if not held(i) for w in words_of(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        ws = words_of(t)
        yield i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)


def check_base(rows, got):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    want = sorted(brute_base(rows), key=key)
    mine = sorted((tuple(r)[:6] for r in got), key=key)
    assert [r[:5] for r in mine] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in mine], [r[5] for r in want], rtol=1e-9)


def sample(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_base_score_and_held_out(spark, sf):
    docs, rows = sample(spark, sf)
    got = class_lm.score_texts(docs).collect()
    check_base(rows, got)
    new = [r for r in got if r.held_out]
    assert len(new) > 10 and all(math.isfinite(r.score) and r.score < 0 and r.perplexity > 1 for r in got)
    assert sum(r.score for r in new) > 0.9 * sum(r.base_score for r in new) > sum(r.base_score for r in new)  # a tenth of the digits saved


@pytest.mark.parametrize("block, piece", [(300, 7), (class_lm.BLOCK, class_lm.PIECE)])
def test_odd_rows(spark, block, piece):
    df = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    for name in ("block", "first", "key", "held", "seq", "word", "wid", "c", "n", "class", "kind"):
        df = df.withColumn(name, F.lit("clash"))
    check_base(ODD, class_lm.score_texts(df, block, piece).collect())


def test_scores_by_the_formula(spark, sf):
    """Classes are one for each word; counts, transitions and scores follow from them in plain Python."""
    docs, rows = sample(spark, sf)
    got = {}
    for block, piece in ((20_000, 50), (class_lm.BLOCK, class_lm.PIECE)):
        found = class_lm.classify(docs, block, piece)
        pieces = defaultdict(list)
        for r in found.pieces.select("key", "doc_id", "classes", "emitted").collect():
            pieces[r.key].append(r)
        if block == class_lm.BLOCK:  # whole texts: classes stand beside their words
            assert all(len(v) == 1 or sum(len(r.classes) - 1 for r in v) > class_lm.PIECE for v in pieces.values())
            one = {v[0].doc_id: v[0] for v in pieces.values() if len(v) == 1}
        got[block] = sorted((r.doc_id, round(r.score, 6)) for r in class_lm.score_texts(docs, block, piece).collect())
    small, large = got.values()
    assert small == large  # how texts were dealt to blocks and pieces doesn't matter
    counts = Counter(w for i, t in rows if not held(i) for w in words_of(t))
    of = {}
    for i, t in rows:
        if i in one:
            ws, cs = words_of(t), list(one[i].classes)
            assert len(cs) == len(ws) + 1 and cs[0] == cs[-1]
            for w, c in zip(ws, cs[1:], strict=True):
                assert of.setdefault(w, c) == c
    assert all((of[w] == class_lm.CLASSES + 1) == (counts[w] == 0) for w in of) and of[None] == class_lm.CLASSES
    missing = [w for w in counts if w not in of]
    if missing:  # words of texts in several pieces only
        return
    size = class_lm.CLASSES + 2
    each, pairs = Counter(), Counter()
    for w, n in counts.items():
        each[of[w]] += n
    for i, t in rows:
        if not held(i):
            cs = [of[w] for w in [None, *words_of(t)]]
            pairs.update(zip(cs, cs[1:], strict=False))
    once = sum(n == 1 for n in counts.values())
    unigram = [each[c] + 1 + (once if c == size - 1 else 0) for c in range(size)]
    total = Counter()
    for (a, _), n in pairs.items():
        total[a] += n
    kinds = Counter(a for a, _ in pairs)
    for doc_id, score in large:
        text = dict(rows)[doc_id]
        want, before = 0.0, None
        for w in words_of(text):
            a, b = of[before], of[w]
            k = max(1, kinds[a])
            p = (pairs[a, b] + k * unigram[b] / sum(unigram)) / (total[a] + k)
            want += math.log10(p * (counts[w] / each[b] if counts[w] else 1))
            before = w
        assert math.isclose(score, want, rel_tol=1e-6, abs_tol=1e-5)


def test_tables_without_training_texts(spark):
    out = [i for i in range(200) if held(i)][:4]
    got = class_lm.score_texts(spark.createDataFrame([(i, "some words") for i in out], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0)] * 4
    assert all(math.isfinite(r.score) for r in got)
    assert class_lm.score_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    empty = class_lm.score_texts(spark.createDataFrame([(1, None), (3, "")], "doc_id long, text string")).collect()
    assert all(r.n_tokens == 1 and math.isfinite(r.score) for r in empty)


def test_transitions_are_probabilities():
    rng = np.random.default_rng(1)
    t = np.round(rng.random((66, 66)) ** 8 * 50)
    t[5] = 0
    p = 10 ** class_lm.log_transitions(t, 17)
    assert np.allclose(p.sum(axis=1), 1) and (p > 0).all()


def test_exchange_takes_the_most_likely_class(monkeypatch):
    monkeypatch.setattr(class_lm, "CLASSES", 5)
    rng = random.Random(3)
    for _ in range(20):
        n_words = 12
        tokens = [rng.randrange(n_words) for _ in range(300)]
        of = [rng.randrange(5) for _ in range(n_words - 2)] + [5, 6]  # an end token and a rare word, which stay
        pairs = Counter(zip(tokens, [*tokens[1:], tokens[0]], strict=True))

        def counted(classes):
            t = np.zeros((7, 7))
            for (a, b), n in pairs.items():
                t[classes[a], classes[b]] += n
            return t

        w = rng.randrange(n_words - 2)
        right, left = np.zeros(7), np.zeros(7)
        for (a, b), n in pairs.items():
            if a == w and b != w:
                right[of[b]] += n
            if b == w and a != w:
                left[of[a]] += n
        found = class_lm.best_class(counted(of), of[w], right, left, pairs[w, w])
        each = [class_lm.likelihood(counted([*of[:w], c, *of[w + 1 :]])) for c in range(5)]
        assert math.isclose(each[found], max(each), rel_tol=1e-12)


def test_clustering_raises_the_likelihood(spark):
    """Words of two languages, nouns and verbs in turn: exchange parts them."""
    rng = random.Random(4)
    kinds = [[f"{p}{k}" for k in range(40)] for p in ("noun", "verb", "nom", "verbe")]
    text = lambda a, b: " ".join(rng.choice(kinds[k]) for _ in range(30) for k in (a, b))
    rows = [(k, text(0, 1) if k % 2 else text(2, 3)) for k in range(300)]
    found = class_lm.classify(spark.createDataFrame(rows, "doc_id long, text string"))
    seen = defaultdict(set)
    for r in found.pieces.where(~F.col("held")).collect():
        for w, c in zip(words_of(dict(rows)[r.doc_id]), list(r.classes)[1:], strict=True):
            seen[c].add(w and re.sub(r"\d", "", w))
    assert sum(len(v) == 1 for v in seen.values()) >= 0.95 * len(seen)


def test_words_are_placed_by_all_their_neighbours():
    rng = np.random.default_rng(5)
    table = rng.standard_normal((12, 4)).astype(np.float32)
    wid, code, n = rng.integers(0, 40, 300), rng.integers(0, 12, 300).astype(np.uint8), rng.integers(1, 9, 300).astype(np.int32)
    score, count = defaultdict(lambda: np.zeros(4)), Counter()
    for w, c, k in zip(wid.tolist(), code, n, strict=True):
        score[w] += k * table[c]
        count[w] += k * (c >= 6)
    words, best, total = class_lm.place(wid, code, n, table)
    assert dict(zip(words.tolist(), zip(best.tolist(), total.tolist(), strict=True), strict=True)) == {w: (int(s.argmax()), count[w]) for w, s in score.items()}


def test_cut_parts_words_at_ascii_white_space_only():
    texts = ["", "  ", "A b\x0bC\x0cd\r\ne\tf", "x", " \x1cy\xa0z ", "İ É\u2003q", "b B"]
    ids, distinct, n = class_lm.cut([t.encode() for t in texts])
    got, at = [], 0
    for k in n:
        got.append([distinct[i].decode() for i in ids[at : at + k]])
        at += k
    assert got == [words_of(t)[:-1] for t in texts] and at == len(ids)
