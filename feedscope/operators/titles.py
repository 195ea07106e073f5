"""Near titles: which items tell a story that a recent post has told, one decision for each item.

Two titles are near if their tokens are (three shared and 0.40 of the smaller set, or two and 0.50), or if their letters are:
the sequence ratio, twice the matched letters by both lengths, is 0.72 or more. Rows never meet rows: items and posts
with the same token set are one class, those with the same title one class, and classes meet.

Token classes of a stretch of days meet block by block inside tasks, where those of the posts are counted at each token of an
item's, and only near ones come out. Letters have no such key, as two titles at the ratio may share no more than pairs of
letters, so the titles of a stretch of days are compared block by block inside tasks, where bounds leave few pairs:
their lengths, then how many letters they have in common, then the lengths of the longest common subsequences of their letters
of each part of the alphabet, then of all letters, computed bit by bit for many pairs at once, or, if they are long, how many
runs of letters they share. Only what passes
these is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from feedscope.functions.text import title_tokens
from feedscope.operators.shared import written

RATIO, DAYS = 0.72, 7
#: Rows of a chunk; titles meet in blocks of 32 times as many of items and up to four times as many of posts.
BLOCK = 1024
#: Pairs that are worked on at a time, and the longest title whose common subsequences are computed, in words of so many letters.
PAIRS, LONGEST, WORD = 1 << 14, 378, 63
#: Letters with a bit mask of their own, a quarter of the classes in which letters are counted, and from which count on a letter counts as often as in the other title.
LETTERS, COARSE, MOST = 64, 8, 32
#: Parts of the alphabet, whose subsequences together bound those of all letters, and the words that hold a title's letters of one part: how many letters, how many words.
PARTS, LANES = 4, ((np.uint16, 16, 1), (np.uint32, 32, 1), (np.uint64, 64, 1), (np.uint64, 126, 2), (np.uint64, 378, 6))
#: Letters of a run, and bins for the runs of a title.
RUN, BINS = 4, 4096
#: Token sets of a stretch meet in blocks of twice as many of items and eight times as many of posts.
BUSY = 8192
#: Rows of a block of items, and rows of posts that come out at a time.
ROWS = 1 << 18


def tokens_are_near(shared: Column, smaller: Column) -> Column:
    return ((shared >= 3) & (shared >= 0.4 * smaller)) | ((shared >= 2) & (shared >= 0.5 * smaller))


def _numbered(titles: list[str], number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the titles' letters as numbers, one after the other; where each title begins, and the end)."""
    flat = np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), np.uint32)
    return number.take(flat), np.append(0, np.cumsum([len(t) for t in titles], dtype=np.int64))


def _folded(often: np.ndarray, own: int, others: int) -> np.ndarray:
    """A class for each letter: the most frequent ones have their own, all others share some. Titles have no less in common so."""
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(-often, kind="stable")] = np.arange(len(often))
    return np.where(rank < own, rank, own + rank % others).astype(np.uint8)


def _dealt(often: np.ndarray, parts: int) -> np.ndarray:
    """A part of the alphabet for each letter, all parts about as frequent."""
    out, load = np.zeros(len(often), np.uint8), [0] * parts
    for letter in np.argsort(-often, kind="stable").tolist():
        out[letter] = load.index(min(load))
        load[out[letter]] += int(often[letter])
    return out


def _counted(letters: np.ndarray, at: np.ndarray, kinds: int) -> np.ndarray:
    """How often each letter stands in each title; rows are letters, columns titles."""
    n = len(at) - 1
    return np.bincount(letters.astype(np.int64) * n + np.repeat(np.arange(n), np.diff(at)), minlength=kinds * n).reshape(kinds, n)


def _masks(letters: np.ndarray, whose: np.ndarray, n: int, kinds: int, words: int, kind: type = np.uint64) -> np.ndarray:
    """By letter, word and title: the places of the letter in the title, a bit each. ``whose`` rises: the title of each letter."""
    lengths = np.bincount(whose, minlength=n)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    bits = WORD if words > 1 else np.iinfo(kind).bits
    out = np.zeros(kinds * words * n, kind)
    np.add.at(out, (letters.astype(np.int64) * words + place // bits) * n + whose, kind(1) << (place % bits).astype(kind))
    return out.reshape(kinds, words, n)


def subsequences(masks: np.ndarray, groups: list[tuple[list[int], np.ndarray]]) -> list[np.ndarray]:
    """For groups of (letters of a title, chosen titles of ``masks``), the longest title first, the lengths of their longest common
    subsequences.

    Each bit of a word stands for a letter of a title; the bits that have become 0 count the subsequence. The highest bit of
    a word takes what is carried to the next. All groups take a letter at a time together.
    """
    words, kind = masks.shape[1], masks.dtype.type
    bits = WORD if words > 1 else np.iinfo(kind).bits
    low, top = ~kind(0) >> kind(np.iinfo(kind).bits - bits), kind(WORD if words > 1 else 0)
    rows, steps = [], []
    for letters, chosen in groups:
        seen: dict[int, int] = {}
        steps.append([seen.setdefault(letter, len(seen)) for letter in letters])
        own = np.empty((len(seen), words, len(chosen)), kind)
        for letter, k in seen.items():
            masks[letter].take(chosen, axis=1, out=own[k], mode="clip")
        rows.append(list(own))
    ends = np.cumsum([len(chosen) for _, chosen in groups]).tolist()
    every = [np.empty((words, ends[-1]), kind) for _ in range(3)]
    every[0].fill(low)
    on, known = len(steps), None
    for t in range(len(steps[0])):
        while len(steps[on - 1]) <= t:
            on -= 1
        if on != known:
            known = on
            v, met, total = (z[:, : ends[on - 1]] for z in every)
        np.concatenate([rows[g][steps[g][t]] for g in range(on)], axis=1, out=met)
        np.bitwise_and(v, met, out=met)
        np.add(v, met, out=total)
        np.bitwise_xor(v, met, out=met)
        for w in range(words - 1):
            np.right_shift(total[w], top, out=v[w])
            np.add(total[w + 1], v[w], out=total[w + 1])
        if words > 1:
            np.bitwise_and(total, low, out=total)
        np.bitwise_or(total, met, out=v)
    found = words * bits - np.bitwise_count(every[0] & low).astype(np.int64).sum(axis=0)
    return np.split(found, ends[:-1])


def _runs(flat: np.ndarray, at: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Of each chosen title, how many runs of RUN letters fall into each of BINS bins."""
    out = np.zeros((len(chosen), BINS), np.int32)
    for k, title in enumerate(chosen):
        u = flat[at[title] : at[title + 1]].astype(np.uint64)
        run = np.zeros(max(0, len(u) - RUN + 1), np.uint64)
        for t in range(RUN):
            run = run * np.uint64(0x9E3779B97F4A7C15) + u[t : t + len(run)] + np.uint64(1)
        out[k] = np.bincount((run * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), minlength=BINS)
    return out


def alike(a: list[str], b: list[str], ratio: float = RATIO) -> Iterator[tuple[int, int]]:
    """The pairs of places (in a, in b) of titles whose sequence ratio is ``ratio`` or more."""
    if not a or not b:
        return
    a_at, b_at = (sorted(range(len(z)), key=lambda k, z=z: len(z[k])) for z in (a, b))
    a, b = [a[k] for k in a_at], [b[k] for k in b_at]
    often = np.bincount(np.frombuffer("".join([*a, *b]).encode("utf-32-le", "surrogatepass"), np.uint32), minlength=1)
    codes = np.flatnonzero(often)
    number, often = np.zeros(len(often), np.int32), often[codes]
    number[codes] = np.arange(len(codes))
    (fa, ta), (fb, tb) = _numbered(a, number), _numbered(b, number)
    m, n = np.diff(ta), np.diff(tb)
    kinds, fold, coarse = min(len(codes), LETTERS) + LETTERS, _folded(often, LETTERS, LETTERS), _folded(often, 3 * COARSE, COARSE)
    p, q = (_counted(coarse.take(f), t, 4 * COARSE) for f, t in ((fa, ta), (fb, tb)))
    fa_fold, fb_fold = fold.take(fa), fold.take(fb)
    little, short = np.searchsorted(m, 1 << 8), int(np.searchsorted(m, LONGEST, "right"))
    few, many = p[:, :little].astype(np.uint8), p[:, little:].astype(np.int32)
    least: dict[tuple[int, int], np.ndarray] = {}
    ends = [0, *(int(np.searchsorted(m, WORD * w, "right")) for w in range(1, -(-LONGEST // WORD))), short]
    masks: dict[int, np.ndarray] = {}
    far = None
    # titles by the word that holds their letters of each part of the alphabet; those that have too many come last
    part = _dealt(p.sum(axis=1) + q.sum(axis=1), PARTS)
    of_a, of_b = part[coarse.take(fa[: ta[short]])], part[coarse.take(fb)]
    whose = np.repeat(np.arange(short), m[:short])
    where = [np.flatnonzero(of_a == g) for g in range(PARTS)]
    sizes = np.max([np.bincount(whose[z], minlength=short) for z in where], axis=0)
    lane, at, lanes = np.searchsorted([most for _, most, _ in LANES], sizes), np.zeros(short, np.int64), []
    for c, (kind, _, words) in enumerate(LANES):
        mine = np.flatnonzero(lane == c)
        at[mine] = np.arange(len(mine))
        for z in where:
            z = z[lane[whose[z]] == c]
            lanes.append(_masks(fa_fold[z], at[whose[z]], len(mine), kinds, words, kind))
    needed = np.ceil(ratio * np.arange(int(m[-1] + n[-1]) + 1) / 2 - 1e-9).astype(np.int64)
    matcher = SequenceMatcher()

    def common(post: int, lo: int, hi: int) -> list[np.ndarray]:
        """How many letters of each part a post's title has in common with each of those from lo to hi, wherever they stand."""
        held, to, out = q[:, post], min(hi, little), []
        for g in range(PARTS):
            k = np.flatnonzero((held > 0) & (part == g))
            total = np.zeros(max(0, to - lo), np.uint8)
            for key in zip(k.tolist(), np.minimum(held[k], MOST).tolist(), strict=True):
                if key not in least:  # beyond MOST, all letters of the other title count
                    least[key] = np.minimum(few[key[0]], np.uint8(key[1])) if key[1] < MOST else few[key[0]]
                if len(total):
                    np.add(total, least[key][lo:to], out=total)
            if hi > little:
                since = max(lo, little)
                rest = np.zeros(hi - since, np.int32)
                for one in k.tolist():
                    rest += np.minimum(many[one, since - little : hi - little], held[one])
                total = np.concatenate([total, rest])
            out.append(total)
        return out

    def compared(post: int, k: np.ndarray, need: np.ndarray) -> Iterator[tuple[int, int]]:
        """Of a post's titles that may be alike, those that are."""
        nonlocal far
        matcher.set_seq2(b[post])  # what the matcher knows of a post's title serves all items
        # all matched stretches but the one at both beginnings hold a letter that the matcher looks up, so they are few in
        # long titles, where it looks up rare letters only; what they hold they share in runs
        runs = need - (RUN - 1) * (1 + sum(map(len, matcher.b2j.values())))
        test = np.flatnonzero((k >= short) & (runs > 0))
        if len(test):
            if far is None:
                far = _runs(fa, ta, np.arange(short, len(a)))
            mine = _runs(fb, tb, np.array([post]))
            shared = np.concatenate([np.minimum(far[k[test[c : c + 64]] - short], mine).sum(axis=1) for c in range(0, len(test), 64)])
            k = np.delete(k, test[shared < runs[test]])
        for item in k.tolist():
            matcher.set_seq1(a[item])
            if matcher.ratio() >= ratio:
                yield a_at[item], b_at[post]

    whole = len(lanes)  # queues of titles that wait: by words and part of the alphabet, then by words for all letters
    waiting: list[list] = [[] for _ in range(whole + len(ends) - 1)]
    held = [0] * len(waiting)

    letters: dict[int, list[list[int]]] = {}

    def told(post: int, g: int) -> list[int]:
        """A post's letters of a part of the alphabet; beyond the parts, all."""
        if post not in letters:
            every, of = (z[tb[post] : tb[post + 1]] for z in (fb_fold, of_b))
            letters[post] = [*(every[of == z].tolist() for z in range(PARTS)), every.tolist()]
        return letters[post][g]

    def wait(w: int, post: int, k: np.ndarray, need: np.ndarray, spare: np.ndarray, shared: np.ndarray) -> Iterator[tuple[int, int]]:
        words = LANES[w // PARTS][2] if w < whole else w - whole + 1
        for c in range(0, len(k), PAIRS):
            waiting[w].append((post, *(z[..., c : c + PAIRS] for z in (k, need, spare, shared))))
            held[w] += len(k[c : c + PAIRS]) * words
            if held[w] >= PAIRS:
                yield from reached(w)

    def reached(w: int) -> Iterator[tuple[int, int]]:
        """Titles that wait go on if letters enough are left: ``spare`` are those in common beyond what is needed, and what the subsequences of a
        part are shorter than the letters that it has in common is taken off."""
        longest = [(told(some[0], w % PARTS if w < whole else PARTS), *some) for some in waiting[w]]
        longest.sort(key=lambda z: -len(z[0]))
        waiting[w], held[w] = [], 0
        if w < whole:
            lengths = subsequences(lanes[w], [(z, at[k]) for z, _, k, *_ in longest])
        else:
            start, end = ends[w - whole], ends[w - whole + 1]
            if w not in masks:
                masks[w] = _masks(fa_fold[ta[start] : ta[end]], whose[ta[start] : ta[end]] - start, end - start, kinds, w - whole + 1)
            lengths = subsequences(masks[w], [(z, k - start) for z, _, k, *_ in longest])
        for (_, post, k, need, spare, shared), length in zip(longest, lengths, strict=True):
            if w >= whole:
                some = np.flatnonzero(length >= need)
                if len(some):
                    yield from compared(post, k[some], need[some])
                continue
            spare = spare - shared[w % PARTS] + length
            some = np.flatnonzero(spare >= 0)
            if not len(some):
                continue
            k, need, spare, shared = k[some], need[some], spare[some], shared[:, some]
            if (w + 1) % PARTS:
                yield from wait(w + 1, post, k, need, spare, shared)
                continue
            for c, (since, until) in enumerate(pairwise(np.searchsorted(k, ends).tolist())):
                if since < until:
                    yield from wait(whole + c, post, *(z[..., since:until] for z in (k, need, spare, shared)))

    for post in range(len(b)):
        lo = int(np.searchsorted(m, ratio * n[post] / (2 - ratio) - 1))
        hi = int(np.searchsorted(m, n[post] * (2 - ratio) / ratio + 1, "right")) if ratio > 0 else len(a)
        need, shared = needed[n[post] + m[lo:hi]], common(post, lo, hi)
        most = shared[0] + shared[1]  # of 8 bits while all letters of a title are
        for z in shared[2:]:
            most += z
        k = np.flatnonzero(most >= need)
        need, spare, shared, k = need[k], most[k] - need[k], np.stack([z[k] for z in shared]).astype(np.int64), k + lo
        cut = int(np.searchsorted(k, short))
        if cut < len(k):
            yield from compared(post, k[cut:], need[cut:])
        kind = lane[k[:cut]]
        for w in range(len(LANES)):
            some = np.flatnonzero(kind == w)
            if len(some):
                yield from wait(w * PARTS, post, k[some], need[some], spare[some], shared[:, some])
    for w in range(len(waiting)):  # what goes on waits further down
        if waiting[w]:
            yield from reached(w)


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table]]:
    """Rows sorted by cell and kind: of each cell those of kind 0 and those of kind 1."""
    at, held = None, []

    def both() -> tuple[pa.Table, pa.Table]:
        rows = pa.Table.from_batches(held)
        n = int(np.count_nonzero(rows["kind"].to_numpy() == 0))
        return rows.slice(0, n), rows.slice(n)

    for batch in batches:
        cell = batch.column("cell").to_numpy()
        for lo, hi in pairwise([0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]):
            if lo < hi:
                if at is not None and cell[lo] != at:
                    yield both()
                    held = []
                at = cell[lo]
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield both()


def _in_cells(x: DataFrame, y: DataFrame, key: Sequence[str], most_x: Column, most_y: Column) -> DataFrame:
    """The rows of x and y with cell and kind, 0 and 1, sorted by both: each row of x is in one cell with each row of y of its s.

    ``most_x`` and ``most_y`` are the numbers of blocks that the rows of an s make; ``key`` says which block a row is in.
    Cells are numbered through, so that all tasks get equally many.
    """
    both = x.groupBy("s").agg(most_x.cast("long").alias("na")).join(y.groupBy("s").agg(most_y.cast("long").alias("nb")), "s")
    before = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)  # a row for each s
    both = F.broadcast(written(both.withColumn("first", F.coalesce(F.sum(F.col("na") * F.col("nb")).over(before), F.lit(0)))))
    mine = lambda n: F.pmod(F.xxhash64(*key), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cell = (F.col("first") + F.col("i") * F.col("nb") + F.col("j")).alias("cell")
    p = x.join(both, "s").withColumn("i", mine("na")).withColumn("j", every("nb")).select(cell, F.lit(0).alias("kind"), *(c for c in x.columns if c != "s"))
    q = y.join(both, "s").withColumn("j", mine("nb")).withColumn("i", every("na")).select(cell, F.lit(1).alias("kind"), *(c for c in y.columns if c != "s"))
    tasks = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named: few bytes stand for much work
    rows = p.unionByName(q, allowMissingColumns=True)
    return rows.repartitionById(tasks, (F.col("cell") % tasks).cast("int")).sortWithinPartitions("cell", "kind")


def _met(batches: Iterator[pa.RecordBatch], ratio: float) -> Iterator[pa.RecordBatch]:
    """(a, b): classes of the titles of a cell that are alike."""
    for x, y in _by_cell(batches):
        found = list(alike(x["low"].to_pylist(), y["low"].to_pylist(), ratio))
        i, j = (pa.array([pair[k] for pair in found], pa.int64()) for k in (0, 1))
        for at in range(0, len(found), ROWS):
            yield pa.record_batch([t["title_class"].combine_chunks().take(k[at : at + ROWS]) for t, k in ((x, i), (y, j))], names=["a", "b"])


def _classed(df: DataFrame, day: str) -> DataFrame:
    """The rows with title_class and token_class, the lower-case title and its tokens; null titles are empty."""
    low = F.lower(F.coalesce("title", F.lit("")))
    tokens = F.array_sort(title_tokens(F.col("title")))
    out = df.where(F.col(day).isNotNull()).select("id", F.col(day).cast("date").alias("day"), low.alias("low"), tokens.alias("tokens"))
    return out.withColumn("title_class", F.md5("low")).withColumn("token_class", F.md5(F.array_join("tokens", " ")))


def _stretch(day: Column, days: int) -> Column:
    return F.floor(F.unix_date(day) / (days + 1))


def _letter_pairs(a: DataFrame, b: DataFrame, days: int, ratio: float) -> DataFrame:
    """(a, b): classes of titles that are near by letters and not by tokens."""
    titles = lambda df: written(df.select("title_class", "low", _stretch(F.col("day"), days).alias("s")).distinct())
    x, y = titles(a), titles(b)
    y = y.withColumn("s", F.explode(F.array(F.col("s"), F.col("s") + 1))).distinct()  # posts of the days before lie in an item's own stretch or the one before
    n, letters = F.count(F.lit(1)), F.sum(F.length("low"))
    blocks = F.greatest(F.ceil(n / (4 * BLOCK)), F.least(F.lit(4), F.ceil(n / BLOCK)))
    rows = _in_cells(x, y, ("title_class",), F.ceil(F.greatest(n / (32 * BLOCK), letters / (32 * ROWS))), F.greatest(blocks, F.ceil(letters / (32 * ROWS))))
    met = rows.mapInArrow(lambda it: _met(it, ratio), "a string, b string").distinct()
    sets = lambda df, k: df.groupBy(F.col("title_class").alias(k)).agg(F.first("tokens").alias(f"t{k}"))
    met = met.join(sets(a, "a"), "a").join(sets(b, "b"), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    return met.where(~tokens_are_near(shared, F.least(F.size("ta"), F.size("tb")))).select("a", "b")


def token_sets(*tables: DataFrame) -> DataFrame:
    """(token_class, c, ids): each token set once, numbered, with the numbers of its tokens, the rarest first; tables have
    token_class and tokens. Sets of one token are near to none and left out."""
    every = tables[0].select("token_class", "tokens")
    for t in tables[1:]:
        every = every.union(t.select("token_class", "tokens"))
    each = every.where("size(tokens) > 1").groupBy("token_class").agg(F.first("tokens").alias("tokens")).select("token_class", F.explode("tokens").alias("t"))
    number = written(each.groupBy("t").agg(F.count(F.lit(1)).alias("df")).orderBy("df", "t").select("t", F.monotonically_increasing_id().alias("k")))
    sets = each.join(number, "t").groupBy("token_class").agg(F.sort_array(F.collect_list("k")).alias("ids"))
    return written(sets.select("token_class", F.monotonically_increasing_id().alias("c"), "ids"))


def sets_met(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, shared): pairs of sets that are near, in pieces; a and b are the sets' numbers, one set after the other, na and nb
    their sizes. Each set of a has the counters of all sets of b go up where they hold one of its numbers."""
    if not len(a) or not len(b):
        return
    by_size = np.argsort(nb, kind="stable")
    place = np.empty_like(by_size)
    place[by_size] = np.arange(len(nb))
    known, local = np.unique(b, return_inverse=True)
    holders = np.repeat(place, nb)[np.argsort(local, kind="stable")]
    first = np.append(0, np.cumsum(np.bincount(local))).tolist()
    at = np.minimum(np.searchsorted(known, a), len(known) - 1)
    found = known[at] == a
    ends = np.append(0, np.cumsum(found))[np.append(0, np.cumsum(na))].tolist()
    at = at[found].tolist()
    most = int(nb.max())
    kind = np.dtype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)
    count, need, one, sizes, last = np.zeros(len(nb), kind), np.zeros(len(nb), kind), kind.type(1), nb[by_size], None
    flags = np.zeros(-(-len(nb) // 8) * 8, np.bool_)
    hit, groups, words = flags[: len(nb)], flags.reshape(-1, 8), flags.view(np.uint64)
    held, n = [], 0

    def pairs() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i = np.repeat([k for k, _, _ in held], [len(z) for _, z, _ in held])
        return i, by_size[np.concatenate([z for _, z, _ in held])], np.concatenate([z for _, _, z in held]).astype(np.int64)

    for k in np.argsort(na, kind="stable").tolist():
        lo, hi = ends[k], ends[k + 1]
        if hi - lo < 2:
            continue
        if min(int(na[k]), most) != last:  # what must be shared depends on the smaller set
            last = min(int(na[k]), most)
            smaller = np.minimum(sizes, last)
            need[:] = np.where(smaller <= 4, 2, np.maximum(3, (2 * smaller + 4) // 5))
        np.add.at(count, np.concatenate([holders[first[t] : first[t + 1]] for t in at[lo:hi]]), one)
        np.greater_equal(count, need, out=hit)
        row = np.flatnonzero(words != 0)
        if len(row):
            r, lane = np.nonzero(groups[row])
            j = row[r] * 8 + lane
            held.append((k, j, count[j]))
            n += len(j)
        count.fill(0)
        if n >= PAIRS:
            yield pairs()
            held, n = [], 0
    if held:
        yield pairs()


def _pieces(n: np.ndarray) -> Iterator[slice]:
    """Stretches of n, each with a sum of about ROWS at most."""
    cuts = np.flatnonzero(np.diff(np.cumsum(n) // ROWS)) + 1
    for lo, hi in pairwise([0, *cuts.tolist(), len(n)]):
        if lo < hi:
            yield slice(lo, hi)


def _places(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n places from each start on."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + n, n)


def _near_days(batches: Iterator[pa.RecordBatch], days: int) -> Iterator[tuple]:
    """(x, y, place, by_day, upto, i, j, lo, hi, shared, smaller) in pieces: rows i that sets of kind 0 bring meet a set j of kind 1 that is
    near, of whose rows, by day, those from lo up to hi are of the days before."""
    for x, y in _by_cell(batches):
        ia, ib, xs, ys = (t[k].combine_chunks() for t, k in ((x, "ids"), (y, "ids"), (x, "xs"), (y, "ys")))
        na, nb, mine, each = (z.value_lengths().to_numpy().astype(np.int64) for z in (ia, ib, xs, ys))
        xs, ys = xs.flatten(), ys.flatten()
        at, posted = (z.field("day").cast(pa.int32()).to_numpy().astype(np.int64) for z in (xs, ys))
        first = posted.min(initial=1 << 40)
        width = int(posted.max(initial=first) - first) + 1
        slot = np.repeat(np.arange(len(nb)), each) * width + posted - first
        ys = ys.take(pa.array(np.argsort(slot, kind="stable")))
        upto = np.append(0, np.cumsum(np.bincount(slot, minlength=len(nb) * width)))  # rows before a set's day
        since, until = np.clip(at - days - first, 0, width), np.clip(at + 1 - first, 0, width)
        starts = np.cumsum(mine) - mine
        for i, j, shared in sets_met(ia.flatten().to_numpy(), na, ib.flatten().to_numpy(), nb):
            smaller = np.minimum(na[i], nb[j])
            for piece in _pieces(mine[i]):
                n = mine[i[piece]]
                row, of = _places(starts[i[piece]], n), np.repeat(j[piece], n)
                lo, hi = upto[of * width + since[row]], upto[of * width + until[row]]
                some = np.flatnonzero(hi > lo)
                yield x, xs, ys, row[some], lo[some], hi[some], np.repeat(shared[piece], n)[some], np.repeat(smaller[piece], n)[some]


def _near_rows(batches: Iterator[pa.RecordBatch], days: int) -> Iterator[pa.RecordBatch]:
    """(id, post_id, shared, containment) of rows whose sets are near."""
    for _, xs, ys, row, lo, hi, shared, smaller in _near_days(batches, days):
        ids, posts = xs.field("id"), ys.field("id")
        for piece in _pieces(hi - lo):
            n = (hi - lo)[piece]
            out = [ids.take(pa.array(np.repeat(row[piece], n))), posts.take(pa.array(_places(lo[piece], n)))]
            out += [pa.array(np.repeat(z[piece], n)) for z in (shared, shared / smaller)]
            yield pa.record_batch(out, names=["id", "post_id", "shared", "containment"])


def _near_counts(batches: Iterator[pa.RecordBatch], days: int) -> Iterator[pa.RecordBatch]:
    """(a, day, n, place): of each set and day of kind 0, how many posts of sets that are near it meets, and the least place."""
    for x, xs, ys, row, lo, hi, _, _ in _near_days(batches, days):
        sums = np.append(0, np.cumsum(ys.field("n").to_numpy()))
        places = ys.field("place").to_numpy()
        order = np.argsort(row, kind="stable")
        row, lo, hi = row[order], lo[order], hi[order]
        if len(row):
            new = np.flatnonzero(np.append(True, np.diff(row) > 0))
            n = np.add.reduceat(sums[hi] - sums[lo], new)
            place = np.minimum.reduceat(places[hi - 1], new)  # posts are numbered from the latest on
            a = np.repeat(x["c"].to_numpy(), x["xs"].combine_chunks().value_lengths().to_numpy())[row[new]]
            yield pa.record_batch([pa.array(a), xs.field("day").take(pa.array(row[new])), pa.array(n), pa.array(place)], names=["a", "day", "n", "place"])


def near_sets(x: DataFrame, y: DataFrame) -> DataFrame:
    """Rows of x and y in cells, in which sets of the same s meet.

    x has s, c, chunk, ids and what a set brings along, xs; y has s, c, chunk, ids, ys; xs and ys are structs with a day. Sets of a stretch meet block
    by block inside tasks, where they are counted at the tokens they share. No pair is shuffled.
    """
    x, y = written(x.select("s", "c", "chunk", "ids", "xs")), written(y.select("s", "c", "chunk", "ids", "ys"))
    y = y.withColumn("s", F.explode(F.array(F.col("s"), F.col("s") + 1)))  # posts of the days before lie in an item's own stretch or the one before
    # empty lists, as Spark goes through a batch again for each null one
    x, y = x.withColumn("ys", F.array().cast(y.schema["ys"].dataType)), y.withColumn("xs", F.array().cast(x.schema["xs"].dataType))
    n, many = F.count(F.lit(1)), lambda c: F.sum(F.size(c)) / ROWS
    blocks = F.greatest(F.ceil(F.greatest(n / (2 * BUSY), many("xs"))), F.least(F.lit(8), F.ceil(n / BLOCK)))
    return _in_cells(x, y, ("c", "chunk"), blocks, F.ceil(F.greatest(n / (8 * BUSY), many("ys") / 4)))


def near_titles(items: DataFrame, posts: DataFrame, days: int = DAYS) -> DataFrame:
    """(id, post_id, shared, containment): posts of the ``days`` before an item whose title shares enough tokens.

    Three shared tokens and 0.40 of the smaller set, or two and 0.50. Token sets meet, with a stretch's rows in chunks, and
    pairs of rows come out where their sets are near: what travels grows with the rows, not with the pairs.
    """

    def classed(df: DataFrame) -> DataFrame:
        tokens = F.array_sort(title_tokens(F.col("title")))
        return written(df.select("id", F.col("published").cast("date").alias("day"), tokens.alias("tokens")).withColumn("token_class", F.md5(F.array_join("tokens", " "))))

    a = classed(items)
    b = a if posts is items else classed(posts)
    sets = token_sets(a, b)

    def chunked(df: DataFrame, name: str) -> DataFrame:
        rows = df.join(sets, "token_class").select("c", "ids", _stretch(F.col("day"), days).alias("s"), "id", "day")
        large = rows.groupBy("c", "s").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK).select("c", "s", F.ceil(F.col("m") / BLOCK).alias("chunks"))
        rows = rows.join(large, ["c", "s"], "left").withColumn("chunk", F.pmod(F.xxhash64("id"), F.coalesce("chunks", F.lit(1))))
        return rows.groupBy("c", "s", "chunk").agg(F.first("ids").alias("ids"), F.collect_list(F.struct("id", "day")).alias(name))

    kept = StructType([a.schema["id"], StructField("post_id", b.schema["id"].dataType), StructField("shared", LongType()), StructField("containment", DoubleType())])
    return near_sets(chunked(a, "xs"), chunked(b, "ys")).mapInArrow(lambda it: _near_rows(it, days), kept).where("id <> post_id")


def _told_by_tokens(a: DataFrame, b: DataFrame, days: int) -> DataFrame:
    """(id, n, nearest) of the items near a post by tokens."""
    sets = token_sets(a, b)
    rows = a.select("id", "day", "token_class").join(sets.select("token_class", "c"), "token_class").select("id", "day", "c")
    s = _stretch(F.col("day"), days).alias("s")
    x = a.select("token_class", "day").distinct().join(sets, "token_class").groupBy("c", s).agg(F.first("ids").alias("ids"), F.collect_list(F.struct("day")).alias("xs")).withColumn("chunk", F.lit(0))
    # posts numbered from the latest on, of a day from the smallest id on: near pairs are counted by numbers alone, which Spark
    # does in a hash map, while a least struct would have all of them sorted and spilled first
    by = b.groupBy("token_class", F.col("day").alias("posted")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    by = written(by.orderBy(F.desc("posted"), "first").select("token_class", "posted", "n", "first", F.monotonically_increasing_id().alias("place")))
    y = by.join(sets, "token_class").groupBy("c", _stretch(F.col("posted"), days).alias("s")).agg(F.first("ids").alias("ids"), F.collect_list(F.struct(F.col("posted").alias("day"), "n", "place")).alias("ys")).withColumn("chunk", F.lit(0))
    met = near_sets(x, y).mapInArrow(lambda it: _near_counts(it, days), "a long, day date, n long, place long")
    told = met.groupBy(F.col("a").alias("c"), "day").agg(F.sum("n").alias("n"), F.min("place").alias("place"))
    told = told.join(by.select("place", F.struct((-F.unix_date("posted")).alias("age"), F.col("first").alias("id")).alias("nearest")), "place")
    return rows.join(told, ["c", "day"]).select("id", "n", "nearest")


def _told(a: DataFrame, b: DataFrame, pairs: DataFrame, key: str, days: int) -> DataFrame:
    """key, day, n, nearest: of each class and day of items, how many posts it meets and which is the latest."""
    by_day = b.groupBy(F.col(key).alias("b"), F.col("day").alias("posted")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    asked = a.select(F.col(key).alias("a"), "day").distinct().join(pairs, "a").withColumn("posted", F.explode(F.sequence(F.date_sub("day", days), F.col("day"))))
    latest = F.min(F.struct((-F.unix_date("posted")).alias("age"), F.col("first").alias("id"))).alias("nearest")
    return asked.join(by_day, ["b", "posted"]).groupBy(F.col("a").alias(key), "day").agg(F.sum("n").alias("n"), latest)


def told_before(items: DataFrame, posts: DataFrame, days: int = DAYS, ratio: float | None = RATIO) -> DataFrame:
    """(id, nearest, n): the items near the title of a post of the ``days`` before, the latest such post (of those the
    smallest id) and their number. ``ratio`` None leaves the letters out.

    items has id, title, published, posts id, title, published; rows without a date are left out, and so are items that no
    post is near. All posts count, also one with the item's own id. Two empty titles are alike.
    """
    a, b = written(_classed(items, "published")), written(_classed(posts, "published"))  # read by every step
    found = [_told_by_tokens(a, b, days)]
    if ratio is not None:
        rows = a.select("id", "day", "title_class")
        found.append(rows.join(_told(a, b, _letter_pairs(a, b, days, ratio), "title_class", days), ["title_class", "day"]).select("id", "n", "nearest"))
    both = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return both.groupBy("id").agg(F.min("nearest")["id"].alias("nearest"), F.sum("n").alias("n"))
