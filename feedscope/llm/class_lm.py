"""A class-based bigram language model in the manner of Brown: words fall into classes by exchange, and a text's probability
is the product, token by token, of the transition from the class before and of the word in its class.

What is gathered covers the whole corpus and grows with it. Tables travel packed: a row is what one task has to tell
another, as arrays, so that Spark shuffles few rows and numpy works on them; each task holds what comes to its
partition, or a block.

1. Texts become blocks of some four million tokens. A block has a dictionary of its own and its texts are sequences of local
   numbers, in pieces of bounded length. A piece begins with the token before it (the end token, for a text's first), so
   that pieces hold each pair of neighbours once.
2. Dictionaries meet by word (in parts, by a hash of the word), which gives each word's count in training texts and a number.
   Words that make up 1 / FREQUENT of the training tokens or more are *frequent*: there can't be more than FREQUENT of
   them, whatever the corpus, so only what is known of these may be sent to all tasks. The numbers return to the blocks.
3. Pairs of neighbours are counted, with rare words as one. Frequent words are clustered by exchange: the most frequent ones
   start the classes; then a part of the words at a time, each moves to the class that raises the likelihood of
   the class bigrams most, all else fixed; transition counts are taken anew after each part.
4. Every rare word is put into the class that makes its own neighbours, all of them, most likely.
5. Classes go back to the blocks, pieces become sequences of classes, transitions are counted over all training texts,
   and texts are scored by them.

P(class | class before) is interpolated with P(class) by Witten and Bell's rule; P(word | class) is its share of the class's
tokens. The end token is a class of its own. So is the unknown word, one word as in the base score; P(class) gives it
the count of words seen once (Good and Turing). All words known and the unknown one add up to 1 after every class.

Defined cases: a null or empty text is the end token alone; very long texts run in pieces; rows that share a doc_id are
rows like others; rows without one are training texts and get a null doc_id; where no text is held for training, all
tokens are unknown and the scores still finite; an empty table gives an empty result; columns other than doc_id and
text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedscope.llm.common import drop_written, materialise, slices, written, written_since

CLASSES, FREQUENT = 64, 1 << 18
SWEEPS, PARTS = 4, 2
#: Tokens of a block and of a piece, bytes of texts that are cut into words at a time, pairs counted at a time.
BLOCK, PIECE, STRETCH, PAIRS = 1 << 22, 4096, 1 << 22, 1 << 22
#: How the packed tables are compressed.
CODEC = "zstd"
#: A word's number is its part's, so many bits up, and its own in the part.
PART_BITS = 40
#: Codes of tokens that aren't frequent words; the k-th rare word of a piece is RARE - k.
END, UNKNOWN, RARE = -1, -2, -3
#: What stands for the end token among words.
END_WORD = b""
SPACE = b" \t\n\x0b\x0c\r"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def cut(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(numbers of the words of all texts one after another, the distinct words, how many words each text has); A-Z in
    lower case. Only ASCII white space parts words."""
    low = pc.ascii_trim_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).view(pa.string())))
    lists = pc.ascii_split_whitespace(low)
    words = pc.dictionary_encode(lists.flatten())
    n = pc.list_value_length(lists).to_numpy().astype(np.int64)
    n[pc.binary_length(low).to_numpy() == 0] = 0  # an empty text splits into one empty word
    ids, distinct = words.indices.to_numpy(), words.dictionary.view(pa.binary()).to_pylist()
    if b"" in distinct:
        ids = ids[ids != distinct.index(b"")]
    return ids, distinct, n


def stretches(text: str | None) -> Iterator[bytes]:
    """A text in stretches of bounded size that end between words; one at least."""
    data = (text or "").encode()
    at = 0
    while True:
        end = at + STRETCH
        while end < len(data) and data[end] not in SPACE:
            end += 1
        yield data[at:end]
        at = end
        if at >= len(data):
            return


class _Block:
    """Texts as local numbers; 0 is the end token."""

    def __init__(self, number: int) -> None:
        self.number, self.local, self.n, self.train, self.rows = number, {END_WORD: 0}, 0, [], []

    def numbers(self, words: list[bytes]) -> np.ndarray:
        local = self.local
        return np.fromiter((local.setdefault(w, len(local)) for w in words), np.int32, len(words))

    def add(self, piece: np.ndarray, key: int, doc_id: int | None, held: bool) -> None:
        self.rows.append((key, doc_id, held, piece.tobytes()))
        self.n += len(piece) - 1
        if not held:
            self.train.append(piece[1:])

    def batches(self, parts: int) -> Iterator[pa.RecordBatch]:
        counts = np.bincount(np.concatenate(self.train), minlength=len(self.local)) if self.train else np.zeros(len(self.local), np.int64)
        for at in range(0, len(self.rows), 512):
            key, doc_id, held, seq = zip(*self.rows[at : at + 512], strict=True)
            yield _batch(_BLOCKS, len(key), block=[self.number] * len(key), key=key, doc_id=doc_id, held=held, seq=seq)
        words = list(self.local)
        part = np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            mine = order[ends[p] : ends[p + 1]]
            if len(mine):
                yield _batch(_BLOCKS, 1, block=[self.number], part=[p], words=[b"\n".join(words[k] for k in mine)], local=[mine.astype(np.int32).tobytes()], counts=[counts[mine].astype(np.int64).tobytes()], n=[int(counts[mine].sum())])


_TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
_BLOCKS = "block long, key long, doc_id long, held boolean, seq binary, part int, words binary, local binary, counts binary, n long"


def _batch(schema: str, rows: int, **columns: list) -> pa.RecordBatch:
    """A batch of a schema in Spark's words; columns that aren't given are null."""
    fields = [f.split() for f in schema.split(", ")]
    return pa.record_batch([pa.array(columns[name], _TYPES[kind]) if name in columns else pa.nulls(rows, _TYPES[kind]) for name, kind in fields], names=[name for name, _ in fields])


def _to_blocks(batches: Iterator[pa.RecordBatch], most: int, size: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Blocks of ``most`` tokens, in pieces of ``size``; dictionaries in ``parts`` by word."""
    task, made, key = TaskContext.get().partitionId(), 0, 0
    block = _Block(task << 20)
    waiting: list[tuple[int, int | None, bool, bool]] = []  # of each stretch: its text's key, doc_id, held, and whether the text ends
    texts: list[bytes] = []
    before = END_WORD

    def settle() -> Iterator[pa.RecordBatch]:
        nonlocal block, made, before
        ids, distinct, n = cut(texts)
        at, known = 0, None
        for (number, doc_id, held, last), count in zip(waiting, n.tolist(), strict=True):
            words = ids[at : at + count]
            at += count
            words = np.append(words, len(distinct)) if last else words  # the end token
            for k in range(0, len(words), size):
                if known is None:
                    known = np.append(block.numbers(distinct), 0).astype(np.int32)
                piece = known[words[k : k + size]]
                block.add(np.append(np.int32(block.local.setdefault(before, len(block.local))), piece), number, doc_id, held)
                end = words[min(k + size, len(words)) - 1]
                before = END_WORD if end == len(distinct) else distinct[end]
                if block.n >= most:
                    yield from block.batches(parts)
                    made += 1
                    block, known = _Block(task << 20 | made), None
        waiting.clear()
        texts.clear()

    held_bytes = 0
    for b in slices(batches, 256):
        for doc_id, text, held in zip(*(b.column(c) for c in ("doc_id", "text", "held")), strict=True):
            number, doc_id, held = task << 33 | key, doc_id.as_py(), held.as_py()
            key += 1
            for data in stretches(text.as_py()):
                if texts and held_bytes + len(data) > STRETCH:
                    yield from settle()
                    held_bytes = 0
                waiting.append((number, doc_id, held, False))
                texts.append(data)
                held_bytes += len(data)
            waiting[-1] = (number, doc_id, held, True)
    if texts:
        yield from settle()
    if block.rows:
        yield from block.batches(parts)


_DICTIONARY = "part int, block long, local binary, wid binary, c binary, word long, count long, h long, v long, once long, ends long"


def _dictionary(total: int):
    """Rows of a part, block by block: ``wid`` and ``c`` of a block's words; then the part's frequent words, and its totals."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def part() -> Iterator[pa.RecordBatch]:
            number: dict[bytes, int] = {}
            ids, counts = [], np.zeros(1024, np.int64)
            for _, words, _, n in rows:
                own = np.fromiter((number.setdefault(w, len(number)) for w in words.split(b"\n")), np.int64)
                if len(number) > len(counts):
                    counts = np.append(counts, np.zeros(max(len(number), len(counts)), np.int64))
                counts[own] += np.frombuffer(n, np.int64)  # a block has a word once
                ids.append(own)
            for (block, _, local, _), own in zip(rows, ids, strict=True):
                yield _batch(_DICTIONARY, 1, part=[at], block=[block], local=[local], wid=[(own + (at << PART_BITS)).tobytes()], c=[counts[own].tobytes()])
            counts = counts[: len(number)]
            often = np.flatnonzero((counts * FREQUENT >= total) & (counts > 0)).tolist()
            names, end = list(number), number.get(END_WORD)
            often = [k for k in often if k != end]
            for k in range(0, len(often), 4096):
                some = often[k : k + 4096]
                yield _batch(_DICTIONARY, len(some), word=[x + (at << PART_BITS) for x in some], count=[int(counts[x]) for x in some], h=[int.from_bytes(blake2b(names[x], digest_size=7).digest()) for x in some])
            yield _batch(_DICTIONARY, 1, v=[int((counts > 0).sum())], once=[int((counts == 1).sum())], ends=[int(counts[end]) if end is not None else 0])

        for b in batches:
            for p, *row in zip(*(b.column(c).to_pylist() for c in ("part", "block", "words", "local", "counts")), strict=True):
                if p != at:
                    if rows:
                        yield from part()
                    at, rows = p, []
                rows.append(row)
        if rows:
            yield from part()

    return work


def _by_block(batches: Iterator[pa.RecordBatch], known, coded) -> Iterator[pa.RecordBatch]:
    """What is known of a block's words, then its pieces: ``known`` makes tables of the rows, ``coded`` a batch of some pieces."""
    block, rows, table = None, [], None
    for batch in batches:
        at = batch.column("block").to_numpy()
        kind = batch.column("kind").to_numpy()
        cuts = np.flatnonzero(np.diff(at) | np.diff(kind)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(at)], strict=True):
            if start == end:
                continue
            part = batch.slice(start, end - start)
            if at[start] != block:
                block, rows, table = at[start], [], None
            if kind[start] == 0:
                rows.append(part)
                continue
            if table is None:
                table, rows = known(rows), []
            for k in range(0, part.num_rows, 512):
                yield coded(table, part.slice(k, 512))


def _joined(rows: list[pa.RecordBatch], column: str, dtype) -> np.ndarray:
    """The arrays of a binary column, one after another."""
    return np.frombuffer(b"".join(x for b in rows for x in b.column(column).to_pylist()), dtype)


def _met(words: DataFrame, pieces: DataFrame, by: str, work, schema: str) -> DataFrame:
    """The rows of both tables with the same ``by`` in one task, ``words`` first."""
    both = words.withColumn("kind", F.lit(0)).unionByName(pieces.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition(by).sortWithinPartitions(by, "kind").mapInArrow(work, schema)


_CODED = "block long, key long, doc_id long, held boolean, n_tokens long, n_known long, base double, seq binary, rare binary"


def _code(n: int, v: int, often: np.ndarray):
    """Local numbers become frequent words' numbers (places in ``often``), END, UNKNOWN, or a place in the piece's rare words."""
    order = np.argsort(often)

    def known(rows: list[pa.RecordBatch]):
        local, wid, c = _joined(rows, "local", np.int32), _joined(rows, "wid", np.int64), _joined(rows, "c", np.int64)
        at = np.minimum(np.searchsorted(often, wid, sorter=order), max(len(often) - 1, 0))
        fid = np.where(often[order[at]] == wid, order[at], RARE) if len(often) else np.full(len(wid), RARE)
        to, wids, counts = (np.zeros(len(local), np.int64) for _ in range(3))
        to[local] = np.where(c == 0, UNKNOWN, np.where(local == 0, END, fid))
        wids[local], counts[local] = wid, c
        return to, wids, counts, np.log10((counts + 1) / (n + v + 1))

    def coded(table, b: pa.RecordBatch) -> pa.RecordBatch:
        to, wids, counts, base = table
        out: list[list] = [[], [], [], [], []]
        for data in b.column("seq"):
            s = np.frombuffer(data.as_py(), np.int32)
            codes = to[s]
            rare = np.flatnonzero(codes == RARE)
            own, number = np.unique(wids[s[rare]], return_inverse=True)
            codes[rare] = RARE - number
            for column, value in zip(out, (len(s) - 1, int((counts[s[1:]] > 0).sum()), float(base[s[1:]].sum()), codes.astype(np.int32).tobytes(), own.tobytes()), strict=True):
                column.append(value)
        return _batch(_CODED, b.num_rows, **{c: b.column(c) for c in ("block", "key", "doc_id", "held")}, **dict(zip(("n_tokens", "n_known", "base", "seq", "rare"), out, strict=True)))

    return lambda batches: _by_block(batches, known, coded)


def _spread(part: np.ndarray, parts: int, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each part with its rows of the columns, as arrays."""
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    used = np.flatnonzero(np.diff(ends))
    data = {k: [v[order[ends[p] : ends[p + 1]]].tobytes() for p in used] for k, v in columns.items()}
    return pa.record_batch([pa.array(used, pa.int32()), *(pa.array(v, pa.binary()) for v in data.values())], names=["part", *data])


def _pairs(size: int, parts: int):
    """part, code, n: neighbours in training pieces; ``size`` frequent words, then the end token, then rare words as one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def rows() -> pa.RecordBatch:
            code, count = np.unique(np.concatenate(held), return_counts=True)
            return _spread(code // (size + 2) % parts, parts, code=code, n=count.astype(np.int64))

        for b in batches:
            for data in b.column("seq"):
                s = np.frombuffer(data.as_py(), np.int32).astype(np.int64)
                s = np.where(s >= 0, s, np.where(s == END, size, size + 1))
                held.append(s[:-1] * (size + 2) + s[1:])
                n += len(held[-1])
                if n >= PAIRS:
                    yield rows()
                    held, n = [], 0
        if n:
            yield rows()

    return work


def _by_part(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], whole) -> Iterator[pa.RecordBatch]:
    """``whole(part, rows)`` of the rows (lists of the named columns) of each part, which come sorted by it."""
    at, rows = None, []
    for b in batches:
        for p, *row in zip(*(b.column(c).to_pylist() for c in ("part", *names)), strict=True):
            if p != at:
                if rows:
                    yield from whole(at, rows)
                at, rows = p, []
            rows.append(row)
    if rows:
        yield from whole(at, rows)


def _totals(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and their sums."""
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, np.int64)
    return code[first], np.add.reduceat(n, first) if len(code) else n


def _arrays(rows: list, k: int, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(r[k] for r in rows), dtype)


def _sides(size: int, parts: int):
    """part, w, code, n from a part's pairs: each pair at its first word (code: twice the second) and, but for the end token
    and rare words, at its second (code: twice the first, and 1)."""

    def whole(_: int, rows: list) -> Iterator[pa.RecordBatch]:
        code, n = _totals(_arrays(rows, 0, np.int64), _arrays(rows, 1, np.int64))
        a, b = code // (size + 2), code % (size + 2)
        back = b < size
        w, other = np.concatenate([a, b[back]]), np.concatenate([2 * b, 2 * a[back] + 1])
        yield _spread(w % parts, parts, w=w.astype(np.int32), code=other.astype(np.int32), n=np.concatenate([n, n[back]]))

    return lambda batches: _by_part(batches, ("code", "n"), whole)


def _sorted_sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sides of a part's words, in order of the word."""

    def whole(p: int, rows: list) -> Iterator[pa.RecordBatch]:
        w, code, n = _arrays(rows, 0, np.int32), _arrays(rows, 1, np.int32), _arrays(rows, 2, np.int64)
        order = np.argsort(w, kind="stable")
        yield pa.record_batch([pa.array([p], pa.int32()), *(pa.array([x[order].tobytes()], pa.binary()) for x in (w, code, n))], names=["part", "w", "code", "n"])

    return _by_part(batches, ("w", "code", "n"), whole)


def _read_sides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for w, code, n in zip(*(b.column(c) for c in ("w", "code", "n")), strict=True):
            yield np.frombuffer(w.as_py(), np.int32), np.frombuffer(code.as_py(), np.int32), np.frombuffer(n.as_py(), np.int64)


def _transitions(around: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Counts of class pairs, by the class of each frequent word, of the end token and of rare words."""
    size = CLASSES + 2
    shared = around.sparkSession.sparkContext.broadcast(classes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, of = np.zeros(size * size), shared.value.astype(np.int64)
        for w, code, n in _read_sides(batches):
            first = code & 1 == 0
            total += np.bincount(of[w[first]] * size + of[code[first] >> 1], n[first], size * size)
        yield _cells(total)

    return _matrix(around.select("w", "code", "n").mapInArrow(work, "at int, n long"), size)


def _cells(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at].astype(np.int64))], names=["at", "n"])


def _matrix(cells: DataFrame, size: int) -> np.ndarray:
    got = cells.groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(size, size)


def f(x: np.ndarray) -> np.ndarray:
    """x log x, 0 for 0."""
    return x * np.log(np.where(x > 0, x, 1.0))


def likelihood(t: np.ndarray) -> float:
    """What the classes add to the likelihood of the tokens; every token has one before and one after it."""
    return float(f(t).sum() - f(t.sum(axis=1)).sum() - f(t.sum(axis=0)).sum())


def best_class(t: np.ndarray, was: int, right: np.ndarray, left: np.ndarray, own: float, ft: np.ndarray | None = None) -> int:
    """The class to which a word of class ``was`` should move; ``right`` and ``left`` count its neighbours' classes without
    itself, ``own`` its being its own neighbour. The exact change of ``likelihood``, all other words fixed. ``ft`` is f(t)."""
    k, n = CLASSES, right.sum() + own
    total = t.sum(axis=1)  # the tokens of each class, as every token has one before and one after it
    total[was] -= n
    t, ft = t.copy(), f(t) if ft is None else ft.copy()
    t[was] -= right
    t[:, was] -= left
    t[was, was] -= own
    ft[was], ft[:, was] = f(t[was]), f(t[:, was])
    r, c = np.flatnonzero(right), np.flatnonzero(left)
    gain = (f(t[:k, r] + right[r]) - ft[:k, r]).sum(axis=1) + (f(t[c, :k] + left[c][:, None]) - ft[c, :k]).sum(axis=0)
    d = np.arange(k)
    mid, both = t[d, d], right[:k] + left[:k]  # the cell of the class with itself is in both sums
    gain += f(mid + both + own) - f(mid + right[:k]) - f(mid + left[:k]) + ft[d, d]
    gain -= 2 * (f(total[:k] + n) - f(total[:k]))
    best = int(gain.argmax())
    return was if was < k and gain[best] <= gain[was] + 1e-9 * abs(gain[was]) else best


def _exchange(around: DataFrame, classes: np.ndarray, t: np.ndarray, k: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, their best classes) of the frequent words from ``first`` on whose number leaves ``k`` of PARTS."""
    size = CLASSES + 2
    width = 2 * size + 1
    shared = around.sparkSession.sparkContext.broadcast((classes, t))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, table = shared.value[0].astype(np.int64), shared.value[1]
        ft = f(table)
        for w, code, n in _read_sides(batches):
            mine = (w % PARTS == k) & (w >= first) & (w < len(of) - 2)
            w, code, n = w[mine], code[mine], n[mine]
            other, side = code >> 1, code & 1
            column = np.where(other == w, 2 * size, side * size + of[other])
            n = np.where((other == w) & (side == 1), 0, n)  # its own neighbour once
            words, number = np.unique(w, return_inverse=True)
            sums = np.bincount(number * width + column, n, len(words) * width).reshape(-1, width)
            best = [best_class(table, int(of[x]), r[:size], r[size : 2 * size], float(r[-1]), ft) for x, r in zip(words, sums, strict=True)]
            yield pa.record_batch([pa.array(words, pa.int32()), pa.array(best, pa.int32())], names=["w", "class"])

    got = around.select("w", "code", "n").mapInArrow(choose, "w int, class int").toArrow()  # FREQUENT rows at most
    return got["w"].to_numpy(), got["class"].to_numpy()


def cluster(around: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(the class of each of ``size`` frequent words, of the end token and of rare words as one; counts of class pairs)."""
    classes = np.full(size + 2, CLASSES + 1, np.int16)
    classes[: min(size, CLASSES)] = np.arange(min(size, CLASSES))
    classes[size] = CLASSES
    t = _transitions(around, classes)
    best = (-np.inf, classes, t)
    for sweep in range(SWEEPS + 1 if size else 0):
        for k in range(PARTS):
            w, c = _exchange(around, classes, t, k, CLASSES if sweep == 0 else 0)  # the first sweep places, the others exchange
            if not (classes[w] != c).any():
                continue
            classes = classes.copy()
            classes[w] = c
            t = _transitions(around, classes)
        if sweep and likelihood(t) <= best[0]:
            break
        best = (likelihood(t), classes, t)
    return best[1], best[2]


def _contexts(classes: np.ndarray, parts: int):
    """part, wid, code, n: the classes beside each rare word of training pieces, after it and (+ CLASSES + 2) before it."""
    size = CLASSES + 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        n = 0

        def rows() -> pa.RecordBatch:
            wid, number = np.unique(np.concatenate(held[0]), return_inverse=True)
            cell, count = np.unique(number * (2 * size) + np.concatenate(held[1]), return_counts=True)
            wid = wid[cell // (2 * size)]
            return _spread(wid >> PART_BITS, parts, wid=wid, code=(cell % (2 * size)).astype(np.uint8), n=count.astype(np.int32))

        for b in batches:
            for seq, rare in zip(b.column("seq"), b.column("rare"), strict=True):
                s, own = np.frombuffer(seq.as_py(), np.int32), np.frombuffer(rare.as_py(), np.int64)
                if not len(own):
                    continue
                of = np.where(s >= 0, classes[np.maximum(s, 0)], np.where(s == END, CLASSES, CLASSES + 1)).astype(np.int64)
                first, last = np.flatnonzero(s[:-1] <= RARE), np.flatnonzero(s[1:] <= RARE)
                held[0] += [own[RARE - s[first]], own[RARE - s[last + 1]]]
                held[1] += [of[first + 1], size + of[last]]
                n += len(first) + len(last)
                if n >= PAIRS:
                    yield rows()
                    held, n = [[], []], 0
        if n:
            yield rows()

    return work


def placement(t: np.ndarray) -> np.ndarray:
    """By context code: the log probability that each class gives to a neighbour, and for the class before, to the word."""
    k = CLASSES
    total = t.sum(axis=1)
    share = (total + 1) / (total.sum() + len(total))
    p = np.log((t + share) / (total + 1)[:, None])  # p[c, d]: d after c
    out = np.concatenate([p[:k].T, p[:, :k] - np.log(np.maximum(total[:k], 1))])
    out[:, total[:k] == 0] = -np.inf if (total[:k] > 0).any() else 0.0
    return out.astype(np.float32)


def place(wid: np.ndarray, code: np.ndarray, n: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words in order, their best classes, how often they occur) from the classes beside them."""
    order = np.argsort(wid, kind="stable")
    wid, code, n = wid[order], code[order].astype(np.int64), n[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, wid[1:] != wid[:-1]])
    best = np.empty(len(first), np.int32)
    ends = np.append(first, len(wid))
    for at in range(0, len(first), 1 << 14):  # some words at a time: a number for each class and entry
        k = slice(ends[at], ends[min(at + (1 << 14), len(first))])
        score = np.add.reduceat(table[code[k]] * n[k, None].astype(np.float32), first[at : at + (1 << 14)] - ends[at], axis=0)
        best[at : at + (1 << 14)] = score.argmax(axis=1)
    return wid[first], best, np.add.reduceat(np.where(code >= len(table) // 2, n, 0), first)


_PLACED = "block long, wid binary, class binary, n binary, totals binary"


def _place(table: np.ndarray):
    """The rare words of each block with class and count, part by part; and each part's tokens by class."""

    def whole(_: int, rows: list) -> Iterator[pa.RecordBatch]:
        met = [r for r in rows if r[0] == 0]
        if not met:
            return
        wid, best, n = place(_arrays(met, 2, np.int64), _arrays(met, 3, np.uint8), _arrays(met, 4, np.int32), table)
        for kind, block, data, *_ in rows:
            if kind:
                own = np.frombuffer(data, np.int64)
                at = np.minimum(np.searchsorted(wid, own), len(wid) - 1)
                own, at = own[wid[at] == own], at[wid[at] == own]
                if len(own):
                    yield _batch(_PLACED, 1, block=[block], wid=[own.tobytes()], **{"class": [best[at].astype(np.uint8).tobytes()]}, n=[n[at].tobytes()])
        yield _batch(_PLACED, 1, totals=[np.bincount(best, n, CLASSES + 2).astype(np.int64).tobytes()])

    return lambda batches: _by_part(batches, ("kind", "block", "wid", "code", "n"), whole)


_CLASSED = "key long, doc_id long, held boolean, n_tokens long, n_known long, base double, emitted double, classes binary"


def _classed(classes: np.ndarray, counts: np.ndarray, ends: int, totals: np.ndarray):
    """Pieces as sequences of classes, with the log probability of their words in their classes."""

    def known(rows: list[pa.RecordBatch]):
        wid, of, n = _joined(rows, "wid", np.int64), _joined(rows, "class", np.uint8), _joined(rows, "n", np.int64)
        order = np.argsort(wid)
        return wid[order], of[order].astype(np.int64), n[order]

    def coded(table, b: pa.RecordBatch) -> pa.RecordBatch:
        emitted, out = [], []
        for seq, rare in zip(b.column("seq"), b.column("rare"), strict=True):
            s, own = np.frombuffer(seq.as_py(), np.int32), np.frombuffer(rare.as_py(), np.int64)
            c = np.where(s == END, CLASSES, CLASSES + 1)
            n = np.ones(len(s))
            n[s == END] = ends
            often = s >= 0
            c[often], n[often] = classes[s[often]], counts[s[often]]
            seldom = s <= RARE
            if len(own):
                at = np.searchsorted(table[0], own)[RARE - s[seldom]]
                c[seldom], n[seldom] = table[1][at], table[2][at]
            emitted.append(float(np.log10(n[1:] / totals[c[1:]]).sum()))
            out.append(c.astype(np.uint8).tobytes())
        return _batch(_CLASSED, b.num_rows, **{x: b.column(x) for x in ("key", "doc_id", "held", "n_tokens", "n_known", "base")}, emitted=emitted, classes=out)

    return lambda batches: _by_block(batches, known, coded)


def _class_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = CLASSES + 2
    total = np.zeros(size * size)
    for b in batches:
        for data in b.column("classes"):
            c = np.frombuffer(data.as_py(), np.uint8).astype(np.int64)
            total += np.bincount(c[:-1] * size + c[1:], minlength=size * size)
    yield _cells(total)


def log_transitions(t: np.ndarray, once: int) -> np.ndarray:
    """log10 P(class | class before) from counts, smoothed; rows add up to 1."""
    each = t.sum(axis=0)
    each[-1] += once  # unknown words: as many as were seen once
    share = (each + 1) / (each.sum() + len(each))
    total, kinds = t.sum(axis=1), np.maximum((t > 0).sum(axis=1), 1)
    return np.log10((t + kinds[:, None] * share) / (total + kinds)[:, None])


def _scored(table: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = []
            for data, emitted in zip(b.column("classes"), b.column("emitted").to_pylist(), strict=True):
                c = np.frombuffer(data.as_py(), np.uint8)
                scores.append(emitted + float(table[c[:-1], c[1:]].sum()))
            yield pa.record_batch([*(b.column(x) for x in ("key", "doc_id", "held", "n_tokens", "n_known", "base")), pa.array(scores, pa.float64())], names=["key", "doc_id", "held", "n_tokens", "n_known", "base", "score"])

    return work


def _unpacked_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield _cells(_joined([b], "totals", np.int64).reshape(-1, CLASSES + 2).sum(axis=0))


def _written(df: DataFrame, name: str):
    """(the rows, read from a table; what deletes it)."""
    begun = written()
    table = materialise(df, name, CODEC)
    folders = written_since(begun)
    return table, lambda: drop_written(df.sparkSession, folders)


@dataclass
class Classified:
    """The pieces of all texts as sequences of classes; how many tokens were trained on, and words seen once."""

    pieces: DataFrame
    n: int
    once: int


def classify(docs: DataFrame, block: int = BLOCK, piece: int = PIECE) -> Classified:
    """Learn the classes from the training texts and write all texts as sequences of them."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held"))
    blocks, drop_blocks = _written(rows.mapInArrow(lambda it: _to_blocks(it, block, piece, parts), _BLOCKS), "blocks")
    n = blocks.agg(F.sum("n")).first()[0] or 0
    by_part = blocks.where("part IS NOT NULL").select("part", "block", "words", "local", "counts").repartition("part").sortWithinPartitions("part")
    dictionary, drop_dictionary = _written(by_part.mapInArrow(_dictionary(n), _DICTIONARY), "dictionary")
    v, once, ends = (x or 0 for x in dictionary.agg(F.sum("v"), F.sum("once"), F.sum("ends")).first())
    got = dictionary.where("word IS NOT NULL").select("word", "count", "h").toArrow()  # FREQUENT rows at most
    wid, counts, h = (got[c].to_numpy() for c in ("word", "count", "h"))
    order = np.lexsort((wid, h, -counts))
    often, counts = wid[order], counts[order]
    slots = dictionary.where("block IS NOT NULL")
    pieces = blocks.where("part IS NULL").select("block", "key", "doc_id", "held", "seq")
    coded, drop_coded = _written(_met(slots.select("block", "local", "wid", "c"), pieces, "block", _code(n, v, often), _CODED), "coded")
    drop_blocks()
    training = coded.where(~F.col("held"))
    pairs = training.select("seq").mapInArrow(_pairs(len(counts), parts), "part int, code binary, n binary")
    sides = pairs.repartition("part").sortWithinPartitions("part").mapInArrow(_sides(len(counts), parts), "part int, w binary, code binary, n binary")
    around, drop_around = _written(sides.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_sorted_sides, "part int, w binary, code binary, n binary"), "around")
    classes, t = cluster(around, len(counts))
    drop_around()
    contexts = training.select("seq", "rare").mapInArrow(_contexts(classes, parts), "part int, wid binary, code binary, n binary")
    placed, drop_placed = _written(_met(contexts, slots.select("part", "block", "wid"), "part", _place(placement(t)), _PLACED), "placed")
    drop_dictionary()
    totals = np.zeros(CLASSES + 2)
    np.add.at(totals, classes[: len(counts)].astype(int), counts)
    for at, k in placed.where("totals IS NOT NULL").mapInArrow(_unpacked_totals, "at int, n long").groupBy("at").agg(F.sum("n")).collect():
        totals[at] += k
    totals[CLASSES], totals[CLASSES + 1] = max(ends, 1), 1
    pieces = coded.select("block", "key", "doc_id", "held", "n_tokens", "n_known", "base", "seq", "rare")
    classed = materialise(_met(placed.where("block IS NOT NULL").select("block", "wid", "class", "n"), pieces, "block", _classed(classes, counts, ends, totals), _CLASSED), "classed", CODEC)
    drop_coded()
    drop_placed()
    return Classified(classed, n, once)


def score_texts(docs: DataFrame, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of each whole text."""
    found = classify(docs, block, piece)
    t = _matrix(found.pieces.where(~F.col("held")).select("classes").mapInArrow(_class_pairs, "at int, n long"), CLASSES + 2)
    scored = found.pieces.mapInArrow(_scored(log_transitions(t, found.once)), "key long, doc_id long, held boolean, n_tokens long, n_known long, base double, score double")
    out = scored.groupBy("key").agg(*(F.first(c).alias(c) for c in ("doc_id", "held")), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")))
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return out.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(found.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", perplexity.alias("perplexity"))
