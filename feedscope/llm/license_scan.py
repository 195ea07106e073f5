"""License scans: fuzzy search for short notices.

A notice found with at most k edits holds one of k + 1 pieces of it unchanged (pigeonhole), so an automaton
over all pieces finds the seeds; around each seed lies a window where the whole notice would stand. Windows in which
the notice's first letters already take more than k edits, counted bit by bit for many windows at once, drop out; in the
others the regex library searches the notice with bounded errors, and what it finds gives edits and span. Every seed is looked at in a window of its
own, so that a copy with more edits isn't passed over for a better one beside it.

Beside the fuzzy notices, base phrases count where their words stand one after another.

A word is a run of characters that are not ASCII, or are ASCII letters or digits; A-Z count as a-z. Defined
cases: a null or empty text has no words and no labels; a very long text is scanned whole, in time that grows with its
length and its seeds; overlapping finds of one label and place keep the fewest edits, ties the first notice; repeated
rows, and rows without a doc_id, are scanned one by one; an empty table gives an empty result; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed by contract: phrase and label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Short notices in lower case, single blanks, without punctuation.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the gnu general public license version 3", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("licensed under the bsd 3 clause license", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under a creative commons attribution", "cc"),
    ("released into the public domain", "public-domain"),
    ("all rights reserved", "proprietary"),
)
#: A notice may have one edit for each so many characters.
CHARS_AN_EDIT = 10
_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, notices array<struct<label:string,notice:int,edits:int,first_word:long,last_word:long,quote:string>>"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_IN_WORD = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A for b in range(256)])


def allowed(notice: str) -> int:
    return len(notice) // CHARS_AN_EDIT


def pieces(notice: str) -> list[tuple[str, int]]:
    """k + 1 pieces of near equal length, with their offsets: k edits leave one of them whole."""
    n, k = len(notice), allowed(notice) + 1
    cuts = [round(i * n / k) for i in range(k + 1)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a, found = ahocorasick.Automaton(), {}
    for i, (notice, _) in enumerate(NOTICES):
        for piece, off in pieces(notice):
            found.setdefault(piece, []).append((i, off))
    for piece, where in found.items():
        a.add_word(piece, (len(piece), where))
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def _patterns() -> list:
    return [regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={allowed(notice)}}}") for notice, _ in NOTICES]


#: Windows whose edits are counted at a time.
WINDOWS = 1 << 15


@lru_cache(maxsize=None)
def _letter_bits(i: int) -> np.ndarray:
    """For each ASCII letter, the places among a notice's first 64 where it stands, as bits; none for other characters."""
    out = np.zeros(129, np.uint64)
    for k, c in enumerate(NOTICES[i][0][:64]):
        out[ord(c)] |= np.uint64(1) << np.uint64(k)
    return out


def least_edits(i: int, codes: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """How many edits turn the notice's first letters (64 at most) into some stretch of each window (start, stop) of the codes.

    No more than the whole notice takes. The columns of the table of edits are kept as bits that tell by how much
    neighbouring cells differ.
    """
    bits, m = _letter_bits(i), min(64, len(NOTICES[i][0]))
    one, top = np.uint64(1), np.uint64(m - 1)
    least = np.empty(len(windows), np.int64)
    for at in range(0, len(windows), WINDOWS):
        lo, hi = windows[at : at + WINDOWS].T
        up, down = np.full(len(lo), ~np.uint64(0)), np.zeros(len(lo), np.uint64)
        now = np.full(len(lo), m)
        best = now.copy()
        for t in range(int((hi - lo).max(initial=0))):
            place = lo + t
            eq = bits[np.minimum(codes[np.minimum(place, len(codes) - 1)], 128)]
            across = eq | down
            along = (((eq & up) + up) ^ up) | eq
            more, less = down | ~(along | up), up & along
            now += ((more >> top) & one).astype(np.int64) - ((less >> top) & one).astype(np.int64)
            best = np.where(place < hi, np.minimum(best, now), best)
            more, less = more << one, less << one
            up, down = less | ~(across | more), more & across
        least[at : at + WINDOWS] = best
    return least


def fuzzy(bare: str) -> list[tuple[int, int, int, int]]:
    """(notice, edits, start, stop) of notices in a text of words with single blanks."""
    windows: dict[int, set[tuple[int, int]]] = {}
    for end, (n, where) in _automaton().iter(bare):
        for i, off in where:
            k = allowed(NOTICES[i][0])
            start = end + 1 - n - off
            windows.setdefault(i, set()).add((max(0, start - k), min(len(bare), start + len(NOTICES[i][0]) + k)))
    found, codes = [], np.frombuffer(bare.encode("utf-32-le", "surrogatepass"), np.uint32)
    for i, own in windows.items():
        own = np.array(sorted(own))
        own = own[least_edits(i, codes, own) <= allowed(NOTICES[i][0])]
        found += [(i, *m) for m in _apart(i, bare, set(map(tuple, own.tolist())))]
    return found


def _apart(i: int, bare: str, windows: set[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(edits, start, stop) of a notice's finds in the windows, in order: of overlapping finds the one with the fewest
    edits, and what is left of the other's window is searched again."""
    least = len(NOTICES[i][0]) - allowed(NOTICES[i][0])
    queue: list[tuple[int, int, int, int, int]] = []

    def search(lo: int, hi: int) -> None:
        if hi - lo >= least and (m := _patterns()[i].search(bare, lo, hi)):
            heappush(queue, (sum(m.fuzzy_counts), m.start(), m.end(), lo, hi))

    for lo, hi in sorted(windows):
        search(lo, hi)
    kept: list[tuple[int, int, int]] = []  # (start, stop, edits), apart and in order
    while queue:
        edits, start, stop, lo, hi = heappop(queue)
        at = bisect_right(kept, (start,))
        near = [k for k in kept[max(0, at - 1) : at + 2] if k[0] < stop and k[1] > start]
        if not near:
            insort(kept, (start, stop, edits))
            continue
        for a, b in zip([lo, *(k[1] for k in near)], [*(k[0] for k in near), hi], strict=True):
            search(a, b)
    return [(edits, start, stop) for start, stop, edits in kept]


#: The phrases' words: a text with none of the last words has no phrase.
_PHRASES = [(regex.compile(rb"(?<![0-9a-z\x80-\xff])" + rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+".join(regex.escape(w).encode() for w in phrase.split()) + rb"(?![0-9a-z\x80-\xff])"), label) for phrase, label in BASE]


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels and the notices of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    inside = _IN_WORD[np.frombuffer(raw, np.uint8)]
    starts = np.nonzero(np.diff(inside.astype(np.int8), prepend=0) == 1)[0]
    places, labels = [], set()
    for pattern, label in _PHRASES if b"license" in raw else ():
        for m in pattern.finditer(raw, overlapped=True):
            places.append(int(np.searchsorted(starts, m.start())))
            labels.add(label)
    # words with single blanks between them, and the word that each character belongs to
    bare_bytes = np.where(inside, np.frombuffer(raw, np.uint8), 32)
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    bare = bare_bytes[keep].astype(np.uint8).tobytes().decode("utf-8", "surrogatepass")
    blanks = np.nonzero(np.frombuffer(bare.encode("utf-32-le", "surrogatepass"), "<u4") == 32)[0]
    lead = int(bare[:1] == " ")
    best: dict[tuple[str, int], tuple] = {}
    for i, edits, start, stop in fuzzy(bare):
        first = int(np.searchsorted(blanks, start + (bare[start : start + 1] == " ")))
        last = max(first, int(np.searchsorted(blanks, max(start, stop - 1))))
        row = (NOTICES[i][1], i, edits, first - lead, last - lead, bare[start:stop])
        at = (row[0], row[3])
        if at not in best or edits < best[at][2]:
            best[at] = row
    notices = [dict(zip(("label", "notice", "edits", "first_word", "last_word", "quote"), r, strict=True)) for r in sorted(best.values(), key=lambda r: (r[3], r[0]))]
    return len(starts), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), notices


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.int32()), ("edits", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("quote", pa.string())]))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), kind)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "notices"]
    for b in batches:
        rows = [scan(t.as_py()) for t in b.column("text")]
        cols = zip(*rows, strict=True) if rows else [[]] * 6
        yield pa.record_batch([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base finds and the list of fuzzy notices with their edits and spans."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scanned, _SCHEMA)


def license_digest(docs: DataFrame) -> DataFrame:
    rows = scan_licenses(docs)
    lengths = F.array(*[F.lit(len(n)) for n, _ in NOTICES])
    own = F.transform("notices", lambda x: x["label"])
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    likeness = F.transform("notices", lambda x: 1 - x["edits"] / F.get(lengths, x["notice"]))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(likeness), F.lit(0.0)))
    labels = F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",")
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"), F.size("notices").cast("long").alias("n_notices"))
