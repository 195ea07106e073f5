"""Token counts by trie-shared dynamic programming over a unigram model.

A text falls into pre-tokens (words with a leading U+2581). The distinct pre-tokens of a batch stand in a trie;
going through it in sorted order, the best unigram score and its number of pieces are computed once for each
prefix that pre-tokens share. A terminal stores its counts, and a text's count is the sum over its words.

The vocabulary is that of a public sentencepiece model; a piece's score is minus the logarithm of its rank, the
rank standing in for frequency. Characters that no piece covers fall back to their UTF-8 bytes at a fixed cost.

Defined cases: a null or wordless text has 0 tokens and score 0; equal scores take fewer pieces; repeated rows are
counted one by one; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedscope.llm.common import Memory

#: What a byte costs that no piece covers, and the distinct pre-tokens that a worker remembers.
BYTE_SCORE, REMEMBERED = -12.0, 400_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
MARK = "▁"


@lru_cache(maxsize=2)
def unigram(path: str) -> dict[str, float]:
    """Piece -> score of a sentencepiece model, without control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return {sp.id_to_piece(i): -math.log(rank) for rank, i in enumerate(plain, 2)}


@lru_cache(maxsize=2)
def endings(path: str) -> set[str]:
    """Every string that a piece ends with: no piece goes on to the left of what isn't among them."""
    return {p[k:] for p in unigram(path) for k in range(len(p))}


def score_trie(tokens: list[str], pieces: dict[str, float], ends: set[str]) -> dict[str, tuple[int, float]]:
    """(pieces, score) of the best segmentation of each pre-token.

    ``tokens`` is sorted, so that going from one to the next walks the trie: the scores of the shared prefix stay.
    """
    done: dict[str, tuple[int, float]] = {}
    score, count, last = [0.0], [0], ""
    get = pieces.get
    for token in tokens:
        shared, n = 0, min(len(last), len(token))
        while shared < n and last[shared] == token[shared]:
            shared += 1
        del score[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(token) + 1):
            width = len(token[end - 1].encode("utf-8", "surrogatepass"))
            best, pieces_in = score[end - 1] + BYTE_SCORE * width, count[end - 1] + width
            for start in range(end - 1, -1, -1):
                part = token[start:end]
                if part not in ends:
                    break
                s = get(part)
                if s is not None:
                    s += score[start]
                    if s > best or s == best and count[start] + 1 < pieces_in:
                        best, pieces_in = s, count[start] + 1
            score.append(best)
            count.append(pieces_in)
        done[token] = (count[-1], score[-1])
        last = token
    return done


_known: dict[str, Memory] = {}


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    pieces, ends = unigram(path), endings(path)
    memory = _known.setdefault(path, Memory(REMEMBERED))
    for b in batches:
        out: tuple[list, list, list] = ([], [], [])
        texts = b.column("text")
        for at in range(0, len(texts), 128):
            cut = [_WORD.findall(t.as_py() or "") for t in texts[at : at + 128]]
            new = memory.lacks(set().union(*cut))
            known = memory.now
            if new:
                known.update((k[1:], v) for k, v in score_trie(sorted(MARK + w for w in new), pieces, ends).items())
            for words in cut:
                both = [known[w] for w in words]
                out[0].append(len(words))
                out[1].append(sum(c for c, _ in both))
                out[2].append(math.fsum(s for _, s in both))
        yield pa.record_batch([b.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["doc_id", "n_words", "n_tokens", "score"])


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_words, n_tokens and the unigram score of each whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: _counted(it, model), "doc_id long, n_words long, n_tokens long, score double")
