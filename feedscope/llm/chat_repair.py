"""Minimum-cost role repair of conversations and their rendering.

A conversation is legal if an optional system turn comes first, user and assistant turns then alternate from a
user turn on, and an assistant turn ends it. Each turn is kept, relabelled, or merged into the turn before it;
an empty turn may be inserted before a turn and at the end. Every step has a cost, and dynamic programming over
the automaton's states finds the cheapest legal sequence.

A stretch of turns maps the state before it to the cheapest cost of each state after it. Such maps combine, so
that one conversation may be spread over many tasks: chunks are bounded in turns and in bytes, each gives its map, the
maps of a conversation are combined in order (a row for each chunk), and each chunk is then traced back between known
states. The rendered text comes as one piece for each turn; a conversation's pieces in order are its text.

Defined cases: roles are compared in lower case and without blanks, known aliases count as their role, a null or
unknown role must be relabelled; a null or empty text is empty, a very long one stays whole; turns with equal numbers go
by role and text, null first, and repeated rows are turns of their own; of equally cheap repairs the first in the order
of ``steps`` is taken; rows without a conv_id form one conversation of their own, rows without a turn come first; an
empty table gives an empty result; columns other than conv_id, turn, role, text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedscope.llm.common import materialise

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "chatbot": "assistant", "developer": "system"}
#: Costs of the repairs.
RELABEL, UNKNOWN, MERGE, INSERT = 4, 2, 1, 3
#: Turns and bytes of text of a chunk, and of a batch that a worker gives out.
CHUNK_TURNS, CHUNK_BYTES, BATCH = 4096, 4_000_000, 5000
#: Letters of a text from which the ranges of turns are drawn.
PREFIX = 64
#: State 0 is before the first turn, then the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
_FAR = 1 << 40
_OUT = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("pos", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("action", pa.string()), ("inserted", pa.string()), ("cost", pa.int64()), ("piece", pa.string())])


def state_of(role: str | None) -> int | None:
    r = (role or "").strip().lower()
    r = ALIASES.get(r, r)
    return ROLES.index(r) + 1 if r in ROLES else None


def steps(role: int | None) -> list[tuple[int, int, int, int | None, bool]]:
    """(state before, state after, cost, inserted state, merged) that a turn of this role allows."""
    found = []
    for before in range(4):
        for after in (SYSTEM, USER, ASSISTANT):
            label = 0 if role == after else UNKNOWN if role is None else RELABEL
            if after in _NEXT[before]:
                found.append((before, after, label, None, False))
            elif before == after:
                found.append((before, after, label + MERGE, None, True))
            else:
                between = [x for x in _NEXT[before] if after in _NEXT[x]]
                if between:
                    found.append((before, after, label + INSERT, between[-1], False))
    return found


_STEPS = {r: steps(r) for r in (None, SYSTEM, USER, ASSISTANT)}
#: What ending a conversation costs, and the empty turns it takes.
_END = {START: (0, ()), ASSISTANT: (0, ()), USER: (INSERT, (ASSISTANT,)), SYSTEM: (2 * INSERT, (USER, ASSISTANT))}


def forward(roles: list[int | None], costs: list[int]) -> tuple[list[int], list[list[tuple | None]]]:
    """The costs of the states after the turns, and the best step into each state at each turn."""
    taken = []
    for r in roles:
        new, best = [_FAR] * 4, [None] * 4
        for step in _STEPS[r]:
            c = costs[step[0]] + step[2]
            if c < new[step[1]]:
                new[step[1]], best[step[1]] = c, step
        costs = new
        taken.append(best)
    return costs, taken


def trace(taken: list[list[tuple | None]], last: int) -> list[tuple]:
    path = []
    for best in reversed(taken):
        path.append(best[last])
        last = best[last][0]
    return path[::-1]


def entry(state: int) -> list[int]:
    return [0 if s == state else _FAR for s in range(4)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the chunks of sorted rows: a new one with each conversation, and where one is full."""
    chunk = (TaskContext.get().partitionId() << 32) - 1
    conv, turns, held = (), 0, 0
    for b in batches:
        numbers = []
        sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist()
        for c, size in zip(b.column("conv_id").to_pylist(), sizes, strict=True):
            if c != conv or turns >= CHUNK_TURNS or held >= CHUNK_BYTES:
                chunk, conv, turns, held = chunk + 1, c, 0, 0
            turns, held = turns + 1, held + size
            numbers.append(chunk)
        yield pa.record_batch([*b.columns, pa.array(numbers, pa.int64())], names=[*b.schema.names, "chunk"])


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight: Callable[[tuple], int] = lambda r: 0) -> Iterator[pa.RecordBatch]:
    """Rows in batches of a bounded number and weight."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += weight(row)
        if len(out) >= BATCH or held >= CHUNK_BYTES:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out, held = [], 0
    if out:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[list[dict]]:
    """Runs of rows with equal keys in sorted batches."""
    run: list[dict] = []
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            for row in b.slice(at, 1024).to_pylist():
                if run and any(row[k] != run[0][k] for k in key):
                    yield run
                    run = []
                run.append(row)
    if run:
        yield run


_MAP = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("map", pa.list_(pa.int64()))])
_BOUND = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("ends", pa.bool_()), ("cost", pa.int64())])


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The map of each chunk of a conversation, without holding the chunk."""

    def rows() -> Iterator[tuple]:
        key, maps = None, []
        for b in batches:
            for conv, chunk, role in zip(*(b.column(c).to_pylist() for c in ("conv_id", "chunk", "role")), strict=True):
                if (conv, chunk) != key:
                    if key:
                        yield (*key, sum(maps, []))
                    key, maps = (conv, chunk), [entry(s) for s in range(4)]
                maps = [forward([state_of(role)], m)[0] for m in maps]
        if key:
            yield (*key, sum(maps, []))

    yield from _batches(rows(), _MAP)


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states on either side of each chunk on the cheapest way through its conversation."""

    def rows() -> Iterator[tuple]:
        for run in _groups(batches, ("conv_id",)):
            costs, taken = entry(START), []
            for row in run:
                m = [row["map"][4 * s : 4 * s + 4] for s in range(4)]
                best = [min((costs[s] + m[s][t], s) for s in range(4)) for t in range(4)]
                costs = [min(c, _FAR) for c, _ in best]
                taken.append([s for _, s in best])
            last = min(range(4), key=lambda s: costs[s] + _END[s][0])
            total = costs[last] + _END[last][0]
            for k in range(len(run) - 1, -1, -1):
                first = taken[k][last]
                yield (run[k]["conv_id"], run[k]["chunk"], first, last, k == len(run) - 1, total)
                last = first

    yield from _batches(rows(), _BOUND)


def _open(state: int) -> str:
    return f"<|im_start|>{ROLES[state - 1]}\n"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for run in _groups(batches, ("conv_id", "chunk")):
            roles = [state_of(r["role"]) for r in run]
            _, taken = forward(roles, entry(run[0]["first"]))
            path = trace(taken, run[0]["last"])
            for pos, (row, role, (before, after, cost, inserted, merged)) in enumerate(zip(run, roles, path, strict=True)):
                text, action = row["text"] or "", "keep" if role == after else "relabel"
                if merged:
                    piece, action = f"\n{text}", "merge" if action == "keep" else "relabel_merge"
                else:
                    piece = "" if before == START else "<|im_end|>\n"
                    piece += f"{_open(inserted)}<|im_end|>\n" if inserted else ""
                    piece += _open(after) + text
                if row["ends"] and pos == len(run) - 1:
                    piece += "<|im_end|>\n" + "".join(f"{_open(s)}<|im_end|>\n" for s in _END[after][1])
                    cost += _END[after][0]
                yield (row["conv_id"], row["chunk"], pos, row["turn"], ROLES[after - 1], action, ROLES[inserted - 1] if inserted else None, cost, piece)

    yield from _batches(rows(), _OUT, lambda r: len(r[8]))


def repair(turns: DataFrame, ranges: int | None = None) -> DataFrame:
    """A row for each turn: conv_id, chunk, pos (its order), turn, role, action, inserted, cost, piece.

    Chunks are numbered in the order of the turns, so that (conv_id, chunk, pos) sorts a conversation.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    ranges = ranges or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "text", "tie"]
    # ranges are drawn from a text's first letters, not from whole texts; equal short texts are told apart by the tie
    begin, short = F.substring(F.coalesce("text", F.lit("")), 1, PREFIX), F.length("text") <= PREFIX
    dealt = rows.repartitionByRange(ranges, "conv_id", "turn", "role", F.col("text").isNotNull(), begin, F.when(short, F.col("tie")).otherwise(1 << 62)).sortWithinPartitions(*order)
    chunks = materialise(dealt.mapInArrow(_cut, "conv_id long, turn long, role string, text string, tie long, chunk long"), "turns")
    key, inner = ["conv_id", "chunk"], ["conv_id", "chunk", "turn", "role", "text", "tie"]
    maps = chunks.select("conv_id", "chunk", "turn", "role", "tie").repartition(*key).sortWithinPartitions("conv_id", "chunk", "turn", "role", "tie")
    maps = maps.select("conv_id", "chunk", "role").mapInArrow(_maps, "conv_id long, chunk long, map array<long>")
    bounds = maps.repartition("conv_id").sortWithinPartitions(*key).mapInArrow(_bounds, "conv_id long, chunk long, first int, last int, ends boolean, cost long")
    bounds = bounds.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), "first", "last", "ends")
    joined = chunks.join(bounds, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k"))).drop("c", "k")
    ready = joined.repartition(*key).sortWithinPartitions(*inner)
    return ready.mapInArrow(_pieces, "conv_id long, chunk long, pos long, turn long, role string, action string, inserted string, cost long, piece string")
