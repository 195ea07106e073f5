"""Months, statuses, constraints, boards and late counts."""

import datetime
import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from feedscope.operators import archive, joins, ranks, readings, windows
from feedscope.plans import constraints
from feedscope.sources import monthly
from feedscope.streaming import jobs

ROWS = "id string, seen_at timestamp, score double, status string"


def day(m, d):
    return datetime.datetime(2024, m, d)


def test_only_touched_months_are_written(spark, tmp_path):
    path = str(tmp_path / "months")
    first = [("a", day(1, 3), 1.0, "radar"), ("b", day(1, 9), 2.0, "radar"), ("c", day(2, 1), 3.0, "radar"), ("d", day(3, 1), 4.0, "radar"), ("a", day(1, 5), 7.0, "promoted")]
    monthly.merge_months(spark.createDataFrame(first, ROWS), path, ["score"])
    stamps = lambda: {f: os.stat(f).st_mtime_ns for top, _, names in os.walk(path) for f in (f"{top}/{n}" for n in names) if f.endswith(".parquet")}
    before = stamps()
    second = [("c", day(2, 20), 9.0, "dismissed"), ("e", day(2, 2), 5.0, "radar"), (None, day(3, 1), 1.0, "radar"), ("x", None, 1.0, "radar")]
    got = monthly.merge_months(spark.createDataFrame(second, ROWS), path, ["score"])
    assert {(r.id, r.change, r.score, r.status, r.seen_at) for r in got.collect()} == {("c", "refreshed", 9.0, "radar", day(2, 1)), ("e", "inserted", 5.0, "radar", day(2, 2))}
    after = stamps()
    kept = {f for f in before if "month=2024-02" not in f}
    assert kept and all(after[f] == before[f] for f in kept) and not any(f in after for f in before if "month=2024-02" in f)
    rows = {r.id: (r.score, r.status, r.month) for r in monthly.read_months(spark, path, ["2024-01", "2024-02", "2024-03"], ROWS).collect()}
    assert rows == {"a": (7.0, "radar", "2024-01"), "b": (2.0, "radar", "2024-01"), "c": (9.0, "radar", "2024-02"), "d": (4.0, "radar", "2024-03"), "e": (5.0, "radar", "2024-02")}
    same = monthly.merge_months(spark.createDataFrame(second, ROWS), path, ["score"], changes=True)
    assert {r.change for r in same.collect()} == {"refreshed"} and stamps() == after
    assert monthly.merge_months(spark.createDataFrame([], ROWS), path, ["score"]).collect() == [] and stamps() == after


def brute_states(events, table, start):
    state, out = {}, {}
    for k, at, symbol, n in sorted(events, key=lambda e: (e[0] is None, e[0] or "", e[1], e[3])):
        now = state.get(k, start)
        legal = (now, symbol) in table
        state[k] = table[now, symbol] if legal else now
        out[n] = (now, state[k], legal)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_states_by_composition(spark, seed):
    """A hot key over many tasks, and every event's state as one pass would have it."""
    rng = random.Random(seed)
    table = {("a", "x"): "b", ("b", "x"): "c", ("c", "y"): "a", ("b", "y"): "b"}
    events = [(rng.choice(["hot"] * 6 + ["k1", "k2", None]), rng.randrange(99), rng.choice(["x", "y", "z", None]), n) for n in range(2500)]
    got = ranks.states(spark.createDataFrame(events, "key string, at int, symbol string, n long").repartition(4), "key", ["at", "n"], "symbol", table, "a").collect()
    assert {r.n: (r.before, r.after, r.legal) for r in got} == brute_states(events, table, "a")


def test_statuses_and_expiries(spark):
    events = [("p", 1, 1, "promoted"), ("p", 2, 2, "radar"), ("p", 3, 3, "dismissed"), ("q", 1, 4, "dismissed"), ("q", 2, 5, "promoted"), ("r", 1, 6, "nonsense"), ("s", 1, 7, None)]
    got = monthly.current_statuses(spark.createDataFrame(events, "id string, at int, seq int, status string"))
    assert {tuple(r) for r in got.collect()} == {("p", "dismissed", 3, 1), ("q", "dismissed", 2, 1), ("r", "radar", 1, 1), ("s", "radar", 1, 1)}
    queue = spark.createDataFrame([("c", "old", day(1, 1), 0), ("c", "tried", day(1, 30), 3), ("c", "fine", day(1, 30), 1), ("c", "undated", None, 0)], "channel string, key string, queued_at timestamp, attempts int")
    lost = monthly.expiries(windows.pruned_queue(queue, F.lit(day(1, 31))))
    assert {tuple(r) for r in lost.collect()} == {("c", "old", "queue_expired", "budget"), ("c", "undated", "queue_expired", "budget"), ("c", "tried", "publish_attempts_exhausted", "budget")}


def test_constraints_in_one_pass(spark):
    rules = (constraints.Constraint("low", "v < 0"), constraints.Constraint("gap", "w IS NULL", "warning", since="2024-02-01"), constraints.Constraint("never", "v > 1000"))
    rows = [(1, -1, 1, day(1, 1)), (2, -2, None, day(1, 2)), (3, 5, None, day(3, 1)), (4, None, None, None), (5, 7, 7, day(1, 1))]
    df = spark.createDataFrame(rows, "id long, v int, w int, at timestamp")
    seen = Observation("totals")
    got = constraints.violations(df, rules, "id", "at", seen).collect()
    want = {("low", "error", 1), ("low", "error", 2), ("gap", "grandfathered", 2), ("gap", "warning", 3), ("gap", "warning", 4)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert seen.get == {"rows": 5, "low:broken": 2, "low:grandfathered": 0, "gap:broken": 2, "gap:grandfathered": 1, "never:broken": 0, "never:grandfathered": 0}
    assert {tuple(r) for r in constraints.report(df, rules, "at").collect()} == {("low", "error", 2, 0, 5), ("gap", "warning", 2, 1, 5), ("never", "error", 0, 0, 5)}
    assert all(r.rows == 0 for r in constraints.report(df.limit(0), rules, "at").collect())


def test_boards(spark):
    rng = random.Random(4)
    rows = []
    for k in range(300):
        rows.append((rng.choice("xy"), f"i{k:03}", f"m{rng.randrange(12)}", rng.choice(["v1", "v2", "v3"]), rng.choice([None, 1.0, 2.0, 3.5, 9.0]), day(1, 1 + k % 28), rng.choice(["vendor", "lab"]), k > 200, f"i{rng.randrange(300):03}" if rng.random() < 0.2 else None))
    df = spark.createDataFrame(rows, "benchmark string, id string, model string, vendor string, value double, measured_at timestamp, measured_by string, is_new boolean, supersedes string")
    info = spark.createDataFrame([("x", True), ("y", False)], "benchmark string, higher_is_better boolean")
    got = {tuple(r) for r in readings.boards(df, info, spark.createDataFrame([("v1",), ("v2",)], "vendor string"), k=10).collect()}
    gone = {r[8] for r in rows}
    live = [r for r in rows if r[1] not in gone]
    want = set()
    for b, sign in (("x", -1), ("y", 1)):
        mine = [r for r in live if r[0] == b]
        by = lambda r: (r[4] is None, sign * (r[4] or 0))  # noqa: B023, E731
        for n, r in enumerate(sorted(sorted(sorted(mine, key=lambda r: r[1]), key=lambda r: r[5], reverse=True), key=by)[:10], 1):
            want.add(("table", b, r[1], r[2], r[4], n, len(mine)))
        for n, r in enumerate(sorted((r for r in mine if r[6] != "vendor"), key=lambda r: (*by(r), r[1]))[:5], 1):
            if r[7]:
                want.add(("new_leader" if n == 1 else "new_top_entrant", b, r[1], r[2], r[4], n, len(mine)))
    known, total = {r[2] for r in live if not r[7]}, Counter(r[0] for r in live)
    firsts = defaultdict(list)
    for r in live:
        if r[7] and r[2] not in known and r[3] in ("v1", "v2"):
            firsts[r[2]].append(r)
    for m, rs in firsts.items():
        r = min(rs, key=lambda r: (r[5], r[1]))
        want.add(("first_measurement", r[0], r[1], m, r[4], 1, total[r[0]]))
    assert got == want


def test_related_by_threads_first(spark):
    posts = spark.createDataFrame([(1, "a", ["t"], 1), (2, "a", ["t"], 2), (3, "b", ["t"], 3), (4, "b", ["u"], 4), (5, "a", ["t"], 5)], "id long, kind string, topics array<string>, published int")
    threads = spark.createDataFrame([("s", 0, 4), ("s", 1, 1), ("s", 2, 99), ("s", 3, 5)], "thread string, ord int, id long")
    got = {(r.id, r.rank): (r.other, r.priority) for r in joins.related(posts, threads=threads).collect()}
    assert [got.get((1, k)) for k in (1, 2, 3)] == [(4, 0), (5, 0), (3, 1)]
    assert [got.get((4, k)) for k in (1, 2, 3)] == [(1, 0), (5, 0), None]
    assert [got.get((2, k)) for k in (1, 2, 3)] == [(3, 1), (5, 2), (1, 2)]


def test_thread_lists_and_replay(spark):
    lists = spark.createDataFrame([("t", [5, 9, 3, 5]), ("u", [9]), ("v", [])], "thread string, ids array<long>")
    posts = spark.createDataFrame([(3,), (5,), (7,)], "id long")
    got = windows.positions(windows.members(lists, posts)).collect()
    assert {tuple(r) for r in got} == {("t", 5, 1, 2, None, 3), ("t", 3, 2, 2, 5, None)}
    log = spark.createDataFrame([("a", "slow", day(1, 1), 1, "c", "u1"), ("a", "dull", day(1, 2), 2, "c", "u1"), ("b", "slow", day(1, 1), 3, "d", "u2"), (None, "slow", day(1, 1), 4, "c", "u3")], "item string, reason string, at timestamp, seq int, channel string, url string")
    cursor = spark.createDataFrame([("a",), ("b",), ("z",)], "item string")
    found = archive.replay(log, cursor, channels=["c"], reasons=["slow"])
    assert {(r.item, r.state) for r in found.collect()} == {("a", "in_cursor"), (None, "no_id")}
    assert {r.item for r in archive.offered_again(cursor, found).collect()} == {"b", "z"}
    assert {(r.item, r.reason) for r in archive.replay(log, cursor, urls=["u1"]).collect()} == {("a", "dull")}
    with pytest.raises(ValueError, match="reason or a url"):
        archive.replay(log, cursor)


def test_late_events_are_counted_once(spark, tmp_path):
    """An event a month late is counted, and a batch that runs again replaces its own counts."""
    source, path, state = (str(tmp_path / k) for k in ("in", "out", "state"))
    schema = "kind string, at timestamp"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    put([("a", day(3, 1)), ("a", day(3, 1)), ("b", day(3, 2))])
    jobs.counted_batches(stream(), path, state, length="1 day")
    put([("a", day(3, 5))])
    jobs.counted_batches(stream(), path, state, length="1 day")
    put([("b", day(1, 31)), ("a", day(3, 1))])
    got = jobs.counted_batches(stream(), path, state, length="1 day")
    want = {(day(3, 1), "a", 3), (day(3, 2), "b", 1), (day(3, 5), "a", 1), (day(1, 31), "b", 1)}
    assert {tuple(r) for r in got.collect()} == want
    last = max(int(d.split("=")[1]) for d in os.listdir(path) if d.startswith("batch="))
    os.remove(next(f"{state}/commits/{f}" for f in sorted(os.listdir(f"{state}/commits"), reverse=True) if f == str(last)))
    os.path.exists(f"{state}/commits/.{last}.crc") and os.remove(f"{state}/commits/.{last}.crc")
    assert {tuple(r) for r in jobs.counted_batches(stream(), path, state, length="1 day").collect()} == want
