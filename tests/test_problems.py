"""The general operators against brute force on small random tables with nulls, ties, repeats, and clashing extra columns."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from tidelog import OPEN
from tidelog.operators import asof, cdc, history, incremental, intervals, orphans
from tidelog.sources.shared import fresh_folder


def frame(spark, rows, schema, extra=True):
    """A table with further columns under names that operators use inside."""
    df = spark.createDataFrame(rows, schema)
    if extra:
        df = df.selectExpr("*", "1 as _blk", "'x' as _salt", "2 as _h", "3 as _cell", "4 as _end", "5 as _t", "6 as _side", "7 as _nulls")
    return df


def got(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def maybe(rng, x, share=0.08):
    return None if rng.random() < share else x


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("least", [10**9, 4])
def test_versions(spark, seed, least):
    rng = random.Random(seed)
    rows = [(maybe(rng, rng.choice(["a", "b"])), maybe(rng, rng.choice("xyz")), maybe(rng, rng.choice("pq")), maybe(rng, rng.randrange(25)), maybe(rng, rng.choice("uv"), 0.2), i) for i in range(150)]
    rows += rows[:10]
    ends = [("a", "x", 12), ("a", "x", 15), ("b", "y", None), ("b", "z", 0), (None, "x", 3)]
    df = history.versions(frame(spark, rows, "kind string, record_id string, property string, sim_time long, value string, row_seq long"), frame(spark, ends, "kind string, record_id string, ended_at long"), least)
    stop = {}
    for k, r, e in ends:
        if e is not None and k is not None:
            stop[k, r] = min(e, stop.get((k, r), e))
    want = Counter()
    keys = {r[:3] for r in rows}
    for key in keys:
        end = stop.get(key[:2])
        mine = {}
        for r in sorted((r for r in rows if r[:3] == key and r[3] is not None and (end is None or r[3] < end)), key=lambda r: r[5]):
            mine[r[3]] = r[4]
        out = []
        for t in sorted(mine):
            if not out or out[-1][1] != mine[t]:
                out.append((t, mine[t]))
        for i, (t, v) in enumerate(out):
            want[(*key, t, out[i + 1][0] if i + 1 < len(out) else OPEN if end is None else end, v)] += 1
    assert got(df, "kind", "record_id", "property", "valid_from", "valid_to", "value") == want


@pytest.mark.parametrize("least", [10**9, 5])
def test_orphans(spark, least):
    rng = random.Random(4)
    refs = [("s", rng.choice("fg"), i, maybe(rng, rng.choice(["k", "l"])), maybe(rng, rng.choice("abcde")), maybe(rng, rng.randrange(10) * 43_200_000_000_000)) for i in range(200)]
    refs += refs[:7]
    parents = [("k", "a", 0, None), ("k", "b", 86_400_000_000_000, 200_000_000_000_000), ("l", "a", None, 90_000_000_000_000), ("l", "c", 0, None), ("l", "c", 5, 10), (None, "d", 0, None)]
    df = orphans.orphans(frame(spark, refs, "src string, ref_field string, row_key long, ref_kind string, ref_id string, ref_time long"), frame(spark, parents, "kind string, record_id string, created_at long, ended_at long"), least)
    lives = {}
    for k, i, b, e in parents:
        was = lives.get((k, i))
        b = -(2**63) if b is None else b
        e = 2**63 - 1 if e is None else e
        lives[k, i] = (min(b, was[0]), max(e, was[1])) if was else (b, e)
    want = Counter()
    for s, f, n, k, i, t in refs:
        if k is None or i is None:
            continue
        life = lives.get((k, i))
        if life is None or (t is not None and (t < life[0] or t >= life[1] != 2**63 - 1)):
            want[s, f, n, None if t is None else t // 86_400_000_000_000] += 1
    assert got(df, "src", "ref_field", "row_key", "sim_day") == want
    assert sum(r[0] for r in orphans.orphan_counts(df).select("orphans").collect()) == sum(want.values())


@pytest.mark.parametrize("least", [10**9, 4])
def test_last_known(spark, least):
    rng = random.Random(8)
    changes = [(maybe(rng, rng.choice("abc")), maybe(rng, rng.randrange(20)), maybe(rng, rng.randrange(30)), i, maybe(rng, rng.choice("uv"), 0.3)) for i in range(120)]
    events = [(maybe(rng, rng.choice("abcd")), maybe(rng, rng.randrange(32)), i) for i in range(80)] + [("a", 5, 500), ("a", 5, 500)]
    df = asof.last_known(frame(spark, events, "record_id string, event_time long, event_seq long"), frame(spark, changes, "record_id string, sim_time long, known_sim_time long, row_seq long, value string"), least)
    want = Counter()
    for r, t, n in events:
        fits = [(c[1], c[3], c[4]) for c in changes if r is not None and t is not None and c[0] == r and None not in (c[1], c[2]) and c[1] <= t and c[2] <= t]
        if fits:
            best = max(fits, key=lambda f: f[:2])
            want[n, best[1], best[2]] += 1
    assert got(df, "event_seq", "change_seq", "value") == want


@pytest.mark.parametrize("least", [10**9, 4])
def test_periods_and_gaps(spark, least):
    rng = random.Random(15)
    rows = [(maybe(rng, rng.choice("abc")), maybe(rng, s := rng.randrange(200)), maybe(rng, s + rng.randrange(-3, 8), 0.02)) for _ in range(120)]
    rows += rows[:9]
    df = intervals.periods_and_gaps(frame(spark, rows, "record_id string, start_ns long, end_ns long"), least)
    want = Counter()
    for key in "abc":
        out = []
        for s, e in sorted((s, OPEN if e is None else e) for k, s, e in rows if k == key and s is not None and (e is None or s < e)):
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        want.update((key, "period", s, e) for s, e in out)
        want.update((key, "gap", a[1], b[0]) for a, b in zip(out, out[1:], strict=False))
    assert got(df, "record_id", "span", "start_ns", "end_ns") == want


SCHEMA = "q string, p string, event_sim_time long, cls int, change_id long, arrival_seq long"


def places(rows):
    latest = {}
    for r in rows:
        if r[4] is not None:
            rank = (r[5] is not None, r[5] or 0)
            if r[4] not in latest or rank > latest[r[4]][0]:
                latest[r[4]] = (rank, r)
    state = {}
    usable = [r for _, r in latest.values() if None not in (r[0], r[1], r[2], r[3])]
    for q, p, _, cls, change, _ in sorted(usable, key=lambda r: (r[2], r[3], r[4])):
        if cls == 0 or (cls == 1 and (q, p) in state):
            state[q, p] = change
        elif cls == 2:
            state.pop((q, p), None)
    return {(*k, v) for k, v in state.items()}


@pytest.mark.parametrize("batches", [1, 4])
def test_changes_in_batches(spark, batches):
    rng = random.Random(23)
    rows = []
    for i in range(300):
        change = rng.randrange(180)
        rows.append((maybe(rng, rng.choice("ab"), 0.03), maybe(rng, rng.choice("xyz"), 0.03), maybe(rng, rng.randrange(60), 0.03), maybe(rng, rng.choice([0, 1, 2]), 0.05), maybe(rng, change, 0.02), i))
    rng.shuffle(rows)
    data = frame(spark, rows, SCHEMA)
    table = cdc.BucketedTable(spark, fresh_folder(spark, "t"), spark.createDataFrame([], SCHEMA).schema, ["q", "p"], "change_id", "arrival_seq", buckets=5)
    for b in range(batches):
        table.apply(data.where(f"pmod(arrival_seq * 7, {batches}) = {b}"))
    assert {tuple(r) for r in table.read().collect()} == places(rows)
    # the same deliveries again change nothing, and a batch touches only its own buckets
    before = table.manifests.latest()["changes"]
    one = data.where("change_id is not null and q is not null and p is not null").limit(1)
    now = table.apply(one)
    assert {tuple(r) for r in table.read().collect()} == places(rows)
    assert len([k for k in before if now["changes"].get(k) != before[k]]) <= 2
    table.expire()
    assert {tuple(r) for r in table.read().collect()} == places(rows)


def test_only_touched_buckets_are_read_and_written(spark):
    """A batch that names one bucket reads and writes that one; the index is read only where the batch's changes hash to."""
    schema = spark.createDataFrame([], SCHEMA).schema
    table = cdc.BucketedTable(spark, fresh_folder(spark, "t"), schema, ["q", "p"], "change_id", "arrival_seq", buckets=64)
    rows = [("q", f"p{i}", i, 0, i, i) for i in range(400)]
    before = table.apply(spark.createDataFrame(rows, SCHEMA))
    assert len(before["touched"]) > 50
    read, files = [], table._files
    table._files = lambda what, s, buckets=None: (read.append((what, None if buckets is None else sorted(buckets))), files(what, s, buckets))[1]
    now = table.apply(spark.createDataFrame([("q", "p7", 500, 2, 900, 900)], SCHEMA))
    (bucket,) = now["touched"]
    assert dict(read)["changes"] == [bucket] and len(dict(read)["homes"]) == 1 and len(read) == 2
    for what in ("changes", "rows"):
        assert {k for k in before[what] if now[what].get(k) != before[what][k]} == {str(bucket)}
    assert len(table.changes([bucket]).inputFiles()) < 8 and table.read().count() == 399
    # a delivery that corrects the key takes the change out of its old bucket; an older one does nothing
    table.apply(spark.createDataFrame([("q", "other", 7, 0, 3, 950), ("q", "p5", 9, 1, 4, 2)], SCHEMA))
    state = {(r["p"], r["change_id"]) for r in table.read().collect()}
    assert ("other", 3) in state and ("p3", 3) not in state and ("p4", 4) in state and ("p5", 4) not in state


def test_of_two_racing_publishers_one_wins(spark):
    from concurrent.futures import ThreadPoolExecutor

    from tidelog.sources.shared import Manifests

    m = Manifests(spark, fresh_folder(spark, "race"))
    m.publish({"by": -1}, 0)

    def run(i):
        try:
            return m.publish({"by": i}, 1)["by"]
        except RuntimeError:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [x for x in pool.map(run, range(24)) if x is not None]
    assert len(won) == 1 and m.latest() == {"by": won[0], "version": 2}


def test_a_failed_batch_leaves_the_table(spark):
    table = cdc.BucketedTable(spark, fresh_folder(spark, "t"), spark.createDataFrame([], SCHEMA).schema, ["q", "p"], "change_id", "arrival_seq", buckets=3)
    table.apply(spark.createDataFrame([("a", "x", 1, 0, 1, 1)], SCHEMA))
    publish, table.manifests.publish = table.manifests.publish, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        table.apply(spark.createDataFrame([("a", "x", 2, 2, 2, 2)], SCHEMA))
    assert table.read().count() == 1
    table.manifests.publish = publish
    table.apply(spark.createDataFrame([("a", "x", 2, 2, 2, 2)], SCHEMA))
    assert table.read().count() == 0
    with pytest.raises(RuntimeError):
        table.manifests.publish({}, 0)  # somebody else published that version


def test_words_of_changes(spark):
    rows = [(0, None), (None, " JOIN "), (None, "Up date"), (None, "leave\t"), (None, "moved"), (7, "join"), (None, None), (2, "leave")]
    df = spark.createDataFrame(rows, "event_class int, op string").select(cdc.change_class("event_class", "op").alias("c"))
    assert [r[0] for r in df.collect()] == [0, 0, 1, 2, None, 0, None, 2]


def test_target(spark):
    schema = "feed string, record_id string, sim_time long, value string, row_seq long"
    rng = random.Random(5)
    rows = [(maybe(rng, "f"), maybe(rng, rng.choice("ab")), maybe(rng, rng.randrange(4)), maybe(rng, rng.choice(["", "v", "w" * 50])), i) for i in range(60)]
    data = frame(spark, rows, schema)
    keys = ["feed", "record_id", "sim_time", "value"]
    t = incremental.Target(spark, fresh_folder(spark, "target"), spark.createDataFrame([], schema).schema, keys, "row_seq")
    t.publish(data.where("row_seq < 20"))
    done = {r[:4] for r in rows if r[4] < 20}
    want = {}
    for r in rows:
        if r[:4] not in done:
            want[r[:4]] = min(r[4], want.get(r[:4], r[4]))
    first = t.publish(t.due(data))
    assert got(first, *keys, "row_seq") == Counter((*k, v) for k, v in want.items())
    assert t.due(data).count() == 0


def test_exported_windows(spark):
    cell = 10
    rows = [("f", t, t + k, t * 10 + k) for t in range(-5, 60) for k in (0, 3)] + [("g", 5, 5, 1), (None, 5, 5, 2), ("f", None, 5, 3), ("f", 5, None, 4)]
    windows = [("f", 0, 10, "a", 12, "2024-01-01"), ("f", 0, 10, "a", 5, "2024-01-01"), ("f", 7, 35, "a", 30, "2024-01-01"), ("f", 40, 50, "b", 99, "2024-01-01"), ("f", 50, 55, "a", 99, None), ("f", 58, 57, "a", 99, "2024-01-01"), ("g", None, 9, "a", 9, "2024-01-01")]
    meta = [("f", "a"), ("g", "z")]
    w = spark.createDataFrame(windows, "feed string, start_ns long, end_ns long, fingerprint string, read_ns long, committed_at string")
    m = spark.createDataFrame(meta, "feed string, fingerprint string")
    df = incremental.exported(frame(spark, rows, "feed string, sim_time long, known_sim_time long, n long"), w, m, cell)
    good = [x for x in windows if (x[0], x[3]) in meta and x[5] and x[1] is not None]
    want = Counter(r[3] for r in rows if None not in r[:3] and any(x[0] == r[0] and x[1] <= r[1] < x[2] and r[2] <= x[4] for x in good))
    assert Counter(r[0] for r in df.select("n").collect()) == want


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p5_wide", "p6_found"])
def test_empty_tables(spark, tmp_path, name):
    from tidelog.plans import problems

    source = "/root/testdata/sf0.001"
    for t in ("history", "records__patient", "records__doctor", "records__queue", "membership__patient__visits", "membership_events", "export_windows", "export_meta"):
        spark.read.parquet(f"{source}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert problems.QUERIES[name](spark, f"file://{tmp_path}").count() == 0


@pytest.mark.parametrize("arrivals", [[None] * 4, [None, 7, None, 9]])
def test_waiting_lists_without_order_of_arrival(spark, tmp_path, arrivals):
    """Deliveries without arrival_seq are the lowest version, not left out."""
    from tidelog.plans import problems

    rows = [("q", 1, 0, None, "a", 1), ("q", 2, None, " Join", "b", 2), ("q", 3, 2, "leave", "a", 3), ("r", 4, 0, "join", "a", 4)]
    schema = "record_id string, event_sim_time long, event_class int, op string, member__patient__id string, change_id long, arrival_seq long"
    spark.createDataFrame([(*r, a) for r, a in zip(rows, arrivals, strict=True)], schema).write.parquet(f"{tmp_path}/membership_events.parquet")
    assert got(problems.p1_found(spark, str(tmp_path)), "*") == Counter([("q", "b", 2), ("r", "a", 4)])
    assert got(problems.p1_queue_lengths(spark, str(tmp_path)), "*") == Counter([("q", 1), ("r", 1)])
