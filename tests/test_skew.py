"""The paths for hot groups must give what the plain paths give."""

import random
from functools import partial

import pytest

from tests.oracle import connect, difference
from tidelog.operators import asof, history, intervals, kernels, orphans, skew
from tidelog.plans import problems, reference

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name,module,function,least", [
    ("p2_found", history, "versions", 30),
    ("p3_found", orphans, "orphans", 100),
    ("p5_found", asof, "attributes_at", 40),
    ("p6_found", intervals, "periods_and_gaps", 20),
])
def test_hot_paths_agree(spark, monkeypatch, name, module, function, least):
    monkeypatch.setattr(module, function, partial(getattr(module, function), min_rows=least))
    assert difference(problems.QUERIES[name](spark, FOLDER), connect(FOLDER), problems.SQL[name]) == ""


@pytest.mark.parametrize("name,least", [
    ("der_versions", 15), ("exp_scd2_window", 15), ("inc_windows_make_the_whole", 15), ("der_occupancy", 15), ("exp_source_log_window", 15), ("exp_fact_interval", 15), ("exp_fact_history_window", 15),
    ("exp_ordinal", 12), ("join_as_of", 30), ("exp_fk_at_a_moment", 3), ("der_row_events", 15),
])
def test_windows_of_hot_groups_agree(spark, monkeypatch, name, least):
    """Every operator with an order per record, with its groups cut into blocks, and with carries joined instead of sent to all tasks."""
    monkeypatch.setattr(skew, "MIN_ROWS", least)
    cut = []
    blocks = skew.with_blocks
    monkeypatch.setattr(skew, "with_blocks", lambda df, keys, order, hot, m=least: (cut.append(len(hot)), blocks(df, keys, order, hot, m))[1])
    for small in (skew.SMALL, 0):
        monkeypatch.setattr(skew, "SMALL", small)
        assert difference(reference.QUERIES[name](spark, FOLDER), connect(FOLDER), reference.SQL[name]) == ""
    assert max(cut) > 0


@pytest.mark.parametrize("least", [10**9, 6])
def test_neighbours_along_groups(spark, least):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(30)]), rng.choice([None, 1, 2]), i) for i in range(160)]
    data = spark.createDataFrame(rows, "g string, o long, v long, id long").selectExpr("*", "1 as _blk", "2 as _at")
    made = kernels.along_groups(data, ["g"], ["o", "id"], "o", leads={"nxt": "v"}, lags={"prev": "v"}, sums={"total": "v"}, number="n", min_rows=least)
    got = {r["id"]: (r["nxt"], r["prev"], r["total"], r["n"]) for r in made.collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[3]))
        for i, r in enumerate(own):
            seen = [x[2] for x in own[: i + 1] if x[2] is not None]
            want = (own[i + 1][2] if i + 1 < len(own) else None, own[i - 1][2] if i else None, sum(seen) if seen else None, i + 1)
            assert got[r[3]] == want


def test_a_group_has_blocks_by_its_own_size(spark):
    data = spark.range(12_000).selectExpr("if(id < 10000, 'big', if(id < 11500, 'mid', cast(id as string))) as k", "id as t")
    (hot,) = skew.hot_groups(data, ["k"], min_rows=500)
    assert len(hot) == 2
    counts = {r["k"]: r["n"] for r in skew.with_blocks(data, ["k"], "t", hot, 500).where("_blk > 0").groupBy("k").agg({"_blk": "max"}).withColumnRenamed("max(_blk)", "n").collect()}
    assert 15 <= counts["big"] <= 22 and 2 <= counts["mid"] <= 5


def test_planning_starts_no_job(spark):
    """The audit log is numbered, which writes it, only when it is asked for."""
    from tidelog.plans import config, incremental
    from tidelog.sources.adapters import clinic

    bundle, jobs = clinic(spark, FOLDER), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "")
    planned = incremental.export_tables(bundle, config.export(reference._SOURCE))
    assert [t.deferred for t in planned] == [False, False, True] and len(jobs.getJobIdsForGroup("planning")) == 0
    spark.sparkContext.setJobGroup("", "")
    assert planned[2].frame.columns[0] == "id"
