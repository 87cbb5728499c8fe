"""State, versions and events of a bundle's records.

Of history rows of one property at one instant that with the greatest value
counts (null smallest); a null value is a value. All functions are lazy.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators import kernels, skew
from tidelog.sources.bundle import Bundle, spark_type

#: Classes of events at one instant, in the order they apply.
OPS = {"c": 0, "u": 1, "d": 2}
JOIN, LEAVE = 0, 1


def busy(bundle: Bundle, kind: str, properties: Sequence[str]) -> dict[int, int]:
    """The records with very many history rows, from one scan of the history itself."""
    (hot,) = skew.hot_groups(bundle.history(kind, properties), ["record_id"], min_rows=skew.MIN_ROWS)
    return hot


def _instants(bundle: Bundle, kind: str, properties: Sequence[str]) -> DataFrame:
    """One row per record and instant, with a struct per property that changed then, else null."""
    rows = bundle.history(kind, properties).where("record_id is not null and sim_time is not null")
    picks = [F.max(F.when(F.col("property") == p, F.struct("value"))).alias(f"_p_{p}") for p in properties]
    return rows.groupBy("record_id", "sim_time").agg(*picks)


def versions(bundle: Bundle, kind: str, properties: Sequence[str] | None = None, scope: Sequence[str] | None = None) -> DataFrame:
    """record_id, version_start, version_end and every tracked property as of the start.

    One version per record and instant at which any property of ``scope`` (by
    default all tracked ones, projected or not) has a history row; the end is
    the next start, null for the last. Deactivation does not end a version.
    """
    scope = list(scope if scope is not None else bundle.sidecar.tracked(kind))
    properties = list(properties if properties is not None else scope)
    wide = _instants(bundle, kind, sorted({*scope, *properties}))
    hot = busy(bundle, kind, sorted({*scope, *properties}))
    filled = kernels.fill_last(wide, ["record_id"], ["sim_time"], [f"_p_{p}" for p in properties], hot=hot)
    if set(properties) - set(scope):
        filled = filled.where(" or ".join(f"`_p_{p}` is not null" for p in scope))
    ended = kernels.along_groups(filled, ["record_id"], ["sim_time"], "sim_time", leads={"_end": "sim_time"}, hot=hot)
    return ended.select("record_id", F.col("sim_time").alias("version_start"), F.col("_end").alias("version_end"), *(F.col(f"_p_{p}.value").alias(p) for p in properties))


def latest_values(bundle: Bundle, kind: str, properties: Sequence[str], horizon: int | None, inclusive: bool = False) -> DataFrame:
    """record_id and the last value of each property before the horizon (at or before it if inclusive), as text; one shuffle for all."""
    rows = bundle.history(kind, properties)
    if horizon is not None:
        rows = rows.where(F.col("sim_time") <= horizon if inclusive else F.col("sim_time") < horizon)
    best = [F.max(F.when(F.col("property") == p, F.struct("sim_time", "value"))).alias(f"_l_{p}") for p in properties]
    return rows.groupBy("record_id").agg(*best).select("record_id", *(F.col(f"_l_{p}.value").alias(p) for p in properties))


def state_at(bundle: Bundle, kind: str, properties: Sequence[str] | None = None, horizon: int | None = None) -> DataFrame:
    """The records created before the horizon as they were just before it; without horizon, at the end of the tape.

    Tracked properties come from history, others keep their value at the
    slice. ``active`` and ``deactivated_at`` are derived for the horizon;
    without one they are taken as they are. Values have their declared types.
    """
    table = bundle.sidecar.records(kind)
    properties = list(properties if properties is not None else table.properties())
    tracked = [p for p in properties if table.column(f"prop__{p}").history_tracked]
    rows = bundle.records(kind)
    if horizon is not None:
        gone = F.col("deactivated_at").isNotNull() & (F.col("deactivated_at") < horizon)
        rows = rows.where(F.col("created_sim_time") < horizon).withColumns({"active": ~gone, "deactivated_at": F.when(gone, F.col("deactivated_at"))})
    keep = [c for c in rows.columns if c not in {f"prop__{p}" for p in tracked} and not c.startswith("ref_index__") and (not c.startswith("prop__") or c[6:] in properties)]
    rows = rows.select(*keep)
    if tracked:
        values = latest_values(bundle, kind, tracked, horizon)
        typed = [F.expr(f"try_cast(`{p}` AS {spark_type(table.column(f'prop__{p}').type)})").alias(f"prop__{p}") for p in tracked]
        rows = rows.join(values.select("record_id", *typed), "record_id", "left")
    lead = [c for c in keep if not c.startswith("prop__")]
    return rows.select(*lead, *(f"prop__{p}" for p in properties))


def membership_state_at(bundle: Bundle, kind: str, prop: str, horizon: int) -> DataFrame:
    """The intervals open just before the horizon."""
    return bundle.membership(kind, prop).where((F.col("joined_sim_time") < horizon) & (F.col("left_sim_time").isNull() | (F.col("left_sim_time") >= horizon)))


def row_events(bundle: Bundle, kind: str, properties: Sequence[str], scope: Sequence[str] | None = None, hot: dict[int, int] | None = None) -> DataFrame:
    """The change feed of a kind: record_id, sim_time, op, op_class and the after-image of ``properties`` as text.

    c at creation, u at each later instant with a history row of the scope
    (by default all tracked properties, so the events don't depend on what is
    shown), d at deactivation with a null image. Tracked properties are as of
    the event, others as at the slice.
    """
    table = bundle.sidecar.records(kind)
    tracked = [p for p in properties if table.column(f"prop__{p}").history_tracked]
    scope = list(scope if scope is not None else bundle.sidecar.tracked(kind))
    records = bundle.records(kind)
    arm = lambda df, time, op: df.select("record_id", F.col(time).alias("sim_time"), F.lit(op).alias("op"))
    created = arm(records, "created_sim_time", "c")
    gone = arm(records.where("deactivated_at is not null"), "deactivated_at", "d")
    events = created.unionByName(gone)
    if scope:
        changes = bundle.history(kind, scope).select("record_id", "sim_time").distinct()
        changes = changes.join(records.select("record_id", "created_sim_time"), "record_id").where("sim_time > created_sim_time")
        events = events.unionByName(arm(changes, "sim_time", "u"))
    if tracked:
        wide = _instants(bundle, kind, tracked).withColumns({"op": F.lit(None).cast("string"), "_rank": F.lit(-1)})
        ops = F.when(F.col("op") == "c", 0).when(F.col("op") == "u", 1).otherwise(2)
        nothing = {f"_p_{p}": F.lit(None).cast("struct<value:string>") for p in tracked}
        both = wide.unionByName(events.withColumn("_rank", ops).withColumns(nothing))
        events = kernels.fill_last(both, ["record_id"], ["sim_time", "_rank"], list(nothing), hot=busy(bundle, kind, tracked) if hot is None else hot).where("op is not null").drop("_rank")
    others = [p for p in properties if p not in tracked]
    if others:
        fixed = records.select("record_id", *(F.col(f"prop__{p}").cast("string").alias(f"_c_{p}") for p in others))
        events = events.join(fixed, "record_id", "left")
    shown = lambda p: F.col(f"_p_{p}.value") if p in tracked else F.col(f"_c_{p}")
    image = [F.when(F.col("op") != "d", shown(p)).alias(p) for p in properties]
    cls = F.when(F.col("op") == "c", 0).when(F.col("op") == "u", 1).otherwise(2)
    return events.select("record_id", "sim_time", "op", cls.alias("op_class"), *image)


def membership_events(bundle: Bundle, kind: str, prop: str) -> DataFrame:
    """Each interval as a join and, if closed, a leave: record_id, sim_time, op, op_class, elements and members. One scan."""
    rows = bundle.membership(kind, prop)
    payload = [c for c in rows.columns if c.startswith(("elem__", "member__"))]
    join = F.struct(F.col("joined_sim_time").alias("sim_time"), F.lit("join").alias("op"), F.lit(JOIN).alias("op_class"))
    leave = F.struct(F.col("left_sim_time").alias("sim_time"), F.lit("leave").alias("op"), F.lit(LEAVE).alias("op_class"))
    return rows.select("record_id", *payload, F.explode(F.array(join, leave)).alias("e")).select("record_id", "e.*", *payload).where("sim_time is not null")


def truncated(bundle: Bundle, horizon: int) -> Bundle:
    """The bundle as it was at ``horizon`` inclusive, so every operator can run on a past state.

    Later history, records and intervals are gone, later ends open; tracked
    properties and lifecycle are rebuilt, reference indexes derived from the
    records that exist, and properties whose past can't be known dropped.
    """
    side = bundle.sidecar
    frames: dict[str, DataFrame] = {"history": bundle.table("history").where(F.col("sim_time") <= horizon)}
    tables = []
    for t in side.tables:
        if t.category == "membership":
            left = F.when(F.col("left_sim_time") <= horizon, F.col("left_sim_time")).alias("left_sim_time")
            frames[t.name] = bundle.table(t.name).where(F.col("joined_sim_time") <= horizon).select(*(left if c == "left_sim_time" else c for c in t.names()))
        if t.category != "records":
            tables.append(t)
            continue
        kind = t.record_kind
        kept = tuple(c for c in t.columns if not side.slice_only(kind, c.name) and not (c.name.startswith("ref_index__") and side.slice_only(kind, f"prop__{c.name[11:]}")))
        props = [c.name[6:] for c in kept if c.role == "payload"]
        rows = state_at(bundle, kind, props, horizon + 1)
        trail = bundle.history(kind).where(F.col("sim_time") <= horizon).groupBy("record_id").agg(F.max("sim_time").alias("_trail"))
        rows = rows.join(trail, "record_id", "left").withColumn("last_mutation_sim_time", F.greatest("created_sim_time", "deactivated_at", "_trail")).drop("_trail")
        for c in kept:
            if c.name.startswith("ref_index__"):
                target = side.records(kind).column(f"prop__{c.name[11:]}").references
                index = bundle.records(target).where(F.col("created_sim_time") <= horizon).select(F.col("record_id").alias("_id"), F.col("record_index").alias(c.name))
                rows = rows.join(index, rows[f"prop__{c.name[11:]}"] == index["_id"], "left").drop("_id")
        frames[t.name] = rows.select(*(c.name for c in kept))
        tables.append(replace(t, columns=kept, rows=None))
    branches = tuple({**b, "slice_at": horizon} for b in side.branches)
    return bundle.replacing(frames, replace(side, tables=tuple(tables), branches=branches))


def occupancy(bundle: Bundle, kind: str, prop: str) -> DataFrame:
    """For each owner and each instant at which an interval begins or ends, how many are then open. Edges are summed, never paired."""
    edges = membership_events(bundle, kind, prop).groupBy("record_id", "sim_time").agg(F.sum(F.when(F.col("op") == "join", 1).otherwise(-1)).alias("_net"))
    (hot,) = skew.hot_groups(bundle.membership(kind, prop), ["record_id"], min_rows=skew.MIN_ROWS)
    running = kernels.along_groups(edges, ["record_id"], ["sim_time"], "sim_time", sums={"open": "_net"}, hot=hot)
    return running.select("record_id", "sim_time", "open")


def anchored(ns: Column | str, origin: str, zone: str = "UTC") -> Column:
    """Sim time as a wall-clock timestamp without zone: ns since ``origin`` (UTC), shown in ``zone``."""
    ns = F.col(ns) if isinstance(ns, str) else ns
    moved = F.timestamp_add("MICROSECOND", F.call_function("div", ns, F.lit(1000)), F.lit(origin).cast("timestamp_ntz"))
    return moved if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), moved)
