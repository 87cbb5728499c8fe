"""The guarantees C1 to C14 of a bundle, each checked exhaustively.

Checks on data give frames of violations, so nothing but counts and a few
samples reaches the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.sources.bundle import HISTORY, RECORD_PREFIX, SIDECAR, VERSION, Bundle, BundleError, Sidecar, spark_type

NAME = re.compile(r"history|records__[a-z][a-z0-9_]*|membership__[a-z][a-z0-9_]*?__[a-z][a-z0-9_]*")
CLASSES = ("constant", "tracked", "slice_only")
#: Types whose values come back from text unchanged.
ROUND_TRIP = {"bigint", "int", "smallint", "tinyint", "boolean", "string", "double"}


@dataclass
class Finding:
    check: str
    ok: bool
    problems: list[str] = field(default_factory=list)


def c1(bundle: Bundle) -> list[str]:
    """The sidecar, as it was read, has the declared shape."""
    side, out = bundle.sidecar, []
    raw = side.read if side.read and Sidecar.parse(side.read) == side else side.raw()  # a changed sidecar is what it says now
    if raw.get("base_format_version") != VERSION:
        out.append("base_format_version")
    out += [f"{k}: no such member" for k in raw if k not in SIDECAR]
    out += [f"{t.get('name')}.{c.get('name')}.{k}: no such member" for t in raw["tables"] for c in t["columns"] for k in c if k not in ("name", "type", "references", "history_tracked", "temporal_class")]
    out += [f"{t.get('name')}.{k}: no such member" for t in raw["tables"] for k in t if k not in ("name", "category", "columns", "record_kind", "property", "rows")]
    for b in raw["branches"]:
        if not isinstance(b.get("fork_path"), str):
            out.append("a branch without fork_path")
    if not raw["branches"]:
        out.append("no branch")
    for t in raw["tables"]:
        if t["category"] not in ("fixed", "history", "records", "membership"):
            out.append(f"{t['name']}: category {t['category']}")
        if t["category"] in ("records", "membership") and not t.get("record_kind"):
            out.append(f"{t['name']}: no record_kind")
        if t["category"] == "membership" and not t.get("property"):
            out.append(f"{t['name']}: no property")
        for c in t["columns"]:
            try:
                spark_type(c["type"])
            except ValueError:
                out.append(f"{t['name']}.{c['name']}: type {c['type']}")
    return out


def c2(bundle: Bundle) -> list[str]:
    """Tables have exactly the declared columns, in order, with their types, and the declared number of rows."""
    out = []
    for t in bundle.sidecar.tables:
        frame = bundle.table(t.name)
        have = [(f.name, f.dataType.simpleString()) for f in frame.schema.fields]
        want = [(c.name, spark_type(c.type)) for c in t.columns]
        if have != want:
            out.append(f"{t.name}: {[x for x in have if x not in want]} instead of {[x for x in want if x not in have]}")
        if t.rows is not None and frame.count() != t.rows:
            out.append(f"{t.name}: not {t.rows} rows")
    return out


def c3(bundle: Bundle) -> list[str]:
    """history is there, every table's name follows its category, and every membership's kind has records."""
    side, out = bundle.sidecar, []
    if not side.has("history"):
        out.append("no history")
    for t in side.tables:
        want = {"records": f"records__{t.record_kind}", "membership": f"membership__{t.record_kind}__{t.property}"}.get(t.category, t.name)
        if not NAME.fullmatch(t.name) or t.name != want:
            out.append(t.name)
        if t.category == "membership" and not side.has(f"records__{t.record_kind}"):
            out.append(f"{t.name}: no records__{t.record_kind}")
    return out


def c4(bundle: Bundle) -> list[str]:
    """The first six columns of history."""
    want = list(zip(HISTORY, ("string", "string", "string", "string", "bigint", "string"), strict=True))
    have = [(f.name, f.dataType.simpleString()) for f in bundle.table("history").schema.fields][:6]
    return [] if have == want else [f"history begins with {have}"]


def c5(bundle: Bundle) -> list[str]:
    """The leading columns of records, presentation_id only at third place, each index beside its reference."""
    out = []
    kinds = dict(zip(RECORD_PREFIX, ("string", "string", "bigint", "boolean", "bigint", "bigint", "bigint"), strict=True))
    for t in bundle.sidecar.tables:
        if t.category != "records":
            continue
        names = t.names()
        if "presentation_id" in names and names.index("presentation_id") != 2:
            out.append(f"{t.name}: presentation_id at {names.index('presentation_id') + 1}")
        lead = [n for n in names if n != "presentation_id"]
        if lead[:7] != list(RECORD_PREFIX) or any(spark_type(t.column(c).type) != k for c, k in kinds.items() if t.column(c)):
            out.append(f"{t.name} begins with {lead[:7]}")
        rest = lead[7:]
        for i, n in enumerate(rest):
            if n.startswith("prop__"):
                paired = i + 1 < len(rest) and rest[i + 1] == f"ref_index__{n[6:]}"
                if paired != bool(t.column(n).references):
                    out.append(f"{t.name}.{n}: index column {'without' if paired else 'missing for'} a reference")
            elif not (n.startswith("ref_index__") and i and rest[i - 1] == f"prop__{n[11:]}"):
                out.append(f"{t.name}.{n}")
    return out


def _tracked(side: Sidecar) -> list[tuple[str, str, str]]:
    return [(t.record_kind, c.name[6:], spark_type(c.type)) for t in side.tables if t.category == "records" for c in t.columns if c.role == "payload" and c.history_tracked]


def round_trip(bundle: Bundle) -> DataFrame:
    """C6: kind, record_id, property where the last value up to the slice is not the record's. One shuffle of history, one of records."""
    side, out = bundle.sidecar, None
    history = bundle.history()
    if side.slice_at is not None:
        history = history.where(F.col("sim_time") <= side.slice_at)
    last = history.groupBy("kind", "record_id", "property").agg(F.max(F.struct("sim_time", "value")).alias("_last"))
    for kind in side.kinds():
        props = [(p, t) for k, p, t in _tracked(side) if k == kind and t in ROUND_TRIP and f"prop__{p}" in bundle.table(f"records__{kind}").columns]
        if not props:
            continue
        cells = F.explode(F.array(*(F.struct(F.lit(p).alias("property"), F.col(f"prop__{p}").cast("string").alias("_now")) for p, _ in props)))
        records = bundle.table(f"records__{kind}").select("record_id", cells.alias("c")).select("record_id", "c.*").groupBy("record_id", "property").agg(F.min("_now").alias("_least"), F.max("_now").alias("_most"), F.count_if(F.col("_now").isNull()).alias("_nulls"))
        joined = last.where(F.col("kind") == kind).join(records, ["record_id", "property"])
        # a double has many spellings, so its texts are compared as Spark spells the number
        doubles = [p for p, t in props if t == "double"]
        spelt = F.coalesce(F.expr("try_cast(_last.value AS double)").cast("string"), F.col("_last.value"))
        value = F.when(F.col("property").isin(doubles), spelt).otherwise(F.col("_last.value")) if doubles else F.col("_last.value")
        agrees = F.when(value.isNull(), (F.col("_nulls") > 0) & F.col("_least").isNull()).otherwise((F.col("_nulls") == 0) & (F.col("_least") == value) & (F.col("_most") == value))
        one = joined.where(~agrees).select("kind", "record_id", "property")
        # a series whose record is gone
        lost = last.where(F.col("kind") == kind).join(bundle.table(f"records__{kind}").select("record_id").distinct(), "record_id", "left_anti").where(F.col("property").isin([p for p, _ in props]))
        one = one.unionByName(lost.select("kind", "record_id", "property"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else bundle.spark.createDataFrame([], "kind string, record_id string, property string")


def null_groups(bundle: Bundle) -> DataFrame:
    """C7: table, record_id, field where columns that belong together are not null together."""
    out = None
    for t in bundle.sidecar.tables:
        frame, bad = bundle.table(t.name), []
        if t.category == "records":
            bad = [("deactivated_at", F.col("deactivated_at").isNull() != F.coalesce("active", F.lit(False)))]
        elif t.category == "membership":
            bad = [(f, F.col(f"member__{f}__kind").isNull() != F.col(f"member__{f}__id").isNull()) for f in t.member_fields()]
        for name, wrong in bad:
            one = frame.where(wrong).select(F.lit(t.name).alias("table"), "record_id", F.lit(name).alias("field"))
            out = one if out is None else out.unionByName(one)
    return out


def pins(bundle: Bundle) -> DataFrame:
    """C9: kind, record_id of pinned records that are not there exactly once."""
    said = [(k, i) for k, labels in bundle.sidecar.optional.get("pinned_ids", {}).items() for i in labels.values()]
    want = bundle.spark.createDataFrame(said, "kind string, record_id string")
    out = want.limit(0)
    for kind in sorted({k for k, _ in said}):
        if not bundle.sidecar.has(f"records__{kind}"):
            out = out.unionByName(want.where(F.col("kind") == kind))
            continue
        mine = want.where(F.col("kind") == kind)
        n = bundle.table(f"records__{kind}").join(F.broadcast(mine.select("record_id")), "record_id", "left_semi").groupBy("record_id").count()
        out = out.unionByName(mine.join(n, "record_id", "left").where(F.coalesce("count", F.lit(0)) != 1).select("kind", "record_id"))
    return out


def intervals(bundle: Bundle) -> DataFrame:
    """C10: table, record_id, field of intervals that end before they begin (field null) or whose member does not exist."""
    out, ids = None, None
    for kind in bundle.sidecar.kinds():
        one = bundle.table(f"records__{kind}").select(F.lit(kind).alias("_k"), F.col("record_id").alias("_i")).distinct()
        ids = one if ids is None else ids.unionByName(one)
    for t in bundle.sidecar.tables:
        if t.category != "membership":
            continue
        frame = bundle.table(t.name)
        parts = [frame.where("left_sim_time < joined_sim_time").select(F.lit(t.name).alias("table"), "record_id", F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("member"))]
        for f in t.member_fields():
            refs = frame.where(f"member__{f}__kind is not null and member__{f}__id is not null").select("record_id", F.col(f"member__{f}__kind").alias("_k"), F.col(f"member__{f}__id").alias("_i"))
            lost = refs.select("_k", "_i").distinct().join(ids, ["_k", "_i"], "left_anti")
            parts.append(refs.join(lost, ["_k", "_i"]).select(F.lit(t.name).alias("table"), "record_id", F.lit(f).alias("field"), F.col("_i").alias("member")))
        for p in parts:
            out = p if out is None else out.unionByName(p)
    return out if out is not None else bundle.spark.createDataFrame([], "table string, record_id string, field string, member string")


def genesis(bundle: Bundle) -> DataFrame:
    """C13: kind, record_id, property of tracked properties without a history row at their record's creation."""
    side, out = bundle.sidecar, None
    for kind in side.kinds():
        props = [p for k, p, _ in _tracked(side) if k == kind]
        if not props:
            continue
        want = bundle.table(f"records__{kind}").select("record_id", F.col("created_sim_time").alias("sim_time"), F.explode(F.array(*map(F.lit, props))).alias("property"))
        have = bundle.history(kind, props).select("record_id", "sim_time", "property").distinct()
        one = want.join(have, ["record_id", "sim_time", "property"], "left_anti").select(F.lit(kind).alias("kind"), "record_id", "property")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else bundle.spark.createDataFrame([], "kind string, record_id string, property string")


def pairs(bundle: Bundle) -> DataFrame:
    """C11: kind, property in history without a tracked column, or tracked with records but without history."""
    side = bundle.sidecar
    said = bundle.spark.createDataFrame([(k, p) for k, p, _ in _tracked(side)], "kind string, property string")
    have = bundle.history().select("kind", "property").distinct()
    filled = [k for k in side.kinds() if not bundle.table(f"records__{k}").isEmpty()]
    return have.join(said, ["kind", "property"], "left_anti").unionByName(said.where(F.col("kind").isin(filled)).join(have, ["kind", "property"], "left_anti"))


def _some(frame: DataFrame | None) -> list[str]:
    """The number of violations and a few of them."""
    if frame is None:
        return []
    n = frame.count()
    return [f"{n} violations", *(str(r.asDict()) for r in frame.limit(3).collect())] if n else []


def c8(bundle: Bundle) -> list[str]:
    """The data's only branch is the sidecar's only branch."""
    found: set[str] = set()
    for t in bundle.sidecar.tables:
        found |= {r[0] for r in bundle.table(t.name).select("fork_path").distinct().limit(3).collect()}
    said = {b["fork_path"] for b in bundle.sidecar.branches}
    return [] if found <= said and len(said) == 1 else [f"data has {sorted(map(str, found))}, the sidecar {sorted(said)}"]


def _has_classes(side: Sidecar) -> bool:
    return any(c.history_tracked is not None for t in side.tables if t.category == "records" for c in t.columns)


def undeclared(bundle: Bundle) -> DataFrame | None:
    """C12: table, record_id and sub_type of the actors whose sub-type has no role; None if actors have no roles by sub-type."""
    roles, side = (bundle.sidecar.optional.get("record_roles") or {}).get("actor"), bundle.sidecar
    if not isinstance(roles, dict) or not side.has("records__actor") or "prop__actor_type" not in bundle.table("records__actor").columns:
        return None
    said = bundle.spark.createDataFrame([(s,) for s in roles], "sub_type string")
    rows = bundle.table("records__actor").select(F.lit("records__actor").alias("table"), "record_id", F.col("prop__actor_type").cast("string").alias("sub_type"))
    return rows.where("sub_type is not null").join(said, "sub_type", "left_anti").select("table", "record_id", "sub_type")


def c12(bundle: Bundle) -> list[str]:
    """Every kind has a role; the roles of sub-typed actors cover the sub-types that occur."""
    roles, side = bundle.sidecar.optional.get("record_roles"), bundle.sidecar
    if roles is None:
        return []
    out = [f"{k} has no role" for k in side.kinds() if k not in roles]
    for kind, role in roles.items():
        said = list(role.values()) if isinstance(role, dict) else [role]
        if isinstance(role, dict) != (kind == "actor") or not set(said) <= {"dimension", "fact"}:
            out.append(f"{kind}: {role}")
        elif kind == "actor" and undeclared(bundle) is not None:
            out += _some(undeclared(bundle).select("sub_type").distinct())
    return out


def c13(bundle: Bundle) -> list[str]:
    side = bundle.sidecar
    if not _has_classes(side):
        return []
    out = []
    for t in side.tables:
        for c in t.columns:
            if t.category == "records" and c.role == "payload":
                h, k = c.history_tracked, c.temporal_class
                if (h is None) != (k is None) or (k is not None and k not in CLASSES) or (k == "tracked" and h is False) or (k == "slice_only" and h):
                    out.append(f"{t.name}.{c.name}: {h}, {k}")
    return out + _some(genesis(bundle))


def c14(bundle: Bundle) -> list[str]:
    """The columns of the sub-types make up the kind's columns."""
    side = bundle.sidecar
    parts, domains = side.optional.get("sub_type_columns"), side.optional.get("enum_domains")
    if parts is None:
        return []
    if domains is None:
        return ["sub_type_columns without enum_domains"]
    split = {k for k in side.kinds() if side.domain(k)}
    out = [] if set(parts) == split else [f"sub-types of {sorted(parts)} instead of {sorted(split)}"]
    for kind in sorted(split & set(parts)):
        table, listed = side.records(kind), parts[kind]
        if set(listed) != set(side.domain(kind)):
            out.append(f"{kind}: sub-types {sorted(listed)}")
        values = {c.name for c in table.columns if c.temporal_class is not None and c.name != f"prop__{kind}_type"}
        values |= {"presentation_id"} & set(table.names())
        values |= {f"ref_index__{c.name[6:]}" for c in table.columns if c.references and c.name in values}
        union = {c for columns in listed.values() for c in columns}
        if union != values:
            out.append(f"{kind}: columns {sorted(union ^ values)}")
        for s, columns in listed.items():
            out += [f"{kind}.{s}: {c.name} without its index" for c in table.columns if c.references and (c.name in columns) != (f"ref_index__{c.name[6:]}" in columns)]
    return out


CHECKS: dict[str, Callable[[Bundle], list[str]]] = {
    "C1": c1, "C2": c2, "C3": c3, "C4": c4, "C5": c5, "C6": lambda b: _some(round_trip(b)), "C7": lambda b: _some(null_groups(b)), "C8": c8,
    "C9": lambda b: _some(pins(b)), "C10": lambda b: _some(intervals(b)), "C11": lambda b: _some(pairs(b)) if _has_classes(b.sidecar) else [], "C12": c12, "C13": c13, "C14": c14,
}


def run_check(bundle: Bundle, check: str) -> Finding:
    """A check that can't be run, because a table or column it needs is missing, has failed."""
    try:
        problems = CHECKS[check](bundle)
    except (BundleError, AnalysisException, KeyError, TypeError, AttributeError) as x:
        problems = [f"could not be checked: {type(x).__name__}: {str(x).splitlines()[0][:200]}"]
    return Finding(check, not problems, problems)


def validate(bundle: Bundle) -> list[Finding]:
    return [run_check(bundle, c) for c in CHECKS]


