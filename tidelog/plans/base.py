"""Flat export: one table per kind of record, as of the end, a moment, or the end of a window."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import temporal
from tidelog.plans.common import RESERVED_COLUMNS, Anchor, Notice, Planned, Sink, Window, reserved
from tidelog.plans.config import Export
from tidelog.plans.election import claim, elect, guard, translate
from tidelog.sources.bundle import Bundle, BundleError


def plan(bundle: Bundle, export: Export, anchor: Anchor | None = None, window: Window | None = None, notices: Sink = lambda n: None) -> list[Planned]:
    """<kind>_key, id, lifecycle and properties, each reference followed by <property>_key, the target's index at the horizon.

    References that resolve to nothing at the horizon have a null key;
    properties whose past can't be known are left out with a notice.
    """
    config, side = export.base, bundle.sidecar
    election = elect(side, export.keys)
    guard(bundle, election, set(side.kinds()))
    excluded = set(config.exclude.kinds) if config.exclude else set()
    excluded |= {t.record_kind for t in side.tables if config.exclude and t.name in config.exclude.tables and t.category == "records"}
    renames = {r.table: r for r in config.rename}
    if unknown := [n for n in renames if not side.has(n) or side.table(n).category != "records"]:
        raise BundleError("rename", f"no records table {', '.join(unknown)}")
    horizon = window.end if window else None if config.slice_at is None else config.slice_at + 1
    out, taken = [], set()
    for kind in side.kinds():
        if kind in excluded:
            continue
        table = side.records(kind)
        rename = renames.get(table.name)
        name = rename.name if rename and rename.name else kind
        if name in taken or reserved(name):
            raise BundleError("naming", f"the table name {name} is taken or reserved")
        taken.add(name)
        shown, columns = [], {}
        for c in table.columns:
            if c.role == "payload":
                if side.slice_only(kind, c.name):
                    if rename and c.name in rename.columns:
                        raise BundleError("rename", f"{table.name}.{c.name} is left out, its past can't be known")
                    notices(Notice("slice-only-column-omitted", f"{table.name}.{c.name}"))
                else:
                    shown.append(c.name[6:])
        rows = temporal.state_at(bundle, kind, shown, horizon)
        columns[f"{kind}_key"] = F.col("record_index")
        rows = translate(rows, bundle, election, kind, "record_id", "_id")
        columns["id"] = F.col("_id")
        if "presentation_id" in rows.columns and election.surfaces(kind) != {"presentation_id"}:
            columns["presentation_id"] = F.col("presentation_id")
        for c in ("created_sim_time", "deactivated_at"):
            columns[c] = anchor.column(c) if anchor else F.col(c)
        for p in shown:
            column = f"prop__{p}"
            target = table.column(column).references
            if target is None or not side.has(f"records__{target}"):
                columns[column] = F.col(column)
                if target:
                    notices(Notice("reference-key-omitted", f"{table.name}.{column}: no records of {target}"))
                continue
            there = bundle.records(target)
            if horizon is not None:
                there = there.where(F.col("created_sim_time") < horizon)
            index = there.select(F.col("record_id").alias("_rid"), F.col("record_index").alias(f"_key_{p}"))
            rows = rows.join(index, rows[column] == index["_rid"], "left").drop("_rid")
            rows = translate(rows, bundle, election, target, column, f"_show_{p}", horizon)
            columns[column], columns[f"{p}_key"] = F.col(f"_show_{p}"), F.col(f"_key_{p}")
        order = [f"{kind}_key", "id", *(["presentation_id"] if "presentation_id" in columns else []), "created_sim_time", "active", "deactivated_at", *(c for c in columns if c.startswith("prop__") or (c.endswith("_key") and c != f"{kind}_key"))]
        columns["active"] = F.col("active")
        final = {n: (rename.columns.get("record_id" if n == "id" else n, n) if rename else n) for n in order}
        if len(set(final.values())) < len(final) or set(final.values()) & {*RESERVED_COLUMNS, "last_mutation_sim_time"}:
            raise BundleError("naming", f"{name}: two columns of one name, or a reserved one")
        primary = [final["id"]] if config.declare_keys else []
        unique = [[final["presentation_id"]]] if config.declare_keys and "presentation_id" in final and claim(side, kind, None) else []
        out.append(Planned(name, rows.select(*(columns[n].alias(final[n]) for n in order)), "replace", primary, unique))
    return out
