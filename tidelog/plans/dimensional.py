"""Star schemas: dims of type 1 and 2 and facts at four grains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.operators import kernels, temporal
from tidelog.plans.common import RESERVED_COLUMNS, Anchor, Notice, Planned, Sink, VersionView, Window, reserved
from tidelog.plans.config import Dimensional, Export, Fk, OutColumn, OutTable
from tidelog.plans.election import Election, claim, elect, guard, translate
from tidelog.sources.bundle import Bundle, BundleError, Sidecar, condition

SECONDS = {"seconds": 1, "minutes": 60, "hours": 3600}


def paths(sidecar: Sidecar, start: str, goal: str) -> list[list[str]]:
    """All shortest and longer reference paths from a kind to another, without visiting a kind twice."""
    found: list[list[str]] = []
    todo = [(start, [], {start})]
    while todo:
        kind, path, seen = todo.pop(0)
        for column, target in sidecar.references(kind).items():
            if target == goal:
                found.append([*path, column])
            elif target not in seen and sidecar.has(f"records__{target}"):
                todo.append((target, [*path, column], seen | {target}))
    return found


def resolve_path(sidecar: Sidecar, start: str, goal: str | None, given: list[str] | None) -> tuple[list[str], str]:
    """The path's columns and the kind it ends at; none or more than one without a hint is refused, and so is a hop whose past can't be known."""
    if given is None:
        options = paths(sidecar, start, goal)
        if len(options) != 1:
            raise BundleError("path", f"{len(options)} reference paths from {start} to {goal}" + ("; name one" if options else ""))
        given = options[0]
    kind = start
    for column in given:
        target = sidecar.references(kind).get(column)
        if target is None:
            raise BundleError("path", f"{column} of {kind} is no reference")
        if sidecar.slice_only(kind, column):
            raise BundleError("slice-only", f"the past of {kind}.{column} can't be known")
        kind = target
    if goal is not None and kind != goal:
        raise BundleError("path", f"the path from {start} ends at {kind}, not {goal}")
    return given, kind


def follow(rows: DataFrame, bundle: Bundle, kind: str, path: list[str], first: str, out: str, take: str = "record_id") -> DataFrame:
    """rows with ``out``: the column ``take`` of the record at the end of a reference path that begins in column ``first``."""
    current = rows.withColumn("_hop", F.col(first))
    for i, column in enumerate(path):
        kind = bundle.sidecar.references(kind)[column]
        last = i == len(path) - 1
        step = take if last else path[i + 1]
        if last and take == "record_id":
            target = bundle.records(kind).select(F.col("record_id").alias("_id"), F.col("record_id").alias("_next"))
        else:
            target = bundle.records(kind).select(F.col("record_id").alias("_id"), F.col(step).alias("_next"))
        current = current.join(target, current["_hop"] == target["_id"], "left").drop("_hop", "_id").withColumnRenamed("_next", "_hop")
    return current.withColumnRenamed("_hop", out)


class TableBuilder:
    def __init__(self, bundle: Bundle, config: Dimensional, table: OutTable, election: Election, anchor: Anchor | None, window: Window | None):
        self.bundle, self.side, self.config, self.table, self.election, self.anchor, self.window = bundle, bundle.sidecar, config, table, election, anchor, window
        self.kind = table.source.kind

    def build(self) -> Planned:
        t = self.table
        self.check()
        rows, key = self.grain()
        out: dict[str, Column] = {}
        for c in t.columns:
            rows, out[c.name] = self.column(rows, c)
        made = rows
        # ordinals refer to sibling columns, so they come last
        for c in t.columns:
            if c.mode == "derived" and c.derived.mode == "ordinal":
                o = c.derived.ordinal
                ties = [F.col(n).asc_nulls_first() for n in self.source_table().names() if n in made.columns]
                made = numbered(made, out[o.partition_by], out[o.order_by], [F.col("record_id"), *ties], f"_nth_{c.name}")
                out[c.name] = F.col(f"_nth_{c.name}")
        mode, view, name = "replace", None, t.name
        # the filter of the window follows the numbering, so numbers are the same in every window
        selected = made.select(*(c.alias(n) for n, c in out.items()), F.col(key).alias("_window_key"))
        if self.window is not None and not (t.role == "dim" and t.scd == "type1"):
            mode = "append"
            selected = selected.where(self.window.holds("_window_key"))
            if t.scd == "type2":
                ends = [c.name for c in t.columns if c.mode == "derived" and c.derived.scd_window == "valid_to"]
                starts = [c.name for c in t.columns if c.mode == "derived" and c.derived.scd_window == "valid_from"]
                identity = [k for k in t.key if k not in starts]
                if ends:
                    if len(starts) != 1 or not identity:
                        raise BundleError("incremental", f"{t.name}: its view needs one valid_from column and an identity in its key")
                    name = f"{t.name}__rows"
                    selected = selected.drop(*ends).withColumnRenamed("_window_key", "__valid_from_ns")
                    view = VersionView(tuple(identity), starts[0], tuple(ends), tuple(c.name for c in t.columns))
        order = [c for c in dict.fromkeys([*t.key, *out]) if c in selected.columns and c != "_window_key"]
        return Planned(name, selected.drop("_window_key"), mode, view=view, view_name=t.name if view else None, order=order)

    def check(self) -> None:
        t, names = self.table, [c.name for c in self.table.columns]
        if reserved(t.name) or set(names) & set(RESERVED_COLUMNS):
            raise BundleError("reserved", f"{t.name}: a reserved name is used")
        if missing := [k for k in t.key if k not in names]:
            raise BundleError("key", f"{t.name}: key {', '.join(missing)} is no column")
        exclude = self.config.exclude
        source = self.source_table().name
        if exclude and (self.kind in exclude.kinds or source in exclude.tables):
            raise BundleError("exclude", f"{t.name} is made from the excluded {source}")
        scd = [c.derived.scd_window for c in t.columns if c.mode == "derived" and c.derived.scd_window]
        if t.scd == "type2":
            if not self.side.tracked(self.kind):
                raise BundleError("scd", f"{t.name}: {self.kind} has no tracked property")
            if self.window is not None and "valid_from" not in scd:
                raise BundleError("incremental", f"{t.name}: windows need a valid_from column")
        elif scd:
            raise BundleError("scd", f"{t.name}: only a dim of type 2 has valid_from and valid_to")
        for c in t.columns:
            if c.mode == "derived" and c.derived.mode == "ordinal" and not {c.derived.ordinal.partition_by, c.derived.ordinal.order_by} <= set(names):
                raise BundleError("ordinal", f"{t.name}.{c.name} refers to no sibling column")
            if c.mode == "lookup" and t.scd == "type2":
                raise BundleError("lookup", f"{t.name}.{c.name}: a dim of type 2 takes no lookup")
        if self.window is not None:
            self.check_window()

    def check_window(self) -> None:
        """A window selects rows and never recomputes them, so no value may depend on what comes after it."""
        t, g = self.table, self.table.source
        if g.grain in ("history_interval", "membership"):
            raise BundleError("incremental", f"{t.name}: rows of the grain {g.grain} change after their window")
        snapshot = t.role == "dim" and t.scd == "type1"
        key = {"history_point": "sim_time", "records": "last_mutation_sim_time"}[g.grain]
        sources = {c.name: c.source or c.correlation for c in t.columns}

        def constant(kind: str, column: str) -> bool:
            c = self.side.records(kind).column(column)
            return c is None or c.role not in ("payload", "index") or c.temporal_class == "constant" or column == self.side.discriminator(kind)

        for c in t.columns:
            if c.mode == "derived" and c.derived.mode == "elapsed":
                raise BundleError("incremental", f"{t.name}.{c.name}: elapsed needs the whole tape")
            if c.mode == "derived" and c.derived.mode == "ordinal" and sources.get(c.derived.ordinal.order_by) != key:
                raise BundleError("incremental", f"{t.name}.{c.name}: numbers must follow {key}")
            if c.mode == "fk" and c.fk.via == "membership":
                raise BundleError("incremental", f"{t.name}.{c.name}: a membership edge changes after its window")
            if c.mode == "fk":
                kind = self.kind
                dim = next((d for d in self.config.tables if d.name == c.fk.to), None)
                for hop in resolve_path(self.side, kind, dim.source.kind if dim else None, c.fk.path)[0]:
                    if not constant(kind, hop):
                        raise BundleError("incremental", f"{t.name}.{c.name}: {hop} changes")
                    kind = self.side.references(kind)[hop]
            if snapshot and c.source and not constant(self.kind, c.source):
                raise BundleError("incremental", f"{t.name}.{c.name}: {c.source} changes")
        for name in g.filter or {}:
            if not constant(self.kind, name):
                raise BundleError("incremental", f"{t.name}: rows are selected by {name}, which changes")

    def source_table(self):
        g = self.table.source
        if g.grain == "membership":
            return self.side.membership(g.kind, g.property)
        return self.side.records(g.kind) if g.grain == "records" else self.side.table("history")

    def grain(self) -> tuple[DataFrame, str]:
        """The rows of the table's grain and the sim-time column that windows filter by."""
        g, t = self.table.source, self.table
        if g.grain == "membership":
            return self.bundle.membership(g.kind, g.property, g.where), "joined_sim_time"
        if g.grain == "records":
            for name in [*(g.filter or {}), *(c.source for c in t.columns if c.source)]:
                if self.side.slice_only(g.kind, name):
                    raise BundleError("slice-only", f"{t.name}: the past of {name} can't be known")
            records = self.bundle.records(g.kind, g.filter)
            if t.scd != "type2":
                return records, "last_mutation_sim_time"
            tracked = self.side.tracked(g.kind)
            shown = [c.source[6:] for c in t.columns if c.source and c.source.startswith("prop__") and c.source[6:] in tracked]
            made = temporal.versions(self.bundle, g.kind, sorted({*shown}) or tracked[:1], scope=tracked)
            kept = records.drop(*(f"prop__{p}" for p in tracked))
            rows = made.withColumnsRenamed({p: f"prop__{p}" for p in made.columns[3:]}).join(kept, "record_id", "left" if not g.filter else "inner")
            return rows, "version_start"
        prop = g.property
        column = self.side.records(g.kind).column(f"prop__{prop}") if self.side.has(f"records__{g.kind}") else None
        if column is not None and not column.history_tracked:
            raise BundleError("grain", f"{g.kind}.{prop} is not tracked")
        rows = self.bundle.history(g.kind, [prop])
        if g.grain == "history_interval":
            rows = kernels.along_groups(rows, ["record_id"], ["sim_time", F.col("value").asc_nulls_first()], "sim_time", leads={"lead_sim_time": "sim_time"}, hot=temporal.busy(self.bundle, g.kind, [prop]))
        if g.value is not None:
            rows = rows.where(condition("value", g.value, "VARCHAR"))
        return rows, "sim_time"

    def time(self, source: str) -> Column:
        return F.col(source)

    def column(self, rows: DataFrame, c: OutColumn) -> tuple[DataFrame, Column]:
        if c.mode in ("source", "correlation"):
            name = c.source or c.correlation
            if name not in rows.columns:
                raise BundleError("column", f"{self.table.name}.{c.name}: the grain has no {name}")
            if name == "record_id" and self.side.has(f"records__{self.kind}") and self.election.surfaces(self.kind) != {"record_id"}:
                alias = f"_own_{c.name}"
                return translate(rows, self.bundle, self.election, self.kind, "record_id", alias), F.col(alias)
            return rows, F.col(name)
        if c.mode == "null":
            return rows, F.lit(None).cast("string")
        if c.mode == "lookup":
            return self.lookup(rows, c)
        if c.mode == "fk":
            return self.fk(rows, c, c.fk)
        d = c.derived
        if d.mode == "value_map":
            values = list(d.value_map.map.values())
            kind = "bigint" if all(isinstance(v, int) for v in values) else "double" if all(isinstance(v, (int, float)) for v in values) else "string"
            source = F.col(d.value_map.source).cast("string")
            arms = [(source == str(k), F.lit(v).cast(kind)) for k, v in d.value_map.map.items()]
            return rows, reduce(lambda tail, arm: F.when(arm[0], arm[1]).otherwise(tail), reversed(arms), F.lit(None).cast(kind))
        if d.mode == "timestamp":
            if d.timestamp.source not in rows.columns:
                raise BundleError("timestamp", f"{self.table.name}.{c.name}: the grain has no {d.timestamp.source}")
            return rows, self.anchor.column(d.timestamp.source) if self.anchor else F.col(d.timestamp.source)
        if d.mode == "scd_window":
            source = "version_start" if d.scd_window == "valid_from" else "version_end"
            return rows, self.anchor.column(source) if self.anchor else F.col(source)
        if d.mode == "elapsed":
            e = d.elapsed
            table = self.source_table()
            if lost := [n for n in (e.correlate_on, e.start_source, *e.other_where) if table.column(n) is None] + [n for n in (e.correlate_on, e.end_source) if n not in rows.columns]:
                raise BundleError("elapsed", f"{self.table.name}.{c.name}: the grain has no {', '.join(lost)}")
            others = self.bundle.history(self.kind, [self.table.source.property]) if table.name == "history" else self.bundle.table(table.name)
            for name, value in e.other_where.items():
                others = others.where(condition(name, value, table.column(name).type))
            alias = f"_start_{c.name}"
            starts = others.groupBy(F.col(e.correlate_on).alias("_on")).agg(F.min(e.start_source).alias(alias))
            rows = rows.join(starts, rows[e.correlate_on] == starts["_on"], "left").drop("_on")
            return rows, (F.col(e.end_source) - F.col(alias)) / F.lit(SECONDS[e.unit] * 1_000_000_000).cast("double")
        return rows, F.lit(None).cast("int")  # an ordinal, filled in later

    def lookup(self, rows: DataFrame, c: OutColumn) -> tuple[DataFrame, Column]:
        alias = f"_look_{c.name}"
        if c.lookup.to is None or (c.lookup.to == self.kind and c.lookup.path is None):
            if self.table.source.grain == "records":
                raise BundleError("lookup", f"{self.table.name}.{c.name}: the grain has the property itself")
            path, end = [], self.kind
        else:
            path, end = resolve_path(self.side, self.kind, c.lookup.to, c.lookup.path)
        prop = self.side.records(end).column(f"prop__{c.lookup.property}")
        if prop is None or (prop.temporal_class != "constant" and prop.name != self.side.discriminator(end)):
            raise BundleError("lookup", f"{end}.{c.lookup.property} is no constant property")
        if not path:
            own = self.bundle.records(self.kind).select(F.col("record_id").alias("_rid"), F.col(prop.name).alias(alias))
            return rows.join(own, rows["record_id"] == own["_rid"], "left").drop("_rid"), F.col(alias)
        rows = self.with_first(rows, path[0])
        return follow(rows, self.bundle, self.kind, path, path[0], alias, prop.name), F.col(alias)

    def with_first(self, rows: DataFrame, column: str) -> DataFrame:
        """rows with the first hop's column, from the records if the grain lacks it."""
        if column in rows.columns:
            return rows
        first = self.bundle.records(self.kind).select(F.col("record_id").alias("_rid"), column)
        return rows.join(first, rows["record_id"] == first["_rid"], "left").drop("_rid")

    def fk(self, rows: DataFrame, c: OutColumn, fk: Fk) -> tuple[DataFrame, Column]:
        dim = next((t for t in self.config.tables if t.name == fk.to), None)
        if dim is None or dim.role != "dim":
            raise BundleError("fk", f"{self.table.name}.{c.name}: {fk.to} is no dim")
        goal, alias = dim.source.kind, f"_fk_{c.name}"
        shown = self.election.surfaces(goal, self.admitted(dim))
        surface = fk.target_key or next(iter(sorted(shown)))
        if len(shown) == 1 and not any(k.source in (surface, "record_id") for k in dim.columns if k.name in dim.key):
            raise BundleError("fk", f"{self.table.name}.{c.name} shows {surface}, which is in no key column of {dim.name}")
        if fk.via == "reference":
            path, _ = resolve_path(self.side, self.kind, goal, fk.path)
            rows = self.with_first(rows, path[0])
            rows = follow(rows, self.bundle, self.kind, path, path[0], alias)
        else:
            rows = self.membership_fk(rows, fk, goal, alias)
        shown = alias
        if fk.target_key:
            only = elect(self.side, {goal: fk.target_key})
            rows, shown = translate(rows, self.bundle, only, goal, alias, f"{alias}_key"), f"{alias}_key"
        elif self.election.surfaces(goal) != {"record_id"}:
            rows, shown = translate(rows, self.bundle, self.election, goal, alias, f"{alias}_key"), f"{alias}_key"
        return rows, F.col(shown)

    def admitted(self, dim: OutTable) -> list[str] | None:
        """The sub-types a dim's filter lets in; None for all."""
        name = self.side.discriminator(dim.source.kind)
        said = (dim.source.filter or {}).get(name) if name else None
        return None if said is None else said if isinstance(said, list) else [said]

    def membership_fk(self, rows: DataFrame, fk: Fk, goal: str, alias: str) -> DataFrame:
        g, member_kind = self.table.source, goal
        if fk.as_of:
            member_kind = resolve_path(self.side, self.kind, None, fk.member_path)[1] if fk.member_path else self.kind
        options = [
            (t, f) for t in self.side.tables if t.category == "membership" and (fk.property is None or t.property == fk.property)
            for f in t.member_fields() if (fk.member_field is None or f == fk.member_field)
            and (t.record_kind == goal if fk.as_of else t.record_kind == self.kind)
        ]
        if len(options) != 1:
            raise BundleError("fk", f"{self.table.name}: {len(options)} membership fields fit")
        table, member = options[0]
        kind_col, id_col = f"member__{member}__kind", f"member__{member}__id"
        if g.grain == "membership" and not fk.as_of:
            return rows.withColumn(alias, F.when(F.col(kind_col) == goal, F.col(id_col)))
        edges = self.bundle.membership(table.record_kind, table.property, fk.where)
        if fk.as_of:
            # the owner that holds the row's member at the row's time
            edges = edges.where((F.col(kind_col) == member_kind) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_member"), F.col("record_id").alias(alias), "joined_sim_time", "left_sim_time")
            if fk.member_path:
                rows = self.with_first(rows, fk.member_path[0])
                if len(fk.member_path) == 1:  # the reference itself names the member
                    rows = rows.withColumn("_member", F.col(fk.member_path[0]))
                else:
                    rows = follow(rows, self.bundle, self.kind, fk.member_path, fk.member_path[0], "_member")
            else:
                rows = rows.withColumn("_member", F.col("record_id"))
            edges = edges.withColumnsRenamed({"joined_sim_time": "_from", "left_sim_time": "_until"})
            return kernels.containing(rows, fk.as_of, edges, ["_member"], "_from", "_until", [alias]).drop("_member")
        edges = edges.where(F.col(kind_col) == goal).select(F.col("record_id").alias("_owner"), F.col(id_col).alias(alias))
        return rows.join(edges, rows["record_id"] == edges["_owner"], "left").drop("_owner")


def numbered(rows: DataFrame, group: Column, order: Column, ties: list[Column], name: str) -> DataFrame:
    """rows with their place per group in an order, nulls last; groups with very many rows are cut along it where it is a number or a time."""
    placed = rows.withColumns({"_g": group, "_o": order})
    kind = dict(placed.dtypes)["_o"]
    if kind in ("string", "boolean", "binary"):  # nothing to cut along
        return placed.withColumn(name, F.row_number().over(W.partitionBy("_g").orderBy(F.col("_o").asc_nulls_last(), *ties))).drop("_g", "_o")
    # rows without order come after all others of their group: they are numbered by themselves and moved behind
    parts = placed.withColumn("_none", F.col("_o").isNull())
    known = kernels.along_groups(parts, ["_g", "_none"], ["_o", *ties], "_o", number=name)
    before = parts.where(~F.col("_none")).groupBy("_g").agg(F.count(F.lit(1)).alias("_before")).withColumnRenamed("_g", "_h")
    late = known.where("_none").join(before, F.col("_g").eqNullSafe(F.col("_h")), "left").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
    return known.where(~F.col("_none")).unionByName(late.drop("_h", "_before")).drop("_g", "_o", "_none")


def plan(bundle: Bundle, export: Export, anchor: Anchor | None = None, window: Window | None = None, notices: Sink = lambda n: None) -> list[Planned]:
    config = export.dimensional
    election = elect(bundle.sidecar, export.keys)
    guard(bundle, election, {t.source.kind for t in config.tables if bundle.sidecar.has(f"records__{t.source.kind}")})
    census = {(e.get("table"), e.get("column"), str(e.get("value"))) for e in bundle.sidecar.optional.get("row_census", []) if isinstance(e, dict)}
    for t in config.tables:
        for name, value in (t.source.filter or {}).items():
            domain = bundle.sidecar.domain(t.source.kind) if name == bundle.sidecar.discriminator(t.source.kind) else None
            for v in value if isinstance(value, list) else [value]:
                if domain is not None and v not in domain and (f"records__{t.source.kind}", name, str(v)) not in census:
                    notices(Notice("value-never-seen", f"{t.name}: {name} is never {v}"))
        if t.role == "dim" and claim(bundle.sidecar, t.source.kind, None):
            notices(Notice("natural-key", f"{t.name}: presentation_id is claimed unique"))
    return [TableBuilder(bundle, config, t, election, anchor, window).build() for t in config.tables]


__all__ = ["follow", "paths", "plan", "resolve_path"]
