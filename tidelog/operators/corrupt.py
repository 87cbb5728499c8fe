"""Seeded, declared defects in a bundle, with a manifest that names each.

What an operation touches is drawn by a hash of seed, operation and the row's
own content, never by a position: the draw is exact in size, the same under
any partitioning, and needs no order of all rows. After every operation the
tables it changed are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

import fnmatch
import json
from dataclasses import dataclass, field, replace
from typing import Any, Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import mutations
from tidelog.operators import kernels
from tidelog.plans import conformance
from tidelog.plans.config import build, one_of
from tidelog.sources.bundle import Bundle, BundleError, Table, filtered, spark_type
from tidelog.sources.shared import written

BEYOND = "beyond-c1-c12"
#: Mutations that need the column's other values.
POOLED = ("resample", "out_of_domain")
#: Columns that no operation may change in place.
FIXED = ("fork_path", "record_id", "record_index", "kind", "property")
ROW = "_row"


@dataclass
class Target:
    table: str | None = None
    tables: list[str] | None = None
    glob: str | None = None
    category: Literal["fixed", "records", "membership"] | None = None
    record_kind: str | None = None
    where: dict[str, str] | None = None
    columns: list[str] | None = None

    def __post_init__(self):
        one_of("target", table=self.table, tables=self.tables, glob=self.glob, category=self.category, record_kind=self.record_kind)


@dataclass
class Amount:
    rate: float | None = None
    count: int | None = None

    def __post_init__(self):
        one_of("amount", rate=self.rate, count=self.count)
        if (self.rate is not None and not 0 <= self.rate <= 1) or (self.count is not None and self.count < 0):
            raise BundleError("config", "a rate is from 0 to 1, a count not negative")

    def of(self, n: int) -> int:
        return int(self.rate * n) if self.rate is not None else min(self.count, n)


@dataclass
class Placement:
    kind: Literal["entity_scoped", "clustered_temporal", "correlated"]
    entities: Amount | None = None
    column: str | None = None
    clusters: int | None = None
    width: int | None = None
    value: str | None = None
    weight: float | None = None


@dataclass
class Distribution:
    shape: Literal["uniform", "normal"]
    low: float | None = None
    high: float | None = None
    mean: float | None = None
    stddev: float | None = None

    def __post_init__(self):
        need = ("low", "high") if self.shape == "uniform" else ("mean", "stddev")
        if any(getattr(self, n) is None for n in need):
            raise BundleError("config", f"{self.shape} needs {' and '.join(need)}")

    def draw(self, *seed: Column) -> Column:
        u = lambda salt: (F.shiftrightunsigned(F.xxhash64(F.lit(salt), *seed), 11) + 1) / F.lit(float(2**53 + 1))
        if self.shape == "uniform":
            return F.lit(self.low) + u("u") * F.lit(self.high - self.low)
        return F.lit(self.mean) + F.lit(self.stddev) * F.sqrt(-2 * F.log(u("a"))) * F.cos(2 * F.pi() * u("b"))


@dataclass
class Mutation:
    kind: Literal["sentinel", "typo", "case", "whitespace", "truncate", "precision_drop", "scale", "mojibake", "format_dirt", "resample", "out_of_domain"]
    value: Any = None
    form: Literal["upper", "lower", "title", "swap"] | None = None
    where: Literal["leading", "trailing"] | None = None
    max_length: int | None = None
    digits: int | None = None
    factor: float | None = None

    def options(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "kind" and v is not None}


@dataclass
class Shift:
    kind: Literal["offset", "collide", "swap"]
    distribution: Distribution | None = None


@dataclass
class Operation:
    kind: Literal["null_cells", "mutate_cells", "duplicate_rows", "delete_rows", "insert_rows", "schema_drift", "dangle_reference", "mispoint_reference", "drop_events", "freeze_series", "shift_sim_time", "distort_intervals"]
    target: Target
    name: str | None = None
    amount: Amount | None = None
    placement: Placement | None = None
    mutation: Mutation | None = None
    jitter: Distribution | None = None
    rename_to: dict[str, str] | None = None
    retype_to: dict[str, str] | None = None
    drop: list[str] | None = None
    constraint: Literal["created_after_reference"] | None = None
    cut: Literal["after_first", "random"] | None = None
    shift: Shift | None = None
    mode: Literal["overlap", "gap", "left_before_join"] | None = None

    def __post_init__(self):
        if (self.amount is None) != (self.kind == "schema_drift"):
            raise BundleError("config", f"{self.kind}: amount is {'needed' if self.amount is None else 'not used'}")
        need = {"mutate_cells": "mutation", "freeze_series": "cut", "shift_sim_time": "shift", "distort_intervals": "mode"}.get(self.kind)
        if need and getattr(self, need) is None:
            raise BundleError("config", f"{self.kind} needs {need}")


@dataclass
class Corruption:
    seed: int
    operations: list[Operation]


@dataclass
class State:
    """Working tables with a row identity, and the defects so far."""

    bundle: Bundle
    frames: dict[str, DataFrame]
    next_index: dict[str, int]
    defects: list[DataFrame] = field(default_factory=list)

    def table(self, name: str) -> Table:
        return self.bundle.sidecar.table(name)

    def current(self) -> Bundle:
        return self.bundle.replacing({n: f.drop(ROW) for n, f in self.frames.items()})


def load(bundle: Bundle) -> State:
    """Every table with ROW, a text made of the row's content and, among equal rows, their number."""
    frames, index = {}, {}
    for t in bundle.sidecar.tables:
        rows = bundle.table(t.name).select(*t.names())
        nulls = F.concat(*(F.when(F.col(c).isNull(), "1").otherwise("0") for c in rows.columns))  # hashes skip nulls
        h = F.concat_ws("-", F.hex(F.xxhash64(nulls, *rows.columns)), F.hex(F.xxhash64(F.lit("b"), nulls, *rows.columns)))
        again = F.row_number().over(Window.partitionBy("_h").orderBy(F.lit(0)))
        frames[t.name] = written(rows.withColumn("_h", h).withColumn(ROW, F.concat_ws("-", "_h", again.cast("string"))).drop("_h"), t.name)
        if t.category == "records":
            index[t.record_kind] = (frames[t.name].agg(F.max("record_index")).first()[0] or -1) + 1
    return State(bundle, frames, index)


class Runner:
    def __init__(self, state: State, op: Operation, seed: int, number: int):
        self.state, self.op, self.seed = state, op, F.lit(f"{seed}:{number}")
        self.rule = op.name or f"{op.kind}_{number}"

    def hash(self, *columns: str | Column) -> Column:
        return F.xxhash64(self.seed, *columns)

    def tables(self) -> list[Table]:
        t, all_ = self.op.target, self.state.bundle.sidecar.tables
        if t.table or t.tables:
            return [self.state.table(n) for n in ([t.table] if t.table else t.tables)]
        if t.glob:
            found = [x for x in all_ if fnmatch.fnmatchcase(x.name, t.glob)]
        elif t.category:
            found = [x for x in all_ if x.category == t.category or (t.category == "fixed" and x.category == "history")]
        else:
            found = [x for x in all_ if x.record_kind == t.record_kind and x.category == "records"]
        if not found:
            raise BundleError("target", f"{self.rule}: no table fits")
        return found

    def columns(self, table: Table, roles: tuple[str, ...] = ("payload", "element", "member", "presentation")) -> list[str]:
        can = [c.name for c in table.columns if (c.role in roles or (table.name == "history" and c.name == "value")) and c.name not in FIXED]
        said = self.op.target.columns
        if said is None:
            return can
        out = [c for c in can if any(c == s or fnmatch.fnmatchcase(c, s) for s in said)]
        extra = [s for s in said if table.column(s) and s not in out and s == "deactivated_at"]
        return out + extra

    def rows(self, table: Table) -> DataFrame:
        return filtered(self.state.frames[table.name], self.op.target.where, table)

    def weight(self, units: DataFrame, source: DataFrame) -> DataFrame:
        """units with _w, the placement's weight of their row."""
        p = self.op.placement
        if p is None:
            return units.withColumn("_w", F.lit(1.0))
        if p.kind == "entity_scoped":
            ids = source.select("record_id").distinct().withColumn("_o", self.hash(F.lit("entity"), "record_id"))
            picked = kernels.smallest(ids, "_o", p.entities.of(ids.count()), ["record_id"]).select("record_id").withColumn("_w", F.lit(1.0))
            return units.join(source.select(ROW, "record_id"), ROW).join(picked, "record_id").drop("record_id")
        if p.kind == "correlated":
            value = source.select(ROW, F.when(F.col(p.column).cast("string") == p.value, F.lit(float(p.weight))).otherwise(1.0).alias("_w"))
            return units.join(value, ROW)
        times = source.select(ROW, F.col(p.column).alias("_t"))
        centres = kernels.smallest(times.withColumn("_o", self.hash(F.lit("centre"), ROW)), "_o", p.clusters, [ROW]).select("_t").collect()  # as many as the configuration names
        near = F.lit(False)
        for c in centres:
            near = near | (F.abs(F.col("_t") - F.lit(c[0])) <= p.width)
        return units.join(times.where(near).select(ROW, F.lit(1.0).alias("_w")), ROW)

    def draw(self, units: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
        """The exact amount of units, weighted by the placement; by the key u ** (1 / w), largest first."""
        n = units.count()
        k = self.op.amount.of(n)
        u = (F.shiftrightunsigned(self.hash(*keys), 11) + 1) / F.lit(float(2**53 + 1))
        weighted = self.weight(units, source).where("_w > 0")
        ordered = weighted.withColumn("_o", F.floor((1 - F.pow(u, 1 / F.col("_w"))) * F.lit(float(2**62))).cast("long"))
        return kernels.smallest(ordered, "_o", k, keys).drop("_o", "_w")

    def cells(self, table_columns: dict[str, list[str]]) -> dict[str, DataFrame]:
        """Drawn cells per table: ROW and column. All tables are one pool."""
        pool, source = None, None
        for name, columns in table_columns.items():
            rows = self.rows(self.state.table(name))
            one = rows.select(F.lit(name).alias("_table"), ROW, F.explode(F.array(*map(F.lit, columns))).alias("_column")) if columns else None
            if one is not None:
                pool = one if pool is None else pool.unionByName(one)
                source = rows if source is None else source.unionByName(rows, allowMissingColumns=True)
        if pool is None:
            raise BundleError("target", f"{self.rule}: no column fits")
        drawn = written(self.draw(pool, source, ["_table", ROW, "_column"]), "drawn")
        return {name: drawn.where(F.col("_table") == name).select(ROW, "_column") for name in table_columns}

    def drawn_rows(self, rows: dict[str, DataFrame]) -> dict[str, DataFrame]:
        pool, source = None, None
        for name, frame in rows.items():
            one = frame.select(F.lit(name).alias("_table"), ROW)
            pool = one if pool is None else pool.unionByName(one)
            source = frame if source is None else source.unionByName(frame, allowMissingColumns=True)
        drawn = written(self.draw(pool, source, ["_table", ROW]), "drawn")
        return {name: drawn.where(F.col("_table") == name).select(ROW) for name in rows}

    def put(self, name: str, frame: DataFrame) -> None:
        self.state.frames[name] = written(frame, name)

    def report(self, name: str, hit: DataFrame, cls: str | Column, column: str | Column | None = None, old: Column | None = None, new: Column | None = None) -> None:
        """Record one defect per row of hit, which has the table's columns as they were."""
        table = self.state.table(name)
        text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string") if isinstance(c, Column) else F.lit(c)
        kind = F.col("kind") if name == "history" else F.lit(table.record_kind)
        prop = F.col("property") if name == "history" else F.regexp_extract(text(column), "^prop__(.*)", 1) if column is not None else F.lit(None).cast("string")
        made = hit.select(
            text(cls).alias("class"), F.lit(self.rule).alias("rule"), F.lit(name).alias("table"), text(column).alias("column"), F.col(ROW).alias("row"),
            kind.alias("kind"), F.col("record_id") if "record_id" in hit.columns else F.lit(None).cast("string").alias("record_id"), F.when(prop != "", prop).alias("property"),
            (F.col("sim_time") if name == "history" else F.lit(None).cast("long")).alias("sim_time"), text(old).alias("before"), text(new).alias("after"),
        )
        self.state.defects.append(written(made, "defects"))

    def change_cells(self, drawn: dict[str, DataFrame], new_value, cls: str) -> None:
        """Replace drawn cells by new_value(table, column name, frame) -> Column; nulls and cells left as they were are no defects."""
        for name, cells in drawn.items():
            table = self.state.table(name)
            columns = [c.name for c in table.columns]
            marks = cells.groupBy(ROW).agg(F.collect_set("_column").alias("_cells"))
            frame = self.state.frames[name].join(marks, ROW, "left")
            fresh = {c: new_value(table, c, frame) for c in self.columns(table)}
            hit = {c: F.array_contains("_cells", c) for c in fresh}
            changed = {c: F.when(hit[c], v).otherwise(F.col(c)).alias(c) for c, v in fresh.items()}
            after = frame.select(*(changed.get(c, F.col(c)) for c in columns), ROW)
            entries = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("old"), v.cast("string").alias("new"), F.coalesce(hit[c], F.lit(False)).alias("hit")) for c, v in fresh.items())))
            told = frame.withColumn("_e", entries).where("_e.hit and _e.old is not null and not (_e.old <=> _e.new)")
            self.report(name, told, cls, F.col("_e.column"), F.col("_e.old"), F.col("_e.new"))
            self.put(name, after)

    def run(self) -> None:
        getattr(self, self.op.kind)()

    def null_cells(self) -> None:
        targets = {t.name: self.columns(t) for t in self.tables()}
        self.change_cells(self.cells(targets), lambda t, c, f: F.lit(None).cast(spark_type(t.column(c).type)), "missing_value")

    def mutate_cells(self) -> None:
        m = self.op.mutation
        fits = lambda t, c: any(t.column(c).type.upper().startswith(k) for k in mutations.TAKES[m.kind])
        targets = {t.name: [c for c in self.columns(t) if fits(t, c)] for t in self.tables()}
        drawn = self.cells(targets)
        if m.kind in POOLED:
            for name, cells in drawn.items():
                self.state.frames[name] = self.with_replacements(name, self.state.frames[name], cells, targets[name])

        def value(t: Table, c: str, f: DataFrame) -> Column:
            if c not in targets[t.name]:
                return F.col(c)
            if m.kind in POOLED:
                return F.coalesce(F.element_at("_news", c).cast(spark_type(t.column(c).type)), F.col(c))
            return mutations.mutate(m.kind, F.col(c), t.column(c).type, self.hash(ROW, F.lit(c)), **m.options())

        self.change_cells(drawn, value, mutations.CLASS[m.kind])

    def with_replacements(self, name: str, frame: DataFrame, cells: DataFrame, columns: list[str], kind: str | None = None) -> DataFrame:
        """frame with _news, a map from column to the new value (as text) of each of the row's cells.

        The distinct values of a column may be as many as its rows, so they are
        never gathered: a resampled value is the one at a seeded place of the
        numbered distinct values (the next one if that is the cell's own), and
        transpositions are anti-joined against them.
        """
        kind, out = kind or self.op.mutation.kind, None
        source = self.state.frames[name]
        for c in columns:
            values = source.select(F.col(c).alias("_v")).where("_v is not null").distinct()
            hit = frame.select(ROW, F.col(c).alias("_old")).where("_old is not null").join(cells.where(F.col("_column") == c).select(ROW), ROW, "left_semi")
            if kind == "resample":
                numbered = kernels.dense_sequence(values, ["_v"], "_i", 0)
                n = numbered.count()
                if n < 2:
                    continue
                first = hit.withColumn("_i", F.pmod(self.hash(ROW, F.lit(c)), F.lit(n))).join(numbered, "_i")
                again = first.where("_v = _old").select(ROW, "_old", F.pmod(F.col("_i") + 1, F.lit(n)).alias("_i")).join(numbered, "_i")
                fresh = first.where("_v <> _old").select(ROW, "_v").unionByName(again.select(ROW, "_v"))
            else:
                places = F.sequence(F.lit(1), F.greatest(F.length("_old") - 1, F.lit(1)))
                tries = hit.select(ROW, "_old", F.posexplode(F.transform(places, lambda i: mutations.swapped(F.col("_old"), i))).alias("_at", "_try"))
                outside = tries.where("length(_old) >= 2 and _try <> _old").join(values, tries["_try"] == values["_v"], "left_anti")
                found = outside.groupBy(ROW).agg(F.min_by("_try", "_at").alias("_v"))
                fresh = hit.join(found, ROW, "left").select(ROW, F.coalesce("_v", F.concat("_old", F.right("_old", F.lit(1)))).alias("_v"))
            one = fresh.select(ROW, F.struct(F.lit(c).alias("key"), F.col("_v").cast("string").alias("value")).alias("_e"))
            out = one if out is None else out.unionByName(one)
        if out is None:
            return frame.withColumn("_news", F.lit(None).cast("map<string,string>"))
        return frame.join(out.groupBy(ROW).agg(F.map_from_entries(F.collect_list("_e")).alias("_news")), ROW, "left")

    def duplicate_rows(self) -> None:
        op = self.op
        cls = "near_duplicate_row" if op.jitter else "conflicting_duplicate_row" if op.mutation else "duplicate_row"
        for name, drawn in self.drawn_rows({t.name: self.rows(t) for t in self.tables()}).items():
            table = self.state.table(name)
            copies = self.state.frames[name].join(drawn, ROW, "left_semi")
            before = copies
            for c in self.columns(table):
                kind = spark_type(table.column(c).type)
                if op.jitter and op.target.columns and kind in ("bigint", "int", "double"):
                    moved = F.col(c) + op.jitter.draw(self.seed, F.col(ROW), F.lit(c))
                    copies = copies.withColumn(c, (F.bround(moved) if kind != "double" else moved).cast(kind))
                if op.mutation and op.target.columns and any(table.column(c).type.upper().startswith(k) for k in mutations.TAKES[op.mutation.kind]):
                    if op.mutation.kind in POOLED:
                        copies = self.with_replacements(name, copies, drawn.withColumn("_column", F.lit(c)), [c])
                        copies = copies.withColumn(c, F.coalesce(F.element_at("_news", c).cast(kind), F.col(c))).drop("_news")
                    else:
                        copies = copies.withColumn(c, mutations.mutate(op.mutation.kind, F.col(c), table.column(c).type, self.hash(ROW, F.lit(c)), **op.mutation.options()))
            copies = copies.withColumn(ROW, F.concat_ws("-", F.lit("copy"), self.seed, ROW))
            self.report(name, before, cls)
            self.put(name, self.state.frames[name].unionByName(copies))

    def delete_rows(self) -> None:
        for name, drawn in self.drawn_rows({t.name: self.rows(t) for t in self.tables()}).items():
            frame = self.state.frames[name]
            self.report(name, frame.join(drawn, ROW, "left_semi"), "deleted_row" if self.op.kind == "delete_rows" else "dropped_event")
            self.put(name, frame.join(drawn, ROW, "left_anti"))

    drop_events = delete_rows

    def insert_rows(self) -> None:
        for name, drawn in self.drawn_rows({t.name: self.rows(t) for t in self.tables()}).items():
            table, frame = self.state.table(name), self.state.frames[name]
            if table.category != "records":
                raise BundleError("target", f"{self.rule}: phantom rows are records")
            fresh = frame.join(drawn, ROW, "left_semi").withColumn("_o", self.hash(ROW))
            fresh = kernels.dense_sequence(fresh, ["_o", ROW], "_nth", 0)
            ids = frame.select("record_id").distinct()
            fresh = fresh.withColumn("_new", F.concat(F.lit("ghost-"), F.lower(F.hex(self.hash(ROW, F.lit("id"))))))
            taken = fresh.select("_new").join(ids, fresh["_new"] == ids["record_id"], "left_semi").withColumn("_taken", F.lit("-2"))
            fresh = fresh.join(taken, "_new", "left").withColumn("_new", F.concat("_new", F.coalesce("_taken", F.lit(""))))
            start = self.state.next_index[table.record_kind]
            self.state.next_index[table.record_kind] = start + fresh.count()
            fresh = fresh.withColumns({"record_id": F.col("_new"), "record_index": F.col("_nth") + start, ROW: F.concat_ws("-", F.lit("ghost"), self.seed, ROW)})
            for c in self.op.target.columns or []:
                if table.column(c):
                    fresh = self.with_replacements(name, fresh, fresh.select(ROW, F.lit(c).alias("_column")), [c], "resample")
                    fresh = fresh.withColumn(c, F.coalesce(F.element_at("_news", c).cast(spark_type(table.column(c).type)), F.col(c))).drop("_news")
            fresh = fresh.select(*frame.columns)
            self.report(name, fresh, "phantom_row")
            self.put(name, frame.unionByName(fresh))

    def schema_drift(self) -> None:
        op, side = self.op, self.state.bundle.sidecar
        for table in self.tables():
            name, frame, columns = table.name, self.state.frames[table.name], list(table.columns)
            told: list[tuple[str, str, str]] = []
            for old, new in (op.rename_to or {}).items():
                if table.column(new) or table.column(old) is None or table.column(old).role != table.column(old).__class__(new, "VARCHAR").role:
                    raise BundleError("drift", f"{self.rule}: {old} can't become {new}")
                frame = frame.withColumnRenamed(old, new)
                columns = [replace(c, name=new) if c.name == old else c for c in columns]
                told.append(("column_rename", old, new))
            for c, kind in (op.retype_to or {}).items():
                frame = frame.withColumn(c, F.expr(f"try_cast(`{c}` as {spark_type(kind)})"))
                columns = [replace(x, type=kind) if x.name == c else x for x in columns]
                told.append(("column_retype", c, kind))
            for c in op.drop or []:
                frame = frame.drop(c)
                columns = [x for x in columns if x.name != c]
                told.append(("column_drop", c, ""))
            spark = frame.sparkSession
            made = spark.createDataFrame(told, "class string, column string, after string")
            kind = F.lit(table.record_kind)
            self.state.defects.append(written(made.select(
                "class", F.lit(self.rule).alias("rule"), F.lit(name).alias("table"), "column", F.lit(None).cast("string").alias("row"), kind.alias("kind"), F.lit(None).cast("string").alias("record_id"),
                F.regexp_extract("column", "^prop__(.*)", 1).alias("property"), F.lit(None).cast("long").alias("sim_time"), F.col("column").alias("before"), "after"), "defects"))
            self.put(name, frame)
            tables = tuple(replace(t, columns=tuple(columns)) if t.name == name else t for t in side.tables)
            side = replace(side, tables=tables)
        self.state.bundle = self.state.bundle.replacing({}, side)

    def reference_columns(self, table: Table) -> dict[str, str | None]:
        """Reference columns and the kind they refer to (None: the member's own kind column says)."""
        out: dict[str, str | None] = {}
        for c in self.columns(table):
            column = table.column(c)
            if column.references and c.startswith("prop__"):
                out[c] = column.references
            elif c.startswith("member__") and c.endswith("__id"):
                out[c] = None
        return out

    def universe(self, kinds: set[str]) -> DataFrame:
        ids = None
        for kind in sorted(kinds):
            one = self.state.frames[f"records__{kind}"].select(F.lit(kind).alias("_k"), "record_id", "created_sim_time", "record_index")
            ids = one if ids is None else ids.unionByName(one)
        return ids

    def point(self, make, cls: str) -> None:
        """Rewrite drawn reference cells with make(frame with _k, _old, _unit) -> (frame with _new, _new_index)."""
        targets = {t.name: list(self.reference_columns(t)) for t in self.tables()}
        for name, cells in self.cells(targets).items():
            table, frame = self.state.table(name), self.state.frames[name]
            for column, kind in self.reference_columns(table).items():
                hit = frame.join(cells.where(F.col("_column") == column).select(ROW), ROW, "left_semi").where(F.col(column).isNotNull())
                known = F.lit(kind) if kind else F.col(column[:-4] + "__kind")
                units = hit.withColumn("_k", known).withColumn("_old", F.col(column))
                moved = make(units, table, column)
                self.report(name, moved, cls, column, F.col("_old"), F.col("_new"))
                fresh = moved.select(ROW, "_new", "_new_index")
                frame = frame.join(fresh, ROW, "left").withColumn(column, F.coalesce("_new", column))
                index = f"ref_index__{column[6:]}"
                if index in frame.columns:
                    frame = frame.withColumn(index, F.when(F.col("_new").isNotNull(), F.col("_new_index")).otherwise(F.col(index)))
                frame = written(frame.drop("_new", "_new_index"), name)
            self.state.frames[name] = frame

    def dangle_reference(self) -> None:
        def make(units: DataFrame, table: Table, column: str) -> DataFrame:
            numbered = kernels.dense_sequence(units.withColumn("_o", self.hash(ROW)), ["_o", ROW], "_n", 0)
            kinds = {r[0] for r in units.select("_k").distinct().collect()} & set(self.state.bundle.sidecar.kinds())  # kinds of the sidecar
            used = self.universe(kinds).where(F.col("record_id").startswith("__dangling__")).count() if kinds else 0
            return numbered.withColumns({"_new": F.concat(F.lit("__dangling__"), (F.col("_n") + used).cast("string")), "_new_index": -(F.col("_n") + used + 1)}).drop("_o", "_n")

        self.point(make, "dangling_reference")

    def mispoint_reference(self) -> None:
        late = self.op.constraint == "created_after_reference"

        def make(units: DataFrame, table: Table, column: str) -> DataFrame:
            kinds = {r[0] for r in units.select("_k").distinct().collect()} & set(self.state.bundle.sidecar.kinds())
            pool = self.universe(kinds) if kinds else self.universe(set(self.state.bundle.sidecar.kinds()[:1])).limit(0)
            # donors numbered by kind and creation: later ones are a range, and a seeded place in it is one equi-join
            order = kernels.dense_sequence(pool, ["_k", "created_sim_time", "record_id"], "_at", 0)
            span = order.groupBy("_k").agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"))
            units = units.join(F.broadcast(span), "_k")  # one row per kind
            if late:
                time = {"membership": "joined_sim_time", "records": "last_mutation_sim_time"}.get(table.category, "sim_time")
                begin = kernels.as_of(units.select(ROW, "_k", F.col(time).alias("_t")), "_t", order.select("_k", "created_sim_time", "_at"), "created_sim_time", ["_k"], ["_at"])
                units = units.join(begin.select(ROW, F.col("_at").alias("_after")), ROW).withColumn("_lo", F.coalesce(F.col("_after") + 1, "_lo")).drop("_after")
            units = units.where("_lo <= _hi").withColumn("_pick", F.col("_lo") + F.pmod(self.hash(ROW, F.lit(column)), F.greatest(F.lit(1), F.col("_hi") - F.col("_lo") + 1)))
            named = order.select(F.col("_at").alias("_pick"), F.col("record_id").alias("_new"), F.col("record_index").alias("_new_index"))
            first = units.join(named, "_pick")
            same = first.where("_new = _old").drop("_new", "_new_index")
            # the old target itself was drawn: take its neighbour
            step = F.when(F.col("_pick") < F.col("_hi"), F.col("_pick") + 1).otherwise(F.col("_lo"))
            second = same.withColumn("_pick", step).join(named, "_pick").where("_new <> _old")
            return first.where("_new <> _old").unionByName(second.select(*first.columns)).drop("_pick", "_lo", "_hi")

        self.point(make, "point_in_time_dangling_reference" if late else "mispointed_reference")

    def series(self) -> DataFrame:
        return self.rows(self.state.table("history"))

    def freeze_series(self) -> None:
        key = ["kind", "record_id", "property"]
        history = self.state.frames["history"]
        long_ = self.series().groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min(ROW).alias(ROW)).where("_n >= 2")
        drawn = self.draw(long_.select(ROW, *key, "_n"), self.series(), key).select(*key, "_n")
        keep = F.lit(1) if self.op.cut == "after_first" else (F.pmod(self.hash(*key), F.greatest(F.lit(1), F.col("_n") - 1)) + 1)
        place = F.row_number().over(Window.partitionBy(*key).orderBy("sim_time", ROW))
        tail = written(history.join(drawn, key).withColumn("_place", place).where(F.col("_place") > keep).drop("_n", "_place"), "tail")
        self.report("history", tail, "frozen_series_event")
        self.put("history", history.join(tail.select(ROW), ROW, "left_anti"))

    def shift_sim_time(self) -> None:
        history, how = self.state.frames["history"], self.op.shift
        drawn = self.drawn_rows({"history": self.series()})["history"].withColumn("_hit", F.lit(True))
        rows = history.join(drawn, ROW, "left")
        key = ["kind", "record_id", "property"]
        if how.kind == "offset":
            delta = F.bround(how.distribution.draw(self.seed, F.col(ROW))).cast("long")
            moved = rows.where("_hit").withColumn("_to", F.col("sim_time") + delta).where("_to <> sim_time")
            cls = "shifted_event_time"
        elif how.kind == "collide":
            ticks = history.select(*key, "sim_time").distinct().withColumn("_to", F.lag("sim_time").over(Window.partitionBy(*key).orderBy("sim_time")))
            moved = rows.where("_hit").join(ticks, [*key, "sim_time"]).where("_to is not null")
            cls = "tick_collision"
        else:
            moved = self.swaps(rows)
            cls = "reordered_event"
        moved = written(moved.select(*history.columns, "_to"), "moved")
        self.report("history", moved, cls, "sim_time", F.col("sim_time"), F.col("_to"))
        changed = history.join(moved.select(ROW, "_to"), ROW, "left").withColumn("sim_time", F.coalesce("_to", "sim_time")).drop("_to")
        self.put("history", changed.select(*history.columns))

    def swaps(self, rows: DataFrame) -> DataFrame:
        """Drawn rows exchange their time with their predecessor's. In a run of drawn rows every second one does, from its start, so no row moves twice; equal values are skipped."""
        key = ["kind", "record_id", "property"]
        along = Window.partitionBy(*key).orderBy("sim_time", ROW)
        before = rows.withColumns({"_pt": F.lag("sim_time").over(along), "_pv": F.lag(F.struct("value")).over(along), "_pr": F.lag(ROW).over(along)})
        can = F.coalesce("_hit", F.lit(False)) & F.col("_pr").isNotNull() & (F.col("_pt") < F.col("sim_time")) & ~F.col("_pv.value").eqNullSafe(F.col("value"))
        placed = before.withColumn("_can", can).withColumn("_i", F.row_number().over(along)).withColumn("_start", F.max(F.when(~F.col("_can"), F.col("_i"))).over(along.rowsBetween(Window.unboundedPreceding, 0)))
        takes = placed.where("_can").withColumn("_odd", F.pmod(F.col("_i") - F.coalesce("_start", F.lit(0)), F.lit(2)) == 1).where("_odd")
        pairs = takes.select(F.col(ROW).alias("_a"), F.col("_pr").alias("_b"), F.col("sim_time").alias("_ta"), F.col("_pt").alias("_tb"))
        to = pairs.select(F.col("_a").alias(ROW), F.col("_tb").alias("_to")).unionByName(pairs.select(F.col("_b").alias(ROW), F.col("_ta").alias("_to")))
        return rows.join(to, ROW)

    def distort_intervals(self) -> None:
        mode = self.op.mode
        cls = {"overlap": "overlapping_interval", "gap": "interval_gap", "left_before_join": "inverted_interval"}[mode]
        rows, fresh = {}, {}
        for t in self.tables():
            if t.category != "membership":
                raise BundleError("target", f"{self.rule}: {t.name} holds no intervals")
            elements = [c.name for c in t.columns if c.role in ("element", "member")]
            after = Window.partitionBy("record_id", *elements).orderBy("joined_sim_time", ROW)
            frame = self.rows(t).withColumns({"_nj": F.lead("joined_sim_time").over(after), "_nl": F.lead("left_sim_time").over(after)})
            middle = lambda a, b: (F.col(a) + F.call_function("div", F.col(b) - F.col(a), F.lit(2)))
            if mode == "overlap":
                frame = frame.where("left_sim_time is not null and _nl is not null and _nj >= left_sim_time and _nl - _nj >= 2").withColumn("_to", middle("_nj", "_nl"))
            else:
                frame = frame.where(f"left_sim_time - joined_sim_time >= {2 if mode == 'gap' else 1}").withColumn("_to", middle("joined_sim_time", "left_sim_time"))
            rows[t.name], fresh[t.name] = frame.select(*self.state.frames[t.name].columns), frame
        for name, drawn in self.drawn_rows(rows).items():
            hit = written(fresh[name].join(drawn, ROW, "left_semi"), "hit")
            frame = self.state.frames[name]
            if mode == "left_before_join":
                self.report(name, hit, cls)
                swapped = hit.select(ROW, F.col("left_sim_time").alias("_j"), F.col("joined_sim_time").alias("_l"))
                frame = frame.join(swapped, ROW, "left").withColumns({"joined_sim_time": F.coalesce("_j", "joined_sim_time"), "left_sim_time": F.coalesce("_l", "left_sim_time")}).drop("_j", "_l")
            else:
                self.report(name, hit, cls, "left_sim_time", F.col("left_sim_time"), F.col("_to"))
                frame = frame.join(hit.select(ROW, "_to"), ROW, "left").withColumn("left_sim_time", F.coalesce("_to", "left_sim_time")).drop("_to")
            self.put(name, frame.select(*self.state.frames[name].columns))


def impacts(state: State, defects: DataFrame) -> DataFrame:
    """defects with ``impact``: the checks that now fail at the place of the defect, or BEYOND.

    The checks' violations are frames keyed like the defects, so this is a
    handful of joins for all defects of a run, whatever their number.
    """
    now = state.current()
    marks = [("C6", conformance.round_trip(now).select("kind", "record_id", "property").distinct(), ["kind", "record_id", "property"])]
    marks.append(("C13", conformance.genesis(now).select("kind", "record_id", "property").distinct(), ["kind", "record_id", "property"]))
    marks.append(("C11", conformance.pairs(now).distinct(), ["kind", "property"]))
    marks.append(("C7", conformance.null_groups(now).select("table", "record_id").distinct(), ["table", "record_id"]))
    marks.append(("C9", conformance.pins(now).distinct(), ["kind", "record_id"]))
    lost = conformance.intervals(now)
    marks.append(("C10", lost.select("table", "record_id").distinct(), ["table", "record_id"]))
    if (strange := conformance.undeclared(now)) is not None:
        marks.append(("C12", strange.select("table", "record_id").distinct(), ["table", "record_id"]))
    out = defects.withColumn("impact", F.array().cast("array<string>"))
    for code, frame, keys in marks:
        named = frame.withColumn("_hit", F.lit(True))
        # whole-row defects of records concern every property of the record
        use = [k for k in keys if k != "property"] if code in ("C6", "C13") else keys
        if use != keys:
            rowwise = named.select(*use, "_hit").distinct().withColumnRenamed("_hit", "_any")
            out = out.join(named, keys, "left").join(rowwise, use, "left")
            out = out.withColumn("_hit", F.when(F.col("column").isNull() & (F.col("table") != "history"), F.col("_any")).otherwise(F.col("_hit"))).drop("_any")
        else:
            out = out.join(named, keys, "left")
        relevant = F.coalesce("_hit", F.lit(False))
        if code == "C12":  # other cells of the record have no part in it
            relevant &= F.col("column").isNull() | (F.col("column") == "prop__actor_type")
        out = out.withColumn("impact", F.when(relevant, F.array_append("impact", code)).otherwise(F.col("impact"))).drop("_hit")
    members = lost.where("member is not null").select(F.col("member").alias("record_id")).distinct().withColumn("_hit", F.lit(True))
    out = out.join(members, "record_id", "left")
    wake = (F.col("class") == "deleted_row") & F.col("table").startswith("records__") & F.coalesce("_hit", F.lit(False)) & ~F.array_contains("impact", "C10")
    out = out.withColumn("impact", F.when(wake, F.array_append("impact", "C10")).otherwise(F.col("impact"))).drop("_hit")
    return out.withColumn("impact", F.when(F.size("impact") == 0, F.array(F.lit(BEYOND))).otherwise(F.array_sort("impact")))


def identified(defects: DataFrame) -> DataFrame:
    """defects with a content-derived id: equal places are numbered before hashing."""
    place = F.to_json(F.struct("class", "rule", "table", "column", "row"))
    nth = F.row_number().over(Window.partitionBy("_place").orderBy("before", "after"))
    return defects.withColumn("_place", place).withColumn("id", F.sha2(F.concat_ws("|", "_place", nth.cast("string")), 256)).drop("_place")


def corrupt(bundle: Bundle, raw: dict, check_source: bool = True) -> tuple[Bundle, DataFrame]:
    """The corrupted bundle and its defects, one row each: id, class, rule, place, before, after, impact."""
    config = build(Corruption, raw)
    bundle.sidecar.fork  # noqa: B018  one branch only
    if check_source:
        failed = [f.check for f in conformance.validate(bundle) if not f.ok]
        if failed:
            raise BundleError("source", f"the bundle itself fails {', '.join(failed)}")
    state = load(bundle)
    for i, op in enumerate(config.operations):
        Runner(state, op, config.seed, i).run()
    if all(f.isEmpty() for f in state.frames.values()):
        raise BundleError("erased", "nothing is left")
    schema = "class string, rule string, table string, column string, row string, kind string, record_id string, property string, sim_time long, before string, after string"
    defects = bundle.spark.createDataFrame([], schema)
    for d in state.defects:
        defects = defects.unionByName(d)
    return state.current(), identified(impacts(state, defects))


def write_manifest(defects: DataFrame, out: str) -> None:
    """The defects, sorted by table, then column before row before cell, as JSON lines."""
    level = F.when(F.col("row").isNull(), 0).when(F.col("column").isNull(), 1).otherwise(2)
    defects.withColumn("_l", level).orderBy("table", "_l", "id").drop("_l").write.mode("errorifexists").json(out)


def manifest_summary(defects: DataFrame) -> dict:
    """Defects per class and per impact: small, whatever the run."""
    by_class = {r[0]: r[1] for r in defects.groupBy("class").count().collect()}
    by_impact = {r[0]: r[1] for r in defects.select(F.explode("impact").alias("i")).groupBy("i").count().collect()}
    return {"defect_counts": by_class, "impact_counts": by_impact}


def summary_text(defects: DataFrame) -> str:
    return json.dumps(manifest_summary(defects), sort_keys=True)
