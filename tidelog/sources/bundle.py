"""A dataset bundle: Parquet tables beside a JSON sidecar that declares them.

Three categories of tables: ``history`` (one row per change of a tracked
property, values as text), ``records__<kind>`` (one row per record) and
``membership__<kind>__<property>`` (intervals). The sidecar is the authority on
columns, types, references and what may be asked about the past.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 8
#: Leading columns of the tables, and the types of the sidecar.
HISTORY = ("fork_path", "kind", "record_id", "property", "sim_time", "value")
RECORD_PREFIX = ("fork_path", "record_id", "created_sim_time", "active", "deactivated_at", "last_mutation_sim_time", "record_index")
LIFECYCLE = ("created_sim_time", "active", "deactivated_at", "last_mutation_sim_time")
TYPES = {
    "TINYINT": "tinyint", "SMALLINT": "smallint", "INTEGER": "int", "BIGINT": "bigint", "UBIGINT": "decimal(20,0)", "HUGEINT": "decimal(38,0)",
    "FLOAT": "float", "REAL": "float", "DOUBLE": "double", "BOOLEAN": "boolean", "VARCHAR": "string", "BLOB": "binary",
}


#: Bits of the whole numbers.
WIDTHS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}
#: The members of a sidecar, the needed and known ones first.
SIDECAR = ("base_format_version", "branches", "runtime", "tables", "pinned_ids", "enum_domains", "record_roles", "sub_type_columns", "presentation_keys", "row_census")


class BundleError(ValueError):
    """A bundle or configuration that is refused; ``code`` names the rule."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def spark_type(declared: str) -> str:
    """The Spark type of a sidecar type."""
    name = declared.strip().upper()
    if m := re.fullmatch(r"(?:DECIMAL|NUMERIC)\((\d+),\s*(\d+)\)", name):
        return f"decimal({m[1]},{m[2]})"
    if re.fullmatch(r"VARCHAR\(\d+\)", name):
        return "string"
    if name not in TYPES:
        raise BundleError("type", f"{declared} is no type of a bundle")
    return TYPES[name]


def declared_type(kind: T.DataType) -> str:
    """The sidecar type of a Spark type."""
    simple = kind.simpleString()
    if simple.startswith("decimal"):
        return simple.upper()
    return {v: k for k, v in reversed(TYPES.items())}.get(simple) or simple.upper()


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    references: str | None = None
    history_tracked: bool | None = None
    temporal_class: str | None = None

    @property
    def role(self) -> str:
        """identity, lifecycle, presentation, payload, index, element, member or none."""
        if self.name in ("fork_path", "record_id", "record_index"):
            return "identity"
        if self.name == "presentation_id":
            return "presentation"
        if self.name in LIFECYCLE or self.name in ("joined_sim_time", "left_sim_time"):
            return "lifecycle"
        for prefix, role in (("prop__", "payload"), ("ref_index__", "index"), ("elem__", "element"), ("member__", "member")):
            if self.name.startswith(prefix):
                return role
        return "none"


@dataclass(frozen=True)
class Table:
    name: str
    category: str
    columns: tuple[Column, ...]
    record_kind: str | None = None
    property: str | None = None
    rows: int | None = None

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def properties(self) -> list[str]:
        return [c.name[6:] for c in self.columns if c.role == "payload"]

    def member_fields(self) -> list[str]:
        return [c.name[8:-4] for c in self.columns if c.role == "member" and c.name.endswith("__id")]


@dataclass(frozen=True)
class Sidecar:
    version: int
    branches: tuple[dict, ...]
    runtime: dict | None
    tables: tuple[Table, ...]
    optional: dict = field(default_factory=dict)
    #: What was parsed, with members that are not declared; None for a sidecar that was made.
    read: dict | None = field(default=None, compare=False, repr=False)

    @classmethod
    def parse(cls, raw: Mapping) -> Sidecar:
        """The sidecar of a JSON object. One without the needed members, or with members of another shape, is refused."""
        try:
            return cls._parse(raw)
        except (KeyError, TypeError, AttributeError) as x:
            raise BundleError("sidecar", f"base.json lacks or misshapes {x}") from x

    @classmethod
    def _parse(cls, raw: Mapping) -> Sidecar:
        version = raw.get("base_format_version")
        if version != VERSION:
            raise BundleError("version", f"format version {version!r} is not {VERSION}; nothing is upgraded by itself")
        tables = []
        for t in raw["tables"]:
            columns = tuple(Column(c["name"], c["type"], c.get("references"), c.get("history_tracked"), c.get("temporal_class")) for c in t["columns"])
            tables.append(Table(t["name"], t["category"], columns, t.get("record_kind"), t.get("property"), t.get("rows")))
        return cls(version, tuple(dict(b) for b in raw["branches"]), raw.get("runtime"), tuple(tables), {k: v for k, v in raw.items() if k in SIDECAR[4:]}, dict(raw))

    def raw(self) -> dict:
        tables = []
        for t in self.tables:
            columns = []
            for c in t.columns:
                extra = {k: getattr(c, k) for k in ("references", "history_tracked", "temporal_class") if getattr(c, k) is not None}
                columns.append({"name": c.name, "type": c.type, **extra})
            tables.append({"name": t.name, "category": t.category, "columns": columns, **{k: getattr(t, k) for k in ("record_kind", "property", "rows") if getattr(t, k) is not None}})
        return {"base_format_version": self.version, "branches": list(self.branches), **({"runtime": self.runtime} if self.runtime else {}), "tables": tables, **self.optional}

    @property
    def fork(self) -> str:
        if len(self.branches) != 1:
            raise BundleError("branch", f"{len(self.branches)} branches; exactly one is supported")
        return self.branches[0]["fork_path"]

    @property
    def slice_at(self) -> int | None:
        return self.branches[0].get("slice_at")

    def table(self, name: str) -> Table:
        found = next((t for t in self.tables if t.name == name), None)
        if found is None:
            raise BundleError("table", f"the sidecar declares no table {name}")
        return found

    def has(self, name: str) -> bool:
        return any(t.name == name for t in self.tables)

    def kinds(self) -> list[str]:
        return [t.record_kind for t in self.tables if t.category == "records"]

    def records(self, kind: str) -> Table:
        return self.table(f"records__{kind}")

    def membership(self, kind: str, prop: str) -> Table:
        return self.table(f"membership__{kind}__{prop}")

    def tracked(self, kind: str) -> list[str]:
        return [c.name[6:] for c in self.records(kind).columns if c.history_tracked]

    def references(self, kind: str) -> dict[str, str]:
        """prop__ column to the kind it refers to."""
        return {c.name: c.references for c in self.records(kind).columns if c.references and c.role == "payload"}

    def domain(self, kind: str) -> list[str] | None:
        """The declared sub-types of a kind, in order; None for a flat kind."""
        return self.optional.get("enum_domains", {}).get(kind, {}).get(f"{kind}_type")

    def discriminator(self, kind: str) -> str | None:
        return f"prop__{kind}_type" if self.domain(kind) and self.records(kind).column(f"prop__{kind}_type") else None

    def slice_only(self, kind: str, column: str) -> bool:
        """Whether the column's past can't be known; the discriminator of a sub-typed kind is exempt."""
        c = self.records(kind).column(column)
        return bool(c) and c.temporal_class == "slice_only" and column != self.discriminator(kind)


class Bundle:
    """A sidecar with one lazy DataFrame per declared table; tables can be exchanged, so a truncated tape reads like a whole one."""

    def __init__(self, spark: SparkSession, sidecar: Sidecar, provider: Callable[[str], DataFrame]):
        self.spark, self.sidecar, self._provider = spark, sidecar, provider

    def table(self, name: str) -> DataFrame:
        self.sidecar.table(name)
        return self._provider(name)

    def replacing(self, frames: Mapping[str, DataFrame], sidecar: Sidecar | None = None) -> Bundle:
        return Bundle(self.spark, sidecar or self.sidecar, lambda name: frames[name] if name in frames else self._provider(name))

    def records(self, kind: str, where: Mapping | None = None) -> DataFrame:
        t = self.sidecar.records(kind)
        rows = self.table(t.name).where(F.col("fork_path") == self.sidecar.fork).select(*t.names())
        return filtered(rows, where, t)

    def history(self, kind: str | None = None, properties: Iterable[str] | None = None, value=None) -> DataFrame:
        rows = self.table("history").where(F.col("fork_path") == self.sidecar.fork)
        if kind is not None:
            rows = rows.where(F.col("kind") == kind)
        if properties is not None:
            rows = rows.where(F.col("property").isin(list(properties)))
        return filtered(rows, None if value is None else {"value": value}, self.sidecar.table("history"))

    def membership(self, kind: str, prop: str, where: Mapping | None = None) -> DataFrame:
        t = self.sidecar.membership(kind, prop)
        return filtered(self.table(t.name).where(F.col("fork_path") == self.sidecar.fork).select(*t.names()), where, t)

    def distinct_values(self, kind: str, prop: str) -> DataFrame:
        c = f"prop__{prop}"
        return self.records(kind).select(c).where(F.col(c).isNotNull()).distinct().orderBy(c)

    def sql(self, query: str, **args) -> DataFrame:
        """A query over the bundle's tables under their own names."""
        frames = {t.name: self.table(t.name) for t in self.sidecar.tables}
        names = {n: "{" + n + "}" for n in frames}
        pattern = re.compile(r"\b(" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")\b(?!\s*\.)")
        used = set(pattern.findall(query))
        return self.spark.sql(pattern.sub(lambda m: names[m[1]], query), args=args or None, **{n: frames[n] for n in used})


def literal(value, declared: str):
    """A typed literal; a value that doesn't fit its column's type is refused."""
    kind, text = spark_type(declared), str(value).strip()
    try:
        if kind in WIDTHS:
            if isinstance(value, (bool, float)) or not -(2 ** (WIDTHS[kind] - 1)) <= int(text) < 2 ** (WIDTHS[kind] - 1):
                raise ValueError
        elif kind in ("float", "double") or kind.startswith("decimal"):
            if isinstance(value, bool):
                raise ValueError
            float(text)
        elif kind == "boolean" and text.lower() not in ("t", "true", "y", "yes", "1", "f", "false", "n", "no", "0"):
            raise ValueError
    except ValueError as x:
        raise BundleError("predicate", f"{value!r} is no {declared}") from x
    return F.lit(value).cast(kind)


def condition(column: str, value, declared: str):
    """column = value, or column IN for a list."""
    values = list(value) if isinstance(value, (list, tuple)) else [value]
    if not values:
        raise BundleError("predicate", f"no value for {column}")
    if len(values) == 1:
        return F.col(column) == literal(values[0], declared)
    return F.col(column).isin(*[literal(v, declared) for v in values])


def filtered(rows: DataFrame, where: Mapping | None, table: Table) -> DataFrame:
    for name, value in (where or {}).items():
        c = table.column(name)
        if c is None:
            raise BundleError("column", f"{table.name} has no column {name}")
        rows = rows.where(condition(name, value, c.type))
    return rows


def open_bundle(spark: SparkSession, path: str) -> Bundle:
    """A bundle from ``base.json`` and one ``<table>.parquet`` per declared table."""
    path = path.rstrip("/")

    def read(name: str, load: Callable):
        try:
            return load()
        except AnalysisException as x:
            raise BundleError("missing", f"{path}/{name} can't be read") from x

    found = read("base.json", lambda: spark.read.text(f"{path}/base.json", wholetext=True).first())
    if found is None:
        raise BundleError("missing", f"{path}/base.json is empty")
    try:
        raw = json.loads(found[0])
    except ValueError as x:
        raise BundleError("sidecar", f"{path}/base.json is no JSON") from x
    return Bundle(spark, Sidecar.parse(raw), lambda name: read(f"{name}.parquet", lambda: spark.read.parquet(f"{path}/{name}.parquet")))


def import_duckdb(spark: SparkSession, source: str, target: str) -> Bundle:
    """Turn a bundle kept in a DuckDB file (run.duckdb with base.json) into Parquet, once, through DuckDB's own export."""
    import shutil
    from pathlib import Path

    import duckdb

    Path(target).mkdir(parents=True, exist_ok=True)
    shutil.copyfile(f"{source}/base.json", f"{target}/base.json")
    sidecar = Sidecar.parse(json.loads(Path(target, "base.json").read_text()))
    con = duckdb.connect(f"{source}/run.duckdb", read_only=True)
    for t in sidecar.tables:
        con.execute(f"COPY (SELECT * FROM \"{t.name}\") TO '{target}/{t.name}.parquet' (FORMAT parquet)")
    con.close()
    return open_bundle(spark, target)


def with_columns(table: Table, columns: Iterable[Column]) -> Table:
    return replace(table, columns=tuple(columns))
