"""Configurations of exports, streams and corruptions, parsed strictly: an unknown key or a missing one is refused."""

from __future__ import annotations

import dataclasses
import json
import types
import typing
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path
from typing import Any, Literal

from tidelog.sources.bundle import BundleError

Surface = Literal["record_id", "record_index", "presentation_id"]


def build(kind: Any, raw: Any, where: str = "config") -> Any:
    """raw as the declared type; dataclasses from mappings, unions by the first type that fits."""
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if kind is Any:
        return raw
    if origin in (typing.Union, types.UnionType):
        problems = []
        for option in args:
            if option is type(None) and raw is None:
                return None
            if option is type(None):
                continue
            try:
                return build(option, raw, where)
            except BundleError as x:
                problems.append(str(x))
        raise BundleError("config", problems[0] if len(problems) == 1 else f"{where}: {raw!r} fits nothing; " + "; ".join(problems))
    if origin is Literal:
        if raw not in args or isinstance(raw, bool) != isinstance(args[0], bool):
            raise BundleError("config", f"{where}: {raw!r} is none of {', '.join(map(repr, args))}")
        return raw
    if origin in (list, tuple):
        if not isinstance(raw, (list, tuple)):
            raise BundleError("config", f"{where}: a list is expected")
        return [build(args[0], x, f"{where}[{i}]") for i, x in enumerate(raw)]
    if origin is dict:
        if not isinstance(raw, dict):
            raise BundleError("config", f"{where}: a mapping is expected")
        return {build(args[0], k, where): build(args[1], v, f"{where}.{k}") for k, v in raw.items()}
    if dataclasses.is_dataclass(kind):
        if not isinstance(raw, dict):
            raise BundleError("config", f"{where}: a mapping is expected")
        hints = typing.get_type_hints(kind)
        names = {f.metadata.get("key", f.name): f for f in dataclasses.fields(kind)}
        if unknown := [k for k in raw if k not in names]:
            raise BundleError("config", f"{where}: unknown {', '.join(map(str, unknown))}")
        missing = [k for k, f in names.items() if k not in raw and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING]
        if missing:
            raise BundleError("config", f"{where}: {', '.join(missing)} missing")
        return kind(**{names[k].name: build(hints[names[k].name], v, f"{where}.{k}") for k, v in raw.items()})
    if kind is datetime:
        return raw if isinstance(raw, datetime) else datetime.fromisoformat(str(raw))
    if kind is float and isinstance(raw, int) and not isinstance(raw, bool):
        return float(raw)
    if not isinstance(raw, kind) or (isinstance(raw, bool) and kind is not bool):
        raise BundleError("config", f"{where}: {raw!r} is no {kind.__name__}")
    return raw


def one_of(what: str, **given: Any) -> str:
    """The single name that is given."""
    said = [k for k, v in given.items() if v is not None]
    if len(said) != 1:
        raise BundleError("config", f"{what}: exactly one of {', '.join(given)} is needed, not {', '.join(said) or 'none'}")
    return said[0]


def unique(what: str, names: typing.Iterable[str]) -> None:
    names = list(names)
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise BundleError("config", f"{what}: {', '.join(twice)} used twice")


def load(path: str) -> dict:
    """A configuration file, YAML if a YAML library is there, else JSON."""
    text = Path(path).read_text()
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def keyed(name: str):
    return dataclasses.field(default=None, metadata={"key": name})


Predicate = str | bool | int | float | list[Any]
Where = dict[str, Predicate]


@dataclass
class Fk:
    to: str
    via: Literal["reference", "membership"]
    where: Where | None = None
    member_field: str | None = None
    property: str | None = None
    path: list[str] | None = None
    target_key: Surface | None = None
    as_of: str | None = None
    member_path: list[str] | None = None

    def __post_init__(self):
        if self.via == "reference":
            if any(getattr(self, n) is not None for n in ("where", "member_field", "property", "as_of", "member_path")):
                raise BundleError("config", "an edge by reference takes no membership fields")
        elif self.path is not None:
            raise BundleError("config", "an edge by membership takes no path")
        if (self.as_of is None) != (self.member_path is None):
            raise BundleError("config", "as_of and member_path belong together")


@dataclass
class Ordinal:
    partition_by: str
    order_by: str


@dataclass
class ValueMap:
    map: dict[Any, Any]
    source: str = dataclasses.field(default="", metadata={"key": "from"})


@dataclass
class Timestamp:
    source: str


@dataclass
class Elapsed:
    correlate_on: str
    other_where: Where
    start_source: str
    end_source: str
    unit: Literal["seconds", "minutes", "hours"]


@dataclass
class Derived:
    ordinal: Ordinal | None = None
    value_map: ValueMap | None = None
    timestamp: Timestamp | None = None
    scd_window: Literal["valid_from", "valid_to"] | None = None
    elapsed: Elapsed | None = None

    def __post_init__(self):
        self.mode = one_of("derived", ordinal=self.ordinal, value_map=self.value_map, timestamp=self.timestamp, scd_window=self.scd_window, elapsed=self.elapsed)


@dataclass
class Lookup:
    property: str
    to: str | None = None
    path: list[str] | None = None

    def __post_init__(self):
        if self.path is not None and self.to is None:
            raise BundleError("config", "a lookup's path needs its to")


@dataclass
class OutColumn:
    name: str
    source: str | None = keyed("from")
    fk: Fk | None = None
    correlation: str | None = None
    derived: Derived | None = None
    null: Literal[True] | None = None
    lookup: Lookup | None = None

    def __post_init__(self):
        self.mode = one_of(f"column {self.name}", source=self.source, fk=self.fk, correlation=self.correlation, derived=self.derived, null=self.null, lookup=self.lookup)


@dataclass
class Grain:
    grain: Literal["records", "history_point", "history_interval", "membership"]
    kind: str
    property: str | None = None
    value: Predicate | None = None
    where: Where | None = None
    filter: Where | None = None

    def __post_init__(self):
        if (self.property is None) == (self.grain != "records"):
            raise BundleError("config", f"grain {self.grain}: property is {'needed' if self.property is None else 'not used'}")
        for name, grains in (("filter", ("records",)), ("value", ("history_point", "history_interval")), ("where", ("membership",))):
            if getattr(self, name) is not None and self.grain not in grains:
                raise BundleError("config", f"grain {self.grain} takes no {name}")


@dataclass
class OutTable:
    name: str
    role: Literal["dim", "fact"]
    source: Grain
    key: list[str]
    columns: list[OutColumn]
    scd: Literal["type1", "type2"] | None = None

    def __post_init__(self):
        unique(f"columns of {self.name}", (c.name for c in self.columns))
        if (self.scd is None) != (self.role == "fact"):
            raise BundleError("config", f"{self.name}: scd belongs to dims, and every dim needs it")
        if self.role == "dim" and self.source.grain != "records":
            raise BundleError("config", f"{self.name}: a dim has the grain records")


@dataclass
class Exclude:
    kinds: list[str] = dataclasses.field(default_factory=list)
    tables: list[str] = dataclasses.field(default_factory=list)


@dataclass
class Dimensional:
    tables: list[OutTable]
    exclude: Exclude | None = None

    def __post_init__(self):
        unique("tables", (t.name for t in self.tables))


@dataclass
class MembershipRef:
    kind: str
    property: str


@dataclass
class SourceTable:
    name: str
    kind: str | None = None
    sub_types: list[str] | None = None
    membership: MembershipRef | None = None
    columns: list[str] | None = None
    rename: dict[str, str] | None = None
    where: Where | None = None

    def __post_init__(self):
        one_of(f"source table {self.name}", kind=self.kind, membership=self.membership)


@dataclass
class EventSource:
    kind: str | None = None
    sub_types: list[str] | None = None
    membership: MembershipRef | None = None
    only: list[str] | None = None
    ignore: list[str] | None = None
    item_type: str | None = None
    rename: dict[str, str] | None = None
    where: Where | None = None

    def __post_init__(self):
        one_of("event source", kind=self.kind, membership=self.membership)
        if self.only is not None and self.ignore is not None:
            raise BundleError("config", "an event source takes only or ignore, not both")


@dataclass
class EventLog:
    name: str
    sources: list[EventSource]


@dataclass
class Source:
    tables: list[SourceTable] = dataclasses.field(default_factory=list)
    events: EventLog | None = None
    declare_keys: bool = False
    kind_labels: dict[str, str] = dataclasses.field(default_factory=dict)

    def __post_init__(self):
        if not self.tables and self.events is None:
            raise BundleError("config", "source declares no output")
        unique("tables", [t.name for t in self.tables] + ([self.events.name] if self.events else []))


@dataclass
class Rename:
    table: str
    sub_type: str | None = None
    name: str | None = None
    columns: dict[str, str] = dataclasses.field(default_factory=dict)


@dataclass
class Base:
    exclude: Exclude | None = None
    rename: list[Rename] = dataclasses.field(default_factory=list)
    slice_at: int | None = None
    declare_keys: bool = False

    def __post_init__(self):
        if self.slice_at is not None and self.slice_at < 0:
            raise BundleError("config", "slice_at is not negative")
        if any(r.sub_type is not None for r in self.rename):
            raise BundleError("config", "a flat export splits no kind, so a rename names no sub-type")
        unique("renames", (r.table for r in self.rename))


@dataclass
class Rebase:
    base_date: datetime | None = None
    timezone: str | None = None


@dataclass
class Incremental:
    period: Literal["day", "week", "month"] | None = None
    sim_period_ns: int | None = None

    def __post_init__(self):
        one_of("incremental", period=self.period, sim_period_ns=self.sim_period_ns)
        if self.sim_period_ns is not None and self.sim_period_ns <= 0:
            raise BundleError("config", "sim_period_ns must be positive")


Keys = dict[str, Surface | dict[str, Surface]]


@dataclass
class Export:
    mode: Literal["dimensional", "source", "base"]
    rebase: Rebase | None = None
    incremental: Incremental | None = None
    dimensional: Dimensional | None = None
    source: Source | None = None
    base: Base | None = None
    keys: Keys | None = None

    def __post_init__(self):
        if self.mode == "base" and self.base is None:
            self.base = Base()
        for name in ("dimensional", "source", "base"):
            if (getattr(self, name) is not None) != (name == self.mode):
                raise BundleError("config", f"mode {self.mode} takes the section {self.mode} and no other")
        if self.base and self.base.slice_at is not None and self.incremental:
            raise BundleError("config", "slice_at and incremental exclude each other")


@dataclass
class Stream:
    name: str
    kind: str | None = None
    sub_types: list[str] | None = None
    properties: list[str] | None = None
    membership: MembershipRef | None = None
    fields: list[str] | None = None

    def __post_init__(self):
        if one_of(f"stream {self.name}", kind=self.kind, membership=self.membership) == "kind":
            one_of(f"stream {self.name}", properties=self.properties)
        else:
            one_of(f"stream {self.name}", fields=self.fields)


@dataclass
class SourceIdentity:
    connector: str
    name: str
    db: str
    schema: str
    version: str


@dataclass
class Debezium:
    source: SourceIdentity
    table_identity: Literal["source_table", "topic"] = "source_table"
    schemas_enable: bool = True


@dataclass
class Clock:
    mode: Literal["fast", "realtime"]
    speed: float | None = None
    idle_cap_seconds: float | None = None

    def __post_init__(self):
        if any(x is not None and x <= 0 for x in (self.speed, self.idle_cap_seconds)):
            raise BundleError("config", "speed and idle_cap_seconds must be positive")


@dataclass
class Kafka:
    bootstrap_servers: str


@dataclass
class Streams:
    content: Literal["state-changes", "membership-events"]
    streams: list[Stream]
    keys: Keys | None = None
    rebase: Rebase | None = None
    debezium: Debezium | None = None
    clock: Clock | None = None
    kafka: Kafka | None = None

    def __post_init__(self):
        unique("streams", (s.name for s in self.streams))
        for s in self.streams:
            if (s.kind is not None) != (self.content == "state-changes"):
                raise BundleError("config", f"stream {s.name} doesn't fit the content {self.content}")


def export(raw: dict) -> Export:
    return build(Export, raw)


def streams(raw: dict) -> Streams:
    return build(Streams, raw)
