"""What all export modes share: planned tables, notices, the time anchor and windows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, is_dataclass
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators import kernels
from tidelog.operators.temporal import anchored
from tidelog.plans.config import Export, Rebase
from tidelog.sources.bundle import BundleError, Sidecar

#: Names that the bookkeeping of windows needs.
RESERVED = ("_export_meta", "_export_windows")
RESERVED_COLUMNS = ("__valid_from_ns",)


def reserved(name: str) -> bool:
    return name in RESERVED or name.endswith("__rows")


@dataclass(frozen=True)
class VersionView:
    """A view over appended version rows that supplies the ends: the next start of the same identity."""

    identity: tuple[str, ...]
    start: str
    ends: tuple[str, ...]
    order: tuple[str, ...]

    def __call__(self, rows: DataFrame) -> DataFrame:
        following = kernels.along_groups(rows, list(self.identity), ["__valid_from_ns"], "__valid_from_ns", leads={"_following": self.start})
        return following.withColumns({e: F.col("_following") for e in self.ends}).select(*self.order)

    def sql(self, table: str) -> str:
        """The view as a SELECT over the table of its rows."""
        q = lambda n: '"' + n.replace('"', '""') + '"'
        end = f"lead({q(self.start)}) OVER (PARTITION BY {', '.join(map(q, self.identity))} ORDER BY {q('__valid_from_ns')})"
        return f"SELECT {', '.join(f'{end} AS {q(c)}' if c in self.ends else q(c) for c in self.order)} FROM {q(table)}"


@dataclass
class Planned:
    """One output table: a lazy frame, or a function that makes it when it is first asked for, and how it is written."""

    name: str
    source: DataFrame | Callable[[], DataFrame]
    mode: str = "replace"
    primary: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    view: VersionView | None = None
    view_name: str | None = None
    #: The columns a delivery is sorted by; all, in their order, if none are named.
    order: list[str] = field(default_factory=list)

    @property
    def deferred(self) -> bool:
        return callable(self.source)

    @property
    def frame(self) -> DataFrame:
        if self.deferred:
            self.source = self.source()
        return self.source

    def sorted(self) -> DataFrame:
        """The rows in the order of a delivery, nulls first, so equal runs give equal files."""
        names = dict.fromkeys([*self.order, *self.frame.columns])
        return self.frame.orderBy(*(F.col(c).asc_nulls_first() for c in names))


@dataclass(frozen=True)
class Notice:
    code: str
    message: str


Sink = Callable[[Notice], None]


@dataclass(frozen=True)
class Anchor:
    """Where sim time 0 is on the clock: a UTC instant (text) and the zone times are shown in."""

    origin: str
    zone: str

    def column(self, ns: str | Column) -> Column:
        return anchored(ns, self.origin, self.zone)

    def epoch_us(self) -> int:
        return int(datetime.fromisoformat(self.origin).replace(tzinfo=UTC).timestamp()) * 1_000_000 + datetime.fromisoformat(self.origin).microsecond


def localise(moment: datetime, zone: str) -> datetime:
    """A wall-clock moment as UTC; one that does not exist or exists twice in the zone is refused."""
    try:
        tz = ZoneInfo(zone)
    except (ZoneInfoNotFoundError, ValueError) as x:
        raise BundleError("anchor", f"no zone {zone}") from x
    if moment.tzinfo is not None:
        return moment.astimezone(UTC)
    first, second = (moment.replace(tzinfo=tz, fold=f).astimezone(UTC) for f in (0, 1))
    if first.astimezone(tz).replace(tzinfo=None) != moment:
        raise BundleError("anchor", f"{moment} does not exist in {zone}")
    if first != second:
        raise BundleError("anchor", f"{moment} exists twice in {zone}")
    return first


def resolve_anchor(sidecar: Sidecar, rebase: Rebase | None = None, base_date: datetime | None = None, zone: str | None = None) -> Anchor | None:
    """Per knob the argument, then the configuration, then the sidecar; None if there is no origin at all."""
    runtime = sidecar.runtime or {}
    zone = zone or (rebase and rebase.timezone) or runtime.get("timezone") or "UTC"
    start = base_date or (rebase and rebase.base_date) or runtime.get("start_datetime")
    if start is None:
        return None
    start = datetime.fromisoformat(start) if isinstance(start, str) else start
    return Anchor(localise(start, zone).replace(tzinfo=None).isoformat(" "), zone)


@dataclass(frozen=True)
class Window:
    """Half-open in sim time."""

    index: int | None
    start: int
    end: int
    label: str

    def holds(self, column: str) -> Column:
        return (F.col(column) >= self.start) & (F.col(column) < self.end)


def window(index: int, config, anchor: Anchor | None) -> Window:
    """The index-th window: a span of sim time, or a civil day, week or month in the anchor's zone."""
    if config.sim_period_ns is not None:
        if anchor is not None:
            raise BundleError("incremental", "with a time origin the windows are civil periods, not spans of sim time")
        a = index * config.sim_period_ns
        return Window(index, a, a + config.sim_period_ns, f"w{index:05d}_ns{a}")
    if anchor is None:
        raise BundleError("incremental", "civil periods need an anchor")
    tz = ZoneInfo(anchor.zone)
    origin = datetime.fromisoformat(anchor.origin).replace(tzinfo=UTC)
    local = origin.astimezone(tz).replace(tzinfo=None)
    first = local.replace(hour=0, minute=0, second=0, microsecond=0)
    if config.period == "week":
        first -= timedelta(days=first.weekday())
    elif config.period == "month":
        first = first.replace(day=1)

    def border(i: int) -> datetime:
        if config.period == "month":
            m = first.year * 12 + first.month - 1 + i
            return datetime(m // 12, m % 12 + 1, 1)
        return first + timedelta(days=(7 if config.period == "week" else 1) * i)

    def ns(moment: datetime) -> int:
        delta = moment.replace(tzinfo=tz).astimezone(UTC) - origin
        return (delta.days * 86_400_000_000 + delta.seconds * 1_000_000 + delta.microseconds) * 1000

    a, b = border(index), border(index + 1)
    return Window(index, max(0, ns(a)), ns(b), f"w{index:05d}_{max(a, local):%Y-%m-%d}")


def civil_range(start: str, end: str, anchor: Anchor | None) -> Window:
    """[start, end) as given by hand: with a time origin civil times in its zone (a date alone is midnight), else whole ns of sim time.

    Times that the zone skips or has twice are refused. A time before the
    origin is a negative one and selects nothing.
    """
    if anchor is None:
        try:
            a, b = int(start), int(end)
        except ValueError as x:
            raise BundleError("range", f"{start} to {end}: without a time origin a range is in whole ns") from x
        label = f"r_ns{a}_ns{b}"
    else:
        try:
            moments = [datetime.fromisoformat(t.strip()) for t in (start, end)]
        except ValueError as x:
            raise BundleError("range", f"{start} to {end}: {x}") from x
        if any(m.tzinfo for m in moments):
            raise BundleError("range", f"{start} to {end}: times are in the zone {anchor.zone} and name none")
        origin = datetime.fromisoformat(anchor.origin).replace(tzinfo=UTC)
        a, b = ((localise(m, anchor.zone) - origin) // timedelta(microseconds=1) * 1000 for m in moments)
        label = "r_" + "_".join(f"{m:%Y-%m-%d}" if not (m.hour or m.minute or m.second or m.microsecond) else f"{m:%Y-%m-%dT%H%M%S}" for m in moments)
    if a >= b:
        raise BundleError("range", f"{start} is not before {end}")
    return Window(None, a, b, label)


def fingerprint(export: Export, anchor: Anchor | None, sidecar: Sidecar, fmt: str) -> str:
    """Equal only for runs that would make the same tables from the same dataset."""
    facts = {"config": plain(export), "anchor": plain(anchor), "sidecar": sidecar.raw(), "format": fmt, "version": 1}
    return hashlib.sha256(json.dumps(facts, sort_keys=True, default=str).encode()).hexdigest()


def plain(x):
    return asdict(x) if is_dataclass(x) and not isinstance(x, type) else x


def require_unique(frame: DataFrame, keys: list[str], what: str) -> None:
    """Refuse a table whose key has nulls or repeats; one aggregate job, only a count reaches the driver."""
    bad = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(" or ".join(["_n > 1", *(f"`{k}` is null" for k in keys)])).limit(1)
    if bad.count():
        raise BundleError("keys", f"{what}: {', '.join(keys)} is no key")
