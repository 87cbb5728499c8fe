"""A bundle as something to play: events of a range, the state at a moment, and exports of either."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators import temporal
from tidelog.plans.common import Anchor, Planned, Window, resolve_anchor
from tidelog.plans.config import Export, MembershipRef, Stream
from tidelog.plans.incremental import export_tables
from tidelog.plans.source import populations
from tidelog.sources.bundle import Bundle, BundleError
from tidelog.streaming import events as ev


@dataclass
class Atom:
    """What is played of one kind (sub-types, properties) or one membership (fields); None means all."""

    kind: str
    membership: str | None = None
    sub_types: list[str] | None = None
    properties: list[str] | None = None


@dataclass
class Playback:
    bundle: Bundle
    atoms: list[Atom]
    anchor: Anchor | None = None
    _events: DataFrame | None = field(default=None, repr=False)

    def __post_init__(self):
        if not self.atoms:
            raise BundleError("playback", "nothing is selected")
        names = [self.name(a) for a in self.atoms]
        if len(set(names)) < len(names):
            raise BundleError("playback", "an atom is selected twice")
        side = self.bundle.sidecar
        for a in self.atoms:
            if a.membership is None:
                populations(self.bundle, a.kind, a.sub_types)
                for p in a.properties or []:
                    if side.records(a.kind).column(f"prop__{p}") is None or side.slice_only(a.kind, f"prop__{p}"):
                        raise BundleError("playback", f"{a.kind}.{p} can't be played")
            else:
                side.membership(a.kind, a.membership)
        self.anchor = self.anchor or resolve_anchor(side)

    @staticmethod
    def name(a: Atom) -> str:
        return f"{a.kind}.{a.membership}" if a.membership else a.kind if a.sub_types is None else f"{a.kind}.{'-'.join(a.sub_types)}"

    def properties(self, a: Atom) -> list[str]:
        side = self.bundle.sidecar
        return a.properties if a.properties is not None else [p for p in side.records(a.kind).properties() if not side.slice_only(a.kind, f"prop__{p}")]

    def tape(self) -> DataFrame:
        """All events with seq counted from the tape's beginning, made once."""
        if self._events is None:
            made, side = None, self.bundle.sidecar
            for a in self.atoms:
                if a.membership is None:
                    stream = Stream(self.name(a), a.kind, a.sub_types, self.properties(a))
                    one = ev._state_stream(self.bundle, stream, ev.elect(side, None))
                else:
                    table = side.membership(a.kind, a.membership)
                    fields = a.properties if a.properties is not None else [c.name[6:] for c in table.columns if c.role == "element"] + table.member_fields()
                    stream = Stream(self.name(a), membership=MembershipRef(a.kind, a.membership), fields=fields)
                    one = ev._member_stream(self.bundle, stream, ev.elect(side, None))
                made = one if made is None else made.unionByName(one)
            self._events = ev.kernels.dense_sequence(made, ["sim_time", "op_class", "topic", "record_id", "after"], "seq").select(*ev.COLUMNS)
        return self._events

    def events(self, start: int, end: int) -> DataFrame:
        """Events of [start, end) in the order of seq."""
        if start < 0 or end < start:
            raise BundleError("playback", f"[{start}, {end}) is no range")
        made = self.tape().where((F.col("sim_time") >= start) & (F.col("sim_time") < end))
        return made.withColumn("ts", ev.timestamp(self.anchor))

    def snapshot(self, moment: int) -> dict[str, DataFrame]:
        """Per atom the records (or open intervals) as they are at the moment, its own events included."""
        if moment < 0:
            raise BundleError("playback", "a moment is not negative")
        out = {}
        for a in self.atoms:
            if a.membership is not None:
                out[self.name(a)] = temporal.membership_state_at(self.bundle, a.kind, a.membership, moment + 1)
                continue
            rows = temporal.state_at(self.bundle, a.kind, self.properties(a), moment + 1)
            selected = populations(self.bundle, a.kind, a.sub_types)
            if a.sub_types is not None:
                kept = self.bundle.records(a.kind).where(F.col(self.bundle.sidecar.discriminator(a.kind)).isin(selected)).select("record_id")
                rows = rows.join(kept, "record_id", "left_semi")
            out[self.name(a)] = rows
        return out

    def stamped(self, a: Atom, rows: DataFrame) -> DataFrame:
        """rows of a snapshot with their record's sub-type and, beside each sim-time column, its wall-clock time."""
        side = self.bundle.sidecar
        name = side.discriminator(a.kind)
        if name:
            leaf = self.bundle.records(a.kind).select(F.col("record_id").alias("_rid"), F.col(name).alias("owner_sub_type" if a.membership else "sub_type"))
            rows = rows.join(leaf, rows["record_id"] == leaf["_rid"], "left").drop("_rid")
        times = [c for c in rows.columns if c.endswith("_sim_time") or c == "deactivated_at"]
        return rows.withColumns({f"{c}_ts": self.anchor.column(c) if self.anchor else F.lit(None).cast("timestamp_ntz") for c in times})

    def seek(self, moment: int) -> tuple[dict[str, DataFrame], DataFrame]:
        """The state at the moment and the events after it."""
        last = self.bundle.sidecar.slice_at
        return self.snapshot(moment), self.events(moment + 1, 2**63 - 1 if last is None else max(moment + 1, last + 1))

    def shaped(self, export: Export, start: int, end: int) -> list[Planned]:
        """The rows an export has for [start, end)."""
        return export_tables(self.bundle, export, None, Window(None, start, end, f"r{start}_{end}"))

    def tables(self, export: Export) -> list[dict]:
        """What an export's windows hold: name, columns and mode of each table, with the view over it if it has one."""
        planned = export_tables(self.bundle, export, None, Window(None, 0, 1, "r0_1"))
        return [{"name": t.name, "columns": t.frame.columns, "mode": t.mode, "view": t.view_name} for t in planned]

    def shaped_state(self, export: Export, moment: int) -> list[Planned]:
        """A whole export of the tape as it was at the moment."""
        return export_tables(temporal.truncated(self.bundle, moment), export)


