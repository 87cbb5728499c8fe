"""Which identity a kind's records show outside: record_id, record_index or presentation_id, per population."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.plans.config import Keys
from tidelog.sources.bundle import Bundle, BundleError, Sidecar


#: The classes of keys that are a prefix and a number.
NUMBERED = {"counter", "record_index"}


@dataclass(frozen=True)
class Election:
    """kind -> {population: surface}; the population of a flat kind is None."""

    chosen: dict[str, dict[str | None, str]]

    def surfaces(self, kind: str, populations: list[str] | None = None) -> set[str]:
        own = self.chosen.get(kind, {})
        return {own.get(p, "record_id") for p in (populations if populations is not None else own)} or {"record_id"}

    def surface(self, kind: str, populations: list[str] | None = None) -> str:
        found = self.surfaces(kind, populations)
        if len(found) != 1:
            raise BundleError("election", f"{kind}: one table shows one identity, not {', '.join(sorted(found))}")
        return found.pop()


def elect(sidecar: Sidecar, keys: Keys | None) -> Election:
    """Check the choice against the sidecar's domains and claims; what isn't mentioned shows record_id."""
    chosen: dict[str, dict[str | None, str]] = {}
    for kind in sidecar.kinds():
        domain = sidecar.domain(kind)
        said = (keys or {}).get(kind, "record_id")
        if isinstance(said, dict):
            if not domain:
                raise BundleError("election", f"{kind} has no sub-types to choose for")
            if unknown := set(said) - set(domain):
                raise BundleError("election", f"{kind} has no sub-type {', '.join(sorted(unknown))}")
        chosen[kind] = {p: said.get(p, "record_id") if isinstance(said, dict) else said for p in (domain or [None])}
        for p, surface in chosen[kind].items():
            if surface == "presentation_id" and not claim(sidecar, kind, p):
                raise BundleError("election", f"{kind}{f'.{p}' if p else ''}: the sidecar claims no presentation key")
    if unknown := set(keys or {}) - set(chosen):
        raise BundleError("election", f"unknown kind {', '.join(sorted(unknown))}")
    return Election(chosen)


def claim(sidecar: Sidecar, kind: str, population: str | None) -> dict | None:
    """What the sidecar claims of the presentation key of a population."""
    entry = sidecar.optional.get("presentation_keys", {}).get(kind)
    if entry is None or sidecar.records(kind).column("presentation_id") is None:
        return None
    return entry.get(population) if population and population in entry else entry if "key_space" in entry else None


def space(sidecar: Sidecar, kind: str, population: str | None, surface: str) -> dict:
    """The key space of a surface: its class, prefix and width."""
    if surface == "presentation_id":
        return claim(sidecar, kind, population)["key_space"]
    return {"class": surface, "prefix": "", "width": 0}


def union_safe(a: dict, b: dict) -> bool:
    """Whether keys of two spaces of one kind can stand in one column without one meaning two records.

    Ids and uuids meet their own class safely, and so do indexes rendered alike,
    as a kind counts its records once. Rendered numbers of two counts never
    meet only if no prefix is the other one followed by nothing but digits.
    Any other pair could meet.
    """
    kinds = {a["class"], b["class"]}
    if kinds in ({"record_id"}, {"uuid"}):
        return True
    if not kinds <= NUMBERED:
        return False
    p, q = sorted((a.get("prefix") or "", b.get("prefix") or ""), key=len)
    if kinds == {"record_index"} and p == q and (a.get("width") or 0) == (b.get("width") or 0):
        return True
    rest = q.removeprefix(p)
    return not q.startswith(p) or not (rest == "" or rest.isdigit())


def require_safe_edge(sidecar: Sidecar, election: Election, kind: str) -> None:
    spaces = [space(sidecar, kind, p, s) for p, s in election.chosen[kind].items()]
    if any(not union_safe(a, b) for i, a in enumerate(spaces) for b in spaces[:i]):
        raise BundleError("election", f"references to {kind} would mix key spaces that can collide")


def identities(bundle: Bundle, election: Election, kind: str, name: str = "_shown", horizon: int | None = None) -> DataFrame:
    """record_id and the shown identity of every record of a kind that was created before the horizon; text if its populations show different ones."""
    side = bundle.sidecar
    own = election.chosen[kind]
    surfaces = set(own.values())
    rows = bundle.records(kind)
    if horizon is not None:
        rows = rows.where(F.col("created_sim_time") < horizon)
    if len(surfaces) == 1:
        shown: Column = F.col(surfaces.pop())
    else:
        require_safe_edge(side, election, kind)
        shown = F.lit(None).cast("string")
        for p, s in own.items():
            shown = F.when(F.col(side.discriminator(kind)) == p, F.col(s).cast("string")).otherwise(shown)
    return rows.select("record_id", shown.alias(name)).distinct()


def translate(frame: DataFrame, bundle: Bundle, election: Election, kind: str, column: str, out: str | None = None, horizon: int | None = None) -> DataFrame:
    """frame with the record ids of ``column`` shown as the kind's elected identity; unresolved ids become null, and so do those of records not created before the horizon.

    Where record_id is elected nothing is joined.
    """
    out = out or column
    if election.surfaces(kind) == {"record_id"}:
        return frame if out == column else frame.withColumn(out, F.col(column))
    shown = identities(bundle, election, kind, "_to", horizon).withColumnRenamed("record_id", "_from")
    joined = frame.join(shown, frame[column] == shown["_from"], "left").drop("_from")
    return joined.withColumn(out, F.col("_to")).drop("_to")


def key_counts(bundle: Bundle, election: Election, kind: str) -> DataFrame:
    """One row: pairs of record and shown identity, different records, different identities, and records without one."""
    return identities(bundle, election, kind).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("record_id").alias("ids"), F.countDistinct("_shown").alias("shown"), F.count_if(F.col("_shown").isNull()).alias("nulls"))


def guard(bundle: Bundle, election: Election, kinds: set[str]) -> None:
    """Refuse if an elected identity other than record_id does not name each record once. One aggregate per kind."""
    for kind in sorted(kinds):
        if election.surfaces(kind) == {"record_id"}:
            continue
        n, ids, shown, nulls = key_counts(bundle, election, kind).first()
        if nulls or not n == ids == shown:
            raise BundleError("election", f"{kind}: the elected identity is no key ({n} pairs, {ids} records, {shown} identities, {nulls} nulls)")
