"""Candidate configurations from a sidecar: complete, valid, and to be cut down by their author."""

from __future__ import annotations

from tidelog.plans.election import claim
from tidelog.sources.bundle import Bundle, BundleError, Sidecar


def _shown(side: Sidecar, kind: str, sub_type: str | None = None) -> list[str]:
    """Properties of a kind whose past can be known; of a sub-type only those it declares."""
    own = side.optional.get("sub_type_columns", {}).get(kind, {}).get(sub_type) if sub_type else None
    return [p for p in side.records(kind).properties() if not side.slice_only(kind, f"prop__{p}") and (own is None or f"prop__{p}" in own or f"prop__{p}" == side.discriminator(kind))]


def keys(side: Sidecar) -> dict:
    """Presentation keys for the populations that claim them."""
    out = {}
    for kind in side.kinds():
        domain = side.domain(kind)
        if domain:
            said = {p: "presentation_id" for p in domain if claim(side, kind, p)}
            if said:
                out[kind] = said
        elif claim(side, kind, None):
            out[kind] = "presentation_id"
    return out


def dimensional(side: Sidecar) -> dict:
    """A dim per kind (type 2 if it has tracked properties, one per sub-type of a split kind), a fact per membership."""
    roles, tables = side.optional.get("record_roles", {}), []
    for kind in side.kinds():
        role = roles.get(kind, "dimension")
        for sub in side.domain(kind) or [None]:
            fact = (role.get(sub) if isinstance(role, dict) else role) == "fact"
            name = f"{'fact' if fact else 'dim'}_{sub or kind}"
            tracked = bool(side.tracked(kind)) and not fact
            columns = [{"name": f"{kind}_id", "from": "record_id"}, *({"name": p, "from": f"prop__{p}"} for p in _shown(side, kind, sub))]
            if tracked:
                columns += [{"name": w, "derived": {"scd_window": w}} for w in ("valid_from", "valid_to")]
            table = {"name": name, "role": "fact" if fact else "dim", "source": {"grain": "records", "kind": kind}, "key": [f"{kind}_id", *(["valid_from"] if tracked else [])], "columns": columns}
            if sub:
                table["source"]["filter"] = {side.discriminator(kind): sub}
            if not fact:
                table["scd"] = "type2" if tracked else "type1"
            tables.append(table)
    for t in side.tables:
        if t.category == "membership":
            names = [c.name for c in t.columns if c.role in ("lifecycle", "element", "member")]
            tables.append({"name": f"fact_{t.record_kind}_{t.property}", "role": "fact", "source": {"grain": "membership", "kind": t.record_kind, "property": t.property}, "key": [f"{t.record_kind}_id", "joined_sim_time"], "columns": [{"name": f"{t.record_kind}_id", "from": "record_id"}, *({"name": n, "from": n} for n in names)]})
    return {"mode": "dimensional", "dimensional": {"tables": tables}}


def source(side: Sidecar) -> dict:
    tables = [{"name": k, "kind": k} for k in side.kinds()]
    tables += [{"name": f"{t.record_kind}_{t.property}", "membership": {"kind": t.record_kind, "property": t.property}} for t in side.tables if t.category == "membership"]
    tracked = [{"kind": k} for k in side.kinds() if side.tracked(k)]
    out = {"mode": "source", "source": {"tables": tables}}
    if tracked:
        out["source"]["events"] = {"name": "versions", "sources": tracked}
    return out | ({"keys": k} if (k := keys(side)) else {})


def streaming(side: Sidecar) -> dict:
    streams, taken = [], set()
    for kind in side.kinds():
        for sub in side.domain(kind) or [None]:
            name = sub or kind
            if name not in taken:
                taken.add(name)
                streams.append({"name": name, "kind": kind, **({"sub_types": [sub]} if sub else {}), "properties": _shown(side, kind, sub)})
    if not streams:
        raise BundleError("init", "a bundle without records has nothing to stream")
    return {"content": "state-changes", "streams": streams} | ({"keys": k} if (k := keys(side)) else {})


def propose(bundle: Bundle, mode: str) -> dict:
    return {"dimensional": dimensional, "source": source, "streaming": streaming}[mode](bundle.sidecar)


def versions_per_record(bundle: Bundle, kind: str):
    """How many versions each tracked property has per record: many mean an operational state rather than a slow attribute."""
    from pyspark.sql import functions as F

    n = bundle.history(kind).groupBy("kind", "property").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("record_id").alias("records"))
    return n.withColumn("versions_per_record", F.col("rows") / F.col("records"))
