"""The application database behind a dataset: state tables, junction tables and one audit log."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators import kernels, temporal
from tidelog.plans.common import Anchor, Notice, Planned, Sink, Window, reserved
from tidelog.plans.config import EventLog, EventSource, Export, SourceTable
from tidelog.plans.election import Election, claim, elect, guard, identities, translate
from tidelog.sources.bundle import Bundle, BundleError, filtered, spark_type

EVENTS = {"c": "create", "u": "update", "d": "destroy"}


def populations(bundle: Bundle, kind: str, sub_types: list[str] | None) -> list[str] | None:
    domain = bundle.sidecar.domain(kind)
    if sub_types is None:
        return domain
    if not domain:
        raise BundleError("population", f"{kind} has no sub-types")
    if unknown := set(sub_types) - set(domain):
        raise BundleError("population", f"{kind} has no sub-type {', '.join(sorted(unknown))}")
    return sub_types


def chosen_records(bundle: Bundle, kind: str, sub_types: list[str] | None, where: dict | None) -> DataFrame | None:
    """record_id of the selected records; None if all are. Rows are selected by constant properties only."""
    side, spine = bundle.sidecar, None
    selected = populations(bundle, kind, sub_types)
    for name in where or {}:
        c = side.records(kind).column(name)
        if c is None or c.role != "payload" or c.temporal_class != "constant":
            raise BundleError("where", f"{kind}.{name} is no constant property")
    if where:
        spine = bundle.records(kind, where)
    if selected is not None and set(selected) != set(side.domain(kind)):
        spine = (spine if spine is not None else bundle.records(kind)).where(F.col(side.discriminator(kind)).isin(selected))
    return None if spine is None else spine.select("record_id")


def plan(bundle: Bundle, export: Export, anchor: Anchor | None, window: Window | None = None, notices: Sink = lambda n: None) -> list[Planned]:
    if anchor is None:
        raise BundleError("anchor", "a source export needs a time origin")
    config = export.source
    election = elect(bundle.sidecar, export.keys)
    guard(bundle, election, set(bundle.sidecar.kinds()))
    out = [state_table(bundle, t, election, anchor, window, config.declare_keys, notices) if t.kind else junction(bundle, t, election, anchor, window, config.kind_labels) for t in config.tables]
    if config.events:
        for s in config.events.sources:
            for p in bundle.sidecar.records(s.kind).properties() if s.kind else []:
                if bundle.sidecar.slice_only(s.kind, f"prop__{p}"):
                    notices(Notice("slice-only-column-omitted", f"{config.events.name}: {s.kind}.{p}"))
        out.append(event_log(bundle, config.events, election, anchor, window, config.kind_labels, config.declare_keys))
    for t in out:
        if reserved(t.name):
            raise BundleError("reserved", t.name)
        if not t.deferred and len(set(t.frame.columns)) < len(t.frame.columns):
            raise BundleError("naming", f"{t.name}: two columns of one name")
    return out


def renamed(decl: SourceTable, names: dict[str, str]) -> dict[str, str]:
    """Contract name to output name of the shown columns; identity always, others if listed."""
    if decl.columns is not None:
        if unknown := [c for c in decl.columns if c not in names]:
            raise BundleError("column", f"{decl.name}: no column {', '.join(unknown)}")
        names = {k: v for i, (k, v) in enumerate(names.items()) if i == 0 or k in decl.columns}
    if unknown := [c for c in decl.rename or {} if c not in names]:
        raise BundleError("rename", f"{decl.name}: no column {', '.join(unknown)}")
    return {k: (decl.rename or {}).get(k, v) for k, v in names.items()}


def state_table(bundle: Bundle, decl: SourceTable, election: Election, anchor: Anchor, window: Window | None, keys: bool, notices: Sink) -> Planned:
    """One current row per record with its lifecycle; in a window the state at its end, without updated_at."""
    side, kind = bundle.sidecar, decl.kind
    table = side.records(kind)
    spine = chosen_records(bundle, kind, decl.sub_types, decl.where)
    props = []
    for p in table.properties():
        if side.slice_only(kind, f"prop__{p}"):
            notices(Notice("slice-only-column-omitted", f"{table.name}.prop__{p}"))
        elif f"prop__{p}" != side.discriminator(kind) or len(populations(bundle, kind, decl.sub_types)) > 1 or f"prop__{p}" in (decl.columns or []):
            props.append(p)
    rows = temporal.state_at(bundle, kind, props, window.end if window else None)
    if spine is not None:
        rows = rows.join(spine, "record_id", "left_semi")
    rows = translate(rows, bundle, election, kind, "record_id", "_id")
    names = {"record_id": "id", "created_sim_time": "created_at", "active": "active", "deactivated_at": "deactivated_at", "last_mutation_sim_time": "updated_at", **{f"prop__{p}": p for p in props}}
    if window:
        del names["last_mutation_sim_time"]
    for p in props:
        target = table.column(f"prop__{p}").references
        if target and side.has(f"records__{target}"):
            rows = translate(rows, bundle, election, target, f"prop__{p}", horizon=window.end if window else None)
    final = renamed(decl, names)
    columns = [(F.col("_id") if c == "record_id" else anchor.column(c) if c.endswith(("_sim_time", "_at")) else F.col(c)).alias(n) for c, n in final.items()]
    claimed = keys and claim(side, kind, None) and "presentation_id" in final
    return Planned(decl.name, rows.select(*columns), "replace", [final["record_id"]] if keys else [], [[final["presentation_id"]]] if claimed else [])


def labelled(value: Column, labels: dict[str, str]) -> Column:
    out = value
    for kind, label in labels.items():
        out = F.when(value == kind, label).otherwise(out)
    return out


def junction(bundle: Bundle, decl: SourceTable, election: Election, anchor: Anchor, window: Window | None, labels: dict[str, str]) -> Planned:
    """The intervals of a membership; in a window those that began or ended in it, with later ends hidden."""
    ref = decl.membership
    table = bundle.sidecar.membership(ref.kind, ref.property)
    rows = bundle.membership(ref.kind, ref.property, decl.where)
    if window:
        rows = rows.where(window.holds("joined_sim_time") | window.holds("left_sim_time")).withColumn("left_sim_time", F.when(F.col("left_sim_time") < window.end, F.col("left_sim_time")))
    rows = translate(rows, bundle, election, ref.kind, "record_id")
    names = {"record_id": f"{ref.kind}_id", "joined_sim_time": "joined_at", "left_sim_time": "left_at"}
    for c in table.columns:
        if c.role == "element":
            names[c.name] = c.name[6:]
        elif c.role == "member":
            names[c.name] = c.name[8:].replace("__", "_")
            if c.name.endswith("__id"):
                rows = member_identity(rows, bundle, election, c.name[:-4] + "__kind", c.name, window.end if window else None)
    final = renamed(decl, names)
    show = lambda c: labelled(F.col(c), labels) if c.endswith("__kind") and c.startswith("member__") else anchor.column(c) if c.endswith("_sim_time") else F.col(c)
    return Planned(decl.name, rows.select(*(show(c).alias(n) for c, n in final.items())), "append" if window else "replace")


def member_identity(rows: DataFrame, bundle: Bundle, election: Election, kind_column: str, id_column: str, horizon: int | None = None) -> DataFrame:
    """A member column in the identity its own kind shows; kinds are joined by (kind, id)."""
    others = [k for k in bundle.sidecar.kinds() if election.surfaces(k) != {"record_id"}]
    if not others:
        return rows
    edges = None
    for k in others:
        one = identities(bundle, election, k, "_to", horizon).select(F.lit(k).alias("_k"), F.col("record_id").alias("_from"), F.col("_to").cast("string"))
        edges = one if edges is None else edges.unionByName(one)
    joined = rows.join(edges, (rows[kind_column] == edges["_k"]) & (rows[id_column] == edges["_from"]), "left")
    return joined.withColumn(id_column, F.when(F.col(kind_column).isin(others), F.col("_to")).otherwise(F.col(id_column))).drop("_k", "_from", "_to")


def pair(key: str, old: Column, new: Column, always: Column) -> Column:
    """A changeset entry "key":[old,new]; null where nothing changed, unless ``always``. Values are JSON texts."""
    text = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))
    head = F.regexp_extract(F.to_json(F.array(F.lit(key))), r"(?s)^\[(.*)\]$", 1)
    return F.when(always | ~old.eqNullSafe(new), F.concat(head, F.lit(":["), text(old), F.lit(","), text(new), F.lit("]")))


def changeset(parts: list[Column]) -> Column:
    if not parts:
        return F.lit("{}")
    kept = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.concat(F.lit("{"), F.array_join(kept, ","), F.lit("}"))


def audited_properties(bundle: Bundle, s: EventSource) -> tuple[list[str], list[str]]:
    """The audited properties of a source of records and the keys they have in changesets; refused if one isn't there or two share a key."""
    side, kind = bundle.sidecar, s.kind
    candidates = [p for p in side.records(kind).properties() if not side.slice_only(kind, f"prop__{p}")]
    for p in (s.only or []) + (s.ignore or []) + list(s.rename or {}):
        if p not in candidates:
            raise BundleError("events", f"{kind} has no audited property {p}")
    audited = [p for p in candidates if (s.only is None or p in s.only) and p not in (s.ignore or [])]
    keys = [(s.rename or {}).get(p, p) for p in audited]
    if len(set(keys)) < len(keys):
        raise BundleError("events", f"{kind}: two properties under one name")
    return audited, keys


def record_arm(bundle: Bundle, s: EventSource, election: Election, labels: dict[str, str]) -> DataFrame:
    """item_type, item_id, event, sim_time, class and changes of one kind's events; updates that change no audited property are left out."""
    side, kind = bundle.sidecar, s.kind
    table = side.records(kind)
    audited, keys = audited_properties(bundle, s)
    scope = [p for p in audited if table.column(f"prop__{p}").history_tracked]
    hot = temporal.busy(bundle, kind, scope) if scope else {}
    events = temporal.row_events(bundle, kind, audited, scope, hot)
    spine = chosen_records(bundle, kind, s.sub_types, s.where)
    if spine is not None:
        events = events.join(spine, "record_id", "left_semi")
    for p in audited:
        target = table.column(f"prop__{p}").references
        if target and side.has(f"records__{target}") and election.surfaces(target) != {"record_id"}:
            events = translate(events, bundle, election, target, p)
    events = kernels.along_groups(events, ["record_id"], ["sim_time", "op_class"], "sim_time", lags={f"_old_{p}": p for p in audited}, hot=hot)
    parts = [pair(k, F.when(F.col("op") != "c", F.col(f"_old_{p}")), F.col(p), F.col("op") != "u") for k, p in zip(keys, audited, strict=True)]
    events = events.withColumn("changes", changeset(parts)).where((F.col("op") != "u") | (F.col("changes") != "{}"))
    events = translate(events, bundle, election, kind, "record_id", "_shown")
    event = F.when(F.col("op") == "c", EVENTS["c"]).when(F.col("op") == "u", EVENTS["u"]).otherwise(EVENTS["d"])
    return events.select(F.lit(s.item_type or labels.get(kind, kind)).alias("item_type"), F.col("_shown").alias("item_id"), event.alias("event"), "sim_time", "op_class", "changes", F.col("record_id").alias("_rid"))


def membership_arm(bundle: Bundle, s: EventSource, election: Election, labels: dict[str, str]) -> DataFrame:
    ref = s.membership
    events = temporal.membership_events(bundle, ref.kind, ref.property)
    table = bundle.sidecar.membership(ref.kind, ref.property)
    events = filtered(events, s.where, table)
    parts = []
    for c in table.columns:
        if c.role not in ("element", "member"):
            continue
        name = c.name[6:] if c.role == "element" else c.name[8:].replace("__", "_")
        if (s.only is not None and name not in s.only) or name in (s.ignore or []):
            continue
        if c.role == "member" and c.name.endswith("__id"):
            events = member_identity(events, bundle, election, c.name[:-4] + "__kind", c.name)
        value = labelled(F.col(c.name), labels) if c.name.endswith("__kind") else F.col(c.name).cast("string")
        joined = F.col("op") == "join"
        parts.append(pair((s.rename or {}).get(name, name), F.when(~joined, value), F.when(joined, value), F.lit(True)))
    events = translate(events.withColumn("changes", changeset(parts)), bundle, election, ref.kind, "record_id", "_shown")
    return events.select(F.lit(s.item_type or f"{labels.get(ref.kind, ref.kind)}.{ref.property}").alias("item_type"), F.col("_shown").alias("item_id"), F.when(F.col("op") == "join", EVENTS["c"]).otherwise(EVENTS["d"]).alias("event"), "sim_time", "op_class", "changes", F.col("record_id").alias("_rid"))


def typed_values(value, declared: str) -> set:
    """The values of a selection as their column's type tells them apart."""
    def one(v):
        if spark_type(declared) == "string":
            return str(v)
        try:
            return Decimal(str(int(v) if isinstance(v, bool) else v).strip())
        except InvalidOperation:
            return {"t": 1, "true": 1, "y": 1, "yes": 1, "f": 0, "false": 0, "n": 0, "no": 0}.get(str(v).strip().lower(), str(v))

    return {one(v) for v in (value if isinstance(value, (list, tuple)) else [value])}


def refuse_overlaps(bundle: Bundle, sources: list[EventSource]) -> None:
    """Refuse two sources of one kind or membership that share a sub-type, unless a common where column has disjoint values."""
    def scope(s: EventSource) -> tuple:
        if s.kind:
            return (s.kind, None), set(populations(bundle, s.kind, s.sub_types) or [None]), bundle.sidecar.records(s.kind)
        return (s.membership.kind, s.membership.property), {None}, bundle.sidecar.membership(s.membership.kind, s.membership.property)

    for i, a in enumerate(sources):
        space, held, table = scope(a)
        for j, b in enumerate(sources[:i]):
            other, also, _ = scope(b)
            if space != other or held.isdisjoint(also):
                continue
            common = [c for c in a.where or {} if c in (b.where or {}) and table.column(c) is not None]
            if not any(typed_values(a.where[c], table.column(c).type).isdisjoint(typed_values(b.where[c], table.column(c).type)) for c in common):
                raise BundleError("events", f"sources {j} and {i} cover the same rows")


def item_id_type(bundle: Bundle, log: EventLog, election: Election) -> str:
    """The type of item_id: that of the identity all sources show, text if they show different ones."""
    shown, types = set(), set()
    for s in log.sources:
        kind = s.kind or s.membership.kind
        shown |= election.surfaces(kind, populations(bundle, kind, s.sub_types) if s.kind else None)
        claimed = bundle.sidecar.records(kind).column("presentation_id") if bundle.sidecar.has(f"records__{kind}") else None
        types.add(spark_type(claimed.type) if claimed else "string")
    if shown == {"record_index"}:
        return "bigint"
    return types.pop() if shown == {"presentation_id"} and len(types) == 1 else "string"


def event_log(bundle: Bundle, log: EventLog, election: Election, anchor: Anchor, window: Window | None, labels: dict[str, str], keys: bool) -> Planned:
    """One audit log over all sources, its id dense in the order of the tape; numbered before a window is cut out, so ids never change."""
    refuse_overlaps(bundle, log.sources)
    for s in log.sources:  # what is refused is refused now; the log itself is made when it is asked for
        if s.kind:
            audited_properties(bundle, s)
            chosen_records(bundle, s.kind, s.sub_types, s.where)
        else:
            filtered(bundle.membership(s.membership.kind, s.membership.property), s.where, bundle.sidecar.membership(s.membership.kind, s.membership.property))

    id_type = item_id_type(bundle, log, election)

    def made() -> DataFrame:
        arms = None
        for s in log.sources:
            arm = (record_arm if s.kind else membership_arm)(bundle, s, election, labels).withColumn("item_id", F.col("item_id").cast(id_type))
            arms = arm if arms is None else arms.unionByName(arm)
        numbered = kernels.dense_sequence(arms, ["sim_time", "item_type", "op_class", "_rid", "changes"], "id")
        if window:
            numbered = numbered.where(window.holds("sim_time"))
        return numbered.select("id", "item_type", "item_id", "event", anchor.column("sim_time").alias("occurred_at"), "changes")

    return Planned(log.name, made, "append" if window else "replace", ["id"] if keys else [])
