"""Declared streams of change events: folded, merged in one order, numbered and rendered, all as one frame."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators import kernels, temporal
from tidelog.plans.common import Anchor, resolve_anchor
from tidelog.plans.config import Stream, Streams
from tidelog.plans.election import Election, elect, translate
from tidelog.plans.source import chosen_records, populations
from tidelog.sources.bundle import Bundle, BundleError

TOPIC = re.compile(r"[A-Za-z0-9._-]+")
#: The fields of an envelope's source block and transaction: name, type, whether optional.
SOURCE = (
    ("version", "string", False), ("connector", "string", False), ("name", "string", False), ("ts_ms", "int64", False), ("snapshot", "string", True), ("db", "string", False),
    ("sequence", "string", True), ("schema", "string", True), ("table", "string", True), ("txId", "int64", True), ("lsn", "int64", True),
)
TRANSACTION = (("id", "string", False), ("total_order", "int64", False), ("data_collection_order", "int64", False))
#: Stands for the table's name in a schema until a row's own is put in.
TABLE = "%table%"
COLUMNS = ["seq", "topic", "route_table", "kind", "op", "record_id", "key_column", "key_value", "sim_time", "after"]


def check(bundle: Bundle, config: Streams, election: Election) -> None:
    """All refusals, before any frame is made."""
    side = bundle.sidecar
    for s in config.streams:
        if not TOPIC.fullmatch(s.name) or s.name in (".", ".."):
            raise BundleError("topic", f"{s.name} is no topic")
        if s.kind:
            table = side.records(s.kind)
            selected = populations(bundle, s.kind, s.sub_types)
            for p in s.properties:
                if table.column(f"prop__{p}") is None:
                    raise BundleError("property", f"{s.kind} has no property {p}")
                if side.slice_only(s.kind, f"prop__{p}"):
                    raise BundleError("slice-only", f"the past of {s.kind}.{p} can't be known")
            election.surface(s.kind, selected)
        else:
            table = side.membership(s.membership.kind, s.membership.property)
            names = {c.name[6:] for c in table.columns if c.role == "element"} | set(table.member_fields())
            if lost := [f for f in s.fields if f not in names]:
                raise BundleError("field", f"{table.name} has no field {', '.join(lost)}")
            election.surface(s.membership.kind)


def _image(pairs: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in pairs.items())), {"ignoreNullFields": "false"})


def _state_stream(bundle: Bundle, s: Stream, election: Election) -> DataFrame:
    side, kind = bundle.sidecar, s.kind
    table, selected = side.records(kind), populations(bundle, kind, s.sub_types)
    events = temporal.row_events(bundle, kind, s.properties)
    spine = chosen_records(bundle, kind, s.sub_types, None)
    if spine is not None:
        events = events.join(spine, "record_id", "left_semi")
    for p in s.properties:
        target = table.column(f"prop__{p}").references
        if target and side.has(f"records__{target}"):
            events = translate(events, bundle, election, target, p)
    surface = election.surface(kind, selected)
    events = translate(events, bundle, election, kind, "record_id", "key_value")
    route = F.lit(kind)
    if side.discriminator(kind):
        leaf = bundle.records(kind).select("record_id", F.col(side.discriminator(kind)).alias("_leaf"))
        events = events.join(leaf, "record_id", "left")
        route = F.coalesce("_leaf", F.lit(kind))
    after = _image({surface: F.col("key_value").cast("string"), **{f"prop__{p}": F.col(p) for p in s.properties}})
    return events.select(
        F.lit(s.name).alias("topic"), route.alias("route_table"), F.lit(kind).alias("kind"), "op", "op_class", "record_id", F.lit(surface).alias("key_column"),
        F.col("key_value").cast("string").alias("key_value"), "sim_time", F.when(F.col("op") != "d", after).alias("after"),
    )


def _member_stream(bundle: Bundle, s: Stream, election: Election) -> DataFrame:
    ref = s.membership
    table = bundle.sidecar.membership(ref.kind, ref.property)
    events = temporal.membership_events(bundle, ref.kind, ref.property)
    surface = election.surface(ref.kind)
    events = translate(events, bundle, election, ref.kind, "record_id", "key_value")
    shown: dict[str, Column] = {surface: F.col("key_value").cast("string")}
    for f in s.fields:
        for c in table.columns:
            if c.name == f"elem__{f}" or c.name in (f"member__{f}__kind", f"member__{f}__id"):
                shown[c.name] = F.col(c.name).cast("string")
    return events.select(
        F.lit(s.name).alias("topic"), F.lit(f"{ref.kind}__{ref.property}").alias("route_table"), F.lit(ref.kind).alias("kind"), "op", "op_class", "record_id",
        F.lit(surface).alias("key_column"), F.col("key_value").cast("string").alias("key_value"), "sim_time", _image(shown).alias("after"),
    )


def merged(bundle: Bundle, config: Streams) -> DataFrame:
    """The events of all streams, not yet numbered; what is refused is refused here."""
    election = elect(bundle.sidecar, config.keys)
    check(bundle, config, election)
    made = None
    for s in config.streams:
        one = _state_stream(bundle, s, election) if s.kind else _member_stream(bundle, s, election)
        made = one if made is None else made.unionByName(one)
    return made


def events(bundle: Bundle, config: Streams) -> DataFrame:
    """All events of all streams with ``seq``, dense in the order of time, class, stream and record.

    ``after`` is the image as JSON text, null on a delete. The events of a
    stream don't depend on which properties it shows.
    """
    return kernels.dense_sequence(merged(bundle, config), ["sim_time", "op_class", "topic", "record_id", "after"], "seq").select(*COLUMNS)


def timestamp(anchor: Anchor | None, ns: str = "sim_time") -> Column:
    """Wall-clock text with offset, or the sim time itself without an anchor."""
    if anchor is None:
        return F.col(ns)
    us = F.call_function("div", F.col(ns), F.lit(1000)) + F.lit(anchor.epoch_us())
    moment = F.timestamp_micros(us)
    utc = F.to_timestamp_ntz(F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    local = F.convert_timezone(F.lit("UTC"), F.lit(anchor.zone), utc)
    seconds = F.unix_seconds(local.cast("timestamp")) - F.unix_seconds(utc.cast("timestamp"))
    sign = F.when(seconds < 0, "-").otherwise("+")
    offset = F.concat(sign, F.lpad(F.floor(F.abs(seconds) / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(F.abs(seconds) % 3600 / 60).cast("string"), 2, "0"))
    text = F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.000000$", ""), offset)


def jsonl(made: DataFrame, anchor: Anchor | None) -> DataFrame:
    """seq, topic, value: one JSON object {seq, op, ts, kind, key, after} per event."""
    head = F.to_json(F.struct("seq", "op", timestamp(anchor).alias("ts"), "kind", F.create_map("key_column", "key_value").alias("key")), {"ignoreNullFields": "false"})
    value = F.concat(F.expr("left(_head, length(_head) - 1)"), F.lit(',"after":'), F.coalesce("after", F.lit("null")), F.lit("}"))
    return made.withColumn("_head", head).select("seq", "topic", "sim_time", value.alias("value"))


def debezium(bundle: Bundle, made: DataFrame, config: Streams, anchor: Anchor | None) -> DataFrame:
    """seq, topic, value: the envelope {before, after, source, op, ts_ms, transaction}, with a schema if enabled.

    A delete carries its key as before-image; joins and leaves are inserts
    with the operation as leading field ``event``.
    """
    if anchor is None or config.debezium is None:
        raise BundleError("debezium", "the format needs a time origin and its source identity")
    d, identity = config.debezium, config.debezium.source
    ns = F.col("sim_time") + F.lit(anchor.epoch_us() * 1000)
    ms = F.call_function("div", ns - F.pmod(ns, F.lit(1_000_000)), F.lit(1_000_000))
    table = F.col("route_table") if d.table_identity == "source_table" else F.col("topic")
    said = {
        "version": F.lit(identity.version), "connector": F.lit(identity.connector), "name": F.lit(identity.name), "ts_ms": ms, "snapshot": F.lit("false"), "db": F.lit(identity.db),
        "sequence": F.concat(F.lit('[null,"'), F.col("seq").cast("string"), F.lit('"]')), "schema": F.lit(identity.schema), "table": table, "txId": F.lit(None).cast("long"), "lsn": F.col("seq"),
    }
    source = F.struct(*(said[n].alias(n) for n, *_ in SOURCE))
    key = F.to_json(F.create_map("key_column", "key_value"))
    member = F.col("op").isin("join", "leave")
    image = F.when(member, F.concat(F.lit('{"event":"'), F.col("op"), F.lit('",'), F.substring("after", 2, 2**31 - 1))).otherwise(F.col("after"))
    parts = [
        F.lit('{"before":'), F.when(F.col("op") == "d", key).otherwise("null"), F.lit(',"after":'), F.coalesce(image, F.lit("null")), F.lit(',"source":'), F.to_json(source, {"ignoreNullFields": "false"}),
        F.lit(',"op":"'), F.when(member, "c").otherwise(F.col("op")), F.lit('","ts_ms":'), ms.cast("string"), F.lit(',"transaction":null}'),
    ]
    payload = F.concat(*parts)
    if d.schemas_enable:
        # the columns of a topic's rows are the same; the name of their table is put in per row
        schemas = F.create_map(*(x for s, names in image_columns(bundle, config).items() for x in (F.lit(s), F.lit(value_schema(names, TABLE, identity)))))
        payload = F.concat(F.lit('{"schema":'), F.replace(schemas[F.col("topic")], F.lit(TABLE), F.regexp_extract(F.to_json(F.array(table)), r'(?s)^\["(.*)"\]$', 1)), F.lit(',"payload":'), payload, F.lit("}"))
    return made.select("seq", "topic", "sim_time", payload.alias("value"))


def image_columns(bundle: Bundle, config: Streams) -> dict[str, list[str]]:
    """Per topic the fields its images have, in order."""
    election, out = elect(bundle.sidecar, config.keys), {}
    for s in config.streams:
        if s.kind:
            out[s.name] = [election.surface(s.kind, populations(bundle, s.kind, s.sub_types)), *(f"prop__{p}" for p in s.properties)]
        else:
            table = bundle.sidecar.membership(s.membership.kind, s.membership.property)
            shown = [c.name for f in s.fields for c in table.columns if c.name in (f"elem__{f}", f"member__{f}__kind", f"member__{f}__id")]
            out[s.name] = ["event", election.surface(s.membership.kind), *shown]
    return out


def value_schema(columns: list[str], table: str, identity) -> str:
    """The schema of an envelope as text: both images with optional text fields, the source, operation, time and transaction."""

    def struct(fields: list[dict], name: str, optional: bool, **field: str) -> dict:
        return {"type": "struct", "fields": fields, "optional": optional, "name": name, **field}

    value = lambda name, kind, optional: {"type": kind, "optional": optional, "field": name}
    image = [value(c, "string", True) for c in columns]
    space = f"{identity.name}.{table}"
    fields = [struct(image, f"{space}.Value", True, field=side) for side in ("before", "after")]
    fields.append(struct([value(*f) for f in SOURCE], f"io.debezium.connector.{identity.connector}.Source", False, field="source"))
    fields += [value("op", "string", False), value("ts_ms", "int64", True)]
    fields.append(struct([value(*f) for f in TRANSACTION], "event.block", True, field="transaction"))
    return json.dumps(struct(fields, f"{space}.Envelope", False), separators=(",", ":"))


def write_files(lines: DataFrame, out: str, topics: list[str]) -> None:
    """A folder per topic with ordered parts; topics without events are there too, and empty."""
    spread = lines.repartitionByRange("topic", "seq").sortWithinPartitions("topic", "seq")
    spread.select("topic", "value").write.mode("errorifexists").partitionBy("topic").text(out)
    jvm = lines.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(lines.sparkSession.sparkContext._jsc.hadoopConfiguration())
    for t in topics:
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{out}/topic={t}"))


def deliver_files(lines: DataFrame, out: str, topics: list[str]) -> dict[str, int]:
    """One ``<topic>.jsonl`` per topic in the order of seq, written as the events come in; counts per topic, zeros kept."""
    from pathlib import Path

    Path(out).mkdir(parents=True, exist_ok=True)
    files = {t: Path(out, f"{t}.jsonl").open("w") for t in topics}
    counts = dict.fromkeys(topics, 0)
    try:
        for row in lines.orderBy("seq").toLocalIterator(prefetchPartitions=True):
            files[row["topic"]].write(row["value"] + "\n")
            counts[row["topic"]] += 1
    finally:
        for f in files.values():
            f.close()
    return counts


def deliver_lines(lines: DataFrame) -> Iterator[tuple[int, str]]:
    """Sim time and line of every event in order, for standard output or a paced sink."""
    for row in lines.orderBy("seq").toLocalIterator(prefetchPartitions=True):
        yield row["sim_time"], row["value"]


def write_kafka(lines: DataFrame, made: DataFrame, servers: str) -> None:
    """One record per event, keyed by the shown identity; needs Spark's Kafka connector on the cluster.

    Every topic is written by one task, in the order of seq, to its partition
    0, so its order is that of the tape; the sim time goes into a header, as
    the connector sets no record times.
    """
    keyed = lines.join(made.select("seq", F.to_json(F.create_map("key_column", "key_value")).alias("key")), "seq").repartition("topic")
    header = F.array(F.struct(F.lit("sim_time").alias("key"), F.col("sim_time").cast("string").cast("binary").alias("value")))
    records = keyed.sortWithinPartitions("topic", "seq").select("topic", "key", "value", F.lit(0).alias("partition"), header.alias("headers"))
    records.write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").option("kafka.enable.idempotence", "true").save()


def servers(argument: str | None, config: Streams, environment: str | None) -> str:
    """Where the broker is: the argument, then the configuration, then the environment."""
    found = argument or (config.kafka and config.kafka.bootstrap_servers) or environment
    if not found:
        raise BundleError("kafka", "no bootstrap servers are named")
    return found


def stream_anchor(bundle: Bundle, config: Streams) -> Anchor | None:
    return resolve_anchor(bundle.sidecar, config.rebase)


def topic_counts(made: DataFrame, config: Streams) -> DataFrame:
    """Events per declared topic, zeros kept."""
    topics = made.sparkSession.createDataFrame([(s.name,) for s in config.streams], "topic string")
    return topics.join(made.groupBy("topic").agg(F.count(F.lit(1)).alias("events")), "topic", "left").na.fill(0)
