"""Queries of what is refused, what is written and what is checked, over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.plans import common, config, conformance, incremental
from tidelog.plans.common import Anchor, Notice, Window
from tidelog.plans.playback import Atom, Playback
from tidelog.plans.reference import _STAR, _STREAMS, _TS, HI, LO, T
from tidelog.plans.reference import SQL as _SQL
from tidelog.sources import writers
from tidelog.sources.adapters import clinic, sales
from tidelog.sources.bundle import Bundle, BundleError, Sidecar, open_bundle
from tidelog.sources.shared import fresh_folder, put_text
from tidelog.streaming import events as ev
from tidelog.streaming import mixer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def refused(want: dict[str, str]):
    """A query of what each case is refused for. The function gives the cases by name; ``want`` is what its SQL says."""

    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            rows = []
            for name, case in f(spark, d).items():
                try:
                    case()
                    rows.append((name, "accepted"))
                except BundleError as x:
                    rows.append((name, x.code))
            return spark.createDataFrame(rows, "name string, answer string")

        QUERIES[f.__name__] = run
        SQL[f.__name__] = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in want.items()) + ") AS t(name, answer)"
        return f

    return add


_POINT = {"grain": "history_point", "kind": "patient", "property": "status"}
_RECORDS = {"grain": "records", "kind": "patient"}
_ID = {"name": "id", "from": "record_id"}


def _fact(source: dict, *columns: dict, **more) -> dict:
    return {"name": "f", "role": "fact", "source": source, "key": [columns[0]["name"]], "columns": list(columns), **more}


def _dim(*columns: dict, **more) -> dict:
    return {"name": "d", "role": "dim", "scd": "type1", "source": _RECORDS, "key": ["id"], "columns": [_ID, *columns], **more}


def _plan(bundle: Bundle, raw: dict, span: Window | None = None) -> Callable:
    return lambda: incremental.export_tables(bundle, config.export(raw), None, span)


def _stars(bundle: Bundle, span: Window | None = None):
    return lambda *tables, **more: _plan(bundle, {"mode": "dimensional", "dimensional": {"tables": list(tables)}, **more}, span)


@refused({
    "plain": "accepted", "no such kind": "table", "no such column": "column", "key without column": "key", "ordinal of a missing sibling": "ordinal", "time that is not there": "timestamp", "elapsed from a missing column": "elapsed",
    "elapsed to a missing column": "elapsed", "value of another type": "predicate", "version dim without versions": "scd", "lookup of a tracked property": "lookup", "edge to no dim": "fk", "edge without a path": "path", "untracked history": "grain",
    "unclaimed presentation key": "election", "unknown sub-type in keys": "election", "reserved table name": "reserved",
})
def val_dimensional(spark: SparkSession, d: str) -> dict[str, Callable]:
    star = _stars(clinic(spark, d))
    doctor = {"name": "dd", "role": "dim", "scd": "type1", "source": {"grain": "records", "kind": "queue"}, "key": ["id"], "columns": [_ID]}
    elapsed = lambda **k: {"name": "e", "derived": {"elapsed": {"correlate_on": "record_id", "other_where": {"value": "x"}, "start_source": "sim_time", "end_source": "sim_time", "unit": "hours", **k}}}
    return {
        "plain": star(_fact(_RECORDS, _ID)), "no such kind": star(_fact({"grain": "records", "kind": "ghost"}, _ID)), "no such column": star(_fact(_RECORDS, {"name": "id", "from": "prop__ghost"})),
        "key without column": star(_fact(_RECORDS, _ID, key=["other"])), "ordinal of a missing sibling": star(_fact(_POINT, _ID, {"name": "n", "derived": {"ordinal": {"partition_by": "id", "order_by": "ghost"}}})),
        "time that is not there": star(_fact(_POINT, _ID, {"name": "t", "derived": {"timestamp": {"source": "created_sim_time"}}})),
        "elapsed from a missing column": star(_fact(_POINT, _ID, elapsed(start_source="ghost"))), "elapsed to a missing column": star(_fact(_POINT, _ID, elapsed(end_source="ghost"))),
        "value of another type": star(_fact({**_RECORDS, "filter": {"prop__severity": "high"}}, _ID)), "version dim without versions": star(_dim(scd="type2", source={"grain": "records", "kind": "doctor"})),
        "lookup of a tracked property": star(_fact(_POINT, _ID, {"name": "s", "lookup": {"property": "status"}})), "edge to no dim": star(_fact(_RECORDS, _ID, {"name": "x", "fk": {"to": "ghost", "via": "reference"}})),
        "edge without a path": star(doctor, _fact(_RECORDS, _ID, {"name": "x", "fk": {"to": "dd", "via": "reference"}})), "untracked history": star(_fact({**_POINT, "property": "name"}, _ID)),
        "unclaimed presentation key": star(_fact(_RECORDS, _ID), keys={"patient": "presentation_id"}), "unknown sub-type in keys": star(_fact(_RECORDS, _ID), keys={"patient": {"child": "record_id"}}),
        "reserved table name": star(_fact(_RECORDS, _ID, name="_export_meta")),
    }


@refused({
    "points": "accepted", "intervals": "incremental", "memberships": "incremental", "numbers by a value": "incremental", "dim with a tracked column": "incremental", "tracked filter": "incremental", "no section": "incremental",
    "civil period without origin": "incremental", "span with origin": "incremental", "range backwards": "range", "range of words": "range", "hour that is skipped": "anchor", "hour that comes twice": "anchor",
})
def inc_refusals(spark: SparkSession, d: str) -> dict[str, Callable]:
    bundle, day = clinic(spark, d), 86_400_000_000_000
    star = _stars(bundle, Window(None, 0, day, "w"))
    berlin = Anchor("2024-03-01 00:00:00", "Europe/Berlin")
    plain = config.export({"mode": "dimensional", "dimensional": {"tables": [_fact(_POINT, _ID)]}})
    return {
        "points": star(_fact(_POINT, _ID)), "intervals": star(_fact({**_POINT, "grain": "history_interval"}, _ID)), "memberships": star(_fact({"grain": "membership", "kind": "patient", "property": "visits"}, _ID)),
        "numbers by a value": star(_fact(_POINT, _ID, {"name": "v", "from": "value"}, {"name": "n", "derived": {"ordinal": {"partition_by": "id", "order_by": "v"}}})),
        "dim with a tracked column": star(_dim({"name": "s", "from": "prop__status"})), "tracked filter": star(_fact({**_RECORDS, "filter": {"prop__status": "active"}}, _ID)),
        "no section": lambda: incremental.export_next(spark, bundle, plain, "unused"), "civil period without origin": lambda: common.window(0, config.Incremental("day"), None),
        "span with origin": lambda: common.window(0, config.Incremental(sim_period_ns=5), berlin), "range backwards": lambda: common.civil_range("2024-03-02", "2024-03-01", berlin), "range of words": lambda: common.civil_range("now", "then", None),
        "hour that is skipped": lambda: common.civil_range("2024-03-31T02:30:00", "2024-04-01", berlin), "hour that comes twice": lambda: common.localise(datetime(2024, 10, 27, 2, 30), "Europe/Berlin"),
    }


@refused({
    "plain": "accepted", "no origin": "anchor", "no such column": "column", "rename of nothing": "rename", "selection by a tracked column": "where", "selection by a missing column": "where", "unknown sub-type": "population", "sub-types of a flat kind": "population",
    "two columns of one name": "naming", "reserved name": "reserved", "no such membership": "table", "audit of a missing property": "events", "two properties under one name": "events", "events twice": "events", "part of the events twice": "events", "disjoint events": "accepted",
})
def val_source(spark: SparkSession, d: str) -> dict[str, Callable]:
    from dataclasses import replace

    bundle, shop = clinic(spark, d), sales(spark, d)
    timeless = bundle.replacing({}, replace(bundle.sidecar, runtime=None))
    tables = lambda b, *t: _plan(b, {"mode": "source", "source": {"tables": list(t)}})
    log = lambda b, *s: _plan(b, {"mode": "source", "source": {"events": {"name": "log", "sources": list(s)}}})
    person = {"name": "person", "kind": "patient"}
    order = lambda *s: {"kind": "order", "sub_types": list(s)}
    return {
        "plain": tables(bundle, person), "no origin": tables(timeless, person), "no such column": tables(bundle, {**person, "columns": ["prop__ghost"]}), "rename of nothing": tables(bundle, {**person, "rename": {"prop__ghost": "x"}}),
        "selection by a tracked column": tables(bundle, {**person, "where": {"prop__status": "active"}}), "selection by a missing column": tables(bundle, {**person, "where": {"prop__ghost": "x"}}),
        "unknown sub-type": tables(shop, {"name": "o", "kind": "order", "sub_types": ["X"]}), "sub-types of a flat kind": tables(bundle, {**person, "sub_types": ["X"]}), "two columns of one name": tables(bundle, {**person, "rename": {"prop__status": "name"}}),
        "reserved name": tables(bundle, {**person, "name": "_export_windows"}), "no such membership": tables(bundle, {"name": "x", "membership": {"kind": "patient", "property": "ghost"}}),
        "audit of a missing property": log(bundle, {"kind": "patient", "only": ["ghost"]}), "two properties under one name": log(bundle, {"kind": "patient", "rename": {"status": "severity"}}),
        "events twice": log(bundle, {"kind": "patient"}, {"kind": "patient"}), "part of the events twice": log(shop, order("F"), order("O", "F")), "disjoint events": log(shop, order("F"), order("O", "P")),
    }


@refused({"plain": "accepted", "rename of no table": "rename", "reserved name": "naming", "two columns of one name": "naming", "moment and windows": "config", "unknown option": "config"})
def val_base(spark: SparkSession, d: str) -> dict[str, Callable]:
    bundle = clinic(spark, d)
    base = lambda **k: lambda: incremental.export_tables(bundle, config.export({"mode": "base", "base": k}))
    return {
        "plain": base(), "rename of no table": base(rename=[{"table": "records__ghost", "name": "x"}]), "reserved name": base(rename=[{"table": "records__patient", "name": "_export_meta"}]),
        "two columns of one name": base(rename=[{"table": "records__patient", "columns": {"prop__status": "prop__name"}}]),
        "moment and windows": lambda: config.export({"mode": "base", "base": {"slice_at": 1}, "incremental": {"period": "day"}}), "unknown option": base(ghost=1),
    }


@refused({"plain": "accepted", "topic with a slash": "topic", "no such property": "property", "no such field": "field", "sub-types of a flat kind": "population", "no such kind": "table", "envelope without identity": "debezium", "no broker": "kafka"})
def val_streaming(spark: SparkSession, d: str) -> dict[str, Callable]:
    bundle = clinic(spark, d)
    state = lambda **k: lambda: ev.merged(bundle, config.streams({"content": "state-changes", "streams": [{"name": "people", "kind": "patient", "properties": [], **k}]}))
    bare = config.streams({"content": "state-changes", "streams": [{"name": "people", "kind": "patient", "properties": []}]})
    visits = {"name": "v", "membership": {"kind": "patient", "property": "visits"}, "fields": ["ghost"]}
    return {
        "plain": state(), "topic with a slash": state(name="a/b"), "no such property": state(properties=["ghost"]), "no such field": lambda: ev.merged(bundle, config.streams({"content": "membership-events", "streams": [visits]})),
        "sub-types of a flat kind": state(sub_types=["x"]), "no such kind": state(kind="ghost"), "envelope without identity": lambda: ev.debezium(bundle, ev.merged(bundle, bare), bare, None), "no broker": lambda: ev.servers(None, bare, None),
    }


@refused({"plain": "accepted", "nothing": "playback", "twice": "playback", "no such property": "playback", "no such membership": "table", "backwards": "playback", "before the start": "playback"})
def val_playback(spark: SparkSession, d: str) -> dict[str, Callable]:
    bundle = clinic(spark, d)
    of = lambda *a: lambda: Playback(bundle, list(a))
    return {
        "plain": of(Atom("patient")), "nothing": of(), "twice": of(Atom("patient"), Atom("patient")), "no such property": of(Atom("patient", properties=["ghost"])), "no such membership": of(Atom("patient", "ghost")),
        "backwards": lambda: of(Atom("patient"))().events(5, 3), "before the start": lambda: of(Atom("patient"))().snapshot(-1),
    }


@refused({"version": "version", "no tables": "sidecar", "misshapen table": "sidecar", "no file": "missing", "no JSON": "sidecar", "table that is not declared": "table", "type that is none": "type", "two branches": "branch", "number too large": "predicate"})
def src_refusals(spark: SparkSession, d: str) -> dict[str, Callable]:
    raw = clinic(spark, d).sidecar.raw()
    place = fresh_folder(spark, "refused")
    put_text(spark, f"{place}/base.json", "{")
    other = lambda **k: lambda: Sidecar.parse({**raw, **k})
    return {
        "version": other(base_format_version=7), "no tables": lambda: Sidecar.parse({k: v for k, v in raw.items() if k != "tables"}), "misshapen table": other(tables=[{"name": "x"}]), "no file": lambda: open_bundle(spark, f"{place}/none"),
        "no JSON": lambda: open_bundle(spark, place), "table that is not declared": lambda: clinic(spark, d).table("ghost"), "type that is none": lambda: clinic(spark, d).sidecar and conformance.spark_type("WORD"),
        "two branches": lambda: Sidecar.parse({**raw, "branches": raw["branches"] * 2}).fork, "number too large": lambda: clinic(spark, d).records("patient", {"prop__severity": 2**70}),
    }


# --- what is written ----------------------------------------------------------

_WINDOWS = ((0, LO), (LO, HI), (HI, 15_552_000_000_000_001))
_CHANGE = {**_fact({**_POINT, "value": ["active", "discharged", "pending"]}, _ID, {"name": "at", "from": "sim_time"}, {"name": "status", "from": "value"}), "name": "fact_status"}
_VISIT_STAR = {"mode": "dimensional", "dimensional": {"tables": [_STAR["doctor"], _STAR["patient"], _CHANGE]}}


def _windowed(spark: SparkSession, d: str, house) -> None:
    for i, (a, b) in enumerate(_WINDOWS):
        house.commit(incremental.export_tables(clinic(spark, d), config.export(_VISIT_STAR), None, Window(i, a, b, f"w{i}")), Window(i, a, b, f"w{i}"), "mark")


@query(_SQL["exp_scd2"])
def snk_warehouse_versions(spark: SparkSession, d: str) -> DataFrame:
    """A version table grown window by window, read back with the ends its view supplies."""
    house = writers.Warehouse(spark, fresh_folder(spark, "house"))
    _windowed(spark, d, house)
    return house.table("dim_patient")


def _from_duckdb(spark: SparkSession, path: str, sql: str, schema: str) -> DataFrame:
    import duckdb

    with duckdb.connect(path, read_only=True) as con:
        return spark.createDataFrame(con.execute(sql).fetchall(), schema)


@query("""SELECT 'versions' AS what, count(*) AS n FROM (SELECT DISTINCT record_id, sim_time FROM history WHERE kind = 'patient' AND property IN ('status', 'severity', 'doctor_id') AND sim_time >= 0)
    UNION ALL SELECT 'open versions', count(DISTINCT record_id) FROM history WHERE kind = 'patient' AND property IN ('status', 'severity', 'doctor_id') AND sim_time >= 0 UNION ALL SELECT 'doctors', count(*) FROM records__doctor
    UNION ALL SELECT 'changes', count(*) FROM history WHERE kind = 'patient' AND property = 'status' AND value IN ('active', 'discharged', 'pending') AND sim_time >= 0 UNION ALL SELECT 'windows', 3 UNION ALL SELECT 'marks', 1""")
def snk_duckdb_windows(spark: SparkSession, d: str) -> DataFrame:
    """A DuckDB file grown window by window: appended rows, a replaced dim, the view with its ends, and the bookkeeping."""
    import tempfile

    with tempfile.TemporaryDirectory() as local:  # the delivered file is the driver's own
        path = f"{local}/house.duckdb"
        _windowed(spark, d, writers.DuckWarehouse(path))
        counts = [("versions", "dim_patient"), ("open versions", "dim_patient WHERE valid_to IS NULL"), ("doctors", "dim_doctor"), ("changes", "fact_status"), ("windows", "_export_windows"), ("marks", "_export_meta")]
        return _from_duckdb(spark, path, " UNION ALL ".join(f"SELECT '{n}', count(*) FROM {t}" for n, t in counts), "what string, n long")


@query(f"SELECT record_id AS id, {_TS.format('created_sim_time')} AS created_at, active, prop__name AS name FROM records__doctor")
def snk_csv(spark: SparkSession, d: str) -> DataFrame:
    """A table written as CSV parts and read back."""
    raw = {"mode": "source", "source": {"tables": [{"name": "doctor", "kind": "doctor"}]}}
    place = fresh_folder(spark, "csv")
    writers.write_csv_parts(incremental.export_tables(clinic(spark, d), config.export(raw)), place)
    schema = "id string, created_at timestamp_ntz, active boolean, deactivated_at timestamp_ntz, updated_at timestamp_ntz, name string"
    return spark.read.csv(f"{place}/doctor", schema=schema, header=True, emptyValue="", nullValue="").select("id", "created_at", "active", "name")


@query("SELECT record_id, prop__status, prop__severity, prop__name FROM records__patient")
def snk_bundle(spark: SparkSession, d: str) -> DataFrame:
    """A bundle written with its sidecar, opened again; its checks that don't concern dirt hold."""
    place = fresh_folder(spark, "bundle")
    writers.write_bundle(clinic(spark, d), place)
    again = open_bundle(spark, place)
    if bad := [c for c in ("C1", "C2", "C3", "C4", "C5", "C8") if not conformance.run_check(again, c).ok]:
        raise BundleError("conformance", ", ".join(bad))
    return again.records("patient").select("record_id", "prop__status", "prop__severity", "prop__name")


@query(_SQL["str_jsonl"].replace("SELECT seq, 'people' AS topic, sim_time, to_json", "SELECT 'people' AS topic, to_json"))
def snk_jsonl_files(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a stream, read back from the parts of its topic."""
    b, c = clinic(spark, d), config.streams(_STREAMS)
    place = fresh_folder(spark, "lines")
    ev.write_files(ev.jsonl(ev.events(b, c), ev.stream_anchor(b, c)), place, ["people"])
    return spark.read.text(f"{place}/topic=people").select(F.lit("people").alias("topic"), "value")


# --- windows, checks and replay -------------------------------------------------


@query("""WITH days AS (SELECT n AS i, DATE '2024-03-30' + CAST(n AS INTEGER) AS day FROM range(4) t(n)),
    edges AS (SELECT i, day, epoch_us(timezone('Europe/Berlin', day::TIMESTAMP)) AS a, epoch_us(timezone('Europe/Berlin', (day + 1)::TIMESTAMP)) AS b FROM days)
    SELECT i AS window_index, 'w0000' || i || '_' || strftime(day, '%Y-%m-%d') AS label, (a - epoch_us(TIMESTAMPTZ '2024-03-29 23:00:00+00')) * 1000 AS start_ns, (b - epoch_us(TIMESTAMPTZ '2024-03-29 23:00:00+00')) * 1000 AS end_ns FROM edges""")
def inc_civil_days(spark: SparkSession, d: str) -> DataFrame:
    """Civil days across a change of summer time; one has 23 hours."""
    origin = Anchor("2024-03-29 23:00:00", "Europe/Berlin")
    made = [common.window(i, config.Incremental("day"), origin) for i in range(4)]
    return spark.createDataFrame([(w.index, w.label, w.start, w.end) for w in made], "window_index long, label string, start_ns long, end_ns long")


@query("SELECT 'C' || n AS \"check\", 'ok' AS answer FROM range(1, 15) t(n)")
def con_clean(spark: SparkSession, d: str) -> DataFrame:
    """All checks hold on tables without dirt."""
    found = conformance.validate(sales(spark, d))
    return spark.createDataFrame([(f.check, "ok" if f.ok else "failed") for f in found], "check string, answer string")


@query("SELECT * FROM (VALUES ('C2', 'a column is lost'), ('C4', 'history has another column'), ('C7', 'ended and active'), ('C8', 'another branch'), ('C10', 'a member is gone'), ('C3', 'a name that is none')) AS t(\"check\", defect)")
def con_broken(spark: SparkSession, d: str) -> DataFrame:
    """Each defect is found by its own check."""
    b = sales(spark, d)
    swap = lambda name, change: b.replacing({name: change(b.table(name))})
    raw = b.sidecar.raw()
    named = Bundle(spark, Sidecar.parse({**raw, "tables": [{**t, "name": "records__Part"} if t["name"] == "records__part" else t for t in raw["tables"]]}), lambda n: b.table("records__part" if n == "records__Part" else n))
    cases = [
        ("C2", "a column is lost", swap("records__part", lambda t: t.drop("prop__size"))), ("C4", "history has another column", swap("history", lambda t: t.withColumnRenamed("value", "v"))),
        ("C7", "ended and active", swap("records__order", lambda t: t.withColumn("active", F.lit(True)))), ("C8", "another branch", swap("records__nation", lambda t: t.withColumn("fork_path", F.lit("b")))),
        ("C10", "a member is gone", swap("records__part", lambda t: t.where("record_index > 5"))), ("C3", "a name that is none", named),
    ]
    return spark.createDataFrame([(c, what) for c, what, bad in cases if not conformance.run_check(bad, c).ok], "check string, defect string")


@query(f"WITH people AS (SELECT sim_time FROM ({_SQL['der_row_events']}) e), docs AS (SELECT created_sim_time AS sim_time FROM records__doctor UNION ALL SELECT deactivated_at FROM records__doctor WHERE deactivated_at IS NOT NULL) SELECT 'people' AS topic, count(*) AS sent FROM people WHERE sim_time <= {T} - 3600000000000 UNION ALL SELECT 'doctors', 0")
def mix_released(spark: SparkSession, d: str) -> DataFrame:
    """What a steered replay has sent when its transport stands at a moment: one topic an hour behind, one muted."""
    c = config.streams({**_STREAMS, "streams": [*_STREAMS["streams"], {"name": "doctors", "kind": "doctor", "properties": ["name"]}]})
    state = mixer.Mixer({n: mixer.Topic(n) for n in ("people", "doctors")}, T, 86_400.0)
    state.steer("people", lag=3_600_000_000_000)
    state.steer("doctors", muted=True)
    lines = ev.jsonl(ev.events(clinic(spark, d), c), None)
    for seconds in (30.0, 30.0, 60.0):
        mixer.release(lines, state, seconds, lambda topic, due: None)
    return spark.createDataFrame([(t.name, t.sent) for t in state.topics.values()], "topic string, sent long")


@query("SELECT * FROM (VALUES ('dim_doctor', 'replace', NULL), ('dim_patient__rows', 'append', 'dim_patient'), ('fact_status', 'append', NULL)) AS t(name, mode, view)")
def ply_tables(spark: SparkSession, d: str) -> DataFrame:
    """What the windows of an export hold."""
    made = Playback(clinic(spark, d), [Atom("patient")]).tables(config.export(_VISIT_STAR))
    return spark.createDataFrame([(t["name"], t["mode"], t["view"]) for t in made], "name string, mode string, view string")


@query(f"SELECT record_id, sim_time, value FROM history WHERE kind = 'patient' AND property = 'status' AND sim_time >= {LO} AND sim_time < {HI}")
def ply_shaped_window(spark: SparkSession, d: str) -> DataFrame:
    """The rows an export has for a span of the tape."""
    fact = _fact(_POINT, {"name": "record_id", "from": "record_id"}, {"name": "sim_time", "from": "sim_time"}, {"name": "value", "from": "value"})
    planned = Playback(clinic(spark, d), [Atom("patient")]).shaped(config.export({"mode": "dimensional", "dimensional": {"tables": [fact]}}), LO, HI)
    return planned[0].frame


@query("SELECT 'slice-only-column-omitted' AS code, 'records__patient.prop__name' AS message UNION ALL SELECT 'keys-not-declarable-csv', 'patient'")
def snk_notices(spark: SparkSession, d: str) -> DataFrame:
    """What is left out is said: a column whose past can't be known, keys a CSV file can't hold."""
    import tempfile

    heard: list[Notice] = []
    b = clinic(spark, d)
    raw = b.sidecar.raw()
    for t in raw["tables"]:
        for c in t["columns"]:
            if (t["name"], c["name"]) == ("records__patient", "prop__name"):
                c["temporal_class"] = "slice_only"
    blurred = Bundle(spark, Sidecar.parse(raw), b.table)
    tables = incremental.export_tables(blurred, config.export({"mode": "source", "source": {"declare_keys": True, "tables": [{"name": "patient", "kind": "patient"}]}}), None, None, heard.append)
    with tempfile.TemporaryDirectory() as local:
        writers.write_csv(tables, local, heard.append)
    return spark.createDataFrame([(n.code, n.message) for n in heard], "code string, message string")

