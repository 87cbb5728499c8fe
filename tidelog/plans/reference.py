"""Queries of the bundle operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import mutations
from tidelog.operators import kernels, temporal
from tidelog.plans import config, conformance, dimensional, incremental, propose
from tidelog.plans.common import Window
from tidelog.plans.election import elect, identities, key_counts
from tidelog.plans.playback import Atom, Playback
from tidelog.sources.adapters import clinic, sales
from tidelog.sources.tables import table
from tidelog.streaming import events as ev
from tidelog.streaming import live

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: A moment in the middle of the tape, and a window around it.
T = 7_776_000_000_000_000
LO, HI = 5_184_000_000_000_000, 7_862_400_000_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _one(bundle, raw: dict, name: str, span: Window | None = None) -> DataFrame:
    planned = incremental.export_tables(bundle, config.export(raw), None, span)
    return next(t for t in planned if t.name == name).frame


# --- scans -----------------------------------------------------------------


@query("SELECT record_id, prop__status, prop__severity, record_index FROM records__patient WHERE prop__status IN ('active', 'pending')")
def src_records(spark: SparkSession, d: str) -> DataFrame:
    return clinic(spark, d).records("patient", {"prop__status": ["active", "pending"]}).select("record_id", "prop__status", "prop__severity", "record_index")


@query("SELECT record_id, sim_time, value FROM history WHERE kind = 'patient' AND property = 'status' AND value = 'discharged'")
def src_history(spark: SparkSession, d: str) -> DataFrame:
    return clinic(spark, d).history("patient", ["status"], "discharged").select("record_id", "sim_time", "value")


@query("SELECT record_id, joined_sim_time, left_sim_time, elem__slot FROM membership__patient__visits WHERE elem__slot IN (1, 3) AND member__doctor__kind = 'doctor'")
def src_membership(spark: SparkSession, d: str) -> DataFrame:
    return clinic(spark, d).membership("patient", "visits", {"elem__slot": [1, 3], "member__doctor__kind": "doctor"}).select("record_id", "joined_sim_time", "left_sim_time", "elem__slot")


@query("SELECT DISTINCT prop__status FROM records__patient WHERE prop__status IS NOT NULL")
def src_distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return clinic(spark, d).distinct_values("patient", "status")


@query("SELECT kind, property, count(*) AS n FROM history WHERE sim_time < 7776000000000000 GROUP BY kind, property")
def src_sql(spark: SparkSession, d: str) -> DataFrame:
    return clinic(spark, d).sql("SELECT kind, property, count(*) AS n FROM history WHERE sim_time < :t GROUP BY kind, property", t=T)


@query("SELECT 'records__patient' AS name, 12 AS columns, (SELECT count(*) FROM records__patient) AS n UNION ALL SELECT 'records__doctor', 8, (SELECT count(*) FROM records__doctor) UNION ALL SELECT 'records__queue', 8, (SELECT count(*) FROM records__queue) UNION ALL SELECT 'history', 6, (SELECT count(*) FROM history) UNION ALL SELECT 'membership__patient__visits', 7, (SELECT count(*) FROM membership__patient__visits)")
def src_catalog(spark: SparkSession, d: str) -> DataFrame:
    b, out = clinic(spark, d), None
    for t in b.sidecar.tables:
        one = b.table(t.name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t.name).alias("name"), F.lit(len(t.columns)).alias("columns"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# --- joins -----------------------------------------------------------------

_EVENTS = "(SELECT user_id, event_id, epoch_us(ts) * 1000 AS t, event_type, value FROM events)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) * 1000").alias("t")
    return table(spark, d, "events").select("user_id", "event_id", t, "event_type", "value")


def _asof(spark: SparkSession, d: str, **how) -> DataFrame:
    e = _events(spark, d)
    probes = e.select("event_id", "user_id", (F.col("t") - 3_600_000_000_000).alias("at"))
    changes = e.select("user_id", "t", F.col("event_type").alias("last_type"), F.col("value").alias("last_value"))
    return kernels.as_of(probes, "at", changes, "t", ["user_id"], ["last_type", "last_value"], **how)


_PROBES = f"p AS (SELECT event_id, user_id, t - 3600000000000 AS at FROM {_EVENTS}), c AS (SELECT user_id, t, event_type AS last_type, value AS last_value FROM {_EVENTS})"


@query(f"WITH {_PROBES} SELECT p.event_id, p.user_id, p.at, c.last_type, c.last_value FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.at >= c.t")
def join_as_of(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d)


@query(f"WITH {_PROBES} SELECT p.event_id, p.user_id, p.at, c.last_type, c.last_value FROM p ASOF JOIN c ON p.user_id = c.user_id AND p.at >= c.t")
def join_as_of_inner(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, inner=True)


@query(f"SELECT p.event_id, p.user_id, p.t AS at, c.last_type, c.last_value FROM {_EVENTS} p ASOF LEFT JOIN (SELECT user_id, t, event_type AS last_type, value AS last_value FROM {_EVENTS}) c ON p.user_id = c.user_id AND p.t > c.t")
def join_as_of_strict(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    changes = e.select("user_id", "t", F.col("event_type").alias("last_type"), F.col("value").alias("last_value"))
    return kernels.as_of(e.select("event_id", "user_id", F.col("t").alias("at")), "at", changes, "t", ["user_id"], ["last_type", "last_value"], strict=True)


@query("SELECT CAST(o.o_orderkey AS VARCHAR) AS record_id, r.r_name AS region FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey")
def join_reference_path(spark: SparkSession, d: str) -> DataFrame:
    b = sales(spark, d)
    path, _ = dimensional.resolve_path(b.sidecar, "order", "region", None)
    return dimensional.follow(b.records("order"), b, "order", path, path[0], "region", "prop__name").select("record_id", "region")


_LINES = "lines AS (SELECT l_orderkey, l_partkey, date_diff('microsecond', TIMESTAMP '1995-01-01', least(o_orderdate, l_shipdate)) * 1000 AS s, date_diff('microsecond', TIMESTAMP '1995-01-01', greatest(o_orderdate, l_shipdate)) * 1000 AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"""WITH {_LINES},
    probes AS (SELECT CAST(p_partkey AS VARCHAR) AS part, 100000000000000000 + p_partkey * 1000000000 AS at FROM part),
    ranked AS (SELECT p.part, p.at, l.l_orderkey, row_number() OVER (PARTITION BY p.part ORDER BY l.s DESC, CAST(l.l_orderkey AS VARCHAR)) AS n FROM probes p JOIN lines l ON CAST(l.l_partkey AS VARCHAR) = p.part AND l.s <= p.at AND p.at < l.e)
    SELECT p.part, p.at, CAST(r.l_orderkey AS VARCHAR) AS holder FROM probes p LEFT JOIN ranked r ON p.part = r.part AND r.n = 1""")
def join_holder_at(spark: SparkSession, d: str) -> DataFrame:
    """The order that holds a part at a moment: of overlapping lines the latest, then the smallest id."""
    lines = sales(spark, d).membership("order", "lines").select(F.col("member__part__id").alias("part"), F.col("record_id").alias("holder"), "joined_sim_time", "left_sim_time")
    probes = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("part"), (F.lit(100_000_000_000_000_000) + F.col("p_partkey") * 1_000_000_000).alias("at"))
    return kernels.containing(probes, "at", lines, ["part"], "joined_sim_time", "left_sim_time", ["holder"])


_STAR = {
    "doctor": {"name": "dim_doctor", "role": "dim", "scd": "type1", "source": {"grain": "records", "kind": "doctor"}, "key": ["doctor_id"], "columns": [{"name": "doctor_id", "from": "record_id"}, {"name": "name", "from": "prop__name"}]},
    "patient": {
        "name": "dim_patient", "role": "dim", "scd": "type2", "source": {"grain": "records", "kind": "patient"}, "key": ["patient_id", "valid_from"],
        "columns": [{"name": "patient_id", "from": "record_id"}, {"name": "name", "from": "prop__name"}, {"name": "status", "from": "prop__status"}, {"name": "severity", "from": "prop__severity"}, {"name": "valid_from", "derived": {"scd_window": "valid_from"}}, {"name": "valid_to", "derived": {"scd_window": "valid_to"}}],
    },
    "visit": {
        "name": "fact_visit", "role": "fact", "source": {"grain": "membership", "kind": "patient", "property": "visits"}, "key": ["patient_id"],
        "columns": [{"name": "patient_id", "from": "record_id"}, {"name": "joined", "from": "joined_sim_time"}, {"name": "slot", "from": "elem__slot"}, {"name": "doctor_id", "fk": {"to": "dim_doctor", "via": "membership"}}],
    },
    "owner": {
        "name": "dim_patient_doctor", "role": "dim", "scd": "type1", "source": {"grain": "records", "kind": "patient"}, "key": ["patient_id"],
        "columns": [{"name": "patient_id", "from": "record_id"}, {"name": "doctor_id", "fk": {"to": "dim_doctor", "via": "membership", "where": {"elem__slot": 1}}}],
    },
    "change": {
        "name": "fact_status", "role": "fact", "source": {"grain": "history_point", "kind": "patient", "property": "status", "value": ["active", "discharged", "pending"]}, "key": ["patient_id", "at"],
        "columns": [
            {"name": "patient_id", "from": "record_id"}, {"name": "at", "from": "sim_time"}, {"name": "status", "from": "value"},
            {"name": "rank", "derived": {"value_map": {"from": "value", "map": {"pending": 1, "active": 2}}}}, {"name": "ts", "derived": {"timestamp": {"source": "sim_time"}}},
            {"name": "hours", "derived": {"elapsed": {"correlate_on": "record_id", "other_where": {"value": "pending"}, "start_source": "sim_time", "end_source": "sim_time", "unit": "hours"}}},
            {"name": "doctor_id", "fk": {"to": "dim_doctor", "via": "reference"}}, {"name": "doctor", "lookup": {"to": "doctor", "property": "name"}}, {"name": "pad", "null": True},
        ],
    },
    "interval": {
        "name": "fact_interval", "role": "fact", "source": {"grain": "history_interval", "kind": "patient", "property": "severity"}, "key": ["patient_id", "since"],
        "columns": [{"name": "patient_id", "from": "record_id"}, {"name": "severity", "from": "value"}, {"name": "since", "from": "sim_time"}, {"name": "until", "from": "lead_sim_time"}],
    },
}


def _star(spark: SparkSession, d: str, *names: str, span: Window | None = None) -> DataFrame:
    raw = {"mode": "dimensional", "dimensional": {"tables": [_STAR[n] for n in dict.fromkeys(("doctor", *names))]}}
    return _one(clinic(spark, d), raw, _STAR[names[-1]]["name"], span)


_TS = "TIMESTAMP '2024-01-01' + to_microseconds({} // 1000)"
_INSTANTS = """
    inst AS (SELECT record_id, sim_time, count(*) FILTER (property = 'status') AS ns, max(value) FILTER (property = 'status') AS vs, count(*) FILTER (property = 'severity') AS ny, max(value) FILTER (property = 'severity') AS vy,
                    count(*) FILTER (property = 'doctor_id') AS nd, max(value) FILTER (property = 'doctor_id') AS vd
             FROM history WHERE kind = 'patient' AND property IN ('status', 'severity', 'doctor_id') GROUP BY ALL),
    vers AS (SELECT record_id, sim_time AS version_start, lead(sim_time) OVER w AS version_end,
                    last_value(CASE WHEN ns > 0 THEN {'v': vs} END IGNORE NULLS) OVER f AS s, last_value(CASE WHEN ny > 0 THEN {'v': vy} END IGNORE NULLS) OVER f AS y, last_value(CASE WHEN nd > 0 THEN {'v': vd} END IGNORE NULLS) OVER f AS d
             FROM inst WINDOW w AS (PARTITION BY record_id ORDER BY sim_time), f AS (PARTITION BY record_id ORDER BY sim_time ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {_INSTANTS} SELECT record_id, version_start, version_end, s.v AS status, y.v AS severity, d.v AS doctor_id FROM vers")
def der_versions(spark: SparkSession, d: str) -> DataFrame:
    return temporal.versions(clinic(spark, d), "patient")


@query(f"WITH {_INSTANTS} SELECT v.record_id AS patient_id, p.prop__name AS name, s.v AS status, y.v AS severity, {_TS.format('version_start')} AS valid_from, {_TS.format('version_end')} AS valid_to FROM vers v LEFT JOIN records__patient p ON v.record_id = p.record_id")
def exp_scd2(spark: SparkSession, d: str) -> DataFrame:
    return _star(spark, d, "patient")


@query(f"WITH {_INSTANTS} SELECT v.record_id AS patient_id, p.prop__name AS name, s.v AS status, y.v AS severity, {_TS.format('version_start')} AS valid_from, version_start AS __valid_from_ns FROM vers v LEFT JOIN records__patient p ON v.record_id = p.record_id WHERE version_start >= {LO} AND version_start < {HI}")
def exp_scd2_window(spark: SparkSession, d: str) -> DataFrame:
    raw = {"mode": "dimensional", "dimensional": {"tables": [_STAR["patient"]]}}
    return _one(clinic(spark, d), raw, "dim_patient__rows", Window(None, LO, HI, "w"))


@query(SQL["exp_scd2"])
def inc_windows_make_the_whole(spark: SparkSession, d: str) -> DataFrame:
    """Version rows of three windows together, seen through the view that supplies their ends."""
    raw = {"mode": "dimensional", "dimensional": {"tables": [_STAR["patient"]]}}
    rows = view = None
    for a, b in ((0, LO), (LO, HI), (HI, 2**62)):
        (planned,) = incremental.export_tables(clinic(spark, d), config.export(raw), None, Window(None, a, b, "w"))
        rows, view = planned.frame if rows is None else rows.unionByName(planned.frame), planned.view
    return view(rows)


@query("SELECT record_id AS patient_id, joined_sim_time AS joined, elem__slot AS slot, CASE WHEN member__doctor__kind = 'doctor' THEN member__doctor__id END AS doctor_id FROM membership__patient__visits")
def exp_fact_membership(spark: SparkSession, d: str) -> DataFrame:
    return _star(spark, d, "visit")


@query(f"SELECT record_id AS patient_id, sim_time AS at, value AS status, row_number() OVER (PARTITION BY record_id ORDER BY sim_time, record_id, value NULLS FIRST) AS nth FROM history WHERE kind = 'patient' AND property = 'status' QUALIFY sim_time >= {LO} AND sim_time < {HI}")
def exp_fact_history_window(spark: SparkSession, d: str) -> DataFrame:
    """The window's rows with the numbers they have in the whole."""
    columns = [{"name": "patient_id", "from": "record_id"}, {"name": "at", "from": "sim_time"}, {"name": "status", "from": "value"}]
    columns.append({"name": "nth", "derived": {"ordinal": {"partition_by": "patient_id", "order_by": "at"}}})
    raw = {"mode": "dimensional", "dimensional": {"tables": [{"name": "f", "role": "fact", "source": {"grain": "history_point", "kind": "patient", "property": "status"}, "key": ["patient_id", "at"], "columns": columns}]}}
    return _one(clinic(spark, d), raw, "f", Window(None, LO, HI, "w"))


@query(f"""WITH ranked AS (SELECT p.record_id AS patient, v.record_id AS holder, row_number() OVER (PARTITION BY p.record_id ORDER BY v.joined_sim_time DESC, v.record_id) AS n
        FROM records__patient p JOIN membership__patient__visits v ON v.member__doctor__kind = 'doctor' AND v.member__doctor__id = p.prop__doctor_id AND v.joined_sim_time <= p.last_mutation_sim_time AND p.last_mutation_sim_time < coalesce(v.left_sim_time, 9223372036854775807))
    SELECT p.record_id AS patient_id, r.holder AS other_id FROM records__patient p LEFT JOIN ranked r ON r.patient = p.record_id AND r.n = 1""")
def exp_fk_at_a_moment(spark: SparkSession, d: str) -> DataFrame:
    """Which patient was with a patient's doctor when the patient's record last changed: the latest visit, then the smallest id."""
    edge = {"to": "dim_other", "via": "membership", "as_of": "last_mutation_sim_time", "member_path": ["prop__doctor_id"]}
    other = {"name": "dim_other", "role": "dim", "scd": "type1", "source": {"grain": "records", "kind": "patient"}, "key": ["id"], "columns": [{"name": "id", "from": "record_id"}]}
    fact = {"name": "f", "role": "fact", "source": {"grain": "records", "kind": "patient"}, "key": ["patient_id"], "columns": [{"name": "patient_id", "from": "record_id"}, {"name": "other_id", "fk": edge}]}
    return _one(clinic(spark, d), {"mode": "dimensional", "dimensional": {"tables": [other, fact]}}, "f")


@query("SELECT p.record_id AS patient_id, v.member__doctor__id AS doctor_id FROM records__patient p LEFT JOIN membership__patient__visits v ON v.record_id = p.record_id AND v.elem__slot = 1 AND v.member__doctor__kind = 'doctor'")
def exp_fk_membership(spark: SparkSession, d: str) -> DataFrame:
    """An edge through a membership fans out, one row per interval."""
    return _star(spark, d, "owner")


@query(f"""WITH starts AS (SELECT record_id, min(sim_time) AS s FROM history WHERE kind = 'patient' AND property = 'status' AND value = 'pending' GROUP BY 1)
    SELECT h.record_id AS patient_id, h.sim_time AS at, h.value AS status, CAST(CASE h.value WHEN 'pending' THEN 1 WHEN 'active' THEN 2 END AS BIGINT) AS rank, {_TS.format('h.sim_time')} AS ts,
           (h.sim_time - st.s) / 3600000000000.0 AS hours, dr.record_id AS doctor_id, dr.prop__name AS doctor, CAST(NULL AS VARCHAR) AS pad
    FROM history h LEFT JOIN starts st ON h.record_id = st.record_id LEFT JOIN records__patient p ON h.record_id = p.record_id LEFT JOIN records__doctor dr ON p.prop__doctor_id = dr.record_id
    WHERE h.kind = 'patient' AND h.property = 'status' AND h.value IN ('active', 'discharged', 'pending')""")
def exp_fact_history(spark: SparkSession, d: str) -> DataFrame:
    return _star(spark, d, "change")


@query("SELECT record_id AS patient_id, value AS severity, sim_time AS since, lead(sim_time) OVER (PARTITION BY record_id ORDER BY sim_time, value NULLS FIRST) AS until FROM history WHERE kind = 'patient' AND property = 'severity'")
def exp_fact_interval(spark: SparkSession, d: str) -> DataFrame:
    return _star(spark, d, "interval")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id, row_number() OVER (PARTITION BY o_custkey ORDER BY date_diff('microsecond', TIMESTAMP '1995-01-01', o_orderdate), CAST(o_orderkey AS VARCHAR)) AS nth FROM orders WHERE o_orderstatus IN ('F', 'O')")
def exp_ordinal(spark: SparkSession, d: str) -> DataFrame:
    columns = [{"name": "order_id", "from": "record_id"}, {"name": "customer_id", "from": "prop__customer_id"}, {"name": "at", "from": "created_sim_time"}, {"name": "nth", "derived": {"ordinal": {"partition_by": "customer_id", "order_by": "at"}}}]
    raw = {"mode": "dimensional", "dimensional": {"tables": [{"name": "orders", "role": "fact", "source": {"grain": "records", "kind": "order", "filter": {"prop__order_type": ["F", "O"]}}, "key": ["order_id"], "columns": columns}]}}
    return _one(sales(spark, d), raw, "orders").drop("at")


# --- state and events ------------------------------------------------------

_STATE = """
    last AS (SELECT record_id, property, max_by({{'v': value}}, {{'t': sim_time, 'a': CASE WHEN value IS NULL THEN 0 ELSE 1 END, 'v': coalesce(value, '')}}).v AS v FROM history WHERE kind = 'patient' AND sim_time {0} GROUP BY ALL),
    state AS (SELECT p.record_id, p.created_sim_time, {1} AS active, {2} AS deactivated_at, p.record_index, s.v AS prop__status, TRY_CAST(y.v AS BIGINT) AS prop__severity, p.prop__name, dr.v AS prop__doctor_id
              FROM records__patient p LEFT JOIN last s ON s.record_id = p.record_id AND s.property = 'status' LEFT JOIN last y ON y.record_id = p.record_id AND y.property = 'severity' LEFT JOIN last dr ON dr.record_id = p.record_id AND dr.property = 'doctor_id'
              WHERE p.created_sim_time {0})"""


def _state(bound: str) -> str:
    return _STATE.format(bound, f"NOT coalesce(p.deactivated_at {bound}, false)", f"CASE WHEN p.deactivated_at {bound} THEN p.deactivated_at END")


_SHOWN = ["record_id", "created_sim_time", "active", "deactivated_at", "record_index", "prop__status", "prop__severity", "prop__name", "prop__doctor_id"]


@query(f"WITH {_state(f'< {T}')} SELECT * FROM state")
def der_state_at(spark: SparkSession, d: str) -> DataFrame:
    return temporal.state_at(clinic(spark, d), "patient", horizon=T).select(*_SHOWN)


@query(f"WITH {_STATE.format('IS NOT NULL', 'p.active', 'p.deactivated_at')} SELECT * FROM state")
def der_state_at_end(spark: SparkSession, d: str) -> DataFrame:
    return temporal.state_at(clinic(spark, d), "patient").select(*_SHOWN)


@query(f"SELECT record_id, joined_sim_time, left_sim_time, elem__slot, member__doctor__id FROM membership__patient__visits WHERE joined_sim_time < {T} AND (left_sim_time IS NULL OR left_sim_time >= {T})")
def der_membership_state(spark: SparkSession, d: str) -> DataFrame:
    return temporal.membership_state_at(clinic(spark, d), "patient", "visits", T).select("record_id", "joined_sim_time", "left_sim_time", "elem__slot", "member__doctor__id")


_ROWEVENTS = f"""{_INSTANTS},
    ev AS (SELECT record_id, created_sim_time AS sim_time, 'c' AS op, 0 AS op_class FROM records__patient
           UNION ALL SELECT record_id, deactivated_at, 'd', 2 FROM records__patient WHERE deactivated_at IS NOT NULL
           UNION ALL SELECT i.record_id, i.sim_time, 'u', 1 FROM inst i JOIN records__patient p ON p.record_id = i.record_id AND i.sim_time > p.created_sim_time),
    imaged AS (SELECT e.record_id, e.sim_time, e.op, e.op_class, CASE WHEN e.op <> 'd' THEN v.s.v END AS status, CASE WHEN e.op <> 'd' THEN v.y.v END AS severity, CASE WHEN e.op <> 'd' THEN p.prop__name END AS name
               FROM ev e ASOF LEFT JOIN vers v ON e.record_id = v.record_id AND e.sim_time >= v.version_start LEFT JOIN records__patient p ON p.record_id = e.record_id)"""


@query(f"WITH {_ROWEVENTS} SELECT * FROM imaged")
def der_row_events(spark: SparkSession, d: str) -> DataFrame:
    return temporal.row_events(clinic(spark, d), "patient", ["status", "severity", "name"])


_MEMBEREVENTS = """
    member AS (SELECT record_id, joined_sim_time AS sim_time, 'join' AS op, 0 AS op_class, elem__slot, member__doctor__kind, member__doctor__id FROM membership__patient__visits
               UNION ALL SELECT record_id, left_sim_time, 'leave', 1, elem__slot, member__doctor__kind, member__doctor__id FROM membership__patient__visits WHERE left_sim_time IS NOT NULL)"""


@query(f"WITH {_MEMBEREVENTS} SELECT * FROM member")
def der_membership_events(spark: SparkSession, d: str) -> DataFrame:
    return temporal.membership_events(clinic(spark, d), "patient", "visits")


@query(f"""WITH {_state(f'<= {T}')}, trail AS (SELECT record_id, max(sim_time) AS t FROM history WHERE kind = 'patient' AND sim_time <= {T} GROUP BY 1)
    SELECT s.record_id, s.created_sim_time, s.active, s.deactivated_at, greatest(s.created_sim_time, s.deactivated_at, tr.t) AS last_mutation_sim_time, s.prop__status, s.prop__severity, s.prop__doctor_id, dr.record_index AS ref_index__doctor_id
    FROM state s LEFT JOIN trail tr ON s.record_id = tr.record_id LEFT JOIN records__doctor dr ON dr.record_id = s.prop__doctor_id AND dr.created_sim_time <= {T}""")
def der_truncated_records(spark: SparkSession, d: str) -> DataFrame:
    cut = temporal.truncated(clinic(spark, d), T)
    return cut.records("patient").select("record_id", "created_sim_time", "active", "deactivated_at", "last_mutation_sim_time", "prop__status", "prop__severity", "prop__doctor_id", "ref_index__doctor_id")


@query(f"SELECT record_id, joined_sim_time, CASE WHEN left_sim_time <= {T} THEN left_sim_time END AS left_sim_time, elem__slot FROM membership__patient__visits WHERE joined_sim_time <= {T}")
def der_truncated_membership(spark: SparkSession, d: str) -> DataFrame:
    return temporal.truncated(clinic(spark, d), T).membership("patient", "visits").select("record_id", "joined_sim_time", "left_sim_time", "elem__slot")


@query(f"WITH {_MEMBEREVENTS}, edges AS (SELECT record_id, sim_time, sum(CASE op WHEN 'join' THEN 1 ELSE -1 END) AS net FROM member GROUP BY ALL) SELECT record_id, sim_time, CAST(sum(net) OVER (PARTITION BY record_id ORDER BY sim_time) AS BIGINT) AS open FROM edges")
def der_occupancy(spark: SparkSession, d: str) -> DataFrame:
    return temporal.occupancy(clinic(spark, d), "patient", "visits")


@query(f"SELECT record_id, sim_time, timezone('Europe/London', timezone('UTC', {_TS.format('sim_time')})) AS ts FROM history WHERE property = 'status'")
def fn_anchor_dst(spark: SparkSession, d: str) -> DataFrame:
    """Wall-clock times across a change of summer time."""
    return clinic(spark, d).history(properties=["status"]).select("record_id", "sim_time", temporal.anchored("sim_time", "2024-01-01 00:00:00", "Europe/London").alias("ts"))


# --- base and source exports ----------------------------------------------


@query(f"WITH {_state(f'<= {T}')} SELECT s.record_index AS patient_key, s.record_id AS id, {_TS.format('s.created_sim_time')} AS created_sim_time, s.active, {_TS.format('s.deactivated_at')} AS deactivated_at, s.prop__status, s.prop__severity, s.prop__name, s.prop__doctor_id, dr.record_index AS doctor_id_key FROM state s LEFT JOIN records__doctor dr ON dr.record_id = s.prop__doctor_id AND dr.created_sim_time <= {T}")
def exp_base_slice(spark: SparkSession, d: str) -> DataFrame:
    return _one(clinic(spark, d), {"mode": "base", "base": {"slice_at": T}}, "patient")


@query("SELECT o_orderkey AS order_key, CAST(o_orderkey AS VARCHAR) AS id, o_orderdate AS created_sim_time, o_orderstatus <> 'F' AS active, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS deactivated_at, o_orderstatus AS prop__order_type, o_orderpriority AS prop__priority, o_totalprice AS prop__total, CAST(o_custkey AS VARCHAR) AS prop__customer_id, o_custkey AS customer_id_key FROM orders")
def exp_base_current(spark: SparkSession, d: str) -> DataFrame:
    return _one(sales(spark, d), {"mode": "base"}, "order")


_SOURCE = {"mode": "source", "source": {"kind_labels": {"doctor": "physician"}, "tables": [{"name": "person", "kind": "patient", "rename": {"prop__status": "state"}}, {"name": "stay", "membership": {"kind": "patient", "property": "visits"}}], "events": {"name": "log", "sources": [{"kind": "patient", "only": ["status", "severity"], "rename": {"severity": "level"}}, {"membership": {"kind": "patient", "property": "visits"}, "item_type": "stay"}]}}}


@query(f"WITH {_STATE.format('IS NOT NULL', 'p.active', 'p.deactivated_at')} SELECT s.record_id AS id, {_TS.format('s.created_sim_time')} AS created_at, s.active, {_TS.format('s.deactivated_at')} AS deactivated_at, {_TS.format('p.last_mutation_sim_time')} AS updated_at, s.prop__status AS state, s.prop__severity AS severity, s.prop__name AS name, s.prop__doctor_id AS doctor_id FROM state s JOIN records__patient p USING (record_id)")
def exp_source_state(spark: SparkSession, d: str) -> DataFrame:
    return _one(clinic(spark, d), _SOURCE, "person")


@query(f"WITH {_state(f'< {HI}')} SELECT record_id AS id, {_TS.format('created_sim_time')} AS created_at, active, {_TS.format('deactivated_at')} AS deactivated_at, prop__status AS state, prop__severity AS severity, prop__name AS name, prop__doctor_id AS doctor_id FROM state")
def exp_source_state_window(spark: SparkSession, d: str) -> DataFrame:
    return _one(clinic(spark, d), _SOURCE, "person", Window(None, LO, HI, "w"))


@query(f"SELECT record_id AS patient_id, {_TS.format('joined_sim_time')} AS joined_at, CASE WHEN left_sim_time < {HI} THEN {_TS.format('left_sim_time')} END AS left_at, elem__slot AS slot, CASE member__doctor__kind WHEN 'doctor' THEN 'physician' ELSE member__doctor__kind END AS doctor_kind, member__doctor__id AS doctor_id FROM membership__patient__visits WHERE (joined_sim_time >= {LO} AND joined_sim_time < {HI}) OR (left_sim_time >= {LO} AND left_sim_time < {HI})")
def exp_source_junction_window(spark: SparkSession, d: str) -> DataFrame:
    return _one(clinic(spark, d), _SOURCE, "stay", Window(None, LO, HI, "w"))


_PAIR = "CASE WHEN {a} OR {o} IS DISTINCT FROM {n} THEN '\"{k}\":[' || coalesce(to_json({o})::VARCHAR, 'null') || ',' || coalesce(to_json({n})::VARCHAR, 'null') || ']' END"
_LOG = f"""{_INSTANTS.replace("'status', 'severity', 'doctor_id') GROUP", "'status', 'severity') GROUP")},
    ev AS (SELECT record_id, created_sim_time AS sim_time, 'c' AS op, 0 AS op_class FROM records__patient
           UNION ALL SELECT record_id, deactivated_at, 'd', 2 FROM records__patient WHERE deactivated_at IS NOT NULL
           UNION ALL SELECT i.record_id, i.sim_time, 'u', 1 FROM inst i JOIN records__patient p ON p.record_id = i.record_id AND i.sim_time > p.created_sim_time),
    imaged AS (SELECT e.*, CASE WHEN e.op <> 'd' THEN v.s.v END AS status, CASE WHEN e.op <> 'd' THEN v.y.v END AS severity FROM ev e ASOF LEFT JOIN vers v ON e.record_id = v.record_id AND e.sim_time >= v.version_start),
    lagged AS (SELECT *, CASE WHEN op <> 'c' THEN lag(status) OVER w END AS os, CASE WHEN op <> 'c' THEN lag(severity) OVER w END AS oy FROM imaged WINDOW w AS (PARTITION BY record_id ORDER BY sim_time, op_class)),
    changed AS (SELECT *, '{{' || concat_ws(',', {_PAIR.format(a="op <> 'u'", o='os', n='status', k='status')}, {_PAIR.format(a="op <> 'u'", o='oy', n='severity', k='level')}) || '}}' AS changes FROM lagged),
    {_MEMBEREVENTS.strip()},
    labelled AS (SELECT *, CASE member__doctor__kind WHEN 'doctor' THEN 'physician' ELSE member__doctor__kind END AS k, CAST(elem__slot AS VARCHAR) AS sl FROM member),
    arms AS (
        SELECT 'patient' AS item_type, record_id AS item_id, CASE op WHEN 'c' THEN 'create' WHEN 'u' THEN 'update' ELSE 'destroy' END AS event, sim_time, op_class, changes FROM changed WHERE op <> 'u' OR changes <> '{{}}'
        UNION ALL
        SELECT 'stay', record_id, CASE op WHEN 'join' THEN 'create' ELSE 'destroy' END, sim_time, op_class, '{{' || CASE op WHEN 'join' THEN concat_ws(',', {_PAIR.format(a='true', o='NULL', n='sl', k='slot')}, {_PAIR.format(a='true', o='NULL', n='k', k='doctor_kind')}, {_PAIR.format(a='true', o='NULL', n='member__doctor__id', k='doctor_id')})
            ELSE concat_ws(',', {_PAIR.format(a='true', o='sl', n='NULL', k='slot')}, {_PAIR.format(a='true', o='k', n='NULL', k='doctor_kind')}, {_PAIR.format(a='true', o='member__doctor__id', n='NULL', k='doctor_id')}) END || '}}' FROM labelled),
    log AS (SELECT row_number() OVER (ORDER BY sim_time, item_type, op_class, item_id, changes) AS id, * FROM arms)"""


@query(f"WITH {_LOG} SELECT id, item_type, item_id, event, {_TS.format('sim_time')} AS occurred_at, changes FROM log WHERE sim_time >= {LO} AND sim_time < {HI}")
def exp_source_log_window(spark: SparkSession, d: str) -> DataFrame:
    """The audit log of a window, with ids that count from the tape's beginning."""
    return _one(clinic(spark, d), _SOURCE, "log", Window(None, LO, HI, "w"))


@query("SELECT record_id, record_index AS shown FROM records__patient")
def exp_election(spark: SparkSession, d: str) -> DataFrame:
    """The elected identity of every patient; the ids have nothing in common with the indexes."""
    b = clinic(spark, d)
    return identities(b, elect(b.sidecar, {"patient": "record_index"}), "patient", "shown")


@query(f"SELECT record_id, record_index AS shown FROM records__doctor WHERE created_sim_time < {T}")
def exp_election_at(spark: SparkSession, d: str) -> DataFrame:
    b = clinic(spark, d)
    return identities(b, elect(b.sidecar, {"doctor": "record_index"}), "doctor", "shown", T)


@query(f"WITH {_state(f'<= {T}')} SELECT s.record_index AS id, s.prop__status, dr.record_index AS prop__doctor_id, dr.record_index AS doctor_id_key FROM state s LEFT JOIN records__doctor dr ON dr.record_id = s.prop__doctor_id AND dr.created_sim_time <= {T}")
def exp_base_elected(spark: SparkSession, d: str) -> DataFrame:
    """A past state under elected identities: a doctor who was not there yet has none."""
    raw = {"mode": "base", "base": {"slice_at": T}, "keys": {"patient": "record_index", "doctor": "record_index"}}
    return _one(clinic(spark, d), raw, "patient").select("id", "prop__status", "prop__doctor_id", "doctor_id_key")


@query("SELECT kind, property, count(*) AS rows, count(DISTINCT record_id) AS records, count(*) / count(DISTINCT record_id) AS versions_per_record FROM history WHERE kind = 'patient' GROUP BY ALL")
def agg_versions_per_record(spark: SparkSession, d: str) -> DataFrame:
    return propose.versions_per_record(clinic(spark, d), "patient")


@query("SELECT count(*) AS n, count(DISTINCT record_id) AS ids, count(DISTINCT record_index) AS shown, count(*) FILTER (record_index IS NULL) AS nulls FROM records__patient")
def agg_bijection(spark: SparkSession, d: str) -> DataFrame:
    b = clinic(spark, d)
    return key_counts(b, elect(b.sidecar, {"patient": "record_index"}), "patient")


@query("SELECT row_number() OVER (ORDER BY ts, event_id) AS seq, event_id FROM events")
def win_dense_sequence(spark: SparkSession, d: str) -> DataFrame:
    return kernels.dense_sequence(table(spark, d, "events").select("ts", "event_id"), ["ts", "event_id"], "seq").select("seq", "event_id")


@query("SELECT o_orderkey FROM orders ORDER BY (o_orderkey * 2654435761) % 4294967296 - 2147483648, o_orderkey LIMIT 1234")
def sample_exact(spark: SparkSession, d: str) -> DataFrame:
    """The 1,234 orders that come first in a scrambled order, drawn without gathering or ordering all."""
    units = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 2654435761 % 4294967296 - 2147483648).alias("_o"))
    return kernels.smallest(units, "_o", 1234, ["o_orderkey"]).select("o_orderkey")


# --- streams and playback ---------------------------------------------------

_STREAMS = {"content": "state-changes", "debezium": {"schemas_enable": False, "source": {"connector": "postgres", "name": "clinic", "db": "clinic", "schema": "public", "version": "1.0"}}, "streams": [{"name": "people", "kind": "patient", "properties": ["status", "severity", "name"]}]}
_SEQ = "seqd AS (SELECT row_number() OVER (ORDER BY sim_time, op_class, record_id) AS seq, * FROM imaged)"


@query(f"WITH {_ROWEVENTS}, {_SEQ} SELECT seq, op, record_id, sim_time, CASE WHEN op <> 'd' THEN to_json({{'record_id': record_id, 'prop__status': status, 'prop__severity': severity, 'prop__name': name}})::VARCHAR END AS after FROM seqd")
def str_state_changes(spark: SparkSession, d: str) -> DataFrame:
    return ev.events(clinic(spark, d), config.streams(_STREAMS)).select("seq", "op", "record_id", "sim_time", "after")


@query(f"""WITH {_ROWEVENTS}, {_SEQ} SELECT seq, 'people' AS topic, sim_time, to_json({{'seq': seq, 'op': op, 'ts': strftime({_TS.format('sim_time')}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN sim_time // 1000 % 1000000 = 0 THEN '' ELSE strftime({_TS.format('sim_time')}, '.%f') END || '+00:00', 'kind': 'patient', 'key': {{'record_id': record_id}},
    'after': CASE WHEN op <> 'd' THEN {{'record_id': record_id, 'prop__status': status, 'prop__severity': severity, 'prop__name': name}} END}})::VARCHAR AS value FROM seqd""")
def str_jsonl(spark: SparkSession, d: str) -> DataFrame:
    b, c = clinic(spark, d), config.streams(_STREAMS)
    return ev.jsonl(ev.events(b, c), ev.stream_anchor(b, c))


@query(f"""WITH {_ROWEVENTS}, {_SEQ}, t AS (SELECT *, 1704067200000 + sim_time // 1000000 AS ms FROM seqd)
    SELECT seq, 'people' AS topic, sim_time, to_json({{'before': CASE WHEN op = 'd' THEN {{'record_id': record_id}} END, 'after': CASE WHEN op <> 'd' THEN {{'record_id': record_id, 'prop__status': status, 'prop__severity': severity, 'prop__name': name}} END,
    'source': {{'version': '1.0', 'connector': 'postgres', 'name': 'clinic', 'ts_ms': ms, 'snapshot': 'false', 'db': 'clinic', 'sequence': '[null,"' || seq || '"]', 'schema': 'public', 'table': 'patient', 'txId': NULL, 'lsn': seq}}, 'op': op, 'ts_ms': ms, 'transaction': NULL}})::VARCHAR AS value FROM t""")
def str_debezium(spark: SparkSession, d: str) -> DataFrame:
    b, c = clinic(spark, d), config.streams(_STREAMS)
    return ev.debezium(b, ev.events(b, c), c, ev.stream_anchor(b, c))


@query(f"WITH {_MEMBEREVENTS}, t AS (SELECT *, to_json({{'record_id': record_id, 'elem__slot': CAST(elem__slot AS VARCHAR), 'member__doctor__kind': member__doctor__kind, 'member__doctor__id': member__doctor__id}})::VARCHAR AS after FROM member) SELECT row_number() OVER (ORDER BY sim_time, op_class, record_id, after) AS seq, op, record_id, after FROM t")
def str_membership_events(spark: SparkSession, d: str) -> DataFrame:
    c = config.streams({"content": "membership-events", "streams": [{"name": "visits", "membership": {"kind": "patient", "property": "visits"}, "fields": ["slot", "doctor"]}]})
    return ev.events(clinic(spark, d), c).select("seq", "op", "record_id", "after")


_VISITS = {"content": "membership-events", "debezium": {"schemas_enable": True, "source": _STREAMS["debezium"]["source"]}, "streams": [{"name": "visits", "membership": {"kind": "patient", "property": "visits"}, "fields": ["slot", "doctor"]}]}
_FIELDS = ", ".join(f'{{"type":"string","optional":true,"field":"{f}"}}' for f in ("event", "record_id", "elem__slot", "member__doctor__kind", "member__doctor__id")).replace(", ", ",")
_SOURCE_FIELDS = ",".join(f'{{"type":"{t}","optional":{o},"field":"{n}"}}' for n, t, o in (
    ("version", "string", "false"), ("connector", "string", "false"), ("name", "string", "false"), ("ts_ms", "int64", "false"), ("snapshot", "string", "true"), ("db", "string", "false"),
    ("sequence", "string", "true"), ("schema", "string", "true"), ("table", "string", "true"), ("txId", "int64", "true"), ("lsn", "int64", "true"),
))
_ENVELOPE = f"""{{"type":"struct","fields":[{{"type":"struct","fields":[{_FIELDS}],"optional":true,"name":"clinic.patient__visits.Value","field":"before"}},{{"type":"struct","fields":[{_FIELDS}],"optional":true,"name":"clinic.patient__visits.Value","field":"after"}},{{"type":"struct","fields":[{_SOURCE_FIELDS}],"optional":false,"name":"io.debezium.connector.postgres.Source","field":"source"}},{{"type":"string","optional":false,"field":"op"}},{{"type":"int64","optional":true,"field":"ts_ms"}},{{"type":"struct","fields":[{{"type":"string","optional":false,"field":"id"}},{{"type":"int64","optional":false,"field":"total_order"}},{{"type":"int64","optional":false,"field":"data_collection_order"}}],"optional":true,"name":"event.block","field":"transaction"}}],"optional":false,"name":"clinic.patient__visits.Envelope"}}"""


def _visit_messages(spark: SparkSession, d: str) -> DataFrame:
    b, c = clinic(spark, d), config.streams(_VISITS)
    return ev.debezium(b, ev.events(b, c), c, ev.stream_anchor(b, c))


@query(f"SELECT 'visits' AS topic, '{_ENVELOPE}' AS schema, count(*) AS messages FROM (SELECT unnest([joined_sim_time, left_sim_time]) AS t FROM membership__patient__visits) WHERE t IS NOT NULL")
def str_debezium_schema(spark: SparkSession, d: str) -> DataFrame:
    """The schema every message of a topic carries, with how many do."""
    schema = F.regexp_extract("value", r'^\{"schema":(.*),"payload":', 1)
    return _visit_messages(spark, d).groupBy("topic", schema.alias("schema")).agg(F.count(F.lit(1)).alias("messages"))


@query(f"""WITH {_MEMBEREVENTS}, a AS (SELECT *, to_json({{'record_id': record_id, 'elem__slot': CAST(elem__slot AS VARCHAR), 'member__doctor__kind': member__doctor__kind, 'member__doctor__id': member__doctor__id}})::VARCHAR AS after FROM member),
    t AS (SELECT *, row_number() OVER (ORDER BY sim_time, op_class, record_id, after) AS seq, 1704067200000 + sim_time // 1000000 AS ms FROM a)
    SELECT seq, to_json({{'before': NULL, 'after': {{'event': op, 'record_id': record_id, 'elem__slot': CAST(elem__slot AS VARCHAR), 'member__doctor__kind': member__doctor__kind, 'member__doctor__id': member__doctor__id}},
    'source': {{'version': '1.0', 'connector': 'postgres', 'name': 'clinic', 'ts_ms': ms, 'snapshot': 'false', 'db': 'clinic', 'sequence': '[null,"' || seq || '"]', 'schema': 'public', 'table': 'patient__visits', 'txId': NULL, 'lsn': seq}}, 'op': 'c', 'ts_ms': ms, 'transaction': NULL}})::VARCHAR AS payload FROM t""")
def str_membership_debezium(spark: SparkSession, d: str) -> DataFrame:
    payload = F.regexp_extract("value", r'"payload":(.*)\}$', 1)
    return _visit_messages(spark, d).select("seq", payload.alias("payload"))


@query(f"""WITH {_ROWEVENTS}, docs AS (SELECT record_id, created_sim_time AS sim_time, 'c' AS op, 0 AS op_class FROM records__doctor UNION ALL SELECT record_id, deactivated_at, 'd', 2 FROM records__doctor WHERE deactivated_at IS NOT NULL),
    both_ AS (SELECT 'doctors' AS topic, * FROM docs UNION ALL SELECT 'people', record_id, sim_time, op, op_class FROM imaged)
    SELECT row_number() OVER (ORDER BY sim_time, op_class, topic, record_id) AS seq, topic, op, record_id FROM both_""")
def str_two_topics(spark: SparkSession, d: str) -> DataFrame:
    """One order over the events of several topics."""
    c = config.streams({**_STREAMS, "streams": [*_STREAMS["streams"], {"name": "doctors", "kind": "doctor", "properties": ["name"]}]})
    return ev.events(clinic(spark, d), c).select("seq", "topic", "op", "record_id")


@query(f"WITH {_ROWEVENTS} SELECT 'people' AS topic, count(*) AS events FROM imaged")
def str_topic_counts(spark: SparkSession, d: str) -> DataFrame:
    c = config.streams(_STREAMS)
    return ev.topic_counts(ev.merged(clinic(spark, d), c), c)


@query(f"WITH {_ROWEVENTS}, {_SEQ} SELECT seq, op, record_id FROM seqd WHERE sim_time >= {LO} AND sim_time < {HI}")
def ply_events(spark: SparkSession, d: str) -> DataFrame:
    return Playback(clinic(spark, d), [Atom("patient")]).events(LO, HI).select("seq", "op", "record_id")


@query(f"WITH {_state(f'< {T + 1}')} SELECT record_id, active, prop__status, prop__severity FROM state")
def ply_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return Playback(clinic(spark, d), [Atom("patient")]).snapshot(T)["patient"].select("record_id", "active", "prop__status", "prop__severity")


@query(SQL["exp_base_slice"])
def ply_shaped_state(spark: SparkSession, d: str) -> DataFrame:
    """A whole flat export of the tape as it was at a moment equals the flat export at that moment."""
    planned = Playback(clinic(spark, d), [Atom("patient")]).shaped_state(config.export({"mode": "base"}), T)
    return next(t for t in planned if t.name == "patient").frame


def _stream(spark: SparkSession, d: str, delay: str = "1 hour") -> DataFrame:
    schema = table(spark, d, "events").schema
    return live.event_time(live.replay(spark, d, "events", schema), "ts", delay)


_AGG = "count(*) AS events, round(sum(value), 4) AS total"


@query(f"SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, {_AGG} FROM events GROUP BY ALL")
def live_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return live.run(live.tumbling(_stream(spark, d), "ts", "1 hour", ["event_type"]), "tumbling", "complete")


@query(f"""WITH w AS (SELECT date_trunc('hour', ts) AS a, * FROM events), mark AS (SELECT max(ts) - INTERVAL 1 HOUR AS m FROM events)
    SELECT a AS window_start, a + INTERVAL 1 HOUR AS window_end, event_type, {_AGG} FROM w, mark WHERE a + INTERVAL 1 HOUR <= m GROUP BY ALL""")
def live_closed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Append mode: only windows that the watermark has closed."""
    return live.run(live.tumbling(_stream(spark, d), "ts", "1 hour", ["event_type"]), "closed")


@query(f"WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - n * INTERVAL 30 MINUTE AS a, e.* FROM events e, (SELECT unnest([0, 1]) AS n)) SELECT a AS window_start, a + INTERVAL 1 HOUR AS window_end, {_AGG} FROM w GROUP BY ALL")
def live_sliding(spark: SparkSession, d: str) -> DataFrame:
    return live.run(live.sliding(_stream(spark, d), "ts", "1 hour", "30 minutes", []), "sliding", "complete")


@query(f"""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT min(ts) AS window_start, max(ts) + INTERVAL 2 HOUR AS window_end, user_id, {_AGG} FROM n GROUP BY user_id, s""")
def live_sessions(spark: SparkSession, d: str) -> DataFrame:
    return live.run(live.sessions(_stream(spark, d), "ts", "2 hours", ["user_id"]), "sessions", "complete")


@query("SELECT DISTINCT event_id, user_id FROM events")
def live_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """Every event delivered twice, kept once."""
    twice = _stream(spark, d).select("ts", "event_id", "user_id")
    return live.run(live.deduplicated(twice.unionByName(_stream(spark, d).select("ts", "event_id", "user_id")), ["event_id"]), "deduplicated").select("event_id", "user_id")


@query("SELECT a.event_id AS purchase, b.event_id AS click FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'click' AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 6 HOUR WHERE a.event_type = 'purchase'")
def live_joined(spark: SparkSession, d: str) -> DataFrame:
    purchases = _stream(spark, d).where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase"))
    clicks = _stream(spark, d).where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click"))
    return live.run(live.joined(purchases, clicks, "ts", "ts", ["user_id"], "6 hours"), "joined").select("purchase", "click")


# --- conformance -------------------------------------------------------------

_LASTC6 = "last AS (SELECT kind, record_id, property, max_by({'v': value}, {'t': sim_time, 'a': CASE WHEN value IS NULL THEN 0 ELSE 1 END, 'v': coalesce(value, '')}).v AS v FROM history WHERE kind = 'patient' AND property IN ('status', 'severity', 'doctor_id') AND sim_time <= 15552000000000000 GROUP BY ALL), cells AS (SELECT record_id, 'status' AS property, prop__status AS v FROM records__patient UNION ALL SELECT record_id, 'severity', CAST(prop__severity AS VARCHAR) FROM records__patient UNION ALL SELECT record_id, 'doctor_id', prop__doctor_id FROM records__patient)"


@query(f"WITH {_LASTC6} SELECT l.kind, l.record_id, l.property FROM last l LEFT JOIN cells c USING (record_id, property) WHERE c.record_id IS NULL OR c.v IS DISTINCT FROM l.v")
def con_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return conformance.round_trip(clinic(spark, d))


@query("SELECT 'records__' || k AS \"table\", record_id, 'deactivated_at' AS field FROM (SELECT 'patient' AS k, * FROM (SELECT record_id, active, deactivated_at FROM records__patient) UNION ALL SELECT 'doctor', record_id, active, deactivated_at FROM records__doctor UNION ALL SELECT 'queue', record_id, active, deactivated_at FROM records__queue) WHERE (deactivated_at IS NULL) <> coalesce(active, false) UNION ALL SELECT 'membership__patient__visits', record_id, 'doctor' FROM membership__patient__visits WHERE (member__doctor__kind IS NULL) <> (member__doctor__id IS NULL)")
def con_null_groups(spark: SparkSession, d: str) -> DataFrame:
    return conformance.null_groups(clinic(spark, d))


@query("SELECT 'membership__patient__visits' AS \"table\", record_id, NULL AS field, NULL AS member FROM membership__patient__visits WHERE left_sim_time < joined_sim_time UNION ALL SELECT 'membership__patient__visits', record_id, 'doctor', member__doctor__id FROM membership__patient__visits v WHERE member__doctor__kind IS NOT NULL AND member__doctor__id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT 'doctor' AS k, record_id AS i FROM records__doctor UNION ALL SELECT 'patient', record_id FROM records__patient UNION ALL SELECT 'queue', record_id FROM records__queue) r WHERE r.k = v.member__doctor__kind AND r.i = v.member__doctor__id)")
def con_intervals(spark: SparkSession, d: str) -> DataFrame:
    return conformance.intervals(clinic(spark, d))


@query("SELECT DISTINCT kind, property FROM history WHERE NOT (kind = 'patient' AND property IN ('status', 'severity', 'doctor_id'))")
def con_pairs(spark: SparkSession, d: str) -> DataFrame:
    return conformance.pairs(clinic(spark, d))


@query("SELECT 'patient' AS kind, p.record_id, x.property FROM records__patient p, (SELECT unnest(['status', 'severity', 'doctor_id']) AS property) x WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.kind = 'patient' AND h.record_id = p.record_id AND h.property = x.property AND h.sim_time = p.created_sim_time)")
def con_genesis(spark: SparkSession, d: str) -> DataFrame:
    return conformance.genesis(clinic(spark, d))


# --- wrong values and corruption ---------------------------------------------


@query("""SELECT p_partkey, upper(p_name) AS upper, ' ' || p_name AS padded, p_name || ' ' AS trailing, left(p_name, 4) AS short, round_even(p_retailprice, 1) AS coarse, p_retailprice * 100.0 AS scaled,
    CASE WHEN length(CAST(p_partkey + 10000 AS VARCHAR)) > 3 THEN regexp_replace(CAST(p_partkey + 10000 AS VARCHAR), '^(\\d+)(\\d{3})$', '\\1,\\2') END AS commas, CASE WHEN p_name IS NULL THEN NULL ELSE 'N/A' END AS sentinel FROM part""")
def fn_mutations(spark: SparkSession, d: str) -> DataFrame:
    m, seed, name, price = mutations.mutate, F.xxhash64("p_partkey"), F.col("p_name"), F.col("p_retailprice")
    return table(spark, d, "part").select(
        "p_partkey", m("case", name, "VARCHAR", seed, form="upper").alias("upper"), m("whitespace", name, "VARCHAR", seed, where="leading").alias("padded"), m("whitespace", name, "VARCHAR", seed, where="trailing").alias("trailing"),
        m("truncate", name, "VARCHAR", seed, max_length=4).alias("short"), m("precision_drop", price, "DOUBLE", seed, digits=1).alias("coarse"), m("scale", price, "DOUBLE", seed, factor=100.0).alias("scaled"),
        m("format_dirt", (F.col("p_partkey") + 10000).cast("string"), "VARCHAR", seed).alias("commas"), m("sentinel", name, "VARCHAR", seed, value="N/A").alias("sentinel"),
    )


def _corrupted(spark: SparkSession, d: str, bundle, *operations: dict) -> tuple:
    from tidelog.operators import corrupt

    return corrupt.corrupt(bundle(spark, d), {"seed": 7, "operations": list(operations)}, check_source=False)




_CELLS = "CAST(floor(0.1 * (SELECT count(*) FROM customer) * 2) AS BIGINT)"
_TWICE, _GONE = "CAST(floor(0.05 * (SELECT count(*) FROM orders)) AS BIGINT)", "CAST(floor(0.02 * (SELECT count(*) FROM part)) AS BIGINT)"
_SPOILT = (
    {"kind": "null_cells", "target": {"table": "records__customer", "columns": ["prop__name", "prop__mktsegment"]}, "amount": {"rate": 0.1}},
    {"kind": "duplicate_rows", "target": {"table": "records__order"}, "amount": {"rate": 0.05}},
    {"kind": "delete_rows", "target": {"table": "records__part"}, "amount": {"rate": 0.02}},
    {"kind": "insert_rows", "target": {"table": "records__part"}, "amount": {"count": 9}},
    {"kind": "dangle_reference", "target": {"table": "records__order", "columns": ["prop__customer_id"]}, "amount": {"count": 11}},
)


@query(f"SELECT 'missing_value' AS class, {_CELLS} AS n UNION ALL SELECT 'duplicate_row', {_TWICE} UNION ALL SELECT 'phantom_row', 9 UNION ALL SELECT 'dangling_reference', 11 UNION ALL SELECT 'deleted_row', {_GONE}")
def cor_records(spark: SparkSession, d: str) -> DataFrame:
    """Exact amounts: as many defects as the operations declare."""
    _, defects = _corrupted(spark, d, sales, *_SPOILT)
    return defects.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT 'cells newly null' AS what, {_CELLS} AS n UNION ALL SELECT 'other cells changed', 0 UNION ALL SELECT 'orders', (SELECT count(*) FROM orders) + {_TWICE}
    UNION ALL SELECT 'orders without a customer', 11 UNION ALL SELECT 'parts missing', {_GONE} UNION ALL SELECT 'parts made up', 9 UNION ALL SELECT 'lines', (SELECT count(*) FROM lineitem)""")
def cor_effects(spark: SparkSession, d: str) -> DataFrame:
    """What the defects did to the tables themselves: rows and cells before and after, compared."""
    before = sales(spark, d)
    after, _ = _corrupted(spark, d, sales, *_SPOILT)
    was = before.records("customer").select("record_id", *(F.col(c).alias(f"_{c}") for c in ("prop__name", "prop__mktsegment", "prop__nation_id")))
    both = after.records("customer").join(was, "record_id")
    lost = sum((F.col(c).isNull() & F.col(f"_{c}").isNotNull()).cast("long") for c in ("prop__name", "prop__mktsegment"))
    other = sum((F.col(c).isNotNull() & (F.col(c) != F.col(f"_{c}"))).cast("long") for c in ("prop__name", "prop__mktsegment")) + (~F.col("prop__nation_id").eqNullSafe(F.col("_prop__nation_id"))).cast("long")
    said = lambda what, df, n=F.count(F.lit(1)): df.agg(n.cast("long").alias("n")).select(F.lit(what).alias("what"), "n")
    parts, now = before.records("part").select("record_id"), after.records("part").select("record_id")
    stray = after.records("order").join(before.records("customer").select(F.col("record_id").alias("_id")), F.col("prop__customer_id") == F.col("_id"), "left_anti").where("prop__customer_id is not null")
    out = said("cells newly null", both, F.sum(lost))
    for part in (
        said("other cells changed", both, F.sum(other)), said("orders", after.records("order")), said("orders without a customer", stray.select("record_id", "prop__customer_id").distinct()),
        said("parts missing", parts.join(now, "record_id", "left_anti")), said("parts made up", now.join(parts, "record_id", "left_anti")), said("lines", after.membership("order", "lines")),
    ):
        out = out.unionByName(part)
    return out


@query("""SELECT 'rows' AS what, count(*) - CAST(floor(0.03 * count(*)) AS BIGINT) AS n FROM history UNION ALL SELECT 'rows that were not there', 0""")
def cor_history(spark: SparkSession, d: str) -> DataFrame:
    """Dropped events: the declared share is gone, and what is left was there before, counted with its repeats."""
    after, _ = _corrupted(spark, d, clinic, {"kind": "drop_events", "target": {"table": "history"}, "amount": {"rate": 0.03}})
    left = after.history()
    fresh = left.exceptAll(clinic(spark, d).history().select(*left.columns))
    return left.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows").alias("what"), "n").unionByName(fresh.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows that were not there").alias("what"), "n"))


@query()
def cor_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Temporal and interval defects with the checks each breaks; what is drawn is defined by a hash, so there is no SQL."""
    _, defects = _corrupted(
        spark, d, clinic,
        {"kind": "shift_sim_time", "target": {"table": "history"}, "amount": {"rate": 0.02}, "shift": {"kind": "offset", "distribution": {"shape": "normal", "mean": 0, "stddev": 1e12}}},
        {"kind": "shift_sim_time", "target": {"table": "history"}, "amount": {"rate": 0.02}, "shift": {"kind": "swap"}},
        {"kind": "freeze_series", "target": {"table": "history"}, "amount": {"count": 20}, "cut": "after_first"},
        {"kind": "distort_intervals", "target": {"table": "membership__patient__visits"}, "amount": {"rate": 0.02}, "mode": "left_before_join"},
        {"kind": "mutate_cells", "target": {"table": "history", "columns": ["value"]}, "amount": {"rate": 0.01}, "mutation": {"kind": "typo"}, "placement": {"kind": "entity_scoped", "entities": {"rate": 0.3}}},
    )
    return defects.select("id", "class", "table", "record_id", "before", "after", F.array_join("impact", ",").alias("impact"))


@query()
def cor_mispointed(spark: SparkSession, d: str) -> DataFrame:
    """References to another record that exists, here one created only after the reference was made."""
    _, defects = _corrupted(spark, d, clinic, {"kind": "mispoint_reference", "target": {"table": "membership__patient__visits", "columns": ["member__doctor__id"]}, "amount": {"rate": 0.05}, "constraint": "created_after_reference"})
    return defects.select("id", "record_id", "before", "after", F.array_join("impact", ",").alias("impact"))


