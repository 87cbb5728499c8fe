"""The driver's tables as bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources.bundle import HISTORY, VERSION, Bundle, Sidecar, declared_type
from tidelog.sources.tables import table

DAY180 = 15_552_000_000_000_000
_LIFE = "created_sim_time active deactivated_at last_mutation_sim_time record_index".split()


def _declare(frame: DataFrame, name: str, category: str, facts: dict[str, dict] | None = None, **more) -> dict:
    facts = facts or {}
    columns = [{"name": f.name, "type": declared_type(f.dataType), **facts.get(f.name, {})} for f in frame.schema.fields]
    return {"name": name, "category": category, "columns": columns, **more}


CONSTANT = {"history_tracked": False, "temporal_class": "constant"}
TRACKED = {"history_tracked": True, "temporal_class": "tracked"}


def clinic(spark: SparkSession, d: str) -> Bundle:
    """Patients, doctors, queues, their history and the patients' visits."""
    frames = {n: table(spark, d, n) for n in ("history", "records__patient", "records__doctor", "records__queue", "membership__patient__visits")}
    frames["history"] = frames["history"].select(*HISTORY)
    patient = {"prop__status": TRACKED, "prop__severity": TRACKED, "prop__name": CONSTANT, "prop__doctor_id": {**TRACKED, "references": "doctor"}}
    tables = [_declare(frames["history"], "history", "fixed")]
    for kind, facts in (("patient", patient), ("doctor", {"prop__name": CONSTANT}), ("queue", {"prop__name": CONSTANT})):
        tables.append(_declare(frames[f"records__{kind}"], f"records__{kind}", "records", facts, record_kind=kind))
    visits = frames["membership__patient__visits"].drop("row_seq")
    frames["membership__patient__visits"] = visits
    tables.append(_declare(visits, "membership__patient__visits", "membership", record_kind="patient", property="visits"))
    raw = {
        "base_format_version": VERSION, "branches": [{"fork_path": "trunk", "parent": None, "slice_at": DAY180}],
        "runtime": {"timezone": "UTC", "start_datetime": "2024-01-01T00:00:00"}, "tables": tables,
        "record_roles": {"patient": "dimension", "doctor": "dimension", "queue": "dimension"},
    }
    return Bundle(spark, Sidecar.parse(raw), frames.__getitem__)


def _ns(time: str, origin: str):
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{origin}', {time}) * 1000")


def sales(spark: SparkSession, d: str) -> Bundle:
    """Orders (sub-types by status) of customers of nations of regions, and the orders' lines as intervals."""
    origin = "1995-01-01 00:00:00"
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")

    def records(rows: DataFrame, key: str, created, index, props: dict, gone=None) -> DataFrame:
        made = rows.select(
            F.lit("trunk").alias("fork_path"), F.col(key).cast("string").alias("record_id"), created.cast("long").alias("created_sim_time"),
            (F.lit(True) if gone is None else gone.isNull()).alias("active"), (F.lit(None) if gone is None else gone).cast("long").alias("deactivated_at"),
            created.cast("long").alias("last_mutation_sim_time"), index.cast("long").alias("record_index"), *(c.alias(n) for n, c in props.items()),
        )
        return made

    zero = F.lit(0)
    text = lambda c: F.col(c).cast("string")
    time = _ns("o_orderdate", origin)
    frames = {
        "records__region": records(table(spark, d, "region"), "r_regionkey", zero, F.col("r_regionkey"), {"prop__name": F.col("r_name")}),
        "records__nation": records(table(spark, d, "nation"), "n_nationkey", zero, F.col("n_nationkey"), {"prop__name": F.col("n_name"), "prop__region_id": text("n_regionkey"), "ref_index__region_id": F.col("n_regionkey").cast("long")}),
        "records__customer": records(table(spark, d, "customer"), "c_custkey", zero, F.col("c_custkey"), {"prop__name": F.col("c_name"), "prop__mktsegment": F.col("c_mktsegment"), "prop__nation_id": text("c_nationkey"), "ref_index__nation_id": F.col("c_nationkey").cast("long")}),
        "records__order": records(orders, "o_orderkey", time, F.col("o_orderkey"), {"prop__order_type": F.col("o_orderstatus"), "prop__priority": F.col("o_orderpriority"), "prop__total": F.col("o_totalprice"), "prop__customer_id": text("o_custkey"), "ref_index__customer_id": F.col("o_custkey")}, F.when(F.col("o_orderstatus") == "F", time)),
        "history": spark.createDataFrame([], "fork_path string, kind string, record_id string, property string, sim_time long, value string"),
    }
    held = lines.join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    a, b = F.least("o_orderdate", "l_shipdate"), F.greatest("o_orderdate", "l_shipdate")
    held = held.select("*", a.alias("_a"), b.alias("_b"))
    frames["membership__order__lines"] = held.select(
        F.lit("trunk").alias("fork_path"), text("l_orderkey").alias("record_id"), _ns("_a", origin).alias("joined_sim_time"), _ns("_b", origin).alias("left_sim_time"),
        F.col("l_quantity").alias("elem__quantity"), F.col("l_returnflag").alias("elem__returnflag"), F.lit("part").alias("member__part__kind"), text("l_partkey").alias("member__part__id"),
    )
    parts = table(spark, d, "part")
    frames["records__part"] = records(parts, "p_partkey", zero, F.col("p_partkey"), {"prop__name": F.col("p_name"), "prop__brand": F.col("p_brand"), "prop__size": F.col("p_size")})
    ref = lambda kind: {**CONSTANT, "references": kind}
    facts = {
        "region": {"prop__name": CONSTANT}, "nation": {"prop__name": CONSTANT, "prop__region_id": ref("region")},
        "customer": {"prop__name": CONSTANT, "prop__mktsegment": CONSTANT, "prop__nation_id": ref("nation")},
        "order": {"prop__order_type": CONSTANT, "prop__priority": CONSTANT, "prop__total": CONSTANT, "prop__customer_id": ref("customer")},
        "part": {"prop__name": CONSTANT, "prop__brand": CONSTANT, "prop__size": CONSTANT},
    }
    tables = [_declare(frames["history"], "history", "fixed")]
    tables += [_declare(frames[f"records__{k}"], f"records__{k}", "records", f, record_kind=k) for k, f in facts.items()]
    tables.append(_declare(frames["membership__order__lines"], "membership__order__lines", "membership", record_kind="order", property="lines"))
    raw = {
        "base_format_version": VERSION, "branches": [{"fork_path": "trunk", "parent": None, "slice_at": 400_000_000_000_000_000}],
        "runtime": {"timezone": "UTC", "start_datetime": "1995-01-01T00:00:00"}, "tables": tables,
        "enum_domains": {"order": {"order_type": ["F", "O", "P"]}},
    }
    return Bundle(spark, Sidecar.parse(raw), frames.__getitem__)
