"""The queries of the general training-data problems, over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import asof, cdc, history, incremental, intervals, orphans
from tidelog.sources.shared import fresh_folder
from tidelog.sources.tables import table

PLACE = ["record_id", "member__patient__id"]
ATTRIBUTES = ["status", "severity"]
#: Changes in a bucket of the waiting lists, about.
BUCKET_ROWS, FILE_ROWS = 100_000, 1_000_000
#: The manifest names every bucket, so they are not more than this.
MOST_BUCKETS = 4_096
#: Cells of the export windows: half a day.
CELL = 43_200_000_000_000


def waiting_lists(spark: SparkSession, d: str, slices: int) -> cdc.BucketedTable:
    """The feed of the waiting lists, applied in batches by order of arrival."""
    feed = table(spark, d, "membership_events").select(*PLACE, "event_sim_time", cdc.change_class("event_class", "op").alias("cls"), "change_id", "arrival_seq")
    first, last, n = feed.agg(F.min("arrival_seq"), F.max("arrival_seq"), F.count(F.lit(1))).first()
    buckets = max(8, min(MOST_BUCKETS, n // BUCKET_ROWS))
    files = max(2, n // buckets // FILE_ROWS)
    lists = cdc.BucketedTable(spark, fresh_folder(spark, "waiting-lists"), feed.schema, PLACE, "change_id", "arrival_seq", buckets=buckets, files=files)
    if first is None:
        if n:  # no delivery has an arrival_seq
            lists.apply(feed)
        return lists
    borders = [first + (last - first + 1) * i // slices for i in range(slices + 1)]
    for lo, hi in zip(borders, borders[1:], strict=False):
        late = F.col("arrival_seq").isNull() if lo == first else F.lit(False)
        lists.apply(feed.where(late | ((F.col("arrival_seq") >= lo) & (F.col("arrival_seq") < hi))))
    return lists


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return waiting_lists(spark, d, 2).read().select(*PLACE, "change_id")


def p1_queue_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Patients waiting per queue, from the table after one batch."""
    return waiting_lists(spark, d, 1).read().groupBy("record_id").agg(F.count(F.lit(1)).alias("waiting"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    ends = None
    for kind in ("patient", "queue"):
        one = table(spark, d, f"records__{kind}").select(F.lit(kind).alias("kind"), "record_id", F.col("deactivated_at").alias("ended_at"))
        ends = one if ends is None else ends.unionByName(one)
    rows = table(spark, d, "history").where(~F.col("property").eqNullSafe(F.lit("profile")))
    return history.versions(rows, ends)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _versions(spark, d).select("kind", "record_id", "property", "valid_from", "valid_to")


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """The versions with their values."""
    return _versions(spark, d)


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    named = lambda src, field: (F.lit(src).alias("src"), F.lit(field).alias("ref_field"))
    h = table(spark, d, "history").select(*named("history", "record_id"), F.col("row_seq").alias("row_key"), F.col("kind").alias("ref_kind"), F.col("record_id").alias("ref_id"), F.col("sim_time").alias("ref_time"))
    visits, v = table(spark, d, "membership__patient__visits"), "membership__patient__visits"
    owner = visits.select(*named(v, "record_id"), F.col("row_seq").alias("row_key"), F.lit("patient").alias("ref_kind"), F.col("record_id").alias("ref_id"), F.col("joined_sim_time").alias("ref_time"))
    member = visits.select(*named(v, "member__doctor__id"), F.col("row_seq").alias("row_key"), F.col("member__doctor__kind").alias("ref_kind"), F.col("member__doctor__id").alias("ref_id"), F.col("joined_sim_time").alias("ref_time"))
    p = table(spark, d, "records__patient").select(*named("records__patient", "prop__doctor_id"), F.col("record_index").alias("row_key"), F.lit("doctor").alias("ref_kind"), F.col("prop__doctor_id").alias("ref_id"), F.col("last_mutation_sim_time").alias("ref_time"))
    parents = None
    for kind in ("patient", "doctor", "queue"):
        one = table(spark, d, f"records__{kind}").select(F.lit(kind).alias("kind"), "record_id", F.col("created_sim_time").alias("created_at"), F.col("deactivated_at").alias("ended_at"))
        parents = one if parents is None else parents.unionByName(one)
    return h.unionByName(owner).unionByName(member).unionByName(p), parents


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(*_references(spark, d))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(p3_found(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """What the next run of each feed processes: published as a new version of the target, and read from it."""
    meta = table(spark, d, "export_meta")
    feeds = F.broadcast(meta.select("feed").distinct())  # one row per feed of the configuration
    source = table(spark, d, "history").where(F.col("kind") == "patient").join(feeds, F.col("property") == F.col("feed"))
    source = source.select("feed", "record_id", "sim_time", incremental.key_text("value").alias("value"), "known_sim_time", "row_seq")
    keys = ["feed", "record_id", "sim_time", "value"]
    target = incremental.Target(spark, fresh_folder(spark, "export-target"), source.select(*keys, "row_seq").schema, keys, "row_seq")
    target.publish(incremental.exported(source, table(spark, d, "export_windows"), meta, CELL))
    return target.publish(target.due(source)).select("feed", "row_seq")


def _visits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "membership__patient__visits").select("record_id", F.col("joined_sim_time").alias("event_time"), F.col("row_seq").alias("event_seq"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    changes = table(spark, d, "history").where(F.col("kind") == "patient")
    found = asof.attributes_at(_visits(spark, d), changes, ATTRIBUTES)
    return found.select(F.col("event_seq").alias("visit_seq"), "property", F.col("change_seq").alias("history_seq"))


def p5_wide(spark: SparkSession, d: str) -> DataFrame:
    """Every visit with the status and severity known when it began."""
    visits, changes = _visits(spark, d), table(spark, d, "history").where(F.col("kind") == "patient")
    wide = asof.attributes_wide(visits, asof.attributes_at(visits, changes, ATTRIBUTES), ATTRIBUTES)
    return wide.withColumnRenamed("event_seq", "visit_seq")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    visits = table(spark, d, "membership__patient__visits")
    return intervals.periods_and_gaps(visits.select("record_id", F.col("joined_sim_time").alias("start_ns"), F.col("left_sim_time").alias("end_ns")))


QUERIES = {f.__name__: f for f in (p1_found, p1_queue_lengths, p2_found, p2_values, p3_found, p3_counts, p4_found, p5_found, p5_wide, p6_found)}

_LATEST = """
    changes AS (
        SELECT * EXCLUDE (rn) FROM (
            SELECT record_id, member__patient__id, event_sim_time, change_id,
                   coalesce(event_class, CASE lower(trim(op)) WHEN 'join' THEN 0 WHEN 'update' THEN 1 WHEN 'leave' THEN 2 END) AS cls,
                   row_number() OVER (PARTITION BY change_id ORDER BY arrival_seq DESC) AS rn
            FROM membership_events) WHERE rn = 1),
    ordered AS (
        SELECT *, row_number() OVER (PARTITION BY record_id, member__patient__id ORDER BY event_sim_time, cls, change_id) AS n FROM changes),
    places AS (
        SELECT record_id, member__patient__id,
               max(n) FILTER (WHERE cls = 0) AS joined, coalesce(max(n) FILTER (WHERE cls = 2), 0) AS gone, arg_max(change_id, n) AS change_id
        FROM ordered GROUP BY ALL HAVING joined > gone)"""
_VERSIONS = """
    ends AS (
        SELECT 'patient' AS kind, record_id, deactivated_at FROM records__patient
        UNION ALL SELECT 'queue', record_id, deactivated_at FROM records__queue),
    settled AS (
        SELECT h.kind, h.record_id, h.property, h.sim_time, h.value, e.deactivated_at
        FROM history h LEFT JOIN ends e ON h.kind = e.kind AND h.record_id = e.record_id
        WHERE h.property <> 'profile' AND (e.deactivated_at IS NULL OR h.sim_time < e.deactivated_at)
        QUALIFY row_number() OVER (PARTITION BY h.kind, h.record_id, h.property, h.sim_time ORDER BY h.row_seq DESC) = 1),
    marked AS (
        SELECT *, row_number() OVER w = 1 OR value IS DISTINCT FROM lag(value) OVER w AS changed
        FROM settled WINDOW w AS (PARTITION BY kind, record_id, property ORDER BY sim_time)),
    versions AS (
        SELECT kind, record_id, property, sim_time AS valid_from,
               coalesce(lead(sim_time) OVER (PARTITION BY kind, record_id, property ORDER BY sim_time), deactivated_at, 9223372036854775807) AS valid_to, value
        FROM marked WHERE changed)"""
_ORPHANS = """
    refs AS (
        SELECT 'history' AS src, 'record_id' AS ref_field, row_seq AS row_key, kind, record_id AS id, sim_time AS t FROM history
        UNION ALL SELECT 'membership__patient__visits', 'record_id', row_seq, 'patient', record_id, joined_sim_time FROM membership__patient__visits
        UNION ALL SELECT 'membership__patient__visits', 'member__doctor__id', row_seq, member__doctor__kind, member__doctor__id, joined_sim_time FROM membership__patient__visits
        UNION ALL SELECT 'records__patient', 'prop__doctor_id', record_index, 'doctor', prop__doctor_id, last_mutation_sim_time FROM records__patient),
    parents AS (
        SELECT 'patient' AS kind, record_id AS id, created_sim_time AS born, deactivated_at AS gone FROM records__patient
        UNION ALL SELECT 'doctor', record_id, created_sim_time, deactivated_at FROM records__doctor
        UNION ALL SELECT 'queue', record_id, created_sim_time, deactivated_at FROM records__queue),
    found AS (
        SELECT src, ref_field, row_key, t // 86400000000000 AS sim_day FROM refs r
        WHERE kind IS NOT NULL AND id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM parents p WHERE p.kind = r.kind AND p.id = r.id AND r.t >= p.born AND (p.gone IS NULL OR r.t < p.gone)))"""
_DUE = """
    source AS (
        SELECT h.property AS feed, h.record_id, h.sim_time, h.value, h.row_seq,
               EXISTS (SELECT 1 FROM export_windows w JOIN export_meta m ON w.feed = m.feed AND w.fingerprint = m.fingerprint
                       WHERE w.feed = h.property AND w.committed_at IS NOT NULL AND w.start_ns <= h.sim_time AND h.sim_time < w.end_ns AND h.known_sim_time <= w.read_ns) AS done
        FROM history h WHERE h.kind = 'patient' AND h.property IN (SELECT feed FROM export_meta))"""
_KNOWN = """
    matched AS (
        SELECT v.row_seq AS visit_seq, h.property, h.row_seq AS history_seq, h.value
        FROM membership__patient__visits v JOIN history h ON h.kind = 'patient' AND h.record_id = v.record_id
         AND h.property IN ('status', 'severity') AND h.sim_time <= v.joined_sim_time AND h.known_sim_time <= v.joined_sim_time
        QUALIFY row_number() OVER (PARTITION BY v.row_seq, h.property ORDER BY h.sim_time DESC, h.row_seq DESC) = 1)"""

SQL = {
    "p1_found": f"WITH {_LATEST} SELECT record_id, member__patient__id, change_id FROM places",
    "p1_queue_lengths": f"WITH {_LATEST} SELECT record_id, count(*) AS waiting FROM places GROUP BY record_id",
    "p2_found": f"WITH {_VERSIONS} SELECT kind, record_id, property, valid_from, valid_to FROM versions",
    "p2_values": f"WITH {_VERSIONS} SELECT kind, record_id, property, valid_from, valid_to, value FROM versions",
    "p3_found": f"WITH {_ORPHANS} SELECT src, ref_field, row_key, sim_day FROM found",
    "p3_counts": f"WITH {_ORPHANS} SELECT src, ref_field, sim_day, count(*) AS orphans FROM found GROUP BY ALL",
    "p4_found": f"WITH {_DUE} SELECT feed, min(row_seq) AS row_seq FROM source GROUP BY feed, record_id, sim_time, value HAVING NOT bool_or(done)",
    "p5_found": f"WITH {_KNOWN} SELECT visit_seq, property, history_seq FROM matched",
    "p5_wide": f"WITH {_KNOWN} SELECT v.row_seq AS visit_seq, s.value AS status, y.value AS severity FROM membership__patient__visits v LEFT JOIN matched s ON s.visit_seq = v.row_seq AND s.property = 'status' LEFT JOIN matched y ON y.visit_seq = v.row_seq AND y.property = 'severity'",
    "p6_found": """
        WITH visits AS (
            SELECT record_id, joined_sim_time AS s, coalesce(left_sim_time, 9223372036854775807) AS e FROM membership__patient__visits
            WHERE joined_sim_time < coalesce(left_sim_time, 9223372036854775807)),
        marked AS (SELECT *, max(e) OVER (PARTITION BY record_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM visits),
        labelled AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY record_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked),
        periods AS (SELECT record_id, island, min(s) AS s, max(e) AS e FROM labelled GROUP BY ALL)
        SELECT record_id, 'period' AS span, s AS start_ns, e AS end_ns FROM periods
        UNION ALL SELECT record_id, 'gap', e, n FROM (SELECT record_id, e, lead(s) OVER (PARTITION BY record_id ORDER BY island) AS n FROM periods) WHERE n IS NOT NULL""",
}
