"""Attributes as they were known at the time of an event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators import skew
from tidelog.operators.skew import BLOCK


def last_known(events: DataFrame, changes: DataFrame, min_rows: int = skew.MIN_ROWS) -> DataFrame:
    """For each event the change of its record that applies: event_seq, change_seq, value.

    events: record_id, event_time, event_seq. changes: record_id, sim_time,
    known_sim_time, row_seq, value. Among the changes that both took effect and
    were known at or before the event's time, that with the highest sim_time,
    then row_seq, applies; its value may be null. Events without such a
    change, without time or without record have no row; changes lacking a time
    never apply.

    A change is usable from the later of its two times on, so one ordering is
    enough: changes and events of a record are sorted by time, and a running
    maximum of (sim_time, row_seq) gives the answer. Records with very many
    rows are cut into blocks of time, each given the maximum of those before.
    """
    usable = F.greatest("sim_time", "known_sim_time")
    best = F.struct("sim_time", "row_seq", "value")
    have = F.col("sim_time").isNotNull() & F.col("known_sim_time").isNotNull() & F.col("record_id").isNotNull()
    a = changes.where(have).select("record_id", usable.alias("_t"), F.lit(0).alias("_side"), best.alias("_best"), F.lit(None).cast("long").alias("event_seq"))
    b = events.where(F.col("record_id").isNotNull() & F.col("event_time").isNotNull())
    b = b.select("record_id", F.col("event_time").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(a.schema["_best"].dataType).alias("_best"), F.col("event_seq").cast("long").alias("event_seq"))
    rows, key = a.unionByName(b), ["record_id"]
    (hot,) = skew.hot_groups(rows, key, min_rows=min_rows)
    rows = skew.with_blocks(rows, key, "_t", hot, min_rows)
    along = Window.partitionBy("record_id", BLOCK).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_found", F.max("_best").over(along)).where(F.col("_side") == 1)
    if hot:
        earlier = skew.carried(rows, key, {"_earlier": F.max("_best")}, {"_earlier": F.max})
        out = skew.join_carried(out, key, earlier, skew.few(hot, min_rows)).withColumn("_found", F.greatest("_found", "_earlier"))
    return out.where(F.col("_found").isNotNull()).select("event_seq", F.col("_found.row_seq").alias("change_seq"), F.col("_found.value").alias("value"))


def attributes_at(events: DataFrame, history: DataFrame, attributes: Sequence[str], min_rows: int = skew.MIN_ROWS) -> DataFrame:
    """Matches of all attributes, one row per event and attribute: event_seq, property, change_seq, value.

    history has a further column property; each attribute has its own change
    history and is matched by itself, so attributes that change at different
    times never make wide versions.
    """
    out = None
    for name in attributes:
        one = last_known(events, history.where(F.col("property") == name), min_rows).withColumn("property", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def attributes_wide(events: DataFrame, matches: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Every event with one column per attribute, null where nothing was known."""
    wide = matches.groupBy("event_seq").pivot("property", list(attributes)).agg(F.first("value"))
    return events.select("event_seq").join(wide, "event_seq", "left")
