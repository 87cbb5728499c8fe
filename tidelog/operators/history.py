"""The full history of changing attributes: versions and the periods in which they were valid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog import OPEN
from tidelog.operators import skew
from tidelog.operators.skew import BLOCK, SALT


def versions(history: DataFrame, ends: DataFrame, min_rows: int = skew.MIN_ROWS) -> DataFrame:
    """One row per version: kind, record_id, property, valid_from, valid_to, value.

    history: kind, record_id, property, sim_time, value, row_seq. ends: kind,
    record_id, ended_at; a record's rows at or after its earliest end don't
    count, and its last version ends there, otherwise at OPEN. At one sim_time
    the row with the highest row_seq counts (null lowest). Successive equal
    values, null equal to null, are one version. Rows without sim_time are
    ignored; null kinds, ids and properties are keys like others, and have no
    end.

    Gaps and islands: a lag comparison of value hashes (and of the values, as
    hashes may collide) marks changes, their running sum numbers the islands,
    the minimum of an island and the next one's give the period. The history is
    shuffled once, by record and salt; that serves the join to the ends, all
    windows and the grouping of islands. A record that holds a large part of
    the rows is spread by property and block of time.
    """
    record, key = ["kind", "record_id"], ["kind", "record_id", "property"]
    rows = history.select(*key, "sim_time", "value", "row_seq").where(F.col("sim_time").isNotNull())
    hot_record, hot_key = skew.hot_groups(rows, record, key, min_rows=min_rows)
    rows = skew.with_blocks(rows, key, "sim_time", hot_key, min_rows)
    ends = ends.groupBy(*record).agg(F.min("ended_at").alias("_end")).where(F.col("_end").isNotNull())
    left, right = skew.salted(rows, ends, record, hot_record, ["property", BLOCK])
    live = left.join(right.hint("shuffle_hash"), [*record, SALT], "left").where(F.col("_end").isNull() | (F.col("sim_time") < F.col("_end")))

    part = [*record, SALT, "property", BLOCK]
    along = Window.partitionBy(*part).orderBy("sim_time", F.col("row_seq").asc_nulls_first())
    settled = live.withColumn("_next", F.lead("sim_time").over(along)).where(F.col("_next").isNull() | (F.col("_next") != F.col("sim_time")))
    settled = settled.withColumn("_v", F.struct(F.xxhash64("value").alias("h"), F.col("value"))).withColumn("_was", F.lag("_v").over(along))
    if hot_key:  # rows before a living row live too, so the blocks' last rows need no ends
        last = skew.carried(
            rows, key,
            {"_before": F.max_by(F.struct(F.xxhash64("value").alias("h"), F.col("value")), F.struct("sim_time", "row_seq"))},
            {"_before": lambda c: F.last(c, ignorenulls=True)},
        )
        settled = skew.join_carried(settled, key, last, skew.few(hot_key, min_rows)).withColumn("_was", F.coalesce("_was", "_before")).drop("_before")
    changed = F.col("_was").isNull() | (F.col("_v.h") != F.col("_was.h")) | ~F.col("_v.value").eqNullSafe(F.col("_was.value"))
    island = F.sum(F.when(changed, 1).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, 0))
    # island 0 of a block goes on from the block before
    islands = settled.withColumn("_island", island).where(F.col("_island") > 0)
    starts = islands.groupBy(*part, "_island").agg(F.min("sim_time").alias("valid_from"), F.min_by("value", "sim_time").alias("value"), F.first("_end").alias("_end"))
    following = F.lead("valid_from").over(Window.partitionBy(*part).orderBy("valid_from"))
    out = starts.withColumn("_to", following)
    if hot_key:
        later = skew.carried(starts, key, {"_later": F.min("valid_from")}, {"_later": F.min}, backwards=True)
        out = skew.join_carried(out, key, later, skew.few(hot_key, min_rows)).withColumn("_to", F.coalesce("_to", "_later"))
    return out.select(*key, "valid_from", F.coalesce("_to", "_end", F.lit(OPEN)).alias("valid_to"), "value")
