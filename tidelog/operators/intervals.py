"""Overlapping, nested and gapped intervals: continuous periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog import OPEN
from tidelog.operators import skew
from tidelog.operators.skew import BLOCK


def periods_and_gaps(intervals: DataFrame, min_rows: int = skew.MIN_ROWS) -> DataFrame:
    """record_id, span ("period" or "gap"), start_ns, end_ns from half-open intervals record_id, start_ns, end_ns.

    A null end is OPEN. Intervals without start or record, and those that
    don't end after they start, are ignored. Touching intervals make one
    period.

    Sorted by start, an interval opens a period if it starts after the
    running maximum of the ends before it; that maximum is also where the gap
    before it begins. The running sum of such starts labels the islands,
    whose extent is aggregated partially. Records with very many intervals
    are cut into blocks of start, each given the maximum end and the number
    of islands of those before.
    """
    key = ["record_id"]
    rows = intervals.select("record_id", "start_ns", F.coalesce("end_ns", F.lit(OPEN)).alias("end_ns"))
    rows = rows.where(F.col("record_id").isNotNull() & (F.col("start_ns") < F.col("end_ns")))
    (hot,) = skew.hot_groups(rows, key, min_rows=min_rows)
    rows = skew.with_blocks(rows, key, "start_ns", hot, min_rows)
    along = Window.partitionBy("record_id", BLOCK).orderBy("start_ns", "end_ns")
    marked = rows.withColumn("_reach", F.max("end_ns").over(along.rowsBetween(Window.unboundedPreceding, -1)))
    if hot:
        reach = skew.carried(rows, key, {"_before": F.max("end_ns")}, {"_before": F.max})
        marked = skew.join_carried(marked, key, reach, skew.few(hot, min_rows)).withColumn("_reach", F.greatest("_reach", "_before")).drop("_before")
    marked = marked.withColumn("_opens", F.when(F.col("_reach").isNull() | (F.col("start_ns") > F.col("_reach")), 1).otherwise(0))
    labelled = marked.withColumn("_island", F.sum("_opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    if hot:
        count = skew.carried(marked, key, {"_done": F.sum("_opens")}, {"_done": F.sum})
        labelled = skew.join_carried(labelled, key, count, skew.few(hot, min_rows)).withColumn("_island", F.col("_island") + F.coalesce("_done", F.lit(0)))
    # the opening row knows the hole before its period; each period is one group
    islands = labelled.groupBy("record_id", "_island").agg(F.min("start_ns").alias("_s"), F.max("end_ns").alias("_e"), F.min(F.when(F.col("_opens") == 1, F.col("_reach"))).alias("_hole"))
    period = F.struct(F.lit("period").alias("span"), F.col("_s").alias("start_ns"), F.col("_e").alias("end_ns"))
    gap = F.struct(F.lit("gap").alias("span"), F.col("_hole").alias("start_ns"), F.col("_s").alias("end_ns"))
    both = F.when(F.col("_hole").isNull(), F.array(period)).otherwise(F.array(period, gap))
    return islands.select("record_id", F.inline(both))
