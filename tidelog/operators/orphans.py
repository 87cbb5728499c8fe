"""References to records that do not exist, not yet or no longer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog import DAY
from tidelog.functions.numbers import floor_div
from tidelog.operators import skew
from tidelog.operators.skew import SALT


def orphans(refs: DataFrame, parents: DataFrame, min_rows: int = skew.MIN_ROWS) -> DataFrame:
    """The rows of refs whose record does not live at the time of the reference, with sim_day.

    refs: src, ref_field, row_key, ref_kind, ref_id, ref_time; a null kind or
    id is no reference, a reference without time is an orphan only if its
    record never existed (sim_day is then null). parents: kind, record_id,
    created_at, ended_at (null while alive); of repeated parents the earliest
    creation and the latest end count, and a null creation means always.

    The distinct keys, with the earliest and latest time they are referred to
    (partial aggregation, so hot keys shrink before the shuffle), are
    anti-joined against the parents that cover all their references. What
    remains is joined back to the references; keys with very many of them are
    salted.
    """
    refs = refs.select("src", "ref_field", "row_key", "ref_kind", "ref_id", "ref_time").where("ref_kind is not null and ref_id is not null")
    born = F.min(F.coalesce("created_at", F.lit(-(2**63)))).alias("_born")
    gone = F.max(F.coalesce("ended_at", F.lit(2**63 - 1))).alias("_gone")
    lives = parents.groupBy(F.col("kind").alias("ref_kind"), F.col("record_id").alias("ref_id")).agg(born, gone)
    keys = ["ref_kind", "ref_id"]
    distinct = refs.groupBy(*keys).agg(F.min("ref_time").alias("_first"), F.max("ref_time").alias("_last"))
    on = [distinct[k] == lives[k] for k in keys]
    covers = F.coalesce((F.col("_born") <= F.col("_first")) & ((F.col("_last") < F.col("_gone")) | (F.col("_gone") == 2**63 - 1)), F.col("_first").isNull())
    doubtful = distinct.join(lives, [*on, covers], "left_anti").select(*keys)
    doubtful = doubtful.join(lives, keys, "left")
    (hot,) = skew.hot_groups(refs, keys, min_rows=min_rows)
    left, right = skew.salted(refs, doubtful, keys, hot, ["src", "row_key"])
    back = left.join(right, [*keys, SALT])
    outside = F.col("_born").isNull() | (F.col("ref_time") < F.col("_born")) | ((F.col("ref_time") >= F.col("_gone")) & (F.col("_gone") != 2**63 - 1))
    return back.where(outside).select("src", "ref_field", "row_key", floor_div("ref_time", DAY).alias("sim_day"))


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphan references per table, field and day."""
    return found.groupBy("src", "ref_field", "sim_day").agg(F.count(F.lit(1)).alias("orphans"))
