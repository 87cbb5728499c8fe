"""Keys that hold a large part of all rows: finding, splitting and salting them.

A group is hot if it has more than ``min_rows`` rows and more than the
``1 / max_hot`` share of all rows, so there are at most ``max_hot`` hot groups
and what is broadcast about them has that bound. Hot groups of an ordered
operation are cut into blocks of about ``min_rows`` rows along the order; what
an operation has to know of the blocks before is carried in a frame of one row
per block. Results don't depend on what is hot.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_ROWS, MAX_HOT, MOST_BLOCKS, SKETCHES = 500_000, 5_000, 2_000, 64
#: Bytes of input a task reads, about; rows of a frame that may be sent to every task.
TASK_BYTES, SMALL = 128 << 20, 100_000
BLOCK, SALT = "_blk", "_salt"


def key_hash(keys: Sequence[str | Column]) -> Column:
    return F.xxhash64(*keys)


def hot_groups(df: DataFrame, *key_sets: Sequence[str], min_rows: int = MIN_ROWS, max_hot: int = MAX_HOT) -> list[dict[int, int]]:
    """For each set of keys the hash and about the rows of each hot group, from one pass with mergeable sketches.

    A sketch errs by at most 3.5 / 2**16 of all rows at 8 * max_hot tracked
    keys, so every group above the threshold is in it. The tasks' sketches are
    merged in a tree whose fan-in is about the square root of the number of
    tasks, so no task merges those of all; at most max_hot pairs of numbers a
    set reach the driver. An empty table has no hot groups.
    """
    tracked, sets = 8 * max_hot, range(len(key_sets))
    hashes = [key_hash(keys).alias(f"h{i}") for i, keys in enumerate(key_sets)]
    fan = max(SKETCHES, math.isqrt(_tasks(df)))
    merged = df.select(*hashes, F.pmod(F.spark_partition_id(), F.lit(fan)).alias("part"))
    made = [F.expr(f"approx_top_k_accumulate(h{i}, {tracked})").alias(f"s{i}") for i in sets]
    merged = merged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *made)
    while True:
        fan = fan // SKETCHES if fan > SKETCHES else 1
        joined = [F.expr(f"approx_top_k_combine(s{i}, {tracked})").alias(f"s{i}") for i in sets]
        merged = merged.withColumn("part", F.pmod("part", F.lit(fan))).groupBy("part").agg(F.sum("n").alias("n"), *joined)
        if fan == 1:
            break
    row = merged.select("n", *(F.expr(f"approx_top_k_estimate(s{i}, {max_hot})").alias(f"k{i}") for i in sets)).first()
    if row is None:
        return [{} for _ in sets]
    least = max(min_rows, row["n"] / max_hot)
    return [{x["item"]: x["count"] for x in row[f"k{i}"] or [] if x["count"] > least} for i in sets]


def _tasks(df: DataFrame) -> int:
    """About how many tasks read df, from the optimizer's estimate of its size; no job runs."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return min(10_000_000, int(str(size)) // TASK_BYTES + 1)


def blocks_of(rows: int, min_rows: int) -> int:
    return max(2, min(MOST_BLOCKS, -(-rows // min_rows)))


def few(hot: dict[int, int], min_rows: int) -> bool:
    """Whether all blocks of the hot groups together are few enough to be sent to every task."""
    return sum(blocks_of(n, min_rows) for n in hot.values()) <= SMALL


def is_hot(keys: Sequence[str], hot: dict[int, int]) -> Column:
    return key_hash(keys).isin(list(hot)) if hot else F.lit(False)


def with_blocks(df: DataFrame, keys: Sequence[str], order: str, hot: dict[int, int], min_rows: int = MIN_ROWS) -> DataFrame:
    """df with BLOCK: 0, or for rows of hot groups 1, 2, ... along ``order`` (numbers, not null).

    Rows equal in ``order`` are in one block. The borders are approximate
    quantiles of the group, found with partial aggregation; a group has as
    many blocks as its own size asks for. Rows without ``order`` are in block 1.
    """
    if not hot:
        return df.withColumn(BLOCK, F.lit(0))
    parts = blocks_of(max(hot.values()), min_rows)
    grid = [i / parts for i in range(1, parts)]
    made = df.where(is_hot(keys, hot)).groupBy(key_hash(keys).alias("_h")).agg(F.percentile_approx(order, grid, 20 * parts).alias("_all"), F.count(F.lit(1)).alias("_n"))
    own = F.greatest(F.lit(2), F.ceil(F.col("_n") / F.lit(min_rows)))
    made = made.withColumn("_step", F.greatest(F.lit(1), F.floor(F.lit(parts) / own)).cast("int"))
    borders = made.select("_h", F.expr("array_sort(array_distinct(filter(_all, (x, i) -> (i + 1) % _step = 0)))").alias("_borders"))
    hashed = df.withColumn("_h", F.when(is_hot(keys, hot), key_hash(keys)))
    at = F.expr(f"1 + array_size(filter(_borders, x -> x < `{order}`))")
    return hashed.join(F.broadcast(borders), "_h", "left").withColumn(BLOCK, F.when(F.col("_borders").isNull(), 0).otherwise(at)).drop("_h", "_borders")


def carried(blocks: DataFrame, keys: Sequence[str], made: dict[str, Column], over: dict[str, Callable], backwards: bool = False) -> DataFrame:
    """One row per block of the hot groups, with what the blocks before it (after it if backwards) give.

    ``made`` are aggregates of a block, ``over`` functions that combine them
    over the blocks before. The frame has at most as many rows as there are
    blocks.
    """
    each = blocks.where(F.col(BLOCK) > 0).groupBy(*keys, BLOCK).agg(*(c.alias(n) for n, c in made.items()))
    order = F.col(BLOCK).desc() if backwards else F.col(BLOCK)
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return each.select(*keys, BLOCK, *(over[n](F.col(n)).over(before).alias(n) for n in made))


def join_carried(df: DataFrame, keys: Sequence[str], carry: DataFrame, small: bool) -> DataFrame:
    """df with the columns of carry, null for groups that are not hot.

    small: whether carry, one row per block, may be sent to every task (see
    few). If not, it is joined by key and block, as df is partitioned already.
    """
    names = [c for c in carry.columns if c not in (*keys, BLOCK)]
    right = carry.select(*(F.col(k).alias(f"_c_{k}") for k in (*keys, BLOCK)), *names)
    on = [df[k].eqNullSafe(right[f"_c_{k}"]) for k in (*keys, BLOCK)]
    return df.join(F.broadcast(right) if small else right, on, "left").drop(*(f"_c_{k}" for k in (*keys, BLOCK)))


def salted(left: DataFrame, right: DataFrame, keys: Sequence[str], hot: dict[int, int], by: Sequence[str | Column], salts: int = 64) -> tuple[DataFrame, DataFrame]:
    """Both sides with SALT: rows of hot keys on the left are spread by ``by``, those on the right repeated per salt.

    The right side repeats at most as many keys as are hot.
    """
    if not hot:
        return left.withColumn(SALT, F.lit(0)), right.withColumn(SALT, F.lit(0))
    spread = F.when(is_hot(keys, hot), F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).otherwise(0)
    copies = F.when(is_hot(keys, hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return left.withColumn(SALT, spread), right.withColumn(SALT, F.explode(copies))


def broadcast_if_small(df: DataFrame, most_rows: int = SMALL) -> DataFrame:
    """df, marked for broadcast only if a count finds at most most_rows rows."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
