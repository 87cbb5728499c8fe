"""Joins and numberings that the temporal operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators import skew
from tidelog.operators.skew import BLOCK
from tidelog.sources.shared import written


def fill_last(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], min_rows: int | None = None, hot: dict[int, int] | None = None) -> DataFrame:
    """rows with each column (a struct, so null values inside it survive) replaced by its last non-null one up to the row.

    order[0] is a number; rows equal in it stay together. Keys with very many
    rows are cut into blocks along it. hot: those keys, where the caller knows
    them from a cheaper table; else they are looked for in rows.
    """
    min_rows = skew.MIN_ROWS if min_rows is None else min_rows
    if hot is None:
        (hot,) = skew.hot_groups(rows, keys, min_rows=min_rows)
    rows = skew.with_blocks(rows, keys, order[0], hot, min_rows)
    along = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({c: F.last(c, ignorenulls=True).over(along) for c in columns})
    if hot:
        at = F.struct(*order)
        made = {f"_p_{c}": F.max_by(c, F.when(F.col(c).isNotNull(), at)) for c in columns}
        before = skew.carried(rows, keys, made, {n: lambda x: F.last(x, ignorenulls=True) for n in made})
        out = skew.join_carried(out, keys, before, skew.few(hot, min_rows))
        out = out.withColumns({c: F.coalesce(c, f"_p_{c}") for c in columns}).drop(*made)
    return out.drop(BLOCK)


def along_groups(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], by: str, leads: dict[str, str] | None = None, lags: dict[str, str] | None = None, sums: dict[str, str] | None = None, number: str | None = None, min_rows: int | None = None, hot: dict[int, int] | None = None,
) -> DataFrame:
    """rows with values of their neighbours in a total order per group: new name to the column whose next, previous or running value it is.

    ``number`` names a column for the row's place in its group, from 1.
    Null values are values. ``by`` is the first column of the order (a number
    or time, nulls first); groups with very many rows are cut into blocks along it, and what a
    block needs of its neighbours is carried in one row per block.
    """
    leads, lags, sums = leads or {}, lags or {}, sums or {}
    min_rows = skew.MIN_ROWS if min_rows is None else min_rows
    if hot is None:
        (hot,) = skew.hot_groups(rows, keys, min_rows=min_rows)
    rows = skew.with_blocks(rows, keys, by, hot, min_rows)
    along = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    made = {n: F.lead(F.struct(F.col(c).alias("v"))).over(along) for n, c in leads.items()}
    made |= {n: F.lag(F.struct(F.col(c).alias("v"))).over(along) for n, c in lags.items()}
    made |= {n: F.sum(c).over(upto) for n, c in sums.items()}
    if number or hot:
        made["_at"] = F.row_number().over(along)
    out = rows.withColumns(made)
    if hot:
        # the first and last rows of the blocks are found by their places, so any order will do
        edge = lambda c, best: best(F.struct("_at", F.struct(F.col(c).alias("v")).alias("s")))
        last = {f"_b_{n}": edge(c, F.max) for n, c in lags.items()} | {f"_b_{n}": F.sum(c) for n, c in sums.items()} | ({"_b_at": F.count(F.lit(1))} if number else {})
        merge = {n: (lambda x: F.last(x, ignorenulls=True)) for n in last if n[3:] in lags} | {n: F.sum for n in last if n[3:] not in lags}
        small = skew.few(hot, min_rows)
        if last:
            out = skew.join_carried(out, keys, skew.carried(out, keys, last, merge), small)
        if leads:
            first = {f"_a_{n}": edge(c, F.min) for n, c in leads.items()}
            out = skew.join_carried(out, keys, skew.carried(out, keys, first, {n: (lambda x: F.last(x, ignorenulls=True)) for n in first}, backwards=True), small)
        fixed = {n: F.coalesce(n, f"_a_{n}.s") for n in leads} | {n: F.coalesce(n, f"_b_{n}.s") for n in lags}
        fixed |= {n: F.coalesce(F.col(f"_b_{n}") + F.col(n), n, f"_b_{n}") for n in sums} | ({"_at": F.col("_at") + F.coalesce("_b_at", F.lit(0))} if number else {})
        out = out.withColumns(fixed).drop(*(f"_a_{n}" for n in leads), *(f"_b_{n}" for n in (*lags, *sums)), "_b_at")
    out = out.withColumns({n: F.col(f"{n}.v") for n in (*leads, *lags)})
    return (out.withColumnRenamed("_at", number) if number else out.drop("_at")).drop(BLOCK)


def as_of(probes: DataFrame, time: str, changes: DataFrame, change_time: str, on: Sequence[str], values: Sequence[str], strict: bool = False, inner: bool = False, min_rows: int | None = None) -> DataFrame:
    """Each probe with the ``values`` of the last change of its key at or before its time (before it, if strict).

    Null values are values. Of changes at one time that with the greatest
    values counts. Probes without a match have nulls, or are left out if
    inner; so are probes without time or with a null key. Columns of changes
    that also exist in probes must be renamed by the caller. Changes and
    probes are sorted together, so nothing is compared pairwise.
    """
    probe = F.struct(*[F.col(c) for c in probes.columns])
    side = 0 if strict else 1
    a = changes.where(" and ".join(f"`{c}` is not null" for c in (*on, change_time)))
    a = a.select(*on, F.col(change_time).cast("long").alias("_t"), F.lit(1 - side).alias("_side"), F.struct(*values).alias("_v"))
    known = probes.where(" and ".join(f"`{c}` is not null" for c in (*on, time)))
    b = known.select(*on, F.col(time).cast("long").alias("_t"), F.lit(side).alias("_side"), F.lit(None).cast(a.schema["_v"].dataType).alias("_v"), probe.alias("_probe"))
    rows = a.withColumn("_probe", F.lit(None).cast(b.schema["_probe"].dataType)).unionByName(b)
    rows = rows.withColumn("_rank", F.struct("_side", "_v"))
    found = fill_last(rows, on, ["_t", "_rank"], ["_v"], min_rows).where(F.col("_probe").isNotNull())
    if inner:
        found = found.where(F.col("_v").isNotNull())
    out = found.select("_probe.*", *(F.col(f"_v.{v}").alias(v) for v in values))
    if not inner:
        lost = probes.where(" or ".join(f"`{c}` is null" for c in (*on, time)))
        kinds = dict(changes.dtypes)
        out = out.unionByName(lost.select("*", *(F.lit(None).cast(kinds[v]).alias(v) for v in values)))
    return out


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], columns: Sequence[str]) -> DataFrame:
    """keys and the columns of each key's row that is greatest in order; partial aggregation, no window."""
    best = F.max(F.struct(*order, F.struct(*columns).alias("_v"))).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, "_best._v.*")


def dense_sequence(rows: DataFrame, order: Sequence[str], name: str, start: int = 1, parts: int | None = None) -> DataFrame:
    """rows numbered without holes in a total order, without a window over everything.

    Range-partitioned, sorted and written once with the position in each
    partition; the partitions' sizes (one row each) give the offsets.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = written(spread.withColumn("__at", F.monotonically_increasing_id()), "sequence")
    sizes = placed.groupBy(F.shiftright("__at", 33).alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("__part", before.alias("__before")))  # one row per partition
    out = placed.withColumn("__part", F.shiftright("__at", 33)).join(offsets, "__part")
    return out.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + start).drop("__part", "__before", "__at")


def containing(probes: DataFrame, time: str, intervals: DataFrame, on: Sequence[str], start: str, end: str, pick: Sequence[str], min_rows: int | None = None) -> DataFrame:
    """Each probe with the interval of its key that contains its time, [start, end), null end open: the latest start, then the smallest pick.

    Intervals that never end are met by an ordering of starts and probes. The
    others are sorted into levels by the power of two that holds their length
    and into cells of that size, at most two each, so a probe meets, per level
    there is, only intervals of its key that reach into its cell and fill at
    least half of it; cells with very many probes are salted. A probe without
    an interval, without time or with a null key has nulls; equal probes are
    kept apart.
    """
    last, min_rows = 2**63 - 1, skew.MIN_ROWS if min_rows is None else min_rows
    numbered = probes.withColumn("__id", F.monotonically_increasing_id())
    numbered = written(numbered, "probes")  # so that an id means the same row in every branch
    # the complement of the start falls as it rises, so the latest start and then the smallest pick are one minimum
    best = F.struct(F.bitwise_not("__s").alias("__back"), *(F.col(p) for p in pick)).alias("__best")
    spans = intervals.select(*on, F.col(start).cast("long").alias("__s"), F.coalesce(F.col(end).cast("long"), F.lit(last)).alias("__e"), *pick)
    spans = spans.where(" and ".join(["__e > __s", *(f"`{c}` is not null" for c in on)])).select(*on, "__s", "__e", best)
    known = numbered.where(" and ".join(f"`{c}` is not null" for c in (*on, time))).select("__id", *on, F.col(time).cast("long").alias("__t"))

    spans = spans.withColumn("__level", F.when(F.col("__e") < last, F.coalesce(F.length(F.bin(F.expr("try_subtract(__e, __s)") - 1)), F.lit(63))))
    levels, never = spans.agg(F.collect_set("__level"), F.bool_or(F.col("__level").isNull())).first()  # at most 64 numbers
    cell = lambda c: F.expr(f"shiftright({c}, __level)")
    cut = spans.where("__level is not null").withColumn("__cell", F.explode(F.array_distinct(F.array(cell("__s"), cell("(__e - 1)")))))
    spread = known.withColumn("__level", F.explode(F.array(*map(F.lit, sorted(levels))).cast("array<int>"))).withColumn("__cell", cell("__t"))
    at = [*on, "__level", "__cell"]
    if known.limit(skew.SMALL + 1).count() <= skew.SMALL:  # the probes go to the intervals, at most 64 rows each
        left, right = spread.withColumn(skew.SALT, F.lit(0)), cut.withColumn(skew.SALT, F.lit(0))
        met = right.join(F.broadcast(left), [*at, skew.SALT])
    else:
        (hot,) = skew.hot_groups(spread, at, min_rows=min_rows)
        left, right = skew.salted(spread, cut, at, hot, ["__id"])
        met = left.join(right, [*at, skew.SALT])
    found = met.where("__s <= __t and __t < __e").select("__id", "__best")
    if not never:
        winner = found.groupBy("__id").agg(F.min("__best").alias("__best"))
        return numbered.join(winner, "__id", "left").select(*probes.columns, *(F.col(f"__best.{p}").alias(p) for p in pick))

    # of the intervals that never end, the last to begin; one row per start
    opened = spans.where("__level is null").groupBy(*on, F.col("__s").alias("__t")).agg(F.min("__best").alias("__best"))
    asked = known.select(*on, "__t", F.lit(1).alias("__side"), F.lit(None).cast(spans.schema["__best"].dataType).alias("__best"), "__id")
    both = opened.select(*on, "__t", F.lit(0).alias("__side"), "__best", F.lit(None).cast("long").alias("__id")).unionByName(asked)
    begun = fill_last(both, on, ["__t", "__side"], ["__best"], min_rows).where("__id is not null and __best is not null").select("__id", "__best")
    winner = found.unionByName(begun).groupBy("__id").agg(F.min("__best").alias("__best"))
    return numbered.join(winner, "__id", "left").select(*probes.columns, *(F.col(f"__best.{p}").alias(p) for p in pick))


def smallest(units: DataFrame, order: str, k: int, ties: Sequence[str] = (), fine: int = 50_000) -> DataFrame:
    """Exactly k units (all, if fewer) with the smallest ``order`` (a long), told apart by ``ties``; nothing is gathered.

    A histogram over the leading 16 bits finds the bin the border lies in, and
    again within it, until that bin is small enough to be sorted.
    """
    if k <= 0:
        return units.limit(0)
    below, inside, shift = F.lit(False), F.lit(True), 48
    left = k
    while True:
        bins = units.where(inside).groupBy(F.shiftright(order, shift).alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect()  # at most 65,536 rows
        if sum(r["n"] for r in bins) <= left:
            return units.where(below | inside)
        at = 0
        while left >= bins[at]["n"]:
            left -= bins[at]["n"]
            at += 1
        border = bins[at]["b"]
        below = below | (inside & (F.shiftright(order, shift) < border))
        inside = inside & (F.shiftright(order, shift) == border)
        if bins[at]["n"] <= fine or shift == 0:
            break
        shift -= 16
    if left == 0:
        return units.where(below)
    return units.where(below).unionByName(units.where(inside).orderBy(order, *ties).limit(left))
