"""Mixing documents of several sources to target shares of the total size."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Membership patterns that reach the driver as they are; the documents of smaller ones are routed as members of one of their sources.
MOST_PATTERNS = 4096


@dataclass
class Flow:
    """A small min-cost flow, by successive shortest paths."""

    arcs: list[list] = field(default_factory=list)  # to, capacity left, cost; arc i ^ 1 is the reverse of arc i
    out: dict = field(default_factory=dict)

    def arc(self, a, b, capacity: int, cost: int) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.arcs))
            self.out.setdefault(y, [])
            self.arcs.append([y, c, w])
        return len(self.arcs) - 2

    def run(self, s, t) -> None:
        """Send as much as possible from s to t, at least cost."""
        while True:
            dist, via, queue = {s: 0}, {}, [s]
            for x in queue:
                for i in self.out[x]:
                    y, c, w = self.arcs[i]
                    if c > 0 and dist[x] + w < dist.get(y, 1 << 62):
                        dist[y], via[y] = dist[x] + w, i
                        queue.append(y)
            if t not in dist:
                return
            path, x = [], t
            while x != s:
                path.append(via[x])
                x = self.arcs[via[x] ^ 1][0]
            push = min(self.arcs[i][1] for i in path)
            for i in path:
                self.arcs[i][1] -= push
                self.arcs[i ^ 1][1] += push


def route(sizes: dict[tuple[str, ...], int], quotas: dict[str, int], repeats: dict[str, int]) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens that each membership pattern gives to each source.

    sizes: tokens of the documents that belong to exactly these sources. A
    source gets at most its quota, from a pattern at most ``repeats`` times
    the pattern's tokens. Using a document again costs more each time, so
    sources that overlap share the repetitions evenly; of all ways to fill the
    quotas as far as possible the cheapest is taken.
    """
    flow, into = Flow(), {}
    for pattern, size in sorted(sizes.items()):
        for again in range(sum(repeats[s] for s in pattern)):
            flow.arc("start", pattern, size, again)
        for s in pattern:
            into[pattern, s] = (flow.arc(pattern, ("source", s), size * repeats[s], 0), size * repeats[s])
    for s, quota in sorted(quotas.items()):
        flow.arc(("source", s), "end", quota, 0)
    if sizes:
        flow.run("start", "end")
    return {k: most - flow.arcs[i][1] for k, (i, most) in into.items()}


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The uses of documents in the mix (doc_id, source, uses) and the shares reached per source.

    documents: doc_id, n_tokens, sources (the sources it belongs to; nulls and
    sources without a target don't count, a document without any stays out).
    targets: source, target_share, max_repeats; shares are taken relative to
    their sum, a null or non-positive share or number of repeats means none.
    total: tokens of the mix; if None, the tokens of all documents that take
    part, once each. Each source gets its share of the total or, where
    max_repeats doesn't allow that, all it can give; the others are then not
    raised above their share of the total, which would move the shares further
    away.

    Documents are aggregated by membership pattern; patterns and sources make
    a small min-cost flow, solved on the driver. Of more than MOST_PATTERNS
    patterns the largest are kept; a document of another one takes part as a
    member of that source of its own which has least to offer for its share,
    so none is left out, only the choice of where it goes is narrower. A pattern that gives a source f tokens is used f // size times
    whole, and for the rest in a seeded order of its documents up to the last
    that fits. That prefix is found with a histogram over the order's hash and
    a sort within one of its 65,536 bins, so no source is ever gathered in one
    task. Rows with the same doc_id are documents of their own; null sizes
    count 0.
    """
    spark = documents.sparkSession
    named = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("most"))
    goal = {r["source"]: (max(r["share"] or 0.0, 0.0), max(r["most"] or 0, 0)) for r in named.collect()}  # the configuration: one row per source
    shares, repeats = {s: g[0] for s, g in goal.items()}, {s: g[1] for s, g in goal.items()}
    whole = sum(shares.values()) or 1.0
    listed = F.array(*map(F.lit, sorted(goal))) if goal else F.array().cast("array<string>")
    docs = documents.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.array_sort(F.array_distinct(F.array_intersect("sources", listed))).alias("pattern"))
    docs = offers = docs.where(F.size("pattern") > 0)
    by_pattern = lambda: docs.groupBy("pattern").agg(F.sum("n_tokens").alias("size"))
    found = by_pattern().orderBy(F.desc("size"), "pattern").limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        held = {r["source"]: r["size"] for r in docs.select(F.explode("pattern").alias("source"), "n_tokens").groupBy("source").agg(F.sum("n_tokens").alias("size")).collect()}
        needy = sorted(held, key=lambda s: (held[s] / shares[s] if shares[s] and repeats[s] else float("inf"), s))
        kept = spark.createDataFrame([(r["pattern"], True) for r in found[:MOST_PATTERNS]], "pattern array<string>, _kept boolean")
        one = F.filter(F.array(*map(F.lit, needy)), lambda s: F.array_contains("pattern", s))[0]
        docs = docs.join(F.broadcast(kept), "pattern", "left").withColumn("pattern", F.when(F.col("_kept"), F.col("pattern")).otherwise(F.array(one))).drop("_kept")
        found = by_pattern().collect()  # at most one more per source
    sizes = {tuple(r["pattern"]): r["size"] for r in found}
    total = sum(sizes.values()) if total is None else total
    quotas = {s: int(total * shares[s] / whole) for s in goal}
    given = route(sizes, quotas, repeats)

    plan = [(list(p), s, f // sizes[p] if sizes[p] else 0, f % sizes[p] if sizes[p] else 0) for (p, s), f in sorted(given.items())]
    planned = spark.createDataFrame(plan, "pattern array<string>, source string, passes long, rest long")
    key = ["pattern", "source"]
    seeded = F.xxhash64(F.lit(seed), "doc_id", "source", "_nth")
    rows = docs.withColumn("_nth", F.lit(0)).join(F.broadcast(planned), "pattern").withColumn("_u", seeded).withColumn("_bin", F.shiftright("_u", 48))
    bins = rows.where("rest > 0").groupBy(*key, "_bin", "rest").agg(F.sum("n_tokens").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    cut = bins.withColumn("_upto", upto).where((F.col("_upto") - F.col("_n") <= F.col("rest")) & (F.col("_upto") > F.col("rest")))
    cut = cut.groupBy(*key).agg(F.min_by(F.struct(F.col("_bin").alias("bin"), (F.col("_upto") - F.col("_n")).alias("before")), "_bin").alias("_cut"))
    rows = rows.join(F.broadcast(cut), key, "left")  # one row per pattern and source
    border = (F.col("rest") > 0) & (F.col("_bin") == F.col("_cut.bin"))
    along = Window.partitionBy(*key, "_edge").orderBy("_u", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    below = rows.where(~F.coalesce(border, F.lit(False))).withColumn("_in", (F.col("rest") > 0) & (F.col("_cut.bin").isNull() | (F.col("_bin") < F.col("_cut.bin"))))
    edge = rows.where(border).withColumn("_edge", F.lit(0))
    edge = edge.withColumn("_in", F.col("_cut.before") + F.sum("n_tokens").over(along) <= F.col("rest")).drop("_edge")
    uses = below.unionByName(edge).withColumn("uses", F.col("passes") + F.col("_in").cast("long")).where("uses > 0").select("doc_id", "source", "uses", "n_tokens")

    offered = offers.select(F.explode("pattern").alias("source"), "n_tokens").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens_available"))
    taken = uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens_used"), F.max("uses").alias("most_uses"))
    goals = spark.createDataFrame([(s, shares[s] / whole, repeats[s], quotas[s]) for s in sorted(goal)], "source string, target_share double, max_repeats int, quota long")
    report = goals.join(offered, "source", "left").join(taken, "source", "left").na.fill(0)
    over = Window.partitionBy()  # one row per source of the configuration
    report = report.withColumn("actual_share", F.col("tokens_used") / F.when(F.sum("tokens_used").over(over) > 0, F.sum("tokens_used").over(over)))
    return uses, report
