"""Processing only what is new since the last successful run, with the target as the state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.numbers import floor_div
from tidelog.operators.skew import broadcast_if_small
from tidelog.sources.shared import Manifests, new_name


def key_text(value: Column | str, most: int = 32) -> Column:
    """A text as part of a key: itself up to ``most`` bytes, of longer ones the SHA-256; null stays null."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(F.octet_length(value) > most, F.concat(F.lit("sha256:"), F.sha2(value, 256))).otherwise(value)


class Target:
    """A table whose rows carry the key and version of the source row they come from.

    ``due`` anti-joins the source against those keys, null equal to null;
    ``publish`` writes new rows beside the old ones and makes them part of the
    target by one atomic manifest. A run that fails leaves no trace, so the
    next run finds the same rows due: none is skipped, none repeated. Of source
    rows equal in all key columns only one, with the lowest version, is due.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], version: str):
        self.spark, self.path, self.schema, self.keys, self.version = spark, path.rstrip("/"), schema, list(keys), version
        self.manifests = Manifests(spark, path)

    def read(self) -> DataFrame:
        parts = self.manifests.latest().get("parts", [])
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def due(self, source: DataFrame) -> DataFrame:
        """keys and version of the source rows that the target lacks.

        Both sides are reduced to their distinct keys with partial aggregation
        before the join, so rows delivered again and again don't pile up.
        """
        spread = [*self.keys, "_nulls"]
        have = self._plain_keys(self.read()).select(*(F.col(k).alias(f"_t_{k}") for k in spread)).distinct()
        each = self._plain_keys(source).groupBy(*spread).agg(F.min(self.version).alias(self.version))
        lacking = each.join(have, [each[k] == have[f"_t_{k}"] for k in spread], "left_anti")
        kinds = dict(lacking.dtypes)
        null = lambda i, k: F.when(F.shiftright("_nulls", i).bitwiseAND(1) == 0, F.col(k)).cast(kinds[k]).alias(k)
        return lacking.select(*(null(i, k) for i, k in enumerate(self.keys)), self.version).select(*self.schema.names)

    def _plain_keys(self, rows: DataFrame) -> DataFrame:
        """rows with nulls in keys as a fixed value and a bit in _nulls, so that grouping and join need one and the same shuffle."""
        nulls = F.lit(0)
        for i, k in enumerate(self.keys):
            nulls = nulls.bitwiseOR(F.col(k).isNull().cast("int") * (1 << i))
        fixed = {k: F.coalesce(F.col(k), F.lit("" if t == "string" else 0).cast(t)) for k, t in rows.dtypes if k in self.keys}
        return rows.withColumn("_nulls", nulls).withColumns(fixed)

    def publish(self, rows: DataFrame) -> DataFrame:
        """Add rows as one new version; returns them as read from it."""
        now = self.manifests.latest()
        part = f"{self.path}/data/{new_name(now['version'] + 1)}"
        rows.select(*self.schema.names).write.parquet(part)
        self.manifests.publish({"parts": [*now.get("parts", []), part]}, now["version"])
        return self.spark.read.schema(self.schema).parquet(part)


def exported(rows: DataFrame, windows: DataFrame, meta: DataFrame, cell: int) -> DataFrame:
    """The rows (feed, sim_time, known_sim_time, ...) that some successful run of the log has exported.

    A run counts if it has the current fingerprint of its feed and a
    committed_at. Its window is cut into cells of ``cell`` ns, so rows meet
    only the windows of their own cell, in an equi-join; the semi-join never
    multiplies rows. The windows are broadcast only if they are few.
    """
    good = windows.where("committed_at is not null and start_ns < end_ns").join(F.broadcast(meta.select("feed", "fingerprint").distinct()), ["feed", "fingerprint"])
    good = good.groupBy("feed", "start_ns", "end_ns").agg(F.max("read_ns").alias("read_ns"))
    cells = F.sequence(floor_div("start_ns", cell), floor_div(F.col("end_ns") - 1, cell))
    named = {"feed": "__w_feed", "start_ns": "__w_start", "end_ns": "__w_end", "read_ns": "__w_read"}
    good = broadcast_if_small(good.withColumn("__w_cell", F.explode(cells)).withColumnsRenamed(named))
    time, known = rows["sim_time"], rows["known_sim_time"]
    inside = (time >= F.col("__w_start")) & (time < F.col("__w_end")) & (known <= F.col("__w_read"))
    return rows.join(good, (rows["feed"] == F.col("__w_feed")) & (floor_div(time, cell) == F.col("__w_cell")) & inside, "left_semi")
