"""Streams as Structured Streaming queries: replay, windows with watermarks, joins, and results as tables.

Every query writes through ``foreachBatch`` into the shared folder, one folder
per batch, so a batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.sources.shared import fresh_folder


def replay(spark: SparkSession, folder: str, table: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A table's file or files as a stream."""
    read = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}*.parquet")
    if files_per_batch:
        read = read.option("maxFilesPerTrigger", files_per_batch)
    return read.parquet(folder)


def event_time(stream: DataFrame, column: str, delay: str) -> DataFrame:
    """stream with its event time as a timestamp with zone (a watermark needs one; the session is in UTC) and a watermark."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def run(stream: DataFrame, name: str, mode: str = "append", at: str | None = None) -> DataFrame:
    """Run over what is there now, then stop; the result so far as a table. In complete mode the last batch holds everything.

    at: a folder that keeps progress, state and result. A later run with it,
    also after a failure, reads only what has come since and adds each batch
    once. Without it all goes when the driver's Python ends.
    """
    spark = stream.sparkSession
    out, schema = at or fresh_folder(spark, name), stream.schema

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={number if mode != 'complete' else 0}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/data")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(f"{out}/data/*") if there else spark.createDataFrame([], schema)


def tumbling(stream: DataFrame, time: str, size: str, keys: list[str], start: str | None = None) -> DataFrame:
    return _counted(stream, F.window(time, size, size, start) if start else F.window(time, size), keys)


def sliding(stream: DataFrame, time: str, size: str, slide: str, keys: list[str]) -> DataFrame:
    return _counted(stream, F.window(time, size, slide), keys)


def sessions(stream: DataFrame, time: str, gap: str, keys: list[str]) -> DataFrame:
    return _counted(stream, F.session_window(time, gap), keys)


def _counted(stream: DataFrame, window, keys: list[str]) -> DataFrame:
    made = stream.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    ntz = lambda c: F.to_timestamp_ntz(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return made.select(ntz(F.col("w.start")).alias("window_start"), ntz(F.col("w.end")).alias("window_end"), *keys, "events", F.round("total", 4).alias("total"))


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once within the watermark's delay; the state for it expires."""
    return stream.dropDuplicatesWithinWatermark(keys)


def joined(left: DataFrame, right: DataFrame, left_time: str, right_time: str, keys: list[str], within: str) -> DataFrame:
    """Left events with right events of the same key up to ``within`` before; both sides have watermarks, so state is bounded."""
    r = right.select(*(F.col(k).alias(f"_r_{k}") for k in keys), F.col(right_time).alias("_r_time"), *(c for c in right.columns if c not in (*keys, right_time)))
    on = [left[k] == r[f"_r_{k}"] for k in keys]
    near = (F.col("_r_time") <= F.col(left_time)) & (F.col("_r_time") >= F.col(left_time) - F.expr(f"interval {within}"))
    for one in on:
        near = near & one
    return left.join(r, near)
