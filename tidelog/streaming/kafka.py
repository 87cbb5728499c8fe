"""Reading topics back, and how far behind a reader is. Needs Spark's Kafka connector on the cluster; nothing else does."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, servers: str, topics: list[str], per_trigger: int | None = None, start: str = "latest") -> DataFrame:
    """The topics as a stream of topic, key, value and event_time; at most ``per_trigger`` records a batch, the rest waits in the broker."""
    read = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", start)
    if per_trigger:
        read = read.option("maxOffsetsPerTrigger", per_trigger)
    return read.load().select("topic", F.col("key").cast("string"), F.col("value").cast("string"), F.col("timestamp").alias("event_time"))


def lag(progress: dict | None) -> dict[str, int]:
    """Records per topic that a query's last progress had not read, never below 0."""
    out: dict[str, int] = {}
    for s in (progress or {}).get("sources", []):
        offsets = [json.loads(x) if isinstance(x, str) else x for x in (s.get("latestOffset") or {}, s.get("endOffset") or {})]
        for topic, parts in offsets[0].items():
            done = offsets[1].get(topic, {})
            out[topic] = out.get(topic, 0) + sum(max(0, int(n) - int(done.get(p, 0))) for p, n in parts.items())
    return out


def watermark(progress: dict | None) -> str | None:
    """The event-time watermark of a query's last progress; across streams Spark takes the least."""
    return (progress or {}).get("eventTime", {}).get("watermark")
