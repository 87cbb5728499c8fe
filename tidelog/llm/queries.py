"""The queries of the text problems, over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import formatting, mixing, spam, tokenizer
from tidelog.sources.shared import written
from tidelog.sources.tables import table


def _copies(spark: SparkSession, d: str) -> DataFrame:
    profiles = table(spark, d, "history").where((F.col("kind") == "patient") & (F.col("property") == "profile"))
    return formatting.copies(profiles)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d).select(F.col("kept").alias("record_id_a"), F.col("copy").alias("record_id_b"))


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """The kept records with the number of their copies."""
    return formatting.kept_records(_copies(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encoded(table(spark, d, "documents"), ["doc_id"])


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every text decoded from its ids; a null text comes back empty."""
    return tokenizer.decoded(tokenizer.encoded(table(spark, d, "documents"), ["doc_id"]), ["doc_id"])


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = written(tokenizer.encoded(table(spark, d, "documents"), ["doc_id", "source"], counts=True), "sizes")
    return mixing.mix(sized.select("doc_id", "n_tokens", F.array("source").alias("sources")), table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix with how often each is used."""
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    return _mix(spark, d)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.stuffed(table(spark, d, "documents"), "author_id")


QUERIES = {f.__name__: f for f in (p7_found, p7_kept, p8_ids, p8_round_trip, p9_mix, p9_shares, p10_found)}

_CONTENT = r"""
    content AS (
        SELECT DISTINCT record_id, list_sort(list_filter(list_transform(string_split(
            regexp_replace(regexp_replace(lower(value), '[^\p{L}\p{N}]+', ' ', 'g'), '\b(name|born|weight|ward|wing|badge|contact)\b', '|\1', 'g'), '|'),
            lambda x: trim(x)), lambda x: x <> '')) AS fields
        FROM history WHERE kind = 'patient' AND property = 'profile' AND value IS NOT NULL),
    kept AS (SELECT fields, min(record_id) AS id, count(*) AS copies FROM content GROUP BY fields HAVING count(*) > 1)"""

SQL = {
    "p7_found": f"WITH {_CONTENT} SELECT k.id AS record_id_a, c.record_id AS record_id_b FROM content c JOIN kept k ON c.fields = k.fields WHERE c.record_id <> k.id",
    "p7_kept": f"WITH {_CONTENT} SELECT id AS record_id, copies FROM kept",
    "p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
