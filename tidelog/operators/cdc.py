"""Applying a feed of inserts, updates and deletes to a bucketed table."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators.skew import SALT
from tidelog.sources.shared import Manifests, new_name

#: The classes of a change and the words for them.
CLASSES = {"join": 0, "update": 1, "leave": 2}


def change_class(event_class: str, op: str) -> Column:
    """The class of a change from its number or, if that is null, from its unevenly written word; else null."""
    word = F.lower(F.regexp_replace(F.col(op), r"\s+", ""))
    said = F.when(word == "join", 0).when(word == "update", 1).when(word == "leave", 2)
    return F.coalesce(F.when(F.col(event_class).isin(*CLASSES.values()), F.col(event_class)), said).cast("int")


class BucketedTable:
    """A copy-on-write table of current rows, hashed into buckets by their key, with the changes they result from.

    ``apply`` routes a batch of deliveries to buckets, sort-merges it with the
    changes of only the touched buckets, derives those buckets' current rows,
    writes replacement files for both and publishes a manifest that names, for
    each bucket, the folders that now hold it. Untouched buckets are neither
    read nor written. A run that dies before the manifest leaves the table as
    it was; two runs can't publish the same version.

    ``read`` gives the current rows as stored, the keys and the change that
    made each. The changes (one row each, the latest delivery) are kept beside
    them because a later delivery may undo one.

    keys: columns that name the changed row (nulls allowed; changes with a
    null key are kept and never form a row). change: the column that is equal
    for deliveries of one change; deliveries without it are ignored. version:
    of deliveries of one change that with the highest counts, null lowest;
    equal ones are told apart by all other columns, so results don't depend
    on file order. movable: whether a later delivery may name another key; if
    so, an index from changes to buckets, itself hashed by change, says where
    an earlier delivery lies, and only its touched parts are read. files: how
    many files a bucket is written in, so a large bucket, or one with a hot
    key, is the work of several tasks.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], change: str, version: str, order: Sequence[str] = ("event_sim_time", "cls"), buckets: int = 64, movable: bool = True, files: int = 4):
        self.spark, self.path, self.schema, self.buckets, self.movable = spark, path.rstrip("/"), schema, buckets, movable
        self.keys, self.change, self.version, self.order, self.files = list(keys), change, version, list(order), files
        self.rows = T.StructType([schema[k] for k in (*keys, change)])
        self.homes = T.StructType([schema[change], T.StructField("_at", T.IntegerType()), T.StructField("_bucket", T.IntegerType())])
        self.manifests = Manifests(spark, path)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _home(self) -> Column:
        return F.pmod(F.xxhash64(self.change), F.lit(self.buckets)).cast("int")

    def _files(self, what: str, schema: T.StructType, buckets: Sequence[int] | None = None) -> DataFrame:
        held = self.manifests.latest().get(what, {})
        chosen = held if buckets is None else {str(b): held[str(b)] for b in buckets if str(b) in held}
        paths = sorted(p for ps in chosen.values() for p in ps)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The current rows (of some buckets)."""
        return self._files("rows", self.rows, buckets)

    def changes(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The latest delivery of each change (of some buckets)."""
        return self._files("changes", self.schema, buckets)

    def _latest(self, df: DataFrame, *by: str) -> DataFrame:
        """One row per change. Partial aggregation, so a change delivered very often does no harm."""
        rest = [c for c in self.schema.names if c not in (self.change, self.version)]
        best = F.max(F.struct(F.col(self.version), *rest)).alias("_best")
        return df.where(F.col(self.change).isNotNull()).groupBy(*by, self.change).agg(best).select(*by, self.change, "_best.*").select(*by, *self.schema.names)

    def _moved(self, delta: DataFrame, parts: list[int]) -> list[int]:
        """The buckets where older deliveries of the batch's changes lie that are not those of the new ones."""
        known = self._files("homes", self.homes, parts).join(delta.select(self.change, F.col("_bucket").alias("_now")), self.change)
        last = known.groupBy(self.change, "_now").agg(F.max(F.struct("_at", "_bucket")).alias("_last")).where("_last._bucket != _now")
        return [r[0] for r in last.select("_last._bucket").distinct().collect()]  # at most self.buckets numbers

    def _store(self, df: DataFrame, by: str, place: str, spread: Sequence[str]) -> None:
        """Write df into one folder per bucket, each in at most self.files files."""
        df.withColumn(SALT, F.pmod(F.xxhash64(*spread), F.lit(self.files))).repartition(by, SALT).drop(SALT).write.partitionBy(by).parquet(place)

    def apply(self, batch: DataFrame) -> dict:
        """Merge a batch of deliveries, in any order and however often repeated; returns the new manifest."""
        now = self.manifests.latest()
        name = new_name(now["version"] + 1)
        place = {what: f"{self.path}/{what}/{name}" for what in ("batch", "changes", "rows", "homes")}
        held = {what: dict(now.get(what, {})) for what in ("changes", "rows", "homes")}
        delta = self._latest(batch.select(*self.schema.names)).withColumns({"_bucket": self.bucket(), "_home": self._home()})
        touched, moved, new = None, [], delta
        if held["changes"]:
            delta.write.parquet(place["batch"])
            delta = self.spark.read.parquet(place["batch"])
            to, parts = delta.agg(F.collect_set("_bucket"), F.collect_set("_home")).first()  # at most self.buckets numbers each
            moved = self._moved(delta, parts) if self.movable else []
            touched = sorted({*to, *moved})
            new = self.changes(touched).unionByName(delta.select(*self.schema.names))
            if moved:  # the deliveries of a change meet first, whatever bucket they name
                new = self._latest(new)
        spread = new.withColumn("_bucket", self.bucket()).withColumn(SALT, F.pmod(F.xxhash64(self.change), F.lit(self.files))).repartition("_bucket", SALT)
        # merged where it is written: the grouping needs no shuffle of its own
        merged = self._latest(spread, "_bucket", SALT) if touched else spread.select("_bucket", *self.schema.names)
        merged.drop(SALT).write.partitionBy("_bucket").parquet(place["changes"])
        written = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])).parquet(place["changes"])
        rows = open_places(written, self.keys, *self.order, self.change).withColumn("_bucket", self.bucket())
        todo = [(rows, "_bucket", place["rows"], self.keys)]
        if self.movable:
            source = delta if touched is not None else written.withColumn("_home", self._home())
            todo.append((source.select(self.change, F.lit(now["version"] + 1).alias("_at"), "_bucket", "_home"), "_home", place["homes"], [self.change]))
        with ThreadPoolExecutor(len(todo)) as both:  # neither needs the other
            list(both.map(lambda x: self._store(*x), todo))
        there = {what: {f.rpartition("=")[2] for f in self.manifests.folders(place[what]) if "=" in f} for what in held}
        touched = sorted(map(int, there["changes"])) if touched is None else touched
        for what in ("changes", "rows"):
            held[what] = {k: v for k, v in held[what].items() if int(k) not in touched} | {k: [f"{place[what]}/_bucket={k}"] for k in there[what]}
        for k in there["homes"]:
            held["homes"][k] = [*held["homes"].get(k, []), f"{place['homes']}/_home={k}"]
        self.manifests.drop(place["batch"])
        return self.manifests.publish(held | {"touched": touched}, now["version"])

    def expire(self) -> None:
        """Delete the files that the latest manifest doesn't name. Readers of older versions must be done."""
        now = self.manifests.latest()
        used = {p for what in ("changes", "rows", "homes") for ps in now.get(what, {}).values() for p in ps}
        for what in ("changes", "rows", "homes", "batch"):
            for version in self.manifests.folders(f"{self.path}/{what}"):
                for part in self.manifests.folders(version):
                    if "=" in part and part not in used:
                        self.manifests.drop(part)


def open_places(changes: DataFrame, keys: Sequence[str], time: str = "event_sim_time", cls: str = "cls", change: str = "change_id") -> DataFrame:
    """The rows that are open after all changes, with the last change that took effect.

    Changes of a key apply in the order of time, class, change. A join (0)
    opens or replaces, an update (1) replaces what is open, a leave (2)
    closes. So a key is open if the last of its joins and leaves is a join, and
    then the very last change is the one that took effect. Both are maxima:
    they aggregate partially, and a key with very many changes does no harm.
    Changes without time, class or key can't be placed and do nothing.
    """
    usable = changes.where(" and ".join(f"`{c}` is not null" for c in (*keys, time, cls, change)))
    order = F.struct(F.col(time), F.col(cls), F.col(change))
    last = usable.groupBy(*keys).agg(F.max(order).alias("_last"), F.max(F.when(F.col(cls) != 1, order)).alias("_edge"))
    return last.where(F.col(f"_edge.{cls}") == 0).select(*keys, F.col(f"_last.{change}").alias(change))
