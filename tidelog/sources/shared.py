"""The folder all executors share, and versions published in it by an atomic manifest.

Tables written here replace cached or locally checkpointed data: they outlive
the loss of any executor.
"""

from __future__ import annotations

import atexit
import json
import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset in local mode (tests), a new local one. A cluster must name one."""
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError(f"{SETTING} must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set(SETTING, root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_fresh: list[tuple[SparkSession, str]] = []


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; what is in it goes when the driver's Python ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _fresh.append((spark, path))
    return path


@atexit.register
def drop_fresh() -> None:
    """Delete the folders made so far. Frames that read them are no longer usable."""
    while _fresh:
        spark, path = _fresh.pop()
        try:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001  the session is gone; its folder is the cluster's to clear
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back: cuts the lineage."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """One file with the text; an existing one is refused."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, False)
    out.write(bytearray(text.encode()))
    out.close()


class Manifests:
    """Numbered JSON manifests beside a table's files.

    A version exists from the moment its manifest is put in place, which
    fails if the version is there already: of two runs that race for a version
    one wins and the other starts again from what the winner published.
    Files of a run that failed before are never named by a manifest, so
    readers never see them and the next run simply starts again from the last
    version.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.path).getFileSystem(self._conf)

    def _place(self, version: int):
        return self._hadoop.Path(f"{self.path}/_manifests/v{version:08d}.json")

    def latest(self) -> dict:
        """The newest manifest; version 0 without content if there is none."""
        folder = self._hadoop.Path(f"{self.path}/_manifests")
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        found = sorted(n for n in names if n.startswith("v") and n.endswith(".json"))
        return self.at(int(found[-1][1:9])) if found else {"version": 0}

    def at(self, version: int) -> dict:
        stream = self._fs.open(self._place(version))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def publish(self, content: dict, base: int) -> dict:
        """Make content version base + 1. Fails if another run published that version first."""
        version, place = base + 1, self._place(base + 1)
        draft = self._hadoop.Path(f"{self.path}/_manifests/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(content | {"version": version}, sort_keys=True).encode()))
        out.close()
        try:
            self._put(draft, place)
        except Exception as x:
            raise RuntimeError(f"version {version} of {self.path} could not be published; another run may have done so") from x
        finally:
            self._fs.delete(draft, False)
        return content | {"version": version}

    def _put(self, draft, place) -> None:
        """Give the draft its final name in one step that fails if the name is taken."""
        if self._fs.getUri().getScheme() == "file":  # renaming would replace the other run's file
            os.link(*(unquote(urlparse(p.toUri().toString()).path) for p in (draft, place)))
            return
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        kinds = jvm.org.apache.hadoop.fs.Options.Rename
        never = gateway.new_array(kinds, 1)
        never[0] = kinds.NONE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(draft, place, never)

    def drop(self, path: str) -> None:
        """Delete a folder that no manifest in use names."""
        self._fs.delete(self._hadoop.Path(path), True)

    def folders(self, path: str) -> list[str]:
        """The folders in a folder, as full paths without scheme for local ones; none if it isn't there."""
        place = self._hadoop.Path(path)
        return [f"{path}/{x.getPath().getName()}" for x in self._fs.listStatus(place)] if self._fs.exists(place) else []


def new_name(version: int) -> str:
    """A folder name for a version's files that no other run uses."""
    return f"v{version:08d}-{uuid.uuid4().hex[:12]}"
