"""Writing planned tables: Parquet, CSV and DuckDB, whole or window by window."""

from __future__ import annotations

import csv
import json
import shutil
from collections.abc import Iterable
from dataclasses import asdict
from itertools import islice
from pathlib import Path
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidelog.plans.common import RESERVED, Notice, Planned, Sink, VersionView, Window, require_unique
from tidelog.sources.bundle import Bundle, BundleError, Column, Sidecar, declared_type
from tidelog.sources.shared import Manifests, fresh_folder, new_name, put_text

#: Fixed value: the version of cursors. The cursor of a drop folder is in a file of this name.
CURSOR_VERSION = 1
CURSOR_FILE = ".tidelog-cursor.json"


def checked(table: Planned) -> Planned:
    for key in [*([table.primary] if table.primary else []), *table.unique]:
        require_unique(table.frame, key, table.name)
    return table


def write_parquet(tables: Iterable[Planned], out: str) -> None:
    """One folder per table; an existing one is refused."""
    for t in tables:
        checked(t).frame.write.mode("errorifexists").parquet(f"{out}/{t.name}")


def text(value: object) -> str:
    """A cell of a CSV file: nothing for null, True and False, numbers and times as Python shows them."""
    return "" if value is None else str(value)


def write_csv(tables: Iterable[Planned], out: str, notices: Sink = lambda n: None) -> None:
    """One ``<table>.csv`` with a header each, streamed through the driver partition by partition, for deliveries a spreadsheet can open."""
    Path(out).mkdir(parents=True, exist_ok=True)
    for t in tables:
        if t.primary or t.unique:
            notices(Notice("keys-not-declarable-csv", t.name))
        with Path(out, f"{t.name}.csv").open("w", newline="") as f:
            w = csv.writer(f)
            w.writerow(t.frame.columns)
            for row in t.sorted().toLocalIterator(prefetchPartitions=True):
                w.writerow([text(v) for v in row])


def write_csv_parts(tables: Iterable[Planned], out: str) -> None:
    """CSV for large tables: one folder of part files each, written by the executors."""
    for t in tables:
        t.frame.write.mode("errorifexists").csv(f"{out}/{t.name}", header=True, emptyValue="", nullValue="")


def _loaded(con, frame: DataFrame, run) -> None:
    """Call ``run`` with the SQL of a relation that holds the frame's rows: its Parquet parts where the shared folder is on this machine's file system, else batch by batch."""
    place = fresh_folder(frame.sparkSession, "load")
    frame.write.parquet(place)
    local = urlparse(place)
    if local.scheme in ("", "file"):
        run(f"(SELECT * EXCLUDE (filename, file_row_number) FROM read_parquet('{unquote(local.path)}/*.parquet', filename = true, file_row_number = true) ORDER BY filename, file_row_number)")
        return
    rows = frame.sparkSession.read.schema(frame.schema).parquet(place).toLocalIterator(prefetchPartitions=True)
    kinds = to_arrow_schema(frame.schema)
    batch = list(islice(rows, 50_000))
    while True:  # at least once, so that an empty table is made as well
        con.register("_batch", pa.Table.from_pylist([r.asDict() for r in batch], schema=kinds))
        run("_batch")
        con.unregister("_batch")
        if not (batch := list(islice(rows, 50_000))):
            return


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def put_table(con, table: Planned) -> None:
    """Make the table with its declared keys, append to it, or replace its rows, as its mode says and as it is there already."""
    names = lambda columns: ", ".join(map(quoted, columns))
    fresh = not con.execute("SELECT count(*) FROM duckdb_tables() WHERE table_name = ?", [table.name]).fetchone()[0]
    done = False

    def run(source: str) -> None:
        nonlocal done
        if fresh and not done:
            keys = [f"PRIMARY KEY ({names(table.primary)})"] * bool(table.primary) + [f"UNIQUE ({names(u)})" for u in table.unique]
            kinds = con.execute(f"DESCRIBE SELECT * FROM {source}").fetchall()
            con.execute(f"CREATE TABLE {quoted(table.name)} ({', '.join([*(f'{quoted(k[0])} {k[1]}' for k in kinds), *keys])})")
        elif table.mode != "append" and not done:
            con.execute(f"DELETE FROM {quoted(table.name)}")
        done = True
        con.execute(f"INSERT INTO {quoted(table.name)} SELECT * FROM {source}")

    _loaded(con, table.sorted(), run)


def write_duckdb(tables: Iterable[Planned], path: str) -> None:
    """A DuckDB file with one table each, with its declared keys, and the views of version tables."""
    import duckdb

    with duckdb.connect(path) as con:
        for t in tables:
            put_table(con, t)
            if t.view:
                con.execute(f"CREATE OR REPLACE VIEW {quoted(t.view_name)} AS {t.view.sql(t.name)}")


class DuckWarehouse:
    """A DuckDB file that grows window by window, each window in one transaction with its entry in the bookkeeping tables."""

    def __init__(self, path: str):
        self.path = path

    def cursor(self) -> dict:
        """next, fingerprint, windows; next 0 if the file isn't there or holds nothing. A file with tables but without readable bookkeeping is refused."""
        import duckdb

        fresh = {"next": 0, "fingerprint": None, "windows": []}
        if not Path(self.path).exists():
            return fresh
        with duckdb.connect(self.path, read_only=True) as con:
            there = {r[0] for r in con.execute("SELECT table_name FROM duckdb_tables() UNION SELECT view_name FROM duckdb_views() WHERE NOT internal").fetchall()}
            if not there:
                return fresh
            if not set(RESERVED) <= there:
                raise BundleError("cursor", f"{self.path} holds tables but no record of its windows")
            meta = con.execute("SELECT cursor_format_version, fingerprint FROM _export_meta").fetchall()
            if len(meta) != 1 or meta[0][0] != CURSOR_VERSION:
                raise BundleError("cursor", f"{self.path}: the record of its windows is not of version {CURSOR_VERSION}")
            done = con.execute("SELECT window_index, label FROM _export_windows ORDER BY 1").fetchall()
        return {"next": done[-1][0] + 1 if done else 0, "fingerprint": meta[0][1], "windows": [label for _, label in done]}

    def commit(self, tables: Iterable[Planned], window: Window, fingerprint: str | None) -> None:
        """Apply a window: all of it or, if anything fails, nothing. An explicit range has no bookkeeping (fingerprint None)."""
        import duckdb

        with duckdb.connect(self.path) as con:
            con.begin()
            try:
                for t in tables:
                    put_table(con, t)
                    if t.view:
                        con.execute(f"CREATE OR REPLACE VIEW {quoted(t.view_name)} AS {t.view.sql(t.name)}")
                if fingerprint is not None:
                    con.execute("CREATE TABLE IF NOT EXISTS _export_meta (cursor_format_version INTEGER NOT NULL, fingerprint VARCHAR NOT NULL)")
                    con.execute("CREATE TABLE IF NOT EXISTS _export_windows (window_index INTEGER NOT NULL, label VARCHAR NOT NULL, start_ns BIGINT NOT NULL, end_ns BIGINT NOT NULL)")
                    con.execute("INSERT INTO _export_meta SELECT ?, ? WHERE NOT EXISTS (FROM _export_meta)", [CURSOR_VERSION, fingerprint])
                    con.execute("INSERT INTO _export_windows VALUES (?, ?, ?, ?)", [window.index, window.label, window.start, window.end])
                con.commit()
            except BaseException:
                con.rollback()
                raise


class Warehouse:
    """A warehouse that grows window by window.

    All tables of a window are written beside the old ones, and one manifest
    makes them visible together with the cursor, so a run that dies leaves the
    last window as it was and the next run repeats it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Manifests(spark, path)

    def cursor(self) -> dict:
        """next (index of the window to come), fingerprint, windows; of a fresh warehouse only next 0."""
        now = self.manifests.latest()
        return {"next": now.get("next", 0), "fingerprint": now.get("fingerprint"), "windows": now.get("windows", [])}

    def commit(self, tables: Iterable[Planned], window: Window, fingerprint: str) -> None:
        now = self.manifests.latest()
        if now.get("fingerprint") not in (None, fingerprint):
            raise BundleError("fingerprint", "the warehouse was made by another configuration")
        if window.label in now.get("windows", []):
            raise BundleError("cursor", f"window {window.label} is there already")
        held, views = {k: list(v) for k, v in now.get("tables", {}).items()}, dict(now.get("views", {}))
        for t in tables:
            if t.view:
                views[t.view_name] = {"rows": t.name, **asdict(t.view)}
            place = f"{self.path}/data/{t.name}/{window.label}-{new_name(now['version'] + 1)}"
            checked(t).frame.write.parquet(place)
            held[t.name] = [*held.get(t.name, []), place] if t.mode == "append" else [place]
        following = now.get("next", 0) if window.index is None else window.index + 1
        self.manifests.publish({"tables": held, "views": views, "next": following, "fingerprint": fingerprint, "windows": [*now.get("windows", []), window.label]}, now["version"])

    def table(self, name: str) -> DataFrame:
        """A table, or a version table with the ends its view supplies."""
        now = self.manifests.latest()
        if name in now.get("views", {}):
            view = {k: tuple(v) if isinstance(v, list) else v for k, v in now["views"][name].items()}
            return VersionView(**{k: v for k, v in view.items() if k != "rows"})(self.spark.read.parquet(*now["tables"][view["rows"]]))
        if name not in now.get("tables", {}):
            raise BundleError("table", f"{self.path} has no table {name}")
        return self.spark.read.parquet(*now["tables"][name])


def drop_window(tables: Iterable[Planned], out: str, window: Window, fingerprint: str | None, notices: Sink = lambda n: None) -> None:
    """One folder of CSV files per window, named by its label; staged and renamed, so it is there whole or not at all. The cursor follows it."""
    target, stage = Path(out, window.label), Path(out, f".{window.label}")
    if target.exists():
        if window.index is None or Path(out, CURSOR_FILE).exists():
            raise BundleError("cursor", f"{target} is there already")
        shutil.rmtree(target)  # the first window, whose cursor was never written
    shutil.rmtree(stage, ignore_errors=True)
    write_csv(tables, str(stage), notices)
    stage.rename(target)
    if fingerprint is not None:
        draft = Path(out, f"{CURSOR_FILE}.draft")
        draft.write_text(json.dumps({"cursor_format_version": CURSOR_VERSION, "fingerprint": fingerprint, "next_window_index": window.index + 1}, sort_keys=True))
        draft.replace(Path(out, CURSOR_FILE))


def drop_cursor(out: str, first_label: str | None = None) -> dict:
    """The cursor of a drop folder; next 0 if it holds nothing, or only the first window whose cursor got lost in a crash. Other folders without a readable cursor are refused."""
    kept = Path(out, CURSOR_FILE)
    if not kept.exists():
        there = [p.name for p in Path(out).iterdir() if not p.name.startswith(".")] if Path(out).exists() else []
        if there and there != [first_label]:
            raise BundleError("cursor", f"{out} holds {', '.join(sorted(there)[:3])} but no record of its windows")
        return {"next": 0, "fingerprint": None}
    try:
        said = json.loads(kept.read_text())
        if said["cursor_format_version"] != CURSOR_VERSION or type(said["next_window_index"]) is not int or type(said["fingerprint"]) is not str:
            raise ValueError("of another shape or version")
    except (ValueError, KeyError, TypeError) as x:
        raise BundleError("cursor", f"{kept}: {x}") from x
    return {"next": said["next_window_index"], "fingerprint": said["fingerprint"]}


def write_bundle(bundle: Bundle, out: str) -> Sidecar:
    """A bundle's tables, each in the order of all its columns, with a sidecar made from what was written."""
    from dataclasses import replace

    tables = []
    for t in bundle.sidecar.tables:
        frame = bundle.table(t.name)
        names = [c for c in frame.columns]
        frame.orderBy(*(F.col(c).asc_nulls_first() for c in names)).write.mode("errorifexists").parquet(f"{out}/{t.name}.parquet")
        back = bundle.spark.read.parquet(f"{out}/{t.name}.parquet")
        facts = {c.name: c for c in t.columns}
        columns = tuple(replace(facts[f.name], type=declared_type(f.dataType)) if f.name in facts else Column(f.name, declared_type(f.dataType)) for f in back.schema.fields)
        tables.append(replace(t, columns=columns, rows=back.count()))
    side = replace(bundle.sidecar, tables=tuple(tables))
    put_text(bundle.spark, f"{out}/base.json", json.dumps(side.raw(), indent=1, sort_keys=True))
    return side
