"""Exports as a whole, for one window, or for the next one."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

from tidelog.plans import base, dimensional, source
from tidelog.plans.common import Anchor, Planned, Sink, Window, civil_range, fingerprint, resolve_anchor, window
from tidelog.plans.config import Export
from tidelog.sources import writers
from tidelog.sources.bundle import Bundle, BundleError

PLANNERS = {"dimensional": dimensional.plan, "source": source.plan, "base": base.plan}


def export_tables(bundle: Bundle, export: Export, anchor: Anchor | None = None, span: Window | None = None, notices: Sink = lambda n: None) -> list[Planned]:
    anchor = anchor or resolve_anchor(bundle.sidecar, export.rebase)
    return PLANNERS[export.mode](bundle, export, anchor, span, notices)


def explicit(start: int, end: int) -> Window:
    return civil_range(str(start), str(end), None)


def export_range(spark: SparkSession, bundle: Bundle, export: Export, out: str, fmt: str, start: str, end: str, anchor: Anchor | None = None, notices: Sink = lambda n: None) -> Window:
    """Export one range given by hand to a place where nothing is yet; no cursor is kept."""
    anchor = anchor or resolve_anchor(bundle.sidecar, export.rebase)
    span = civil_range(start, end, anchor)
    tables = export_tables(bundle, export, anchor, span, notices)
    if fmt == "duckdb":
        if Path(out).exists():
            raise BundleError("range", f"{out} is there already")
        writers.DuckWarehouse(out).commit(tables, span, None)
    elif fmt == "csv":
        writers.drop_window(tables, out, span, None, notices)
    else:
        writers.write_parquet(tables, out)
    return span


def export_next(spark: SparkSession, bundle: Bundle, export: Export, out: str, fmt: str = "parquet", notices: Sink = lambda n: None, anchor: Anchor | None = None) -> Window | None:
    """Export the window after the last one; None when the tape has been read to its end."""
    if export.incremental is None:
        raise BundleError("incremental", "the configuration has no incremental section")
    anchor = anchor or resolve_anchor(bundle.sidecar, export.rebase)
    mark = fingerprint(export, anchor, bundle.sidecar, fmt)
    if fmt not in ("parquet", "duckdb", "csv"):
        raise BundleError("format", f"{fmt} is no format of windows")
    warehouse = writers.Warehouse(spark, out) if fmt == "parquet" else writers.DuckWarehouse(out) if fmt == "duckdb" else None
    cursor = warehouse.cursor() if warehouse else writers.drop_cursor(out, window(0, export.incremental, anchor).label)
    if cursor["fingerprint"] not in (None, mark):
        raise BundleError("fingerprint", "the windows so far were made by another configuration")
    span = window(cursor["next"], export.incremental, anchor)
    if bundle.sidecar.slice_at is not None and span.start > bundle.sidecar.slice_at:
        return None
    tables = export_tables(bundle, export, anchor, span, notices)
    if warehouse:
        warehouse.commit(tables, span, mark)
    else:
        writers.drop_window(tables, out, span, mark, notices)
    return span
