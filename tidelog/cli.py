"""Command line: validate, export, init, stream, mixer, corrupt. Exit codes: 0 done, 1 refused or failed, 2 misuse, 3 nothing left to export."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from datetime import datetime

from pyspark.sql import SparkSession

from tidelog.plans import config, conformance, incremental, propose
from tidelog.plans.common import Notice, resolve_anchor
from tidelog.sources import writers
from tidelog.sources.bundle import BundleError, open_bundle
from tidelog.streaming import events as ev
from tidelog.streaming import mixer, pacing


def notice(n: Notice) -> None:
    print(f"notice {n.code}: {n.message}", file=sys.stderr)


def cmd_validate(spark: SparkSession, a) -> int:
    findings = conformance.validate(open_bundle(spark, a.bundle))
    for f in findings:
        print(f"{f.check} {'ok' if f.ok else 'FAILED ' + '; '.join(f.problems)}")
    return 0 if all(f.ok for f in findings) else 1


def cmd_export(spark: SparkSession, a) -> int:
    bundle, export = open_bundle(spark, a.bundle), config.export(config.load(a.config))
    anchor = resolve_anchor(bundle.sidecar, export.rebase, a.base_date and datetime.fromisoformat(a.base_date), a.timezone)
    if a.next:
        span = incremental.export_next(spark, bundle, export, a.out, a.fmt, notice, anchor)
        print(span.label if span else "drained")
        return 0 if span else 3
    if (a.range_from is None) != (a.range_to is None):
        raise BundleError("usage", "--from and --to go together")
    if a.range_from is not None:
        print(incremental.export_range(spark, bundle, export, a.out, a.fmt, a.range_from, a.range_to, anchor, notice).label)
        return 0
    tables = incremental.export_tables(bundle, export, anchor, None, notice)
    write = {"parquet": writers.write_parquet, "duckdb": writers.write_duckdb, "csv": lambda t, o: writers.write_csv(t, o, notice)}[a.fmt]
    write(tables, a.out)
    return 0


def cmd_init(spark: SparkSession, a) -> int:
    made = propose.propose(open_bundle(spark, a.bundle), a.mode)
    try:
        import yaml

        text = yaml.safe_dump(made, sort_keys=False)
    except ImportError:
        text = json.dumps(made, indent=2)
    with open(a.out, "w") as f:
        f.write(text)
    return 0


def _lines(spark: SparkSession, a):
    bundle, streams = open_bundle(spark, a.bundle), config.streams(config.load(a.config))
    anchor = resolve_anchor(bundle.sidecar, streams.rebase, a.base_date and datetime.fromisoformat(a.base_date), a.timezone)
    made = ev.events(bundle, streams)
    return streams, made, ev.jsonl(made, anchor) if a.fmt == "jsonl" else ev.debezium(bundle, made, streams, anchor)


def cmd_stream(spark: SparkSession, a) -> int:
    streams, made, lines = _lines(spark, a)
    topics = [s.name for s in streams.streams]
    if a.sink == "kafka":
        ev.write_kafka(lines, made, ev.servers(a.bootstrap_servers, streams, os.environ.get("TIDELOG_KAFKA_BOOTSTRAP")))
    elif a.sink == "file":
        if not a.out:
            raise BundleError("usage", "the file sink needs --out")
        print(json.dumps(ev.deliver_files(lines, a.out, topics)))
    else:
        clock = pacing.resolve_clock(streams.clock, a.speed, a.idle_cap, a.fast)
        for line in pacing.paced(ev.deliver_lines(lines), clock):
            print(line, flush=clock.mode == "realtime")
    return 0


def cmd_mixer(spark: SparkSession, a) -> int:
    import threading

    streams, made, lines = _lines(spark, a)
    end = made.agg({"sim_time": "max"}).first()[0] or 0
    state = mixer.Mixer({s.name: mixer.Topic(s.name) for s in streams.streams}, end, a.speed or 1.0, not a.paused)
    if a.consume:
        empty = frozenset(r["topic"] for r in ev.topic_counts(made, streams).where("events = 0").collect())  # one row per topic
        joins = [tuple(j.split("-", 1)) for j in a.join or []]
        state.consumer = mixer.Consumer([s.name for s in streams.streams], empty, a.window or [], joins)
        state.budget = mixer.Budget(a.consume_rate)
    target = ev.servers(a.bootstrap_servers, streams, os.environ.get("TIDELOG_KAFKA_BOOTSTRAP")) if a.sink == "kafka" else None
    server = mixer.serve(state, a.host, a.port)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    print(json.dumps({"control": f"http://{server.server_address[0]}:{server.server_address[1]}"}), flush=True)

    polled: list[tuple[str, int]] = []

    def send(topic: str, due) -> None:
        if target:
            ev.write_kafka(due, made, target)
        for row in due.orderBy("seq").toLocalIterator() if a.consume or not target else ():
            polled.append((topic, row["sim_time"]))
            if not target:
                print(row["value"], flush=True)

    while not (state.frontier >= end and all(t.muted or t.edge >= end - t.lag for t in state.topics.values())):
        mixer.release(lines, state, a.tick, send)
        state.pull(a.tick, polled)
        polled.clear()
        time.sleep(a.tick)
    while state.budget and state.budget.buffer:  # what the consumer still owes
        state.pull(a.tick, [])
        time.sleep(a.tick)
    print(json.dumps(state.meters()), flush=True)
    server.shutdown()
    return 0


def cmd_corrupt(spark: SparkSession, a) -> int:
    from tidelog.operators import corrupt

    made, defects = corrupt.corrupt(open_bundle(spark, a.bundle), config.load(a.config))
    writers.write_bundle(made, a.out)
    corrupt.write_manifest(defects, f"{a.out}/defects.json")
    print(corrupt.summary_text(defects))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidelog", description=__doc__)
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, run, *names: str) -> argparse.ArgumentParser:
        q = sub.add_parser(name)
        for n in names:
            q.add_argument(n)
        q.set_defaults(run=run)
        return q

    verb("validate", cmd_validate, "bundle")
    q = verb("export", cmd_export, "bundle", "config", "out")
    q.add_argument("--fmt", choices=["parquet", "csv", "duckdb"], default="parquet")
    q.add_argument("--next", action="store_true")
    q.add_argument("--from", dest="range_from")
    q.add_argument("--to", dest="range_to")
    q.add_argument("--base-date")
    q.add_argument("--timezone")
    q = verb("init", cmd_init, "bundle", "out")
    q.add_argument("--mode", choices=["dimensional", "source", "streaming"], default="dimensional")
    for name, run in (("stream", cmd_stream), ("mixer", cmd_mixer)):
        q = verb(name, run, "bundle", "config")
        q.add_argument("--fmt", choices=["jsonl", "debezium"], default="jsonl")
        q.add_argument("--speed", type=float)
        q.add_argument("--bootstrap-servers")
        q.add_argument("--base-date")
        q.add_argument("--timezone")
        if name == "stream":
            q.add_argument("--sink", choices=["stdout", "file", "kafka"], default="stdout")
            q.add_argument("--out")
            q.add_argument("--idle-cap", type=float)
            q.add_argument("--fast", action="store_true")
        else:
            q.add_argument("--tick", type=float, default=1.0)
            q.add_argument("--sink", choices=["stdout", "kafka"], default="stdout")
            q.add_argument("--consume", action="store_true")
            q.add_argument("--consume-rate", type=float)
            q.add_argument("--window", type=int, action="append")
            q.add_argument("--join", action="append", metavar="FACT-DIMENSION")
            q.add_argument("--paused", action="store_true")
            q.add_argument("--host", default="127.0.0.1")
            q.add_argument("--port", type=int, default=0)
    verb("corrupt", cmd_corrupt, "bundle", "config", "out")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tidelog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return a.run(spark, a)
    except BundleError as x:
        print(f"refused: {x}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
