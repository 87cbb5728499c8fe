"""Small pieces that need no cluster or broker."""

import pytest

from tidelog.plans.playback import Atom, Playback
from tidelog.sources import shared
from tidelog.sources.adapters import sales
from tidelog.streaming import kafka


def test_lag_of_a_reader():
    progress = {"sources": [{"latestOffset": '{"a":{"0":9,"1":4}}', "endOffset": {"a": {"0": 5, "1": 6}}}], "eventTime": {"watermark": "2024-01-01T00:00:00.000Z"}}
    assert kafka.lag(progress) == {"a": 4} and kafka.lag(None) == {} and kafka.watermark(progress).startswith("2024")


def test_stamps(spark):
    p = Playback(sales(spark, "/root/testdata/sf0.001"), [Atom("order"), Atom("order", "lines")])
    rows = p.stamped(p.atoms[0], p.snapshot(10**17)["order"])
    assert {"sub_type", "created_sim_time_ts"} <= set(rows.columns) and rows.where("sub_type not in ('F', 'O', 'P')").count() == 0
    lines = p.stamped(p.atoms[1], p.snapshot(10**17)["order.lines"])
    assert {"owner_sub_type", "joined_sim_time_ts"} <= set(lines.columns) and lines.count() > 0


def test_versions_are_published_once(spark):
    m = shared.Manifests(spark, shared.fresh_folder(spark, "m"))
    assert m.latest() == {"version": 0}
    m.publish({"a": 1}, 0)
    assert m.latest() == {"a": 1, "version": 1}
    with pytest.raises(RuntimeError):
        m.publish({"a": 2}, 0)
    shared.drop_fresh()


def test_command_line(spark, tmp_path):
    import json

    from tidelog import cli
    from tidelog.plans import config
    from tidelog.sources.writers import write_bundle

    bundle = f"file://{tmp_path}/bundle"
    write_bundle(sales(spark, "/root/testdata/sf0.001"), bundle)
    assert cli.main(["validate", bundle]) == 0
    assert cli.main(["init", bundle, str(tmp_path / "c.yaml"), "--mode", "source"]) == 0
    assert cli.main(["export", bundle, str(tmp_path / "c.yaml"), f"file://{tmp_path}/out"]) == 0
    assert spark.read.parquet(f"file://{tmp_path}/out/order").count() == 1500
    (tmp_path / "s.json").write_text(json.dumps({"content": "state-changes", "streams": [{"name": "n", "kind": "nation", "properties": ["name"]}]}))
    assert config.load(str(tmp_path / "s.json"))["content"] == "state-changes"
    assert cli.main(["stream", bundle, str(tmp_path / "s.json"), "--sink", "file", "--out", str(tmp_path / "f")]) == 0
    assert len((tmp_path / "f" / "n.jsonl").read_text().splitlines()) == 25
    (tmp_path / "x.json").write_text(json.dumps({"seed": 1, "operations": [{"kind": "null_cells", "target": {"table": "records__nation", "columns": ["prop__name"]}, "amount": {"count": 3}}]}))
    assert cli.main(["corrupt", bundle, str(tmp_path / "x.json"), f"file://{tmp_path}/bad"]) == 0
    assert spark.read.json(f"file://{tmp_path}/bad/defects.json").count() == 3
    (tmp_path / "bad.json").write_text('{"mode": "nothing"}')
    assert cli.main(["export", bundle, str(tmp_path / "bad.json"), str(tmp_path / "o")]) == 1
