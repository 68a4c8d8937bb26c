from __future__ import annotations

import json
import time

import pytest

from markspan import cli
from markspan.operators.reachability import explore
from markspan.queries import MALFORMED, sample_net
from markspan.sinks.text import net_json, tree_dot, write_lines, write_text
from markspan.sources.nets import nets_from_documents, read_nets, save_net, write_net
from markspan.streaming.net_stream import explore_stream, read_net_stream
from tests import simulator


def test_json_round_trip(spark, tmp_path):
    for name in ("net_1", "net_3"):
        write_net({**sample_net(name), "comment": "ignored"}, str(tmp_path / f"{name}.json"))
    rows = {r.net_id: r.asDict(recursive=True) for r in read_nets(spark, f"{tmp_path}/*.json").collect()}
    assert {k: v for k, v in rows["net_1"].items() if k != "net_id"} == sample_net("net_1")
    text = {r.net_id: json.loads(r.json) for r in net_json(read_nets(spark, str(tmp_path))).collect()}
    assert text["net_3"] == sample_net("net_3")


@pytest.mark.parametrize("value", ['"2"', "3.7", "[1]"])
def test_json_numbers_must_be_integers(spark, tmp_path, value):
    text = json.dumps(sample_net("net_1")).replace('"M0": [1', f'"M0": [{value}', 1)
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception):
        explore(read_nets(spark, str(tmp_path))).collect()


def test_tree_dot_text(spark, tmp_path):
    lines = tree_dot(explore(nets_from_documents(spark, {"n": sample_net("net_3")})))
    write_text(lines, str(tmp_path / "tree.dot"))
    text = (tmp_path / "tree.dot").read_text().splitlines()
    rows = sorted(simulator.explore(sample_net("net_3")))
    node = lambda path: "m0" + "".join(f"_t{t}" for t in path)
    boxes = [f'  "{node(p)}" [label="[{", ".join("ω" if x < 0 else str(x) for x in m)}]"];' for p, m in rows]
    arrows = [f'  "{node(p[:-1])}" -> "{node(p)}" [label="t{p[-1]}"];' for p, _ in rows if p]
    assert text == ["digraph ReachabilityTree {", "  node [shape=box];", "", *boxes, "", *arrows, "}"]
    assert '  "m0_t0_t1_t2_t3_t4_t5_t0_t2_t5" [label="[ω, ω, 0, ω, ω, ω, 0, ω]"];' in text
    assert sum(" -> " in x for x in text) == 27 and sum("[label=\"[" in x for x in text) == 28
    write_lines(lines, str(tmp_path / "dir"), one_file=True)
    assert [r.value for r in spark.read.text(str(tmp_path / "dir")).collect()] == text


def test_command_line(spark, tmp_path, capsys):
    net, dot = tmp_path / "n.json", tmp_path / "n.dot"
    assert cli.main(["generate", "--branches", "3", "--branches-len", "1,1,1", "--tail-length", "2", "--output", str(net)]) == 0
    assert json.loads(net.read_text()) == sample_net("net_1")
    assert cli.main(["generate", "--branches", "2", "--branches-len", "1", "--tail-length", "2"]) == 1
    assert cli.main(["analyze"]) == 1
    assert cli.main(["analyze", "--input", str(tmp_path / "absent.json")]) == 1
    assert cli.main(["analyze", "--input", str(net), "--output", str(dot), "--nthreads", "x"]) == 1
    assert cli.main(["analyze", "--input", str(net), "--output", str(dot), "--nthreads", "2"]) == 0
    assert "Time taken:" in capsys.readouterr().out and dot.read_text().count(" -> ") == 10
    dot.unlink()
    assert cli.main(["analyze", "--out", str(dot), "--input", str(net), "--debugging", "--output"]) == 0 and not dot.exists(), "no abbreviations; an option without a value is ignored"
    assert cli.main(["editor-xml", str(net), str(tmp_path / "n.xml")]) == 0
    assert (tmp_path / "n.xml").read_text().count("<arc ") == 18
    assert cli.main(["pnml", str(net), str(tmp_path / "n.pnml")]) == 0
    assert "<name><text>n.pnml</text></name>" in (tmp_path / "n.pnml").read_text()
    assert cli.main(["dot", str(net)]) == 0
    assert "p0 (start)" in capsys.readouterr().out


def test_analyze_options():
    got = cli.analyze_options(["--output", "--debug", "x", "--input", "a", "--input", "b", "--nthreads", "3", "--markingid"])
    assert vars(got) == {"command": "analyze", "input": "b", "nthreads": 3, "output": "--debug", "markingid": None, "debug": False, "compat": False}
    for words in ([], ["--input"], ["--input", "a", "--nthreads", "many"]):
        with pytest.raises(ValueError):
            cli.analyze_options(words)


def test_repeated_markings_are_named(spark, tmp_path, caplog):
    (tmp_path / "n.json").write_text(json.dumps(MALFORMED["uncovered"]))
    with caplog.at_level("INFO", logger="markspan"):
        assert cli.main(["analyze", "--input", str(tmp_path / "n.json"), "--compat"]) == 0
        assert cli.main(["analyze", "--input", str(tmp_path / "n.json")]) == 1
    assert "repeated markings: [1, 0, 2]" in caplog.text


def test_reports_while_it_runs(spark, caplog):
    with caplog.at_level("INFO", logger="markspan"), cli._reports(spark, 0.01, 0.01) as found:
        found.update(level=3, states=12)
        time.sleep(0.1)
    assert "level: 3, states: 12" in caplog.text


def test_nets_from_a_shared_store(spark, tmp_path):
    save_net(spark, sample_net("net_3"), f"file://{tmp_path}/deep/net_3.json")
    assert read_nets(spark, f"file://{tmp_path}/deep").first().asDict(recursive=True) == {"net_id": "net_3", **sample_net("net_3")}


def test_stream_of_nets(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_net(sample_net("net_1"), str(folder / "net_1.json"))
    for _ in range(2):
        query = explore_stream(read_net_stream(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "check"))
        query.awaitTermination()
        write_net(sample_net("net_3"), str(folder / "net_3.json"))
    rows = spark.read.parquet(str(tmp_path / "out")).groupBy("net_id").count().collect()
    assert {r.net_id: r["count"] for r in rows} == {"net_1": 11, "net_3": 28}
