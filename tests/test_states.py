from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from markspan.functions import vectors as V
from markspan.operators import reachability
from markspan.operators.reachability import StateLimit, explain_node, explore, repeated_markings, state_counts, tree_edges
from markspan.plans.compile import NetError, is_bounded, problems
from markspan.queries import ORDER_NET, sample_net
from markspan.sources.nets import generate_net, generated_nets, nets_from_documents
from tests import simulator

NET_1_STATES = {
    "m0": [1, 0, 0, 0, 0, 0, 0, 0, 0],
    "m0_t0": [0, 1, 0, 1, 0, 1, 0, 0, 0],
    "m0_t0_t1": [0, 0, 1, 1, 0, 1, 0, 0, 0],
    "m0_t0_t2": [0, 1, 0, 0, 1, 1, 0, 0, 0],
    "m0_t0_t3": [0, 1, 0, 1, 0, 0, 1, 0, 0],
    "m0_t0_t1_t2": [0, 0, 1, 0, 1, 1, 0, 0, 0],
    "m0_t0_t1_t3": [0, 0, 1, 1, 0, 0, 1, 0, 0],
    "m0_t0_t2_t3": [0, 1, 0, 0, 1, 0, 1, 0, 0],
    "m0_t0_t1_t2_t3": [0, 0, 1, 0, 1, 0, 1, 0, 0],
    "m0_t0_t1_t2_t3_t4": [0, 0, 0, 0, 0, 0, 0, 1, 0],
    "m0_t0_t1_t2_t3_t4_t5": [0, 0, 0, 0, 0, 0, 0, 0, 1],
}


def random_net(rng: random.Random) -> dict:
    np, nt = rng.randint(1, 4), rng.randint(1, 4)
    matrix = lambda: [[rng.choice([0, 0, 0, 1, 1, 2]) for _ in range(nt)] for _ in range(np)]
    return {
        "M0": [rng.randint(0, 2) for _ in range(np)],
        "I_minus": matrix(),
        "I_plus": matrix(),
        "subnet_definitions": [{"id": 0, "place_indices": list(range(np)), "trans_indices": list(range(nt))}],
    }


def test_net_1(spark):
    got = {r.node_id: r.marking for r in explore(nets_from_documents(spark, {"n": sample_net("net_1")})).collect()}
    assert got == NET_1_STATES


def test_many_nets_in_one_batch_match_the_simulator(spark):
    rng = random.Random(3)
    nets = {"order": ORDER_NET, "net_3": sample_net("net_3")}
    while len(nets) < 40:
        net = random_net(rng)
        if (want := simulator.explore(net, 60)) is not None and len(want) < 60:
            nets[f"r{len(nets)}"] = net
    frame = nets_from_documents(spark, nets)
    states = explore(frame)
    rows = states.collect()
    for name, net in nets.items():
        want = sorted(simulator.explore(net))
        assert sorted((tuple(r.path), tuple(r.marking)) for r in rows if r.net_id == name) == want, name
    assert len([r for r in rows if r.net_id == "order"]) == 17
    assert len([r for r in rows if r.net_id == "net_3"]) == 28
    assert repeated_markings(states).count() == 0
    edges = tree_edges(states)
    assert edges.count() == len(rows) - len(nets)
    ids = states.select("net_id", F.col("node_id").alias("parent_id"))
    assert edges.join(ids, ["net_id", "parent_id"], "left_anti").count() == 0


def test_family_closed_form_and_generators_agree(spark):
    params = [([1, 1, 1], 2), ([4, 3, 5], 1), ([0, 2], 1), ([], 1), ([3], 3), ([2, 0, 1], 2)]
    frame = spark.createDataFrame([(str(i), lengths, k, i % 2 == 1) for i, (lengths, k) in enumerate(params)], "net_id string, branches_len array<int>, tail_length int, omegas boolean")
    made = {r.net_id: r.asDict(recursive=True) for r in generated_nets(frame).collect()}
    for i, (lengths, k) in enumerate(params):
        assert {x: v for x, v in made[str(i)].items() if x != "net_id"} == generate_net(len(lengths), lengths, k, i % 2 == 1)
    # without branches the join needs nothing and the net is unbounded
    plain = generated_nets(frame.withColumn("omegas", F.lit(False)).where(F.size("branches_len") > 0))
    counts = {r.net_id: r.n_states for r in state_counts(explore(plain)).collect()}
    for i, (lengths, k) in enumerate(params):
        if not lengths:
            continue
        want, product = 1 + k, 1
        for x in lengths:
            product *= x + 1
        assert counts[str(i)] == want + product
    assert {r[0] for r in plain.select(is_bounded()).collect()} == {True}


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        generate_net(2, [1], 1)
    with pytest.raises(ValueError):
        generate_net(1, [1], 0)
    frame = spark.createDataFrame([("x", [1], 0, False)], "net_id string, branches_len array<int>, tail_length int, omegas boolean")
    with pytest.raises(Exception, match="tail_length"):
        generated_nets(frame).collect()


@pytest.mark.parametrize("stride", [1, 2, 5])
def test_levels_per_job_and_segments_do_not_matter(spark, monkeypatch, stride):
    monkeypatch.setattr(reachability, "STRIDE", stride)
    monkeypatch.setattr(reachability, "SEGMENTS", 2)
    monkeypatch.setattr(reachability, "SMALL_FRONTIER", 0 if stride == 2 else 5_000)
    net = generate_net(2, [2, 1], 1)
    net["M0"][0] = 2
    states = explore(nets_from_documents(spark, {"n": net}))
    assert sorted((tuple(r.path), tuple(r.marking)) for r in states.collect()) == sorted(simulator.explore(net))
    assert {r.depth == len(r.path) for r in states.collect()} == {True}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("markspan_")]


def test_bounded_and_unbounded_nets_in_one_batch(spark, monkeypatch):
    monkeypatch.setattr(reachability, "SEGMENTS", 3)
    nets = {"a": sample_net("net_1"), "b": sample_net("net_3"), "c": ORDER_NET, "d": generate_net(2, [2, 1], 2)}
    calls = []
    states = explore(nets_from_documents(spark, nets), progress=lambda *x: calls.append(x))
    for name, net in nets.items():
        assert sorted((tuple(r.path), tuple(r.marking)) for r in states.where(F.col("net_id") == name).collect()) == sorted(simulator.explore(net)), name
    assert calls[-1][1] == states.count() - len(nets)


def test_large_transition_tables_are_joined(spark, monkeypatch):
    monkeypatch.setattr(reachability, "BROADCAST_CELLS", 0)
    assert explore(nets_from_documents(spark, {"n": sample_net("net_1")})).count() == 11


def test_limits_raise(spark):
    nets = nets_from_documents(spark, {"n": sample_net("net_1")})
    with pytest.raises(StateLimit):
        explore(nets, max_states=3)
    with pytest.raises(StateLimit):
        explore(nets, max_levels=2)


def test_strict_rejects(spark):
    good = sample_net("net_1")
    change = lambda **kw: {**good, **kw}
    subnets = good["subnet_definitions"]
    bad = {
        "ragged": change(I_minus=[*good["I_minus"][:-1], [0]]),
        "short": change(M0=good["M0"][:-1]),
        "range": change(subnet_definitions=[*subnets[:-1], {**subnets[-1], "place_indices": [99]}]),
        "ids": change(subnet_definitions=[{**s, "id": 0} for s in subnets]),
        "negative": change(I_plus=[[-x for x in r] for r in good["I_plus"]]),
        "omega": change(M0=[-1] + good["M0"][1:]),
        "uncovered": change(subnet_definitions=subnets[:-1]),
        "unlisted": change(subnet_definitions=[{**s, "trans_indices": s["trans_indices"][:-1]} for s in subnets]),
    }
    found = {r.net_id for r in problems(nets_from_documents(spark, {**bad, "good": good})).collect()}
    assert found == set(bad)
    with pytest.raises(NetError):
        explore(nets_from_documents(spark, {"x": bad["uncovered"]}))


def test_compat_keeps_what_malformed_nets_do(spark):
    # place 1 is in no subnet and transition 1 neither: the place empties, the transition makes nodes that end
    net = {"M0": [1, 1], "I_minus": [[1, 0], [0, 1]], "I_plus": [[1, 0], [0, 0]], "subnet_definitions": [{"id": 0, "place_indices": [0], "trans_indices": [0]}]}
    rows = {(r.node_id, tuple(r.marking)) for r in explore(nets_from_documents(spark, {"n": net}), strict=False).collect()}
    assert rows == {("m0", (1, 0)), ("m0_t0", (1, 0)), ("m0_t1", (1, 0))}
    empty = {**sample_net("net_1"), "subnet_definitions": []}
    rows = {(r.node_id, tuple(r.marking)) for r in explore(nets_from_documents(spark, {"n": empty}), strict=False).collect()}
    assert rows == {("m0", (0,) * 9), ("m0_t0", (0,) * 9)}
    omega = {"M0": [-1, 0], "I_minus": [[3], [0]], "I_plus": [[0], [1]], "subnet_definitions": [{"id": 0, "place_indices": [0, 1], "trans_indices": [0]}]}
    rows = {(r.node_id, tuple(r.marking)) for r in explore(nets_from_documents(spark, {"n": omega}), strict=False).collect()}
    assert rows == {("m0", (-1, 0)), ("m0_t0", (-1, -1))}


def test_explained_root_child(spark):
    nets = nets_from_documents(spark, {"n": sample_net("net_3")})
    rows = explain_node(explore(nets), nets, "m0_t0_t1_t2_t3_t4_t5").where("node_id = 'm0_t0_t1_t2_t3_t4_t5'").orderBy("step").collect()
    assert [r.step for r in rows] == [1, 2, 3, 4, 5, 6]
    assert rows[-1].ancestor_id == "m0" and rows[-1].verdict == "grown"


def test_vector_edge_cases(spark):
    row = spark.range(1).select(
        V.is_enabled(F.array(F.lit(-1), F.lit(2)), F.array(F.lit(9), F.lit(2))).alias("enabled"),
        V.fire(F.array(F.lit(-1), F.lit(2)), F.array(F.lit(5), F.lit(-2))).alias("fired"),
        V.label(F.array(F.lit(1), F.lit(-1))).alias("label"),
        V.node_id(F.array().cast("array<int>")).alias("root"),
        V.parent_id(F.lit("m0")).alias("none"),
        V.parent_id(F.lit("m0_t1_t12")).alias("parent"),
        V.quoted(F.lit('a"b')).alias("quoted"),
        V.is_ancestor_path(F.array(F.lit(1)), F.array(F.lit(10))).alias("ancestor"),
        V.local_index(F.array(F.lit(4), F.lit(7)), 7).alias("local"),
        V.local_index(F.array(F.lit(4)), 9).alias("absent"),
    ).first()
    assert row.asDict() == {
        "enabled": True, "fired": [-1, 0], "label": "[1, ω]", "root": "m0", "none": None, "parent": "m0_t1", "quoted": '"a\\"b"', "ancestor": False, "local": 1, "absent": -1,
    }


def test_overflow_is_an_error(spark):
    with pytest.raises(Exception, match="OVERFLOW"):
        spark.range(1).select(V.fire(F.array(F.lit(2147483647)), F.array(F.lit(1))).alias("x")).collect()


def test_empty_table_of_nets(spark):
    assert explore(nets_from_documents(spark, {"n": sample_net("net_1")}).limit(0)).count() == 0
