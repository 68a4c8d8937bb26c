"""Registered queries of the state-space engine: fixed nets, net families from tables, and vector operators over tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markspan.functions import vectors as V
from markspan.operators.reachability import explain_node, explore, firing_counts, repeated_markings, state_counts, tree_edges, work_folder
from markspan.plans.compile import compile_nets, transition_table
from markspan.sinks.text import arcs, editor_xml, net_dot, net_json, pnml, tree_dot
from markspan.sources.nets import NET_SCHEMA, generate_net, generated_nets, nets_from_documents, read_nets, save_net

#: The sample nets, by the family's parameters.
NET_1 = (3, (1, 1, 1), 2, False)
NET_2 = (3, (4, 3, 5), 1, False)
NET_3 = (3, (1, 1, 1), 1, True)


@cache
def sample_net(name: str) -> dict:
    branches, lengths, tail, omegas = {"net_1": NET_1, "net_2": NET_2, "net_3": NET_3}[name]
    net = generate_net(branches, list(lengths), tail, omegas)
    if name == "net_2":
        net["M0"][0] = 4
    return net


#: The smallest known net whose states depend on the order of exploration: 17 in canonical order.
ORDER_NET = {
    "M0": [1, 2, 0],
    "I_minus": [[0, 1, 1], [2, 0, 0], [0, 0, 0]],
    "I_plus": [[2, 0, 0], [1, 0, 1], [1, 1, 0]],
    "subnet_definitions": [{"id": 0, "place_indices": [0, 1, 2], "trans_indices": [0, 1, 2]}],
}


#: Nets whose subnets do not fit them: a place and a transition in no subnet, no subnets at all, an omega at the start,
#: an arc that its place's subnet does not list.
MALFORMED = {
    "uncovered": {
        "M0": [1, 1, 2],
        "I_minus": [[1, 0, 0], [0, 1, 0], [0, 0, 1]],
        "I_plus": [[1, 0, 0], [0, 0, 1], [1, 0, 0]],
        "subnet_definitions": [{"id": 0, "place_indices": [0], "trans_indices": [0]}, {"id": 1, "place_indices": [2], "trans_indices": [0, 2]}],
    },
    "bare": {"M0": [1, 0], "I_minus": [[1, 1], [0, 0]], "I_plus": [[0, 0], [1, 2]], "subnet_definitions": []},
    "omega": {"M0": [-1, 0], "I_minus": [[3], [0]], "I_plus": [[0], [1]], "subnet_definitions": [{"id": 0, "place_indices": [0, 1], "trans_indices": [0]}]},
    "unlisted": {
        "M0": [2, 0],
        "I_minus": [[1, 0], [0, 1]],
        "I_plus": [[0, 1], [1, 0]],
        "subnet_definitions": [{"id": 4, "place_indices": [0], "trans_indices": [0, 1]}, {"id": 2, "place_indices": [1], "trans_indices": [1]}],
    },
}


def _nets(spark: SparkSession, *names: str) -> DataFrame:
    return nets_from_documents(spark, {n: ORDER_NET if n == "order" else sample_net(n) for n in names})


def _shown(states: DataFrame) -> DataFrame:
    return states.select("net_id", "node_id", V.compact("marking").alias("marking"), "depth")


def states_net_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(explore(_nets(spark, "net_1")))


def states_net_3_omega(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(explore(_nets(spark, "net_3")))


def states_order_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(explore(_nets(spark, "order")))


def state_count_net_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_counts(explore(_nets(spark, "net_2"))).select("net_id", "n_states", "n_omega_states")


def edges_net_3_omega(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_edges(explore(_nets(spark, "net_3")))


def states_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of nets that are read from JSON files, one net per file."""
    folder = work_folder(spark)
    for name in ("net_1", "net_3"):
        save_net(spark, sample_net(name), f"{folder}/{name}.json")
    return _shown(explore(read_nets(spark, f"{folder}/*.json")))


def states_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What malformed nets do: reported markings, nodes that are never completed."""
    return _shown(explore(nets_from_documents(spark, MALFORMED), strict=False))


def repeated_markings_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_markings(explore(nets_from_documents(spark, MALFORMED), strict=False)).select("net_id", V.spaced("marking").alias("marking"), "n")


def repeated_markings_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_markings(explore(_nets(spark, "net_1", "net_3", "order"))).select("net_id", V.spaced("marking").alias("marking"), "n")


def firings_net_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    nets = _nets(spark, "net_1", "net_3")
    return firing_counts(explore(nets), compile_nets(nets))


def explained_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nets = _nets(spark, "net_3")
    rows = explain_node(explore(nets), nets, "m0_t0_t1_t2_t3_t4_t5")
    return rows.select("node_id", "step", "ancestor_id", V.compact("ancestor").alias("ancestor"), V.compact("fired").alias("fired"), F.regexp_extract("verdict", r"^(\w+)", 1).alias("verdict"), V.any_true("mask").alias("any_omega"))


def supplier_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fork/join net for each supplier: 1 to 3 branches of 0 to 3 transitions and a tail of 1 to 3 places."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    lengths = F.transform(F.sequence(F.lit(0), (F.col("k") % 3).cast("int")), lambda i: ((F.col("k") + F.col("n") + i * 2) % 4).cast("int"))
    return s.select(F.col("k").cast("string").alias("net_id"), lengths.alias("branches_len"), (F.col("n") % 3 + 1).cast("int").alias("tail_length"), F.lit(False).alias("omegas"))


def family_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of every supplier's net, explored in one batch."""
    return state_counts(explore(generated_nets(supplier_params(spark, sf_dir)))).select("net_id", "n_states", "n_omega_states")


def family_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_edges(explore(generated_nets(supplier_params(spark, sf_dir)))).groupBy("net_id").agg(F.count("*").alias("n_edges"), F.countDistinct("child_id").alias("n_children"))


def generated_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arcs(generated_nets(supplier_params(spark, sf_dir)))


def generated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net documents through their JSON form and back."""
    text = net_json(generated_nets(supplier_params(spark, sf_dir)))
    back = text.select("net_id", F.from_json("json", NET_SCHEMA.split(", ", 1)[1]).alias("d"))
    subnet = F.transform("d.subnet_definitions", lambda s: F.size(s["place_indices"]) * 100 + F.size(s["trans_indices"]))
    return back.select("net_id", V.compact("d.M0").alias("m0"), F.size("d.I_minus").alias("n_places"), F.size(F.get("d.I_plus", F.lit(0))).alias("n_transitions"), V.compact(subnet).alias("subnets"))


def transition_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transition_table(_nets(spark, "net_1", "net_3", "order")).select("net_id", "t", V.compact("pre").alias("pre"), V.compact("delta").alias("delta"), "phantom")


def subnet_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices, membership and local indexes of the subnets of a sample net, for each of its transitions."""
    net = _nets(spark, "net_1").select("*", F.explode("subnet_definitions").alias("s"))
    p, t = F.col("s.place_indices"), F.col("s.trans_indices")
    rows = net.select(F.col("s.id").alias("subnet"), V.gather("M0", p).alias("part"), V.submatrix("I_minus", p, t).alias("sub"), t.alias("ts"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("t"))
    return rows.select("subnet", "t", V.compact("part").alias("part"), F.array_join(F.transform("sub", V.compact), ";").alias("sub"), V.has_transition("ts", F.col("t")).alias("listed"), V.local_index("ts", F.col("t")).alias("local"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token vectors from order lines: a marking, an ancestor and a transition's pre and delta, omegas included."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("long").alias("l"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    vector = lambda *xs: F.array(*(x.cast("int") for x in xs))
    o, l, p, s = (F.col(c) for c in "olps")  # noqa: E741
    return rows.select(
        "o", "l", "p", "s",
        vector(o % 5 - 1, p % 4 - 1, s % 6 - 1, l).alias("m"),
        vector(o % 3 - 1, p % 3 - 1, s % 3 - 1, l % 4).alias("a"),
        vector(o % 2, p % 2, l % 2, l % 3).alias("pre"),
        vector(p % 3 - 1, s % 3 - 1, o % 2, l % 3 - 1).alias("delta"),
    )


def vector_enabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("o", "l", "p", "s", V.is_enabled("m", "pre").alias("enabled"))


def vector_fire(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return v.where(V.is_enabled("m", "pre")).select("o", "l", "p", "s", V.compact(V.fire("m", "delta")).alias("fired"))


def vector_omega_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).withColumn("mask", V.omega_mask("a", "m"))
    return v.select("o", "l", "p", "s", V.any_true("mask").alias("any_omega"), V.compact(V.set_omegas("m", "mask")).alias("widened"))


def vector_accelerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return v.select("o", "l", "p", "s", V.compact(V.accelerate(F.array("a", "pre", "delta"), F.col("m"))).alias("accelerated"))


def vector_gather_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at two overlapping index lists, and put back: later lists win, uncovered places are 0."""
    i, j = F.array(F.lit(3), F.lit(0)), F.array(F.lit(0), F.lit(2))
    v = _vectors(spark, sf_dir)
    back = V.scatter(F.array(i, j), F.array(V.gather("m", i), V.gather("a", j)), 5)
    return v.select("o", "l", "p", "s", V.compact(V.gather("m", i)).alias("part"), V.compact(back).alias("whole"))


def theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dominance join of markings with the transitions that they enable, counted per transition."""
    pres = spark.createDataFrame([(t, [t % 2, t % 3, t % 4, t % 5]) for t in range(8)], "t int, pre array<int>")
    v = _vectors(spark, sf_dir).select("m")
    return v.join(F.broadcast(pres), V.is_enabled("m", "pre")).groupBy("t").agg(F.count("*").alias("n"))


def enabled_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pres = F.array(*(F.array(*(F.lit(t % k) for k in (2, 3, 4, 5))) for t in range(8)))
    return _vectors(spark, sf_dir).select("o", "l", "p", "s", V.compact(V.enabled_transitions("m", pres)).alias("enabled"))


def first_markings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct markings with the smallest (order, line) that has each, and how many have it."""
    return _vectors(spark, sf_dir).groupBy("m").agg(F.min(F.struct("o", "l", "p", "s")).alias("first"), F.count("*").alias("n")).select(V.compact("m").alias("marking"), F.col("first.o").alias("o"), F.col("first.l").alias("l"), "n")


def unseen_markings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti-join on vectors: distinct markings that are no ancestor vector."""
    v = _vectors(spark, sf_dir)
    return v.select("m").distinct().join(v.select(F.col("a").alias("m")).distinct(), "m", "left_anti").select(V.compact("m").alias("marking"))


def id_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).select("o", "l", "p", "s", F.array(F.col("l").cast("int"), (F.col("p") % 13).cast("int")).alias("path"), "m")
    node = V.node_id("path")
    return v.select(
        "o", "l", "p", "s",
        node.alias("node_id"),
        V.child_id(node, F.col("l")).alias("child_id"),
        V.parent_id(node).alias("parent_id"),
        V.transition_label(node).alias("t_label"),
        V.is_prefix(F.lit("m0_t1"), node).alias("prefixed"),
        V.quoted(node).alias("quoted_id"),
        V.label("m").alias("m_label"),
        V.spaced("m").alias("m_spaced"),
        V.compact(V.int_list(F.concat_ws(",", F.col("l").cast("string"), (F.col("p") % 7).cast("string")))).alias("parsed"),
    )


def _as_lines(lines: DataFrame) -> DataFrame:
    return lines.select("part", F.array_join(F.col("pos").cast("array<string>"), ".").alias("pos"), "sub", "line")


def dot_of_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_lines(tree_dot(explore(_nets(spark, "net_3"))))


def dot_of_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_lines(net_dot(_nets(spark, "net_1")))


def xml_of_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_lines(editor_xml(_nets(spark, "net_3")))


def pnml_of_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_lines(pnml(_nets(spark, "net_3"), "net_3.pnml"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            states_net_1, states_net_3_omega, states_order_sensitive, states_from_files, states_compat, state_count_net_2, edges_net_3_omega,
            repeated_markings_check, repeated_markings_compat, firings_net_3,
            explained_nodes, family_state_counts, family_edge_counts, generated_arcs, generated_documents, transition_deltas, subnet_operators,
            vector_enabled, vector_fire, vector_omega_mask, vector_accelerate, vector_gather_scatter, theta_join, enabled_lists, first_markings,
            unseen_markings, id_functions, dot_of_tree, dot_of_net, xml_of_net, pnml_of_net,
        )
    }
