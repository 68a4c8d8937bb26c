"""Nets as DataFrames: JSON documents, in-memory documents, the parametric fork/join family."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BODY = "M0 array<int>, I_minus array<array<int>>, I_plus array<array<int>>, subnet_definitions array<struct<id:int,place_indices:array<int>,trans_indices:array<int>>>"
NET_SCHEMA = f"net_id string, {_BODY}"


def read_nets(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One net per JSON file; ``net_id`` is the file's name without extension.

    Numbers must be JSON integers: a document with anything else, or that is no
    JSON, fails. Other keys are ignored.
    """
    docs = spark.read.schema(_BODY).option("multiLine", True).option("mode", "FAILFAST").json(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return docs.select(name.alias("net_id"), *docs.columns)


def nets_from_documents(spark: SparkSession, documents: dict[str, dict]) -> DataFrame:
    """Nets from parsed JSON documents by net_id."""
    rows = [
        (k, d["M0"], d["I_minus"], d["I_plus"], [(s["id"], s["place_indices"], s["trans_indices"]) for s in d["subnet_definitions"]]) for k, d in documents.items()
    ]
    return spark.createDataFrame(rows, NET_SCHEMA)


def _ranges(lengths: Column, more: int) -> Column:
    """First index of each branch, when a branch of length l takes l + more consecutive indexes from 1 on."""
    return F.transform(lengths, lambda _, i: F.aggregate(F.slice(lengths, 1, i), F.lit(1), lambda acc, x: acc + x + more))


def _run(first: Column, length: Column) -> Column:
    return F.when(length > 0, F.sequence(first, first + length - 1)).otherwise(F.array().cast("array<int>"))


def generated_nets(params: DataFrame) -> DataFrame:
    """Fork/join nets from rows of (net_id string, branches_len array<int>, tail_length int, omegas boolean).

    A split feeds the first place of each branch, a branch of length l has l
    transitions over l + 1 places, a join empties their last places into the
    first tail place (weight 2 with omegas), and the tail leads back to place 0.
    All is computed by column expressions, so millions of nets are one scan.
    """
    L, k, omegas = F.col("branches_len"), F.col("tail_length"), F.coalesce(F.col("omegas"), F.lit(False))
    checked = params.select(
        "net_id",
        F.when((k >= 1) & F.forall(L, lambda x: x >= 0), L).otherwise(F.raise_error("tail_length must be 1 or more and branch lengths 0 or more").cast("array<int>")).alias("L"),
        k.alias("k"),
        omegas.alias("omegas"),
    )
    L, k = F.col("L"), F.col("k")
    total = F.aggregate(L, F.lit(0), lambda a, x: a + x)
    laid = checked.select(
        "net_id", "L", "k", "omegas",
        (total + 1).alias("j"),
        (total + F.size(L) + 1).alias("tail0"),
        _ranges(L, 1).alias("p0"),
        _ranges(L, 0).alias("t0"),
    )
    j, tail0, p0, t0 = F.col("j"), F.col("tail0"), F.col("p0"), F.col("t0")
    places, transitions = tail0 + k, j + k + 1
    arcs = lambda *xs: F.concat(*xs)
    arc = lambda p, t, w: F.struct(p.cast("int").alias("p"), t.cast("int").alias("t"), w.cast("int").alias("w"))
    one = F.lit(1)
    branch = F.arrays_zip(p0.alias("p"), t0.alias("t"), L.alias("l"))
    chain = lambda step: F.flatten(F.transform(branch, lambda b: F.transform(_run(F.lit(0), b["l"]), lambda i: arc(b["p"] + i + step, b["t"] + i, one))))
    tail = lambda step: F.transform(_run(F.lit(0), k), lambda i: arc(F.when(i + step < k, tail0 + i + step).otherwise(0), j + i + 1, one))
    minus = arcs(F.array(arc(F.lit(0), F.lit(0), one)), chain(0), F.transform(branch, lambda b: arc(b["p"] + b["l"], j, one)), tail(0))
    plus = arcs(F.transform(p0, lambda p: arc(p, F.lit(0), one)), chain(1), F.array(arc(tail0, j, F.when(F.col("omegas"), 2).otherwise(1))), tail(1))
    placed = laid.select("net_id", "L", "k", "j", "tail0", "p0", "t0", places.alias("np"), transitions.alias("nt"), minus.alias("minus"), plus.alias("plus"))

    def matrix(entries: str) -> Column:
        cell = lambda row, t: F.aggregate(F.filter(row, lambda a: a["t"] == t), F.lit(0), lambda acc, a: acc + a["w"])

        def row(p):
            own = F.array(F.filter(F.col(entries), lambda a: a["p"] == p))
            return F.element_at(F.transform(own, lambda r: F.transform(F.sequence(F.lit(0), F.col("nt") - 1), lambda t: cell(r, t))), 1)

        return F.transform(F.sequence(F.lit(0), F.col("np") - 1), row)

    subnet = lambda i, p, t: F.struct(i.cast("int").alias("id"), p.alias("place_indices"), t.alias("trans_indices"))
    main = subnet(F.lit(0), F.concat(F.array(F.lit(0)), _run(F.col("tail0"), F.col("k"))), F.concat(F.array(F.lit(0), F.col("j")), _run(F.col("j") + 1, F.col("k"))))
    branch = F.arrays_zip(F.col("p0").alias("p"), F.col("t0").alias("t"), F.col("L").alias("l"))
    others = F.transform(branch, lambda b, i: subnet(i + 1, _run(b["p"], b["l"] + 1), F.concat(F.array(F.lit(0)), _run(b["t"], b["l"]), F.array(F.col("j")))))
    return placed.select(
        "net_id",
        F.transform(F.sequence(F.lit(0), F.col("np") - 1), lambda p: F.when(p == 0, 1).otherwise(0)).alias("M0"),
        matrix("minus").alias("I_minus"),
        matrix("plus").alias("I_plus"),
        F.concat(F.array(main), others).alias("subnet_definitions"),
    )


def generate_net(branches: int, branches_len: list[int], tail_length: int, omegas: bool = False) -> dict:
    """One net of the family as a JSON document, without Spark."""
    if branches != len(branches_len):
        raise ValueError(f"{branches} branches but {len(branches_len)} lengths")
    if tail_length < 1 or min(branches_len, default=0) < 0:
        raise ValueError("tail_length must be 1 or more and branch lengths 0 or more")
    join = 1 + sum(branches_len)
    tail = [1 + sum(branches_len) + branches + i for i in range(tail_length)]
    tail_t = [join + 1 + i for i in range(tail_length)]
    minus = [[0] * (join + 1 + tail_length) for _ in range(tail[-1] + 1)]
    plus = [row[:] for row in minus]
    subnets = [{"id": 0, "place_indices": [0, *tail], "trans_indices": [0, join, *tail_t]}]
    minus[0][0] = 1
    plus[tail[0]][join] = 2 if omegas else 1
    place, transition = 1, 1
    for number, length in enumerate(branches_len, 1):
        own_p, own_t = list(range(place, place + length + 1)), list(range(transition, transition + length))
        plus[own_p[0]][0] = minus[own_p[-1]][join] = 1
        for before, after, t in zip(own_p, own_p[1:], own_t, strict=False):
            minus[before][t] = plus[after][t] = 1
        subnets.append({"id": number, "place_indices": own_p, "trans_indices": [0, *own_t, join]})
        place, transition = place + length + 1, transition + length
    for before, after, t in zip(tail, [*tail[1:], 0], tail_t, strict=True):
        minus[before][t] = plus[after][t] = 1
    return {"M0": [1] + [0] * tail[-1], "I_minus": minus, "I_plus": plus, "subnet_definitions": subnets}


def save_net(spark: SparkSession, document: dict, path: str) -> None:
    """JSON text with indent 2 at any path that Spark's file systems reach, so that executors can read it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    file = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        file.write(bytearray(write_net(document), "utf-8"))
    finally:
        file.close()


def write_net(document: dict, path: str | None = None) -> str:
    """JSON text with indent 2; written to ``path`` if given."""
    text = json.dumps(document, indent=2)
    if path:
        with open(path, "w", encoding="utf-8") as file:
            file.write(text)
    return text
