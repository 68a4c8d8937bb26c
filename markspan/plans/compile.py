"""From net documents to the relations that the state-space loop joins with: checks and effective deltas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspan.functions.vectors import transpose


class NetError(ValueError):
    """A net document that the engine does not accept; lists net_id and reason."""


@dataclass
class CompiledNets:
    """``roots`` (net_id, expand, report, bounded) and ``transitions`` (net_id, t, pre, delta, phantom)."""

    roots: DataFrame
    transitions: DataFrame


def _flat(name: str) -> Column:
    return F.flatten(F.transform("subnet_definitions", lambda s: s[name]))


def problems(nets: DataFrame, strict: bool = True) -> DataFrame:
    """(net_id, problem): one row for each thing wrong with a net.

    Always wrong: missing parts, nulls, ragged or mismatched matrices, indexes
    out of range, repeated subnet ids. Also wrong in strict mode: negative
    weights or tokens, places or transitions that no subnet lists, and arcs of a
    transition that the place's owner does not list.
    """
    np, nt = F.size("M0"), F.size(F.get("I_minus", F.lit(0)))
    no_null = lambda c: F.forall(c, lambda x: x.isNotNull())
    square = lambda m: (F.size(m) == np) & F.forall(m, lambda r: r.isNotNull() & (F.size(r) == nt) & no_null(r))
    present = F.col("M0").isNotNull() & F.col("I_minus").isNotNull() & F.col("I_plus").isNotNull() & F.col("subnet_definitions").isNotNull()
    whole = F.forall("subnet_definitions", lambda s: s.isNotNull() & s["id"].isNotNull() & s["place_indices"].isNotNull() & s["trans_indices"].isNotNull() & no_null(s["place_indices"]) & no_null(s["trans_indices"]))
    inside = lambda c, n: F.forall(c, lambda i: (i >= 0) & (i < n))
    ids = F.transform("subnet_definitions", lambda s: s["id"])
    rules = [
        (~present, "M0, I_minus, I_plus and subnet_definitions are needed"),
        (present & (~no_null(F.col("M0")) | (np < 1)), "M0 must hold integers, one or more"),
        (present & ~(square("I_minus") & square("I_plus")), "matrices must have a row of equal length for each place"),
        (present & ~whole, "subnet definitions must be whole"),
        (present & whole & ~(inside(_flat("place_indices"), np) & inside(_flat("trans_indices"), nt)), "subnet indexes are out of range"),
        (present & whole & (F.size(F.array_distinct(ids)) < F.size(ids)), "subnet ids repeat"),
    ]
    if strict:
        owner = lambda p: F.aggregate("subnet_definitions", F.lit(None).cast("array<int>"), lambda acc, s: F.when(F.array_contains(s["place_indices"], p), s["trans_indices"]).otherwise(acc))
        negative = lambda m: F.exists(F.flatten(m), lambda x: x < 0)
        all_of = lambda n, name: (n == 0) | F.forall(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.array_contains(_flat(name), i))
        arcs = F.forall(
            F.sequence(F.lit(0), np - 1),
            lambda p: F.forall(
                F.transform(F.zip_with(F.get("I_minus", p), F.get("I_plus", p), lambda a, b: (a != 0) | (b != 0)), lambda used, t: ~used | F.coalesce(F.array_contains(owner(p), t), F.lit(False))),
                lambda ok: ok,
            ),
        )
        sound = present & whole & square("I_minus") & square("I_plus")
        rules += [
            (sound & (negative("I_minus") | negative("I_plus")), "weights are negative"),
            (sound & F.exists("M0", lambda x: x < 0), "tokens are negative"),
            (sound & ~all_of(np, "place_indices"), "a place is in no subnet"),
            (sound & ~all_of(nt, "trans_indices"), "a transition is in no subnet"),
            (sound & ~arcs, "an arc's transition is not in the place's subnet"),
        ]
    found = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(what)) for bad, what in rules)))
    return nets.select("net_id", F.explode(found).alias("problem"))


def transition_table(nets: DataFrame) -> DataFrame:
    """(net_id, t, pre, delta, phantom): one row per transition.

    A place belongs to the last subnet that lists it. Firing changes it by
    I_plus - I_minus if that subnet lists the transition, else not at all; delta
    is null where no subnet lists the place. A transition that no subnet lists is
    a phantom: it makes nodes that are never completed.
    """
    owner = lambda p: F.aggregate("subnet_definitions", F.lit(None).cast("array<int>"), lambda acc, s: F.when(F.array_contains(s["place_indices"], p), s["trans_indices"]).otherwise(acc))
    width = F.size(F.get("I_minus", F.lit(0)))
    owned = nets.select(
        "net_id",
        transpose("I_minus", width).alias("pre"),
        transpose("I_plus", width).alias("post"),
        F.transform(F.sequence(F.lit(0), F.size("M0") - 1), owner).alias("owners"),
        _flat("trans_indices").alias("listed"),
    )
    each = owned.select("net_id", F.posexplode(F.arrays_zip("pre", "post")).alias("t", "v"), "owners", "listed")
    change = F.zip_with("v.post", "v.pre", lambda a, b: a - b)
    delta = F.zip_with(change, "owners", lambda d, o: F.when(o.isNotNull(), F.when(F.array_contains(o, F.col("t")), d).otherwise(0)))
    return each.select("net_id", "t", F.col("v.pre").alias("pre"), delta.alias("delta"), (~F.array_contains("listed", F.col("t"))).alias("phantom"))


def is_bounded() -> Column:
    """Sufficient test that omega acceleration can never trigger.

    Each place gets a weight so that no firing raises the weighted token sum:
    weights start at 1 and are raised along each transition with one input place
    (its weight becomes the sum of what it produces, per token consumed) for as
    many rounds as there are places; the weights found are then checked exactly.
    Nets that the test does not prove keep their ancestors.
    """
    n = F.size("M0")
    transitions = F.arrays_zip(transpose("I_minus", F.size(F.get("I_minus", F.lit(0)))).alias("pre"), transpose("I_plus", F.size(F.get("I_minus", F.lit(0)))).alias("post"))
    dot = lambda y, v: F.aggregate(F.zip_with(y, v, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    ones = F.transform("M0", lambda _: F.lit(1.0))

    def raised(y):
        def at(w, t):
            single = F.size(F.filter(t["pre"], lambda x: x > 0)) == 1
            need = dot(w, t["post"])
            return F.when(single, F.zip_with(w, t["pre"], lambda a, x: F.when(x > 0, F.greatest(a, need / x)).otherwise(a))).otherwise(w)

        return F.aggregate(transitions, y, at)

    weights = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(40))), ones, lambda y, _: raised(y))
    bind = F.transform(F.array(weights), lambda y: F.forall(transitions, lambda t: dot(y, t["post"]) <= dot(y, t["pre"]) + 1e-9) & F.forall(y, lambda a: a < 1e12))
    return F.coalesce(F.element_at(bind, 1), F.lit(False)) & ~F.exists("M0", lambda x: x < 0)


def compile_nets(nets: DataFrame, strict: bool = True) -> CompiledNets:
    """Check the nets and derive roots and transitions; raises NetError with the first problems."""
    repeated = nets.groupBy("net_id").count().where("count > 1").select("net_id", F.lit("net_id repeats").alias("problem"))
    wrong = problems(nets, strict).union(repeated).limit(5).collect()
    if wrong:
        raise NetError("; ".join(f"{r['net_id']}: {r['problem']}" for r in wrong))
    covered = _flat("place_indices")
    report = F.transform("M0", lambda x, p: F.when(F.array_contains(covered, p), x).otherwise(0))
    # a null delta empties its place, which the weight test does not model: such nets keep their ancestors
    whole = F.size(F.array_distinct(covered)) == F.size("M0")
    regular = is_bounded() & whole if strict else F.lit(False)
    return CompiledNets(nets.select("net_id", F.col("M0").alias("expand"), report.alias("report"), regular.alias("bounded")), transition_table(nets))
