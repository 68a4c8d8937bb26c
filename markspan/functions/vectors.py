"""Column expressions over token vectors (array<int>, -1 for omega) and state ids. JVM side only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OMEGA = -1


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_enabled(marking: Column | str, pre: Column | str) -> Column:
    """Each place is omega or holds the tokens that the transition consumes; stops at the first that does not."""
    return F.forall(F.zip_with(_col(marking), _col(pre), lambda x, w: (x == OMEGA) | (w <= x)), lambda ok: ok)


def enabled_transitions(marking: Column | str, pres: Column | str) -> Column:
    """Ascending indexes of the enabled transitions; ``pres`` is array<array<int>>, one vector per transition."""
    m = _col(marking)
    flags = F.transform(_col(pres), lambda pre, t: F.when(is_enabled(m, pre), t))
    return F.filter(flags, lambda t: t.isNotNull())


def fire(marking: Column | str, delta: Column | str) -> Column:
    """The successor: omega stays, a null delta empties the place (it belongs to no subnet), overflow is an error."""
    return F.zip_with(_col(marking), _col(delta), lambda x, d: F.when(d.isNull(), 0).when(x == OMEGA, OMEGA).otherwise(x + d))


def covers(ancestor: Column | str, current: Column | str) -> Column:
    """No place that is finite in both holds less than in the ancestor."""
    return F.forall(F.zip_with(_col(ancestor), _col(current), lambda a, c: (a == OMEGA) | (c == OMEGA) | (c >= a)), lambda ok: ok)


def _grown(ancestor: Column, current: Column) -> Column:
    return F.zip_with(ancestor, current, lambda a, c: (a != OMEGA) & (c != OMEGA) & (c > a))


def omega_mask(ancestor: Column | str, current: Column | str) -> Column:
    """Places that grew since an ancestor that the current vector covers; all false otherwise."""
    a, c = _col(ancestor), _col(current)
    return F.when(covers(a, c), _grown(a, c)).otherwise(F.transform(c, lambda _: F.lit(False)))


def set_omegas(marking: Column | str, mask: Column | str) -> Column:
    return F.zip_with(_col(marking), _col(mask), lambda v, f: F.when(f, OMEGA).otherwise(v))


def any_true(mask: Column | str) -> Column:
    return F.exists(_col(mask), lambda b: b)


def accelerate(ancestors: Column | str, current: Column | str) -> Column:
    """Set to omega what grew since any covered ancestor; every comparison uses the vector as it was fired."""
    c = _col(current)
    below = F.filter(_col(ancestors), lambda a: covers(a, c))
    return F.aggregate(below, c, lambda acc, a: F.zip_with(acc, _grown(a, c), lambda v, f: F.when(f, OMEGA).otherwise(v)))


def gather(vector: Column | str, indexes: Column | str) -> Column:
    """The vector's values at 0-based indexes, in their order."""
    v = _col(vector)
    return F.transform(_col(indexes), lambda i: F.get(v, i))


def scatter(places: Column | str, parts: Column | str, size: Column | int) -> Column:
    """Vector of ``size`` from parallel arrays of index lists and value lists; later parts win, uncovered places are 0."""
    pairs = F.arrays_zip(_col(places).alias("i"), _col(parts).alias("v"))
    at = lambda p, pair: F.array_position(pair["i"], p).cast("int")
    width = F.lit(size) if isinstance(size, int) else size
    return F.transform(
        F.sequence(F.lit(0), width - 1),
        lambda p: F.aggregate(pairs, F.lit(0), lambda acc, pair: F.when(at(p, pair) > 0, F.get(pair["v"], at(p, pair) - 1)).otherwise(acc)),
    )


def submatrix(matrix: Column | str, rows: Column | str, columns: Column | str) -> Column:
    m, c = _col(matrix), _col(columns)
    return F.transform(_col(rows), lambda r: F.transform(c, lambda k: F.get(F.get(m, r), k)))


def transpose(matrix: Column | str, width: Column) -> Column:
    m = _col(matrix)
    return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda t: F.transform(m, lambda row: F.get(row, t)))).otherwise(F.array().cast("array<array<int>>"))


def has_transition(transitions: Column | str, t: Column | int) -> Column:
    return F.array_contains(_col(transitions), t)


def local_index(transitions: Column | str, t: Column | int) -> Column:
    """0-based position of the first match, -1 if there is none."""
    return (F.array_position(_col(transitions), t) - 1).cast("int")


def compact(vector: Column | str) -> Column:
    """``[1,0,-1]``"""
    return F.concat(F.lit("["), F.array_join(_col(vector).cast("array<string>"), ","), F.lit("]"))


def spaced(vector: Column | str) -> Column:
    """``[1, 0, -1]``"""
    return F.concat(F.lit("["), F.array_join(_col(vector).cast("array<string>"), ", "), F.lit("]"))


def label(vector: Column | str) -> Column:
    """``[1, 0, ω]``"""
    shown = F.transform(_col(vector), lambda x: F.when(x == OMEGA, "ω").otherwise(x.cast("string")))
    return F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]"))


def node_id(path: Column | str) -> Column:
    """``m0`` and ``_t<k>`` for each firing on the path."""
    return F.concat(F.lit("m0"), F.array_join(F.transform(_col(path), lambda t: F.concat(F.lit("_t"), t.cast("string"))), ""))


def child_id(parent: Column | str, t: Column | str) -> Column:
    return F.concat(_col(parent), F.lit("_t"), _col(t).cast("string"))


def parent_id(node: Column | str) -> Column:
    """The id without its last firing; null for the root."""
    n = _col(node)
    return F.when(n.contains("_t"), F.regexp_replace(n, r"_t[0-9]+$", ""))


def parent_path(path: Column | str) -> Column:
    p = _col(path)
    return F.when(F.size(p) > 0, F.slice(p, 1, F.size(p) - 1))


def is_prefix(prefix: Column | str, node: Column | str) -> Column:
    """Textual prefix test of ids (``m0_t1`` is one of ``m0_t10``)."""
    return _col(node).startswith(_col(prefix))


def is_ancestor_path(prefix: Column | str, path: Column | str) -> Column:
    """Prefix test of paths, firing by firing."""
    p, q = _col(prefix), _col(path)
    return (F.size(p) <= F.size(q)) & (F.slice(q, 1, F.size(p)) == p)


def transition_label(node: Column | str) -> Column:
    """``t<k>`` of the last firing; null for the root."""
    parts = F.split(_col(node), "_t")
    return F.when(F.size(parts) > 1, F.concat(F.lit("t"), F.element_at(parts, -1)))


def quoted(text: Column | str) -> Column:
    return F.concat(F.lit('"'), F.replace(_col(text), F.lit('"'), F.lit('\\"')), F.lit('"'))


def int_list(text: Column | str) -> Column:
    """``1,2,3`` as array<int>."""
    return F.transform(F.split(_col(text), ","), lambda x: F.trim(x).cast("int"))
