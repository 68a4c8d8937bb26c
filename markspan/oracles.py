"""DuckDB SQL that gives the same rows as the registered state-space queries."""

from __future__ import annotations

from markspan.queries import MALFORMED, ORDER_NET, sample_net


def _net(name: str) -> dict:
    return ORDER_NET if name == "order" else sample_net(name)


def _deltas(net: dict) -> list[tuple[int, list[int], list[int]]]:
    """(t, pre, delta) of nets whose subnets cover all arcs."""
    return [(t, [r[t] for r in net["I_minus"]], [b[t] - a[t] for a, b in zip(net["I_minus"], net["I_plus"], strict=True)]) for t in range(len(net["I_minus"][0]))]


def _transitions(name: str) -> str:
    return ", ".join(f"({t}, {pre}::INT[], {delta}::INT[])" for t, pre, delta in _deltas(_net(name)))


_ENABLED = "len(list_filter(list_zip(r.m, tr.pre), lambda z: z[1] <> -1 AND z[2] > z[1])) = 0"
_FIRE = "list_transform(list_zip(r.m, tr.delta), lambda z: CASE WHEN z[1] = -1 THEN -1 ELSE z[1] + z[2] END)"
_COMPACT = "'[' || array_to_string({}, ',') || ']'"
_NODE = "'m0' || array_to_string(list_transform({}, lambda t: '_t' || t), '')"


def _states(name: str) -> str:
    """CTEs: ``r`` (m, path, anc) holds the states in canonical order, omega acceleration included."""
    net = _net(name)
    m0, n = net["M0"], len(net["M0"])
    below = f"list_filter(anc, lambda a: len(list_filter(range(1, {n + 1}), lambda k: a[k] <> -1 AND c[k] <> -1 AND c[k] < a[k])) = 0)"
    return f"""
WITH RECURSIVE tr(t, pre, delta) AS (VALUES {_transitions(name)}),
r(m, path, anc) USING KEY (m) AS (
  SELECT {m0}::INT[], []::INT[], [{m0}]::INT[][]
  UNION
  SELECT m, min(path), list_append(arg_min(anc, path), m) FROM (
    SELECT path, anc, list_transform(c, lambda v, i: CASE WHEN v <> -1 AND len(list_filter(below, lambda a: a[i] <> -1 AND v > a[i])) > 0 THEN -1 ELSE v END) AS m
    FROM (SELECT path, anc, c, {below} AS below
          FROM (SELECT list_append(r.path, t) AS path, r.anc, {_FIRE} AS c FROM r JOIN tr ON {_ENABLED})))
  WHERE m NOT IN (SELECT m FROM recurring.r) GROUP BY m
)"""


def _shown(name: str) -> str:
    return f"{_states(name)} SELECT '{name}' AS net_id, {_NODE.format('path')} AS node_id, {_COMPACT.format('m')} AS marking, len(path)::INT AS depth FROM r"


def _compat(name: str) -> str:
    """States of a net whose subnets may not fit it: (net_id, path, m), m as reported.

    A place takes part in a firing by its last subnet; one in no subnet empties and is 0 in the root as
    reported; a transition in no subnet makes a node with its parent's vector that is not expanded.
    """
    net = MALFORMED[name]
    owner = {p: s["trans_indices"] for s in net["subnet_definitions"] for p in s["place_indices"]}
    listed = {t for s in net["subnet_definitions"] for t in s["trans_indices"]}
    places, n = range(len(net["M0"])), len(net["M0"])
    change = lambda p, t: "NULL" if p not in owner else net["I_plus"][p][t] - net["I_minus"][p][t] if t in owner[p] else 0
    rows = ", ".join(f"({t}, {[net['I_minus'][p][t] for p in places]}::INT[], [{', '.join(str(change(p, t)) for p in places)}]::INT[], {t not in listed})" for t in range(len(net["I_minus"][0])))
    report = [x if p in owner else 0 for p, x in enumerate(net["M0"])]
    fire = "list_transform(list_zip(r.m, tr.delta), lambda z: CASE WHEN z[2] IS NULL THEN 0 WHEN z[1] = -1 THEN -1 ELSE z[1] + z[2] END)"
    below = f"list_filter(anc, lambda a: len(list_filter(range(1, {n + 1}), lambda k: a[k] <> -1 AND c[k] <> -1 AND c[k] < a[k])) = 0)"
    shown = f"CASE WHEN len(r.path) = 0 THEN {report}::INT[] ELSE r.m END"
    return f"""(
WITH RECURSIVE tr(t, pre, delta, phantom) AS (VALUES {rows}),
r(m, path, anc) USING KEY (m) AS (
  SELECT {net["M0"]}::INT[], []::INT[], [{report}]::INT[][]
  UNION
  SELECT m, min(path), list_append(arg_min(anc, path), m) FROM (
    SELECT path, anc, list_transform(c, lambda v, i: CASE WHEN v <> -1 AND len(list_filter(below, lambda a: a[i] <> -1 AND v > a[i])) > 0 THEN -1 ELSE v END) AS m
    FROM (SELECT path, anc, c, {below} AS below
          FROM (SELECT list_append(r.path, t) AS path, r.anc, {fire} AS c FROM r JOIN tr ON NOT phantom AND {_ENABLED})))
  WHERE m NOT IN (SELECT m FROM recurring.r) GROUP BY m
)
SELECT '{name}' AS net_id, r.path AS path, {shown} AS m FROM r
UNION ALL SELECT '{name}', list_append(r.path, t), {shown} FROM r JOIN tr ON phantom AND {_ENABLED})"""


_ALL_COMPAT = " UNION ALL ".join(f"SELECT * FROM {_compat(n)}" for n in MALFORMED)


_EDGES = f"""{_states("net_3")}
SELECT 'net_3' AS net_id, {_NODE.format("path[:-2]")} AS parent_id, {_NODE.format("path")} AS child_id, path[-1] AS t FROM r WHERE len(path) > 0"""

_COUNT_NET_2 = f"""
WITH RECURSIVE tr(t, pre, delta) AS (VALUES {_transitions("net_2")}),
r(m) AS (SELECT {sample_net("net_2")["M0"]}::INT[] UNION SELECT {_FIRE} FROM r JOIN tr ON {_ENABLED})
SELECT 'net_2' AS net_id, count(*) AS n_states, 0::BIGINT AS n_omega_states FROM r"""


def _firings(name: str) -> str:
    return f"({_states(name)} SELECT '{name}' AS net_id, count(*) AS n_firings FROM r JOIN tr ON {_ENABLED})"


_EXPLAINED = f"""{_states("net_3")},
chosen AS (SELECT path, m FROM r WHERE starts_with({_NODE.format("path")}, 'm0_t0_t1_t2_t3_t4_t5') AND len(path) > 0),
fired AS (SELECT chosen.path, {_FIRE} AS f FROM chosen JOIN r ON r.path = chosen.path[:-2] JOIN tr ON tr.t = chosen.path[-1]),
pairs AS (SELECT fired.path, f, r.m AS a, r.path AS ap FROM fired JOIN r ON len(r.path) < len(fired.path) AND r.path = fired.path[:len(r.path)]),
judged AS (
  SELECT *, len(list_filter(list_zip(a, f), lambda z: z[1] <> -1 AND z[2] <> -1 AND z[2] < z[1])) > 0 AS smaller,
         len(list_filter(list_zip(a, f), lambda z: z[1] <> -1 AND z[2] <> -1 AND z[2] > z[1])) > 0 AS grown FROM pairs)
SELECT {_NODE.format("path")} AS node_id, (len(path) - len(ap))::INT AS step, {_NODE.format("ap")} AS ancestor_id, {_COMPACT.format("a")} AS ancestor, {_COMPACT.format("f")} AS fired,
       CASE WHEN smaller THEN 'smaller' WHEN grown THEN 'grown' ELSE 'equal' END AS verdict, NOT smaller AND grown AS any_omega FROM judged"""

_FAMILY = """
WITH s AS (
  SELECT s_suppkey::VARCHAR AS net_id, (s_nationkey % 3 + 1)::INT AS k,
         list_transform(range(0, s_suppkey % 3 + 1), lambda i: ((s_suppkey + s_nationkey + i * 2) % 4)::INT) AS l FROM supplier)"""
_STATES_OF = "(1 + list_product(list_transform(l, lambda x: x + 1)) + k)::BIGINT"

_ARCS = f"""{_FAMILY},
b AS (SELECT *, 1 + coalesce(list_sum(l), 0)::INT AS j FROM s),
c AS (SELECT *, j + len(l)::INT AS tail0 FROM b),
br AS (
  SELECT net_id, j, l[i] AS n, (1 + coalesce(list_sum(l[:i - 1]), 0) + i - 1)::INT AS p0, (1 + coalesce(list_sum(l[:i - 1]), 0))::INT AS t0
  FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM c)),
ch AS (SELECT *, unnest(range(0, n)) AS x FROM br),
tl AS (SELECT *, unnest(range(0, k)) AS x FROM c)
SELECT net_id, kind::INT AS kind, p::INT AS p, t::INT AS t, 1::INT AS w FROM (
  SELECT net_id, 0 AS kind, 0 AS p, 0 AS t FROM c
  UNION ALL SELECT net_id, 0, p0 + x, t0 + x FROM ch
  UNION ALL SELECT net_id, 0, p0 + n, j FROM br
  UNION ALL SELECT net_id, 0, tail0 + x, j + 1 + x FROM tl
  UNION ALL SELECT net_id, 1, p0, 0 FROM br
  UNION ALL SELECT net_id, 1, p0 + x + 1, t0 + x FROM ch
  UNION ALL SELECT net_id, 1, tail0, j FROM c
  UNION ALL SELECT net_id, 1, CASE WHEN x + 1 < k THEN tail0 + x + 1 ELSE 0 END, j + 1 + x FROM tl)"""

_DOCUMENTS = f"""{_FAMILY},
d AS (SELECT *, (1 + coalesce(list_sum(l), 0) + len(l) + k)::INT AS np, (2 + coalesce(list_sum(l), 0) + k)::INT AS nt FROM s)
SELECT net_id, '[1' || repeat(',0', np - 1) || ']' AS m0, np AS n_places, nt AS n_transitions,
       '[' || array_to_string(list_prepend((1 + k) * 100 + 2 + k, list_transform(l, lambda x: (x + 1) * 100 + x + 2)), ',') || ']' AS subnets FROM d"""


def _values(rows: list[tuple], names: str) -> str:
    shown = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) AS x({names})"


def _list(xs: list[int]) -> str:
    return "[" + ",".join(map(str, xs)) + "]"


_DELTAS = _values([(n, t, _list(pre), _list(d), False) for n in ("net_1", "net_3", "order") for t, pre, d in _deltas(_net(n))], "net_id, t, pre, delta, phantom")


def _subnets() -> str:
    net = sample_net("net_1")
    rows = ", ".join(f"({s['id']}, {s['place_indices']}::INT[], {s['trans_indices']}::INT[])" for s in net["subnet_definitions"])
    return f"""
WITH s(subnet, p, t) AS (VALUES {rows}), n AS (SELECT {net["M0"]}::INT[] AS m0, {net["I_minus"]}::INT[][] AS im)
SELECT subnet, x::INT AS t, {_COMPACT.format("list_transform(p, lambda i: m0[i + 1])")} AS part,
       array_to_string(list_transform(p, lambda i: '[' || array_to_string(list_transform(s.t, lambda k: im[i + 1][k + 1]), ',') || ']'), ';') AS sub,
       list_contains(s.t, x::INT) AS listed, (coalesce(list_position(s.t, x::INT), 0) - 1)::INT AS local
FROM s, n, range(7) AS q(x)"""


_VECTORS = """
WITH x AS (SELECT l_orderkey AS o, l_linenumber::BIGINT AS l, l_partkey AS p, l_suppkey AS s FROM lineitem),
v AS (
  SELECT *, [o % 5 - 1, p % 4 - 1, s % 6 - 1, l]::INT[] AS m, [o % 3 - 1, p % 3 - 1, s % 3 - 1, l % 4]::INT[] AS a,
         [o % 2, p % 2, l % 2, l % 3]::INT[] AS pre, [p % 3 - 1, s % 3 - 1, o % 2, l % 3 - 1]::INT[] AS delta FROM x)"""
_OK = "len(list_filter(list_zip(m, pre), lambda z: z[1] <> -1 AND z[2] > z[1])) = 0"
_BELOW = "len(list_filter(list_zip({a}, m), lambda z: z[1] <> -1 AND z[2] <> -1 AND z[2] < z[1])) = 0"
_UP = "({a}[i] <> -1 AND y > {a}[i])"
_PRES = ", ".join(f"({t}, [{t % 2}, {t % 3}, {t % 4}, {t % 5}]::INT[])" for t in range(8))

_MASK = f"""{_VECTORS},
w AS (SELECT *, CASE WHEN {_BELOW.format(a="a")} THEN list_transform(m, lambda y, i: CASE WHEN y <> -1 AND {_UP.format(a="a")} THEN -1 ELSE y END) ELSE m END AS wide FROM v)
SELECT o, l, p, s, wide <> m AS any_omega, {_COMPACT.format("wide")} AS widened FROM w"""

_ACCELERATE = f"""{_VECTORS},
w AS (SELECT *, {", ".join(f"{_BELOW.format(a=c)} AS b_{c}" for c in ("a", "pre", "delta"))} FROM v)
SELECT o, l, p, s, '[' || array_to_string(list_transform(m, lambda y, i: CASE WHEN y <> -1 AND ({" OR ".join(f"(b_{c} AND {_UP.format(a=c)})" for c in ("a", "pre", "delta"))}) THEN -1 ELSE y END), ',') || ']' AS accelerated FROM w"""

_IDS = f"""{_VECTORS},
w AS (SELECT *, 'm0_t' || l || '_t' || p % 13 AS node_id FROM v)
SELECT o, l, p, s, node_id, node_id || '_t' || l AS child_id, 'm0_t' || l AS parent_id, 't' || p % 13 AS t_label, starts_with(node_id, 'm0_t1') AS prefixed,
       '"' || node_id || '"' AS quoted_id, '[' || array_to_string(list_transform(m, lambda x: CASE WHEN x = -1 THEN 'ω' ELSE x::VARCHAR END), ', ') || ']' AS m_label,
       '[' || array_to_string(m, ', ') || ']' AS m_spaced, '[' || l || ',' || p % 7 || ']' AS parsed FROM w"""

_TREE_DOT = f"""{_states("net_3")},
q AS (SELECT *, array_to_string(path, '.') AS pos, '"' || {_NODE.format("path")} || '"' AS id, '"' || {_NODE.format("path[:-2]")} || '"' AS up FROM r)
SELECT 0 AS part, '0' AS pos, 0 AS sub, 'digraph ReachabilityTree {{' AS line UNION ALL SELECT 0, '0', 1, '  node [shape=box];' UNION ALL SELECT 0, '0', 2, ''
UNION ALL SELECT 1, pos, 0, '  ' || id || ' [label="[' || array_to_string(list_transform(m, lambda x: CASE WHEN x = -1 THEN 'ω' ELSE x::VARCHAR END), ', ') || ']"];' FROM q
UNION ALL SELECT 2, '0', 0, ''
UNION ALL SELECT 3, pos, 0, '  ' || up || ' -> ' || id || ' [label="t' || path[-1] || '"];' FROM q WHERE len(path) > 0
UNION ALL SELECT 4, '0', 0, '}}'"""


def _entries(net: dict) -> list[tuple[int, int, int, int]]:
    return [(kind, p, t, w) for kind, m in ((0, net["I_minus"]), (1, net["I_plus"])) for p, row in enumerate(m) for t, w in enumerate(row) if w]


def _unit(net: dict) -> list[tuple[int, int, int]]:
    return [(kind, p, t) for kind, p, t, w in _entries(net) for _ in range(w)]


def _sized(net: dict) -> tuple[int, int]:
    return len(net["M0"]), len(net["I_minus"][0])


def _file(parts: list[list[tuple[str, list[str]]]]) -> str:
    return _values([(part, pos, sub, line) for part, blocks in enumerate(parts) for pos, lines in blocks for sub, line in enumerate(lines)], "part, pos, sub, line")


def _net_dot() -> str:
    net = sample_net("net_1")
    np, nt = _sized(net)
    return _file([
        [("0", ["digraph PetriNet {", "  rankdir=LR;", "  node [shape=circle];"])],
        [(str(p), [f'  p{p} [label="p{p}{" (start)" if not p else ""}", shape=circle];']) for p in range(np)],
        [(str(t), [f'  t{t} [label="t{t}", shape=box];']) for t in range(nt)],
        [(f"{kind}.{p}.{t}", [f"  t{t} -> p{p};" if kind else f"  p{p} -> t{t};"]) for kind, p, t, _ in _entries(net)],
        [("0", ["}"])],
    ])


def _xml() -> str:
    net = sample_net("net_3")
    np, nt = _sized(net)

    def tag(depth: int, name: str, *inner: str) -> list[str]:
        pad = "    " * depth
        return [f"{pad}<{name}>", *inner, f"{pad}</{name.split()[0]}>"]

    def value(depth: int, name: str, text: str) -> list[str]:
        return tag(depth, name, "    " * (depth + 1) + f"<value>{text}</value>")

    def box(name: str, i: str, x: int, y: int, *rest: str) -> list[str]:
        pad4 = "    " * 4
        title = tag(3, "name", f"{pad4}<value>{i}</value>", *tag(4, "graphics", "    " * 5 + '<offset x="5" y="33"/>'))
        return tag(2, f'{name} id="{i}"', *tag(3, "graphics", f'{pad4}<position x="{x}" y="{y}"/>'), *title, *rest)

    settings = [x for name, text in (("orientation", "270"), ("rate", "1.0"), ("timed", "false"), ("infiniteServer", "false"), ("priority", "1")) for x in value(3, name, text)]
    arc = [*tag(3, "inscription", "    " * 4 + "<value>Default,1</value>", "    " * 4 + "<graphics/>"), "    " * 3 + '<type value="regular"/>', "    " * 3 + "<exported>true</exported>"]
    ends = lambda kind, p, t: (f"T{t + 1}", f"P{p + 1}") if kind else (f"P{p + 1}", f"T{t + 1}")
    return _file([
        [("0", ['<?xml version="1.0" encoding="UTF-8"?>', "<pnml>", '    <net id="Net-One" type="P/T net">', '        <token id="Default" enabled="true" red="0" green="0" blue="0"/>'])],
        [(str(p), box("place", f"P{p + 1}", 100, 50 + 80 * p, *value(3, "initialMarking", f"Default,{net['M0'][p]}"), *value(3, "capacity", "0"))) for p in range(np)],
        [(str(t), box("transition", f"T{t + 1}", 300, 50 + 80 * t, *settings)) for t in range(nt)],
        [(str(n), tag(2, f'arc id="A{n + 1}" source="{ends(*a)[0]}" target="{ends(*a)[1]}"', *arc)) for n, a in enumerate(_unit(net))],
        [("0", ["    </net>", "</pnml>"])],
    ])


def _pnml() -> str:
    net = sample_net("net_3")
    np, nt = _sized(net)
    name = lambda i, y: f'    <name><text>{i}</text><graphics><offset x="0" y="{y}"/></graphics></name>'
    spot = lambda x, i: f'    <graphics><position x="{x}" y="{100 + 180 * i}"/></graphics>'
    space = "http://www.pnml.org/version-2009/grammar/"
    rows = []
    for p in range(np):
        tokens = net["M0"][p]
        lines = [f'   <place id="p{p}">', name(f"p{p}", -10), f"    <initialMarking><text>{tokens}</text></initialMarking>" if tokens else None, spot(100, p), "   </place>"]
        rows += [(1, str(p), sub, line) for sub, line in enumerate(lines) if line]
    for t in range(nt):
        rows += [(2, str(t), sub, line) for sub, line in enumerate([f'   <transition id="t{t}">', name(f"t{t}", 0), spot(300, t), "   </transition>"])]
    for n, (kind, p, t) in enumerate(_unit(net)):
        a, b = (f"t{t}", f"p{p}") if kind else (f"p{p}", f"t{t}")
        rows.append((3, str(n), 0, f'   <arc id="e{n}" source="{a}" target="{b}"/>'))
    head = ['<?xml version="1.0"?>', f'<pnml xmlns="{space}pnml">', f' <net id="net1" type="{space}ptnet">', "  <name><text>net_3.pnml</text></name>", '  <page id="page1">']
    rows += [(0, "0", i, x) for i, x in enumerate(head)] + [(4, "0", i, x) for i, x in enumerate(["  </page>", " </net>", "</pnml>"])]
    return _values(rows, "part, pos, sub, line")


def oracle_sql() -> dict[str, str]:
    return {
        "states_net_1": _shown("net_1"),
        "states_net_3_omega": _shown("net_3"),
        "states_order_sensitive": _shown("order"),
        "state_count_net_2": _COUNT_NET_2,
        "edges_net_3_omega": _EDGES,
        "states_from_files": f"SELECT * FROM ({_shown('net_1')}) UNION ALL SELECT * FROM ({_shown('net_3')})",
        "states_compat": f"SELECT net_id, {_NODE.format('path')} AS node_id, {_COMPACT.format('m')} AS marking, len(path)::INT AS depth FROM ({_ALL_COMPAT})",
        "repeated_markings_compat": f"SELECT net_id, '[' || array_to_string(m, ', ') || ']' AS marking, count(*) AS n FROM ({_ALL_COMPAT}) GROUP BY net_id, m HAVING count(*) > 1",
        "repeated_markings_check": " UNION ALL ".join(
            f"SELECT * FROM ({_states(n)} SELECT '{n}' AS net_id, '[' || array_to_string(m, ', ') || ']' AS marking, count(*) AS n FROM r GROUP BY m HAVING count(*) > 1)" for n in ("net_1", "net_3", "order")
        ),
        "firings_net_3": f"{_firings('net_1')} UNION ALL {_firings('net_3')}",
        "explained_nodes": _EXPLAINED,
        "family_state_counts": f"{_FAMILY} SELECT net_id, {_STATES_OF} AS n_states, 0::BIGINT AS n_omega_states FROM s",
        "family_edge_counts": f"{_FAMILY} SELECT net_id, {_STATES_OF} - 1 AS n_edges, {_STATES_OF} - 1 AS n_children FROM s",
        "generated_arcs": _ARCS,
        "generated_documents": _DOCUMENTS,
        "transition_deltas": _DELTAS,
        "subnet_operators": _subnets(),
        "vector_enabled": f"{_VECTORS} SELECT o, l, p, s, {_OK} AS enabled FROM v",
        "vector_fire": f"{_VECTORS} SELECT o, l, p, s, '[' || array_to_string(list_transform(list_zip(m, delta), lambda z: CASE WHEN z[1] = -1 THEN -1 ELSE z[1] + z[2] END), ',') || ']' AS fired FROM v WHERE {_OK}",
        "vector_omega_mask": _MASK,
        "vector_accelerate": _ACCELERATE,
        "vector_gather_scatter": f"{_VECTORS} SELECT o, l, p, s, {_COMPACT.format('[m[4], m[1]]')} AS part, {_COMPACT.format('[a[1], 0, a[3], m[4], 0]')} AS whole FROM v",
        "theta_join": f"{_VECTORS}, tr(t, pre) AS (VALUES {_PRES}) SELECT t, count(*) AS n FROM (SELECT m FROM v) v JOIN tr ON {_OK} GROUP BY t",
        "enabled_lists": f"""{_VECTORS}, tr(t, pre) AS (VALUES {_PRES}), e AS (SELECT o, l, p, s, list(DISTINCT t ORDER BY t) AS ts FROM (SELECT o, l, p, s, m FROM v) v JOIN tr ON {_OK} GROUP BY ALL)
SELECT v.o, v.l, v.p, v.s, '[' || coalesce(array_to_string(ts, ','), '') || ']' AS enabled FROM v LEFT JOIN (SELECT DISTINCT * FROM e) e ON v.o = e.o AND v.l = e.l AND v.p = e.p AND v.s = e.s""",
        "first_markings": f"{_VECTORS} SELECT {_COMPACT.format('m')} AS marking, min((o, l, p, s))[1] AS o, min((o, l, p, s))[2] AS l, count(*) AS n FROM v GROUP BY m",
        "unseen_markings": f"{_VECTORS} SELECT DISTINCT {_COMPACT.format('m')} AS marking FROM v WHERE m NOT IN (SELECT a FROM v)",
        "id_functions": _IDS,
        "dot_of_tree": _TREE_DOT,
        "dot_of_net": _net_dot(),
        "xml_of_net": _xml(),
        "pnml_of_net": _pnml(),
    }
