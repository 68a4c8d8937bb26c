"""DOT, XML and PNML forms as DataFrames of lines: (net_id, position..., line), and their writers.

Element layouts and constants are fixed values of the formats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from markspan.functions.vectors import label, node_id, parent_path, quoted


def _lines(frame: DataFrame, part: int, order: Column, *lines: Column) -> DataFrame:
    """Rows (net_id, part, pos, sub, line), one per given line expression."""
    return frame.select("net_id", F.lit(part).alias("part"), order.alias("pos"), F.posexplode(F.array(*lines)).alias("sub", "line"))


def _fixed(nets: DataFrame, part: int, *lines: str | Column) -> DataFrame:
    return _lines(nets.select("net_id").distinct(), part, F.array(F.lit(0)), *(F.lit(x) if isinstance(x, str) else x for x in lines))


def _all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _text(template: str, **values: Column) -> Column:
    """A line with {names} filled in by columns."""
    pieces: list[Column] = []
    rest = template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [F.lit(before), values[name].cast("string")]
    return F.concat(*pieces, F.lit(rest))


def tree_dot(states: DataFrame) -> DataFrame:
    """The state tree as DOT: a box per state in order of path, then an edge to each state from its parent."""
    this, parent = quoted(node_id("path")), quoted(node_id(parent_path("path")))
    inner = states.where(F.size("path") > 0)
    return _all(
        _fixed(states, 0, "digraph ReachabilityTree {", "  node [shape=box];", ""),
        _lines(states, 1, F.col("path"), _text('  {id} [label="{label}"];', id=this, label=label("marking"))),
        _fixed(states, 2, ""),
        _lines(inner, 3, F.col("path"), _text('  {parent} -> {id} [label="t{t}"];', parent=parent, id=this, t=F.element_at("path", -1))),
        _fixed(states, 4, "}"),
    )


def _places(nets: DataFrame) -> DataFrame:
    return nets.select("net_id", F.posexplode("M0").alias("p", "tokens"))


def _transitions(nets: DataFrame) -> DataFrame:
    return nets.select("net_id", F.posexplode(F.get("I_minus", F.lit(0))).alias("t", "w")).drop("w")


def arcs(nets: DataFrame) -> DataFrame:
    """(net_id, kind, p, t, w): nonzero matrix entries; kind 0 place to transition, 1 transition to place."""
    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("I_minus").alias("m")), F.struct(F.lit(1).alias("kind"), F.col("I_plus").alias("m")))
    rows = nets.select("net_id", F.inline(both)).select("net_id", "kind", F.posexplode("m").alias("p", "row"))
    return rows.select("net_id", "kind", "p", F.posexplode("row").alias("t", "w")).where("w <> 0")


def unit_arcs(nets: DataFrame) -> DataFrame:
    """(net_id, kind, p, t, n): an arc of weight w as w arcs, numbered from 0 per net: consuming ones first, row by row."""
    each = arcs(nets).where("w > 0").select("net_id", "kind", "p", "t", F.explode(F.sequence(F.lit(1), F.col("w"))).alias("k"))
    return each.withColumn("n", F.row_number().over(Window.partitionBy("net_id").orderBy("kind", "p", "t", "k")) - 1)


def net_dot(nets: DataFrame) -> DataFrame:
    """A net's structure as DOT, one arc per nonzero entry."""
    name = F.when(F.col("p") == 0, "p0 (start)").otherwise(_text("p{p}", p=F.col("p")))
    link = F.when(F.col("kind") == 0, _text("  p{p} -> t{t};", p=F.col("p"), t=F.col("t"))).otherwise(_text("  t{t} -> p{p};", p=F.col("p"), t=F.col("t")))
    return _all(
        _fixed(nets, 0, "digraph PetriNet {", "  rankdir=LR;", "  node [shape=circle];"),
        _lines(_places(nets), 1, F.array("p"), _text('  p{p} [label="{name}", shape=circle];', p=F.col("p"), name=name)),
        _lines(_transitions(nets), 2, F.array("t"), _text('  t{t} [label="t{t}", shape=box];', t=F.col("t"))),
        _lines(arcs(nets), 3, F.array("kind", "p", "t"), link),
        _fixed(nets, 4, "}"),
    )


def editor_xml(nets: DataFrame) -> DataFrame:
    """XML of a graphical editor: 1-based names, parallel arcs of weight 1."""
    p, t, n = F.col("p"), F.col("t"), F.col("n")
    position = '            <graphics>|                <position x="{x}" y="{y}"/>|            </graphics>'
    name = '            <name>|                <value>{id}</value>|                <graphics>|                    <offset x="5" y="33"/>|                </graphics>|            </name>'
    field = lambda tag, value: f"            <{tag}>|                <value>{value}</value>|            </{tag}>"
    place = f'        <place id="{{id}}">|{position}|{name}|{field("initialMarking", "Default,{tokens}")}|{field("capacity", "0")}|        </place>'
    settings = "|".join(field(tag, value) for tag, value in (("orientation", "270"), ("rate", "1.0"), ("timed", "false"), ("infiniteServer", "false"), ("priority", "1")))
    transition = f'        <transition id="{{id}}">|{position}|{name}|{settings}|        </transition>'
    arc = '        <arc id="A{n}" source="{source}" target="{target}">|            <inscription>|                <value>Default,1</value>|                <graphics/>|            </inscription>|            <type value="regular"/>|            <exported>true</exported>|        </arc>'
    each = lambda template, **v: [_text(x, **v) for x in template.split("|")]
    pid, tid = _text("P{p}", p=p + 1), _text("T{t}", t=t + 1)
    ends = {"source": F.when(F.col("kind") == 0, pid).otherwise(tid), "target": F.when(F.col("kind") == 0, tid).otherwise(pid)}
    return _all(
        _fixed(nets, 0, '<?xml version="1.0" encoding="UTF-8"?>', "<pnml>", '    <net id="Net-One" type="P/T net">', '        <token id="Default" enabled="true" red="0" green="0" blue="0"/>'),
        _lines(_places(nets), 1, F.array("p"), *each(place, id=pid, x=F.lit(100), y=p * 80 + 50, tokens=F.col("tokens"))),
        _lines(_transitions(nets), 2, F.array("t"), *each(transition, id=tid, x=F.lit(300), y=t * 80 + 50)),
        _lines(unit_arcs(nets), 3, F.array("n"), *each(arc, n=n + 1, **ends)),
        _fixed(nets, 4, "    </net>", "</pnml>"),
    )


def pnml(nets: DataFrame, file_name: str = "net.pnml", generated: str | None = None) -> DataFrame:
    """PNML: 0-based names, parallel arcs; ``generated`` is the text of the header comment, left out if None."""
    p, t, n = F.col("p"), F.col("t"), F.col("n")
    tokens = F.when(F.col("tokens") > 0, _text("    <initialMarking><text>{v}</text></initialMarking>", v=F.col("tokens")))
    place = [
        _text('   <place id="p{p}">', p=p),
        _text('    <name><text>p{p}</text><graphics><offset x="0" y="-10"/></graphics></name>', p=p),
        tokens,
        _text('    <graphics><position x="100" y="{y}"/></graphics>', y=p * 180 + 100),
        F.lit("   </place>"),
    ]
    transition = [
        _text('   <transition id="t{t}">', t=t),
        _text('    <name><text>t{t}</text><graphics><offset x="0" y="0"/></graphics></name>', t=t),
        _text('    <graphics><position x="300" y="{y}"/></graphics>', y=t * 180 + 100),
        F.lit("   </transition>"),
    ]
    pid, tid = _text("p{p}", p=p), _text("t{t}", t=t)
    arc = _text('   <arc id="e{n}" source="{a}" target="{b}"/>', n=n, a=F.when(F.col("kind") == 0, pid).otherwise(tid), b=F.when(F.col("kind") == 0, tid).otherwise(pid))
    comment = [f"<!-- {generated} -->"] if generated is not None else []
    head = ['<pnml xmlns="http://www.pnml.org/version-2009/grammar/pnml">', ' <net id="net1" type="http://www.pnml.org/version-2009/grammar/ptnet">', f"  <name><text>{file_name}</text></name>", '  <page id="page1">']
    return _all(
        _fixed(nets, 0, '<?xml version="1.0"?>', *comment, *head),
        _lines(_places(nets), 1, F.array("p"), *place).where("line IS NOT NULL"),
        _lines(_transitions(nets), 2, F.array("t"), *transition),
        _lines(unit_arcs(nets), 3, F.array("n"), arc),
        _fixed(nets, 4, "  </page>", " </net>", "</pnml>"),
    )


def net_json(nets: DataFrame) -> DataFrame:
    """(net_id, json): each net as one JSON document."""
    return nets.select("net_id", F.to_json(F.struct("M0", "I_minus", "I_plus", "subnet_definitions")).alias("json"))


def ordered(lines: DataFrame) -> DataFrame:
    """(net_id, line) in order."""
    return lines.orderBy("net_id", "part", "pos", "sub").select("net_id", "line")


def write_lines(lines: DataFrame, path: str, one_file: bool = False) -> None:
    """Text files of the lines in order: a range of the order per file, or one file for a single small net."""
    text = lines.orderBy("net_id", "part", "pos", "sub").select("line")
    (text.coalesce(1) if one_file else text).write.mode("overwrite").text(path)


def write_text(lines: DataFrame, path: str) -> None:
    """One local file from the driver, for a single net: its lines stream through the driver partition by partition."""
    with open(path, "w", encoding="utf-8") as file:
        for row in ordered(lines).toLocalIterator():
            file.write(row["line"] + "\n")

