"""URL filtering by rules and by trust that spreads over the hosts' link graph. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspan.llm.tables import discard, materialize

#: Verdict, host, path of each rule.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Trust and distrust that differ by no more than this share of the larger are equal.
TIE = 1e-9
MAX_ROUNDS = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits the host or a parent domain and the path's start; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, domain, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(domain + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links of pages to other hosts, by absolute links in href attributes."""
    links = F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    url = F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), F.col("url"))).otherwise(F.col("url"))
    return (
        pages.select(host_of(F.col("url")).alias("src"), F.explode(links).alias("url"))
        .select("src", host_of(url).alias("dst"))
        .where("src <> dst AND src <> '' AND dst <> ''")
        .groupBy("src", "dst")
        .agg(F.count("*").cast("double").alias("weight"))
    )


def trust_and_distrust(edges: DataFrame, seeds: DataFrame, damping: float, max_rounds: int) -> DataFrame:
    """(host, trust, distrust, ...) from ``seeds`` (host, good, bad); a host without links gives its mass back to no one.

    Trust follows links, distrust follows them backwards; both are personalised
    PageRanks, summed from the masses that arrive after 0, 1, 2, ... links. What
    is still to arrive anywhere is at most the last masses' sum times damping /
    (1 - damping), so rounds go on until that cannot alter a verdict. More than
    ``max_rounds`` raise.

    Masses are written every round, which cuts lineage; a hub's many in-links
    are summed before the shuffle. Its many out-links meet tables that are
    written first, so both inputs of the joins come through an exchange and
    adaptive execution can split the hub's partition.
    """
    total = seeds.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    start = {c: (1 - damping) * F.col(c) / total[c] if total[c] else F.lit(0.0) for c in ("good", "bad")}
    first = seeds.where("good > 0 OR bad > 0").select("host", start["good"].alias("trust"), start["bad"].alias("distrust"))
    state = materialize(first.select("*", F.col("trust").alias("trust_step"), F.col("distrust").alias("distrust_step")), "ranks")
    if not total["bad"] or edges.isEmpty():
        return state
    links = edges.select(F.lit(False).alias("back"), "src", "dst", "weight").union(edges.select(F.lit(True), "dst", "src", "weight"))
    out = materialize(links.groupBy("back", "src").agg(F.sum("weight").alias("out")), "out-weights")
    share = materialize(links.join(out.hint("merge"), ["back", "src"]).select("back", "src", "dst", (F.col("weight") / F.col("out")).alias("part")), "shares")
    discard(out)
    hosts = state.count()
    for _ in range(max_rounds):
        steps = F.array(F.struct(F.lit(False).alias("back"), F.col("trust_step").alias("step")), F.struct(F.lit(True).alias("back"), F.col("distrust_step").alias("step")))
        moving = state.select(F.col("host").alias("src"), F.inline(steps)).where("step > 0")
        step = damping * F.col("step") * F.col("part")
        moved = share.join(moving.hint("merge"), ["back", "src"]).select(
            F.col("dst").alias("host"), F.when(F.col("back"), 0.0).otherwise(step).alias("trust_step"), F.when(F.col("back"), step).otherwise(0.0).alias("distrust_step")
        )
        held = state.select("host", "trust", "distrust", F.lit(0.0).alias("trust_step"), F.lit(0.0).alias("distrust_step"))
        both = held.union(moved.select("host", F.col("trust_step").alias("trust"), F.col("distrust_step").alias("distrust"), "trust_step", "distrust_step"))
        before, state = state, materialize(both.groupBy("host").agg(*(F.sum(c).alias(c) for c in both.columns[1:])), "ranks")
        discard(before)
        now = state.agg(F.count("*").alias("hosts"), F.sum(F.col("trust_step") + F.col("distrust_step")).alias("moved")).first()
        if _settled(state, now["moved"] * damping / (1 - damping), now["hosts"] > hosts):
            discard(share)
            return state
        hosts = now["hosts"]
    raise RuntimeError(f"trust is not settled after {max_rounds} rounds")


def _tie() -> Column:
    """The difference that rounding can make; relative, so that the number of seeds does not matter."""
    return TIE * F.greatest("trust", "distrust")


def _settled(state: DataFrame, left: float, grew: bool) -> bool:
    """Whether no verdict can change by the mass ``left``; ``grew`` if the last round reached new hosts.

    Without new hosts none will follow, so a host that only one of the two
    reaches is settled; one that both reach is when they differ by more than
    what is left, or what is left is no more than a tie.
    """
    if left == 0:
        return True
    close = (F.col("trust") > 0) & (F.col("distrust") > 0) & (F.abs(F.col("distrust") - F.col("trust")) <= _tie() + left) & (_tie() < left)
    return not grew and state.where(close).isEmpty()


def blocked_hosts(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(host) of the hosts whose distrust is above their trust."""
    return trust_and_distrust(edges, seeds, damping, max_rounds).where(F.col("distrust") > F.col("trust") + _tie()).select("host")


def host_verdicts(pages: DataFrame, rules=RULES, damping: float = 0.85, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(host) of the hosts that the link graph blocks.

    Seeds: a host with over half of its pages under allow rules is trusted, one
    with over half under block rules is blocked; its seed is its number of such
    pages. Trust follows links, distrust follows them backwards. A host is
    blocked when its distrust is above its trust; a host that neither reaches
    is not.
    """
    seen = pages.select(host_of(F.col("url")).alias("host"), rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"].alias("verdict"))
    by_host = materialize(
        seen.where("host <> ''")
        .groupBy("host")
        .agg(F.count("*").alias("pages"), F.count_if(F.col("verdict") == "allow").alias("allowed"), F.count_if(F.col("verdict") == "block").alias("blocked")),
        "hosts",
    )
    edges = materialize(host_edges(pages), "host-edges")
    most = lambda c: F.when(F.col(c) * 2 > F.col("pages"), F.col(c)).otherwise(0).cast("double")
    seeds = by_host.select("host", most("allowed").alias("good"), most("blocked").alias("bad"))
    return blocked_hosts(edges, seeds, damping, max_rounds)


def filter_urls(pages: DataFrame, rules=RULES, damping: float = 0.85, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page: the longest fitting rule's verdict, else the link graph's.

    A null url or one without ``://`` has empty host and path, no rule, and is
    allowed. Repeated rows are judged alike, null html has no links, extra
    columns are ignored, an empty table gives an empty result.
    """
    blocked = materialize(host_verdicts(pages, rules, damping, max_rounds), "blocked-hosts", small=True).withColumn("graph", F.lit("block"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), rule_of(host, path, rules).alias("r"))
    return judged.join(blocked, "host", "left").select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), "graph", F.lit("allow")).alias("verdict")
    )
