from __future__ import annotations

from collections import defaultdict

import pytest

from markspan.llm import url_filter
from markspan.llm.oracles import OP2

RULES = url_filter.RULES
A = '<a href="{}">x</a>'
PAGES = [
    (1, "http://A.Example.NET/en/1?x#y", A.format("http://trusted.org/fr/1")),
    (2, "http://a.example.net/de/1", ""),
    (3, "https://www.example.com/de/", None),
    (4, "https://example.com", ""),
    (5, "http://trusted.org/fr/1", A.format("//friend.edu/a") + A.format("/own") + A.format("http://friend.edu/b")),
    (6, "http://trusted.org/fr/2", ""),
    (7, "http://spam.net/", A.format("http://victim.edu/")),
    (8, "http://linker.edu/a", A.format("http://spam.net/x") + A.format("HTTP://SPAM.NET/y") + A.format("http://friend.edu/")),
    (9, "http://far.edu/a", A.format("http://linker.edu/")),
    (10, "http://friend.edu/a", A.format("http://spam.net/")),
    (11, "http://victim.edu/?q", ""),
    (12, None, A.format("http://spam.net/")),
    (13, "mailto:x", ""),
    (14, "", ""),
    (15, "http://notexample.net.evil.edu/en/", ""),
    (16, "http://net", ""),
    (17, "http://net/", ""),
    (17, "http://net/", ""),
    (18, "ftp://x.org://y/fr/", ""),
    (None, "http://far.edu/b", ""),
]


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    for c in "?#":
        tail = tail.split(c, 1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail


def rule(host, path):
    fits = [(len(d + p), d + p, v) for v, d, p in RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute(pages, rounds=10, damping=0.85):
    import re

    edges, stats = defaultdict(float), defaultdict(lambda: [0, 0, 0])
    for _, url, html in pages:
        host, path = host_path(url)
        _, v = rule(host, path)
        if host:
            stats[host][0] += 1
            stats[host][1] += v == "allow"
            stats[host][2] += v == "block"
        for link in re.findall(r"""(?i)href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)""", html or ""):
            to, _ = host_path("http:" + link if link.startswith("//") else link)
            if host and to and host != to:
                edges[host, to] += 1

    def rank(links, seed):
        total = sum(seed.values())
        if not total:
            return {}
        out = defaultdict(float)
        for (a, _), w in links.items():
            out[a] += w
        jump = {h: s / total for h, s in seed.items() if s}
        score = {h: (1 - damping) * s for h, s in jump.items()}
        for _ in range(rounds):
            new = {h: (1 - damping) * s for h, s in jump.items()}
            for (a, b), w in links.items():
                if a in score:
                    new[b] = new.get(b, 0.0) + damping * score[a] * w / out[a]
            score = new
        return score

    trust = rank(edges, {h: a if 2 * a > n else 0 for h, (n, a, _) in stats.items()})
    distrust = rank({(b, a): w for (a, b), w in edges.items()}, {h: b if 2 * b > n else 0 for h, (n, _, b) in stats.items()})
    bad = {h for h, d in distrust.items() if d > trust.get(h, 0.0) + 1e-12}
    out = []
    for i, url, _ in pages:
        host, path = host_path(url)
        r, v = rule(host, path)
        out.append((i, host, path, r, v or ("block" if host in bad else "allow")))
    return out


def run(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "'y' as rule", "1 as verdict", "2 as score")


def test_equals_brute_force(spark):
    got = sorted((tuple(r) for r in url_filter.filter_urls(run(spark, PAGES)).collect()), key=repr)
    want = sorted(brute(PAGES), key=repr)
    assert got == want
    by_id = {r[0]: r for r in want}
    assert by_id[8][4] == "block" and by_id[9][4] == "block", "hosts that lead to blocked ones are blocked"
    assert by_id[11][4] == "allow", "a blocked host cannot get another one blocked by linking to it"
    assert by_id[1][3] == "example.net/en/" and by_id[2][3] == "net/" and by_id[16][3] is None and by_id[17][3] == "net/"


def test_empty_and_linkless(spark):
    assert url_filter.filter_urls(run(spark, PAGES).limit(0)).count() == 0
    rows = [(i, u, "") for i, u, _ in PAGES]
    assert sorted((tuple(r) for r in url_filter.filter_urls(run(spark, rows)).collect()), key=repr) == sorted(brute(rows), key=repr)
    nulls = [(1, None, None)] * 3
    assert [tuple(r) for r in url_filter.filter_urls(run(spark, nulls)).collect()] == [(1, "", "", None, "allow")] * 3


def chain(n):
    """n hosts, each linking to the next, the last to a blocked page; two of them on a cycle, and a trusted host half way."""
    rows = [(i, f"http://h{i}.edu/", A.format(f"http://h{i + 1}.edu/" if i + 1 < n else "http://spam.net/")) for i in range(n)]
    rows += [(n, "http://spam.net/", ""), (n + 1, "http://good.org/fr/", A.format(f"http://h{n // 2}.edu/")), (n + 2, "http://h3.edu/back", A.format("http://h2.edu/"))]
    return rows


def test_chain_longer_than_ten_links_equals_converged_ranks(spark):
    rows = chain(16)
    want = sorted(brute(rows, rounds=400), key=repr)
    assert sorted((tuple(r) for r in url_filter.filter_urls(run(spark, rows)).collect()), key=repr) == want
    assert {v for i, *_, v in want if i < 3} == {"block"} != {v for i, *_, v in sorted(brute(rows)) if i < 3}


def sql_rows(rows):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    return sorted(con.sql(OP2).fetchall(), key=repr)


@pytest.mark.parametrize("rows", [PAGES, chain(40)], ids=["linked", "chain"])
def test_equals_its_sql_on_links(spark, rows):
    got = sorted((tuple(r) for r in url_filter.filter_urls(run(spark, rows)).collect()), key=repr)
    assert got == sql_rows(rows)
    if len(rows) > 40:
        assert [v for i, *_, v in sorted(got) if i < 20] == ["block"] * 20, "distrust reaches hosts forty links away"


def test_hub_with_many_unequal_links(spark):
    """A third of all links leave one host; each link's share follows its weight."""
    rows = [(0, "http://hub.org/fr/", "".join(A.format(f"http://h{i}.edu/") * (1 + i % 5) for i in range(300)))]
    rows += [(i + 1, f"http://h{i}.edu/", A.format("http://spam.net/") if i % 3 == 0 else A.format(f"http://h{i - 1}.edu/")) for i in range(300)]
    rows += [(400 + i, "http://spam.net/", "") for i in range(1 + 300 % 7)] + [(900, "http://hub.org/fr/2", "")]
    got = sorted((tuple(r) for r in url_filter.filter_urls(run(spark, rows)).collect()), key=repr)
    assert got == sorted(brute(rows, rounds=400), key=repr) == sql_rows(rows) and {r[4] for r in got} == {"allow", "block"}


def test_unsettled_ranks_raise(spark):
    with pytest.raises(RuntimeError, match="3 rounds"):
        url_filter.filter_urls(run(spark, chain(16)), max_rounds=3)


def test_verdict_does_not_depend_on_the_number_of_seeds(spark):
    """A little distrust without any trust blocks; equal trust and distrust, however small, do not."""
    many = 10**12
    hosts = [("seed.net", 0.0, 1.0), ("good.org", 1.0, 0.0), ("others.net", 0.0, float(many)), ("others.org", float(many), 0.0)]
    links = [(f"h{i}.edu", "seed.net", 1.0) for i in range(20)] + [("good.org", "tied.edu", 1.0), ("tied.edu", "seed.net", 1.0)]
    links += [("good.org", f"g{i}.edu", 1.0) for i in range(20)]
    edges, seeds = spark.createDataFrame(links, "src string, dst string, weight double"), spark.createDataFrame(hosts, "host string, good double, bad double")
    got = {r.host: (r.trust, r.distrust) for r in url_filter.trust_and_distrust(edges, seeds, 0.85, 1000).collect()}
    blocked = {r.host for r in url_filter.blocked_hosts(edges, seeds).collect()}
    assert 0 < got["h0.edu"][1] < 1e-12 and "h0.edu" in blocked
    assert abs(got["tied.edu"][0] - got["tied.edu"][1]) < 1e-9 * got["tied.edu"][0] and "tied.edu" not in blocked
    assert blocked == {"seed.net", "others.net"} | {f"h{i}.edu" for i in range(20)}
