import re

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import url_filter

URLS = [
    "http://Example.COM/en/1", "https://www.example.com/en/2?x=/", "https://m.example.com/en/", "http://example.com/fr/1", "http://a.net/es/1", "http://net/fr/2", "http://a.net/en/1",
    "http://notexample.com/en/1", "com/x", None, "", "http://", "http://host.org", "http://host.com#en/", "ftp://a://b.net/es/1", "http://É.com/en/", "http://a.net/es", "http://x.com/\n/y",
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits, key=lambda f: len(f[0])) if fits else (None, None)))


def test_rules_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    found = {r["page_id"]: r for r in url_filter.judge(pages).selectExpr("row.page_id", "host", "path", "rule", "verdict").collect()}
    assert len(found) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute(u)
        assert (found[i]["host"], found[i]["path"], found[i]["rule"]) == (host, path, rule), u
        assert verdict is None or found[i]["verdict"] == verdict
    assert url_filter.keep(pages).columns == pages.columns
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_thousands_of_rules_match_brute_force(spark):
    rules = [(f"h{i % 900}.org", f"/{'ab'[i % 2] * (i % 5)}", ("allow", "block")[i % 2]) for i in range(3000)] + [("org", "/", "block"), ("", "/", "allow"), ("b.h1.org", "/a", "block")]
    urls = [f"http://{s}h{i}.org/{p}" for i in range(0, 1000, 7) for s in ("", "b.", "c.b.") for p in ("", "aaa", "bbbbb/x")] + ["http:///x", "http://.h1.org/a", "http://org"]
    table = spark.createDataFrame([(u,) for u in urls], "url string").select("url", url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"))
    for r in table.select("*", url_filter.rule_of(F.col("host"), F.col("path"), rules).alias("found")).collect():
        fits = [(-len(h + p), h, p, v) for h, p, v in rules if (r["host"] == h or h and r["host"].endswith("." + h)) and r["path"].startswith(p)]
        assert (tuple(r["found"]) if r["found"] else None) == ((min(fits)[1] + min(fits)[2], min(fits)[3]) if fits else None), r["url"]


def power(edges, seeds, rounds=200, damping=0.85):
    out = {}
    for s, _, n in edges:
        out[s] = out.get(s, 0) + n
    rank = dict(seeds)
    for _ in range(rounds):
        flow = {}
        for s, d, n in edges:
            flow[d] = flow.get(d, 0) + damping * rank.get(s, 0) * n / out[s]
        back = 1 - sum(flow.values())
        rank = {h: flow.get(h, 0) + back * seeds.get(h, 0) for h in {*flow, *seeds}}
    return rank


def test_propagation_matches_power_iteration(spark):
    edges = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "a", 3.0), ("b", "e", 1.0)]
    seeds = {"a": 0.5, "d": 0.5}
    expected = power(edges, seeds)
    table = spark.createDataFrame(edges, "src string, dst string, n double")
    found = url_filter.propagate(table, spark.createDataFrame(list(seeds.items()), "host string, mass double"), rounds=60, tolerance=1e-9)
    got = {r["host"]: r["rank"] for r in found.collect()}
    assert set(got) == set(expected) and all(got[h] == pytest.approx(expected[h], abs=1e-6) for h in got)


def test_links_spread_trust_and_distrust(spark):
    link = lambda *hosts: " ".join(f'<a href="http://{h}/x">' for h in hosts)
    pages = [
        (1, "http://good.com/", link("friend.org")), (2, "http://friend.org/1", link("friend.org", "other.org")), (3, "http://farm.org/1", link("bad.net")),
        (4, "http://bad.net/es/1", "<a href='//farm.org/'>"), (5, "http://alone.org/", None), (6, "http://bad.net/other", ""),
    ]
    found = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(pages + [(7, "http://bad.net/fr/1", "")], "page_id long, url string, html string")).selectExpr("row.page_id", "verdict", "trust", "distrust").collect()}
    assert {i: found[i]["verdict"] for i in range(1, 7)} == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "block"}
    assert found[2]["trust"] > 0 == found[5]["trust"]


def test_distrust_goes_along_a_chain_of_32_hosts(spark):
    hosts = ["bad.net", *(f"h{i}.org" for i in range(1, 33))]
    edges = [*zip(hosts, hosts[1:]), *((a, f"x.{a}") for a in hosts[:-1])]
    table = spark.createDataFrame([(b, a, 1.0) for a, b in edges], "src string, dst string, n double")
    judged = spark.createDataFrame([("bad.net", "block")], "host string, verdict string")
    found = {r["host"]: r for r in url_filter.host_verdicts(judged, table).collect()}
    expected = power([(a, b, 1.0) for a, b in edges], {"bad.net": 1.0})
    assert set(found) == set(expected) and all(r["host_verdict"] == "block" for r in found.values())
    assert all(r["distrust"] == pytest.approx(expected[h], abs=1e-5) for h, r in found.items())
