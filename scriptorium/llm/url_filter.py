"""URL filters: rules for hosts and paths, and for the rest trust and distrust propagated over links between hosts.

A rule fits its host and all subdomains where the url's path starts with the rule's; the longest rule wins. Hosts most of
whose pages are allowed by a rule are trusted seeds, hosts most of whose pages are blocked are blocked seeds. Trust flows
along links from the trusted seeds (personalised PageRank), distrust against them from the blocked seeds: who links to
blocked hosts is distrusted. What no rule judges is blocked if its host has more distrust than trust.
"""

from __future__ import annotations

import itertools
import json
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, packed, q, small

#: (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
DAMPING = 0.85
#: The change of all ranks together below which propagation ends, once no round reaches another host.
TOLERANCE = 1e-6
#: Shares of trust and distrust from which a host's verdict counts: distrust / (trust + distrust) above this blocks.
BLOCK_ABOVE = 0.5
#: Hosts up to this number are broadcast to the pages (some 60 bytes each); more are joined by shuffle.
BROADCAST_HOSTS = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^"'\s<>]+)"""


def _rest(url: Column) -> Column:
    """What follows the first ://; null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does; of equally long ones the first by name.

    The rules are one constant table of slots by their hosts' checksums. A host asks the slot of each of its suffixes,
    up to as many labels as any rule has, so the cost of a page doesn't grow with the number of rules.
    """
    size = max(1, 2 * len(rules))
    slots: list[list[dict]] = [[] for _ in range(size)]
    for own, start, verdict in sorted(set(map(tuple, rules))):
        slots[zlib.crc32(own.encode()) % size].append({"short": -len(own + start), "host": own, "path": start, "verdict": verdict})
    table = F.from_json(F.lit(json.dumps(slots)), "array<array<struct<short:int,host:string,path:string,verdict:string>>>")
    deepest = max((r[0].count(".") + 1 for r in rules), default=1)
    suffixes = F.array(*[F.substring_index(host, ".", -n) for n in range(1, deepest + 1)])
    asked = F.flatten(F.transform(F.array_distinct(suffixes), lambda s: F.filter(F.get(table, (F.crc32(s.cast("binary")) % size).cast("int")), lambda r: (r["host"] == s) & path.startswith(r["path"]))))
    return F.transform(F.array(F.array_min(asked)), lambda r: F.when(r.isNotNull(), F.struct(F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict"))))[0]


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): absolute links from one host to another, summed for each pair of hosts on the map side first."""
    found = pages.select(host_of(q(url).cast("string")).alias("src"), F.explode(F.regexp_extract_all(F.coalesce(q(html).cast("string"), F.lit("")), F.lit(_LINK), 1)).alias("to"))
    to = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))
    return found.select("src", host_of(to).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank): personalised PageRank over edges (src, dst, n), with the seeds (host, mass; all masses sum to 1).

    What hosts without links would pass on goes back to the seeds, so ranks sum to 1. A round is one join on the linking
    host and one sum for each linked one, written to the checkpoint folder. Rounds go on until ranks change by less than
    the tolerance, which takes log(tolerance / 2) / log(damping) of them and a few more at most, and until all hosts that
    links lead to are reached, however far; `rounds` ends them earlier.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    shares = cut(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")))
    zero, rank = F.lit(0.0), lambda back: F.col("flow") + F.col("mass") * F.lit(back)
    # a host's rank is what flows to it and its mass times what goes back
    state, back = cut(seeds.select("host", zero.alias("flow"), "mass")), 1.0
    if state.isEmpty() or shares.isEmpty():
        return state.select("host", rank(back).alias("rank"))
    for _ in itertools.count() if rounds is None else range(rounds):
        flow = shares.join(state.select("host", rank(back).alias("rank")), F.col("src") == F.col("host")).groupBy("dst").agg((F.sum(F.col("share") * F.col("rank")) * damping).alias("flow"))
        rows = flow.select(F.col("dst").alias("host"), "flow", zero.alias("mass"), zero.alias("old"), F.lit(0).alias("known"))
        rows = rows.unionByName(state.select("host", zero.alias("flow"), "mass", rank(back).alias("old"), F.lit(1).alias("known")))
        after = cut(rows.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("flow", "mass", "old")], F.max("known").alias("known")))
        moved = after.agg(F.sum("flow").alias("flow"), F.sum(F.abs(rank(back) - F.col("old"))).alias("change"), F.count_if(F.col("known") == 0).alias("new")).first()
        before, back, state = back, 1 - moved["flow"], after.select("host", "flow", "mass")
        if moved["change"] + abs(back - before) < tolerance and not moved["new"]:
            break
    return state.select("host", rank(back).alias("rank"))


def host_verdicts(judged: DataFrame, edges: DataFrame, block_above: float = BLOCK_ABOVE) -> DataFrame:
    """(host, trust, distrust, host_verdict) for each host that either reaches, from rows (host, verdict of a rule or null)."""
    sums = judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "allow").alias("allowed"), F.count_if(F.col("verdict") == "block").alias("blocked"))
    hosts = cut(sums)
    edges = cut(edges)

    def seeds(of: str) -> DataFrame:
        chosen = hosts.where(F.col(of) * 2 > F.col("n")).select("host")
        n = chosen.count()
        return chosen.select("host", F.lit(1.0 / max(n, 1)).alias("mass"))

    trust = propagate(edges, seeds("allowed")).withColumnRenamed("rank", "trust")
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(against, seeds("blocked")).withColumnRenamed("rank", "distrust")
    zero = F.lit(0.0)
    both = trust.join(distrust, "host", "full").select("host", F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"))
    share = F.col("distrust") / (F.col("trust") + F.col("distrust"))
    return both.select("*", F.when(share > block_above, "block").otherwise("allow").alias("host_verdict"))


def judge(pages: DataFrame, rules=RULES, url: str = "url", html: str = "html") -> DataFrame:
    """`row` (the whole input row as a struct), host, path, rule, verdict, trust and distrust for each row of `pages`.

    Null urls and urls without :// have empty hosts and paths: no rule fits, no link counts, they are allowed. A host
    that neither trust nor distrust reaches is allowed. Repeated rows count as pages each; an empty table gives an empty
    table. Links are read from whole pages; the joins are on hosts, of which small tables are broadcast.
    """
    rows = packed(pages)
    address = F.col("row").getField(url).cast("string")
    split = rows.select("row", host_of(address).alias("host"), path_of(address).alias("path"))
    ruled = split.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("found"))
    verdicts = cut(host_verdicts(ruled.select("host", F.col("found.verdict").alias("verdict")), links(pages, url, html)))
    verdicts = verdicts.withColumnRenamed("host", "of")
    zero = F.lit(0.0)
    return ruled.join(small(verdicts, BROADCAST_HOSTS), F.col("host") == F.col("of"), "left").select(
        "row", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), F.col("host_verdict"), F.lit("allow")).alias("verdict"),
        F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"),
    )


def keep(pages: DataFrame, rules=RULES, url: str = "url", html: str = "html") -> DataFrame:
    """The rows of `pages`, in their own columns, that aren't blocked.

    A null url has an empty host and path and is judged as such, a null html has no links, repeated rows are judged alike,
    an empty table gives an empty table, and columns of any name stay the caller's."""
    return judge(pages, rules, url, html).where("verdict = 'allow'").select(*[F.col("row").getField(c).alias(c) for c in pages.columns])
