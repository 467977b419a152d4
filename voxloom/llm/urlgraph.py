"""URL filters: rules by host and path, and trust that spreads over the graph of hosts.

Edges are counted between hosts: the host of a page to each host that its
absolute links name, and a host to the nearest host above it among the pages
(and back). Trust is a personalised PageRank from the hosts whose pages the
rules allow; distrust runs over the reversed edges from the hosts whose pages
the rules block, since a page that links to a blocked one is suspect. The same
walk from all pages tells how much distrust a host would have if every page were
blocked; the quotient is the share of blocked pages around a host. A host is
blocked if that share reaches the threshold and exceeds the like share of
allowed pages. The graph has one row for each pair of hosts; rank tables have
one for each host, and a hub's neighbours are combined before the shuffle. Up to
BROADCAST_HOSTS hosts (about 80 bytes each) the ranks are sent to the edges, so
that a hub's edges stay spread out; beyond, they meet by a shuffled join.

Walks go on until the ranks that are still to move are at most ``tolerance`` of
all, or for ``most_rounds`` rounds. A host without edges out keeps what reaches it: sending
its rank back to the seeds would scale all ranks of a walk by one number, another
for each walk, and the quotient of two walks would no longer be a share.

Defined results: a null url, or one without ://, has an empty host and path; an
empty host fits no rule, is in no graph and is allowed. Null html has no links.
Repeated pages weigh as often as they occur. A host without either rank is
allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import checkpointed

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Hosts whose ranks may be sent to all executors.
BROADCAST_HOSTS = 100_000
#: Rounds between two checkpoints, and between two tests of convergence.
ROUNDS_A_JOB = 4
_HREF = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^\s/?#"'<>]+)"""


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).otherwise("")
    return F.translate(F.coalesce(rest, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, of_host, of_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(of_path)
        name, verdict = F.when(fits, of_host + of_path).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n) between different hosts."""
    own = pages.select(host_of(F.col(url)).alias("src"), F.col(html).alias("__html")).where("src <> ''")
    # Most pages name no other host: the cheap test comes before the pattern.
    linked = own.where("contains(__html, '//')").select("src", F.explode(F.array_distinct(F.regexp_extract_all("__html", F.lit(_HREF), F.lit(1)))).alias("dst"))
    links = linked.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    hosts = own.groupBy("src").agg(F.count("*").alias("pages"))
    above = hosts.select(F.col("src").alias("low"), "pages", F.posexplode(F.expr("transform(sequence(1, greatest(1, size(split(src, '[.]')) - 1)), i -> array_join(slice(split(src, '[.]'), i + 1, 1000), '.'))")).alias("depth", "high"))
    nearest = above.join(hosts.select(F.col("src").alias("high")), "high").groupBy("low").agg(F.min(F.struct("depth", "high")).alias("up"), F.max("pages").alias("n"))
    tree = nearest.select(F.col("low").alias("src"), F.col("up.high").alias("dst"), "n")
    both = links.unionByName(tree).unionByName(tree.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    return both.groupBy("src", "dst").agg(F.sum("n").alias("n"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, tolerance: float = 1e-3, most_rounds: int = 80) -> DataFrame:
    """(host, ranks of the seeds) of the walks from seeds (host, one column for each walk)."""
    walks = [c for c in seeds.columns if c != "host"]
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    step = checkpointed(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")))
    rank = before = start = checkpointed(seeds)
    hosts = step.select(F.col("dst").alias("host")).union(start.select("host")).distinct()
    few = hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    total = start.agg(F.sum(sum(F.abs(w) for w in walks))).first()[0] or 0.0
    for i in range(most_rounds):
        own = F.broadcast(rank) if few else rank
        moved = step.join(own, own["host"] == step["src"]).select(F.col("dst").alias("host"), *[(F.col(w) * F.col("share") * damping).alias(w) for w in walks])
        rank = moved.unionByName(start.select("host", *[(F.col(w) * (1 - damping)).alias(w) for w in walks])).groupBy("host").agg(*[F.sum(w).alias(w) for w in walks])
        if i % ROUNDS_A_JOB == ROUNDS_A_JOB - 1:
            rank = checkpointed(rank)
            change = rank.unionByName(before.select("host", *[(-F.col(w)).alias(w) for w in walks])).groupBy("host").agg(*[F.sum(w).alias(w) for w in walks])
            ahead = damping**ROUNDS_A_JOB / (1 - damping**ROUNDS_A_JOB)
            if (change.agg(F.sum(sum(F.abs(w) for w in walks))).first()[0] or 0.0) * ahead <= tolerance * total:
                break
            before = rank
    return rank


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, *, key: str = "page_id", url: str = "url", html: str = "html", threshold: float = 0.5, tolerance: float = 1e-3) -> DataFrame:
    """(key, host, path, rule, verdict, trust, distrust) of every row."""
    named = pages.select(key, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    named = named.select("*", rule.alias("rule"), said.alias("__said"))
    weight = lambda said: F.sum(F.when(F.col("__said") == said, 1.0).otherwise(0.0))
    seeds = checkpointed(named.where("host <> ''").groupBy("host").agg(weight("allow").alias("good"), weight("block").alias("bad"), F.count("*").cast("double").alias("every")))
    edges = checkpointed(host_edges(pages, url=url, html=html))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    trusted, suspected = personalised_rank(edges, seeds.select("host", "good", "every"), tolerance=tolerance), personalised_rank(back, seeds.select("host", "bad", "every"), tolerance=tolerance)
    ranks = trusted.select(F.col("host").alias("__host"), F.try_divide("good", "every").alias("trust")).join(suspected.select(F.col("host").alias("__host"), F.try_divide("bad", "every").alias("distrust")), "__host", "full")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    of_host = F.when((distrust >= threshold) & (distrust > trust), "block").otherwise("allow")
    joined = named.join(ranks, named["host"] == ranks["__host"], "left")
    return joined.select(key, "host", "path", "rule", F.coalesce("__said", of_host).alias("verdict"), "trust", "distrust")
