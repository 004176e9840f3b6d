"""URL verdicts: written rules first, then trust and distrust spread over the link graph of hosts.

Trust is a personalised PageRank that starts at hosts whose pages the rules
allow; distrust is one over the reversed edges that starts at hosts whose pages
they block, so that a host which links to blocked ones is distrusted. A host's
seed is the share of its pages that the rules allow, or block. A host whose
distrust exceeds its trust by ``threshold`` is blocked.

Edges are counted per pair of hosts before anything is shuffled by host; from
there on rows are hosts and edges, not pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm.tables import cut

Rules = list[tuple[str, str]]  # (verdict, rule), a rule being host/path
LINK = r"""(?is)<a\s[^>]*?\bhref\s*=\s*["']?\s*([^"'\s>]*)"""  # quoted or not; up to a space, as hosts have none


AT_ONCE = 3  # rounds from one checkpoint to the next


def _cased(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(_cased(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Rules) -> Column:
    """(rule, verdict) of the longest rule that fits: its host or a subdomain, and a path that starts with the rule's; else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: len(x[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def edges(pages: DataFrame) -> DataFrame:
    """(a, b, n): distinct hosts a and b, and how many links lead from pages of a to b. Relative links stay on their host."""
    targets = pages.select(
        host_of(F.col("url")).alias("a"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("href")
    )
    # a link without scheme but with a leading // names a host too
    full = F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href")).otherwise(F.trim("href"))
    named = targets.where(full.rlike(r"^(?i)https?://")).select("a", host_of(full).alias("b"))
    return named.where("a <> b AND a <> '' AND b <> ''").groupBy("a", "b").agg(F.count("*").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-4, rounds: int = 1000) -> DataFrame:
    """(host, rank) for rank = seed + damping * what the hosts that link to it pass on, by number of links.

    ``edges`` are (a, b, n), ``seeds`` (host, seed) with positive seeds. Goes on
    until what still moves, and all that it could add, is at most ``tolerance`` of
    the seeds; mass shrinks by ``damping`` at least in each round, so that this
    takes log(tolerance * (1 - damping)) / log(damping) rounds at most, 69 by
    default. An error if that is not reached within ``rounds``. Hosts that nothing
    reaches are absent.
    """
    out = edges.groupBy(F.col("a").alias("of")).agg(F.sum("n").alias("out"))
    share = cut(edges.join(out, F.col("a") == F.col("of")).select("a", "b", (F.col("n") / F.col("out")).alias("part")))
    rank = seeds.select("host", F.col("seed").cast("double").alias("rank"), F.col("seed").cast("double").alias("moving"))
    total = seeds.agg(F.sum("seed")).first()[0] or 0.0
    for _ in range(0, rounds, AT_ONCE):
        for _ in range(AT_ONCE):
            passed = share.join(rank.where("moving > 0"), F.col("a") == F.col("host"))
            passed = passed.select(F.col("b").alias("host"), F.lit(0.0).alias("rank"), (F.col("moving") * F.col("part") * damping).alias("moving"))
            every = rank.select("host", "rank", F.lit(0.0).alias("moving")).unionByName(passed).groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("moving").alias("moving"))
            rank = every.select("host", (F.col("rank") + F.col("moving")).alias("rank"), "moving")
        rank = cut(rank)
        left = rank.agg(F.sum("moving")).first()[0] or 0.0
        if left * damping <= tolerance * (1 - damping) * total:
            return rank.select("host", "rank")
    raise RuntimeError(f"ranks did not settle in {rounds} rounds")


def judge(pages: DataFrame, rules: Rules, threshold: float = 0.5, damping: float = 0.85, tolerance: float = 1e-4, salts: int = 64, broadcast_rows: int = 100_000) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), one row per input row.

    The verdict is that of the longest rule that fits, else its host's. Pages
    whose url is null or has no ``://`` have an empty host, which is in no graph
    and allowed. Repeated rows are judged alike, and each counts in its host's
    share. A null html has no links. Other columns are ignored.

    Scores come to pages by host. Only hosts with a score are joined: broadcast up
    to ``broadcast_rows`` of them, beyond that as ``salts`` copies each, among which
    the pages of a host are dealt out, so that no host's pages meet in one task.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), rule_of(host, path, rules).alias("by"))
    part = lambda verdict: F.avg(F.coalesce((F.col("by.verdict") == verdict).cast("double"), F.lit(0.0)))
    hosts = cut(judged.where("host <> ''").groupBy("host").agg(part("allow").alias("allowed"), part("block").alias("blocked")))
    graph = cut(edges(pages))
    trusted = hosts.where("allowed > 0").select("host", F.col("allowed").alias("seed"))
    suspect = hosts.where("blocked > 0").select("host", F.col("blocked").alias("seed"))
    trust = spread(graph, trusted, damping, tolerance).withColumnRenamed("rank", "trust")
    back = graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")
    distrust = spread(back, suspect, damping, tolerance).withColumnRenamed("rank", "distrust")
    scored = trust.withColumnRenamed("host", "of").join(distrust.withColumnRenamed("host", "of"), "of", "full")
    scored = cut(scored.select("of", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
    own = F.when(F.col("distrust") - F.col("trust") >= threshold, "block").otherwise("allow")
    if scored.count() <= broadcast_rows:
        joined = judged.join(F.broadcast(scored), F.col("host") == F.col("of"), "left")
    else:
        copies = scored.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        dealt = judged.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int"))
        joined = dealt.join(copies, (F.col("host") == F.col("of")) & (F.col("salt") == F.col("copy")), "left")
    return joined.select(
        "page_id",
        "host",
        "path",
        F.col("by.rule").alias("rule"),
        F.coalesce(F.col("by.verdict"), own).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
