"""URL verdicts from rules and from link-graph propagation (operator 7).

Hosts are nodes. An edge leads from the host of a page to every other host that the
page links to, and from a host to its parent domain and back, since who runs a
domain runs its subdomains. Trust is personalised PageRank from hosts with allowed
pages; distrust is personalised PageRank over reversed edges from hosts with blocked
pages. A page that no rule fits gets its host's verdict, a threshold on both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Steps go on until ranks, which sum to 1, move by less than TOLERANCE in EVERY steps, after which they are written.
DAMPING, TOLERANCE, EVERY = 0.85, 1e-3, 8
#: Blocked where distrust is over this multiple of trust, by more than sums may round.
RATIO, MARGIN = 1.0, 1e-6
_LINK = r"""(?i)(?:href|src|action)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^\s"'<>]+)"""


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def linked_host(link: Column) -> Column:
    """The host of a link with a scheme, or that begins with "//" and takes its page's scheme."""
    return _lower(F.regexp_extract(link, r"(?s)^[^/?#]*//([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(at + start)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """(src, dst, weight) between different hosts; weights are counts of pages that link."""
    hosts = pages.select(host_of(F.col(f"`{url_col}`")).alias("host")).filter("host <> ''").distinct()
    # a host, and each domain above it down to two labels
    chain = hosts.select(F.split("host", r"\.").alias("p")).select(F.explode(F.expr("transform(sequence(1, greatest(1, size(p) - 1)), i -> array_join(slice(p, i, size(p) - i + 1), '.'))")).alias("host")).distinct()
    up = chain.filter("size(split(host, '[.]')) > 2").select(F.col("host").alias("src"), F.expr("substring(host, instr(host, '.') + 1)").alias("dst"))
    edges = up.union(up.select("dst", "src")).withColumn("weight", F.lit(1.0))
    if html_col:
        found = F.regexp_extract_all(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), F.lit(_LINK), F.lit(1))
        links = pages.select(host_of(F.col(f"`{url_col}`")).alias("src"), F.explode(F.array_distinct(F.transform(found, linked_host))).alias("dst"))
        edges = edges.union(links.filter("src <> '' and dst <> ''").withColumn("weight", F.lit(1.0)))
    return edges.filter("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def ranks(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, rank): for each kind, walks over its edges (kind, src, dst, weight) from its
    seeds (kind, host, weight), to which they return with chance 1 - damping.

    Each kind's ranks sum to 1: what reaches a host without edges returns to the seeds, too,
    which is the same as to divide by the sum in the end. All kinds take a step in one join.
    Steps stop at ``tolerance``; every ``EVERY`` steps the ranks are written to the shared folder.
    """
    sums = seeds.groupBy("kind").agg(F.sum("weight").alias("total")).filter("total > 0")
    start = seeds.groupBy("kind", "host").agg(F.sum("weight").alias("weight")).join(sums, "kind").select("kind", "host", (F.col("weight") / F.col("total")).alias("rank"))
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    steps = materialise(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share")), "steps")
    start = rank = materialise(start, "seeds")
    while True:
        before = rank
        for _ in range(EVERY):
            moved = steps.join(rank.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
            again = start.select("kind", "host", F.col("rank") * (1 - damping))
            rank = moved.union(again).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        rank = materialise(rank, "rank")
        moves = rank.union(before.select("kind", "host", -F.col("rank"))).groupBy("kind", "host").agg(F.sum("rank").alias("move"))
        change = moves.agg(F.sum(F.abs("move"))).first()[0] or 0.0
        if change < tolerance:
            total = rank.groupBy("kind").agg(F.sum("rank").alias("total"))
            return rank.join(F.broadcast(total), "kind").select("kind", "host", (F.col("rank") / F.col("total")).alias("rank"))


def judge_hosts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url", html_col: str | None = "html", ratio: float = RATIO) -> DataFrame:
    """(host, trust, distrust, verdict) for each host of ``pages`` and each host linked to.

    Seeds are weighted by their allowed or blocked pages. A host that neither kind of
    seed reaches is allowed.
    """
    url = F.col(f"`{url_col}`")
    known = pages.select(host_of(url).alias("host"), rule_of(host_of(url), path_of(url), rules)[1].alias("verdict")).filter("verdict is not null").groupBy("host", "verdict").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    known, edges = materialise(known, "known"), materialise(host_edges(pages, url_col, html_col), "edges")
    both = edges.withColumn("kind", F.lit("allow")).union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.lit("block").alias("kind")))
    found = ranks(both, known.withColumnRenamed("verdict", "kind"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    hosts = found.groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust"))
    return hosts.withColumn("verdict", F.when(F.col("distrust") > ratio * (1 + MARGIN) * F.col("trust"), "block").otherwise("allow"))


def judge_pages(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """One row for each row of ``pages``: the id, ``host``, ``path``, ``rule`` and ``verdict``.

    The longest rule that fits decides, else the host's verdict; a host that isn't in
    the graph is allowed, as is a url that is null or has no "://" (host and path
    empty). ``html_col`` None: domains alone make the edges. Ids may be null or
    repeat; repeated pages count each time; of equal trust and distrust a host is allowed;
    pages count whole, however long; other columns are not read, whatever their names. An
    empty table gives an empty table. Hosts' verdicts are joined on the
    host; the join of a hot host is split by adaptive execution or, as verdicts are
    few, broadcast by it.
    """
    url = F.col(f"`{url_col}`")
    judged = judge_hosts(pages, rules, url_col, html_col).select(F.col("host").alias("known_host"), F.col("verdict").alias("host_verdict"))
    own = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = own.select("*", name.alias("rule"), verdict.alias("own_verdict")).join(judged, F.col("host") == F.col("known_host"), "left")
    return own.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("own_verdict", "host_verdict", F.lit("allow")).alias("verdict"))
