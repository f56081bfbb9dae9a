"""Operator 1: URL filtering by trust and distrust over the host link graph.

Edges run from a page's host to the hosts its links name, weighted by the number
of pages that have the link; links within a host are none. A host also has an
edge to its parent domain where that is itself a host of a page, a link's target
or a seed ("www.a.org" to "a.org"). Trust is personalised PageRank from the
trusted seeds along the edges; distrust the same from the blocked seeds against
them, so a host that links to blocked ones inherits from them. Rounds go on
until all later ones together can change no score by ``REST``. A score is the sum over
all damped paths from the seeds, in units of a seed's own share; mass that reaches
a host without out-edges ends there, for either kind.

Ranks hold reached hosts only. Edges are partitioned by source once, those of a
hub by target too, in parts of about EDGES_PER_PART to which its rank is sent; a
round joins ranks to them where they are and shuffles only the contributions, summed
up per task. Lineage is cut by a table in the shared folder every few rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from ._store import dropped, staged
from .ngram_join import sized

DAMPING, CUT, REST = 0.85, 6, 1e-9
EDGES_PER_PART = 1_000_000
HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)"
HREF = r"""(?i)<a\s[^>]*href\s*=\s*["']?([^"'\s>]*)"""


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute or protocol-relative URL, else NULL."""
    h = F.lower(F.regexp_extract(F.trim(url), HOST, 1))
    h = F.regexp_replace(h, r"\.+$", "")
    return F.when(F.length(h) > 0, h)


def parent_of(host: Column) -> Column:
    """The host without its first label, NULL if fewer than two labels are left."""
    p = F.regexp_extract(host, r"^[^.]+\.(.+\..+)$", 1)
    return F.when(F.length(p) > 0, p)


def host_edges(pages: DataFrame, seeds: DataFrame) -> DataFrame:
    """(src, dst, n) of distinct hosts; ``pages`` has url and html, ``seeds`` host."""
    at = pages.select(host_of(F.col("url")).alias("src"), F.col("html")).where("src IS NOT NULL")
    links = at.where(F.col("html").isNotNull()).select("src", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(HREF), 1), host_of))).alias("dst"))
    links = links.where("dst IS NOT NULL AND dst <> src").groupBy("src", "dst").agg(F.count("*").alias("n"))
    nodes = at.select(F.col("src").alias("host")).union(links.select("dst")).union(seeds.select("host")).distinct()
    up = nodes.select(F.col("host").alias("src"), parent_of(F.col("host")).alias("dst")).join(nodes.withColumnRenamed("host", "dst"), "dst", "left_semi").select("src", "dst", F.lit(1).cast("long").alias("n"))
    return links.union(up).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(kind, host, v): kind ``trust`` along and ``distrust`` against the edges.

    ``seeds`` has kind and host. Returns (kind, host, v), a table in the shared folder; v
    is in units of a seed's own share: 1 for a seed that nothing points at.
    """
    spark = edges.sparkSession
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(edges.select(F.lit("distrust"), F.col("dst"), F.col("src"), "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("total"), F.ceil(F.count("*") / EDGES_PER_PART).cast("int").alias("parts"))
    out = staged(out, "host-degrees")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int").alias("part")
    table = staged(both.join(out, ["kind", "src"]).select("kind", "src", part, "dst", (F.col("n") / F.col("total")).alias("w")), "host-edges")
    held = table.repartition(parts, "kind", "src", "part").persist()  # rebuilt from the table if an executor is lost
    hubs = out.where("parts > 1").select("kind", "src", "parts")
    has_hubs = hubs.limit(1).count() > 0  # at most an EDGES_PER_PART-th of the edges
    own = seeds.select("kind", "host", F.lit(1.0).alias("v"))
    ranks, last, before, rest = own, None, float(seeds.count()), 1.0
    while rest > REST:
        for _ in range(CUT):
            sent = ranks.select("kind", F.col("host").alias("src"), "v")
            if has_hubs:
                sent = sent.join(hubs, ["kind", "src"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
            else:
                sent = sent.withColumn("part", F.lit(0))
            moved = sent.join(held, ["kind", "src", "part"]).select("kind", F.col("dst").alias("host"), (DAMPING * F.col("v") * F.col("w")).alias("v"))
            ranks = own.union(moved).groupBy("kind", "host").agg(F.sum("v").alias("v"))
        ranks = staged(ranks, "host-ranks")
        if last is not None:
            dropped(last)
        last = ranks
        # scores only grow, and what CUT rounds add is at most DAMPING ** CUT of what the CUT before them did
        now = float(ranks.agg(F.sum("v")).first()[0] or 0)
        before, rest = now, (now - before) * DAMPING**CUT / (1 - DAMPING**CUT)
    held.unpersist()
    dropped(table, out)
    return ranks


def filter_urls(pages: DataFrame, trusted: Sequence[str], blocked: Sequence[str], cut: float = 0.05) -> DataFrame:
    """(page_id, url, host, trust, distrust, keep) of every row of ``pages``.

    A host goes where its distrust reaches ``cut`` (of a blocked seed's own
    share) and exceeds its trust; all its pages go with it. NULL or hostless URLs
    have NULL host, scores 0 and are kept; NULL html has no links; repeated rows
    are each reported, and count once more as pages of a link. Seeds need not occur in ``pages``; a
    host that is a seed of both kinds is judged by its scores. Other columns are
    ignored. Hosts are compared in lower case without final dots.
    """
    spark = pages.sparkSession
    pages = spread(pages.select("page_id", "url", "html"))
    rows = [("trust", h.lower().rstrip(".")) for h in trusted] + [("distrust", h.lower().rstrip(".")) for h in blocked]
    seeds = spark.createDataFrame(sorted(set(rows)), "kind string, host string")
    ranks = propagate(host_edges(pages, seeds), seeds)
    hosts = ranks.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("v"))).alias(k) for k in ("trust", "distrust")])
    hosts = staged(hosts, "host-scores")
    dropped(ranks)
    at = pages.select("page_id", "url", host_of(F.col("url")).alias("host"))
    out = at.join(sized(hosts), "host", "left").select("page_id", "url", "host", *[F.round(F.coalesce(k, F.lit(0.0)), 6).alias(k) for k in ("trust", "distrust")])
    return out.withColumn("keep", ~((F.col("distrust") >= cut) & (F.col("distrust") > F.col("trust"))))
