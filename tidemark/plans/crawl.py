"""Crawl plans over tables: robots rules, frontier expansion, rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import urls
from tidemark.session import materialize


def robots_rules(lines: DataFrame, agent: str = "tidemark") -> DataFrame:
    """(domain, seq, allow, path, crawl_delay): the rules of robots files (domain, line_no, line) that hold for ``agent``.

    Each User-agent line starts the group anew; it matches ``*`` or a name that contains, or is
    contained in, the agent's. Rules without a path are ignored. A file is one site's, so windows
    over a domain are as small as its file.
    """
    clean = F.trim(F.regexp_replace("line", "#.*", ""))
    rows = lines.select("domain", "line_no", F.lower(F.trim(F.regexp_extract(clean, "^([^:]*):", 1))).alias("k"), F.trim(F.regexp_extract(clean, "^[^:]*:(.*)$", 1)).alias("v"))
    name = F.lower("v")
    mine = (F.col("v") == "*") | ((F.col("v") != "") & (name.contains(agent) | F.lit(agent).contains(name)))
    order = Window.partitionBy("domain").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("on", F.last(F.when(F.col("k") == "user-agent", mine), ignorenulls=True).over(order)).where("`on`")
    delays = rows.where("k = 'crawl-delay'").groupBy("domain").agg(F.max_by(F.expr("try_cast(v as int)"), "line_no").alias("crawl_delay"))
    rules = rows.where("k in ('allow', 'disallow') and v <> ''").select("domain", F.col("line_no").alias("seq"), (F.col("k") == "allow").alias("allow"), F.col("v").alias("path"))
    return rules.join(delays, "domain", "full")


def robots_allowed(links: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``links`` with ``allowed``: the longest matching path decides, the later of equal ones; no match allows.

    An equi-join on the domain, then the prefix test; the decision is a partial aggregate.
    """
    host, where = F.lower(urls.host(F.col(url))), F.regexp_replace(urls.path(F.col(url)), "[?#].*", "")
    where = F.when(F.coalesce(where, F.lit("")) == "", "/").otherwise(where)
    asked = links.select(url).distinct().withColumn("domain", host).withColumn("__p", where)
    hits = asked.join(rules.where("path is not null").select("domain", "seq", "allow", "path"), "domain").where(F.col("__p").startswith(F.col("path")))
    decided = hits.groupBy(url).agg(F.max_by("allow", F.struct(F.octet_length("path").alias("n"), "seq")).alias("allowed"))
    return links.join(decided, url, "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def frontier(seeds: DataFrame, graph: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(url, depth): pages that a crawl from ``seeds`` (url, depth_limit, scope) reaches over ``graph`` (src, dst), breadth first.

    Known pages aren't fetched again, but seeds are. Each round is one anti-join with what was seen;
    the seen set is written, so neither plans nor lineage grow. It goes on until no new page is in reach
    of a seed's depth limit.
    """
    level = (seeds.select(urls.normal_link(F.col("url")).alias("url"), F.col("depth_limit"), "scope").where("url is not null")
             .withColumn("seed_host", F.lower(urls.host(F.col("url")))).groupBy("url").agg(F.max(F.struct("depth_limit", "scope", "seed_host")).alias("s"))
             .select("url", "s.*", F.lit(0).alias("depth")))
    edges = graph.select(urls.normal_link(F.col("src")).alias("src"), urls.normal_link(F.col("dst")).alias("dst")).where("src is not null and dst is not null")
    seen, levels = materialize(level, "level"), []
    levels.append(seen)
    barred = known.select(urls.normal_link(F.col("url")).alias("dst")) if known is not None else None
    deepest = levels[0].agg(F.max("depth_limit")).first()[0] or 0
    for depth in range(1, deepest + 1):
        out = levels[-1].where(F.col("depth_limit") >= depth).join(edges, F.col("url") == F.col("src")).where(~urls.should_skip(F.col("dst")))
        out = out.where(urls.in_scope(F.col("dst"), F.col("scope"), F.col("seed_host")))
        if barred is not None:
            out = out.join(barred, "dst", "left_anti")
        visited = levels[0].select("url")
        for old in levels[1:]:
            visited = visited.unionByName(old.select("url"))
        fresh = (out.groupBy("dst").agg(F.max(F.struct("depth_limit", "scope", "seed_host")).alias("s")).withColumnRenamed("dst", "url")
                 .join(visited, "url", "left_anti").select("url", "s.*", F.lit(depth).alias("depth")))
        fresh = materialize(fresh, "level")
        if fresh.isEmpty():
            break
        levels.append(fresh)
    result = levels[0]
    for more in levels[1:]:
        result = result.unionByName(more)
    return result.select("url", "depth")


def within_rate(requests: DataFrame, limit: int, domain: str = "domain", at: str = "ts", unit: str = "second", order: str | None = None) -> DataFrame:
    """The first ``limit`` requests of each domain and ``unit`` of time; equal times follow ``order``."""
    place = Window.partitionBy(domain, F.date_trunc(unit, F.col(at))).orderBy(at, order or [c for c in requests.columns if c not in (domain, at)][0])
    return requests.withColumn("__n", F.row_number().over(place)).where(F.col("__n") <= limit).drop("__n")


def counters(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: pages crawled, documents fetched, different documents."""
    crawled = pages.agg(F.count("*").alias("crawled"))
    return docs.agg(F.count("*").alias("fetched"), F.count_distinct("id").alias("indexed")).crossJoin(F.broadcast(crawled))  # one row
