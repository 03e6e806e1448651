"""Seeds and the lists they are discovered from: JSON, site maps, ranked domains, stories, certificates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import urls

_SEED = "struct<url:string,depth:int,priority:string,scope:string,sitemap:boolean>"


def seeds(raw: DataFrame, column: str = "raw") -> DataFrame:
    """(url, depth, priority, scope, sitemap) of JSON seeds, each a plain address or an object with defaults; bad ones are left out."""
    parsed = raw.select(F.trim(F.col(column)).alias("raw")).withColumn("o", F.from_json("raw", _SEED))
    plain = F.when(F.col("raw").startswith('"'), F.from_json(F.concat(F.lit("["), F.col("raw"), F.lit("]")), "array<string>")[0])
    out = parsed.select(F.coalesce("o.url", plain).alias("url"), F.coalesce("o.depth", F.lit(3)).alias("depth"), F.coalesce(F.lower("o.priority"), F.lit("normal")).alias("priority"),
                        F.coalesce(F.lower("o.scope"), F.lit("any")).alias("scope"), F.coalesce("o.sitemap", F.lit(False)).alias("sitemap"))
    return out.where("url is not null")


def by_priority(rows: DataFrame, position: str) -> DataFrame:
    """High before normal before low; equal ones keep their position."""
    rank = F.when(F.col("priority") == "high", 2).when(F.col("priority") == "normal", 1).otherwise(0)
    return rows.orderBy(rank.desc(), position)


def first_per_url(rows: DataFrame, position: str) -> DataFrame:
    """Union of sources with one row per address, the first."""
    columns = [c for c in rows.columns if c != "url"]
    return rows.groupBy("url").agg(F.min_by(F.struct(*columns), position).alias("r")).select("url", "r.*")


def sitemap_locations(maps: DataFrame, xml: str = "xml") -> DataFrame:
    """``maps`` with ``loc``, a row for each address of a site map, and ``is_index`` for maps of maps."""
    found = F.regexp_extract_all(F.col(xml), F.lit(r"<loc>\s*(https?://[^<\s]+)\s*</loc>"), F.lit(1))
    return maps.withColumn("is_index", F.col(xml).contains("<sitemapindex")).withColumn("loc", F.explode(found)).drop(xml)


def ranked_domains(lines: DataFrame, existing: DataFrame, limit: int, column: str = "value") -> DataFrame:
    """(domain, rank, score, depth, scope, priority): the best new domains of ``rank,domain`` lines; bad lines are left out."""
    parts = F.split(F.trim(F.col(column)), ",", 2)
    rows = lines.select(F.try_to_number(F.get(parts, F.lit(0)), F.lit("9999999999")).cast("long").alias("rank"), F.lower(F.trim(F.get(parts, F.lit(1)))).alias("domain"))
    rows = rows.where("rank is not null and domain is not null and domain <> ''").where(~urls.is_junk_domain(F.col("domain")))
    known = existing.select(F.regexp_replace(F.lower("domain"), r"^www\.", "").alias("__bare"))
    rows = rows.withColumn("__bare", F.regexp_replace("domain", r"^www\.", "")).join(known, "__bare", "left_anti").drop("__bare")
    d, r = F.col("domain"), F.col("rank")
    return (rows.select("domain", "rank", urls.domain_score(d, r).alias("score"), urls.domain_depth(d, r).alias("depth"),
                        urls.domain_crawl_scope(d).alias("scope"), urls.rank_priority(r).alias("priority"))
            .orderBy(F.col("score").desc(), "domain").limit(limit))


def certificate_domains(entries: DataFrame, existing: DataFrame, limit: int) -> DataFrame:
    """(domain, n, score) of certificate entries (name_value, common_name): richness times the root of the count."""
    names = F.concat(F.split(F.coalesce("name_value", F.lit("")), "\n"), F.array(F.coalesce("common_name", F.lit(""))))
    rows = entries.select(F.explode(names).alias("domain")).withColumn("domain", F.regexp_replace(F.lower(F.trim("domain")), r"^(\*\.)?(www\.)?", ""))
    rows = rows.where(F.col("domain").contains(".")).where(~urls.is_junk_domain(F.col("domain")))
    rows = rows.join(existing.select(F.regexp_replace(F.lower("domain"), r"^www\.", "").alias("domain")), "domain", "left_anti")
    counted = rows.groupBy("domain").agg(F.count("*").alias("n"))
    return (counted.withColumn("score", urls.richness(F.col("domain")) * F.sqrt("n")).orderBy(F.col("score").desc(), "domain").limit(limit))


def story_domains(stories: DataFrame, existing: DataFrame, limit: int) -> DataFrame:
    """(domain, n, url) of stories (pos, url): how many, and the first one's address."""
    rows = stories.withColumn("domain", urls.bare_host(F.col("url"))).where("domain is not null")
    rows = rows.where(~urls.is_junk_domain(F.col("domain")))
    rows = rows.join(existing.select(F.regexp_replace(F.lower("domain"), r"^www\.", "").alias("domain")), "domain", "left_anti")
    return (rows.groupBy("domain").agg(F.count("*").alias("n"), F.min_by("url", "pos").alias("url")).orderBy(F.col("n").desc(), "domain").limit(limit))


def story_ids(lists: DataFrame, limit: int = 500) -> DataFrame:
    """(id): the ``limit`` smallest ids of JSON lists of ids (column ``json``), each once."""
    return lists.select(F.explode(F.from_json("json", "array<long>")).alias("id")).where("id is not null").distinct().orderBy("id").limit(limit)


def append_seed(table: DataFrame, added: DataFrame) -> DataFrame:
    """Seeds with those of ``added`` whose address isn't there yet."""
    return table.unionByName(added.join(table.select("url"), "url", "left_anti").select(*table.columns))


def remove_seed(table: DataFrame, url: str) -> DataFrame:
    return table.where(F.col("url") != url)


def first_icon(docs: DataFrame, position: str) -> DataFrame:
    """(domain, favicon_url): the first icon of each domain."""
    return docs.where("favicon_url is not null").groupBy("domain").agg(F.min_by("favicon_url", position).alias("favicon_url"))
