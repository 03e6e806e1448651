"""How results are shown: addresses, numbers, cuts and the answer's envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import urls


def pretty_url(url: Column) -> Column:
    parts = F.filter(F.split(F.regexp_replace(F.coalesce(urls.path(url), F.lit("")), "[?#].*", ""), "/"), lambda x: x != "")
    return F.array_join(F.concat(F.array(urls.bare_host(url)), parts), " › ")


def cut(text: Column, n: int, at_word: bool = False) -> Column:
    """At most n characters and dots; ``at_word``: back to the last blank."""
    short = F.substring(text, 1, n)
    if at_word:
        short = F.regexp_replace(short, r"\s+\S*\z", "")
    return F.when(F.length(text) > n, F.concat(short, F.lit("…"))).otherwise(text)


def shown_title(title: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.lit("(untitled)"))


def percent(score: Column) -> Column:
    return F.least(F.lit(100), F.floor(100 * score + 0.5)).cast("int")


def human_bytes(n: Column) -> Column:
    value = n.cast("double")
    k = 1024.0
    return (F.when(value >= k**3, F.concat(F.format_string("%.2f", F.bround(value / k**3, 2)), F.lit(" GB"))).when(value >= k**2, F.concat(F.format_string("%.2f", F.bround(value / k**2, 2)), F.lit(" MB")))
            .when(value >= k, F.concat(F.format_string("%.2f", F.bround(value / k, 2)), F.lit(" KB"))).otherwise(F.concat(n.cast("long").cast("string"), F.lit(" B"))))


def content_type(start: Column) -> Column:
    """Kind of an icon by its first bytes, given as hexadecimal text."""
    return (F.when(start.startswith("89504E47"), "image/png").when(start.startswith("474946"), "image/gif").when(start.startswith("FFD8"), "image/jpeg")
            .when(start.startswith("3C737667") | start.startswith("3C3F786D6C"), "image/svg+xml")
            .when(start.startswith("52494646") & (F.substring(start, 17, 8) == "57454250") & (F.length(start) > 24), "image/webp").otherwise("image/x-icon"))


def envelope(title: Column, url: Column, snippet: Column, score: Column) -> Column:
    return F.to_json(F.struct(F.lit(True).alias("success"), F.struct(title.alias("title"), url.alias("url"), snippet.alias("snippet"), score.alias("score")).alias("data")))


def by_host(rows: DataFrame, position: str) -> DataFrame:
    """(host, n, first_id): results grouped by host; ``first_id`` gives the groups' order of appearance."""
    return rows.groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.min(position).alias("first_id"))
