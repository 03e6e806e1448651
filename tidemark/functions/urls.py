"""Addresses and domains as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import fixed


def any_of(words: list[str]) -> str:
    """A pattern that finds any of ``words`` as they stand."""
    return "|".join(re.sub(r"([.?+*()\[\]|^$\\{}])", r"\\\1", w) for w in words)


def host(url: Column) -> Column:
    """Host without port of an http(s) address, null for others; the scheme is compared as written."""
    return F.when(url.rlike("^https?://"), F.regexp_extract(url, "^https?://([^/:]*)", 1))


def path(url: Column) -> Column:
    """From the first slash after the host on, query and fragment included; null for other schemes."""
    return F.when(url.rlike("^https?://"), F.regexp_extract(url, "^https?://[^/]*(/.*)?$", 1))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(host(url)), r"^www\.", "")


def domain_name(url: Column) -> Column:
    return F.substring_index(bare_host(url), ".", 1)


def _last_labels(name: Column, n: int) -> Column:
    return F.substring_index(name, ".", -n)


def root_domain(name: Column) -> Column:
    """Registered domain for ranking: two labels, three under a compound top-level domain, ``www.`` dropped."""
    bare = F.regexp_replace(name, r"^www\.", "")
    return F.when(_last_labels(bare, 2).isin(fixed.COMPOUND_TLDS), _last_labels(bare, 3)).otherwise(_last_labels(bare, 2))


def scope_domain(name: Column) -> Column:
    """Registered domain for crawl scopes: three labels under any of the usual second levels; ``www.`` stays."""
    labels = F.split(name, r"\.")
    second = F.element_at(F.slice(F.concat(F.array(F.lit(""), F.lit("")), labels), -2, 2), 1)
    return F.when(F.size(labels) <= 2, name).when(second.isin(fixed.SECOND_LEVELS), _last_labels(name, 3)).otherwise(_last_labels(name, 2))


def url_key(url: Column) -> Column:
    """What two addresses of one page share: no scheme, ``www.``, query, fragment or last slashes; lower case."""
    plain = F.regexp_replace(F.regexp_replace(url, "^https?://", ""), r"^www\.", "")
    return F.lower(F.regexp_replace(F.regexp_replace(plain, "[?#].*", ""), "/+$", ""))


def normal_link(url: Column) -> Column:
    """An indexed link: no fragment, lower-case scheme and host, default port and last slash dropped; null if not http(s)."""
    plain = F.regexp_replace(url, "#.*", "")
    scheme = F.lower(F.regexp_extract(plain, "^([A-Za-z]+)://", 1))
    authority = F.lower(F.regexp_extract(plain, "^[A-Za-z]+://([^/?]*)", 1))
    authority = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).otherwise(F.regexp_replace(authority, ":443$", ""))
    rest = F.regexp_extract(plain, "^[A-Za-z]+://[^/?]*(.*)$", 1)
    where, query = F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"(\?.*)$", 1)
    where = F.when(where == "", F.lit("/")).when(F.length(where) > 1, F.regexp_replace(where, "/+$", "")).otherwise(where)
    return F.when(scheme.isin("http", "https"), F.concat(scheme, F.lit("://"), authority, where, query))


def is_homepage(url: Column) -> Column:
    """Query and fragment don't matter here."""
    return F.coalesce(F.regexp_replace(path(url), "[?#].*", "").isin(fixed.HOME_PATHS), F.lit(False))


def is_junk(url: Column, title: Column) -> Column:
    where = F.lower(path(url))
    junk = (where.rlike(any_of(fixed.AUTH_PATHS + fixed.WIKI_PATHS + fixed.LISTING_PATHS)) | where.rlike(f"({any_of(fixed.JUNK_SUFFIXES)})$")
            | F.coalesce(title, F.lit("")).rlike(f"^({any_of(fixed.JUNK_TITLES)})"))
    return F.coalesce(junk, F.lit(False))


def is_profile(url: Column) -> Column:
    return F.coalesce(F.lower(path(url)).rlike(any_of(fixed.PROFILE_PATHS)), F.lit(False))


def is_error(title: Column) -> Column:
    return F.coalesce(F.lower(title).rlike(any_of(fixed.ERROR_TITLES)), F.lit(False))


def is_preferred(bare: Column) -> Column:
    return _last_labels(bare, 1).isin(fixed.PREFERRED_TLDS)


def is_brand(name: Column, bare: Column) -> Column:
    size = F.octet_length(name)
    letters = F.length(F.regexp_replace(name, "[^A-Za-z]", ""))
    return ((size <= 20) & ~(name.rlike("[0-9]") & (size < 4)) & ~name.rlike(any_of(fixed.INFRA_NAMES)) & is_preferred(bare)
            & (letters >= F.greatest(size - 1, F.lit(0))))


def should_skip(url: Column) -> Column:
    """Whether a crawl leaves the address out: a file by its extension, or a path without content."""
    low = F.lower(url)
    return F.split(low, r"\?")[0].rlike(f"({any_of(fixed.SKIP_EXTENSIONS)})$") | low.rlike(any_of(fixed.SKIP_FRAGMENTS))


def in_scope(link: Column, scope: Column, seed_host: Column) -> Column:
    """Crawl scope of a link. Same-origin compares with ``https`` on the seed's host, whatever its scheme."""
    same_origin = F.regexp_replace(F.lower(F.regexp_extract(link, "^([A-Za-z]+://[^/?#]*)", 1)), "^(https://.*):443$", "$1") == F.concat(F.lit("https://"), seed_host)
    return (F.when(scope == "any", F.lit(True)).when(scope == "same_domain", scope_domain(F.lower(host(link))) == scope_domain(seed_host))
            .when(scope == "same_origin", same_origin).otherwise(F.lit(False)))


def is_junk_domain(domain: Column) -> Column:
    name = F.substring_index(domain, ".", 1)
    labels = F.split(domain, r"\.")
    sub = F.when(F.size(labels) >= 3, F.array_join(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(1))), "."))
    infra = any_of(fixed.INFRA_KEYWORDS)
    return (domain.rlike(f"({any_of(fixed.JUNK_TLDS)})$") | domain.rlike(f"(^|\\.)({any_of(fixed.INFRA_SUFFIXES)})$") | name.rlike(infra)
            | F.coalesce(sub.rlike(infra), F.lit(False)) | ((F.octet_length(name) <= 2) & (F.octet_length(domain) <= 6)))


def richness(domain: Column) -> Column:
    name = F.substring_index(domain, ".", 1)
    tld = (F.when(domain.rlike(r"(\.edu|\.ac\.uk|\.edu\.au)$"), 3.0).when(domain.rlike(r"\.gov$"), 1.5).when(domain.rlike(r"\.org$"), 1.4)
           .when(domain.rlike(r"(\.io|\.dev|\.sh)$"), 1.3).otherwise(1.0))
    return (F.when(name.rlike(any_of(fixed.RICH_KEYWORDS)), 2.0).otherwise(1.0) * tld
            * F.when((F.octet_length(name) <= 12) & name.rlike("^[A-Za-z]*$"), 1.2).otherwise(1.0))


def domain_score(domain: Column, rank: Column) -> Column:
    return F.lit(1_000_000.0) / (rank + 100.0) * richness(domain)


def domain_depth(domain: Column, rank: Column) -> Column:
    return F.when((richness(domain) >= 2.0) | (rank <= 1000), 3).otherwise(2)


def domain_crawl_scope(domain: Column) -> Column:
    return F.when(domain.rlike(any_of(fixed.OPEN_SCOPE_WORDS)), "any").otherwise("same_domain")


def rank_priority(rank: Column) -> Column:
    return F.when(rank <= 500, "high").when(rank <= 5000, "normal").otherwise("low")


def file_name(domain: Column) -> Column:
    """``domain`` made safe for a file name."""
    return F.regexp_replace(domain, "[^A-Za-z0-9.-]", "_")
