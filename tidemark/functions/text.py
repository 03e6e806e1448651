"""Text analysis as column expressions: tokens, stems, quality, admission, snippets, highlights."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import fixed

_SPACE = r"[\p{IsWhite_Space}]+"


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def words(text: Column) -> Column:
    """White-space separated words; none for null or blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def raw_tokens(text: Column) -> Column:
    """Runs of letters, digits and apostrophes in lower case, before they are trimmed and chosen."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}']+"), F.lit(0))


def token(raw: Column) -> Column:
    """A token without apostrophes at its ends."""
    return F.btrim(raw, F.lit("'"))


def is_term(found: Column) -> Column:
    """Whether the index takes a token: 2 to 40 bytes, no stop word (one look-up in a set)."""
    low, high = fixed.TOKEN_BYTES
    return F.octet_length(found).between(low, high) & ~found.isin(fixed.STOP_WORDS)


def tokens(text: Column) -> Column:
    """Index tokens before stemming: lower case, runs of letters, digits and apostrophes, 2 to 40 bytes, no stop words."""
    return F.filter(F.transform(raw_tokens(text), token), is_term)


def legacy_stem(word: Column) -> Column:
    """The first of the endings -ing, -ed, -ly, -s (not -ss) that leaves two bytes or more."""
    size = F.octet_length(word)

    def cut(ending: str, longer_than: int) -> Column:
        return word.endswith(ending) & (size > longer_than) & (size - len(ending) >= 2)

    def left(n: int) -> Column:
        return F.substring(word, F.lit(1), F.length(word) - n)

    return (F.when(cut("ing", 4), left(3)).when(cut("ed", 3), left(2)).when(cut("ly", 3), left(2))
            .when(cut("s", 2) & ~word.endswith("ss"), left(1)).otherwise(word))


def quality(body: Column) -> Column:
    """0 to 1: unique words, words in sentences of seven or more, paragraphs of twenty or more; 0 under 15 words."""
    all_words = words(body)
    n = F.size(all_words)
    unique = (F.size(F.array_distinct(F.transform(all_words, F.lower))) / n).cast("float")
    sizes = F.transform(F.split(body, "[.!?]"), lambda s: F.size(words(s)))
    in_sentences = (F.aggregate(F.filter(sizes, lambda k: k >= 7), F.lit(0), lambda a, k: a + k) / n).cast("float")
    long_ones = F.size(F.filter(F.split(body, "\n\n"), lambda p: F.size(words(p)) >= 20))
    share = F.least(long_ones / F.lit(3.0), F.lit(1.0)).cast("float")
    score = unique * F.lit(0.3) + in_sentences * F.lit(0.4) + share * F.lit(0.3)
    return F.when(n < 15, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def admitted(title: Column, body: Column) -> Column:
    """Whether the index takes a document: enough words, not all the same, a sentence, more than its title."""
    all_words = words(body)
    n = F.size(all_words)
    title = F.coalesce(title, F.lit(""))
    unique = F.size(F.array_distinct(F.transform(all_words, F.lower))) / n
    sentences = F.size(F.filter(F.split(F.coalesce(body, F.lit("")), "[.!?]"), lambda s: F.size(words(s)) >= 5))
    title_words = F.array_distinct(words(F.lower(title)))
    overlap = F.size(F.array_intersect(title_words, words(F.lower(body)))) / F.size(title_words)
    rejected = ((n < 15) | ((title == "") & (F.octet_length(F.coalesce(body, F.lit(""))) < 100)) | (unique < 0.25) | ((sentences == 0) & (n < 80))
                | F.when(F.size(title_words) > 0, (overlap > 0.8) & (n < 40)).otherwise(F.lit(False)))
    return ~F.coalesce(rejected, F.lit(False))


def title_bonus(title: Column, originals: list[str], raw_query: str, base: Column) -> Column:
    """What a title that holds the query, or its tokens, adds to a base score."""
    low, query = F.lower(F.coalesce(title, F.lit(""))), raw_query.strip().lower()
    wide, narrow = F.greatest(base, F.lit(0.1)), F.greatest(base, F.lit(0.01))
    hits = sum((low.contains(t).cast("int") for t in originals), F.lit(0))
    by_token = 0.35 * narrow * hits + F.when((hits == len(originals)) & (F.lit(len(originals)) > 0), 0.15 * narrow).otherwise(0.0)
    if len(query.encode()) < 3:
        return by_token
    return F.when(low.contains(query), 0.50 * wide + F.when(low.startswith(query), 0.20 * wide).otherwise(0.0)).otherwise(by_token)


def preview(body: Column, n: int = 1000) -> Column:
    return F.substring(body, 1, n)


def embed_text(title: Column, description: Column, headings: Column, body: Column) -> Column:
    """What an encoder gets: title, description if any, headings, the first 512 characters."""
    parts = F.concat(F.array(F.coalesce(title, F.lit(""))), F.when(description.isNull(), F.array().cast("array<string>")).otherwise(F.array(description)),
                     F.coalesce(headings, F.array().cast("array<string>")), F.array(F.substring(F.coalesce(body, F.lit("")), 1, 512)))
    return F.array_join(parts, " ")


def _edge(data: bytes, at: int) -> int:
    """The first place from ``at`` on where a character begins."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(data))


def best_window(body: str | None, terms: list[str], originals: list[str] | None = None, size: int = 300, step: int = 25) -> str:
    """The first best window of ``size`` bytes every ``step``, cut at blanks, with the originals marked; dots mark what is left out.

    A window scores one point for each term (stems and originals) it holds and one more if it holds it
    twice. Windows are counted in UTF-8 bytes and begin and end with whole characters.
    """
    if not body:
        return ""
    wanted = [t.lower().encode() for t in [*terms, *(originals or [])] if t]
    data, low = body.encode(), body.lower().encode()
    best, start, at = 0, 0, 0
    while at < len(data):
        window = low[at : _edge(data, at + size)]
        points = sum((n > 0) + (n > 1) for n in map(window.count, wanted))
        if points > best:
            best, start = points, at
        if points == len(wanted):
            break
        at = _edge(data, at + step)
    end = _edge(data, start + size)
    shown = data[start:end].decode()
    if start > 0 and not data[start - 1 : start].isspace():
        cut = re.search(r"\s", shown)
        shown = shown[cut.end() :] if cut else shown
    if end < len(data) and not data[end : end + 1].isspace():
        cut = re.search(r"\s\S*\Z", shown)
        shown = shown[: cut.start()] if cut else shown
    left, right = start > 0, end < len(data)
    shown = shown.lstrip() if left else shown
    shown = shown.rstrip() if right else shown
    return mark(f"{'…' if left else ''}{shown}{'…' if right else ''}", originals if originals is not None else [])


def mark(text: str | None, tokens: list[str]) -> str | None:
    """Every occurrence of any token marked, case kept; marks that overlap or touch are one. One pass a token."""
    if not text:
        return text
    low, spans = text.lower(), []
    if len(low) != len(text):  # a letter whose lower case is longer: compare letter by letter
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for token_ in dict.fromkeys(t.lower() for t in tokens if t):
        at = low.find(token_)
        while at >= 0:
            spans.append((at, at + len(token_)))
            at = low.find(token_, at + len(token_))
    out, cursor = [], 0
    merged: list[list[int]] = []
    for first, last in sorted(spans):
        if merged and first <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], last)
        else:
            merged.append([first, last])
    for first, last in merged:
        out += [text[cursor:first], "<mark>", text[first:last], "</mark>"]
        cursor = last
    return "".join([*out, text[cursor:]])


def snippet(body: Column, terms: list[str], originals: list[str] | None = None, size: int = 300, step: int = 25) -> Column:
    """``best_window`` of whole texts of any script, in Arrow batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: best_window(text, terms, originals, size, step))

    return run(body)


def highlight(text: Column, token: str) -> Column:
    """Every occurrence of one token marked, case kept."""
    quoted = "".join("\\" + c if not c.isalnum() else c for c in token)
    return F.regexp_replace(text, f"(?i)((?:{quoted})+)", "<mark>$1</mark>")


def highlight_all(text: Column, tokens: list[str]) -> Column:
    """``mark`` of whole texts, in Arrow batches: overlaps can't be told by one pattern."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda value: mark(value, tokens))

    return run(text)


def stop_word_language(body: Column) -> Column:
    """A language by votes of its commonest words in the first 500 characters, ``und`` without a vote, null for blank text.

    It stands in for a detector of letter triples where a page states no language.
    """
    # Some of the commonest words of each language.
    common = {
        "en": "the and of to is that with for", "de": "der die und das nicht ist mit den", "fr": "le les et des est dans une que",
        "es": "el los y las es una con por", "pt": "o os e uma com não para do", "nl": "het een van en niet met voor zijn", "it": "il di che è per gli con della",
    }
    found = words(F.lower(F.substring(body, 1, 500)))
    votes = F.array(*[F.struct(F.size(F.filter(found, _among(text.split()))).alias("n"), F.lit(code).alias("code")) for code, text in sorted(common.items(), reverse=True)])
    best = F.array_max(votes)
    return F.when(F.size(found) == 0, F.lit(None)).when(best["n"] == 0, "und").otherwise(best["code"])


def _among(words_: list[str]):
    return lambda word: word.isin(words_)
