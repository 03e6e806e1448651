"""Queries of the training-data operators and their equivalents in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A public byte-level BPE vocabulary; only its path is used.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.lines import SourceLineIndex

    index = SourceLineIndex(spark)
    index.merge(_read(spark, sf_dir, "crawled_docs"))
    return index.occurrences()


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.lines import SourceLineIndex

    docs, index = _read(spark, sf_dir, "crawled_docs").select("fetch_no", "domain", "body"), SourceLineIndex(spark)
    index.merge(docs)
    return index.clean(docs).select("fetch_no", "body")


def p1_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned bodies after four deltas in order of arrival, each rebuilding only what its threshold crossings changed."""
    from tidemark.llm.lines import SourceLineIndex
    from tidemark.session import materialize

    docs, index, built = _read(spark, sf_dir, "crawled_docs").select("fetch_no", "domain", "body"), SourceLineIndex(spark), None
    low, high = docs.select(F.min("fetch_no"), F.max("fetch_no")).first()
    edges = [] if low is None else [low + (high - low) * k // 4 for k in (1, 2, 3)]
    for start, end in zip([None, *edges], [*edges, None]):
        until = docs if end is None else docs.where(F.col("fetch_no") < end)
        changed = materialize(index.merge(until if start is None else until.where(F.col("fetch_no") >= start)), "changed")
        built = materialize(index.rebuild(until, built, changed), "built")
    return built.select("fetch_no", "body")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mainbody import MainBody

    return MainBody().lines(_read(spark, sf_dir, "raw_pages"))


def p2_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mainbody import MainBody

    return MainBody().bodies(_read(spark, sf_dir, "raw_pages"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.neighbours import VantagePointNeighbours

    near = VantagePointNeighbours().neighbours(_read(spark, sf_dir, "vec_records"))
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.history import History

    # Every batch is checked against all that were accepted before it; a null number comes first.
    docs = _read(spark, sf_dir, "batch_docs")
    history, found = History(spark), None
    for (batch,) in docs.select("batch_no").distinct().orderBy("batch_no").collect():  # the batches' numbers
        part = history.append(docs.where(F.col("batch_no").eqNullSafe(batch)))
        found = part if found is None else found.unionByName(part)
    return found if found is not None else history.append(docs)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.residue import ResidueFinder

    return ResidueFinder().find(_read(spark, sf_dir, "crawled_docs"), _read(spark, sf_dir, "raw_pages")).select("fetch_no")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_ranking(spark, sf_dir).where("place <= 5").select("query_id", "doc_id")


def p6_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.leximin import leximin_ranking

    return leximin_ranking(_read(spark, sf_dir, "ranked_lists"), _read(spark, sf_dir, "score_lists")).select("query_id", "doc_id", "place")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language import LanguageLabeller

    return LanguageLabeller().missing(_read(spark, sf_dir, "crawled_docs"))


def p7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language import LanguageLabeller

    return LanguageLabeller().segments(_read(spark, sf_dir, "crawled_docs"))


def p7_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language import LanguageLabeller

    return LanguageLabeller().labels(_read(spark, sf_dir, "crawled_docs"))


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.leaks import LeakFinder

    return LeakFinder().find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.leaks import LeakFinder

    found = LeakFinder().find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items"))
    return found.where("run >= 10").select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_shares(spark, sf_dir).where("short").select("source")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import SourceMixer

    report, _, _ = SourceMixer(VOCABULARY).plan(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "mix_targets"))
    return report


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import SourceMixer

    return SourceMixer(VOCABULARY).mix(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.spam import SpamFinder

    return SpamFinder().find(_read(spark, sf_dir, "documents")).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found, "p1_clean": p1_clean, "p1_rebuilt": p1_rebuilt, "p2_found": p2_found, "p2_bodies": p2_bodies, "p3_found": p3_found,
        "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p6_ranking": p6_ranking, "p7_found": p7_found,
        "p7_segments": p7_segments, "p7_labels": p7_labels, "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_found": p9_found,
        "p9_shares": p9_shares, "p9_mix": p9_mix, "p10_found": p10_found,
    }


_LINES = r"""
with cut as (
  select fetch_no, domain, body, string_split(body, chr(10)) as lines from crawled_docs where body is not null),
lines as (
  select fetch_no, coalesce(domain, chr(0)) as source, unnest(range(len(lines))) as line_no, unnest(lines) as line from cut),
keyed as (
  select fetch_no, source, line_no,
    trim(regexp_replace(regexp_replace(lower(line), '\p{Nd}+', '0', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')) as key from lines),
sizes as (select coalesce(domain, chr(0)) as source, count(distinct fetch_no) as n from crawled_docs group by 1),
counts as (select source, key, count(distinct fetch_no) as n from keyed where key <> '' group by 1, 2),
flagged as (select c.source, c.key from counts c join sizes s using (source) where c.n >= 4 and c.n >= 0.1 * s.n),
hits as (select distinct k.fetch_no, k.line_no from keyed k join flagged f using (source, key))
"""

_CLEAN = _LINES + """, gone as (select fetch_no, list(line_no) as gone from hits group by 1)
select c.fetch_no, case when g.gone is null then c.body else array_to_string(
  list_transform(list_filter(range(len(c.lines)), lambda i: not list_contains(g.gone, i)), lambda i: c.lines[i + 1]), chr(10)) end as body
from cut c left join gone g using (fetch_no)"""

_PLACES = """
with best as (
  select query_id, list_no, doc_id, max(case when coalesce(higher_is_better, true) then score::double else -score::double end) as s
  from ranked_lists left join score_lists using (list_no)
  where score is not null and not isnan(score) and query_id is not null and doc_id is not null group by 1, 2, 3),
placed as (
  select *, rank() over (partition by query_id, list_no order by s desc) as place,
    count(*) over (partition by query_id, list_no) as n from best),
lists as (select query_id, count(distinct list_no) as lists from best group by 1),
own as (select query_id, doc_id, list_sort(list((n - place + 1) / n)) as own from placed group by 1, 2),
full_own as (
  select query_id, doc_id, list_concat(list_transform(range(lists - len(own)), lambda x: 0.0::double), own) as percentiles
  from own join lists using (query_id)),
ranked as (select query_id, doc_id, row_number() over (partition by query_id order by percentiles desc, doc_id) as place from full_own)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _LINES + "select fetch_no, line_no::int as line_no from hits",
        "p1_clean": _CLEAN,
        "p1_rebuilt": _CLEAN,
        "p3_found": """
with valid as (
  select doc_id, list_transform(arg_min(embedding, rec_no), lambda x: x::double) as v from vec_records
  where embedding is not null and len(embedding) = 128 and list_sum(list_transform(embedding, lambda x: x * x)) > 0 group by 1),
unit as (select doc_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from valid),
near as (
  select a.doc_id as a, b.doc_id as b,
    row_number() over (partition by a.doc_id order by list_dot_product(a.v, b.v) desc, b.doc_id) as place
  from unit a join unit b on a.doc_id <> b.doc_id)
select distinct least(a, b) as id_a, greatest(a, b) as id_b from near where place <= 5""",
        "p4_found": r"""
with words as (
  select arrival_no, regexp_extract_all(lower(body), '[\p{L}\p{N}]+') as w from batch_docs where body is not null),
runs as (
  select distinct arrival_no, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as run
  from (select arrival_no, w, unnest(range(1, len(w) - 1)) as i from words)),
sizes as (select arrival_no, count(*) as n from runs group by 1),
common as (
  select a.arrival_no as x, b.arrival_no as q, count(*) as c from runs a join runs b using (run) where a.arrival_no < b.arrival_no group by 1, 2)
select min(x) as first_no, q as arrival_no from common join sizes s on s.arrival_no = x join sizes t on t.arrival_no = q
where c >= 0.7 * (s.n + t.n - c) group by q""",
        "p6_ranking": _PLACES + "select query_id, doc_id, place::int as place from ranked",
        "p6_found": _PLACES + "select query_id, doc_id from ranked where place <= 5",
        "p8_found": r"""
with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents),
i as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_items),
ig as (select distinct item_id, array_to_string(list_slice(w, k, k + 9), ' ') as g
  from (select item_id, w, unnest(range(1, len(w) - 8)) as k from i)),
dg as (select distinct doc_id, array_to_string(list_slice(w, k, k + 9), ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) - 8)) as k from d))
select distinct doc_id, item_id from dg join ig using (g)""",
        # No source is close to its target, so characters stand for tokens.
        "p9_found": """
with d as (select lower(trim(regexp_replace(source, '[\\s ]+', ' ', 'g'))) as source, length(text) as n from documents),
s as (select source, sum(n) as n from d group by 1)
select m.source from mix_targets m left join s using (source)
where coalesce(s.n, 0) * m.max_repeats < m.target_share * (select sum(n) from d)""",
    }
