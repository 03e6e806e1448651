"""One query per operator over the test tables, with its equivalent in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import fixed, present, text, urls
from tidemark.operators import index as ix
from tidemark.operators import search as se
from tidemark.plans import crawl
from tidemark.sources import html, seeds
from tidemark.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Words in many and in some of the test documents.
PROBE = "harbour map archive index"
TITLE_PROBE = "the harbour map"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return keep


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.col("text").alias("body"))


def docs(spark: SparkSession, d: str) -> DataFrame:
    """The first fetch of each crawled document."""
    return ix.first_versions(read(spark, d, "crawled_docs"), "id", "fetch_no").withColumnRenamed("id", "doc_id")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "raw_pages").select("fetch_no", "url", "html", "domain", "headers").dropDuplicates(["fetch_no"])


def rounded(c: str | Column, n: int = 6) -> Column:
    return F.round(c, n)


# ---- the same things in SQL ------------------------------------------------------------------------


def _list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _re(words: list[str]) -> str:
    return urls.any_of(words).replace("'", "''")


_WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
_FIRST = "(select * from crawled_docs qualify row_number() over (partition by id order by fetch_no) = 1)"


def _tokens(column: str) -> str:
    low, high = fixed.TOKEN_BYTES
    return (rf"list_filter(list_transform(regexp_extract_all(lower(coalesce({column}, '')), '[\p{{L}}\p{{N}}'']+'), lambda t: trim(t, '''')), "
            f"lambda t: strlen(t) between {low} and {high} and t not in ({_list(fixed.STOP_WORDS)}))")


_POSTS = f"posts as (select doc_id, term, count(*) as tf from (select doc_id, unnest({_tokens('text')}) as term from documents) group by 1, 2)"
_LENS = "lens as (select doc_id, sum(tf) as doc_len from posts group by 1)"
_STATS = "stats as (select count(*) as n_docs, sum(doc_len) as total_len, avg(doc_len) as avg_len from lens)"


def _bm25(posts: str, terms: list[str], key: str = "doc_id") -> str:
    """``scored`` (key, score) over ``posts``."""
    bag = ", ".join(f"('{t}')" for t in terms) or "(null)"
    return f"""bag(term) as (values {bag}), df as (select term, count(*) as df from {posts} group by 1),
scored as (select p.{key}, sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * coalesce(doc_len, 1) / avg_len))) as score
  from bag join {posts} p using (term) join df using (term) left join lens using ({key}) cross join stats group by 1)"""


_HOST = "case when regexp_matches({0}, '^https?://') then regexp_extract({0}, '^https?://([^/:]*)', 1) end"
_PATH = "case when regexp_matches({0}, '^https?://') then regexp_extract({0}, '^https?://[^/]*(/.*)?$', 1) end"


def _sql_parts(table: str) -> str:
    return f"""parts as (select *, {_HOST.format('url')} as host, {_PATH.format('url')} as path,
  regexp_replace(lower({_HOST.format('url')}), '^www\\.', '') as bare, lower({_PATH.format('url')}) as low from {table})"""


# ---- index -----------------------------------------------------------------------------------------


@query("token_counts", f"select doc_id, len({_tokens('text')}) as n from documents")
def _(s, d):
    return texts(s, d).select("doc_id", F.size(text.tokens(F.col("body"))).alias("n"))


@query("tf_by_doc", f"with {_POSTS} select * from posts")
def _(s, d):
    return ix.postings(texts(s, d))


@query("doc_lengths", f"with {_POSTS}, {_LENS} select doc_id, doc_len::bigint as doc_len from lens")
def _(s, d):
    return ix.lengths(ix.postings(texts(s, d)))


@query("doc_freq", f"with {_POSTS} select term, count(*) as df from posts group by 1")
def _(s, d):
    return ix.doc_freq(ix.postings(texts(s, d)))


@query("corpus_stats", f"with {_POSTS}, {_LENS}, {_STATS} select n_docs, total_len::bigint as total_len, round(avg_len, 6) as avg_len from stats")
def _(s, d):
    return ix.corpus_stats(ix.lengths(ix.postings(texts(s, d)))).withColumn("avg_len", rounded("avg_len"))


@query("posting_lists", f"with {_POSTS} select term, (doc_id // 65536)::bigint as block, list_sort(list(doc_id)) as doc_ids from posts group by 1, 2")
def _(s, d):
    return ix.posting_lists(ix.postings(texts(s, d)))


def _legacy(w: str) -> str:
    return f"""case when {w} like '%ing' and strlen({w}) > 4 and strlen({w}) - 3 >= 2 then left({w}, length({w}) - 3)
  when {w} like '%ed' and strlen({w}) > 3 and strlen({w}) - 2 >= 2 then left({w}, length({w}) - 2)
  when {w} like '%ly' and strlen({w}) > 3 and strlen({w}) - 2 >= 2 then left({w}, length({w}) - 2)
  when {w} like '%s' and {w} not like '%ss' and strlen({w}) > 2 and strlen({w}) - 1 >= 2 then left({w}, length({w}) - 1) else {w} end"""


@query("legacy_stem_terms", f"with {_POSTS} select distinct term, {_legacy('term')} as stem from posts")
def _(s, d):
    return ix.postings(texts(s, d)).select("term").distinct().select("term", text.legacy_stem(F.col("term")).alias("stem"))


@query("snowball_terms")
def _(s, d):
    terms = ix.postings(texts(s, d)).select("term").distinct()
    return ix.stem_terms(terms).distinct()


_FIELDS = f"""fields as (
  select id as doc_id, title as t, 3 as w from {_FIRST} union all select id, array_to_string(headings, ' '), 2 from {_FIRST}
  union all select id, meta_description, 1 from {_FIRST} union all select id, body, 1 from {_FIRST}),
posts as (select doc_id, term, sum(w)::bigint as tf from (select doc_id, w, unnest({_tokens('t')}) as term from fields) group by 1, 2)"""


@query("field_weighted_tf", f"with {_FIELDS} select * from posts")
def _(s, d):
    return ix.postings(docs(s, d), fixed.FIELD_WEIGHTS)


@query("first_versions", f"select id as doc_id, fetch_no, url from {_FIRST}")
def _(s, d):
    return docs(s, d).select("doc_id", "fetch_no", "url")


@query("known_doc_antijoin", "select distinct c.id as doc_id from crawled_docs c where not exists (select 1 from raw_pages r where r.fetch_no = c.fetch_no)")
def _(s, d):
    return ix.unknown(read(s, d, "crawled_docs"), read(s, d, "raw_pages"), "fetch_no").select(F.col("id").alias("doc_id")).distinct()


@query("point_lookup", f"select id as doc_id, url, title, left(body, 1000) as preview from {_FIRST} where id = (select min(id) from crawled_docs)")
def _(s, d):
    first = read(s, d, "crawled_docs").agg(F.min("id").alias("doc_id"))
    return docs(s, d).join(F.broadcast(first), "doc_id").select("doc_id", "url", "title", text.preview(F.col("body")).alias("preview"))  # one row


@query("body_preview", "select fetch_no, left(body, 1000) as preview from crawled_docs")
def _(s, d):
    return read(s, d, "crawled_docs").select("fetch_no", text.preview(F.col("body")).alias("preview"))


@query("embed_text", """select fetch_no, array_to_string(list_concat(list_concat([coalesce(title, '')], case when meta_description is null then []::varchar[] else [meta_description] end),
  list_concat(coalesce(headings, []::varchar[]), [left(coalesce(body, ''), 512)])), ' ') as embed_text from crawled_docs""")
def _(s, d):
    c = read(s, d, "crawled_docs")
    return c.select("fetch_no", text.embed_text(F.col("title"), F.col("meta_description"), F.col("headings"), F.col("body")).alias("embed_text"))


@query("collapse_whitespace", r"select doc_id, trim(regexp_replace(text, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) as text from documents")
def _(s, d):
    return read(s, d, "documents").select("doc_id", text.collapse(F.col("text")).alias("text"))


_ADMIT = f"""with w as (select fetch_no, coalesce(title, '') as title, body, {_WORDS.format('body')} as words, {_WORDS.format("lower(coalesce(title, ''))")} as tw,
  {_WORDS.format('lower(body)')} as bw from crawled_docs),
f as (select *, len(words) as n, len(list_distinct(list_transform(words, lambda x: lower(x)))) / len(words) as uniq,
  len(list_filter(regexp_split_to_array(body, '[.!?]'), lambda x: len({_WORDS.format('x')}) >= 5)) as sentences,
  len(list_intersect(list_distinct(tw), bw)) / len(list_distinct(tw)) as overlap from w)
select fetch_no, not coalesce(n < 15 or (title = '' and strlen(body) < 100) or uniq < 0.25 or (sentences = 0 and n < 80)
  or (case when len(tw) > 0 then overlap > 0.8 and n < 40 else false end), false) as admitted from f"""


@query("index_admission", _ADMIT)
def _(s, d):
    return read(s, d, "crawled_docs").select("fetch_no", text.admitted(F.col("title"), F.col("body")).alias("admitted"))


_QUALITY = f"""with w as (select fetch_no, url, body, {_WORDS.format('body')} as words from crawled_docs),
f as (select fetch_no, url, len(words) as n, (len(list_distinct(list_transform(words, lambda x: lower(x)))) / len(words))::float as uniq,
  (coalesce(list_sum(list_filter(list_transform(regexp_split_to_array(body, '[.!?]'), lambda x: len({_WORDS.format('x')})), lambda k: k >= 7)), 0) / len(words))::float as sent,
  least(len(list_filter(string_split(body, chr(10) || chr(10)), lambda x: len({_WORDS.format('x')}) >= 20)) / 3.0, 1.0)::float as para from w),
q as (select fetch_no, url, case when n < 15 then 0.0 else greatest(0.0, least(1.0, uniq::double * 0.3 + sent::double * 0.4 + para::double * 0.3)) end as quality from f)"""


@query("content_quality", _QUALITY + " select fetch_no, round(quality, 4) as quality from q")
def _(s, d):
    return read(s, d, "crawled_docs").select("fetch_no", rounded(text.quality(F.col("body")).cast("double"), 4).alias("quality"))


@query("quality_gate", _QUALITY + r""" select fetch_no from q where quality >= 0.15
  or coalesce(regexp_replace(""" + _PATH.format("url") + r""", '[?#].*', '') in ('', '/', '/index.html', '/index.htm'), false)""")
def _(s, d):
    return ingest.quality_gate(read(s, d, "crawled_docs")).select("fetch_no")


@query("index_stats", f"with {_POSTS}, {_LENS}, {_STATS} select n_docs, (select count(*) from posts) as postings, (select count(distinct term) from posts) as terms from stats")
def _(s, d):
    return ix.index_stats(ix.postings(texts(s, d)))


@query("crawl_counters", """select (select count(*) from raw_pages) as crawled, count(*) as fetched, count(distinct id) as indexed from crawled_docs""")
def _(s, d):
    return crawl.counters(read(s, d, "raw_pages"), read(s, d, "crawled_docs"))


# ---- search ----------------------------------------------------------------------------------------


def _bm25_parts(s, d):
    posts = ix.postings(texts(s, d))
    lens = ix.lengths(posts)
    return posts, lens, ix.corpus_stats(lens)


@query("bm25_topk", f"with {_POSTS}, {_LENS}, {_STATS}, {_bm25('posts', PROBE.split())} select doc_id, round(score, 6) as score from scored order by scored.score desc, doc_id limit 50")
def _(s, d):
    return se.top_k(se.bm25_scores(*_bm25_parts(s, d), se.query_tokens(PROBE)), 50).withColumn("score", rounded("score"))


@query("query_bag_duplicates", f"with {_POSTS}, {_LENS}, {_STATS}, {_bm25('posts', ['map', 'harbour', 'map'])} select doc_id, round(score, 6) as score from scored order by scored.score desc, doc_id limit 20")
def _(s, d):
    return se.top_k(se.bm25_scores(*_bm25_parts(s, d), se.query_tokens("map harbour map")), 20).withColumn("score", rounded("score"))


@query("bm25_field_weighted", f"with {_FIELDS}, {_LENS}, {_STATS}, {_bm25('posts', PROBE.split())} select doc_id, round(score, 6) as score from scored order by scored.score desc, doc_id limit 50")
def _(s, d):
    posts = ix.postings(docs(s, d), fixed.FIELD_WEIGHTS)
    lens = ix.lengths(posts)
    return se.top_k(se.bm25_scores(posts, lens, ix.corpus_stats(lens), se.query_tokens(PROBE)), 50).withColumn("score", rounded("score"))


def _written(s, d, parts: int = 2, stemmer: str = "none") -> ix.Index:
    """An index on disk of the documents that it admits, appended in ``parts`` deltas by order of fetching."""
    from tidemark.session import scratch_path

    index, store = ix.Index(s, scratch_path(s, "index"), stemmer), docs(s, d)
    low, high = store.select(F.min("fetch_no"), F.max("fetch_no")).first()
    for k in range(parts):
        inside = F.floor((F.col("fetch_no") - low) * parts / (high + 1 - low)) == k if low is not None else F.lit(True)
        index.add(store.where(inside))
    return index


_ADMITTED = _ADMIT.replace("with w as", "w as").replace("select fetch_no, not coalesce(", ", adm as (select fetch_no, not coalesce(") + ")"
_KEPT = f"""{_ADMITTED}, kept as (select c.* from {_FIRST} c join adm using (fetch_no) where admitted)"""
_INDEX = f"""with {_KEPT}, {_FIELDS.replace(_FIRST, 'kept')}, {_LENS}, {_STATS}"""


@query("index_postings", f"{_INDEX} select * from posts")
def _(s, d):
    return _written(s, d).table("postings")


@query("index_docstore", f"{_INDEX} select id as doc_id, url, title, left(body, 1000) as preview from kept")
def _(s, d):
    return _written(s, d).table("docstore")


@query("index_corpus", f"{_INDEX} select n_docs, total_len::bigint as total_len, round(avg_len, 6) as avg_len from stats")
def _(s, d):
    index = _written(s, d, 3)
    index.compact()
    return index.stats().withColumn("avg_len", rounded("avg_len"))


@query("index_search", f"{_INDEX}, {_bm25('posts', PROBE.split())} select doc_id, round(score, 6) as score from scored order by scored.score desc, doc_id limit 50")
def _(s, d):
    index = _written(s, d)
    return se.top_k(se.bm25_scores(index.table("postings"), index.table("lengths"), index.stats(), se.query_terms(PROBE, index.stemmer)), 50).withColumn("score", rounded("score"))


@query("bm25_snowball")
def _(s, d):
    posts = ix.postings(texts(s, d), stemmer="snowball")
    lens = ix.lengths(posts)
    from tidemark.functions.stem import stem

    return se.top_k(se.bm25_scores(posts, lens, ix.corpus_stats(lens), [stem(t) for t in se.query_tokens("harbours mapping archived")]), 50)


def _title_bonus_sql(tokens: list[str], raw: str) -> str:
    q = raw.strip().lower()
    hits = " + ".join(f"(contains(lower(coalesce(title, '')), '{t}'))::int" for t in tokens) or "0"
    return f"""case when strlen('{q}') >= 3 and contains(lower(coalesce(title, '')), '{q}')
  then 0.5 * greatest(score, 0.1) + case when starts_with(lower(coalesce(title, '')), '{q}') then 0.2 * greatest(score, 0.1) else 0 end
  else 0.35 * greatest(score, 0.01) * ({hits}) + case when ({hits}) = {len(tokens)} and {len(tokens)} > 0 then 0.15 * greatest(score, 0.01) else 0 end end"""


_TITLED = f"""with {_FIELDS}, {_LENS}, {_STATS}, {_bm25('posts', se.query_tokens(TITLE_PROBE))},
pool as (select doc_id, score from scored order by score desc, doc_id limit 80),
titled as (select p.doc_id, f.url, f.title, score + {_title_bonus_sql(se.query_tokens(TITLE_PROBE), TITLE_PROBE)} as total from pool p join {_FIRST} f on f.id = p.doc_id)"""


@query("bm25_title_bonus", _TITLED + " select doc_id, url, title, round(total, 6) as score from titled order by total desc, doc_id limit 20")
def _(s, d):
    return _text_search(s, d, TITLE_PROBE, 20)


def _text_search(s, d, words: str, k: int, key: bool = True) -> DataFrame:
    store = docs(s, d)
    posts = ix.postings(store, fixed.FIELD_WEIGHTS)
    lens = ix.lengths(posts)
    return se.bm25_search(posts, lens, ix.corpus_stats(lens), store, words, k).withColumn("score", rounded("score"))


@query("suggest_topk", _TITLED.replace("limit 80", "limit 40") + " select doc_id, url, title, round(total, 6) as score from titled order by total desc, doc_id limit 10")
def _(s, d):
    return _text_search(s, d, TITLE_PROBE, 10)


@query("page_offset", _TITLED.replace("limit 80", "limit 160") + " select doc_id, url, title, round(total, 6) as score from titled order by total desc, doc_id limit 20 offset 20")
def _(s, d):
    return _text_search(s, d, TITLE_PROBE, 40).orderBy(F.col("score").desc(), "doc_id").offset(20).limit(20)


@query("snippet_full")
def _(s, d):
    return read(s, d, "documents").select("doc_id", text.snippet(F.col("text"), se.query_terms("harbours map archived", "snowball"), se.query_tokens("harbours map archived")).alias("snippet"))


@query("highlight_single", r"select doc_id, regexp_replace(text, '((?:harbour)+)', '<mark>\1</mark>', 'gi') as marked from documents")
def _(s, d):
    return read(s, d, "documents").select("doc_id", text.highlight(F.col("text"), "harbour").alias("marked"))


@query("highlight_many", r"select doc_id, regexp_replace(text, '((?:harbour map|harbour|our map|map)+)', '<mark>\1</mark>', 'gi') as marked from documents")
def _(s, d):
    return read(s, d, "documents").select("doc_id", text.highlight_all(F.col("text"), ["harbour", "our map", "map"]).alias("marked"))


@query("stop_word_language")
def _(s, d):
    return read(s, d, "documents").select("doc_id", text.stop_word_language(F.col("text")).alias("lang"))


@query("hash_embedding")
def _(s, d):
    return read(s, d, "documents").select("doc_id", rounded(se.l2_norm(se.hash_embedding(F.col("text"), 64))).alias("norm"))


def _probe_vector(s, d) -> list[float]:
    return [float(x) for x in read(s, d, "embeddings").where("vec_id = 7").select("embedding").first()[0]]


_Q7 = "q as (select embedding as qe from embeddings where vec_id = 7)"
_DOT = "list_dot_product(embedding::double[], qe::double[])"


@query("knn_exact", f"with {_Q7} select vec_id, round({_DOT}, 6) as score from embeddings, q order by {_DOT} desc, vec_id limit 10")
def _(s, d):
    return se.nearest(read(s, d, "embeddings"), _probe_vector(s, d), 10).withColumn("score", rounded("score"))


@query("knn_filtered_semi", f"with {_Q7} select vec_id, round({_DOT}, 6) as score from embeddings, q where vec_id in (select vec_id from embeddings where label = 3) order by {_DOT} desc, vec_id limit 10")
def _(s, d):
    e = read(s, d, "embeddings")
    return se.nearest(e, _probe_vector(s, d), 10, allowed=e.where("label = 3").select("vec_id")).withColumn("score", rounded("score"))


@query("knn_minus_candidates", f"""with {_Q7}, n as (select vec_id, {_DOT} as score from embeddings, q order by score desc, vec_id limit 25)
select vec_id, round(score, 6) as score from n where vec_id not in (select vec_id from embeddings where label = 3)""")
def _(s, d):
    e = read(s, d, "embeddings")
    near = se.nearest(e, _probe_vector(s, d), 25)
    return near.join(e.where("label = 3").select("vec_id"), "vec_id", "left_anti").withColumn("score", rounded("score"))


@query("knn_batch", """with p as (select a.vec_id as query_id, b.vec_id, list_dot_product(a.embedding::double[], b.embedding::double[]) as score
  from embeddings a, embeddings b where a.vec_id % 50 = 0)
select query_id, vec_id, round(score, 6) as score from p qualify row_number() over (partition by query_id order by p.score desc, vec_id) <= 5""")
def _(s, d):
    e = read(s, d, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")  # the stated query set
    return se.nearest_batch(e, asked, 5).withColumn("score", rounded("score"))


@query("ann_cells")
def _(s, d):
    """Every fiftieth vector against all, by cells; the tests hold its recall against ``knn_batch``."""
    e = read(s, d, "embeddings")
    centres = se.fit_cells(e, 32)
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")  # the stated query set
    return se.nearest_cells_batch(se.assign_cells(e, centres, "vec_id"), centres, asked, 5).withColumn("score", rounded("score"))


@query("l2_norms", "select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm from embeddings")
def _(s, d):
    return read(s, d, "embeddings").select("vec_id", rounded(se.l2_norm(F.col("embedding"))).alias("norm"))


@query("normalized_vectors", """with n as (select rec_no, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as size from vec_records where embedding is not null)
select rec_no, round(list_sum(list_transform(embedding, lambda x: case when size > 1e-8 then x::double / size else x::double end)), 5) as total from n""")
def _(s, d):
    v = read(s, d, "vec_records").where("embedding is not null")
    return v.select("rec_no", rounded(F.aggregate(se.normalized(F.col("embedding")), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("masked_mean_pooling", """with t as (select vec_id, j, i, embedding[j * 8 + i + 1]::double as x, embedding[j * 8 + 1] > 0 as on_ from embeddings, range(8) a(j), range(8) b(i)),
m as (select vec_id, i, coalesce(sum(x) filter (on_), 0) / greatest(count(*) filter (on_), 1e-9) as m from t group by 1, 2),
n as (select vec_id, i, m / case when sqrt(sum(m * m) over (partition by vec_id)) > 1e-8 then sqrt(sum(m * m) over (partition by vec_id)) else 1 end as x from m)
select vec_id, list(round(case when i < 8 then x else 0 end, 6) order by i) as pooled from (select * from n union all select vec_id, 8 + z.i, 0 from embeddings, range(4) z(i)) group by 1""")
def _(s, d):
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.slice("embedding", j * 8 + 1, F.lit(8)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: (F.get("embedding", j * 8) > 0).cast("int"))
    pooled = se.mean_pooled(tokens, mask, 12)
    return read(s, d, "embeddings").select("vec_id", F.transform(pooled, lambda x: F.round(x, 6)).alias("pooled"))


def _lists(s, d) -> DataFrame:
    """Places of the test lists, which hold at most some dozens of items each."""
    r = read(s, d, "ranked_lists").where("score is not null").select("query_id", "list_no", "doc_id", "url", "title", F.col("score").cast("double").alias("score")).distinct()
    up = read(s, d, "score_lists").select("list_no", "higher_is_better")
    signed = r.join(F.broadcast(up), "list_no").withColumn("score", F.when(F.col("higher_is_better"), F.col("score")).otherwise(-F.col("score")))  # five rows
    one = signed.groupBy("query_id", "list_no", "doc_id").agg(F.max("score").alias("score"), F.max("url").alias("url"), F.max("title").alias("title"))
    order = Window.partitionBy("query_id", "list_no").orderBy(F.col("score").desc(), "doc_id")
    return one.withColumn("place", F.row_number().over(order))


_LISTS = """one as (select query_id, list_no, doc_id, max(case when higher_is_better then score::double else -score::double end) as score, max(url) as url, max(title) as title
  from ranked_lists join score_lists using (list_no) where score is not null group by 1, 2, 3),
lists as (select *, row_number() over (partition by query_id, list_no order by score desc, doc_id) as place from one),
fused as (select query_id, doc_id, sum(1.0::double / (60 + place)) as score, count(*) as sources, arg_min(url, list_no) as url, arg_min(title, list_no) filter (title is not null) as title
  from lists group by 1, 2)"""


@query("rrf_fuse", f"with {_LISTS} select query_id, doc_id, round(score, 8) as score, sources, url from fused")
def _(s, d):
    return se.rrf(_lists(s, d), ["query_id", "doc_id"]).select("query_id", "doc_id", rounded("score", 8).alias("score"), "sources", "url")


@query("rrf_multi_source", f"with {_LISTS} select query_id, doc_id, round(score + case when sources > 1 then 0.01 else 0 end, 8) as score from fused")
def _(s, d):
    return se.rrf(_lists(s, d), ["query_id", "doc_id"], fixed.BOOST["multi_source"]).select("query_id", "doc_id", rounded("score", 8).alias("score"))


@query("list_min_max", """select query_id, list_no, doc_id, round(case when hi - lo < 1.2e-7 then 1.0 else (s - lo) / (hi - lo) end, 6) as score from (
  select query_id, list_no, doc_id, s, min(s) over w as lo, max(s) over w as hi from (select distinct query_id, list_no, doc_id, score::double as s from ranked_lists where score is not null)
  window w as (partition by query_id, list_no))""")
def _(s, d):
    r = read(s, d, "ranked_lists").where("score is not null").select("query_id", "list_no", "doc_id", F.col("score").cast("double").alias("score")).distinct()
    return se.min_max(r, ["query_id", "list_no"]).select("query_id", "list_no", "doc_id", rounded("score").alias("score"))


@query("weighted_fuse", """with t as (select query_id, list_no, doc_id, max(score)::double as score from ranked_lists where score is not null and list_no in (0, 1) group by 1, 2, 3),
a as (select *, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from t where list_no = 0), b as (select * from t where list_no = 1)
select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.doc_id, b.doc_id) as doc_id, round(0.6 * coalesce(case when hi - lo < 1.2e-7 then 1.0 else (a.score - lo) / (hi - lo) end, 0)
  + case when b.score is null then 0 else 0.4 * greatest(0.0, least(1.0, (b.score + 1) / 2)) end, 6) as score from a full join b on a.doc_id = b.doc_id and a.query_id = b.query_id""")
def _(s, d):
    r = read(s, d, "ranked_lists").where("score is not null").groupBy("query_id", "list_no", "doc_id").agg(F.max("score").cast("double").alias("score"))
    return se.weighted_fusion(r.where("list_no = 0"), r.where("list_no = 1"), 0.6, group=["query_id"]).withColumn("score", rounded("score"))


#: One list of one query.
_LIST = ["query_id", "list_no"]
_URLS = "(select distinct url, max(title) as title, min(doc_id) as doc_id from ranked_lists group by url)"


def _urls(s, d) -> DataFrame:
    return read(s, d, "ranked_lists").groupBy("url").agg(F.max("title").alias("title"), F.min("doc_id").alias("doc_id"))


_KEY = r"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '^www\.', ''), '[?#].*', ''), '/+$', ''))"


@query("dedup_by_url", f"""with s as (select query_id, list_no, url, max(score)::double as score, min(doc_id) as doc_id from ranked_lists where score is not null group by 1, 2, 3)
select query_id, list_no, url, doc_id, round(score, 6) as score from s qualify row_number() over (partition by query_id, list_no, {_KEY} order by s.score desc, doc_id) = 1""")
def _(s, d):
    r = read(s, d, "ranked_lists").where("score is not null").groupBy(*_LIST, "url").agg(F.max("score").cast("double").alias("score"), F.min("doc_id").alias("doc_id"))
    return se.dedup_by_url(r, group=_LIST).select(*_LIST, "url", "doc_id", rounded("score").alias("score"))


def _root_sql(name: str) -> str:
    labels = f"string_split(regexp_replace({name}, '^www\\.', ''), '.')"
    return f"""case when array_to_string(list_slice({labels}, -2, -1), '.') in ({_list(fixed.COMPOUND_TLDS)}) then array_to_string(list_slice({labels}, -3, -1), '.')
  else array_to_string(list_slice({labels}, -2, -1), '.') end"""


@query("domain_cap", f"""with s as (select query_id, list_no, doc_id, any_value(url) as url, max(score)::double as score from ranked_lists where score is not null group by 1, 2, 3),
p as (select *, {_HOST.format('url')} as host from s),
r as (select *, {_root_sql('lower(host)')} as root, starts_with(string_split(regexp_replace(lower(host), '^www\\.', ''), '.')[1], 'kettle') as nav from p),
n as (select *, row_number() over (partition by query_id, list_no, root order by score desc, doc_id) as n from r),
c as (select *, sum((nav and n > 3)::int) over (partition by query_id, list_no, root order by n) as later from n)
select query_id, list_no, doc_id, round(score, 6) as score from c where n <= 3 or (nav and later <= 7)""")
def _(s, d):
    r = read(s, d, "ranked_lists").where("score is not null").groupBy(*_LIST, "doc_id").agg(F.any_value("url").alias("url"), F.max("score").cast("double").alias("score"))
    return se.cap_domains(r, "kettle", group=_LIST).select(*_LIST, "doc_id", rounded("score").alias("score"))


@query("freshness_boost", """with s as (select query_id, list_no, doc_id, max(score)::double as score from ranked_lists where score is not null group by 1, 2, 3)
select query_id, list_no, doc_id, round((score::float + (0.008 * doc_id / max(doc_id) over (partition by query_id, list_no))::float)::float::double, 4) + 0.0 as score from s""")
def _(s, d):
    r = read(s, d, "ranked_lists").where("score is not null").groupBy(*_LIST, "doc_id").agg(F.max("score").cast("double").alias("score"))
    return se.freshness(r, group=_LIST).select(*_LIST, "doc_id", (rounded(F.col("score").cast("double"), 4) + 0.0).alias("score"))


_BRAND = f"""(strlen(name) <= 20 and not (regexp_matches(name, '[0-9]') and strlen(name) < 4) and not regexp_matches(name, '{_re(fixed.INFRA_NAMES)}')
  and tld in ({_list(fixed.PREFERRED_TLDS)}) and length(regexp_replace(name, '[^A-Za-z]', '', 'g')) >= greatest(strlen(name) - 1, 0))"""
_JUNK = f"""coalesce(regexp_matches(low, '{_re(fixed.AUTH_PATHS + fixed.WIKI_PATHS + fixed.LISTING_PATHS)}') or regexp_matches(low, '({_re(fixed.JUNK_SUFFIXES)})$')
  or regexp_matches(coalesce(title, ''), '^({_re(fixed.JUNK_TITLES)})'), false)"""
_NAMED = f"""{_sql_parts(_URLS)}, named as (select *, string_split(bare, '.')[1] as name, string_split(bare, '.')[-1] as tld, lower(coalesce(title, '')) as tl from parts)"""


@query("url_boost", f"""with {_NAMED}, f as (select *, {_JUNK} as junk, regexp_matches(tl, '{_re(fixed.ERROR_TITLES)}') as err, coalesce(regexp_matches(low, '{_re(fixed.PROFILE_PATHS)}'), false) as prof,
  path in ('', '/', '/index.html', '/index.htm') as home, length(path) - length(replace(path, '/', '')) as depth from named)
select url, round(case when junk then -0.06 else 0 end + case when err then -0.025 else 0 end + case when prof then -0.015 else 0 end
  + case when name = 'harbour' or bare = 'harbour' then 0.15 when starts_with(name, 'harbour') then 0.04 * 7 / strlen(name) when starts_with('harbour', name) and strlen(name) >= 3 then 0.02 * strlen(name) / 7 else 0 end
  + case when home then 0.12 when depth <= 2 then 0.004 when depth >= 5 then -0.006 else 0 end
  + case when starts_with(tl, 'harbour') then 0.02 when contains(tl, 'harbour') then 0.01 when contains(regexp_replace(tl, '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), 'harbour') then 0.008 else 0 end
  + coalesce(0.01 * 7 / strlen(list_filter(regexp_split_to_array(tl, '[^\\p{{L}}\\p{{N}}]'), lambda x: starts_with(x, 'harbour') and strlen(x) > 7)[1]), 0), 6) as boost from f""")
def _(s, d):
    return _urls(s, d).select("url", rounded(se.url_boost(F.col("url"), F.col("title"), "harbour")).alias("boost"))


@query("url_boost_two_terms")
def _(s, d):
    return _urls(s, d).select("url", rounded(se.url_boost(F.col("url"), F.col("title"), "amber harbour")).alias("boost"))


def _engine(s, d):
    """An engine over the documents with their first lines as titles, their stored vectors, and one of these as the query's."""
    from tidemark.plans.engine import SearchEngine

    store = read(s, d, "documents").select("doc_id", "url", F.substring(F.split("text", "\n")[0], 1, 80).alias("title"), F.col("text").alias("body"),
                                           F.array().cast("array<string>").alias("headings"), F.lit(None).cast("string").alias("meta_description"))
    vectors = read(s, d, "vec_records").where("embedding is not null and size(embedding) = 128").groupBy("doc_id").agg(F.min_by("embedding", "rec_no").alias("embedding"))
    vector = vectors.join(store.select("doc_id"), "doc_id", "left_semi").orderBy("doc_id").select("embedding").first()
    return SearchEngine.over(store, vectors, "snowball"), list(vector[0]) if vector else None


def _hybrid(s, d, words: str, k: int) -> DataFrame:
    engine, vector = _engine(s, d)
    found = engine.search(words, "hybrid", k, query_vector=vector)
    return found.select("doc_id", "url", "title", F.round(F.col("score").cast("double"), 4).alias("score"))


@query("hybrid_short_query")
def _(s, d):
    return _hybrid(s, d, "harbour map", 20)


@query("hybrid_long_query")
def _(s, d):
    return _hybrid(s, d, "harbour map archive index notes", 20)


@query("semantic_topk", f"""with v as (select doc_id, arg_min(embedding, rec_no)::double[] as e from vec_records where embedding is not null and len(embedding) = 128 group by 1),
q as (select e as qe from v where doc_id in (select doc_id from documents) order by doc_id limit 1),
n as (select doc_id, list_dot_product(e, qe) as s from v, q order by s desc, doc_id limit 10)
select doc_id, url, left(string_split(text, chr(10))[1], 80) as title, round(s, 6) as score from n join documents using (doc_id)""")
def _(s, d):
    engine, vector = _engine(s, d)
    return engine.search("", "semantic", 10, query_vector=vector).withColumn("score", rounded("score"))


# ---- addresses -------------------------------------------------------------------------------------


@query("url_parts", f"with {_sql_parts(_URLS)} select url, host, path, bare from parts")
def _(s, d):
    u = F.col("url")
    return _urls(s, d).select("url", urls.host(u).alias("host"), urls.path(u).alias("path"), urls.bare_host(u).alias("bare"))


@query("url_root_domain_fusion", f"with {_sql_parts(_URLS)} select url, {_root_sql('lower(host)')} as root from parts")
def _(s, d):
    return _urls(s, d).select("url", urls.root_domain(F.lower(urls.host(F.col("url")))).alias("root"))


@query("url_root_domain_scope", f"""with {_sql_parts(_URLS)}, l as (select url, host, string_split(host, '.') as p from parts)
select url, case when len(p) <= 2 then host when p[-2] in ({_list(fixed.SECOND_LEVELS)}) then array_to_string(list_slice(p, -3, -1), '.') else array_to_string(list_slice(p, -2, -1), '.') end as root from l""")
def _(s, d):
    return _urls(s, d).select("url", urls.scope_domain(urls.host(F.col("url"))).alias("root"))


@query("url_normalize_key", f"select url, {_KEY} as key from {_URLS}")
def _(s, d):
    return _urls(s, d).select("url", urls.url_key(F.col("url")).alias("key"))


@query("url_normalize_link", r"""with b as (select distinct url, regexp_replace(url, '#.*', '') as u from batch_docs where url is not null),
p as (select url, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) as scheme, lower(regexp_extract(u, '^[A-Za-z]+://([^/?]*)', 1)) as auth, regexp_extract(u, '^[A-Za-z]+://[^/?]*(.*)$', 1) as rest from b),
q as (select *, regexp_extract(rest, '^([^?]*)', 1) as w, regexp_extract(rest, '(\?.*)$', 1) as qs from p)
select url, case when scheme in ('http', 'https') then scheme || '://' || case when scheme = 'http' then regexp_replace(auth, ':80$', '') else regexp_replace(auth, ':443$', '') end
  || case when w = '' then '/' when length(w) > 1 then regexp_replace(w, '/+$', '') else w end || qs end as link from q""")
def _(s, d):
    return read(s, d, "batch_docs").where("url is not null").select("url").distinct().select("url", urls.normal_link(F.col("url")).alias("link"))


@query("homepage_flag", f"select url, coalesce(regexp_replace({_PATH.format('url')}, '[?#].*', '') in ('', '/', '/index.html', '/index.htm'), false) as home from {_URLS}")
def _(s, d):
    return _urls(s, d).select("url", urls.is_homepage(F.col("url")).alias("home"))


@query("skip_url_flag", f"select url, regexp_matches(string_split(lower(url), '?')[1], '({_re(fixed.SKIP_EXTENSIONS)})$') or regexp_matches(lower(url), '{_re(fixed.SKIP_FRAGMENTS)}') as skip from {_URLS}")
def _(s, d):
    return _urls(s, d).select("url", urls.should_skip(F.col("url")).alias("skip"))


@query("junk_url_flag", f"with {_sql_parts(_URLS)} select url, {_JUNK} as junk from parts")
def _(s, d):
    return _urls(s, d).select("url", urls.is_junk(F.col("url"), F.col("title")).alias("junk"))


@query("error_title_flag", f"select fetch_no, coalesce(regexp_matches(lower(title), '{_re(fixed.ERROR_TITLES)}'), false) as error from crawled_docs")
def _(s, d):
    return read(s, d, "crawled_docs").select("fetch_no", urls.is_error(F.col("title")).alias("error"))


@query("profile_url_flag", f"with {_sql_parts(_URLS)} select url, coalesce(regexp_matches(low, '{_re(fixed.PROFILE_PATHS)}'), false) as profile from parts")
def _(s, d):
    return _urls(s, d).select("url", urls.is_profile(F.col("url")).alias("profile"))


@query("brand_flag", f"with {_NAMED} select url, {_BRAND} as brand from named")
def _(s, d):
    u = F.col("url")
    return _urls(s, d).select("url", urls.is_brand(urls.domain_name(u), urls.bare_host(u)).alias("brand"))


@query("junk_domain_flag", f"""with h as (select distinct domain from crawled_docs), p as (select domain, string_split(domain, '.') as l from h)
select domain, regexp_matches(domain, '({_re(fixed.JUNK_TLDS)})$') or regexp_matches(domain, '(^|\\.)({_re(fixed.INFRA_SUFFIXES)})$') or regexp_matches(l[1], '{_re(fixed.INFRA_KEYWORDS)}')
  or (len(l) >= 3 and regexp_matches(array_to_string(list_slice(l, 1, len(l) - 2), '.'), '{_re(fixed.INFRA_KEYWORDS)}')) or (strlen(l[1]) <= 2 and strlen(domain) <= 6) as junk from p""")
def _(s, d):
    return read(s, d, "crawled_docs").select("domain").distinct().select("domain", urls.is_junk_domain(F.col("domain")).alias("junk"))


_RICH = f"""(case when regexp_matches(string_split(domain, '.')[1], '{_re(fixed.RICH_KEYWORDS)}') then 2.0 else 1.0 end
  * case when regexp_matches(domain, '(\\.edu|\\.ac\\.uk|\\.edu\\.au)$') then 3.0 when domain like '%.gov' then 1.5 when domain like '%.org' then 1.4
    when regexp_matches(domain, '(\\.io|\\.dev|\\.sh)$') then 1.3 else 1.0 end
  * case when strlen(string_split(domain, '.')[1]) <= 12 and regexp_matches(string_split(domain, '.')[1], '^[A-Za-z]*$') then 1.2 else 1.0 end)::double"""


@query("seed_scoring", f"""with r as (select domain, count(*) as rank from crawled_docs group by 1)
select domain, rank, round(1000000.0::double / (rank + 100) * {_RICH}, 4) as score, case when {_RICH} >= 2 or rank <= 1000 then 3 else 2 end as depth,
  case when regexp_matches(domain, '{_re(fixed.OPEN_SCOPE_WORDS)}') then 'any' else 'same_domain' end as scope,
  case when rank <= 500 then 'high' when rank <= 5000 then 'normal' else 'low' end as priority from r""")
def _(s, d):
    r = read(s, d, "crawled_docs").groupBy("domain").agg(F.count("*").alias("rank"))
    dom, rank = F.col("domain"), F.col("rank")
    return r.select("domain", "rank", rounded(urls.domain_score(dom, rank), 4).alias("score"), urls.domain_depth(dom, rank).alias("depth"),
                    urls.domain_crawl_scope(dom).alias("scope"), urls.rank_priority(rank).alias("priority"))


_KNOWN = "(select regexp_replace(lower(domain), '^www\\.', '') from raw_pages where status = 404)"


@query("ranked_domains", f"""select s.* from ({SQL['seed_scoring']}) s join ({SQL['junk_domain_flag']}) j using (domain)
where not junk and regexp_replace(domain, '^www\\.', '') not in {_KNOWN}""")
def _(s, d):
    lines = read(s, d, "crawled_docs").groupBy("domain").agg(F.count("*").alias("n")).select(F.concat_ws(",", "n", "domain").alias("value"))
    return seeds.ranked_domains(lines, read(s, d, "raw_pages").where("status = 404").select("domain"), 1_000_000).withColumn("score", rounded("score", 4))


_BARE = "(select *, regexp_replace(lower(" + _HOST.format("url") + "), '^www\\.', '') as bare from crawled_docs)"
_JUNK_BARE = SQL["junk_domain_flag"].replace("select distinct domain from crawled_docs", f"select distinct bare as domain from {_BARE} where bare is not null")


@query("story_domains", f"""select bare as domain, count(*) as n, arg_min(url, fetch_no) as url from {_BARE} join ({_JUNK_BARE}) j on j.domain = bare
where not junk and bare not in {_KNOWN} group by 1""")
def _(s, d):
    stories = read(s, d, "crawled_docs").select(F.col("fetch_no").alias("pos"), "url")
    return seeds.story_domains(stories, read(s, d, "raw_pages").where("status = 404").select("domain"), 1_000_000)


@query("certificate_domains", f"""with c as (select bare as domain, 3 * count(*) as n from {_BARE} where bare is not null group by 1)
select domain, n, round({_RICH} * sqrt(n), 4) as score from c join ({_JUNK_BARE}) j using (domain) where not junk and domain not in {_KNOWN}""")
def _(s, d):
    host = urls.bare_host(F.col("url"))
    entries = read(s, d, "crawled_docs").select(F.concat(F.lit("*."), host, F.lit("\nwww."), host).alias("name_value"), F.upper(host).alias("common_name"))
    return seeds.certificate_domains(entries, read(s, d, "raw_pages").where("status = 404").select("domain"), 1_000_000).withColumn("score", rounded("score", 4))


@query("seeds_json", """select fetch_no, url, case when fetch_no % 2 = 0 then 3 else 2 end as depth, case when fetch_no % 2 = 0 then 'normal' else 'high' end as priority, 'any' as scope, fetch_no % 2 = 1 as sitemap
from crawled_docs where fetch_no % 3 <> 2""")
def _(s, d):
    """Seeds as plain addresses, as objects and as text that is no seed."""
    raw = F.when(F.col("fetch_no") % 3 == 2, F.lit("{broken")).when(F.col("fetch_no") % 2 == 0, F.concat(F.lit('"'), F.col("url"), F.lit('"'))).otherwise(
        F.to_json(F.struct("url", F.lit(2).alias("depth"), F.lit("High").alias("priority"), F.lit(True).alias("sitemap"))))
    rows = read(s, d, "crawled_docs").select("fetch_no", "url", raw.alias("raw"))
    return seeds.seeds(rows).join(rows.where("fetch_no % 3 <> 2").select("fetch_no", F.col("url").alias("u")), F.col("url") == F.col("u")).drop("u").distinct()


@query("sitemap_locations", "select distinct domain, url as loc, false as is_index from crawled_docs")
def _(s, d):
    """Site maps of up to a thousand addresses a site, as the protocol asks for."""
    loc = F.concat(F.lit("<url><loc> "), F.col("url"), F.lit(" </loc></url>"))
    maps = read(s, d, "crawled_docs").groupBy("domain", F.floor(F.col("fetch_no") / 1000).alias("part")).agg(F.concat_ws("", F.lit("<urlset>"), F.collect_list(loc), F.lit("</urlset>")).alias("xml"))
    return seeds.sitemap_locations(maps).select("domain", "loc", "is_index").distinct()


@query("robots_decisions", f"""with u as (select distinct url, lower({_HOST.format('url')}) as host, coalesce(nullif(regexp_replace({_PATH.format('url')}, '[?#].*', ''), ''), '/') as p from crawled_docs),
r as (select host, left(min(p), 4) as deny, left(max(p), 6) as allow from u group by 1)
select url, not (starts_with(p, deny) and (not starts_with(p, allow) or strlen(deny) > strlen(allow))) as allowed from u join r using (host)""")
def _(s, d):
    """Two rules a site, the later of which also lets in what the earlier bars where it is as long."""
    u = read(s, d, "crawled_docs").select("url").distinct()
    where = F.regexp_replace(urls.path(F.col("url")), "[?#].*", "")
    where = F.when(F.coalesce(where, F.lit("")) == "", "/").otherwise(where)
    sites = u.select(F.lower(urls.host(F.col("url"))).alias("domain"), where.alias("p")).groupBy("domain").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    text_lines = F.array(F.lit("User-agent: *  # everybody"), F.concat(F.lit("Disallow: "), F.substring("a", 1, 4)), F.concat(F.lit("allow:"), F.substring("b", 1, 6)))
    lines = sites.select("domain", F.posexplode(text_lines).alias("line_no", "line"))
    return crawl.robots_allowed(u, crawl.robots_rules(lines))


@query("safe_file_name", "select distinct domain, regexp_replace(domain, '[^A-Za-z0-9.-]', '_', 'g') as name from crawled_docs")
def _(s, d):
    return read(s, d, "crawled_docs").select("domain", urls.file_name(F.col("domain")).alias("name")).distinct()


@query("scope_filter", """with l as (select distinct fetch_no, unnest(links) as link, domain from crawled_docs),
h as (select *, lower(""" + _HOST.format("link") + f""") as h from l), p as (select *, string_split(h, '.') as a, string_split(domain, '.') as b from h)
select distinct fetch_no, link from p where (case when len(a) <= 2 then h when a[-2] in ({_list(fixed.SECOND_LEVELS)}) then array_to_string(list_slice(a, -3, -1), '.') else array_to_string(list_slice(a, -2, -1), '.') end)
  = (case when len(b) <= 2 then domain when b[-2] in ({_list(fixed.SECOND_LEVELS)}) then array_to_string(list_slice(b, -3, -1), '.') else array_to_string(list_slice(b, -2, -1), '.') end)""")
def _(s, d):
    links = read(s, d, "crawled_docs").select("fetch_no", F.explode("links").alias("link"), "domain").distinct()
    return links.where(urls.in_scope(F.col("link"), F.lit("same_domain"), F.col("domain"))).select("fetch_no", "link").distinct()


@query("seed_union_dedup", """with u as (select url, fetch_no as pos, 'crawled' as origin from crawled_docs union all select url, 1000000000 + arrival_no, 'batch' from batch_docs)
select url, arg_min(origin, pos) as origin from u group by 1""")
def _(s, d):
    a = read(s, d, "crawled_docs").select("url", F.col("fetch_no").alias("pos"), F.lit("crawled").alias("origin"))
    b = read(s, d, "batch_docs").select("url", (F.col("arrival_no") + 1_000_000_000).alias("pos"), F.lit("batch").alias("origin"))
    return seeds.first_per_url(a.unionByName(b), "pos").select("url", "origin")


@query("frontier_bfs")
def _(s, d):
    c = read(s, d, "crawled_docs")
    start = c.groupBy("domain").agg(F.min_by("url", "fetch_no").alias("url")).select("url", F.lit(3).alias("depth_limit"), F.lit("any").alias("scope"))
    return crawl.frontier(start, c.select(F.col("url").alias("src"), F.explode("links").alias("dst")))


@query("arrival_rate_limit", "select event_id from events qualify row_number() over (partition by event_type, date_trunc('minute', ts) order by ts, event_id) <= 2")
def _(s, d):
    return crawl.within_rate(read(s, d, "events"), 2, "event_type", "ts", "minute", "event_id").select("event_id")


@query("favicon_first_per_domain", "select domain, arg_min(favicon_url, fetch_no) as favicon_url from crawled_docs where favicon_url is not null group by 1")
def _(s, d):
    return seeds.first_icon(read(s, d, "crawled_docs"), "fetch_no")


# ---- pages -----------------------------------------------------------------------------------------


@query("html_extract")
def _(s, d):
    return html.extract(read(s, d, "raw_pages")).dropDuplicates(["url", "crawled_at"])


@query("html_links")
def _(s, d):
    return html.extract(read(s, d, "raw_pages")).select("url", F.explode("links").alias("link")).distinct()


def _fields(s, d, columns: str) -> DataFrame:
    return html.fields(pages(s, d)).selectExpr("fetch_no", columns).distinct()


@query("html_title", r"select distinct fetch_no, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g')) as title from raw_pages")
def _(s, d):
    return _fields(s, d, "title")


@query("html_lang", """select distinct fetch_no, nullif(lower(trim(regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1))), '') as lang from raw_pages""")
def _(s, d):
    return _fields(s, d, "lang")


@query("html_headings", """select distinct fetch_no, len(regexp_extract_all(html, '(?i)<h[1-3][ >]'))::int as headings from raw_pages""")
def _(s, d):
    return _fields(s, d, "size(headings) as headings")


@query("html_favicon", "select distinct fetch_no, regexp_extract(url, '^(https?://[^/]*)', 1) || '/favicon.ico' as icon from raw_pages")
def _(s, d):
    return _fields(s, d, "favicon_url as icon")


@query("page_admission", """select distinct fetch_no from raw_pages where trim(coalesce(html, '')) <> ''
  and (headers is null or coalesce(headers['content-type'], 'text/html') like '%text/html%' or headers['content-type'] like '%application/xhtml%')""")
def _(s, d):
    return html.fields(read(s, d, "raw_pages").select("fetch_no", "url", "domain", "html", "headers", "crawled_at")).select("fetch_no").distinct()


@query("stream_ingest")
def _(s, d):
    """Pages as a stream of files into a fresh index; its document store."""
    from tidemark.session import scratch_path

    source, index = scratch_path(s, "arrivals"), ix.Index(s, scratch_path(s, "index"))
    rows = read(s, d, "raw_pages")
    rows.repartition(2).write.parquet(source)
    ingest.ingest_stream(s, source, rows.schema, index, scratch_path(s, "stream")).awaitTermination()
    return index.table("docstore").select("doc_id", "url", "title")


# ---- results ---------------------------------------------------------------------------------------


@query("group_by_host", f"select {_HOST.format('url')} as host, count(*) as n, min(doc_id) as first_id from {_URLS} group by 1")
def _(s, d):
    return present.by_host(_urls(s, d), "doc_id")


@query("pretty_url", f"""with {_sql_parts(_URLS)} select url, array_to_string(list_concat([bare], list_filter(string_split(regexp_replace(path, '[?#].*', ''), '/'), lambda x: x <> '')), ' › ') as pretty from parts""")
def _(s, d):
    return _urls(s, d).select("url", present.pretty_url(F.col("url")).alias("pretty"))


@query("truncate_snippet", "select doc_id, case when length(text) > 120 then left(text, 120) || '…' else text end as snippet from documents")
def _(s, d):
    return read(s, d, "documents").select("doc_id", present.cut(F.col("text"), 120).alias("snippet"))


@query("truncate_at_word", r"select doc_id, case when length(text) > 280 then regexp_replace(left(text, 280), '\s+\S*\z', '') || '…' else text end as snippet from documents")
def _(s, d):
    return read(s, d, "documents").select("doc_id", present.cut(F.col("text"), 280, True).alias("snippet"))


@query("untitled", "select fetch_no, coalesce(nullif(title, ''), '(untitled)') as title from crawled_docs")
def _(s, d):
    return read(s, d, "crawled_docs").select("fetch_no", present.shown_title(F.col("title")).alias("title"))


@query("score_percent", "select query_id, doc_id, list_no, least(100, floor(100 * score::double + 0.5))::int as pct from (select distinct query_id, doc_id, list_no, score from ranked_lists where score is not null)")
def _(s, d):
    r = read(s, d, "ranked_lists").where("score is not null").select("query_id", "doc_id", "list_no", "score").distinct()
    return r.select("query_id", "doc_id", "list_no", present.percent(F.col("score").cast("double")).alias("pct"))


@query("human_bytes", """select doc_id, case when b >= 1048576 then format('{:.2f} MB', b / 1048576.0) when b >= 1024 then format('{:.2f} KB', b / 1024.0) else b || ' B' end as size
  from (select doc_id, strlen(text) as b from documents)""")
def _(s, d):
    return read(s, d, "documents").select("doc_id", present.human_bytes(F.octet_length("text")).alias("size"))


@query("result_json")
def _(s, d):
    return _urls(s, d).select("doc_id", present.envelope(present.shown_title(F.col("title")), F.col("url"), F.lit(""), F.lit(1.0)).alias("json"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
