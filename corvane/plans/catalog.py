"""The named queries over the test tables, each with the DuckDB SQL that says the same.

Searches take as queries the rows whose id is divisible by 20. Scores are ranked on nine decimal places,
then id, and shown with six.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import encoders, identity
from corvane.functions import text as X
from corvane.functions import vectors as V
from corvane.operators import control, dense, evaluate, lexical, ranking, structure
from corvane.plans import lifecycle, search
from corvane.schemas import DOCUMENT_STATES, JOB
from corvane.sources.scratch import written

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_S: dict[str, str] = {}

#: Every how many-th id is a query.
EVERY = 20
SIZE, OVERLAP = 512, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def add(f):
        _Q[name] = f
        if sql is not None:
            _S[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_S)


# --- SQL fragments -------------------------------------------------------------------------------------------------

_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
_SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"


def _terms(column: str) -> str:
    return rf"list_filter(regexp_extract_all(replace(lower(coalesce({column}, '')), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t))"


def _unit(column: str) -> str:
    return f"list_transform({column}::DOUBLE[], lambda x: x / sqrt(list_dot_product({column}::DOUBLE[], {column}::DOUBLE[])))"


def _words(column: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({column}, ''), '{_SPACE}+'), lambda x: x <> '')"


def _ranked(source: str, k: int, id: str = "doc_id") -> str:
    return f"SELECT query_id, {id}, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, {id}) AS rank FROM {source}) WHERE rank <= {k}"


_ASKED = f"asked AS (SELECT item_id AS query_id, text FROM benchmark WHERE item_id % {EVERY} = 0)"


def _bm25(docs: str, queries: str = "asked") -> str:
    """CTEs that end in bm(query_id, doc_id, score)."""
    return f"""toks AS (SELECT doc_id, {_terms("text")} AS t FROM {docs}),
    st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
    tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM toks) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    qt AS (SELECT DISTINCT query_id, unnest({_terms("text")}) AS term FROM {queries}),
    bm AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score
      FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL)"""


def _sparse(docs: str, queries: str) -> str:
    """CTEs that end in sp(query_id, doc_id, score)."""
    return f"""stoks AS (SELECT doc_id, {_terms("text")} AS t FROM {docs}),
    stf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM stoks) GROUP BY ALL),
    sq AS (SELECT query_id, term, count(*) AS q FROM (SELECT query_id, unnest({_terms("text")}) AS term FROM {queries}) GROUP BY ALL),
    sp AS (SELECT query_id, doc_id, sum(q * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / 400.0))) AS score FROM sq JOIN stf USING (term) GROUP BY ALL)"""


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


# --- dense ---------------------------------------------------------------------------------------------------------


def _dense_queries(e: DataFrame) -> DataFrame:
    return e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")


_DENSE = f"""WITH u AS (SELECT vec_id, label, {_unit("embedding")} AS v FROM embeddings),
  s AS (SELECT q.vec_id AS query_id, p.vec_id, list_dot_product(q.v, p.v) AS score FROM u q, u p WHERE q.vec_id % {EVERY} = 0 {{where}})
  SELECT query_id, vec_id, round(round(score, 9), 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""


@register("dense_topk", _DENSE.format(where=""))
def dense_topk(spark, d):
    e = table(spark, d, "embeddings")
    return dense.dense_top(e, _dense_queries(e), 10)


@register("dense_topk_filtered", _DENSE.format(where="AND p.label IN (1, 3, 5) AND p.vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"))
def dense_topk_filtered(spark, d):
    e = table(spark, d, "embeddings")
    excluded = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return dense.dense_top(control.without(e.where(F.col("label").isin(1, 3, 5)), excluded, "vec_id"), _dense_queries(e), 10)


@register("l2_normalize", f"SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round({_unit('embedding')}[1], 6) AS first, round(list_sum({_unit('embedding')}), 6) AS total FROM embeddings")
def l2_normalize(spark, d):
    v = V.doubles(F.col("embedding"))
    e = table(spark, d, "embeddings").select("vec_id", v.alias("v")).withColumn("u", V.l2_normalize(F.col("v")))
    return e.select("vec_id", F.round(V.norm(F.col("v")), 6).alias("norm"), F.round(F.col("u")[0], 6).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@register("vector_validation", "SELECT label, count(*) AS n, sum(CAST(len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AS BIGINT))::BIGINT AS valid FROM embeddings GROUP BY label")
def vector_validation(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.sum(V.is_valid(F.col("embedding"), 64).cast("long")).alias("valid"))


# --- text ----------------------------------------------------------------------------------------------------------


@register("normalize_text", rf"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(nfc_normalize(html), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '{_SPACE}+', ' ', 'g'))) AS digest FROM pages")
def normalize_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(X.normalize_query(F.col("html")), 256).alias("digest"))


@register("tokenize_counts", f"SELECT doc_id, len({_terms('text')})::BIGINT AS n_tokens, len(list_distinct({_terms('text')}))::BIGINT AS n_terms FROM documents")
def tokenize_counts(spark, d):
    t = X.terms(F.col("text"))
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


@register("term_df", f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_terms('text')}) AS term FROM documents) GROUP BY term")
def term_df(spark, d):
    each = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(X.terms(F.col("text")))).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("df"))


@register("avg_doc_len", f"SELECT lang, count(*) AS n_docs, round(avg(len({_terms('text')})), 6) AS avgdl FROM documents GROUP BY lang")
def avg_doc_len(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n_docs"), F.round(F.avg(F.size(X.terms(F.col("text")))), 6).alias("avgdl"))


@register("embed_text", "SELECT doc_id, sha256(concat_ws(' › ', nullif(source, ''), nullif(lang, '')) || chr(10) || chr(10) || text) AS digest FROM documents")
def embed_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(X.embed_text(F.col("text"), F.array("source"), F.array("lang")), 256).alias("digest"))


@register("bounded_text", "SELECT doc_id, length(left(text, 4000))::BIGINT AS n, sha256(left(text, 4000)) AS digest FROM documents")
def bounded_text(spark, d):
    cut = X.bounded(F.col("text"), ranking.TEXT_CHARS)
    return table(spark, d, "documents").select("doc_id", F.length(cut).cast("long").alias("n"), F.sha2(cut, 256).alias("digest"))


@register("object_keys", r"SELECT p_partkey, 'documents/' || p_partkey || '/original/' || left(CASE WHEN s = '' THEN 'file' ELSE s END, 200) AS original_key, 'documents/' || p_partkey || '/parsed/document.md' AS markdown_key FROM (SELECT p_partkey, regexp_replace(regexp_replace(replace(trim(p_name), '..', '_'), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS s FROM part)")
def object_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", identity.original_key(F.col("p_partkey"), F.col("p_name")).alias("original_key"), identity.markdown_key(F.col("p_partkey")).alias("markdown_key"))


@register("token_hash", "SELECT user_id, sha256(CAST(user_id AS VARCHAR)) AS digest, count(*) AS n FROM events GROUP BY user_id")
def token_hash(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(identity.checksum(F.col("user_id").cast("string")).alias("digest"), F.count("*").alias("n"))


@register("rfc3339", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END || 'Z' AS moment FROM events")
def rfc3339(spark, d):
    return table(spark, d, "events").select("event_id", identity.rfc3339(F.col("ts")).alias("moment"))


# --- lexical -------------------------------------------------------------------------------------------------------


@register("bm25_weights", f"SELECT doc_id, term, round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / 400.0)), 6) AS weight FROM (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM (SELECT doc_id, {_terms('text')} AS t FROM documents)) GROUP BY ALL)")
def bm25_weights(spark, d):
    return lexical.encode(lexical.postings(table(spark, d, "documents")), 400).withColumn("weight", F.round("weight", 6))


def _asked(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").where(F.col("item_id") % EVERY == 0).select(F.col("item_id").alias("query_id"), "text")


@register("bm25_topk", f"WITH {_ASKED}, {_bm25('documents')} {_ranked('bm', 10)}")
def bm25_topk(spark, d):
    return lexical.bm25(table(spark, d, "documents"), _asked(spark, d), 10)


@register("bm25_filtered", f"WITH {_ASKED}, live AS (SELECT * FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), {_bm25('live')} {_ranked('bm', 10)}")
def bm25_filtered(spark, d):
    live = control.without(table(spark, d, "documents").where("lang = 'en'"), table(spark, d, "labels").where("toxic = 1"), "doc_id")
    return lexical.bm25(live, _asked(spark, d), 10)


@register("sparse_dot_topk", f"WITH {_ASKED}, {_sparse('documents', 'asked')} {_ranked('sp', 10)}")
def sparse_dot_topk(spark, d):
    return lexical.sparse_dot(table(spark, d, "documents"), _asked(spark, d), 10)


@register("bm25_stemmed")
def bm25_stemmed(spark, d):
    posted = lexical.stemmed(table(spark, d, "documents"))
    return lexical.encode(posted, 400).withColumn("weight", F.round("weight", 6))


@register("sparse_encoded")
def sparse_encoded(spark, d):
    posted = lexical.hashed(table(spark, d, "documents"))
    return lexical.encode(posted, 400, key="idx").withColumn("weight", F.round("weight", 6))


@register("sparse_top_weights", f"SELECT doc_id, token, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) AS rank FROM (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({_words('lower(text)')}) AS token FROM documents) GROUP BY ALL)) WHERE rank <= 8")
def sparse_top_weights(spark, d):
    return lexical.top_tokens(table(spark, d, "documents"), 8)


@register("dense_encoded")
def dense_encoded(spark, d):
    return table(spark, d, "documents").select("doc_id", encoders.dense_encoder(64)("text").alias("v")).select("doc_id", F.round(F.col("v")[0], 6).alias("first"), F.round(V.norm(F.col("v")), 6).alias("norm"))


# --- ranking -------------------------------------------------------------------------------------------------------

_LISTS = f"""WITH {_ASKED}, {_bm25('documents')}, {_sparse('documents', 'asked')},
  a AS ({_ranked('bm', 50)}), b AS ({_ranked('sp', 50)}),
  f AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60.0::DOUBLE + rank)) AS score, min(l) AS first_list FROM (SELECT query_id, doc_id, rank, 0::BIGINT AS l FROM a UNION ALL SELECT query_id, doc_id, rank, 1::BIGINT FROM b) GROUP BY ALL),
  fused AS (SELECT query_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank, first_list FROM f)"""
_RERANK = f""", cand AS (SELECT f.query_id, f.doc_id, list_distinct({_words('lower(q.text)')}) AS x, list_distinct({_words('lower(left(d.text, 4000))')}) AS y FROM fused f JOIN asked q USING (query_id) JOIN documents d USING (doc_id) WHERE rank <= 50),
  rr AS (SELECT query_id, doc_id, {_jaccard('x', 'y')} AS score FROM cand), top AS ({_ranked('rr', 10)})"""


def _two_lists(spark, d) -> list[DataFrame]:
    docs, asked = table(spark, d, "documents"), _asked(spark, d)
    matched = written(lexical.matches(docs, asked), "matches")
    return [lexical.bm25(docs, asked, 50, matched=matched), lexical.sparse_dot(docs, asked, 50, matched=matched)]


def _reranked(spark, d) -> DataFrame:
    fused = written(ranking.fuse(_two_lists(spark, d)), "fused")  # a table of known size, so that texts needn't be shuffled to meet it
    return ranking.rerank(search.candidates(table(spark, d, "documents"), _asked(spark, d), fused, 50), 10)


@register("rrf_fusion", f"{_LISTS} SELECT * FROM fused")
def rrf_fusion(spark, d):
    return ranking.fuse(_two_lists(spark, d))


@register("rerank_jaccard", f"{_LISTS}{_RERANK} SELECT * FROM top")
def rerank_jaccard(spark, d):
    return _reranked(spark, d)


@register("result_projection", f"{_LISTS}{_RERANK} SELECT query_id, 'S' || rank AS source_id, doc_id, left(text, 4000) AS text, score, rank FROM top JOIN documents USING (doc_id)")
def result_projection(spark, d):
    return ranking.results(written(_reranked(spark, d), "reranked"), table(spark, d, "documents").select("doc_id", "text"))


_POINTS = f"""pts AS (SELECT d.doc_id, d.text, e.embedding FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),
  asked AS (SELECT doc_id AS query_id, text, embedding FROM pts WHERE doc_id % {EVERY} = 0)"""


def _hybrid(asked: str = "asked", tag: str = "") -> str:
    """CTEs that end in fused over points for the queries; dl and sl are the two lists."""
    return f"""u{tag} AS (SELECT doc_id, {_unit("embedding")} AS v FROM pts), uq{tag} AS (SELECT query_id, {_unit("embedding")} AS v FROM {asked}),
  dn{tag} AS (SELECT query_id, doc_id, round(list_dot_product(uq{tag}.v, u{tag}.v), 9) AS score FROM uq{tag}, u{tag}),
  {_sparse('pts', asked)}, dl AS ({_ranked(f'dn{tag}', 50)}), sl AS ({_ranked('sp', 50)})"""


_FUSE = """f AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60.0::DOUBLE + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM dl UNION ALL SELECT query_id, doc_id, rank FROM sl) GROUP BY ALL),
  fused AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f)"""
_PTS_RERANK = _RERANK.replace("JOIN documents d", "JOIN pts d")
_META = """, m AS (SELECT query_id, (SELECT count(*) FROM dl WHERE dl.query_id = a.query_id) AS dense_candidates, (SELECT count(*) FROM sl WHERE sl.query_id = a.query_id) AS sparse_candidates,
  (SELECT max(score) FROM dl WHERE dl.query_id = a.query_id) AS top_dense_score, (SELECT max(score) FROM top WHERE top.query_id = a.query_id) AS top_rerank_score,
  (SELECT count(*) FROM top WHERE top.query_id = a.query_id) AS n_results FROM asked a)"""


def _points(spark, d) -> tuple[DataFrame, DataFrame]:
    pts = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    pts = written(pts, "points")  # one join of texts and vectors for all that reads them
    return pts, pts.where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query_id"), "text", "embedding")


@register("hybrid_search", f"WITH {_POINTS}, {_hybrid()}, {_FUSE}{_PTS_RERANK} SELECT query_id, 'S' || rank AS source_id, doc_id, left(text, 4000) AS text, score, rank FROM top JOIN pts USING (doc_id)")
def hybrid_search(spark, d):
    return search.search(*_points(spark, d))[0]


@register("low_confidence_gate", f"WITH {_POINTS}, {_hybrid()}, {_FUSE}{_PTS_RERANK}{_META} SELECT *, n_results > 0 AS reranked, CASE WHEN top_rerank_score IS NOT NULL THEN top_rerank_score < 0.45 ELSE coalesce(top_dense_score < 0.6, false) END AS low_confidence, n_results = 0 OR (n_results > 0 AND coalesce(top_rerank_score < 0.3, false)) AS needs_expansion FROM m")
def low_confidence_gate(spark, d):
    return search.search(*_points(spark, d))[1]


@register("expansion_fusion", f"""WITH {_POINTS}, va AS (SELECT query_id AS query_id, array_to_string({_words('text')}[1 : 8], ' ') AS text, embedding FROM asked),
  u AS (SELECT doc_id, {_unit("embedding")} AS v FROM pts), uq AS (SELECT query_id, {_unit("embedding")} AS v FROM va),
  dn AS (SELECT query_id, doc_id, round(list_dot_product(uq.v, u.v), 9) AS score FROM uq, u), {_sparse('pts', 'va')}, dl AS ({_ranked('dn', 50)}), sl AS ({_ranked('sp', 50)}), {_FUSE}
  SELECT query_id, doc_id, rank FROM fused""")
def expansion_fusion(spark, d):
    pts, asked = _points(spark, d)
    variants = asked.select("query_id", F.col("query_id").alias("variant_id"), F.array_join(F.slice(X.words(F.col("text")), 1, 8), " ").alias("text"), "embedding")
    return ranking.fuse(search.expansion_lists(pts, variants, 50)).select("query_id", "doc_id", "rank")

# --- the stored index ----------------------------------------------------------------------------------------------

#: Places of terms in the small index of these queries: the first 32 bits of a term's SHA-256.
_PLACES = 1 << 20


def _place(term: str) -> int:
    import hashlib

    return int(hashlib.sha256(term.encode()).hexdigest()[:8], 16) % _PLACES


#: Documents that a bucket of these indexes holds, about.
_BUCKET = 20_000
#: Indexes that were built in this process, by application and folder: one is stored once and searched by several queries.
_BUILT: dict[tuple[str, str], object] = {}


def _index(spark, d):
    """The index of all documents for searches."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        _BUILT[key] = _built_index(spark, d)
    return _BUILT[key]


def _built_index(spark, d):
    """A new index of all documents, a point each, in version 2."""
    from corvane.schemas import POINT
    from corvane.sources.index import PointIndex
    from corvane.sources.scratch import folder

    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("_v"), V.doubles(F.col("embedding")).alias("dense"))
    most = vectors.agg(F.max("_v")).first()[0] + 1
    docs = table(spark, d, "documents").withColumn("_v", F.col("doc_id") % most).join(vectors, "_v").withColumn("sparse", lexical.vector(F.col("text"), name=_place))
    given = {"id": F.format_string("p%09d", "doc_id"), "document_id": F.col("doc_id").cast("string"), "document_version": (F.col("doc_id") % 3 + 1).cast("int"), "index_version": F.lit(2), "chunk_index": F.lit(0).cast("long"), "filename": F.col("source"), "content_type": F.lit("text/plain"), "text": F.col("text"), "created_at": F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 100 as int))"), "dense": F.col("dense"), "sparse": F.col("sparse")}
    points = docs.select(*((given[f.name] if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in POINT))
    index = PointIndex(spark, folder(spark, "index"), buckets=max(8, -(-table(spark, d, "documents").count() // _BUCKET)), shards=4)
    index.ensure(2, 64)
    index.upsert(points)
    return index


def _index_requests(spark, d) -> DataFrame:
    """Benchmark items as requests with vectors."""
    most = table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("_v"), V.doubles(F.col("embedding")).alias("dense"))
    asked = _asked(spark, d).withColumn("sparse", lexical.vector(F.col("text"), name=_place)).withColumn("_v", F.col("query_id") % most)
    return asked.join(vectors, "_v").drop("_v")


def _index_sql(wanted: str = "true", seen: str = "true", k: int = 50) -> str:
    """CTEs that end in ir(query_id, doc_id, score, rank): the fused list of each request, and dn1, sp1 of its two lists."""
    sparse = lambda id, source: f"SELECT {id}, idx, sum(tf) * 2.2 / (sum(tf) + 1.2 * (0.25 + 0.75 * n / 400.0)) AS w FROM (SELECT {id}, n, ('0x' || substr(sha256(term), 1, 8))::BIGINT % {_PLACES} AS idx, count(*) AS tf FROM (SELECT {id}, len(t) AS n, unnest(t) AS term FROM (SELECT {id}, {_terms('text')} AS t FROM {source})) GROUP BY ALL) GROUP BY {id}, n, idx"
    return f"""{_ASKED}, most AS (SELECT max(vec_id) + 1 AS m FROM embeddings),
  dw AS ({sparse('doc_id', 'documents')}), qw AS ({sparse('query_id', 'asked')}),
  du AS (SELECT doc_id, {_unit("embedding")} AS v FROM documents, most JOIN embeddings ON vec_id = doc_id % m), qu AS (SELECT query_id, {_unit("embedding")} AS v FROM asked, most JOIN embeddings ON vec_id = query_id % m),
  dn0 AS (SELECT query_id, doc_id, round(list_dot_product(qu.v, du.v), 9) AS score FROM qu, du WHERE {wanted} AND {seen}),
  sp0 AS (SELECT query_id, doc_id, sum(qw.w * dw.w) AS score FROM qw JOIN dw USING (idx) WHERE {wanted} GROUP BY ALL),
  dn1 AS ({_ranked('dn0', k)}), sp1 AS ({_ranked('sp0', k)}),
  if0 AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60.0::DOUBLE + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM dn1 UNION ALL SELECT query_id, doc_id, rank FROM sp1) GROUP BY ALL),
  ir AS (SELECT query_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM if0)"""


_SHOWN = "query_id, 'S' || rank AS source_id, doc_id::VARCHAR AS document_id, score, rank"
_INDEX_RERANK = f""", cand AS (SELECT f.query_id, f.doc_id, list_distinct({_words('lower(q.text)')}) AS x, list_distinct({_words('lower(left(d.text, 4000))')}) AS y FROM ir f JOIN asked q USING (query_id) JOIN documents d USING (doc_id) WHERE rank <= 50),
  rr AS (SELECT query_id, doc_id, {_jaccard('x', 'y')} AS score FROM cand), top AS ({_ranked('rr', 10)})"""


@register("index_search", f"WITH {_index_sql()}{_INDEX_RERANK} SELECT {_SHOWN} FROM top")
def index_search(spark, d):
    """Hybrid search over the stored points and postings of the active version, reranked."""
    from corvane.plans.index_search import Options, search_index, word_overlap

    found, _ = search_index(_index(spark, d), _index_requests(spark, d), options=Options(rerank=word_overlap))
    return found.select("query_id", "source_id", "document_id", "score", "rank")


#: Filters by request: every second one asks for a version, every third for a span of days, every fifth for documents; toxic documents are excluded.
_WANTED = f"""doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND (query_id // {EVERY} % 2 = 1 OR doc_id % 3 + 1 = 2)
  AND (query_id // {EVERY} % 3 > 0 OR (doc_id % 100 >= 10 AND doc_id % 100 <= 70)) AND (query_id // {EVERY} % 5 > 0 OR doc_id % 4 = 1)"""


@register("index_search_filtered", f"WITH {_index_sql(_WANTED)} SELECT {_SHOWN} FROM ir WHERE rank <= 7 + query_id // {EVERY} % 4")
def index_search_filtered(spark, d):
    """Requests with filters and limits of their own; without a reranker the fused order stays."""
    from corvane.plans.index_search import search_index

    n = F.floor(F.col("query_id") / EVERY)
    day = lambda i: F.expr(f"timestamp'2024-01-01 00:00:00' + make_dt_interval({i})")
    named = table(spark, d, "documents").where("doc_id % 4 = 1").agg(F.collect_set(F.col("doc_id").cast("string")).alias("_named"))
    asked = _index_requests(spark, d).crossJoin(F.broadcast(named)).select(
        "query_id", "text", "dense", "sparse", F.when(n % 2 == 0, 2).alias("document_version"), F.when(n % 3 == 0, day(10)).alias("created_from"), F.when(n % 3 == 0, day(70)).alias("created_to"),
        F.when(n % 5 == 0, F.col("_named")).alias("document_ids"), (7 + n % 4).cast("int").alias("limit"),
    )
    excluded = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("document_id"))
    known = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"))
    found, _ = search_index(_index(spark, d), asked, known, excluded)
    return found.select("query_id", "source_id", "document_id", "score", "rank")


#: Requests whose reranking fails, and those whose dense encoder did.
_FAILED, _BLIND = f"query_id // {EVERY} % 2 = 1", f"query_id // {EVERY} % 3 = 0"


@register("rerank_fallback", f"""WITH {_index_sql(seen=f"NOT ({_BLIND})")}{_INDEX_RERANK}, m AS (SELECT query_id, NOT ({_FAILED}) AS reranked, NOT ({_BLIND}) AS dense_available,
    (SELECT count(*) FROM dn1 WHERE dn1.query_id = a.query_id) AS dense_candidates, (SELECT count(*) FROM sp1 WHERE sp1.query_id = a.query_id) AS sparse_candidates, (SELECT least(10, count(*)) FROM ir WHERE ir.query_id = a.query_id) AS n_results,
    (SELECT max(score) FROM dn1 WHERE dn1.query_id = a.query_id) AS top_dense_score, CASE WHEN {_FAILED} THEN NULL ELSE (SELECT max(score) FROM top WHERE top.query_id = a.query_id) END AS top_rerank_score FROM asked a)
  SELECT *, CASE WHEN top_rerank_score IS NOT NULL THEN top_rerank_score < 0.45 ELSE coalesce(dense_available AND top_dense_score < 0.6, false) END AS low_confidence FROM m""")
def rerank_fallback(spark, d):
    """What the meta rows declare where the reranker fails for some requests, and the dense encoder did for others."""
    from corvane.plans.index_search import Options, search_index, word_overlap

    def failing(candidates):
        told = word_overlap(candidates)
        return told.withColumn("error", F.when(F.expr(_FAILED.replace("//", "DIV")), "RERANK_TIMEOUT"))

    asked = _index_requests(spark, d).withColumn("dense", F.when(~F.expr(_BLIND.replace("//", "DIV")), F.col("dense")))
    _, meta = search_index(_index(spark, d), asked, options=Options(rerank=failing))
    return meta.select("query_id", "reranked", "dense_available", "dense_candidates", "sparse_candidates", "n_results", "top_dense_score", "top_rerank_score", "low_confidence")


@register("index_upsert", """SELECT index_version, document_version, count(*) AS n, CAST(sum(n_terms) AS BIGINT) AS n_terms FROM (
    SELECT 2 AS index_version, CAST(CASE WHEN doc_id % 4 = 0 THEN 9 ELSE doc_id % 3 + 1 END AS INTEGER) AS document_version, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE t END AS n_terms
    FROM (SELECT doc_id, len(list_distinct(list_transform(""" + _terms("text") + f""", lambda x: ('0x' || substr(sha256(x), 1, 8))::BIGINT % {_PLACES}))) AS t FROM documents) WHERE doc_id % 10 <> 3
  ) GROUP BY ALL""")
def index_upsert(spark, d):
    """Every fourth document written anew without terms, every tenth deleted: what the points and their postings then hold."""
    index = _built_index(spark, d)
    again = index.active().where(F.col("document_id").cast("long") % 4 == 0)
    index.upsert(again.withColumn("document_version", F.lit(9)).withColumn("sparse", F.slice("sparse", 1, 0)))
    index.delete_documents(index.active().where(F.col("document_id").cast("long") % 10 == 3).select("document_id"))
    posted = index.postings(2).select("bucket", F.explode("ords").alias("ord")).groupBy("bucket", "ord").agg(F.count("*").alias("t"))
    held = index.placed().select("index_version", "document_version", "bucket", "ord").join(posted, ["bucket", "ord"], "left")
    return held.groupBy("index_version", "document_version").agg(F.count("*").alias("n"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_terms"))


# --- structure -----------------------------------------------------------------------------------------------------

_WINDOWS = rf"""WITH p AS (SELECT doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '^{_SPACE}+', ''), '{_SPACE}+|[^\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+') AS p FROM documents),
  n AS (SELECT doc_id, p, (len(p) + 1) // 2 AS n FROM p), s AS (SELECT doc_id, p, n, unnest(range(0, CAST(ceil(greatest(n - {SIZE}, 0) / {SIZE - OVERLAP}.0) AS BIGINT) + 1)) AS chunk_index FROM n WHERE n > 0),
  w AS (SELECT doc_id, chunk_index, least({SIZE}, n - chunk_index * {SIZE - OVERLAP}) AS n_words, array_to_string(p[chunk_index * {2 * (SIZE - OVERLAP)} + 1 : chunk_index * {2 * (SIZE - OVERLAP)} + 2 * least({SIZE}, n - chunk_index * {SIZE - OVERLAP}) - 1], '') AS text FROM s)"""


def _windows(spark, d) -> DataFrame:
    return structure.word_windows(table(spark, d, "documents"), SIZE, OVERLAP)


@register("word_windows", f"{_WINDOWS} SELECT doc_id, chunk_index, CAST(n_words AS BIGINT) AS n_words, sha256(text) AS digest FROM w")
def word_windows(spark, d):
    return _windows(spark, d).select("doc_id", "chunk_index", "n_words", F.sha2("text", 256).alias("digest"))


@register("chunk_stats", f"{_WINDOWS} SELECT lang, count(*) AS n_chunks, CAST(sum(n_words) AS BIGINT) AS n_words, max(chunk_index) + 1 AS most FROM w JOIN documents USING (doc_id) GROUP BY lang")
def chunk_stats(spark, d):
    docs = table(spark, d, "documents")
    cut = structure.word_windows(docs.select("doc_id", "text"), SIZE, OVERLAP).drop("text").join(docs.select("doc_id", "lang"), "doc_id")
    return cut.groupBy("lang").agg(F.count("*").alias("n_chunks"), F.sum("n_words").alias("n_words"), (F.max("chunk_index") + 1).alias("most"))


_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@register("point_ids", f"{_WINDOWS} SELECT doc_id, chunk_index, {_UUID} AS point_id FROM (SELECT doc_id, chunk_index, sha1(unhex('{identity.POINT_NAMESPACE.replace('-', '')}') || encode(doc_id || ':1:1:' || chunk_index)) AS h FROM w)")
def point_ids(spark, d):
    return _windows(spark, d).select("doc_id", "chunk_index", identity.point_id(F.col("doc_id"), F.lit(1), F.lit(1), F.col("chunk_index")).alias("point_id"))


#: Characters that end lines beside the line feed, and those that mean something in Markdown.
_BREAKS, _MARKS = r"[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", "|#*_`"


def _markdown(spark, d) -> DataFrame:
    """A Markdown file of each document: two headings, its text, a captioned table of its words by eight, and a last section."""
    blank = X.BREAKS.replace("\n", "") + _MARKS
    clean = F.translate(F.coalesce("text", F.lit("")), blank, " " * len(blank))
    eight = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 8).cast("int")), lambda i: F.slice("w", i * 8 + 1, 8))
    rows = F.transform(eight, lambda x: F.concat(F.lit("| "), F.array_join(x, " "), F.lit(" | "), F.size(x).cast("string"), F.lit(" |")))
    said = F.when(F.size("w") > 0, F.array_join(rows, "\n")).otherwise(F.lit(""))
    whole = F.concat(F.lit("# S"), "source", F.lit("\n\n## L"), "lang", F.lit("\n\n"), F.col("clean"), F.lit("\n\nTable "), F.col("doc_id").cast("string"), F.lit("\n| words | n |\n|---|---:|\n"), said, F.lit("\n\n# End\n\ndone\n"))
    return table(spark, d, "documents").withColumn("clean", clean).withColumn("w", X.words(F.col("clean"))).select("doc_id", whole.alias("text"))


_MD = rf"""WITH c AS (SELECT doc_id, source, lang, translate(regexp_replace(coalesce(text, ''), '{_BREAKS}', ' ', 'g'), '{_MARKS}', '{" " * len(_MARKS)}') AS clean FROM documents),
  md AS (SELECT *, {_words('clean')} AS w FROM c),
  r AS (SELECT doc_id, source, lang, i, w[i * 8 + 1 : i * 8 + 8] AS e FROM (SELECT *, unnest(range(0, (len(w) + 7) // 8)) AS i FROM md))"""


@register("table_facts", f"{_MD} SELECT doc_id, i AS fact, 'Table ' || doc_id AS caption, concat('S', source, ' / L', lang) AS path, concat('Table ', doc_id, '. words: ', array_to_string(e, ' '), '; n: ', len(e), '.') AS text FROM r")
def table_facts(spark, d):
    told = structure.facts(_markdown(spark, d), whole=False)
    return told.select("doc_id", "fact", "caption", F.array_join("section_path", " / ").alias("path"), "text")


#: Chunks: word windows of the text and the caption, groups of 42 table rows (a row has up to 12 words, and 507 are left beside the header), and the last section.
@register("table_chunks", rf"""{_MD}, p AS (SELECT doc_id, source, lang, regexp_extract_all(regexp_replace(concat(clean, chr(10), chr(10), 'Table ', doc_id), '^{_SPACE}+', ''), '{_SPACE}+|[^\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+') AS p FROM md),
  n AS (SELECT *, (len(p) + 1) // 2 AS n FROM p), s AS (SELECT *, unnest(range(0, CAST(ceil(greatest(n - {SIZE}, 0) / {SIZE - OVERLAP}.0) AS BIGINT) + 1)) AS k FROM n),
  prose AS (SELECT doc_id, k AS o, k, least({SIZE}, n - k * {SIZE - OVERLAP}) AS token_count, concat('S', source, ' / L', lang) AS path, 'prose' AS kind, array_to_string(p[k * {2 * (SIZE - OVERLAP)} + 1 : k * {2 * (SIZE - OVERLAP)} + 2 * least({SIZE}, n - k * {SIZE - OVERLAP}) - 1], '') AS text FROM s),
  t AS (SELECT doc_id, any_value(source) AS source, any_value(lang) AS lang, coalesce(i // 42, 0) AS k, count(i) AS rows, coalesce(sum(len(e) + 4), 0) AS words, string_agg(concat('| ', array_to_string(e, ' '), ' | ', len(e), ' |'), chr(10) ORDER BY i) AS body FROM (SELECT md.doc_id, md.source, md.lang, r.i, r.e FROM md LEFT JOIN r USING (doc_id)) GROUP BY doc_id, coalesce(i // 42, 0)),
  tables AS (SELECT doc_id, 1000000 + k AS o, k, 6 + words AS token_count, concat('S', source, ' / L', lang) AS path, 'table' AS kind, concat('| words | n |', chr(10), '|---|---:|', CASE WHEN rows > 0 THEN concat(chr(10), body) ELSE '' END) AS text FROM t),
  ends AS (SELECT doc_id, 2000000 AS o, 0 AS k, 1 AS token_count, 'End' AS path, 'prose' AS kind, 'done' AS text FROM md)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS chunk_index, CAST(token_count AS BIGINT) AS token_count, path, kind, sha256(text) AS digest FROM (SELECT * FROM prose UNION ALL SELECT * FROM tables UNION ALL SELECT * FROM ends)
  UNION ALL SELECT doc_id, {identity.FACT_BASE} + i, CAST(len(e) + 5 AS BIGINT), concat('S', source, ' / L', lang), 'fact', sha256(concat('Table ', doc_id, '. words: ', array_to_string(e, ' '), '; n: ', len(e), '.')) FROM r""")
def table_chunks(spark, d):
    cut = structure.units(_markdown(spark, d), SIZE, OVERLAP, whole=False)
    return cut.select("doc_id", "chunk_index", "token_count", F.array_join("section_path", " / ").alias("path"), "kind", F.sha2("text", 256).alias("digest"))


@register("section_paths", rf"""{_MD}, l AS (SELECT doc_id, source, lang, len(string_split(clean, chr(10))) AS t, (len(w) + 7) // 8 AS n FROM md),
  e AS (SELECT *, unnest(range(0, 4 + t + 2 + 2 + greatest(n, 1) + 4)) AS line FROM l)
  SELECT doc_id, line, CASE WHEN line < 2 THEN concat('S', source) WHEN line < 4 + t + 2 + 2 + greatest(n, 1) + 1 THEN concat('S', source, ' / L', lang) ELSE 'End' END AS path, CAST(line >= 4 + t + 2 AS BIGINT) AS segment FROM e""")
def section_paths(spark, d):
    lined = structure.lines(_markdown(spark, d))
    return structure.outlined(lined).select("doc_id", F.col("line").cast("long").alias("line"), F.array_join("path", " / ").alias("path"), "segment")


@register("document_lines", r"SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(contains(l, '|') AND trim(l) <> '' AS BIGINT)) AS BIGINT) AS n_rows FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) AS l FROM documents WHERE text <> '') GROUP BY doc_id")
def document_lines(spark, d):
    lined = structure.lines(table(spark, d, "documents").where("text != ''").select("doc_id", "text"))
    return lined.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.col("row").cast("long")).alias("n_rows"))


# --- control -------------------------------------------------------------------------------------------------------


@register("checksum_dedup", "SELECT sha256(text) AS checksum, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def checksum_dedup(spark, d):
    return control.first_copies(table(spark, d, "documents"), identity.checksum(F.col("text")), "doc_id")


@register("find_recent", "SELECT o_orderkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND contains(lower(o_orderpriority), 'urgent') ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def find_recent(spark, d):
    found = control.find(table(spark, d, "orders"), status=F.col("o_orderstatus") == "O", name="URGENT", filename="o_orderpriority", newest=(F.desc("o_orderdate"), F.asc("o_orderkey")))
    return found.select("o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority")


@register("stale_rows", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' AND o_orderdate IS NOT NULL AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY")
def stale_rows(spark, d):
    orders = table(spark, d, "orders")
    last = F.broadcast(orders.agg((F.max("o_orderdate") - F.expr("INTERVAL 365 DAY")).alias("cutoff")))  # one row
    return control.stale(orders.crossJoin(last), F.col("o_orderstatus") == "P", "o_orderdate", F.col("cutoff")).select("o_orderkey", "o_orderdate")


@register("exclusion_anti_join", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def exclusion_anti_join(spark, d):
    return control.without(table(spark, d, "documents"), table(spark, d, "labels").where("toxic = 1"), "doc_id").select("doc_id", "source")


@register("membership_semi_join", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def membership_semi_join(spark, d):
    return control_semi(table(spark, d, "documents"), table(spark, d, "labels").where("quality = 1"), "doc_id").select("doc_id", "lang")


def control_semi(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


@register("latest_active_job", "SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('view', 'click', 'purchase')) WHERE n = 1")
def latest_active_job(spark, d):
    live = table(spark, d, "events").where(F.col("event_type").isin("view", "click", "purchase"))
    return control.newest_each(live, "user_id", (F.desc("ts"), F.desc("event_id"))).select("user_id", "event_id", "event_type", "ts")


@register("inbox_dedup", "SELECT event_id, event_type AS consumer FROM events WHERE event_id % 3 <> 0")
def inbox_dedup(spark, d):
    events = table(spark, d, "events").select("event_id", F.col("event_type").alias("consumer"))
    again = events.unionByName(events.where("event_id % 2 = 0"))  # redelivered ones
    return control.unseen(again, events.where("event_id % 3 = 0")).select("event_id", "consumer")


@register("retry_backoff", "SELECT event_id, a AS attempt, list_element([0.0, 1.0, 3.0, 10.0, 30.0], CAST(least(a, 4) AS BIGINT) + 1)::DOUBLE + 0.5::DOUBLE * (a % 3) / 2.0::DOUBLE AS delay FROM (SELECT event_id, CAST(event_id % 7 AS BIGINT) AS a FROM events)")
def retry_backoff(spark, d):
    return table(spark, d, "events").select("event_id", (F.col("event_id") % 7).alias("attempt")).withColumn("delay", control.backoff(F.col("attempt"), jitter=0.5))


@register("dead_letter_split", "SELECT route, count(*) AS n, CAST(sum(a + 1) AS BIGINT) AS attempts FROM (SELECT event_id % 7 AS a, CASE WHEN value >= 20 AND event_id % 7 + 1 < 5 THEN 'retry' ELSE 'dead_letter' END AS route FROM events) GROUP BY route")
def dead_letter_split(spark, d):
    failed = table(spark, d, "events").select((F.col("event_id") % 7).alias("attempt"), (F.col("value") >= 20).alias("retryable"))
    return control.after_failure(failed).groupBy("route").agg(F.count("*").alias("n"), F.sum("next_attempt").alias("attempts"))


@register("outbox_pending", "SELECT event_id, available_at FROM (SELECT CAST(event_id AS VARCHAR) AS event_id, ts AS available_at, event_type FROM events) WHERE event_type = 'click' AND available_at <= TIMESTAMP '2024-01-15 00:00:00' ORDER BY available_at, event_id LIMIT 50")
def outbox_pending(spark, d):
    outbox = table(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("ts").alias("available_at"), F.when(F.col("event_type") == "click", "PENDING").otherwise("PUBLISHED").alias("status"))
    return control.pending(outbox, F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id", "available_at")


_STATE = "['UPLOADING', 'UPLOADED', 'QUEUED', 'PROCESSING', 'READY', 'FAILED', 'REINDEXING', 'DELETING', 'DELETE_FAILED', 'DELETED']"


@register("state_transitions", f"""WITH t AS (SELECT event_id, {_STATE}[CAST(event_id % 10 AS BIGINT) + 1] AS a, {_STATE}[CAST(event_id // 10 % 10 AS BIGINT) + 1] AS b FROM events),
  ok AS (SELECT * FROM (VALUES ('UPLOADING', 'UPLOADED'), ('UPLOADED', 'QUEUED'), ('FAILED', 'QUEUED'), ('QUEUED', 'PROCESSING'), ('PROCESSING', 'PROCESSING'), ('UPLOADED', 'PROCESSING'), ('FAILED', 'PROCESSING'), ('PROCESSING', 'READY'), ('REINDEXING', 'READY'), ('READY', 'READY'),
    ('UPLOADED', 'REINDEXING'), ('FAILED', 'REINDEXING'), ('READY', 'REINDEXING'), ('REINDEXING', 'REINDEXING'), ('UPLOADED', 'DELETING'), ('FAILED', 'DELETING'), ('READY', 'DELETING'), ('DELETE_FAILED', 'DELETING'), ('DELETING', 'DELETING'), ('DELETING', 'DELETED'),
    ('UPLOADING', 'FAILED'), ('UPLOADED', 'FAILED'), ('QUEUED', 'FAILED'), ('PROCESSING', 'FAILED'), ('DELETING', 'DELETE_FAILED')) v(a, b))
  SELECT event_id AS id, CASE WHEN ok.a IS NULL THEN t.a ELSE t.b END AS status, CAST(CASE WHEN ok.a IS NULL THEN 0 ELSE 1 END AS BIGINT) AS row_version, ok.a IS NULL AS illegal FROM t LEFT JOIN ok ON t.a = ok.a AND t.b = ok.b""")
def state_transitions(spark, d):
    names = F.array(*(F.lit(s) for s in DOCUMENT_STATES))
    state = lambda n: F.element_at(names, (n % 10 + 1).cast("int"))
    events = table(spark, d, "events").select(F.col("event_id").alias("id"))
    docs = events.select("id", state(F.col("id")).alias("status"), F.lit(0).cast("long").alias("row_version"))
    return control.transition(docs, events.select("id", state(F.floor(F.col("id") / 10)).alias("to")))


_JOBS = "SELECT event_id AS id, ['QUEUED', 'PROCESSING', 'COMPLETED', 'CANCELLED'][CAST(event_id % 4 AS BIGINT) + 1] AS status, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'w' || (event_id % 3) END AS lease_owner, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS lease_expires_at, event_id % 11 = 0 AS cancel_requested FROM events"
_NOW = "2024-01-16 00:00:00"


def _jobs(spark, d) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events").select(
        i.alias("id"), F.element_at(F.array(*(F.lit(s) for s in ("QUEUED", "PROCESSING", "COMPLETED", "CANCELLED"))), (i % 4 + 1).cast("int")).alias("status"),
        F.when(i % 5 != 0, F.concat(F.lit("w"), (i % 3).cast("string"))).alias("lease_owner"), F.when(i % 5 != 0, F.col("ts")).alias("lease_expires_at"), (i % 11 == 0).alias("cancel_requested"),
    )


@register("job_leases", f"SELECT lease, status, count(*) AS n, count(DISTINCT lease_owner) AS owners FROM (SELECT *, CASE WHEN status IN ('COMPLETED', 'CANCELLED') THEN 'passthrough' WHEN coalesce(lease_expires_at > TIMESTAMP '{_NOW}', false) AND lease_owner IS DISTINCT FROM 'w1' THEN 'refused' ELSE 'taken' END AS lease FROM ({_JOBS})) GROUP BY ALL")
def job_leases(spark, d):
    jobs = _jobs(spark, d).withColumn("heartbeat_at", F.lit(None).cast("timestamp"))
    leased = control.lease(jobs, "w1", F.lit(_NOW).cast("timestamp"), 60).drop("lease_owner").join(jobs.select("id", "lease_owner"), "id")
    return leased.groupBy("lease", "status").agg(F.count("*").alias("n"), F.countDistinct("lease_owner").alias("owners"))


@register("job_recovery", f"SELECT CASE WHEN e AND cancel_requested THEN 'CANCELLED' WHEN e THEN 'QUEUED' ELSE status END AS status, e AS recovered, count(*) AS n FROM (SELECT *, coalesce(status = 'PROCESSING' AND lease_expires_at < TIMESTAMP '{_NOW}', false) AS e FROM ({_JOBS})) GROUP BY ALL")
def job_recovery(spark, d):
    return control.recover(_jobs(spark, d), F.lit(_NOW).cast("timestamp")).groupBy("status", F.coalesce("recovered", F.lit(False)).alias("recovered")).agg(F.count("*").alias("n"))


@register("upload_checks", "SELECT coalesce(error, 'OK') AS error, count(*) AS n FROM (SELECT CASE WHEN NOT n_chars > 0 THEN 'EMPTY' WHEN n_chars > 5000 THEN 'FILE_TOO_LARGE' WHEN lang NOT IN ('en', 'de') THEN 'UNSUPPORTED_FILE' END AS error FROM documents) GROUP BY 1")
def upload_checks(spark, d):
    error = control.upload_error(F.col("n_chars"), F.col("lang"), ("en", "de"), 5000)
    return table(spark, d, "documents").groupBy(F.coalesce(error, F.lit("OK")).alias("error")).agg(F.count("*").alias("n"))


# --- evaluation, index versions, streams ---------------------------------------------------------------------------

_GOLD = "left(b.text, 40)"


def _hit_ranks(spark, d) -> DataFrame:
    docs, asked = table(spark, d, "documents"), _asked(spark, d)
    ranked = written(lexical.bm25(docs, asked, 10), "ranked")  # a table of known size, so that texts needn't be shuffled to meet it
    ranked = written(ranked.join(docs.select("doc_id", "text"), "doc_id"), "hits")
    gold = asked.select("query_id", F.array(F.left("text", F.lit(40))).alias("needles"))
    return evaluate.first_hits(asked, evaluate.relevant(ranked, gold))


_HITS = f"WITH {_ASKED}, {_bm25('documents')}, top AS ({_ranked('bm', 10)}), h AS (SELECT a.query_id, min(rank) FILTER (WHERE contains(d.text, left(a.text, 40))) AS hit_rank FROM asked a LEFT JOIN top USING (query_id) LEFT JOIN documents d ON d.doc_id = top.doc_id GROUP BY 1)"


@register("first_hits", f"{_HITS} SELECT query_id, coalesce(hit_rank, 0) AS hit_rank FROM h")
def first_hits(spark, d):
    return _hit_ranks(spark, d).select("query_id", F.coalesce("hit_rank", F.lit(0)).alias("hit_rank"))


@register("recall_at_k", f"{_HITS} SELECT count(*) AS n_cases, round(avg(CAST(coalesce(hit_rank <= 10, false) AS DOUBLE)), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / hit_rank, 0.0)), 6) AS mrr FROM h")
def recall_at_k(spark, d):
    return evaluate.report(_hit_ranks(spark, d))


@register("version_counts", f"{_WINDOWS}, v AS (SELECT doc_id, doc_id % 3 + 1 AS index_version FROM w) SELECT index_version, doc_id, count(*) AS n FROM v GROUP BY ALL")
def version_counts(spark, d):
    return _windows(spark, d).groupBy((F.col("doc_id") % 3 + 1).alias("index_version"), "doc_id").agg(F.count("*").alias("n"))


@register("reindex_cutover", f"{_WINDOWS} SELECT CAST(2 AS INTEGER) AS index_version, source, count(*) AS n FROM w JOIN documents USING (doc_id) GROUP BY ALL")
def reindex_cutover(spark, d):
    """Two versions of all windows; after the cutover the first is gone."""
    from corvane.plans.versions import cutover_counts

    return cutover_counts(_windows(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id"))


@register("stream_ingest_counts", "SELECT event_type, count(*) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events GROUP BY event_type")
def stream_ingest_counts(spark, d):
    """The events table read as a stream of files, deduplicated by id, counted by kind."""
    from corvane.sources.scratch import folder

    source = table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/events*.parquet")
    seen = stream.dropDuplicates(["event_id"]).select("event_type", "user_id")
    sink = folder(spark, "stream")
    seen.writeStream.format("parquet").option("path", f"{sink}/rows").option("checkpointLocation", f"{sink}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(seen.schema).parquet(f"{sink}/rows").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@register("event_hours", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_hours(spark, d):
    from corvane.streaming.consume import counts

    return counts(table(spark, d, "events"), "event_type", "ts").select(F.col("window.start").alias("hour"), "event_type", "n")


#: Kinds of control events that the table's kinds stand for here; views have no document, and purchases aren't JSON.
_KINDS = {"click": "DocumentIngestionRequested", "signup": "DocumentDeleted", "error": "Nonsense", "view": "DocumentReindexRequested", "purchase": "DocumentReindexFailed"}


@register("event_parse", "SELECT coalesce(error, 'OK') AS error, event_type, count(*) AS n, CAST(sum(CASE WHEN error IS NULL OR error <> 'BROKEN' THEN user_id ELSE 0 END) AS BIGINT) AS users FROM (SELECT user_id, CASE WHEN event_type = 'purchase' THEN NULL ELSE CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items()) + """ ELSE 'Other' END END AS event_type,
    CASE WHEN event_type IN ('click', 'signup') THEN NULL WHEN event_type IN ('view', 'purchase') THEN 'INVALID_EVENT' ELSE 'UNKNOWN_EVENT' END AS error FROM events) GROUP BY 1, 2""")  # fmt: skip
def event_parse(spark, d):
    """Events as JSON lines, parsed and typed; each line's user is kept beside it."""
    from corvane.sources.parsers import parse_events

    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in _KINDS.items() for x in pair)), F.col("event_type")), F.lit("Other"))
    line = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.col("event_id").cast("string").alias("event_id"), kind.alias("event_type"), F.lit("hr").alias("domain"), F.when(F.col("event_type") != "view", F.col("user_id").cast("string")).alias("document_id")))
    lines = table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "purchase", F.concat(F.lit("?"), line)).otherwise(line).alias("value"))
    told = parse_events(lines, "value", "user_id")
    return told.groupBy(F.coalesce("error", F.lit("OK")).alias("error"), "event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


# --- lifecycle -----------------------------------------------------------------------------------------------------


@register("document_chunks", f"{_WINDOWS} SELECT doc_id, chunk_index, CAST(n_words AS BIGINT) AS token_count, sha256(text) AS digest FROM w")
def document_chunks(spark, d):
    """The whole structure plan over the documents, which have neither headings nor tables."""
    cut = structure.chunks(table(spark, d, "documents").select("doc_id", "text"), SIZE, OVERLAP)
    return cut.select("doc_id", "chunk_index", "token_count", F.sha2("text", 256).alias("digest"))


@register("prepare_uploads", """SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN error IS NULL THEN 'UPLOADING' END AS status, 'documents/' || doc_id || '/original/' || source AS original_object_key, error
  FROM (SELECT doc_id, source, CASE WHEN NOT n_chars > 0 THEN 'EMPTY' WHEN n_chars > 52428800 THEN 'FILE_TOO_LARGE' WHEN lang IN ('fr', 'es') THEN 'UNSUPPORTED_FILE' END AS error FROM documents)""")
def prepare_uploads(spark, d):
    kind = F.when(F.col("lang").isin("fr", "es"), "text/html").otherwise("text/plain")
    requests = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("filename"), kind.alias("content_type"), F.col("n_chars").alias("size"))
    return lifecycle.prepare_uploads(requests, F.lit(_NOW).cast("timestamp")).select("id", "status", "original_object_key", "error")


def _control_documents(spark, d) -> DataFrame:
    state = F.element_at(F.array(*(F.lit(s) for s in DOCUMENT_STATES)), (F.col("doc_id") % 10 + 1).cast("int"))
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), state.alias("status"), F.lit(0).alias("row_version"))


def _requests(spark, d) -> DataFrame:
    """Two requests for each event: by a key that an even id and the next one share, and by a key of its own."""
    i = F.col("event_id")
    keys = F.array(F.concat(F.lit("k"), (i - i % 2).cast("string")), F.concat(F.lit("l"), i.cast("string")))
    return table(spark, d, "events").select(i.cast("string").alias("document_id"), F.explode(keys).alias("idempotency_key"))


#: Two documents share a key: the first in order takes it if it can start, else it is left to the second; keys of their own come after it.
_STARTS = """WITH r AS (SELECT event_id, event_id - event_id % 2 AS pair, {reason} AS why FROM (SELECT DISTINCT event_id FROM events) LEFT JOIN documents ON doc_id = event_id),
  o AS (SELECT why, row_number() OVER w = 1 AS leads, first_value(why) OVER w IS NULL AS lead_starts FROM r WINDOW w AS (PARTITION BY pair ORDER BY CAST(event_id AS VARCHAR))),
  a AS (SELECT CASE WHEN NOT leads AND lead_starts THEN 'IDEMPOTENCY_CONFLICT' ELSE coalesce(why, 'started') END AS outcome FROM o
    UNION ALL SELECT coalesce(why, CASE WHEN NOT leads AND lead_starts THEN 'started' ELSE 'INVALID_STATE' END) FROM o)
  SELECT outcome, count(*) AS n FROM a GROUP BY 1"""


@register("start_deletions", _STARTS.format(reason=f"CASE WHEN doc_id IS NULL THEN 'NOT_FOUND' WHEN {_STATE}[CAST(doc_id % 10 AS BIGINT) + 1] NOT IN ('UPLOADED', 'FAILED', 'READY', 'DELETE_FAILED') THEN 'INVALID_STATE' END"))
def start_deletions(spark, d):
    told, _, _ = lifecycle.start_deletion(_control_documents(spark, d), spark.createDataFrame([], JOB), _requests(spark, d), F.lit(_NOW).cast("timestamp"))
    return told.groupBy("outcome").agg(F.count("*").alias("n"))


@register("start_ingestion", _STARTS.format(reason=f"""CASE WHEN doc_id IS NULL THEN 'NOT_FOUND' WHEN doc_id % 13 = 0 THEN 'OBJECT_MISSING' WHEN doc_id % 7 = 0 THEN 'SIZE_MISMATCH' WHEN doc_id % 3 = 0 AND doc_id % 5 = 0 THEN 'CHECKSUM_CONFLICT'
  WHEN {_STATE}[CAST(doc_id % 10 AS BIGINT) + 1] NOT IN ('UPLOADING', 'UPLOADED', 'FAILED') THEN 'INVALID_STATE' END"""))
def start_ingestion(spark, d):
    """Requests for objects of which some are missing, some have another size than declared, and some another checksum."""
    i, own = F.col("doc_id"), identity.checksum(F.col("text"))
    told = table(spark, d, "documents").select(i.cast("string").alias("id"), F.col("n_chars").alias("size"), F.when(i % 3 == 0, own).alias("checksum"))
    documents = _control_documents(spark, d).join(told, "id")
    objects = table(spark, d, "documents").where("doc_id % 13 <> 0").select(i.cast("string").alias("document_id"), (F.col("n_chars") + F.when(i % 7 == 0, 1).otherwise(0)).alias("object_size"))
    given = table(spark, d, "documents").select(i.cast("string").alias("document_id"), F.when(i % 5 == 0, "another").otherwise(own).alias("checksum"))
    requests = _requests(spark, d).join(given, "document_id", "left")
    outcomes, _, _ = lifecycle.start_ingestion(documents, spark.createDataFrame([], JOB), requests, F.lit(_NOW).cast("timestamp"), objects)
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


@register("deleted_documents", f"""WITH s AS (SELECT doc_id, {_STATE}[CAST(doc_id % 10 AS BIGINT) + 1] AS s FROM documents),
  g AS (SELECT s.*, s IN ('UPLOADED', 'FAILED', 'READY', 'DELETE_FAILED') AND doc_id IN (SELECT event_id FROM events) AS gone FROM s)
  SELECT CASE WHEN gone THEN 'DELETED' ELSE s END AS status, CASE WHEN gone THEN 2 ELSE 0 END AS row_version, count(*) AS n FROM g GROUP BY 1, 2""")
def deleted_documents(spark, d):
    """Deletion from request to end: the documents' states after it."""
    now = F.lit(_NOW).cast("timestamp")
    _, jobs, docs = lifecycle.start_deletion(_control_documents(spark, d), spark.createDataFrame([], JOB), _requests(spark, d), now)
    docs, _ = lifecycle.finish(docs, jobs, jobs.select(F.col("id").alias("job_id")))
    return docs.groupBy("status", "row_version").agg(F.count("*").alias("n"))


@register("requested_ids", "SELECT event_id AS doc_id, event_type FROM events WHERE event_id NOT IN (SELECT doc_id FROM documents)")
def requested_ids(spark, d):
    """Requested documents that don't exist: a Bloom filter of the documents, and an exact join for what passes it."""
    from corvane.operators.membership import missing_members

    asked = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), "event_type")
    return missing_members(asked, table(spark, d, "documents").select("doc_id"), "doc_id")


@register("ingest_duplicates", "SELECT lang, count(*) AS n, CAST(sum(CAST(sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) AS BIGINT)) AS BIGINT) AS known FROM documents WHERE doc_id % 2 = 1 GROUP BY lang")
def ingest_duplicates(spark, d):
    """Of the odd documents those whose content an even one has: which ones ingestion need not index again."""
    from corvane.operators.membership import split
    from corvane.sources.scratch import written

    docs = written(table(spark, d, "documents").select("doc_id", "lang", identity.checksum(F.col("text")).alias("checksum")), "checksums")
    known, new = split(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0"), "checksum")
    both = known.select("lang", F.lit(1).cast("long").alias("k")).unionByName(new.select("lang", F.lit(0).cast("long").alias("k")))
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.sum("k").alias("known"))


@register("document_metadata", f"""WITH e AS (SELECT DISTINCT user_id * 7 AS i FROM events)
  SELECT CAST(i AS VARCHAR) AS document_id, {_STATE}[CAST(doc_id % 10 AS BIGINT) + 1] AS status, n_chars AS size, sha256(text) AS checksum, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id), '%Y-%m-%dT%H:%M:%SZ') AS created_at,
    CASE WHEN doc_id IS NULL THEN 'NOT_FOUND' END AS error FROM e LEFT JOIN documents ON doc_id = i""")
def document_metadata(spark, d):
    """Metadata of ids that events name, of which some are no documents."""
    from corvane.plans import documents

    i = F.col("doc_id")
    moment = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id)")
    told = table(spark, d, "documents").select(i.cast("string").alias("id"), F.col("n_chars").alias("size"), identity.checksum(F.col("text")).alias("checksum"), moment.alias("created_at"))
    asked = table(spark, d, "events").select((F.col("user_id") * 7).cast("string").alias("document_id"))
    return documents.document_metadata(_control_documents(spark, d).join(told, "id"), asked).select("document_id", "status", "size", "checksum", "created_at", "error")


@register("retrieve_points", f"SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE doc_id % {EVERY} = 0)")
def retrieve_points(spark, d):
    wanted = table(spark, d, "documents").where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("vec_id"))
    return control_semi(table(spark, d, "embeddings"), wanted, "vec_id").select("vec_id", "label")


@register("search_requests", "SELECT item_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'EMPTY_QUERY' WHEN length(text) > 4000 THEN 'QUERY_TOO_LONG' WHEN item_id % 60 < 1 OR item_id % 60 > 50 THEN 'BAD_LIMIT' WHEN item_id % 250 < 1 OR item_id % 250 > 200 OR item_id % 250 < item_id % 60 THEN 'BAD_CANDIDATES' END AS error FROM benchmark")
def search_requests(spark, d):
    i = F.col("item_id")
    return table(spark, d, "benchmark").select("item_id", control.request_error(F.col("text"), i % 60, i % 250).alias("error"))
