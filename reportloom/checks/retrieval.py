"""Checks of the term index and of search, on reports and on the text corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportloom.checks import base as B
from reportloom.checks.base import with_
from reportloom.checks.ingest import DOC_PACKED, stored_chunks
from reportloom.checks.registry import check
from reportloom.functions import text as T, vocab as V
from reportloom.operators import chunk as C, nearest, retrieve as R
from reportloom.plans.store import stored
from reportloom.sources import corpus, render

QUESTIONS = ("Which medications does the letter list?", "What is the glucose value?",
             "What was the blood pressure?", "Is an apolipoprotein ratio given?")


def report_questions(spark, sf_dir):
    """One question per report, asked over that report."""
    orders = corpus.read_table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("query_id"), F.col("o_orderkey").alias("scope_id"),
                         render.pick(QUESTIONS, F.col("o_orderkey") % 4).alias("question"))


def report_index(spark, sf_dir):
    def build():
        scopes = corpus.read_table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("scope_id"), F.col("o_orderkey").alias("doc_id"))
        return R.build_index(stored_chunks(spark, sf_dir), scopes)
    index = stored(spark, sf_dir, "report index", build=build)
    return index.chunks, index


def corpus_chunks(spark, sf_dir):
    packed = C.pack_sentences(T.split_sentences(F.col("text")))
    return corpus.read_corpus(spark, sf_dir).select(
        "doc_id", F.posexplode(packed).alias("chunk_index", "text")).select(
        "doc_id", "chunk_index", F.lit(1).alias("page_number"),
        F.lit(None).cast("string").alias("section_title"), "text", F.lit(False).alias("is_table_chunk"))


def passages(spark, sf_dir):
    """Benchmark passages asked over the whole corpus."""
    return corpus.read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.lit(0).cast("long").alias("scope_id"),
        F.col("text").alias("question"))


def corpus_index(spark, sf_dir):
    def build():
        scopes = corpus.read_table(spark, sf_dir, "documents").select(
            F.lit(0).cast("long").alias("scope_id"), "doc_id")
        return R.build_index(corpus_chunks(spark, sf_dir), scopes)
    return stored(spark, sf_dir, "corpus index", build=build)


# --- SQL -----------------------------------------------------------------------------

_MULTI = {}
for _a, _full in V.ABBREVIATIONS.items():
    if 2 <= len(_full.split()) <= 4 and _full == _full.lower():
        _MULTI.setdefault(_full, []).append(_a)
_SHORT_ROWS = ", ".join(f"({B.quote(a)}, 1, 0, {B.quote(f)})" for a, f in V.ABBREVIATIONS.items())
_LONG_ROWS = ", ".join(f"({B.quote(p)}, {len(p.split())}, {j}, {B.quote(a)})"
                       for p, short in _MULTI.items() for j, a in enumerate(short))


def expand_sql(src: str, keep: str) -> str:
    """CTE ``qx(keep..., question, expanded)``."""
    return f"""abbr(k, n, j, e) AS (VALUES {_SHORT_ROWS}, {_LONG_ROWS}),
qk AS (SELECT {keep}, question, regexp_extract_all(lower(question), '[a-z0-9]+') AS t FROM {src}),
qg AS (SELECT {keep}, i, n, array_to_string(t[i:i + n - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM qk), (SELECT unnest([1, 2, 3, 4]) AS n) WHERE i + n - 1 <= len(t)),
qp AS (SELECT {keep}, e, i * 1000 + n * 100 + j AS pos FROM qg JOIN abbr USING (k, n)),
qe AS (SELECT {keep}, string_agg(e, ' ' ORDER BY pos) AS extra FROM (
  SELECT {keep}, e, min(pos) AS pos FROM qp GROUP BY {keep}, e) GROUP BY {keep}),
qx AS (SELECT qk.*, question || coalesce(' ' || extra, '') AS expanded FROM qk LEFT JOIN qe USING ({keep}))"""


_WORDS = (r"list_filter(regexp_extract_all(regexp_replace(lower({x}), '[^\x00-\x7F\P{{L}}]', '_', 'g'), "
          r"'\b[a-z][a-z0-9\-/]{{1,30}}\b'), lambda w: NOT list_contains(" + B.array(V.ENGLISH_STOP_WORDS) + ", w))")


def vector_terms_sql(x: str) -> str:
    return (f"(SELECT list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) "
            f"FROM (SELECT {_WORDS.format(x=x)} AS w))")


INDEX_SQL = f"""
tok AS MATERIALIZED (SELECT scope_id, doc_id, chunk_index, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM ch),
dl AS (SELECT scope_id, doc_id, chunk_index, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM ch),
st AS (SELECT scope_id, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY scope_id),
tf AS MATERIALIZED (SELECT scope_id, doc_id, chunk_index, term, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT scope_id, term, count(*) AS df FROM tf GROUP BY ALL),
ri AS (SELECT scope_id, term, ln(n - df + 0.5) - ln(df + 0.5) AS ri FROM df JOIN st USING (scope_id)),
mi AS (SELECT scope_id, avg(ri) AS mi FROM ri GROUP BY scope_id),
idf AS (SELECT scope_id, term, CASE WHEN ri < 0 THEN 0.25 * mi ELSE ri END AS idf FROM ri JOIN mi USING (scope_id)),
vt AS MATERIALIZED (SELECT scope_id, doc_id, chunk_index, term, count(*) AS tf FROM (
  SELECT scope_id, doc_id, chunk_index, unnest({vector_terms_sql('text')}) AS term FROM ch) GROUP BY ALL),
vi AS MATERIALIZED (SELECT scope_id, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM (
    SELECT scope_id, term, count(*) AS df FROM vt GROUP BY scope_id, term) JOIN st USING (scope_id)),
norms AS (SELECT scope_id, doc_id, chunk_index, sqrt(sum(((1 + ln(tf)) * idf) ** 2)) AS norm
  FROM vt JOIN vi USING (scope_id, term) GROUP BY ALL)"""

SEARCH_SQL = f"""{INDEX_SQL},
qt AS (SELECT query_id, scope_id, term, count(*) AS qtf FROM (
  SELECT query_id, scope_id, unnest(regexp_extract_all(lower(expanded), '[a-z0-9]+')) AS term FROM qx) GROUP BY ALL),
bm AS (SELECT query_id, doc_id, chunk_index, sum(idf * qtf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25
  FROM qt JOIN idf USING (scope_id, term) JOIN tf USING (scope_id, term)
  JOIN dl USING (scope_id, doc_id, chunk_index) JOIN st USING (scope_id) GROUP BY ALL),
seen AS (SELECT scope_id, doc_id, chunk_index, term FROM tf UNION
  SELECT scope_id, doc_id, chunk_index, unnest(regexp_extract_all(lower(coalesce(section_title, '')), '[a-z0-9]+')) FROM ch),
nl AS (SELECT query_id, count(*) FILTER (len(term) > 2) AS nl FROM qt GROUP BY query_id),
cov AS (SELECT query_id, doc_id, chunk_index, count(*)::DOUBLE / max(nl) AS cov
  FROM qt JOIN seen USING (scope_id, term) JOIN nl USING (query_id) WHERE len(term) > 2 GROUP BY ALL),
qv AS (SELECT query_id, scope_id, term, (1 + ln(count(*))) * any_value(idf) AS qw, any_value(idf) AS idf FROM (
  SELECT query_id, scope_id, unnest({vector_terms_sql('expanded')}) AS term FROM qx) JOIN vi USING (scope_id, term) GROUP BY ALL),
qn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qn FROM qv GROUP BY query_id),
vec AS (SELECT query_id, doc_id, chunk_index, greatest(0, least(1, sum(qw * (1 + ln(tf)) * idf) / (max(norm) * max(qn)))) AS vec
  FROM qv JOIN vt USING (scope_id, term) JOIN norms USING (scope_id, doc_id, chunk_index) JOIN qn USING (query_id) GROUP BY ALL),
scored AS MATERIALIZED (SELECT query_id, scope_id, doc_id, chunk_index, round(coalesce(vec, 0), 10) AS vec,
    round(coalesce(bm25, 0) + 6.0 * coalesce(cov, 0), 10) AS lex
  FROM qx JOIN ch USING (scope_id) LEFT JOIN vec USING (query_id, doc_id, chunk_index)
  LEFT JOIN bm USING (query_id, doc_id, chunk_index) LEFT JOIN cov USING (query_id, doc_id, chunk_index)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vec DESC, doc_id, chunk_index) - 1 AS rv,
    row_number() OVER (PARTITION BY query_id ORDER BY lex DESC, doc_id, chunk_index) - 1 AS rl FROM scored),
fused AS (SELECT *, round(1.0::DOUBLE / (61 + rv) + 1.0::DOUBLE / (61 + rl), 12) AS fused FROM ranked),
topk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id DESC, chunk_index DESC) AS fused_rank FROM fused),
found AS MATERIALIZED (SELECT query_id, scope_id, doc_id, chunk_index, round(vec, 4) AS vector_score, round(lex, 4) AS lexical_score,
    CAST(fused_rank AS INT) AS fused_rank, round(fused, 6) AS fused_score
  FROM topk WHERE fused_rank <= 6 AND (vec >= 0.02 OR lex > 0))"""

REPORT_QS = (f"qsrc AS (SELECT o_orderkey AS query_id, o_orderkey AS scope_id, "
             f"{B.lookup(QUESTIONS, 'o_orderkey % 4')} AS question FROM orders)")
REPORT_CH = f"{B.CHUNKS}, ch AS (SELECT doc_id AS scope_id, * FROM chk)"
REPORT_SEARCH = f"{REPORT_CH}, {REPORT_QS}, {expand_sql('qsrc', 'query_id, scope_id')}, {SEARCH_SQL}"

_CORPUS_CH = (f"{DOC_PACKED}, ch AS (SELECT CAST(0 AS BIGINT) AS scope_id, doc_id, CAST(chunk - 1 AS INT) AS chunk_index, "
              f"CAST(NULL AS VARCHAR) AS section_title, text FROM packed)")
_CORPUS_QS = "qsrc AS (SELECT item_id AS query_id, CAST(0 AS BIGINT) AS scope_id, text AS question FROM benchmark)"
CORPUS_SEARCH = f"{_CORPUS_CH}, {_CORPUS_QS}, {expand_sql('qsrc', 'query_id, scope_id')}, {SEARCH_SQL}"


# --- queries ------------------------------------------------------------------------------

@check("r1_tokenize", """
SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY term""")
def _(spark, sf_dir):
    return (corpus.read_corpus(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("term"))
            .groupBy("term").agg(F.count("*").alias("n")))


@check("r2_expand_query", with_(
    "qsrc AS (SELECT conv_id, turn, text AS question FROM conversations), " + expand_sql("qsrc", "conv_id, turn"),
    "SELECT conv_id, turn, expanded FROM qx"))
def _(spark, sf_dir):
    return corpus.read_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", T.expand_query(F.col("text")).alias("expanded"))


@check("r3_tfidf_index", with_(f"{_CORPUS_CH}, {INDEX_SQL}", """
SELECT doc_id, chunk_index, round(norm, 4) AS norm, CAST(count(*) AS BIGINT) AS terms
FROM norms JOIN vt USING (scope_id, doc_id, chunk_index) JOIN vi USING (scope_id, term) GROUP BY ALL""", True))
def _(spark, sf_dir):
    return corpus_index(spark, sf_dir).norms.select("doc_id", "chunk_index", F.round("norm", 4).alias("norm"), "terms")


@check("r4_cosine_scores", with_(REPORT_SEARCH, """
SELECT query_id, doc_id, chunk_index, round(vec, 4) AS vec FROM scored WHERE round(vec, 4) > 0"""))
def _(spark, sf_dir):
    _chunks, index = report_index(spark, sf_dir)
    return R.cosine_scores(index, report_questions(spark, sf_dir)).select(
        "query_id", "doc_id", "chunk_index", F.round("vec", 4).alias("vec")).filter("vec > 0")


@check("r5_bm25_scores", with_(CORPUS_SEARCH, """
SELECT query_id, doc_id, chunk_index, round(bm25, 4) AS bm25 FROM bm""", True))
def _(spark, sf_dir):
    index = corpus_index(spark, sf_dir)
    return R.word_scores(index, passages(spark, sf_dir)).select(
        "query_id", "doc_id", "chunk_index", F.round("bm25", 4).alias("bm25"))


@check("r6_coverage_bonus", with_(REPORT_SEARCH, """
SELECT query_id, doc_id, chunk_index, round(6.0::DOUBLE * cov, 4) AS bonus FROM cov"""))
def _(spark, sf_dir):
    _chunks, index = report_index(spark, sf_dir)
    return R.coverage_scores(index, report_questions(spark, sf_dir)).select(
        "query_id", "doc_id", "chunk_index", F.round(F.col("coverage") * R.COVERAGE, 4).alias("bonus"))


@check("r7_rrf_fuse", with_(REPORT_SEARCH, """
SELECT query_id, doc_id, chunk_index, CAST(rv AS INT) AS rv, CAST(rl AS INT) AS rl, CAST(fused_rank AS INT) AS fused_rank
FROM topk WHERE fused_rank <= 6"""))
def _(spark, sf_dir):
    _chunks, index = report_index(spark, sf_dir)
    return R.fused_ranks(index, report_questions(spark, sf_dir)).select("query_id", "doc_id", "chunk_index", "rv", "rl", "fused_rank")


def report_results(spark, sf_dir):
    made, index = report_index(spark, sf_dir)
    return made, R.search_scopes(index, report_questions(spark, sf_dir))


def report_evidence(spark, sf_dir):
    """Every question with the chunks found for it."""
    return R.search_evidence(report_index(spark, sf_dir)[1], report_questions(spark, sf_dir))


@check("r8_hybrid_search", with_(REPORT_SEARCH, "SELECT * FROM found"))
def _(spark, sf_dir):
    return report_results(spark, sf_dir)[1]


@check("r8_corpus_search", with_(CORPUS_SEARCH, "SELECT * FROM found", True))
def _(spark, sf_dir):
    return R.search_corpus(corpus_index(spark, sf_dir), passages(spark, sf_dir))


@check("r9_index_fingerprint", with_(B.CHUNKS, """
SELECT doc_id, sha256('1.0.0|tfidf-v1|' || string_agg(sha256(chunk_index || '|' || text), '|' ORDER BY chunk_index)) AS fingerprint
FROM chk GROUP BY doc_id"""))
def _(spark, sf_dir):
    return R.index_fingerprint(stored_chunks(spark, sf_dir))


@check("r9_stale_documents", with_(B.REPORT, "SELECT doc_id FROM rep WHERE priority = '1-URGENT'"))
def _(spark, sf_dir):
    """Reports whose text changes when the injected sentence is removed."""
    now = stored_chunks(spark, sf_dir)
    before = now.withColumn("text", F.regexp_replace("text", "Ignore all previous.*$", ""))
    return R.stale_documents(R.index_fingerprint(before), R.index_fingerprint(now))


@check("r9_stale_scopes", with_(B.REPORT, """
SELECT DISTINCT owner_id AS scope_id FROM rep WHERE priority = '1-URGENT' OR doc_id % 50 IN (0, 1)"""))
def _(spark, sf_dir):
    """Owners of whose reports one changed, one left or one came since the last index."""
    chunks = stored_chunks(spark, sf_dir)
    owners = corpus.read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("scope_id"))
    before = chunks.withColumn("text", F.regexp_replace("text", "Ignore all previous.*$", ""))
    old, new = (R.index_fingerprint(c).join(owners, "doc_id") for c in (before, chunks))
    return R.stale_scopes(old.filter("doc_id % 50 <> 0"), new.filter("doc_id % 50 <> 1"))


@check("r10_dense_topk", """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, greatest(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 1e-12) AS n FROM embeddings),
c AS (SELECT label, list(m ORDER BY i) AS q FROM (
  SELECT label, i, avg(e[i]) AS m FROM (SELECT label, e, unnest(range(1, len(e) + 1)) AS i FROM v) GROUP BY label, i) GROUP BY label),
s AS (SELECT c.label AS query_id, vec_id, round(list_dot_product(e, q) / (n * greatest(sqrt(list_dot_product(q, q)), 1e-12)), 6) AS score FROM c, v)
SELECT query_id, vec_id, score, CAST(r AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10""")
def _(spark, sf_dir):
    """Vectors nearest to the mean vector of each label."""
    return R.dense_topk(*label_means(spark, sf_dir)).select("query_id", "vec_id", "score", "rank")


def label_means(spark, sf_dir):
    vectors = corpus.read_table(spark, sf_dir, "embeddings")
    means = (vectors.select("label", F.posexplode("embedding").alias("i", "x"))
             .groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
             .groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))),
                                               lambda p: p["m"]).alias("q")))
    scope = F.lit(0).alias("scope_id")
    return means.select(F.col("label").alias("query_id"), scope, "q"), vectors.select(scope, "vec_id", "embedding")


def every_fiftieth(spark, sf_dir):
    """Every fiftieth vector as a question, against all vectors."""
    vectors = corpus.read_table(spark, sf_dir, "embeddings").select(F.lit(0).alias("scope_id"), "vec_id", "embedding")
    return vectors.filter("vec_id % 50 = 0").select(
        F.col("vec_id").alias("query_id"), "scope_id", F.transform("embedding", lambda x: x.cast("double")).alias("q")), vectors


@check("r10_bucketed_topk")
def _(spark, sf_dir):
    """Vectors nearest to every fiftieth one, by buckets of random projections."""
    return nearest.bucketed_topk(*every_fiftieth(spark, sf_dir)).select("query_id", "vec_id", "score", "rank")


@check("r10_bucketed_recall", "SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
def _(spark, sf_dir):
    """Whether the bucketed search finds nine tenths of the exact answers."""
    asked, vectors = every_fiftieth(spark, sf_dir)
    found = nearest.recall(nearest.bucketed_topk(asked, vectors), R.dense_topk(asked, vectors))
    return found.select("queries", (F.col("recall") >= 0.9).alias("reached"))
