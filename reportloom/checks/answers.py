"""Checks of cited answers over the reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportloom.checks import base as B
from reportloom.checks.base import with_
from reportloom.checks.ingest import reports
from reportloom.checks.registry import check
from reportloom.checks.retrieval import REPORT_SEARCH, report_evidence
from reportloom.functions import text as T, vocab as V
from reportloom.operators import answer as A, manage as O
from reportloom.sources import corpus


def found(spark, sf_dir):
    return A.with_tokens(report_evidence(spark, sf_dir))


def answers(spark, sf_dir):
    return A.answer_found(found(spark, sf_dir))


# --- SQL -------------------------------------------------------------------------------

_KEYS, _FULL = B.array(V.ABBREVIATIONS), B.array(V.ABBREVIATIONS.values())


def words_sql(x: str) -> str:
    full = f"list_extract({_FULL}, list_position({_KEYS}, t))"
    return (f"(SELECT list_distinct(list_concat(ts, flatten(list_transform(list_filter(ts, lambda t: list_contains({_KEYS}, t)), "
            f"lambda t: list_concat([{full}], regexp_extract_all({full}, '[a-z0-9]+')))))) "
            f"FROM (SELECT list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+')), "
            f"lambda t: NOT list_contains({B.array(V.QUESTION_FILLER)}, t)) AS ts))")


def neutral_sql(x: str) -> str:
    for pat, repl in V.NEUTRALIZERS:
        x = f"regexp_replace({x}, {B.quote('(?i)' + pat)}, '{repl}', 'g')"
    return x


ANSWER_SQL = f"""{REPORT_SEARCH},
ev AS MATERIALIZED (SELECT *, {words_sql('text')} AS words, {words_sql("coalesce(section_title, '')")} AS title_words FROM (
  SELECT f.query_id, row_number() OVER (PARTITION BY f.query_id ORDER BY fused_rank) - 1 AS rank, f.doc_id, f.chunk_index,
    section_title, page_number, text FROM found f JOIN ch USING (doc_id, chunk_index))),
evn AS (SELECT query_id, count(*) AS n, list_distinct(flatten(list(list_concat(words, title_words)))) AS known FROM ev GROUP BY query_id),
gate AS (SELECT query_id, asked, CASE WHEN n IS NULL THEN false WHEN len(asked) = 0 THEN true
    WHEN len(asked) = 1 THEN len(list_intersect(asked, known)) > 0
    ELSE len(list_intersect(asked, known)) * 2 > len(asked) END AS ok, n IS NULL AS nothing
  FROM (SELECT query_id, question, {words_sql('question')} AS asked FROM qx) LEFT JOIN evn USING (query_id)),
sent AS (SELECT *, {words_sql('line')} AS sw FROM (
  SELECT query_id, rank, doc_id, page_number, words, title_words, i, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS line FROM (
    SELECT *, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS x,
      generate_subscripts(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS i FROM ev))
  WHERE len(line) >= 8),
sc AS (SELECT s.*, qw, CASE WHEN len(sw) > 0 AND len(words) > 0 THEN
    0.6 * (len(list_intersect(sw, words))::DOUBLE / len(sw)) + 0.4 * (len(list_intersect(sw, words))::DOUBLE / greatest(1, least(len(sw), 10))) ELSE 0.0::DOUBLE END AS support,
    CASE WHEN len(qw) > 0 THEN len(list_intersect(list_distinct(list_concat(sw, title_words)), qw))::DOUBLE / len(qw) ELSE 0.0::DOUBLE END AS rel
  FROM sent s JOIN (SELECT query_id, {words_sql('expanded')} AS qw FROM qx) USING (query_id)),
cand AS (SELECT query_id, rank, i, page_number, support, CASE WHEN regexp_matches(line, '[.?!:]$') THEN line ELSE line || '.' END AS text,
    rel + 0.3 * support + 0.02 * (n - rank) AS score
  FROM sc JOIN evn USING (query_id) WHERE support >= 0.28 AND (len(qw) <= 1 OR rel > 0)),
pick AS (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY score DESC, i) AS rc FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, lower(text)[1:120] ORDER BY score DESC, rank, i) AS rd FROM cand) WHERE rd = 1),
fin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, i) AS rf FROM pick WHERE rc <= 4),
chosen AS MATERIALIZED (SELECT query_id, rank, {neutral_sql('text')} AS text, support, '[' || (rank + 1) || ']' AS ref,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_number, rf) AS position
  FROM fin JOIN gate USING (query_id) WHERE rf <= 6 AND ok),
ans AS (SELECT query_id, any_value(nothing) AS nothing, any_value(ok) AS ok, string_agg(text, ' ' ORDER BY position) AS answer,
    count(text) AS n_sent, count(DISTINCT ref) AS n_refs FROM gate LEFT JOIN chosen USING (query_id) GROUP BY query_id)"""

FINAL_SQL = f"""SELECT query_id, n_sent = 0 AS insufficient_evidence,
  CASE WHEN n_sent > 0 THEN answer WHEN nothing THEN {B.quote(V.NO_PASSAGES)} WHEN NOT ok THEN {B.quote(V.NOT_RELEVANT)}
    ELSE {B.quote(V.NOT_STATED)} END AS answer,
  CASE WHEN n_sent > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS groundedness,
  CASE WHEN n_sent > 0 THEN round(n_refs::DOUBLE / n, 3) ELSE 0.0 END::DOUBLE AS evidence_coverage
FROM ans LEFT JOIN evn USING (query_id)"""


# --- queries ----------------------------------------------------------------------------------

@check("g1_content_tokens", f"""
SELECT conv_id, turn, array_to_string(list_sort({words_sql('text')}), '|') AS words FROM conversations""")
def _(spark, sf_dir):
    return corpus.read_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_join(F.array_sort(T.content_tokens(F.col("text"))), "|").alias("words"))


@check("g2_evidence_sufficiency", with_(ANSWER_SQL, f"""
SELECT query_id, ok, CASE WHEN nothing THEN {B.quote(V.NO_PASSAGES)} WHEN NOT ok THEN {B.quote(V.NOT_RELEVANT)} END AS reason FROM gate"""))
def _(spark, sf_dir):
    return found(spark, sf_dir).select(
        "query_id", A.evidence_sufficiency(F.col("evidence"), F.col("question")).alias("g")).select("query_id", "g.*")


@check("g3_sentence_support", f"""
WITH p AS (SELECT conv_id, turn, {words_sql('text')} AS w FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(a.w) > 0 AND len(b.w) > 0 THEN 0.6 * (len(list_intersect(a.w, b.w))::DOUBLE / len(a.w))
  + 0.4 * (len(list_intersect(a.w, b.w))::DOUBLE / greatest(1, least(len(a.w), 10))) ELSE 0 END, 6) AS support
FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def _(spark, sf_dir):
    """Support of every message by the message after it."""
    said = corpus.read_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", T.content_tokens(F.col("text")).alias("w"))
    after = said.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("next"))
    return said.join(after, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(A.support(F.col("w"), F.col("next")), 6).alias("support"))


@check("g4_candidate_sentences", with_(ANSWER_SQL, """
SELECT query_id, CAST(rank AS INT) AS rank, text, round(support, 6) AS support, round(score, 6) AS score FROM cand"""))
def _(spark, sf_dir):
    sentences = A.candidate_sentences(F.col("evidence"), F.col("question"))
    return found(spark, sf_dir).select("query_id", F.explode(sentences).alias("c")).select(
        "query_id", "c.rank", F.when(F.col("c.line").rlike("[.?!:]$"), F.col("c.line")).otherwise(
            F.concat("c.line", F.lit("."))).alias("text"),
        F.round("c.support", 6).alias("support"), F.round("c.score", 6).alias("score"))


@check("g5_select_answer", with_(ANSWER_SQL, """
SELECT query_id, CAST(position AS INT) AS position, text, ref, round(support, 4) AS support FROM chosen"""))
def _(spark, sf_dir):
    return answers(spark, sf_dir).select("query_id", F.posexplode("sentences").alias("p", "s")).select(
        "query_id", (F.col("p") + 1).alias("position"), "s.text", "s.ref", "s.support")


@check("g7_citations", with_(ANSWER_SQL, """
SELECT query_id, '[' || (rank + 1) || ']' AS ref, doc_id, chunk_index, page_number, section_title, text[1:280] AS quote,
  'report_' || doc_id || '.txt' AS document_title FROM ev JOIN ans USING (query_id) WHERE n_sent > 0"""))
def _(spark, sf_dir):
    docs = reports(spark, sf_dir).select("doc_id", F.col("filename").alias("title"))
    return A.cite_documents(answers(spark, sf_dir), docs)


@check("g8_answer_metrics", with_(ANSWER_SQL, f"SELECT query_id, groundedness, evidence_coverage FROM ({FINAL_SQL})"))
def _(spark, sf_dir):
    return answers(spark, sf_dir).select("query_id", "metrics.*")


@check("g9_answer_questions", with_(ANSWER_SQL, FINAL_SQL))
def _(spark, sf_dir):
    return answers(spark, sf_dir).select("query_id", "insufficient_evidence", "answer", "metrics.*")


@check("g6_redact_answers", with_(B.REPORT, """
SELECT doc_id, '[redacted-instruction].' AS text FROM rep WHERE priority = '1-URGENT'"""))
def _(spark, sf_dir):
    """Every sentence of every report as if it were chosen."""
    every = F.transform(T.split_sentences(F.col("text")), lambda s: F.struct(
        s.alias("text"), F.lit("[1]").alias("ref"), F.lit(1.0).alias("support")))
    return reports(spark, sf_dir).select("doc_id", F.explode(A.redact(every)).alias("s")).select(
        "doc_id", "s.text").filter(F.contains("text", F.lit("[redacted-instruction]")))


@check("g10_validate_rewrites", with_(B.REPORT, """
SELECT doc_id AS query_id, 0 AS position, 'Drawn sample on ' || date_text || '.' AS text, '[1]' AS refs FROM rep
UNION ALL SELECT doc_id, 2, 'Seen by ' || doctor || ' there.', '[1],[2]' FROM rep"""))
def _(spark, sf_dir):
    """Rewrites with a cited, an uncited, a doubly cited and an invented sentence."""
    docs = reports(spark, sf_dir)
    line = F.regexp_extract("text", r"Drawn on: ([^\n]+)", 1)
    doctor = F.regexp_extract("text", r"Seen by: ([^\n]+)", 1)
    chosen = F.array(
        F.struct(F.concat(F.lit("Drawn sample "), line, F.lit(".")).alias("text"), F.lit("[1]").alias("ref")),
        F.struct(F.concat(F.lit("Seen by "), doctor).alias("text"), F.lit("[2]").alias("ref")))
    rewrite = F.concat(
        F.lit("Drawn sample on "), line, F.lit(" (1). Nothing is cited here. Seen by "),
        F.regexp_replace(doctor, r"Dr\. ", "Dr.#"), F.lit(" there (2)(1). Invented claim altogether (2). Out of range (9)."))
    return (A.validate_rewrites(docs.select(F.col("doc_id").alias("query_id"), rewrite.alias("rewrite"),
                                            chosen.alias("sentences")))
            .select("query_id", "position", F.regexp_replace("text", "#", " ").alias("text"),
                    F.array_join("refs", ",").alias("refs")))


@check("g11_conversation_log", """
SELECT conv_id, arg_min(text, turn) FILTER (role = 'user')[1:120] AS title, count(*) AS messages,
  count(*) FILTER (role = 'user') AS questions, max(turn) AS last_turn FROM conversations GROUP BY conv_id""")
def _(spark, sf_dir):
    return A.conversation_log(corpus.read_table(spark, sf_dir, "conversations"))


@check("g11_list_conversations", """
SELECT conv_id, owner_id, created_at, title FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, conv_id DESC) AS n FROM (
  SELECT conv_id, conv_id % 7 AS owner_id, make_timestamp(CAST(1700000000 + conv_id * 7919 % 1000 AS BIGINT) * 1000000) AS created_at,
    arg_min(text, turn) FILTER (role = 'user')[1:120] AS title FROM conversations GROUP BY conv_id)) WHERE n BETWEEN 2 AND 6""")
def _(spark, sf_dir):
    """An owner's conversations, newest first, with their titles; a page of five from the second on."""
    conv = F.col("conv_id")
    log = A.conversation_log(corpus.read_table(spark, sf_dir, "conversations")).withColumn("owner_id", conv % 7).withColumn(
        "created_at", F.timestamp_seconds(conv * 7919 % 1000 + 1_700_000_000))
    return O.list_conversations(log, 1, 5).select("conv_id", "owner_id", "created_at", "title")


@check("g11_list_messages", """
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n BETWEEN 2 AND 3""")
def _(spark, sf_dir):
    return O.list_messages(corpus.read_table(spark, sf_dir, "conversations"), 1, 2).select("conv_id", "turn", "role")


@check("g12_citation_log", """
WITH c AS (SELECT l_partkey AS doc_id, l_shipdate AS created_at, l_orderkey AS query_id, '[' || l_linenumber || ']' AS ref,
    l_extendedprice AS price, l_suppkey AS s FROM lineitem)
SELECT doc_id, created_at, query_id, ref, CAST(n AS INT) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY created_at DESC, query_id, ref) AS n
  FROM c JOIN part ON p_partkey = doc_id)""")
def _(spark, sf_dir):
    """Line items cite parts; newest first."""
    cites = corpus.read_table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("doc_id"), F.col("l_shipdate").alias("created_at"),
        F.col("l_orderkey").alias("query_id"),
        F.concat(F.lit("["), F.col("l_linenumber").cast("string"), F.lit("]")).alias("ref"),
        F.lit("").alias("quote"))
    parts = corpus.read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"))
    return A.citation_log(cites, parts).select("doc_id", "created_at", "query_id", "ref", "n")


@check("q4_evidence_security", with_(ANSWER_SQL, """
SELECT query_id, CAST(count(*) FILTER (regexp_matches(text, '(?i)ignore all previous instructions')) AS INT) AS suspicious_evidence
FROM qx LEFT JOIN ev USING (query_id) GROUP BY query_id"""))
def _(spark, sf_dir):
    return answers(spark, sf_dir).select("query_id", "suspicious_evidence")
