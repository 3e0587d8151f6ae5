"""Checks of listings, counts, evaluation and streaming."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from reportloom.checks import base as B
from reportloom.checks.answers import ANSWER_SQL, FINAL_SQL, answers
from reportloom.checks.base import with_
from reportloom.checks.comparing import _CROSS, _FIRST, FIRST_SQL, compared, order_documents, pairs, text_measurements
from reportloom.checks.ingest import (
    ENTITY_SQL, reports, spaced_documents, stored_chunks, stored_entities, stored_measurements,
    stored_sections)
from reportloom.checks.registry import check
from reportloom.checks.retrieval import REPORT_SEARCH, report_evidence, report_questions
from reportloom.operators import compare as A, evaluate as E, manage as O, pages as P
from reportloom.plans import ingest
from reportloom.plans.store import workspace
from reportloom.sources import corpus, files, render
from reportloom.streaming import intake


@check("o1_list_documents", """
SELECT o_orderkey AS doc_id, o_custkey AS owner_id, o_orderdate AS created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n BETWEEN 3 AND 7""")
def _(spark, sf_dir):
    return O.list_documents(order_documents(spark, sf_dir), 2, 5).select("doc_id", "owner_id", "created_at")


@check("o2_list_pages", with_(B.CLEANED, "SELECT doc_id, page_number, text FROM cleaned WHERE page_number BETWEEN 2 AND 3", True))
def _(spark, sf_dir):
    rows = P.explode_pages(spaced_documents(spark, sf_dir), ingest.cleaned_pages(F.col("text")))
    return O.list_pages(rows, 1, 2).drop("method")


@check("o2_list_sections", with_(B.SECTIONS, "SELECT doc_id, section_idx, title FROM sec WHERE section_idx BETWEEN 3 AND 5"))
def _(spark, sf_dir):
    return O.list_sections(stored_sections(spark, sf_dir), 3, 3).select("doc_id", "section_idx", "title")


@check("o2_list_measurements", with_(B.MEAS, "SELECT doc_id, name, value_raw FROM meas WHERE line_idx < 2"))
def _(spark, sf_dir):
    return O.list_measurements(stored_measurements(spark, sf_dir), 0, 2).select("doc_id", "name", "value_raw")


@check("o2_list_tables", with_(B.LAB, """
SELECT doc_id, 0 AS table_index, 'Test|Result|Units|Reference Range|Flag' AS header, count(*) AS n_rows FROM lab GROUP BY doc_id"""))
def _(spark, sf_dir):
    return O.list_tables(render.report_tables(spark, sf_dir)).select(
        "doc_id", "table_index", F.array_join("header", "|").alias("header"), F.size("rows").cast("long").alias("n_rows"))


@check("o3_list_entities", with_(B.REPORT, f"SELECT doc_id, raw_text FROM ({ENTITY_SQL}) WHERE entity_type = 'medication'"))
def _(spark, sf_dir):
    return O.list_entities(stored_entities(spark, sf_dir), "medication").select("doc_id", "raw_text")


@check("o4_facet_entities", with_(f"{B.REPORT}, e AS ({ENTITY_SQL})", """
SELECT doc_id, entity_type, count(*) AS n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, entity_type) AS INT) AS type_rank,
  array_to_string(list(raw_text ORDER BY raw_text, section_idx)[1:24], '|') AS texts FROM e GROUP BY doc_id, entity_type"""))
def _(spark, sf_dir):
    return O.facet_entities(stored_entities(spark, sf_dir)).withColumn("texts", F.array_join("texts", "|"))


def counted(spark, sf_dir):
    docs = reports(spark, sf_dir).select("doc_id")
    return O.document_counts(docs, {
        "sections": stored_sections(spark, sf_dir),
        "chunks": stored_chunks(spark, sf_dir),
        "measurements": stored_measurements(spark, sf_dir),
        "tables": render.report_tables(spark, sf_dir)})


_COUNTED = f"""{B.CHUNKS}, counted AS (SELECT o_orderkey AS doc_id, 8 AS sections, coalesce(c.n, 0) AS chunks, coalesce(m.n, 0) AS measurements,
  CASE WHEN m.n > 0 THEN 1 ELSE 0 END AS tables FROM orders LEFT JOIN (SELECT doc_id, count(*) AS n FROM chk GROUP BY doc_id) c ON c.doc_id = o_orderkey
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM lab GROUP BY doc_id) m ON m.doc_id = o_orderkey)"""


@check("o5_document_status", with_(_COUNTED, "SELECT * FROM counted"))
def _(spark, sf_dir):
    return counted(spark, sf_dir)


@check("o6_owner_stats", with_(f"{_COUNTED}, {B.PAIRS}", """
SELECT d.*, coalesce(q.n, 0) AS questions, coalesce(p.n, 0) AS comparisons FROM (
  SELECT o_custkey AS owner_id, count(*) AS documents, count(*) FILTER (o_orderstatus <> 'P') AS completed, count(*) FILTER (o_orderstatus = 'P') AS processing,
    count(*) FILTER (false) AS failed, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(measurements) AS BIGINT) AS measurements
  FROM orders JOIN counted ON doc_id = o_orderkey GROUP BY o_custkey) d
LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY user_id) q ON q.user_id = owner_id
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM pairs JOIN orders ON o_orderkey = pair_id GROUP BY o_custkey) p ON p.o_custkey = owner_id"""))
def _(spark, sf_dir):
    docs = order_documents(spark, sf_dir).join(counted(spark, sf_dir).select("doc_id", "chunks", "measurements"), "doc_id")
    asked = corpus.read_table(spark, sf_dir, "events").filter("event_type = 'view'").select(F.col("user_id").alias("owner_id"))
    owners = corpus.read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pair_id"), F.col("o_custkey").alias("owner_id"))
    return O.owner_stats(docs, asked, pairs(spark, sf_dir).join(owners, "pair_id"))


def runs(spark, sf_dir):
    return corpus.read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("kind"), F.col("ts").alias("created_at"),
        F.col("value").alias("duration_ms"), (F.col("value") < 50).alias("success"), "user_id")


@check("o7_newest_runs", """
SELECT event_id AS run_id, ts AS created_at, value AS duration_ms FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 500""")
def _(spark, sf_dir):
    return O.newest_runs(runs(spark, sf_dir), "error", 500).select("run_id", "created_at", "duration_ms")


@check("o7_run_rollup", """
SELECT event_type AS kind, count(*) AS runs, count(*) FILTER (NOT value < 50) AS failures, round(avg(value), 4) AS mean_ms, quantile_cont(value, 0.5) AS median_ms
FROM events GROUP BY event_type""")
def _(spark, sf_dir):
    return O.run_rollup(runs(spark, sf_dir))


_LEFT = "SELECT doc_id FROM labels WHERE toxic = 1"


@check("o8_delete_documents", f"""
SELECT 'documents' AS name, count(*) AS n FROM documents WHERE doc_id NOT IN ({_LEFT})
UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN ({_LEFT})
UNION ALL SELECT 'lines', CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) FROM documents WHERE doc_id NOT IN ({_LEFT})""")
def _(spark, sf_dir):
    docs = corpus.read_corpus(spark, sf_dir)
    labels = corpus.read_table(spark, sf_dir, "labels")
    tables = {"documents": docs, "labels": labels,
              "lines": docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))}
    kept = O.delete_documents(tables, labels.filter("toxic = 1"))
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in kept.items()]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


@check("o9_check_provenance", with_(_COUNTED, """
SELECT 'page-document' AS link, o_orderkey AS doc_id, 1 AS rows FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'chunk-section', doc_id, count(*) FROM chk WHERE section_title = 'Clinical Notes' GROUP BY doc_id"""))
def _(spark, sf_dir):
    """Documents still in processing and all Notes sections are taken away first."""
    pages = P.explode_pages(reports(spark, sf_dir), P.paginate_paragraphs(F.col("text")))
    sections = stored_sections(spark, sf_dir)
    known = order_documents(spark, sf_dir).filter("status = 'completed'")
    return O.check_provenance(known, pages, sections.filter("title <> 'Clinical Notes'"), stored_chunks(spark, sf_dir))


@check("o9_citation_closure", with_(f"{B.CHUNKS}, {B.PAIRS}, e AS ({ENTITY_SQL}), {FIRST_SQL}", """
SELECT 'entity-section' AS link, doc_id, count(*) AS rows FROM e JOIN orders ON o_orderkey = doc_id
  WHERE section_idx = 7 OR section_idx = 4 AND o_orderstatus = 'P' GROUP BY doc_id
UNION ALL SELECT 'measurement-section', doc_id, count(*) FROM lab JOIN orders ON o_orderkey = doc_id WHERE o_orderstatus = 'P' GROUP BY doc_id
UNION ALL SELECT 'comparison-chunk', doc_id, count(*) FROM (SELECT da AS doc_id FROM cmp UNION ALL SELECT db FROM cmp) WHERE doc_id % 5 = 0 GROUP BY doc_id
UNION ALL SELECT 'sentence-citation', NULL, count(*) FROM orders WHERE o_orderkey % 3 = 0 HAVING count(*) > 0"""))
def _(spark, sf_dir):
    """Notes sections, sections of reports in processing, and a fifth of the lab chunks are taken away first; answers cite
    a second passage they do not have."""
    sections, chunks = stored_sections(spark, sf_dir), stored_chunks(spark, sf_dir)
    waiting = order_documents(spark, sf_dir).filter("status = 'processing'").select("doc_id")
    known = sections.filter("title <> 'Clinical Notes'").join(waiting.withColumn("section_idx", F.lit(4)), ["doc_id", "section_idx"], "left_anti")
    left = chunks.filter("not (doc_id % 5 = 0 and chunk_index = 3)")
    orders = corpus.read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"))
    cites = orders.select("query_id", "doc_id", F.lit("[1]").alias("ref"), F.lit(0).alias("chunk_index"))
    said = orders.select("query_id", F.when(F.col("query_id") % 3 == 0, "[2]").otherwise("[1]").alias("ref"))
    found = O.check_provenance(
        reports(spark, sf_dir).select("doc_id"), P.explode_pages(reports(spark, sf_dir), P.paginate_paragraphs(F.col("text"))),
        known, left.withColumn("section_idx", F.lit(None).cast("int")), stored_entities(spark, sf_dir), stored_measurements(spark, sf_dir),
        cites, said, A.comparison_citations(compared(spark, sf_dir), pairs(spark, sf_dir), chunks))
    return found


@check("o10_audit_rollup", """
SELECT event_type AS action, user_id, count(*) AS events, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY ALL""")
def _(spark, sf_dir):
    return O.audit_rollup(runs(spark, sf_dir).withColumnRenamed("kind", "action"))


# --- evaluation -----------------------------------------------------------------------------

@check("e1_prf", """
WITH p AS (SELECT source, doc_id FROM documents WHERE n_chars > 1500), g AS (SELECT source, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
f AS (SELECT coalesce(p.source, g.source) AS source, p.doc_id IS NOT NULL AS p, g.doc_id IS NOT NULL AS g FROM p FULL OUTER JOIN g ON p.doc_id = g.doc_id),
c AS (SELECT source, count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM f GROUP BY source),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS re FROM c)
SELECT source, tp, fp, fn, round(pr, 4) AS precision, round(re, 4) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 4) AS f1 FROM r""")
def _(spark, sf_dir):
    """Long documents as a prediction of good ones, per source."""
    docs = corpus.read_corpus(spark, sf_dir)
    gold = docs.join(corpus.read_table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id")
    return E.prf(docs.filter("n_chars > 1500"), gold, "source", "doc_id")


_GOLD_WORDS = ("mg with breakfast", "glucose", "mmhg", "ratio")


@check("e2_retrieval_eval", with_(REPORT_SEARCH, f"""
SELECT count(*) AS n_queries, round(avg(CASE WHEN r <= 3 THEN 1 ELSE 0 END), 4) AS recall_at_3, round(avg(CASE WHEN r IS NOT NULL THEN 1 ELSE 0 END), 4) AS recall_at_6,
  round(avg(coalesce(1.0::DOUBLE / r, 0)), 4) AS mrr
FROM qx LEFT JOIN (SELECT query_id, min(rank) AS r FROM (
    SELECT f.query_id, row_number() OVER (PARTITION BY f.query_id ORDER BY fused_rank) AS rank, contains(lower(text), {B.lookup(_GOLD_WORDS, 'f.query_id % 4')}) AS hit
    FROM found f JOIN ch USING (doc_id, chunk_index)) WHERE hit GROUP BY query_id) USING (query_id)"""))
def _(spark, sf_dir):
    gold = render.pick(_GOLD_WORDS, F.col("query_id") % 4)
    hits = report_evidence(spark, sf_dir).select("query_id", F.posexplode("evidence").alias("p", "e")).filter(
        F.contains(F.lower("e.text"), gold)).select("query_id", (F.col("p") + 1).alias("rank"))
    return E.retrieval_eval(report_questions(spark, sf_dir), hits)


@check("e3_answer_eval", with_(f"{ANSWER_SQL}, fin2 AS ({FINAL_SQL}), "
       "gold AS (SELECT doc_id AS query_id, CASE style WHEN 0 THEN first_drug WHEN 1 THEN first_glucose WHEN 2 THEN bp END AS expected "
       "FROM rep LEFT JOIN (SELECT doc_id, arg_min(drug, line_idx) AS first_drug, arg_min(q, line_idx) FILTER (analyte = 'Glucose') AS first_glucose FROM lab GROUP BY doc_id) USING (doc_id))", """
SELECT count(*) AS n_cases, round(avg(CASE WHEN expected IS NOT NULL THEN CAST(contains(lower(answer), lower(expected)) AS INT) END), 4) AS answer_accuracy,
  round(avg(CASE WHEN expected IS NULL THEN CAST(insufficient_evidence AS INT) END), 4) AS refusal_correctness, round(avg(groundedness), 4) AS groundedness,
  1.0::DOUBLE AS citation_validity FROM fin2 JOIN gold USING (query_id)"""))
def _(spark, sf_dir):
    """Expected values come from the line items; no glucose line means a refusal."""
    lab = render.lab_lines(spark, sf_dir)
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    first = lab.groupBy("doc_id").agg(
        F.min_by("drug", place).alias("first_drug"),
        F.min_by(F.col("l_quantity").cast("string"), F.when(F.col("analyte") == "Glucose", place)).alias("first_glucose"))
    k = F.col("o_orderkey")
    bp = F.concat((k % 60 + 100).cast("string"), F.lit("/"), (k % 30 + 60).cast("string"), F.lit(" mmHg"))
    gold = corpus.read_table(spark, sf_dir, "orders").join(first, k == F.col("doc_id"), "left").select(
        k.alias("query_id"), F.when(k % 4 == 0, F.col("first_drug")).when(k % 4 == 1, F.col("first_glucose"))
        .when(k % 4 == 2, bp).alias("expected"))
    return E.answer_eval(answers(spark, sf_dir), gold)


_EVAL = "pair_id, count(*) AS tp, '' AS missed, '' AS false_positives, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall"


def _plain(df):
    return df.withColumn("missed", F.array_join("missed", ",")).withColumn(
        "false_positives", F.array_join("false_positives", ","))


def gold_changes(spark, sf_dir):
    """Analytes whose first value differs between the two visits, from the columns."""
    lab = render.lab_lines(spark, sf_dir)
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    first = lab.groupBy("doc_id", F.lower("analyte").alias("item")).agg(F.min_by("l_quantity", place).alias("v"))
    p = pairs(spark, sf_dir)
    a = p.join(first.withColumnRenamed("doc_id", "doc_a"), "doc_a").select("pair_id", "item", F.col("v").alias("va"))
    b = p.join(first.withColumnRenamed("doc_id", "doc_b"), "doc_b").select("pair_id", "item", F.col("v").alias("vb"))
    return a.join(b, ["pair_id", "item"]).filter("va <> vb")


@check("e4_change_eval", with_(_FIRST, f"SELECT {_EVAL} FROM cmp WHERE change_type = 'changed' GROUP BY pair_id"))
def _(spark, sf_dir):
    found = A.filter_changes(compared(spark, sf_dir), "changed").select("pair_id", F.lower("item").alias("item"))
    return _plain(E.name_eval(found, gold_changes(spark, sf_dir)))


@check("e4_conflict_eval", with_(_CROSS, f"SELECT {_EVAL} FROM (SELECT DISTINCT pair_id, split_part(claim_a, ' = ', 1) FROM conf) GROUP BY pair_id"))
def _(spark, sf_dir):
    p = pairs(spark, sf_dir)
    found = E.conflict_names(A.value_conflicts(p, text_measurements(spark, sf_dir)))
    # later values of the first visit count as well
    lab = render.lab_lines(spark, sf_dir).select("doc_id", F.lower("analyte").alias("item"), "l_quantity", F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("place"))
    first = lab.groupBy(F.col("doc_id").alias("doc_b"), "item").agg(F.min_by("l_quantity", "place").alias("vb"))
    gold = (p.join(lab.withColumnRenamed("doc_id", "doc_a"), "doc_a").join(first, ["doc_b", "item"])
            .filter("l_quantity <> vb").select("pair_id", "item").distinct())
    return _plain(E.name_eval(found, gold))


# --- streaming ---------------------------------------------------------------------------------

def scratch(spark, name):
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


@check("w1_stream_ingest", "SELECT doc_id, CASE WHEN len(text) < 10 THEN 'failed' ELSE 'completed' END AS status FROM documents")
def _(spark, sf_dir):
    out = scratch(spark, "ingest")
    docs = intake.stream_table(spark, sf_dir, "documents").select("doc_id", "text")
    intake.start_ingest(docs, out, f"{out}/checkpoint").awaitTermination()
    return intake.read_intake(spark, out, "status").select("doc_id", "status")


def arrivals(spark, rows, name, files_at_once=2, n_files=4):
    """``rows`` as a stream of files, some at a time."""
    path = scratch(spark, name)
    rows.repartition(n_files).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


@check("w1_stream_tables", with_(f"{B.CHUNKS}, e AS ({ENTITY_SQL})", """
SELECT name, doc_id, count(*) AS n FROM (SELECT 'sections' AS name, doc_id FROM sec UNION ALL SELECT 'entities', doc_id FROM e
  UNION ALL SELECT 'measurements', doc_id FROM lab UNION ALL SELECT 'chunks', doc_id FROM chk UNION ALL SELECT 'pages', doc_id FROM rep
  UNION ALL SELECT 'status', doc_id FROM rep) GROUP BY name, doc_id"""))
def _(spark, sf_dir):
    """Rows of every report in every table after two batches, the second from a restarted stream."""
    out, docs = scratch(spark, "intake"), arrivals(spark, reports(spark, sf_dir).select("doc_id", "text"), "inbox")
    for _ in range(2):
        intake.start_ingest(docs, out, f"{out}/checkpoint").awaitTermination()
    counts = [intake.read_intake(spark, out, t).groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("name", F.lit(t))
              for t in intake.INTAKE_TABLES]
    return reduce(lambda a, b: a.unionByName(b), counts)


@check("w2_stored_hashes", """
WITH f AS (SELECT doc_id AS file_id, source AS owner_id, sha256(text) AS sha256,
  first_value(doc_id) OVER (PARTITION BY source, sha256(text) ORDER BY doc_id % 2, doc_id) AS first_id FROM documents)
SELECT file_id, owner_id, sha256, CASE WHEN first_id <> file_id THEN first_id END AS existing_id FROM f""")
def _(spark, sf_dir):
    """Uploads of two streams, one after the other: the second finds what the first has stored."""
    out = scratch(spark, "uploads")
    files_ = corpus.read_corpus(spark, sf_dir).select(
        F.col("doc_id").alias("file_id"), F.col("source").alias("owner_id"), files.content_hash(F.col("text")).alias("sha256"))
    for half in (0, 1):
        stream = arrivals(spark, files_.filter(F.col("file_id") % 2 == half), f"uploads-{half}", 1, 1)
        intake.start_uploads(stream, out, f"{out}/checkpoint-{half}").awaitTermination()
    return intake.read_intake(spark, out, "uploads")


@check("w2_stream_dedup", "SELECT DISTINCT source AS owner_id, sha256(text) AS sha256 FROM documents")
def _(spark, sf_dir):
    out = scratch(spark, "dedup")
    uploads = intake.stream_table(spark, sf_dir, "documents").select(
        F.col("source").alias("owner_id"), files.content_hash(F.col("text")).alias("sha256"),
        F.timestamp_seconds(F.col("doc_id") + 1_700_000_000).alias("uploaded_at"))
    done = intake.run_to_table(intake.stream_dedup(uploads, None), f"{out}/rows", f"{out}/checkpoint")
    return done.select("owner_id", "sha256")


@check("w3_rate_violations", """
SELECT minute, user_id, actions FROM (SELECT date_trunc('minute', ts) AS minute, user_id, count(*) AS actions FROM events GROUP BY 1, 2)
WHERE actions > 1 AND minute + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def _(spark, sf_dir):
    """Minutes the watermark has closed with more than one action of a user."""
    out = scratch(spark, "rates")
    events = intake.stream_table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return intake.run_to_table(intake.rate_violations(events, 1), f"{out}/rows", f"{out}/checkpoint")
