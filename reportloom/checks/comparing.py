"""Checks of comparison and conflict operators over pairs of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportloom.checks import base as B
from reportloom.checks.base import with_
from reportloom.checks.ingest import (
    ENTITY_SQL, reports, stored_chunks, stored_entities, stored_measurements, stored_sections)
from reportloom.checks.registry import check
from reportloom.functions import normalize as N, text as T, vocab as V
from reportloom.operators import compare as A, extract as X
from reportloom.sources import corpus, render


def text_measurements(spark, sf_dir):
    return stored_measurements(spark, sf_dir).withColumn("ord", F.struct("section_idx", "line_idx"))


def pairs(spark, sf_dir):
    return render.visit_pairs(spark, sf_dir)


def compared(spark, sf_dir):
    return A.compare_measurements(pairs(spark, sf_dir), text_measurements(spark, sf_dir))


# --- SQL -------------------------------------------------------------------------------

FIRST_SQL = f"""{B.MEAS.replace(B.LAB + ',', '', 1).lstrip()},
firsts AS (SELECT * EXCLUDE rn FROM (SELECT *, lower(name) AS key, row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY line_idx) AS rn FROM meas) WHERE rn = 1),
fa AS (SELECT p.pair_id, f.* FROM pairs p JOIN firsts f ON f.doc_id = doc_a),
fb AS (SELECT p.pair_id, f.* FROM pairs p JOIN firsts f ON f.doc_id = doc_b),
cmp AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.key, b.key) AS key, coalesce(a.name, b.name) AS item,
  CASE WHEN b.key IS NULL THEN 'removed' WHEN a.key IS NULL THEN 'added' WHEN abs(a.value_num - b.value_num) < 1e-9 THEN 'unchanged' ELSE 'changed' END AS change_type,
  a.value_raw AS ra, b.value_raw AS rb, a.value_num AS na, b.value_num AS nb, a.unit AS ua, b.unit AS ub, a.flag AS fla, b.flag AS flb,
  a.doc_id AS da, b.doc_id AS db
  FROM fa a FULL OUTER JOIN fb b ON a.pair_id = b.pair_id AND a.key = b.key)"""

_FIRST = f"{B.LAB}, {B.PAIRS}, {FIRST_SQL}"

_VALUE = "{r} || ' ' || {u} || ' (ref 5-40)' || coalesce(' [' || {f} || ']', '')"

_ENT = f"""{B.REPORT}, {B.PAIRS}, ents AS ({ENTITY_SQL}),
shown AS (SELECT DISTINCT doc_id, entity_type, coalesce(normalized_text, raw_text) AS item FROM ents
  WHERE entity_type IN ('medication', 'organization', 'person', 'procedure')),
terms AS (
  SELECT pair_id, entity_type, item, 'removed' AS change_type FROM pairs JOIN shown a ON a.doc_id = doc_a
    WHERE NOT EXISTS (SELECT 1 FROM shown b WHERE b.doc_id = doc_b AND b.entity_type = a.entity_type AND b.item = a.item)
  UNION ALL
  SELECT pair_id, entity_type, item, 'added' FROM pairs JOIN shown b ON b.doc_id = doc_b
    WHERE NOT EXISTS (SELECT 1 FROM shown a WHERE a.doc_id = doc_a AND a.entity_type = b.entity_type AND a.item = b.item))"""

_CLAIMS = """SELECT {p} AS pair_id, doc_a, doc_b, a.name || ' = ' || a.value_raw AS claim_a, b.name || ' = ' || b.value_raw AS claim_b,
  '''' || a.name || ''' is recorded as ' || a.value_raw || ' ' || a.unit || ' in one place and ' || b.value_raw || ' ' || b.unit || ' in another.' AS explanation,
  a.source_snippet AS quote_a, b.source_snippet AS quote_b, a.line_idx AS o"""
_CROSS = f"""{_FIRST}, conf AS (SELECT * EXCLUDE (o, rn) FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, claim_a, claim_b ORDER BY o) AS rn FROM (
  {_CLAIMS.format(p='pair_id')} FROM pairs JOIN meas a ON a.doc_id = doc_a JOIN firsts b ON b.doc_id = doc_b AND b.key = lower(a.name)
  WHERE abs(a.value_num - b.value_num) >= 1e-9)) WHERE rn = 1)"""
_INTERNAL = f"""{B.MEAS}, nth AS (SELECT *, doc_id AS doc_a, doc_id AS doc_b, row_number() OVER (PARTITION BY doc_id, name ORDER BY line_idx) AS n FROM meas),
conf AS (SELECT * EXCLUDE (o, rn) FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, claim_a, claim_b ORDER BY o) AS rn FROM (
  {_CLAIMS.format(p='a.doc_id').replace('doc_a, doc_b', 'a.doc_a, a.doc_b')} FROM nth a JOIN nth b ON a.doc_id = b.doc_id AND a.name = b.name AND b.n = CASE WHEN a.n = 1 THEN 2 ELSE 1 END
  WHERE abs(a.value_num - b.value_num) >= 1e-9)) WHERE rn = 1)"""
_CONF_COLS = ["pair_id", "doc_a", "doc_b", "claim_a", "claim_b", "explanation", "quote_a", "quote_b"]


# --- queries ---------------------------------------------------------------------------------

@check("a1_name_key", """
SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_brand || ' / ' || p_type), '[a-z0-9]+'), ' ') AS key FROM part""")
def _(spark, sf_dir):
    return corpus.read_table(spark, sf_dir, "part").select(
        "p_partkey", T.name_key(F.concat_ws(" / ", "p_brand", "p_type")).alias("key"))


@check("a2_same_value", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 25 THEN abs(l_quantity - p_size) < 1e-9
  ELSE lower(l_returnflag) = lower(p_type[1:1]) END AS same FROM lineitem JOIN part ON l_partkey = p_partkey""")
def _(spark, sf_dir):
    j = corpus.read_table(spark, sf_dir, "lineitem").join(
        corpus.read_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    a_num = F.when(F.col("l_quantity") > 25, F.col("l_quantity"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", N.same_value(
        a_num, F.col("l_returnflag"), F.col("p_size").cast("double"), F.left("p_type", F.lit(1))).alias("same"))


@check("a3_compare_measurements", with_(_FIRST, """
SELECT pair_id, item, change_type, CASE WHEN change_type = 'changed' THEN
  'Value changed from ' || ra || ' to ' || rb || ' (' || CASE WHEN nb >= na THEN '+' ELSE '' END || CAST(nb - na AS VARCHAR) || ').'
  || CASE WHEN ua <> ub THEN ' Unit: ' || ua || ' → ' || ub || '.' ELSE '' END
  || CASE WHEN coalesce(fla, '') <> coalesce(flb, '') THEN ' Flag: ' || coalesce(fla, '—') || ' → ' || coalesce(flb, '—') || '.' ELSE '' END END AS change_note
FROM cmp"""))
def _(spark, sf_dir):
    return compared(spark, sf_dir).select("pair_id", "item", "change_type", "change_note")


@check("a3_compare_with_tables", with_(_FIRST, """
SELECT pair_id, coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'removed' WHEN a.key IS NULL THEN 'added'
  WHEN abs(a.value_num - b.value_num) < 1e-9 THEN 'unchanged' ELSE 'changed' END AS change_type, a.value_raw AS value_a, b.value_raw AS value_b
FROM (SELECT pair_id, f.key, value_num + 1000 AS value_num, CAST(value_num + 1000 AS VARCHAR) AS value_raw FROM pairs JOIN firsts f ON f.doc_id = doc_a) a
FULL OUTER JOIN (SELECT pair_id, f.key, value_num + 1000 AS value_num, CAST(value_num + 1000 AS VARCHAR) AS value_raw FROM pairs JOIN firsts f ON f.doc_id = doc_b) b
USING (pair_id, key)"""))
def _(spark, sf_dir):
    """Rows of tables come before lines of text: here every table value is 1000 above the line's."""
    tables = render.report_tables(spark, sf_dir).withColumn("rows", F.transform("rows", lambda r: F.transform(
        r, lambda c, i: F.when(i == 1, (c.cast("double") + 1000).cast("string")).otherwise(c))))
    union = X.union_measurements(X.measurements_from_tables(tables), stored_measurements(spark, sf_dir))
    rows = A.compare_measurements(pairs(spark, sf_dir), union)
    return rows.select("pair_id", "key", "change_type", F.col("a.value_raw").alias("value_a"), F.col("b.value_raw").alias("value_b"))


@check("a4_format_measurement", with_(_FIRST, f"""
SELECT pair_id, item, {_VALUE.format(r='ra', u='ua', f='fla')} AS value_a, {_VALUE.format(r='rb', u='ub', f='flb')} AS value_b FROM cmp"""))
def _(spark, sf_dir):
    return A.with_values(compared(spark, sf_dir)).select("pair_id", "item", "value_a", "value_b")


@check("a5_compare_entities", with_(_ENT, """
SELECT pair_id, upper(entity_type[1:1]) || entity_type[2:] || 's' AS category, item, change_type FROM terms"""))
def _(spark, sf_dir):
    return A.compare_entities(pairs(spark, sf_dir), stored_entities(spark, sf_dir)).drop("page_number")


@check("a6_comparison_citations", with_(_FIRST, f"""
SELECT pair_id, '[C' || row_number() OVER (PARTITION BY pair_id ORDER BY grp, key, side) || ']' AS ref, doc_id, 3 AS chunk_index, 1 AS page_number, quote
FROM (SELECT pair_id, CASE change_type WHEN 'removed' THEN 1 WHEN 'added' THEN 2 ELSE 0 END AS grp, key, 0 AS side, da AS doc_id,
    {_VALUE.format(r='ra', u='ua', f='fla')} AS quote FROM cmp WHERE da IS NOT NULL
  UNION ALL SELECT pair_id, CASE change_type WHEN 'removed' THEN 1 WHEN 'added' THEN 2 ELSE 0 END, key, 1, db,
    {_VALUE.format(r='rb', u='ub', f='flb')} FROM cmp WHERE db IS NOT NULL)"""))
def _(spark, sf_dir):
    return A.comparison_citations(compared(spark, sf_dir), pairs(spark, sf_dir), stored_chunks(spark, sf_dir))


_TERM_SQL = _ENT.replace(B.LAB + ",", "", 1).replace(B.PAIRS + ",", "", 1).lstrip()


@check("a6_all_citations", with_(f"{_FIRST}, {_TERM_SQL}, {B.SECTIONS.replace(B.REPORT + ',', '', 1).lstrip()}, {B.CHUNKS.replace(B.SECTIONS + ',', '', 1).lstrip()}", f"""
SELECT pair_id, '[C' || row_number() OVER (PARTITION BY pair_id ORDER BY grp, sub, key, side) || ']' AS ref, r.doc_id,
  clinic || ' - Outpatient Letter' AS document_title, chunk_index, 1 AS page_number, quote
FROM (SELECT pair_id, 0 AS grp, CASE change_type WHEN 'removed' THEN 1 WHEN 'added' THEN 2 ELSE 0 END AS sub, key, 0 AS side, da AS doc_id, 4 AS section_idx,
    {_VALUE.format(r='ra', u='ua', f='fla')} AS quote FROM cmp WHERE da IS NOT NULL
  UNION ALL SELECT pair_id, 0, CASE change_type WHEN 'removed' THEN 1 WHEN 'added' THEN 2 ELSE 0 END, key, 1, db, 4,
    {_VALUE.format(r='rb', u='ub', f='flb')} FROM cmp WHERE db IS NOT NULL
  UNION ALL SELECT pair_id, CASE entity_type WHEN 'medication' THEN 1 WHEN 'organization' THEN 2 ELSE 3 END, CASE change_type WHEN 'removed' THEN 1 ELSE 2 END,
    item, 0, CASE change_type WHEN 'removed' THEN doc_a ELSE doc_b END, CASE entity_type WHEN 'medication' THEN 5 WHEN 'organization' THEN 0 ELSE 1 END, item
  FROM terms JOIN pairs USING (pair_id)) r
JOIN chk USING (doc_id, section_idx) JOIN (SELECT doc_id AS d, clinic FROM rep) ON d = r.doc_id"""))
def _(spark, sf_dir):
    """Citations of measurements and terms, with the titles of the reports."""
    titles = reports(spark, sf_dir).select("doc_id", F.split("text", "\n")[0].alias("title"))
    return A.cite_comparison(compared(spark, sf_dir), stored_entities(spark, sf_dir), pairs(spark, sf_dir),
                             stored_sections(spark, sf_dir), stored_chunks(spark, sf_dir), titles)


_SUMMARY = f"""{_FIRST}, {_ENT.replace(B.LAB + ',', '', 1).replace(B.PAIRS + ',', '', 1).lstrip()},
tally AS (SELECT pair_id, count(*) FILTER (m) AS compared, count(*) FILTER (change_type = 'changed') AS changed,
    count(*) FILTER (change_type = 'added') AS added, count(*) FILTER (change_type = 'removed') AS removed,
    count(*) FILTER (change_type = 'unchanged') AS unchanged
  FROM pairs LEFT JOIN (SELECT pair_id, change_type, true AS m FROM cmp UNION ALL SELECT pair_id, change_type, false FROM terms) USING (pair_id) GROUP BY pair_id)"""


@check("a7_comparison_summary", with_(_SUMMARY, """
SELECT *, 'Compared ' || compared || ' recorded values and terms: ' || changed || ' changed, ' || added || ' newly added, '
  || removed || ' no longer mentioned, ' || unchanged || ' unchanged. All differences are stated as recorded-value changes without clinical interpretation.' AS summary
FROM tally"""))
def _(spark, sf_dir):
    terms = A.compare_entities(pairs(spark, sf_dir), stored_entities(spark, sf_dir))
    return A.comparison_summary(compared(spark, sf_dir), terms, pairs(spark, sf_dir))


@check("a8_count_changes", with_(_FIRST, """
SELECT 'Measurement' AS category, change_type, count(*) AS n FROM cmp GROUP BY change_type"""))
def _(spark, sf_dir):
    return A.count_changes(compared(spark, sf_dir))


@check("a8_filter_changes", with_(_FIRST, "SELECT pair_id, item FROM cmp WHERE change_type = 'added'"))
def _(spark, sf_dir):
    return A.filter_changes(compared(spark, sf_dir), "added").select("pair_id", "item")


def order_documents(spark, sf_dir):
    """Document rows of the reports: owner, time and processing status."""
    status = (F.when(F.col("o_orderstatus") == "P", "processing").otherwise("completed"))
    return corpus.read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("owner_id"),
        F.col("o_orderdate").alias("created_at"), status.alias("status"))


@check("a9_eligible_pairs", f"""
WITH {B.PAIRS} SELECT pair_id, doc_a, doc_b, a.o_custkey AS owner_id FROM pairs JOIN orders a ON a.o_orderkey = doc_a
JOIN orders b ON b.o_orderkey = doc_b AND b.o_custkey = a.o_custkey WHERE a.o_orderstatus <> 'P' AND b.o_orderstatus <> 'P'""")
def _(spark, sf_dir):
    return A.eligible_pairs(pairs(spark, sf_dir), order_documents(spark, sf_dir))


@check("a10_value_conflicts", with_(_CROSS, "SELECT * FROM conf"))
def _(spark, sf_dir):
    return A.value_conflicts(pairs(spark, sf_dir), text_measurements(spark, sf_dir)).select(*_CONF_COLS)


@check("a11_internal_conflicts", with_(_INTERNAL, "SELECT * FROM conf"))
def _(spark, sf_dir):
    return A.internal_conflicts(text_measurements(spark, sf_dir)).select(*_CONF_COLS)


@check("a12_dedup_conflicts", with_(_INTERNAL, "SELECT pair_id, count(*) AS n FROM conf GROUP BY pair_id"))
def _(spark, sf_dir):
    return A.internal_conflicts(text_measurements(spark, sf_dir)).groupBy("pair_id").agg(F.count("*").alias("n"))


@check("a13_internal_notes", with_(_INTERNAL, f"""
SELECT o_orderkey AS doc_id, '{V.INTERNAL_SCAN} 2 distinct dates detected; only structured value conflicts are flagged.'
  || CASE WHEN o_orderkey IN (SELECT pair_id FROM conf) THEN '' ELSE ' {V.NO_CONFLICTS}' END AS notes FROM orders"""))
def _(spark, sf_dir):
    docs = reports(spark, sf_dir)
    return A.internal_notes(docs, stored_entities(spark, sf_dir), A.internal_conflicts(
        text_measurements(spark, sf_dir))).select("doc_id", F.array_join("notes", " ").alias("notes"))


@check("a13_pair_notes", with_(_CROSS, f"""
SELECT pair_id, concat_ws(' ', CASE WHEN a.o_orderdate <> b.o_orderdate THEN '{V.DATES_DIFFER}' END,
  CASE WHEN pair_id NOT IN (SELECT pair_id FROM conf) THEN '{V.NO_CONFLICTS}' END) AS notes
FROM pairs JOIN orders a ON a.o_orderkey = doc_a JOIN orders b ON b.o_orderkey = doc_b"""))
def _(spark, sf_dir):
    p = pairs(spark, sf_dir)
    dates = X.document_dates(stored_entities(spark, sf_dir))
    return A.pair_notes(p, dates, A.value_conflicts(p, text_measurements(spark, sf_dir))).select(
        "pair_id", F.array_join("notes", " ").alias("notes"))
