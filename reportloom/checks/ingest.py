"""Checks of sources, pages, structure, extraction and chunking."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from reportloom.checks import base as B
from reportloom.checks.base import NL, trim, with_
from reportloom.checks.registry import check
from reportloom.functions import normalize as N, text as T, vocab as V
from reportloom.operators import chunk as C, extract as X, lines, pages as P, structure as S
from reportloom.plans import ingest
from reportloom.plans.store import materialize, stored
from reportloom.sources import corpus, files, render


def reports(spark, sf_dir):
    return render.reports(spark, sf_dir)


def spaced_documents(spark, sf_dir):
    return corpus.read_corpus(spark, sf_dir).select(
        "doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))


# Later stages read the stored tables of the reports, as a service reads its database.

def stored_sections(spark, sf_dir):
    return stored(spark, sf_dir, "sections", build=lambda: materialize(
        ingest.sections_of(reports(spark, sf_dir)), "sections"))


def stored_entities(spark, sf_dir):
    return stored(spark, sf_dir, "entities", build=lambda: materialize(
        X.extract_entities(stored_sections(spark, sf_dir)), "entities"))


def stored_measurements(spark, sf_dir):
    return stored(spark, sf_dir, "measurements", build=lambda: materialize(
        X.extract_measurements(stored_sections(spark, sf_dir)), "measurements"))


def stored_chunks(spark, sf_dir):
    return stored(spark, sf_dir, "chunks", build=lambda: materialize(
        ingest.chunks_of(reports(spark, sf_dir)), "chunks"))


# --- sources ------------------------------------------------------------------

@check("s1_decode_text", f"SELECT doc_id, replace(text, chr(13), {NL}) AS text FROM documents")
def _(spark, sf_dir):
    docs = corpus.read_corpus(spark, sf_dir)
    latin = F.encode(F.col("text"), "ISO-8859-1")
    raw = F.when(F.col("text").rlike(r"^[\x00-\xff]*$"), latin).otherwise(F.encode("text", "UTF-8"))
    return docs.select("doc_id", files.decode_text(raw).alias("text"))


@check("s2_read_corpus", "SELECT doc_id, lang, source, n_chars, text FROM documents")
def _(spark, sf_dir):
    return corpus.read_corpus(spark, sf_dir).select("doc_id", "lang", "source", "n_chars", "text")


_NAME = ("CASE lang WHEN 'en' THEN 'in/' || source || '/visit ' || doc_id || '.txt' "
         "WHEN 'de' THEN source || chr(92) || '#' || doc_id || '.PDF' "
         "WHEN 'fr' THEN source || '_' || doc_id || '..' ELSE ' .' || source || '.exe ' END")


def manifest(spark, sf_dir):
    s, d = F.col("source"), F.col("doc_id").cast("string")
    name = (F.when(F.col("lang") == "en", F.concat(F.lit("in/"), s, F.lit("/visit "), d, F.lit(".txt")))
            .when(F.col("lang") == "de", F.concat(s, F.lit("\\#"), d, F.lit(".PDF")))
            .when(F.col("lang") == "fr", F.concat(s, F.lit("_"), d, F.lit("..")))
            .otherwise(F.concat(F.lit(" ."), s, F.lit(".exe "))))
    return corpus.read_corpus(spark, sf_dir).select(
        F.col("doc_id").alias("file_id"), F.col("source").alias("owner_id"),
        name.alias("filename"), (F.col("n_chars") * 5000).alias("size"), "text")


@check("s3_validate_manifest", f"""
WITH f AS (SELECT doc_id AS file_id, n_chars * 5000 AS size, {_NAME} AS filename FROM documents),
n AS (SELECT *, regexp_replace(trim({trim("regexp_extract(replace(filename, chr(92), '/'), '[^/]*$')")}, '.'),
        '[^A-Za-z0-9_. ()\\[\\]-]', '_', 'g') AS clean_name FROM f),
e AS (SELECT *, lower(regexp_extract(clean_name, '^.+([.][^.]+)$', 1)) AS extension FROM n)
SELECT file_id, clean_name, extension, CASE WHEN size = 0 THEN 'Uploaded file is empty'
  WHEN size > 31457280 THEN 'File exceeds 30 MB limit' WHEN clean_name = '' THEN 'Invalid filename'
  WHEN extension = '' THEN 'File has no extension'
  WHEN extension NOT IN ('.pdf', '.docx', '.txt') THEN 'File type ''' || extension || ''' not allowed' END AS reject_reason
FROM e""")
def _(spark, sf_dir):
    return files.validate_manifest(manifest(spark, sf_dir)).select(
        "file_id", "clean_name", "extension", "reject_reason")


@check("s4_dedup_by_content", """
WITH f AS (SELECT doc_id AS file_id, source AS owner_id, sha256(text) AS sha256 FROM documents),
g AS (SELECT *, min(file_id) OVER (PARTITION BY owner_id, sha256) AS first_id FROM f)
SELECT file_id, owner_id, sha256, CASE WHEN first_id <> file_id THEN first_id END AS existing_id FROM g""")
def _(spark, sf_dir):
    f = manifest(spark, sf_dir).select("file_id", "owner_id", files.content_hash(F.col("text")).alias("sha256"))
    return files.dedup_by_content(f).select("file_id", "owner_id", "sha256", "existing_id")


_CONF = "round(avg(l_tax * 1000) FILTER (l_tax > 0), 2)"


def scanned_pages(spark, sf_dir):
    """Every order is a document, every line number a page, every line item a word."""
    li = corpus.read_table(spark, sf_dir, "lineitem")
    words = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_number"),
                      F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("word_no"),
                      F.concat(F.lit("word"), F.col("l_partkey").cast("string")).alias("word"),
                      (F.col("l_tax") * 1000).alias("confidence"))
    native = (li.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_number"))
              .agg(F.repeat(F.lit("x"), F.max("l_quantity").cast("int") - 20).alias("native_text")))
    return native.join(P.recognised_pages(words), ["doc_id", "page_number"], "left")


@check("s5_classify_pages", f"""
WITH w AS (SELECT l_orderkey AS doc_id, l_linenumber AS page_number,
    repeat('x', CAST(greatest(max(l_quantity) - 20, 0) AS INT)) AS native_text,
    string_agg('word' || l_partkey, ' ' ORDER BY l_partkey, l_suppkey, l_extendedprice) FILTER (l_tax > 0) AS ocr_text,
    {_CONF} AS conf FROM lineitem GROUP BY ALL),
r AS (SELECT *, len(native_text) < 20 AND coalesce(conf, 0) >= 40 AND len(coalesce(ocr_text, '')) >= 10 AS readable FROM w),
n AS (SELECT *, sum(CAST(readable AS INT)) OVER (PARTITION BY doc_id ORDER BY page_number) AS nth FROM r),
m AS (SELECT *, CASE WHEN len(native_text) >= 20 THEN 'text' WHEN readable AND nth <= 2 THEN 'ocr'
    WHEN native_text = '' THEN 'ocr-failed' ELSE 'empty' END AS method FROM n)
SELECT doc_id, page_number, method, CASE method WHEN 'text' THEN native_text WHEN 'ocr' THEN ocr_text ELSE '' END AS text,
  CASE WHEN method = 'ocr' THEN conf END AS ocr_confidence FROM m""")
def _(spark, sf_dir):
    return P.classify_pages(scanned_pages(spark, sf_dir), ocr_cap=2)


@check("s7_export_text", with_(B.CLEANED, f"""
SELECT doc_id, string_agg('--- Page ' || page_number || ' (text) ---' || {NL} || text, {NL} || {NL} ORDER BY page_number) AS text
FROM cleaned GROUP BY doc_id""", True))
def _(spark, sf_dir):
    return spaced_documents(spark, sf_dir).select(
        "doc_id", P.export_text(ingest.cleaned_pages(F.col("text"))).alias("text"))


@check("s8_read_embeddings", "SELECT vec_id, len(embedding) AS dim, round(list_sum(embedding::DOUBLE[]), 3) AS total FROM embeddings")
def _(spark, sf_dir):
    return corpus.read_embeddings(spark, sf_dir).select(
        "vec_id", F.size("embedding").cast("long").alias("dim"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


# --- pages ----------------------------------------------------------------------

@check("p1_paginate_paragraphs", with_(B.PAGED, "SELECT doc_id, page_number, text FROM paged", True))
def _(spark, sf_dir):
    return P.explode_pages(spaced_documents(spark, sf_dir), P.paginate_paragraphs(F.col("text"))).drop("method")


@check("p2_paginate_fixed", """
SELECT doc_id, CAST(g + 1 AS INT) AS page_number, substring(text, CAST(g * 6000 + 1 AS BIGINT), 6000) AS text
FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(len(text) - 1, 0) // 6000)) AS g FROM documents)""")
def _(spark, sf_dir):
    return P.explode_pages(corpus.read_corpus(spark, sf_dir), P.paginate_fixed(F.col("text"))).drop("method")


@check("p3_line_fingerprint", f"""
SELECT regexp_replace(lower({trim('line')}), '\\d+', '#', 'g') AS fp, count(*) AS n
FROM (SELECT unnest(string_split(text, {NL})) AS line FROM documents) GROUP BY ALL""")
def _(spark, sf_dir):
    return (corpus.read_corpus(spark, sf_dir).select(F.explode(T.lines_of(F.col("text"))).alias("line"))
            .groupBy(T.line_fingerprint(F.col("line")).alias("fp")).agg(F.count("*").alias("n")))


def dossiers(spark, sf_dir):
    """Every owner as a document whose pages are its reports in time order."""
    place = F.row_number().over(W.partitionBy("owner_id").orderBy("created_at", "doc_id"))
    rows = reports(spark, sf_dir).withColumn("page_number", place)
    return P.nest_pages(rows.select(F.col("owner_id").alias("doc_id"), "page_number", "text",
                                    F.lit("text").alias("method")))


@check("p4_repeated_lines", with_(B.DOSSIER_CLEANED, "SELECT doc_id, fp, n_pages FROM hot"))
def _(spark, sf_dir):
    return dossiers(spark, sf_dir).select("doc_id", F.explode(P.repeated_lines(F.col("pages"))).alias("h")).select(
        "doc_id", F.col("h.item").alias("fp"), F.col("h.n").alias("n_pages"))


@check("p5_dossier_pages", with_(B.DOSSIER_CLEANED, "SELECT doc_id, page_number, text FROM cleaned"))
def _(spark, sf_dir):
    done = dossiers(spark, sf_dir)
    return P.explode_pages(done, P.clean_pages(F.col("pages"))["pages"]).drop("method")


@check("p5_drop_boilerplate", with_(B.CLEANED, """
SELECT doc_id, CAST(sum(removed) AS INT) AS removed_lines, CAST(sum(squeezed) AS INT) AS squeezed_chars
FROM cleaned GROUP BY doc_id""", True))
def _(spark, sf_dir):
    done = P.clean_pages(P.paginate_paragraphs(F.col("text")))
    return spaced_documents(spark, sf_dir).select("doc_id", done.alias("c")).select(
        "doc_id", "c.removed_lines", "c.squeezed_chars")


@check("p6_clean_text", with_(B.CLEANED, "SELECT doc_id, page_number, text FROM cleaned", True))
def _(spark, sf_dir):
    return P.explode_pages(spaced_documents(spark, sf_dir), ingest.cleaned_pages(F.col("text"))).drop("method")


@check("p7_gate_documents", """
WITH w AS (SELECT l_orderkey AS doc_id, l_linenumber AS page_number,
    repeat('x', CAST(greatest(max(l_quantity) - 20, 0) AS INT)) AS t FROM lineitem GROUP BY ALL),
p AS (SELECT doc_id, page_number, CASE WHEN len(t) >= 20 THEN t ELSE '' END AS text,
    CASE WHEN len(t) >= 20 THEN 'text' WHEN t = '' THEN 'ocr-failed' ELSE 'empty' END AS method FROM w),
g AS (SELECT doc_id, sum(len(text)) AS total, list(page_number ORDER BY page_number) FILTER (method <> 'text') AS bad FROM p GROUP BY doc_id)
SELECT doc_id, CASE WHEN total < 10 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN total < 10 THEN 'Document contains no extractable text' || CASE WHEN len(bad) > 0 THEN
    ' (pages [' || array_to_string(bad[1:5], ', ') || '] appear to be scanned images and OCR is failed to read them)' ELSE '' END END AS message
FROM g""")
def _(spark, sf_dir):
    native = scanned_pages(spark, sf_dir).withColumn("ocr_text", F.lit(""))
    nested = P.nest_pages(P.classify_pages(native))
    return nested.select("doc_id", P.gate(F.col("pages")).alias("g")).select("doc_id", "g.status", "g.message")


@check("p8_word_page_counts", with_(B.CLEANED, """
SELECT doc_id, CAST(count(*) AS INT) AS page_count,
  CAST(sum(len(regexp_extract_all(text, '[^\\s\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{85}\\x{0B}]+'))) AS INT) AS word_count
FROM cleaned GROUP BY doc_id""", True))
def _(spark, sf_dir):
    return spaced_documents(spark, sf_dir).select(
        "doc_id", P.page_word_counts(ingest.cleaned_pages(F.col("text"))).alias("c")).select("doc_id", "c.*")


# --- structure ------------------------------------------------------------------------

@check("t1_detect_title", with_(B.REPORT, "SELECT doc_id, clinic || ' - Outpatient Letter' AS title FROM rep"))
def _(spark, sf_dir):
    return reports(spark, sf_dir).select("doc_id", S.detect_title(ingest.cleaned_pages(F.col("text"))).alias("title"))


_DOC_LINES = f"""dl AS (
  SELECT doc_id, {trim('line')} AS s, ln FROM (SELECT doc_id, unnest(string_split(text, {NL})) AS line,
    generate_subscripts(string_split(text, {NL}), 1) AS ln FROM documents)),
rules AS (
  SELECT *, {B.mapping(V.SECTION_KINDS, trim("regexp_replace(lower(s), ':+$', '')"))} AS known,
    {B.mapping(V.SECTION_KINDS, trim("regexp_replace(regexp_replace(lower(s), '^\\d+(\\.\\d+)*[.)]\\s*', ''), ':+$', '')"))} AS numbered,
    len(list_filter(string_split(regexp_replace(s, '\\s+', ' ', 'g'), ' '), lambda x: x <> '')) AS words FROM dl),
heads AS (
  SELECT *, s <> '' AND len(s) <= 90 AND NOT (ends_with(s, '.') AND words > 12) AND (known IS NOT NULL
      OR (regexp_matches(s, '^\\d+(\\.\\d+)*[.)]\\s+\\S') AND words <= 10 AND numbered IS NOT NULL)
      OR (regexp_matches(regexp_replace(s, '\\P{{L}}', '', 'g'), '^\\p{{Lu}}{{2,}}$') AND words <= 12)
      OR (regexp_matches(s, '\\p{{L}}') AND ends_with(s, ':') AND words <= 10 AND NOT regexp_matches(s, '[.?!;]'))) AS is_heading,
    coalesce(known, CASE WHEN regexp_matches(s, '^\\d+(\\.\\d+)*[.)]\\s+\\S') AND words <= 10 THEN numbered END) AS kind0 FROM rules)"""


@check("t2_classify_heading", with_(_DOC_LINES, """
SELECT doc_id, CAST(ln AS INT) AS line_no, is_heading, CASE WHEN is_heading THEN kind0 END AS kind FROM heads"""))
def _(spark, sf_dir):
    docs = corpus.read_corpus(spark, sf_dir)
    lines = docs.select("doc_id", F.posexplode(T.lines_of(F.col("text"))).alias("i", "line"))
    return lines.select("doc_id", (F.col("i") + 1).alias("line_no"),
                        S.classify_heading(T.strip(F.col("line"))).alias("h")).select(
        "doc_id", "line_no", "h.is_heading", "h.kind")


_DOC_SECTIONS = f"""{_DOC_LINES},
firsts AS (SELECT doc_id, min(ln) AS first_ln FROM dl WHERE s <> '' GROUP BY doc_id),
opened AS (SELECT h.*, sum(CAST(is_heading OR ln = first_ln AS INT)) OVER (PARTITION BY h.doc_id ORDER BY ln) AS sec,
    is_heading OR ln = first_ln AS opens FROM heads h JOIN firsts USING (doc_id)),
dsec AS (SELECT doc_id, CAST(sec - 1 AS INT) AS section_idx,
    coalesce(max({trim("regexp_replace(s, ':+$', '')")}) FILTER (is_heading), 'Preamble') AS title,
    max(kind0) FILTER (is_heading) AS kind,
    {trim(f"coalesce(string_agg(s, {NL} ORDER BY ln) FILTER (NOT is_heading), '')")} AS text
  FROM opened WHERE sec > 0 GROUP BY doc_id, sec)"""


@check("t3_detect_sections", with_(_DOC_SECTIONS, "SELECT doc_id, section_idx, title, kind, text FROM dsec"))
def _(spark, sf_dir):
    whole = F.array(F.struct(F.lit(1).alias("page_number"), F.col("text").alias("text"),
                             F.lit("text").alias("method")))
    return S.explode_sections(corpus.read_corpus(spark, sf_dir), S.detect_sections(whole)).drop("page_number")


@check("t3_sections_by_line", with_(_DOC_SECTIONS, "SELECT doc_id, section_idx, title, kind, text FROM dsec"))
def _(spark, sf_dir):
    """The same from a table of lines, in which a document may be spread over tasks."""
    whole = corpus.read_corpus(spark, sf_dir).select("doc_id", F.lit(1).alias("page_number"), "text")
    return lines.sections_of_lines(lines.page_lines(whole)).drop("page_number")


@check("t3_report_sections", with_(B.SECTIONS, "SELECT * FROM sec"))
def _(spark, sf_dir):
    return ingest.sections_of(reports(spark, sf_dir))


@check("t4_rematch_kind", with_(B.SECTIONS, "SELECT kind, count(*) AS n FROM sec GROUP BY kind"))
def _(spark, sf_dir):
    return S.rematch_kind(ingest.sections_of(reports(spark, sf_dir))).groupBy("kind").agg(F.count("*").alias("n"))


# --- extraction --------------------------------------------------------------------------

_ENT = ["doc_id", "section_idx", "entity_type", "raw_text", "normalized_text", "normalized_confidence"]


def entities(spark, sf_dir, *rules):
    sections = ingest.sections_of(reports(spark, sf_dir))
    return X.extract_entities(sections, rules or X.ALL_RULES)


def _ent(section: int, kind: str, raw: str, norm: str, conf: str, where: str = "true", src: str = "rep") -> str:
    return (f"SELECT DISTINCT doc_id, {section} AS section_idx, '{kind}' AS entity_type, {raw} AS raw_text, "
            f"CAST({norm} AS VARCHAR) AS normalized_text, CAST({conf} AS DOUBLE) AS normalized_confidence "
            f"FROM {src} WHERE {where}")


_DATES = " UNION ALL ".join([
    _ent(3, "date", "date_text", "strftime(d, '%Y-%m-%d')", "CASE WHEN style < 2 THEN 1.0 ELSE 0.9 END"),
    _ent(7, "date", "strftime(follow_up, '%Y-%m-%d')", "strftime(follow_up, '%Y-%m-%d')", "1.0")])
_MEDS = _ent(5, "medication", "drug", "lower(drug)",
             "CASE WHEN drug IN ('Lisinopril', 'Atorvastatin', 'Omeprazole') THEN 0.9 ELSE 1.0 END", src="lab")
_DOSES = " UNION ALL ".join([
    _ent(4, "dose", "q || ' ' || split_part(unit, '/', 1)",
         "q || ' ' || CASE unit WHEN 'mmol/L' THEN 'mmol/L' ELSE split_part(unit, '/', 1) END", "1.0",
         "unit <> 'x10^9/L'", "lab"),
    _ent(5, "dose", "dose || ' mg'", "dose || ' mg'", "1.0", src="lab")])
_BP = " UNION ALL ".join([
    _ent(7, "vitals", "bp", "bp", "1.0"),
    # month/day of a slashed date reads like a pressure when both have two digits
    _ent(3, "vitals", "strftime(d, '%-m/%-d')", "strftime(d, '%-m/%-d') || ' mmHg'", "1.0",
         "style = 2 AND month(d) >= 10 AND day(d) >= 10")])
_TEMP = _ent(7, "vitals", "temp || ' C'", "temp || '°C'", "1.0")
_ORG = _ent(0, "organization", "clinic", "NULL", "NULL")
_PEOPLE = _ent(1, "person", "doctor", "NULL", "NULL")
_ABBR = " UNION ALL ".join([
    _ent(7, "abbreviation", "'BP'", "'blood pressure'", "1.0"),
    _ent(7, "abbreviation", "'mmHg'", "'mmHg'", "1.0"),
    _ent(4, "abbreviation", "'WBC'", "'white blood cell count'", "1.0", "analyte = 'WBC'", "lab"),
    _ent(7, "abbreviation", "'CP'", "'chest pain'", "1.0", "priority = '5-LOW'"),
    _ent(7, "abbreviation", "'ER'", "'emergency room'", "1.0", "priority = '5-LOW'")])
ENTITY_SQL = " UNION ALL ".join([_DATES, _MEDS, _DOSES, _BP, _TEMP, _ORG, _PEOPLE, _ABBR])

for _name, _sql, _rule in [
        ("x1_extract_dates", _DATES, X.extract_dates),
        ("x3_extract_medications", _MEDS, X.extract_medications),
        ("x4_extract_doses", _DOSES, X.extract_doses),
        ("x5_extract_blood_pressure", _BP, X.extract_blood_pressure),
        ("x6_extract_temperature", _TEMP, X.extract_temperature),
        ("x7_extract_organizations", _ORG, X.extract_organizations),
        ("x8_extract_people", _PEOPLE, X.extract_people)]:
    def _make(rule):
        return lambda spark, sf_dir: entities(spark, sf_dir, rule).select(*_ENT)
    check(_name, with_(B.REPORT, _sql))(_make(_rule))

_WORD_SQL = f"""
SELECT doc_id, w AS raw_text, {B.mapping(V.ABBREVIATIONS, 'lower(w)')} AS normalized_text
FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'))) AS w FROM documents)
WHERE regexp_full_match(w, '[A-Za-z]{{2,6}}') AND {B.mapping(V.ABBREVIATIONS, 'lower(w)')} IS NOT NULL"""


@check("x9_extract_abbreviations", _WORD_SQL)
def _(spark, sf_dir):
    hits = X.entity_hits(F.col("text"), (X.extract_abbreviations,))
    return corpus.read_corpus(spark, sf_dir).select("doc_id", F.explode(hits).alias("e")).select(
        "doc_id", "e.raw_text", "e.normalized_text")


@check("x2_normalize_date", """
WITH r AS (SELECT DISTINCT o_orderkey % 40 AS a, month(o_orderdate) AS m, year(o_orderdate) AS y FROM orders),
v AS (SELECT a, m, y, a || '/' || m || '/' || y AS slash, a || '-' || m || '-' || y AS dash FROM r)
SELECT slash AS raw, CASE WHEN a BETWEEN 1 AND 12 THEN y || '-' || lpad(a::VARCHAR, 2, '0') || '-' || lpad(m::VARCHAR, 2, '0') END AS iso,
  CASE WHEN a BETWEEN 1 AND 12 THEN 0.9 ELSE 0.3 END::DOUBLE AS confidence FROM v
UNION ALL SELECT dash, CASE WHEN a BETWEEN 1 AND 31 THEN y || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(a::VARCHAR, 2, '0') END,
  CASE WHEN a BETWEEN 1 AND 31 THEN 0.9 ELSE 0.3 END::DOUBLE FROM v""")
def _(spark, sf_dir):
    o = corpus.read_table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 40).alias("a"), F.month("o_orderdate").alias("m"),
        F.year("o_orderdate").alias("y")).distinct()
    slash = o.select(F.concat_ws("/", "a", "m", "y").alias("raw"))
    dash = o.select(F.concat_ws("-", "a", "m", "y").alias("raw"))
    parts = [df.select("raw", N.normalize_date(F.col("raw"), fmt).alias("d"))
             for df, fmt in ((slash, "us_numeric"), (dash, "dash"))]
    return parts[0].unionAll(parts[1]).select("raw", "d.iso", "d.confidence")


@check("x10_dedup_entities", with_(B.REPORT, ENTITY_SQL))
def _(spark, sf_dir):
    return entities(spark, sf_dir).select(*_ENT)


@check("x11_snippet", with_(B.REPORT, f"""
SELECT doc_id, 'BP ' || bp || '. Oral reading ' || temp || ' C. Next contact set for ' AS source_snippet FROM rep WHERE false
UNION ALL SELECT doc_id, {trim("substring('BP ' || bp || '. Oral reading ' || temp || ' C. Next contact set for ' || strftime(follow_up, '%Y-%m-%d') || '.' || remark, 1, 3 + len(bp) + 60)")} FROM rep"""))
def _(spark, sf_dir):
    return (entities(spark, sf_dir, X.extract_blood_pressure).filter("section_idx = 7")
            .select("doc_id", "source_snippet"))


@check("x12_extract_measurements", with_(B.MEAS, "SELECT * FROM meas"))
def _(spark, sf_dir):
    return X.extract_measurements(ingest.sections_of(reports(spark, sf_dir)))


@check("x13_normalize_unit", f"""
WITH u AS (SELECT DISTINCT p_type AS unit FROM part UNION SELECT DISTINCT unit FROM (WITH {B.LAB} SELECT unit FROM lab))
SELECT unit AS raw, coalesce({B.mapping(V.UNITS, "lower(unit)")}, unit) AS unit,
  CASE WHEN {B.mapping(V.UNITS, "lower(unit)")} IS NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM u""")
def _(spark, sf_dir):
    kinds = corpus.read_table(spark, sf_dir, "part").select(F.col("p_type").alias("raw"))
    units = render.lab_lines(spark, sf_dir).select(F.col("unit").alias("raw"))
    return kinds.union(units).distinct().select("raw", N.normalize_unit(F.col("raw")).alias("u")).select(
        "raw", "u.unit", "u.confidence")


@check("x14_map_table_columns", """
SELECT l_orderkey AS doc_id, 1 AS test, 2 AS value, 3 AS unit, 4 AS range, 5 AS flag FROM lineitem GROUP BY l_orderkey""")
def _(spark, sf_dir):
    return render.report_tables(spark, sf_dir).select(
        "doc_id", X.map_table_columns(F.col("header")).alias("c")).select("doc_id", "c.*")


_TABLE_MEAS = """SELECT doc_id, CAST(line_idx AS INT) AS row_idx, analyte AS name, q AS value_raw, l_quantity AS value_num, unit,
  '5-40' AS reference_range, flag,
  analyte || ' | ' || q || ' | ' || unit || ' | 5-40' || coalesce(' | ' || flag, '') AS source_snippet FROM lab"""


@check("x15_measurements_from_tables", with_(B.LAB, _TABLE_MEAS))
def _(spark, sf_dir):
    return X.measurements_from_tables(render.report_tables(spark, sf_dir)).select(
        "doc_id", "row_idx", "name", "value_raw", "value_num", "unit", "reference_range", "flag", "source_snippet")


def measurements(spark, sf_dir):
    return X.union_measurements(
        X.measurements_from_tables(render.report_tables(spark, sf_dir)),
        X.extract_measurements(ingest.sections_of(reports(spark, sf_dir))))


@check("x16_union_measurements", with_(B.MEAS, f"""
SELECT doc_id, 0 AS source, row_idx AS line, name, value_raw FROM ({_TABLE_MEAS})
UNION ALL SELECT doc_id, 1, line_idx, name, value_raw FROM meas"""))
def _(spark, sf_dir):
    return measurements(spark, sf_dir).select(
        "doc_id", "ord.source", "ord.line", "name", "value_raw")


@check("x17_document_date", with_(B.REPORT, "SELECT doc_id, strftime(d, '%Y-%m-%d') AS doc_date FROM rep"))
def _(spark, sf_dir):
    return X.document_dates(entities(spark, sf_dir, X.extract_dates))


@check("x18_document_fields", with_(B.REPORT, f"""
SELECT doc_id, clinic || ' - Outpatient Letter' AS title, 1 AS page_count, 'txt' AS doc_type, 'completed' AS status,
  '1.0.0' AS pipeline_version, strftime(d, '%Y-%m-%d') AS doc_date,
  CAST(len(string_split(regexp_replace(trim(
    clinic || ' - Outpatient Letter Patient Info Regarding: Client ' || owner_id || ' Seen by: ' || doctor
    || ' FILE: 7-' || mrn || ' Specimen Source: capillary draw Drawn on: ' || date_text || ' Lab Results ' || labs
    || ' Current Medications ' || meds || ' Assessment ' || plan || ' Clinical Notes ' || notes), '\\s+', ' ', 'g'), ' ')) AS INT) AS word_count
FROM rnotes"""))
def _(spark, sf_dir):
    docs = reports(spark, sf_dir)
    found = X.extract_entities(ingest.sections_of(docs), (X.extract_dates,))
    return ingest.document_fields(docs, found).drop("status_message")


# --- chunking ---------------------------------------------------------------------------------

_SENTENCES = f"""{B.SPACED},
blocks AS (SELECT doc_id, unnest(string_split(text, {NL} || {NL})) AS b, generate_subscripts(string_split(text, {NL} || {NL}), 1) AS blk FROM spaced),
dsent AS (SELECT doc_id, 1 AS blk, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (
    SELECT doc_id, {trim('x')} AS s, i FROM (
      SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+', '\\1' || chr(1), 'g'), chr(1))) AS x,
        generate_subscripts(string_split(regexp_replace(text, '([.!?])[\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+', '\\1' || chr(1), 'g'), chr(1)), 1) AS i
      FROM documents)) WHERE s <> '')"""


@check("c1_split_sentences", with_(_SENTENCES, "SELECT doc_id, CAST(i AS INT) AS i, s FROM dsent"))
def _(spark, sf_dir):
    return corpus.read_corpus(spark, sf_dir).select(
        "doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("i", "s")).withColumn("i", F.col("i") + 1)


DOC_PACKED = f"""{_SENTENCES},
pack AS (
  SELECT doc_id, i, len(s) + 1 AS size, 1 AS chunk FROM dsent WHERE i = 1
  UNION ALL
  SELECT d.doc_id, d.i,
    CASE WHEN p.size >= 900 OR p.size + len(d.s) > 1400 THEN len(d.s) + 1 ELSE p.size + len(d.s) + 1 END,
    p.chunk + CASE WHEN p.size >= 900 OR p.size + len(d.s) > 1400 THEN 1 ELSE 0 END
  FROM pack p JOIN dsent d ON d.doc_id = p.doc_id AND d.i = p.i + 1),
packed AS (SELECT doc_id, chunk, string_agg(s, ' ' ORDER BY i) AS text FROM pack JOIN dsent USING (doc_id, i) GROUP BY doc_id, chunk)"""


@check("c2_pack_sentences", with_(DOC_PACKED, "SELECT doc_id, CAST(chunk AS INT) AS chunk, text FROM packed", True))
def _(spark, sf_dir):
    packed = C.pack_sentences(T.split_sentences(F.col("text")))
    return corpus.read_corpus(spark, sf_dir).select("doc_id", F.posexplode(packed).alias("c", "text")).select(
        "doc_id", (F.col("c") + 1).alias("chunk"), "text")


@check("c3_merge_small", with_(f"""lines AS (
  SELECT doc_id, unnest(string_split(text, {NL})) AS t, generate_subscripts(string_split(text, {NL}), 1) AS i FROM documents),
merge AS (
  SELECT doc_id, i, len(t) AS size, 1 AS chunk FROM lines WHERE i = 1
  UNION ALL
  SELECT l.doc_id, l.i, CASE WHEN len(l.t) < 80 AND m.size + len(l.t) <= 1400 THEN m.size + 1 + len(l.t) ELSE len(l.t) END,
    m.chunk + CASE WHEN len(l.t) < 80 AND m.size + len(l.t) <= 1400 THEN 0 ELSE 1 END
  FROM merge m JOIN lines l ON l.doc_id = m.doc_id AND l.i = m.i + 1)""", """
SELECT doc_id, CAST(chunk - 1 AS INT) AS chunk_index, string_agg(t, ' ' ORDER BY i) AS text
FROM merge JOIN lines USING (doc_id, i) GROUP BY doc_id, chunk""", True))
def _(spark, sf_dir):
    pieces = F.transform(F.split("text", "\n"), lambda t: F.struct(
        F.lit(0).alias("section_idx"), F.lit("").alias("section_title"), F.lit(1).alias("page_number"),
        t.alias("text"), F.lit(False).alias("is_table_chunk")))
    return corpus.read_corpus(spark, sf_dir).select(
        "doc_id", F.posexplode(C.merge_small(pieces)).alias("chunk_index", "c")).select(
        "doc_id", "chunk_index", "c.text")


_TABLE_TEXT = (f"'Test | Result | Units | Reference Range | Flag' || {NL} || "
               f"string_agg(analyte || ' | ' || q || ' | ' || unit || ' | 5-40 | ' || coalesce(flag, ''), {NL} ORDER BY line_idx)")


@check("c4_serialize_table", with_(B.LAB, f"SELECT doc_id, {_TABLE_TEXT} AS text FROM lab GROUP BY doc_id"))
def _(spark, sf_dir):
    return render.report_tables(spark, sf_dir).select(
        "doc_id", C.serialize_table(F.col("header"), F.col("rows"), F.col("caption")).alias("text"))


@check("c5_chunk_documents", with_(B.CHUNKS, f"""
SELECT *, len(text) AS char_count, greatest(1, len(text) // 4) AS token_estimate FROM (
  SELECT * FROM chk UNION ALL
  SELECT doc_id, n AS chunk_index, NULL, 'Tables', 1, {trim('t')}, true
  FROM (SELECT doc_id, {_TABLE_TEXT} AS t FROM lab GROUP BY doc_id)
  JOIN (SELECT doc_id, CAST(count(*) AS INT) AS n FROM chk GROUP BY doc_id) USING (doc_id))"""))
def _(spark, sf_dir):
    return ingest.chunks_of(reports(spark, sf_dir), render.report_tables(spark, sf_dir))


_RAW_CLEANED = B.cleaned_sql(B.hot_sql(B.PAGED.replace(B.SPACED, "spaced AS (SELECT doc_id, text FROM documents)", 1)))
_PAGE_LINES = f"""cl AS (SELECT doc_id, page_number, unnest(string_split(text, {NL})) AS line, generate_subscripts(string_split(text, {NL}), 1) AS pln FROM cleaned),
dl AS (SELECT doc_id, page_number, {trim('line')} AS s, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, pln) AS ln FROM cl),
rules AS ("""
_GAP = "'([.!?])[\\s\\x{A0}\\x{2000}-\\x{200A}\\x{3000}]+', '\\1' || chr(1), 'g'"
# pages, cleaned lines, sections over pages, blocks, sentences, packing, merging
_CORPUS_CHUNKS = f"""{_RAW_CLEANED},
{_PAGE_LINES}{_DOC_SECTIONS.split('rules AS (', 1)[1].replace(
    "max(kind0) FILTER (is_heading) AS kind,", "max(kind0) FILTER (is_heading) AS kind, arg_min(page_number, ln) AS page_number,", 1)},
blk AS (SELECT doc_id, section_idx, title, page_number, unnest(string_split(text, {NL} || {NL})) AS b,
  generate_subscripts(string_split(text, {NL} || {NL}), 1) AS k FROM dsec),
sen AS MATERIALIZED (SELECT doc_id, section_idx, title, page_number, k, s, row_number() OVER (PARTITION BY doc_id, section_idx, k ORDER BY i) AS i FROM (
  SELECT *, {trim('x')} AS s FROM (SELECT doc_id, section_idx, title, page_number, k, unnest(string_split(regexp_replace(b, {_GAP}), chr(1))) AS x,
    generate_subscripts(string_split(regexp_replace(b, {_GAP}), chr(1)), 1) AS i FROM blk)) WHERE s <> ''),
cpack AS (
  SELECT doc_id, section_idx, k, i, len(s) + 1 AS size, 1 AS c FROM sen WHERE i = 1
  UNION ALL SELECT d.doc_id, d.section_idx, d.k, d.i,
    CASE WHEN p.size >= 900 OR p.size + len(d.s) > 1400 THEN len(d.s) + 1 ELSE p.size + len(d.s) + 1 END,
    p.c + CASE WHEN p.size >= 900 OR p.size + len(d.s) > 1400 THEN 1 ELSE 0 END
  FROM cpack p JOIN sen d ON d.doc_id = p.doc_id AND d.section_idx = p.section_idx AND d.k = p.k AND d.i = p.i + 1),
piece AS MATERIALIZED (SELECT doc_id, section_idx, title, page_number, t, row_number() OVER (PARTITION BY doc_id ORDER BY section_idx, k, c) AS i FROM (
  SELECT doc_id, section_idx, any_value(title) AS title, any_value(page_number) AS page_number, k, c, string_agg(s, ' ' ORDER BY i) AS t
  FROM cpack JOIN sen USING (doc_id, section_idx, k, i) GROUP BY doc_id, section_idx, k, c)),
cmerge AS (
  SELECT doc_id, i, len(t) AS size, section_idx, page_number, 0 AS chunk_index FROM piece WHERE i = 1
  UNION ALL SELECT n.doc_id, n.i, CASE WHEN j THEN size + 1 + len(t) ELSE len(t) END, n.section_idx, n.page_number, chunk_index + CASE WHEN j THEN 0 ELSE 1 END
  FROM (SELECT p.*, m.size, m.chunk_index, len(p.t) < 80 AND p.section_idx = m.section_idx AND p.page_number = m.page_number AND m.size + len(p.t) <= 1400 AS j
    FROM cmerge m JOIN piece p ON p.doc_id = m.doc_id AND p.i = m.i + 1) n)"""


@check("c5_chunk_corpus", with_(_CORPUS_CHUNKS, """
SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, section_idx, section_title, page_number, text, CAST(len(text) AS INT) AS char_count,
  CAST(greatest(1, len(text) // 4) AS INT) AS token_estimate, false AS is_table_chunk
FROM (SELECT doc_id, chunk_index, min(p.section_idx) AS section_idx, min(title) AS section_title, min(p.page_number) AS page_number,
  string_agg(t, ' ' ORDER BY i) AS text FROM cmerge JOIN piece p USING (doc_id, i) GROUP BY doc_id, chunk_index)""", True))
def _(spark, sf_dir):
    """Chunks of the whole text corpus through pages, cleaning and sections."""
    return ingest.chunks_of(corpus.read_corpus(spark, sf_dir))
