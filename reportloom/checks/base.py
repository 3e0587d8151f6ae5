"""SQL building blocks of the checks.

``REPORT`` states the facts of every rendered report as columns. Checks that
read it never look at report text, so an extraction is compared with data that
never went through a pattern.
"""

from __future__ import annotations

from reportloom.functions import vocab as V
from reportloom.functions.text import _WHITE_CODES
from reportloom.sources import render as R

NL = "chr(10)"
BLANKS = "concat(" + ",".join(f"chr({c})" for c in _WHITE_CODES) + ")"


def trim(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ",".join(quote(v) for v in values) + "]"


def lookup(values, index: str) -> str:
    return f"list_extract({array(values)}, CAST({index} AS INT) + 1)"


def mapping(table: dict[str, str], key: str, default: str = "NULL") -> str:
    return (f"CASE {key} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items())
            + f" ELSE {default} END")


LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"
SLOT = f"(l_linenumber - 1) % {len(R.ANALYTES)}"

LAB = f"""lab AS (
  SELECT l_orderkey AS doc_id, {LINE_ORDER},
    row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) - 1 AS line_idx,
    {lookup(R.ANALYTES, SLOT)} AS analyte, {lookup(R.LAB_UNITS, SLOT)} AS unit,
    CASE WHEN l_quantity > 40 THEN 'H' END AS flag,
    {lookup(R.DRUGS, f'l_partkey % {len(R.DRUGS)}')} AS drug,
    {lookup(R.DOSES, f'l_suppkey % {len(R.DOSES)}')} AS dose,
    CAST(l_quantity AS VARCHAR) AS q
  FROM lineitem)"""

REPORT = f"""{LAB},
labtext AS (
  SELECT doc_id,
    string_agg(analyte || ': ' || q || ' ' || unit || ' [5-40]' || CASE WHEN flag = 'H' THEN ' (H)' ELSE '' END, {NL} ORDER BY line_idx) AS labs,
    string_agg(drug || ' ' || dose || ' mg with breakfast.', {NL} ORDER BY line_idx) AS meds
  FROM lab GROUP BY doc_id),
rep AS (
  SELECT o_orderkey AS doc_id, o_custkey AS owner_id, o_orderkey % 4 AS style,
    'report_' || o_orderkey || '.txt' AS filename, o_orderdate AS created_at,
    o_orderstatus AS status_code, o_orderpriority AS priority,
    CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + 90 AS follow_up,
    {lookup(R.PLACES, f'o_custkey % {len(R.PLACES)}')} || ' Clinic' AS clinic,
    'Dr. ' || {lookup(R.FIRST_NAMES, f'o_orderkey % {len(R.FIRST_NAMES)}')} || ' ' || {lookup(R.LAST_NAMES, f'o_orderkey % {len(R.LAST_NAMES)}')} AS doctor,
    lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS mrn,
    CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
      WHEN 1 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 2 THEN strftime(o_orderdate, '%-m/%-d/%Y')
      ELSE strftime(o_orderdate, '%-d-%-m-%Y') END AS date_text,
    (o_orderkey % 60 + 100) || '/' || (o_orderkey % 30 + 60) || ' mmHg' AS bp,
    (o_orderkey % 20 // 10 + 36) || '.' || (o_orderkey % 10) AS temp,
    coalesce(labs, '') AS labs, coalesce(meds, '') AS meds,
    {mapping(R.PLANS, 'o_orderstatus', "''")} AS plan,
    {mapping(R.REMARKS, 'o_orderpriority', "''")} AS remark
  FROM orders LEFT JOIN labtext ON o_orderkey = doc_id),
rnotes AS (
  SELECT *, 'BP ' || bp || '. Oral reading ' || temp || ' C. Next contact set for '
    || strftime(follow_up, '%Y-%m-%d') || '.' || remark AS notes FROM rep)"""


def _section(idx: int, title: str, kind: str | None, text: str) -> str:
    k = quote(kind) if kind else "CAST(NULL AS VARCHAR)"
    return (f"SELECT doc_id, {idx} AS section_idx, {title} AS title, {k} AS kind, 1 AS page_number, "
            f"{text} AS text FROM rnotes")


SECTIONS = f"""{REPORT},
sec AS (
  {_section(0, "'Preamble'", None, "clinic || ' - Outpatient Letter'")} UNION ALL
  {_section(1, "'Patient Info'", 'patient_info', f"'Regarding: Client ' || owner_id || {NL} || 'Seen by: ' || doctor")} UNION ALL
  {_section(2, "'FILE: 7-' || mrn", None, "''")} UNION ALL
  {_section(3, "'Specimen'", 'specimen', f"'Source: capillary draw' || {NL} || 'Drawn on: ' || date_text")} UNION ALL
  {_section(4, "'Lab Results'", 'labs', 'labs')} UNION ALL
  {_section(5, "'Current Medications'", 'medications', 'meds')} UNION ALL
  {_section(6, "'Assessment'", 'assessment', 'plan')} UNION ALL
  {_section(7, "'Clinical Notes'", 'notes', 'notes')})"""

# sections of a report are far below the chunk size: one chunk each, blank ones none
CHUNKS = f"""{SECTIONS},
chk AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section_idx) - 1 AS INT) AS chunk_index,
    section_idx, title AS section_title, page_number,
    regexp_replace(text, '([.!?])\\s+', '\\1 ', 'g') AS text, false AS is_table_chunk
  FROM sec WHERE text <> '')"""

MEAS = f"""{LAB},
meas AS (
  SELECT doc_id, 1 AS page_number, 4 AS section_idx, CAST(line_idx AS INT) AS line_idx,
    CASE WHEN analyte = 'WBC' THEN 'Wbc' ELSE analyte END AS name, q AS value_raw,
    l_quantity AS value_num, unit,
    CASE WHEN unit IN ('g/dL', 'mg/dL') THEN 1.0 ELSE 0.5 END::DOUBLE AS unit_confidence,
    '5-40' AS reference_range, flag,
    analyte || ': ' || q || ' ' || unit || ' [5-40]' || CASE WHEN flag = 'H' THEN ' (H)' ELSE '' END AS source_snippet
  FROM lab)"""

PAIRS = """visits AS (
  SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS visit
  FROM orders),
pairs AS (
  SELECT a.o_orderkey AS pair_id, a.o_orderkey AS doc_a, b.o_orderkey AS doc_b
  FROM visits a JOIN visits b ON a.o_custkey = b.o_custkey AND b.visit = a.visit + 1)"""

IS_PAGE_NO = (r"(regexp_matches({s}, '(?i)^\s*(page\s*)?[\divxlcm]+\s*(of|/)\s*\d+\s*$')"
              r" OR regexp_matches({s}, '^\s*-?\s*\d{{1,4}}\s*-?\s*$'))")

# documents, every line its own paragraph
SPACED = f"spaced AS (SELECT doc_id, replace(text, {NL}, {NL} || {NL}) AS text FROM documents)"

PAGED = f"""{SPACED},
paras AS (
  SELECT doc_id, unnest(string_split(text, {NL} || {NL})) AS para,
    generate_subscripts(string_split(text, {NL} || {NL}), 1) AS i FROM spaced),
walk AS (
  SELECT doc_id, i, len(para) AS size, 1 AS page_number FROM paras WHERE i = 1
  UNION ALL
  SELECT p.doc_id, p.i, CASE WHEN w.size + len(p.para) > 3000 THEN len(p.para) ELSE w.size + len(p.para) END,
    w.page_number + CASE WHEN w.size + len(p.para) > 3000 THEN 1 ELSE 0 END
  FROM walk w JOIN paras p ON p.doc_id = w.doc_id AND p.i = w.i + 1),
paged AS (
  SELECT doc_id, page_number, string_agg(para, {NL} || {NL} ORDER BY i) AS text
  FROM walk JOIN paras USING (doc_id, i) GROUP BY ALL)"""

def hot_sql(paged: str) -> str:
    return f"""{paged},
plines AS (
  SELECT doc_id, page_number, unnest(string_split(text, {NL})) AS line,
    generate_subscripts(string_split(text, {NL}), 1) AS ln FROM paged),
pl AS (
  SELECT *, {trim('line')} AS s, regexp_replace(lower({trim('line')}), '\\d+', '#', 'g') AS fp FROM plines),
npages AS (SELECT doc_id, count(*) AS n FROM paged GROUP BY ALL),
hot AS (
  SELECT doc_id, fp, CAST(count(DISTINCT page_number) AS INT) AS n_pages
  FROM pl JOIN npages USING (doc_id)
  WHERE s <> '' AND len(s) <= 90 AND NOT {IS_PAGE_NO.format(s='s')} AND n >= 3
  GROUP BY doc_id, fp, n HAVING count(DISTINCT page_number) >= greatest(3, CAST(floor(n * 0.7) AS INT)))"""


HOT = hot_sql(PAGED)


def cleaned_sql(hot: str) -> str:
    return f"""{hot},
kept AS (
  SELECT pl.*, regexp_replace(s, '[ \\t]{{2,}}', ' ', 'g') AS k,
    s <> '' AND ({IS_PAGE_NO.format(s='s')} OR hot.fp IS NOT NULL) AS dropped
  FROM pl LEFT JOIN hot ON hot.doc_id = pl.doc_id AND hot.fp = pl.fp),
joined AS (
  SELECT doc_id, page_number, coalesce(string_agg(k, {NL} ORDER BY ln) FILTER (NOT dropped), '') AS t,
    CAST(count(*) FILTER (dropped) AS INT) AS removed,
    CAST(coalesce(sum(len(line) - len(k)) FILTER (NOT dropped AND s <> ''), 0) AS INT) AS squeezed
  FROM kept GROUP BY ALL),
cleaned AS (
  SELECT j.doc_id, j.page_number, removed, squeezed,
    CASE WHEN c = '' THEN p.text ELSE c END AS text
  FROM (SELECT *, {trim(f"regexp_replace(regexp_replace(regexp_replace(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g'), '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', repeat({NL}, 2), 'g')")} AS c FROM joined) j
  JOIN paged p USING (doc_id, page_number))"""


CLEANED = cleaned_sql(HOT)

# every owner is a document, every report one of its pages
DOSSIER = f"""{REPORT},
paged AS (
  SELECT owner_id AS doc_id, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY created_at, doc_id) AS INT) AS page_number,
    clinic || ' - Outpatient Letter' || repeat({NL}, 2) || 'Patient Info' || {NL} || 'Regarding: Client ' || owner_id || {NL}
    || 'Seen by: ' || doctor || {NL} || 'FILE: 7-' || mrn || repeat({NL}, 2) || 'Specimen' || {NL} || 'Source: capillary draw' || {NL}
    || 'Drawn on: ' || date_text || repeat({NL}, 2) || 'Lab Results' || {NL} || labs || repeat({NL}, 2) || 'Current Medications' || {NL} || meds
    || repeat({NL}, 2) || 'Assessment' || {NL} || plan || repeat({NL}, 2) || 'Clinical Notes' || {NL} || notes || {NL} || '1 / 1' AS text
  FROM rnotes)"""
DOSSIER_CLEANED = cleaned_sql(hot_sql(DOSSIER))


def with_(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {select}"
