"""Registered queries of the training-data operators, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.llm import (
    bpe, hilbert, merkle, mixing, packing, perplexity, pii, repair, simhash, substrings, toxicity, vafile, weak_quality)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document once its repeated 35-word windows are removed."""
    return substrings.removals(documents(spark, sf_dir))


@query
def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of equal row counts along a Hilbert curve over language, source and length."""
    return hilbert.assign(documents(spark, sf_dir))


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces packed into sequences of 2048 tokens."""
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the bytes decoded from them."""
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                       public_tokenizers.PATTERN)


@query
def op4_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and whether its perplexity lies in the band of its language."""
    return perplexity.judge(documents(spark, sf_dir))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, and whether it is toxic."""
    docs = documents(spark, sf_dir)
    return toxicity.severities(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query
def op10_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans, and all spans with those the model adds."""
    docs = documents(spark, sf_dir)
    return pii.find(docs, pii.fit(docs))


@query
def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rows of highest integer inner product for every hundredth vector."""
    found = vafile.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 100 = 0", k=10)
    return found.select("query_id", "rank", "vec_id", "score")


@query
def op9_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document from a scorer trained on posterior labels, and the verdict."""
    return weak_quality.scores(documents(spark, sf_dir))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired digest of every damaged conversation."""
    return repair.repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and what its tampered form folds to."""
    return merkle.audit(documents(spark, sf_dir))


@query
def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes from every document so that sources meet their targets."""
    return mixing.taken(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline, from raw documents to packed pieces."""
    return corpus_pipeline.run(spark, sf_dir)


#: SQL where it can say the same over whole tables
ORACLES["op3_substring_dedup"] = r"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS MATERIALIZED (SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS seq
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
rep AS (SELECT seq FROM win GROUP BY seq HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM win JOIN rep USING (seq)),
word AS (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (r, i) GROUP BY r),
cut AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r) LEFT JOIN cut USING (r)"""

ORACLES["op7_exact_top_k"] = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS qr, q.vec_id AS query_id, c.r, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r AND len(q.e) = len(c.e))
SELECT query_id, CAST(n AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id NULLS LAST, r) AS n FROM s) WHERE n <= 10"""

#: unsigned CRC-32 of an ASCII string; the query reads ``crc_table`` beside its rows
_CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({x}, ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda r, b: xor(r >> 8, crc_row[CAST((xor(r, b) & 255) + 1 AS BIGINT)]))"""
_CRC_TABLE = """crc_table AS MATERIALIZED (SELECT list(v ORDER BY n) AS crc_row FROM (SELECT n, list_reduce(list_prepend(n, range(0, 8)),
  lambda r, i: CASE WHEN r & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), r >> 1) ELSE r >> 1 END) AS v
  FROM (SELECT unnest(range(0, 256)) AS n)))"""


def crc32_sql(x: str) -> str:
    return f"xor({_CRC.format(x=x)}, CAST(4294967295 AS BIGINT))"


def _field(x: str) -> str:
    return f"coalesce(strlen({x}) || ':' || {x}, '-')"


_LEAF = " || ".join(_field(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars"))
_UP = """SELECT level + 1, g, i // 8, sha256(string_agg(d, '' ORDER BY i)), CAST(ceil(any_value(n) / 8.0) AS BIGINT)
  FROM {t} WHERE n > 1 GROUP BY level, g, i // 8"""

# least (cost, audit) per last role (start, system, user, assistant), row by row
def _edit(state: str, cost: str, letter: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}'}}"


def _inserted(s: str) -> str:
    user = ", ".join([f"{s}[3]", *(_edit(f"{s}[{q}]", "5", "I") for q in (1, 2, 4))])
    return f"[{s}[1], {s}[2], list_min([{user}]), list_min([{s}[4], {_edit(f'{s}[3]', '5', 'I')}])]"


def _kept(letter: str) -> str:
    return f"(CASE WHEN must OR l <> '{letter}' THEN 1000000000 ELSE pen END)"


_RE = "(CASE WHEN must THEN 1000000000 ELSE pen + 1 END)"
_USER = ", ".join([_edit("s[3]", "2", "D"), *(x for q in (1, 2, 4) for x in (
    _edit(f"s[{q}]", _kept("u"), "K"), _edit(f"s[{q}]", _RE, "R")))])
_STEP = (f"[{_edit('s[1]', '2', 'D')}, list_min([{_edit('s[2]', '2', 'D')}, {_edit('s[1]', _kept('s'), 'K')}]), list_min([{_USER}]), "
         f"list_min([{_edit('s[4]', '2', 'D')}, {_edit('s[3]', _kept('a'), 'K')}, {_edit('s[3]', _RE, 'R')}])]")
_FAR = "{'c': CAST(1000000000 AS BIGINT), 'a': ''}"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES["op11_conversation_repair"] = f"""
WITH RECURSIVE {_CRC_TABLE},
src AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations, crc_table),
hurt AS (SELECT g, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE k WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM src WHERE k <> 0),
seen AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
  right(rtrim(text, {_WHITE}), 1) AS z FROM hurt WINDOW w AS (PARTITION BY g ORDER BY turn NULLS FIRST, role, md5(text), copy)),
rows AS MATERIALIZED (SELECT *, left(role, 1) AS l, z = '' AS blank, z <> '' AND again AS dup, z NOT IN ('', '.', '!', '?') AND NOT again AS cut,
  z = '' OR again AS must, CASE WHEN z IN ('.', '!', '?') THEN 0 ELSE 5 END AS pen, lag(role) OVER (PARTITION BY g ORDER BY i) AS before FROM seen),
walk AS (SELECT DISTINCT g, CAST(0 AS BIGINT) AS i, {_inserted(_inserted(f"[{{'c': CAST(0 AS BIGINT), 'a': ''}}, {_FAR}, {_FAR}, {_FAR}]"))} AS s FROM src
  UNION ALL SELECT g, i, {_inserted('s')} FROM (SELECT g, i, {_inserted('s')} AS s FROM (
    SELECT w.g, w.i + 1 AS i, {_STEP} AS s FROM walk w JOIN rows r ON r.g = w.g AND r.i = w.i + 1))),
best AS MATERIALIZED (SELECT g, list_min([s[1], s[4]]) AS b FROM (SELECT g, arg_max(s, i) AS s FROM walk GROUP BY g)),
edit AS (SELECT g, p, e, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS o FROM (
  SELECT g, unnest(string_split(b.a, '')) AS e, generate_subscripts(string_split(b.a, ''), 1) AS p FROM best WHERE b.a <> '')
  WINDOW w AS (PARTITION BY g ORDER BY p)),
kept AS (SELECT e.*, r.role, r.text, max(CASE WHEN o = 1 AND e = 'K' AND l = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.g) AS sys
  FROM edit e LEFT JOIN rows r ON r.g = e.g AND r.i = e.i AND e <> 'I' WHERE e <> 'D'),
done AS (SELECT g, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (o - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
  CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS h FROM kept GROUP BY g),
tally AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
  count(*) FILTER (cut) AS truncated, count(*) FILTER (before IS NOT NULL AND left(before, 1) || l NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY g)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, b.c AS cost, b.a AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM src) JOIN best USING (g) LEFT JOIN tally USING (g) LEFT JOIN done USING (g)"""

ORACLES["op12_merkle_manifest"] = f"""
WITH RECURSIVE {_CRC_TABLE},
doc AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, sha256({_LEAF} || {_field('text')}) AS leaf,
  sha256({_LEAF} || {_field('shown')}) AS changed FROM (SELECT *, CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0
    THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS shown FROM documents, crc_table)),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i,
  dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER (PARTITION BY lang) AS n FROM doc),
low AS (SELECT CAST(0 AS BIGINT) AS level, g, i, leaf AS d, n FROM placed UNION ALL {_UP.format(t='low')}),
low_m AS MATERIALIZED (SELECT * FROM low),
subs AS MATERIALIZED (SELECT g, d AS subroot, level AS top FROM low_m WHERE n = 1),
high AS (SELECT CAST(0 AS BIGINT) AS level, CAST(-1 AS BIGINT) AS g, g AS i, subroot AS d, count(*) OVER () AS n FROM subs
  UNION ALL {_UP.format(t='high')}),
high_m AS MATERIALIZED (SELECT * FROM high),
tree AS MATERIALIZED (SELECT level, g, i, d FROM low_m WHERE n > 1 UNION ALL SELECT level, g, i, d FROM high_m WHERE n > 1),
path AS (SELECT r, CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS level, g, i, changed AS f, '' AS proof, g AS own, top
    FROM placed JOIN subs USING (g)
  UNION ALL SELECT r, step + 1, CASE WHEN up THEN 0 ELSE level + 1 END, CASE WHEN up THEN -1 ELSE g END,
    CASE WHEN up THEN own ELSE i // 8 END,
    CASE WHEN up THEN f ELSE sha256((SELECT string_agg(CASE WHEN t.i = p.i THEN p.f ELSE t.d END, '' ORDER BY t.i)
      FROM tree t WHERE t.level = p.level AND t.g = p.g AND t.i // 8 = p.i // 8)) END,
    proof || CASE WHEN up THEN '' ELSE coalesce((SELECT string_agg(t.d, '' ORDER BY t.i)
      FROM tree t WHERE t.level = p.level AND t.g = p.g AND t.i // 8 = p.i // 8 AND t.i <> p.i), '') END, own, top
  FROM (SELECT *, g >= 0 AND level = top AS up FROM path) p
  WHERE p.up OR EXISTS (SELECT 1 FROM tree t WHERE t.level = p.level AND t.g = p.g)),
ends AS (SELECT r, arg_max(f, step) AS folded_root, arg_max(proof, step) AS proof FROM path GROUP BY r)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN subs USING (g) JOIN ends USING (r), (SELECT d AS root FROM high_m WHERE n = 1)"""

ORACLES["op13_source_mix"] = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(sha256('0:' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
-- sources stop in the order of size for weight; the first level that the next source does not stop below is the one
o AS (SELECT *, sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER (ORDER BY source_size / w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size / w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft FROM s),
l AS (SELECT rest, lft FROM o WHERE 3 * CAST(source_size AS HUGEINT) * lft >= w * rest ORDER BY source_size / w LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN 3 * CAST(source_size AS HUGEINT) * lft < w * rest THEN 3.0::DOUBLE * source_size
  ELSE w::DOUBLE * rest::DOUBLE / lft::DOUBLE END AS target FROM s, l),
x AS (SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0 END AS rate FROM t)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source"""

if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
