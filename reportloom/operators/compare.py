"""Differences and conflicting values between pairs of documents, all pairs at once.

Measurements carry ``ord``, their fixed reading order in a document; "first" always
means smallest ``ord``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from reportloom.functions import vocab as V
from reportloom.functions.normalize import format_measurement, same_value
from reportloom.functions.text import WS, name_key, strip, title_case

FIELDS = ("name", "value_raw", "value_num", "unit", "reference_range", "flag", "page_number",
          "section_idx", "source_snippet")
COMPARED_TYPES = ("medication", "organization", "person", "procedure")


def eligible_pairs(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """Requested pairs of two different completed documents of one owner."""
    d = documents.filter("status = 'completed'").select("doc_id", "owner_id")
    a = d.select(F.col("doc_id").alias("doc_a"), F.col("owner_id"))
    b = d.select(F.col("doc_id").alias("doc_b"), F.col("owner_id"))
    return pairs.filter("doc_a <> doc_b").join(a, "doc_a").join(b, ["doc_b", "owner_id"])


def first_by_name(measurements: DataFrame) -> DataFrame:
    """First measurement of every name of a document; combined before the shuffle."""
    keyed = measurements.withColumn("key", name_key(F.col("name")))
    return keyed.groupBy("doc_id", "key").agg(
        F.min_by(F.struct("ord", *FIELDS), "ord").alias("m"))


def _plain_decimal(x):
    """A number rounded to four places without an exponent: ``0.0005``, ``24999990.0``."""
    return F.regexp_replace(x.cast("decimal(38,4)").cast("string"), r"(\.\d+?)0+$", "$1")


def compare_measurements(pairs: DataFrame, measurements: DataFrame) -> DataFrame:
    """One row per pair and name: unchanged, changed, removed or added, with a note."""
    first = first_by_name(measurements)
    a = pairs.select("pair_id", F.col("doc_a").alias("doc_id")).join(first, "doc_id").select(
        "pair_id", "key", F.col("m").alias("a"))
    b = pairs.select("pair_id", F.col("doc_b").alias("doc_id")).join(first, "doc_id").select(
        "pair_id", "key", F.col("m").alias("b"))
    both = a.join(b, ["pair_id", "key"], "full_outer")
    num_a, num_b = F.col("a.value_num"), F.col("b.value_num")
    same = same_value(num_a, F.col("a.value_raw"), num_b, F.col("b.value_raw"))
    kind = (F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added")
            .when(same, "unchanged").otherwise("changed"))

    def moved(field, label):
        old, new = F.coalesce(f"a.{field}", F.lit("")), F.coalesce(f"b.{field}", F.lit(""))
        dash = F.lit("—")
        return F.when(old != new, F.concat(
            F.lit(f"{label}: "), F.coalesce(F.nullif(old, F.lit("")), dash), F.lit(" → "),
            F.coalesce(F.nullif(new, F.lit("")), dash), F.lit(".")))

    delta = F.round(num_b - num_a, 4)
    change = F.concat(
        F.lit("Value changed from "), F.col("a.value_raw"), F.lit(" to "), F.col("b.value_raw"),
        F.when(delta.isNull(), F.lit(".")).otherwise(F.concat(
            F.lit(" ("), F.when(num_b - num_a >= 0, F.lit("+")).otherwise(F.lit("")),
            _plain_decimal(delta), F.lit(")."))))
    return both.select(
        "pair_id", "key", F.lit("Measurement").alias("category"),
        title_case(F.coalesce("a.name", "b.name")).alias("item"), kind.alias("change_type"), "a", "b",
        F.when(kind == "changed", F.concat_ws(
            " ", change, moved("unit", "Unit"), moved("flag", "Flag"))).alias("change_note"))


def with_values(rows: DataFrame) -> DataFrame:
    """Replace the two measurements of comparison rows by their display text."""
    for side in ("a", "b"):
        m = F.col(side)
        rows = rows.withColumn(f"value_{side}", F.when(m.isNotNull(), format_measurement(
            m["value_raw"], m["unit"], m["reference_range"], m["flag"])))
    return rows


def note_missing(rows: DataFrame, pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """Notes of one-sided rows name the document that has the value."""
    titles = documents.select("doc_id", "title")
    named = (pairs.join(titles.select(F.col("doc_id").alias("doc_a"), F.col("title").alias("title_a")), "doc_a")
             .join(titles.select(F.col("doc_id").alias("doc_b"), F.col("title").alias("title_b")), "doc_b")
             .select("pair_id", "title_a", "title_b"))
    measured = F.col("category") == "Measurement"
    return rows.join(named, "pair_id").withColumn("change_note", F.when(
        F.col("change_type") == "removed", F.concat(
            F.when(measured, F.lit("Present only in ")).otherwise(F.lit("Only mentioned in ")),
            "title_a", F.lit("."))).when(
        F.col("change_type") == "added", F.concat(
            F.when(measured, F.lit("Newly recorded in ")).otherwise(F.lit("Newly mentioned in ")),
            "title_b", F.lit("."))).otherwise(F.col("change_note"))).drop("title_a", "title_b")


def _term_rows(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """``pair_id, entity_type, item, sides``, and ``first``: document, section, text and page of its first mention."""
    section = F.col("section_idx") if "section_idx" in entities.columns else F.lit(0)
    shown = (entities.filter(F.col("entity_type").isin(*COMPARED_TYPES))
             .withColumn("item", strip(F.coalesce(F.nullif("normalized_text", F.lit("")), "raw_text")))
             .groupBy("doc_id", "entity_type", "item").agg(F.min(F.struct(
                 section.alias("section_idx"), "page_number", "raw_text")).alias("m")))
    sides = pairs.select("pair_id", F.explode(F.array(
        F.struct(F.col("doc_a").alias("doc_id"), F.lit(1).alias("side")),
        F.struct(F.col("doc_b").alias("doc_id"), F.lit(2).alias("side")))).alias("s")).select(
        "pair_id", "s.doc_id", "s.side")
    # a term of both sides sums to 3; one shuffle instead of two anti-joins
    return sides.join(shown, "doc_id").groupBy("pair_id", "entity_type", "item").agg(
        F.sum("side").alias("sides"), F.min_by(F.struct("doc_id", "m.*"), "side").alias("first")).filter("sides < 3")


def compare_entities(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Terms of one document of a pair that the other lacks."""
    return _term_rows(pairs, entities).select(
        "pair_id", F.concat(F.initcap("entity_type"), F.lit("s")).alias("category"), "item",
        F.when(F.col("sides") == 1, "removed").otherwise("added").alias("change_type"), F.col("first.page_number").alias("page_number"))


def resolve_chunks(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk that holds the source line of ``doc_id, section_idx, source_snippet`` rows."""
    text = chunks.select("doc_id", "section_idx", "chunk_index", "text")
    hit = rows.join(text, ["doc_id", "section_idx"]).filter(F.contains("text", F.col("source_snippet")))
    return hit.groupBy(*rows.columns).agg(F.min("chunk_index").alias("chunk_index"))


def comparison_citations(compared: DataFrame, pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``[C1]...`` over the rows of a pair in order, side a before side b."""
    rank = F.when(F.col("change_type").isin("unchanged", "changed"), 0).when(
        F.col("change_type") == "removed", 1).otherwise(2)
    sides = with_values(compared).join(pairs, "pair_id").select(
        "pair_id", rank.alias("grp"), "key", F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.col("doc_a").alias("doc_id"), F.col("a").alias("m"),
                     F.col("value_a").alias("value")),
            F.struct(F.lit(1).alias("side"), F.col("doc_b").alias("doc_id"), F.col("b").alias("m"),
                     F.col("value_b").alias("value")))).alias("s")).filter("s.m is not null")
    flat = sides.select("pair_id", "grp", "key", "s.side", "s.doc_id", "s.m.section_idx",
                        "s.m.page_number", "s.m.source_snippet",
                        F.substring("s.value", 1, 200).alias("quote"))
    w = W.partitionBy("pair_id").orderBy("grp", "key", "side")
    return resolve_chunks(flat, chunks).select(
        "pair_id", F.concat(F.lit("[C"), F.row_number().over(w).cast("string"), F.lit("]")).alias("ref"),
        "doc_id", "chunk_index", "page_number", "quote")


def _solid(text):
    """Characters of a text that are not white space; packing into chunks moves none of them."""
    return F.length(F.regexp_replace(text, WS, ""))


def place_in_chunks(rows: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """``rows`` with ``chunk_index``, the chunk of their section that holds the beginning of ``needle``.

    ``rows`` have ``doc_id, section_idx, needle``, a text of the section. Chunks divide the section's
    characters, white space aside, into ranges; places and range starts are swept in order once, and a
    place belongs to the last range that began. Rows whose text does not occur, or whose section has no
    chunk, are left out.
    """
    key = ["doc_id", "section_idx"]
    before = W.partitionBy(*key).orderBy("chunk_index").rowsBetween(W.unboundedPreceding, -1)
    starts = chunks.filter("section_idx is not null").select(*key, "chunk_index", _solid(F.col("text")).alias("n")).select(
        *key, F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("at"), F.col("chunk_index").alias("begun"),
        F.lit(None).cast(rows.withColumn("_row", F.struct(*rows.columns)).schema["_row"].dataType).alias("row"))
    place = F.position(F.col("needle"), F.col("text"))
    found = rows.withColumn("row", F.struct(*rows.columns)).join(sections.select(*key, "text"), key).filter(place > 0).select(
        *key, _solid(F.substr(F.col("text"), F.lit(1), place - 1)).cast("long").alias("at"), F.lit(None).cast("int").alias("begun"), "row")
    # a range that begins at a place comes before it
    sweep = W.partitionBy(*key).orderBy("at", F.col("row").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    swept = starts.unionByName(found).withColumn("chunk_index", F.last("begun", True).over(sweep))
    return swept.filter("row is not null and chunk_index is not null").select("row.*", "chunk_index")


def cite_comparison(compared: DataFrame, entities: DataFrame, pairs: DataFrame, sections: DataFrame, chunks: DataFrame,
                    documents: DataFrame) -> DataFrame:
    """``[C1]...`` over all rows of a comparison, with the title of the document cited.

    Measurements that both have, those of the first alone, of the second alone, each by name, side a before
    side b; then medications, organizations, people and procedures, each first what is gone, then what is new.
    """
    kind = F.when(F.col("change_type").isin("unchanged", "changed"), 0).when(F.col("change_type") == "removed", 1).otherwise(2)
    measured = with_values(compared).join(pairs, "pair_id").select(
        "pair_id", F.lit(0).alias("grp"), kind.alias("sub"), "key", F.explode(F.array(*(F.struct(
            F.lit(i).alias("side"), F.col(f"doc_{x}").alias("doc_id"), F.col(x).alias("m"), F.col(f"value_{x}").alias("value"))
            for i, x in enumerate("ab")))).alias("s")).filter("s.m is not null").select(
        "pair_id", "grp", "sub", "key", "s.side", "s.doc_id", "s.m.section_idx", "s.m.page_number",
        F.col("s.m.source_snippet").alias("needle"), F.col("s.value").alias("quote"))
    order = F.array_position(F.array(*(F.lit(t) for t in COMPARED_TYPES)), F.col("entity_type")).cast("int")
    terms = _term_rows(pairs, entities).select(
        "pair_id", order.alias("grp"), F.col("sides").cast("int").alias("sub"), F.col("item").alias("key"), (F.col("sides") - 1).cast("int").alias("side"),
        "first.doc_id", "first.section_idx", "first.page_number", F.col("first.raw_text").alias("needle"), F.col("item").alias("quote"))
    placed = place_in_chunks(measured.unionByName(terms).withColumn("quote", F.substring("quote", 1, 200)), sections, chunks)
    w = W.partitionBy("pair_id").orderBy("grp", "sub", "key", "side")
    return placed.withColumn("ref", F.concat(F.lit("[C"), F.row_number().over(w).cast("string"), F.lit("]"))).join(
        documents.select("doc_id", F.col("title").alias("document_title")), "doc_id", "left").select(
        "pair_id", "ref", "doc_id", "document_title", "chunk_index", "page_number", "quote")


def comparison_summary(measured: DataFrame, terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts per change type and the sentence that states them, for every pair."""
    rows = measured.select("pair_id", "change_type", F.lit(1).alias("m")).unionAll(
        terms.select("pair_id", "change_type", F.lit(0).alias("m")))
    counts = rows.groupBy("pair_id").agg(
        F.sum("m").alias("compared"),
        *[F.count_if(F.col("change_type") == t).alias(t)
          for t in ("changed", "added", "removed", "unchanged")])
    counts = pairs.select("pair_id").distinct().join(counts, "pair_id", "left").fillna(0)
    return counts.withColumn("summary", F.concat(
        F.lit("Compared "), F.col("compared").cast("string"), F.lit(" recorded values and terms: "),
        F.col("changed").cast("string"), F.lit(" changed, "), F.col("added").cast("string"),
        F.lit(" newly added, "), F.col("removed").cast("string"), F.lit(" no longer mentioned, "),
        F.col("unchanged").cast("string"), F.lit(
            " unchanged. All differences are stated as recorded-value changes without clinical "
            "interpretation.")))


def filter_changes(rows: DataFrame, change_type: str) -> DataFrame:
    return rows.filter(F.col("change_type") == change_type)


def count_changes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category", "change_type").agg(F.count("*").alias("n"))


# --- conflicts -----------------------------------------------------------------------------

def _conflicts(joined: DataFrame) -> DataFrame:
    """``pair_id, ord, a, b`` rows whose values differ, as conflict claims."""
    a, b = F.col("a"), F.col("b")
    differ = ~same_value(a["value_num"], a["value_raw"], b["value_num"], b["value_raw"])

    def recorded(m):
        return F.concat(m["value_raw"], F.coalesce(F.concat(F.lit(" "), F.nullif(m["unit"], F.lit(""))), F.lit("")))

    def claim(m):
        return F.concat(m["name"], F.lit(" = "), m["value_raw"])

    return joined.filter(differ).select(
        "pair_id", "doc_a", "doc_b", F.lit("value_conflict").alias("type"), F.lit("high").alias("severity"),
        F.lit(0.9).alias("confidence"),
        F.concat(F.lit("'"), a["name"], F.lit("' is recorded as "), recorded(a), F.lit(" in one place and "),
                 recorded(b), F.lit(" in another.")).alias("explanation"),
        claim(a).alias("claim_a"), claim(b).alias("claim_b"),
        F.substring(a["source_snippet"], 1, 250).alias("quote_a"),
        F.substring(b["source_snippet"], 1, 250).alias("quote_b"), F.col("ord"))


def dedup_conflicts(conflicts: DataFrame) -> DataFrame:
    """First conflict of every (type, claim, claim) of a pair."""
    keys = ["pair_id", "type", "claim_a", "claim_b"]
    rest = [c for c in conflicts.columns if c not in (*keys, "ord")]
    return conflicts.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("r")).select(
        *keys, *[f"r.{c}" for c in rest])


def value_conflicts(pairs: DataFrame, measurements: DataFrame) -> DataFrame:
    """Every measurement of document a against the first of that name in b."""
    every = measurements.select("doc_id", name_key(F.col("name")).alias("key"), "ord",
                                F.struct(*FIELDS).alias("a"))
    a = pairs.join(every.withColumnRenamed("doc_id", "doc_a"), "doc_a")
    b = first_by_name(measurements).select(F.col("doc_id").alias("doc_b"), "key", F.col("m").alias("b"))
    return dedup_conflicts(_conflicts(a.join(b, ["doc_b", "key"])))


def internal_conflicts(measurements: DataFrame) -> DataFrame:
    """The same inside one document: each measurement against the first other one."""
    keyed = measurements.withColumn("key", name_key(F.col("name")))
    w = W.partitionBy("doc_id", "key").orderBy("ord")
    two = (keyed.withColumn("n", F.row_number().over(w)).filter("n <= 2")
           .groupBy("doc_id", "key").agg(
        F.max(F.when(F.col("n") == 1, F.struct("ord", *FIELDS))).alias("one"),
        F.max(F.when(F.col("n") == 2, F.struct("ord", *FIELDS))).alias("two")).filter("two is not null"))
    every = keyed.select("doc_id", "key", "ord", F.struct(*FIELDS).alias("a"))
    joined = every.join(two, ["doc_id", "key"]).withColumn(
        "b", F.when(F.col("ord") == F.col("one.ord"), F.col("two")).otherwise(F.col("one")))
    return dedup_conflicts(_conflicts(joined.select(
        F.col("doc_id").alias("pair_id"), F.col("doc_id").alias("doc_a"), F.col("doc_id").alias("doc_b"),
        "ord", "a", "b")))


def internal_notes(documents: DataFrame, entities: DataFrame, conflicts: DataFrame) -> DataFrame:
    dates = (entities.filter("entity_type = 'date' and normalized_text is not null")
             .groupBy("doc_id").agg(F.count_distinct("normalized_text").alias("dates")))
    found = conflicts.groupBy(F.col("doc_a").alias("doc_id")).agg(F.count("*").alias("n"))
    return documents.select("doc_id").join(dates, "doc_id", "left").join(found, "doc_id", "left").select(
        "doc_id", F.array_compact(F.array(
            F.lit(V.INTERNAL_SCAN), F.concat(F.coalesce("dates", F.lit(0)).cast("string"), F.lit(
                " distinct dates detected; only structured value conflicts are flagged.")),
            F.when(F.col("n").isNull(), V.NO_CONFLICTS))).alias("notes"))


def pair_notes(pairs: DataFrame, dates: DataFrame, conflicts: DataFrame) -> DataFrame:
    found = conflicts.groupBy("pair_id").agg(F.count("*").alias("n"))
    a = dates.select(F.col("doc_id").alias("doc_a"), F.col("doc_date").alias("date_a"))
    b = dates.select(F.col("doc_id").alias("doc_b"), F.col("doc_date").alias("date_b"))
    return (pairs.join(a, "doc_a", "left").join(b, "doc_b", "left").join(found, "pair_id", "left")
            .select("pair_id", F.array_compact(F.array(
                F.when(F.col("date_a") != F.col("date_b"), V.DATES_DIFFER),
                F.when(F.col("n").isNull(), V.NO_CONFLICTS))).alias("notes")))
