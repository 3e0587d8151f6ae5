"""Entities and measurements from section text, and measurements from tables.

All matches of a section are found, ordered and de-duplicated inside the section's
row. Nothing is shuffled: sections of any corpus are processed where they are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.functions import vocab as V
from reportloom.functions.arrays import let, literal_map
from reportloom.functions.normalize import normalize_date, normalize_unit
from reportloom.functions.text import any_word, lines_of, strip, title_case
from reportloom.operators.mentions import PLAIN, find_in_batches

CONTEXT = 60
# every match is at least two characters, so this many neighbours fill the context
NEIGHBOURS = CONTEXT // 2
DIGIT_NEXT = r"(?=\d)"
# what every lab line has, tested once for a whole text
LAB_VALUE = r"(?U)[:|\t]\s*\d"

ENTITY_COLUMNS = ("entity_type", "raw_text", "normalized_text", "normalized_confidence",
                  "source_snippet")


def snippet(before: Column, match: Column, after: Column) -> Column:
    """The match with up to 60 characters on either side, on one line."""
    around = F.concat(F.right(before, F.lit(CONTEXT)), match, F.left(after, F.lit(CONTEXT)))
    return strip(F.replace(around, F.lit("\n"), F.lit(" ")))


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut around the matches of ``pattern``: what is before the first, the first, what is between, ..."""
    # split() compiles a pattern for every row; a replacement keeps it, and one character needs none
    apart = F.zip_with(F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), 0),
                       lambda p, m: F.array_compact(F.array(p, m)))
    return F.when(F.contains(text, F.lit("\u0001")), F.flatten(apart)).otherwise(
        F.split(F.regexp_replace(text, pattern, "\u0001$0\u0001"), "\u0001"))


def _around(pieces: Column, at: Column) -> tuple[Column, Column, Column]:
    """What is before the match at the 0-based place ``at`` of ``_pieces``, the match, and what is after it.

    The surroundings come from neighbouring pieces, which costs the same for a short and a
    very long text; offsets into the whole text would be re-scanned per match.
    """
    begin = F.greatest(at - 2 * NEIGHBOURS - 1, F.lit(0))
    return (F.array_join(F.slice(pieces, begin + 1, at - begin), ""), F.get(pieces, at),
            F.array_join(F.slice(pieces, at + 2, 2 * NEIGHBOURS + 1), ""))


def find_all(text: Column, pattern: str, build) -> Column:
    """``build(match, index0, snippet)`` of every match of ``pattern``."""
    return let(_pieces(text, pattern), lambda ps: F.transform(
        F.filter(F.transform(ps, lambda _p, i: i), lambda i: i % 2 == 1),
        lambda i: build(F.get(ps, i), F.floor(i / 2).cast("int"), snippet(*_around(ps, i)))))


@dataclass(frozen=True)
class Rule:
    """Entities of one kind that a pattern finds; ``normal(match)`` gives their normal form and its confidence."""

    kind: str
    pattern: str
    normal: Callable[[Column], tuple[Column, Column]]
    needs: str | None = None  # a text without this has no match


def _date(pattern, fmt, flags, needs=None) -> Rule:
    def normal(m):
        d = normalize_date(m, fmt)
        return d["iso"], d["confidence"]
    return Rule("date", flags + pattern, normal, needs)


def extract_dates() -> list[Rule]:
    # a look at the first character is cheaper than a word boundary, here and below
    months = f"(?=[{''.join(sorted({m[0] for m in V.MONTHS}))}])"
    return [_date(DIGIT_NEXT + V.DATE_ISO, "iso", "(?U)", "-"), _date(months + V.DATE_WORDS, "us_textual", "(?iU)"),
            _date(DIGIT_NEXT + V.DATE_SLASH, "us_numeric", "(?U)", "/"), _date(DIGIT_NEXT + V.DATE_DASH, "dash", "(?U)", "-")]


def extract_medications(suffixes=V.MEDICATION_SUFFIXES, names=V.MEDICATION_NAMES) -> list[Rule]:
    by_ending = r"(?iU)(?=[a-z])\b[a-z][a-z\-]{4,}" + any_word(suffixes, "i") + r"\b"
    by_name = "(?iu)" + any_word(names, "i")
    return [Rule("medication", by_ending, lambda m: (F.lower(m), F.lit(0.9))),
            Rule("medication", by_name, lambda m: (F.lower(m), F.lit(1.0)))]


def extract_doses() -> list[Rule]:
    pattern = "(?iU)" + DIGIT_NEXT + V.DOSE

    def normal(m):
        unit = normalize_unit(F.regexp_extract(m, pattern, 2))
        return F.concat_ws(" ", F.regexp_extract(m, pattern, 1), unit["unit"]), unit["confidence"]
    return [Rule("dose", pattern, normal)]


def extract_blood_pressure() -> list[Rule]:
    pattern = "(?iU)" + DIGIT_NEXT + V.BLOOD_PRESSURE
    return [Rule("vitals", pattern, lambda m: (F.concat(
        F.regexp_extract(m, pattern, 1), F.lit("/"), F.regexp_extract(m, pattern, 2), F.lit(" mmHg")), F.lit(1.0)), "/")]


def extract_temperature() -> list[Rule]:
    pattern = "(?iU)" + DIGIT_NEXT + V.TEMPERATURE
    return [Rule("vitals", pattern, lambda m: (F.concat(
        F.regexp_extract(m, pattern, 1), F.lit("°"),
        F.when(F.lower(F.regexp_extract(m, pattern, 2)).startswith("c"), F.lit("C")).otherwise(F.lit("F"))), F.lit(1.0)))]


def _as_written(m):
    return F.lit(None), F.lit(None)


def extract_organizations() -> list[Rule]:
    return [Rule("organization", "(?U)(?=[A-Z])" + V.ORGANIZATION, _as_written)]


def extract_people() -> list[Rule]:
    return [Rule("person", "(?U)(?=D)" + V.PERSON, _as_written, "Dr")]


def extract_abbreviations(abbreviations=V.ABBREVIATIONS) -> list[Rule]:
    # only words of the map can match, so ordinary short words cost nothing further on
    letters = {a: full for a, full in abbreviations.items() if a.isalpha()}
    known = r"(?iU)(?<![a-z])" + any_word(letters, "i").replace(")", r")\b", 1) + r"\b"
    return [Rule("abbreviation", known, lambda m: (F.element_at(literal_map(letters), F.lower(m)), F.lit(1.0)))]


ALL_RULES = (extract_dates, extract_medications, extract_doses, extract_blood_pressure,
             extract_temperature, extract_organizations, extract_people, extract_abbreviations)


def first_mentions(hits: Column) -> Column:
    """Keep the first hit of every (type, text); output is ordered by (type, text)."""
    # no hit is null; sort_array compares natively, array_sort by an expression
    return let(F.sort_array(hits), lambda a: F.filter(a, lambda h, i: (i == 0) | (
        F.get(a, i - 1)["entity_type"] != h["entity_type"])
        | (F.get(a, i - 1)["raw_text"] != h["raw_text"])))


def _rules(makers) -> list[Rule]:
    return [r for make in makers for r in make()]


def _pieces_of(text: Column, rule: Rule) -> Column:
    """``_pieces``, or null for a text without a match."""
    has = text.rlike(rule.pattern)
    return F.when(has if rule.needs is None else F.contains(text, F.lit(rule.needs)) & has, _pieces(text, rule.pattern))


def _mentions(pieces: list[Column], rules: list[Rule], build) -> Column:
    """``build(hit, before, match, after)`` of the first mentions in the order of their type and text, from every rule's pieces."""
    def matches(ps, k):
        # sort order: type, text, then rule and position, so the first mention comes first
        return F.when(ps.isNotNull(), F.filter(F.transform(ps, lambda p, i: F.when(i % 2 == 1, F.struct(
            F.lit(rules[k].kind).alias("entity_type"), strip(p).alias("raw_text"), F.lit(k).alias("rule"), i.alias("i")))),
            lambda h: h.isNotNull()))

    def described(every, h):
        return let(F.get(every, h["rule"]), lambda ps: build(h, *_around(ps, h["i"])))

    return let(F.array(*pieces), lambda every: F.transform(first_mentions(F.flatten(F.array_compact(F.array(*(
        matches(F.get(every, F.lit(k)), k) for k in range(len(rules))))))), lambda h: described(every, h)))


def _normal(match: Column, rule: Column, rules: list[Rule]) -> Column:
    """``struct<text, confidence>`` of a match by the number of its rule."""
    made = F
    for k, r in enumerate(rules):
        text, confidence = r.normal(match)
        made = made.when(rule == k, F.struct(text.cast("string").alias("text"), confidence.cast("double").alias("confidence")))
    return made


def entity_hits(text: Column, rules=ALL_RULES) -> Column:
    """The first mentions of a text as an array."""
    chosen = _rules(rules)
    return let(text, lambda t: _mentions([_pieces_of(t, r) for r in chosen], chosen, lambda h, before, m, after: let(
        _normal(m, h["rule"], chosen), lambda n: F.struct(
            h["entity_type"], h["raw_text"], n["text"].alias("normalized_text"), n["confidence"].alias("normalized_confidence"),
            snippet(before, m, after).alias("source_snippet")))))


def extract_entities(sections: DataFrame, rules=ALL_RULES) -> DataFrame:
    """One row per first mention of an entity in a section.

    By all rules plain texts are searched in Arrow batches; other texts, and any by chosen rules, by column functions. The
    two are read apart: in one plan the code of the column functions, which is too long to be compiled, would
    hold up the rows of the batches. So sections that are costly to derive should be stored first.
    """
    if rules is not ALL_RULES:
        return _column_entities(sections, rules)
    plain = F.col("text").rlike(PLAIN)
    return find_in_batches(sections.filter(plain)).unionByName(_column_entities(sections.filter(~plain), rules))


def _column_entities(sections: DataFrame, rules) -> DataFrame:
    """Entities by column functions.

    Texts are cut before, normal forms and snippets are made after the mentions become rows: only what is
    between runs in array functions, which are interpreted.
    """
    key, chosen = ["doc_id", "section_idx", "page_number"], _rules(rules)
    cut = sections.select(*key, *(_pieces_of(F.col("text"), r).alias(f"_p{k}") for k, r in enumerate(chosen)))
    found = _mentions([F.col(f"_p{k}") for k in range(len(chosen))], chosen, lambda h, before, m, after: F.struct(
        h["entity_type"], h["raw_text"], h["rule"], before.alias("before"), m.alias("m"), after.alias("after")))
    rows = cut.select(*key, F.explode(found).alias("e")).withColumn("n", _normal(F.col("e.m"), F.col("e.rule"), chosen))
    return rows.select(*key, "e.entity_type", "e.raw_text", F.col("n.text").alias("normalized_text"),
                       F.col("n.confidence").alias("normalized_confidence"),
                       snippet(F.col("e.before"), F.col("e.m"), F.col("e.after")).alias("source_snippet"))


# --- measurements -----------------------------------------------------------------

MEASUREMENT_COLUMNS = ("name", "value_raw", "value_num", "unit", "unit_confidence",
                       "reference_range", "flag", "source_snippet")


def _measurement(name, raw, num, unit, ref, flag, snip) -> Column:
    return let(normalize_unit(unit), lambda u: F.struct(
        name.alias("name"), raw.alias("value_raw"),
        num.try_cast("double").alias("value_num"), u["unit"].alias("unit"),
        u["confidence"].alias("unit_confidence"),
        F.nullif(ref, F.lit("")).alias("reference_range"),
        flag.alias("flag"), snip.alias("source_snippet")))


def measurement_hits(text: Column) -> Column:
    """Lab lines ``name: value unit [range] flag`` of a text, in order."""
    pattern = "(?U)" + V.LAB_LINE
    lines = F.filter(F.transform(lines_of(text), strip), lambda l: l.rlike(pattern))
    # one pass rewrites the line to its five groups; an absent group is empty
    rows = F.transform(lines, lambda l, i: F.struct(
        l.alias("line"),
        F.split(F.regexp_replace(l, pattern, "$1\u0001$2\u0001$3\u0001$4\u0001$5"), "\u0001").alias("g")))
    usable = F.filter(rows, lambda r: let(strip(r["g"][0]), lambda n: (
        F.length(n) >= 2) & ~F.lower(n).isin(*V.NOT_A_LAB_NAME)))
    return F.transform(usable, lambda r: _measurement(
        title_case(strip(r["g"][0])), r["g"][1], r["g"][1], r["g"][2], r["g"][3],
        F.upper(F.nullif(F.regexp_replace(r["g"][4], r"[()]", ""), F.lit(""))),
        r["line"]))


def extract_measurements(sections: DataFrame) -> DataFrame:
    return (sections.filter(F.col("text").rlike(LAB_VALUE))
            .select("doc_id", "section_idx", "page_number",
                    F.posexplode(measurement_hits(F.col("text"))).alias("line_idx", "m"))
            .select("doc_id", "section_idx", "page_number", "line_idx",
                    *[f"m.{c}" for c in MEASUREMENT_COLUMNS]))


def map_table_columns(header: Column) -> Column:
    """``struct<test, value, unit, range, flag>`` of 1-based column positions, or null."""
    lowered = F.transform(header, F.lower)
    return let(lowered, lambda h: F.struct(*[
        F.coalesce(*[F.nullif(F.array_position(h, F.lit(name)), F.lit(0)) for name in names])
        .cast("int").alias(role)
        for role, names in V.TABLE_ROLES.items()]))


def measurements_from_tables(tables: DataFrame) -> DataFrame:
    """Measurements of table rows whose header names a test and a value column."""
    usable = (tables.filter((F.size("header") > 0) & (F.size("rows") > 0))
              .withColumn("at", map_table_columns(F.col("header")))
              .filter("at.test is not null and at.value is not null"))
    rows = usable.select("doc_id", "page_number", "table_index", "at",
                         F.posexplode("rows").alias("row_idx", "r"))

    def cell(role):
        return strip(F.coalesce(F.get(F.col("r"), F.col(f"at.{role}") - 1), F.lit("")))

    parts = F.array(*[cell(role) for role in V.TABLE_ROLES])
    wide_enough = F.size("r") >= F.greatest("at.test", "at.value")
    return (rows.filter(wide_enough & (cell("test") != "") & (cell("value") != ""))
            .select("doc_id", "page_number", "table_index", "row_idx", _measurement(
                cell("test"), cell("value"),
                F.nullif(F.regexp_extract(cell("value"), r"^\d+(?:\.\d+)?", 0), F.lit("")),
                cell("unit"), cell("range"),
                F.when(F.upper(F.left(cell("flag"), F.lit(1))).isin("H", "L"),
                       F.upper(F.left(cell("flag"), F.lit(1)))),
                F.array_join(F.filter(parts, lambda c: c != ""), " | ")).alias("m"))
            .select("doc_id", "page_number", "table_index", "row_idx",
                    *[f"m.{c}" for c in MEASUREMENT_COLUMNS]))


def union_measurements(from_tables: DataFrame, from_text: DataFrame) -> DataFrame:
    """Table rows first, then text rows; ``ord`` is the fixed reading order in a document."""
    def ordered(df, source, a, b):
        return df.select("doc_id", "page_number", F.struct(
            F.lit(source).alias("source"), F.col(a).cast("int").alias("part"),
            F.col(b).cast("int").alias("line")).alias("ord"),
            F.col("section_idx") if "section_idx" in df.columns
            else F.lit(None).cast("int").alias("section_idx"), *MEASUREMENT_COLUMNS)
    return ordered(from_tables, 0, "table_index", "row_idx").unionByName(
        ordered(from_text, 1, "section_idx", "line_idx"))


# --- document level -----------------------------------------------------------------

def document_dates(entities: DataFrame) -> DataFrame:
    return (entities.filter("entity_type = 'date' and normalized_confidence >= 0.9")
            .groupBy("doc_id").agg(F.min("normalized_text").alias("doc_date")))
