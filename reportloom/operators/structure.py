"""Titles, headings and sections of a document, computed on the document row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.functions import vocab as V
from reportloom.functions.arrays import let, literal_map, positions_where, slice_runs
from reportloom.functions.text import is_plain, lines_of, strip, word_count

MAX_HEADING = 90
LONGEST_KIND = max(map(len, V.SECTION_KINDS))


def section_kind(title: Column) -> Column:
    return F.element_at(literal_map(V.SECTION_KINDS), title)


def _without_colons(c: Column) -> Column:
    return let(c, lambda t: F.when(t.endswith(":"), F.regexp_replace(t, ":+$", "")).otherwise(t))


def classify_heading(stripped: Column) -> Column:
    """``struct<is_heading, kind>`` of one trimmed line."""
    no = F.struct(F.lit(False).alias("is_heading"), F.lit(None).cast("string").alias("kind"))

    def yes(kind):
        return F.struct(F.lit(True).alias("is_heading"), kind.alias("kind"))

    plain = F.lit(None).cast("string")

    def rules(s, base):
        # cheap tests come first; words are counted only for lines that could pass
        def short(n):
            return word_count(s) <= n

        known = F.when(F.length(base) <= LONGEST_KIND, section_kind(base))
        numbered = F.when(s.rlike(V.NUMBERED_HEADING) & short(10), section_kind(strip(
            _without_colons(F.regexp_replace(base, V.HEADING_NUMBER, "")))))
        capitals = s.rlike(r"^[^\p{L}]*(?:\p{Lu}[^\p{L}]*){2,}$") & short(12)
        label = s.endswith(":") & ~s.rlike(r"[.?!;]") & s.rlike(r"\p{L}") & short(10)
        kind = F.coalesce(known, numbered)
        return F.when(kind.isNotNull(), yes(kind)).when(capitals | label, yes(plain)).otherwise(no)

    def checked(s):
        return F.when(s.endswith(".") & (word_count(s) > 12), no).otherwise(
            let(strip(_without_colons(F.lower(s))), lambda base: rules(s, base)))

    return F.when((stripped == "") | (F.length(stripped) > MAX_HEADING), no).otherwise(checked(stripped))


def document_lines(pages: Column) -> Column:
    """``array<struct<page_number, s>>``: trimmed lines of all pages in order."""
    return F.flatten(F.transform(pages, lambda p: F.transform(lines_of(p["text"]), lambda l: F.struct(
        p["page_number"].alias("page_number"), strip(l).alias("s")))))


def detect_title(pages: Column) -> Column:
    """The first non-blank line, if it reads like a title."""
    first = F.get(F.filter(document_lines(pages), lambda l: l["s"] != ""), F.lit(0))["s"]
    return let(first, lambda s: F.when(
        (F.length(s) <= 100) & (word_count(s) <= 12) & ~s.rlike(r"[.?!;]$")
        & section_kind(_without_colons(F.lower(s))).isNull(), s))


# Lines of a plain text that could be headings: short ones, numbered ones, capitals, labels. Every heading is one;
# ``classify_heading`` decides.
_END = r"(?=\n|\z)"
CANDIDATE_LINE = (rf"(?:[^\n:]{{1,{LONGEST_KIND}}} ?:*+{_END}|\d|(?:[^\p{{L}}\n]|\p{{Lu}})++{_END}|[^\n]*+(?<=:))")


def _section(i, is_head, heading, kind, page_number, text) -> Column:
    title = let(strip(_without_colons(heading)), lambda name: F.when(
        (i == 0) & kind.isNull() & (name == "Document"), F.lit("Preamble")).otherwise(name))
    return F.struct(
        i.cast("int").alias("section_idx"),
        F.when(~is_head, F.lit("Preamble")).otherwise(title).alias("title"),
        kind.alias("kind"), page_number.alias("page_number"), strip(text).alias("text"))


def _sections_by_line(pages: Column) -> Column:
    marked = F.transform(document_lines(pages), lambda l: F.struct(
        l["page_number"].alias("page_number"), l["s"].alias("s"),
        classify_heading(l["s"]).alias("h")))

    def build(run, i):
        head = F.get(run, F.lit(0))
        is_head = head["h"]["is_heading"]
        body = F.transform(F.when(is_head, F.slice(run, 2, F.size(run))).otherwise(run), lambda l: l["s"])
        return _section(i, is_head, head["s"], head["h"]["kind"], head["page_number"], F.array_join(body, "\n"))

    def cut(ls):
        # the first line with text opens a section even when it is not a heading
        seen = let(F.transform(ls, lambda l: l["s"] != ""), lambda f: F.array_position(f, True))
        return let(seen, lambda first: let(
            positions_where(ls, lambda l, i: l["h"]["is_heading"] | (i + 1 == first)),
            lambda starts: slice_runs(ls, starts, build)))

    return let(marked, cut)


def _sections_of_plain(page: Column) -> Column:
    """Sections of the only page of a document, a plain text: cut before the lines that could be headings."""
    pieces = F.split(F.regexp_replace(page["text"], r"\n(?=" + CANDIDATE_LINE + ")", "\u0001"), "\u0001")
    marked = F.transform(pieces, lambda t: let(F.substring_index(t, "\n", 1), lambda line: F.struct(
        line.alias("line"), t.alias("t"), classify_heading(line).alias("h"))))

    def section(head, run, i):
        is_head = head["h"]["is_heading"]
        own = F.when(is_head, F.substr(head["t"], F.length(head["line"]) + 1)).otherwise(head["t"])
        text = F.when(F.size(run) == 1, own).otherwise(F.concat(own, F.lit("\n"), F.array_join(F.transform(
            F.slice(run, 2, F.size(run)), lambda p: p["t"]), "\n")))
        return _section(i, is_head, head["line"], head["h"]["kind"], page["page_number"], text)

    def build(run, i):
        return let(F.get(run, F.lit(0)), lambda head: section(head, run, i))

    # the first line has text and opens a section even when it is not a heading
    return let(marked, lambda ls: let(
        positions_where(ls, lambda p, i: p["h"]["is_heading"] | (i == 0)),
        lambda starts: slice_runs(ls, starts, build)))


def detect_sections(pages: Column) -> Column:
    """``array<struct<section_idx, title, kind, page_number, text>>``."""
    return let(pages, lambda ps: let(F.get(ps, F.lit(0)), lambda p: F.when(
        (F.size(ps) == 1) & is_plain(p["text"]) & (p["text"] != "") & ~p["text"].startswith("\n"),
        _sections_of_plain(p)).otherwise(_sections_by_line(ps))))


def explode_sections(docs: DataFrame, sections: Column) -> DataFrame:
    return docs.select("doc_id", F.explode(sections).alias("s")).select(
        "doc_id", "s.section_idx", "s.title", "s.kind", "s.page_number", "s.text")


def rematch_kind(sections: DataFrame) -> DataFrame:
    """Kind looked up again from the bare title; numbered headings lose it."""
    return sections.withColumn("kind", section_kind(strip(F.lower("title"))))
