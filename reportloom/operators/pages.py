"""Pages of a document: pagination, cleaning, gating, counts.

``pages`` is an array column ``array<struct<page_number, text, method>>`` on the
document row; every operator here is narrow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from reportloom.functions.arrays import (
    cut_and_join, grouped_counts, let, sorted_concat)
from reportloom.functions.text import (
    PAGE_NUMBER_LINES, clean_text, is_page_number, is_plain, line_fingerprint, lines_of, strip, word_count)

PAGE_TYPE = "array<struct<page_number:int,text:string,method:string>>"


def _as_pages(texts: Column) -> Column:
    return F.transform(texts, lambda t, i: F.struct(
        (i + 1).cast("int").alias("page_number"), t.alias("text"), F.lit("text").alias("method")))


def paginate_paragraphs(text: Column, limit: int = 3000) -> Column:
    """Greedy pages of whole paragraphs; separators do not count towards the limit."""
    def starts(paras: Column) -> Column:
        empty = F.struct(F.lit(0).alias("i"), F.lit(0).alias("size"),
                         F.array().cast("array<int>").alias("starts"))

        def step(acc, para):
            n = F.length(para)
            fresh = (acc["i"] == 0) | (acc["size"] + n > limit)
            return F.struct(
                (acc["i"] + 1).alias("i"),
                F.when(fresh, n).otherwise(acc["size"] + n).alias("size"),
                F.when(fresh, F.concat(acc["starts"], F.array(acc["i"] + 1)))
                .otherwise(acc["starts"]).alias("starts"))

        return F.aggregate(paras, empty, step, lambda acc: acc["starts"])

    # paragraphs of a text within the limit are one page, the text itself
    return F.when(F.length(text) <= limit, _as_pages(F.array(text))).otherwise(let(
        F.split(text, "\n\n"),
        lambda paras: _as_pages(let(starts(paras), lambda st: cut_and_join(paras, st, "\n\n")))))


def paginate_fixed(text: Column, width: int = 6000) -> Column:
    """Pages of exactly ``width`` characters; shorter texts stay whole."""
    # a regular expression cuts in one pass; substring() would rescan the text per page
    return _as_pages(F.when(F.length(text) <= width, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), 0)))


def explode_pages(docs: DataFrame, pages: Column) -> DataFrame:
    return docs.select("doc_id", F.explode(pages).alias("p")).select(
        "doc_id", "p.page_number", "p.text", "p.method")


def nest_pages(pages: DataFrame) -> DataFrame:
    """Page rows of any parser become one row per document."""
    return pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("page_number").cast("int").alias("page_number"), "text",
        F.col("method").alias("method")))).alias("pages"))


def repeated_lines(pages: Column, min_pages: int = 3, ratio: float = 0.7, max_len: int = 90) -> Column:
    """``array<struct<item, n>>``: line fingerprints found on most pages of a document."""
    def on_page(p):
        short = F.filter(
            F.transform(lines_of(p["text"]), strip),
            lambda s: (s != "") & (F.length(s) <= max_len) & ~is_page_number(s))
        return F.array_distinct(F.transform(short, line_fingerprint))

    def hot(ps):
        needed = F.greatest(F.lit(min_pages), F.floor(F.size(ps) * ratio).cast("int"))
        return F.filter(grouped_counts(F.flatten(F.transform(ps, on_page))), lambda c: c["n"] >= needed)

    # several pages are needed before a line can repeat
    return let(pages, lambda ps: F.when(F.size(ps) >= 3, hot(ps)).otherwise(
        F.array().cast("array<struct<item:string,n:int>>")))


def clean_plain(text: Column) -> Column:
    """What ``clean_pages`` makes of the only page of a document, for a text that ``is_plain``."""
    kept = F.regexp_replace(text, PAGE_NUMBER_LINES, "")
    done = strip(let(kept, lambda t: F.when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t)))
    return let(done, lambda t: F.when(t == "", text).otherwise(t))


def cleaned_texts(pages: Column) -> Column:
    """The pages of ``clean_pages``, without its counts; one plain text page is cleaned as a whole."""
    def single(p):
        return F.array(F.struct(p["page_number"].alias("page_number"), clean_plain(p["text"]).alias("text"),
                                p["method"].alias("method")))
    return let(pages, lambda ps: let(F.get(ps, F.lit(0)), lambda p: F.when(
        (F.size(ps) == 1) & (p["method"] == "text") & is_plain(p["text"]), single(p)).otherwise(clean_pages(ps)["pages"])))


def clean_pages(pages: Column) -> Column:
    """``struct<pages, removed_lines, squeezed_chars>``.

    Page numbers and repeated lines are dropped, white space is squeezed. A text
    page that would become empty keeps its first text.
    """
    def page(p, hot):
        stripped = F.transform(lines_of(p["text"]), lambda l: F.struct(
            F.length(l).alias("before"), strip(l).alias("s")))
        drop = F.transform(stripped, lambda l: F.struct(
            l["before"].alias("before"),
            ((l["s"] != "") & (is_page_number(l["s"]) | (
                (F.size(hot) > 0) & F.array_contains(hot, line_fingerprint(l["s"]))))).alias("drop"),
            F.regexp_replace(l["s"], r"[ \t]{2,}", " ").alias("s")))
        return let(drop, lambda ls: let(F.filter(ls, lambda l: ~l["drop"]), lambda kept: F.struct(
            p["page_number"].alias("page_number"),
            clean_text(F.array_join(F.transform(kept, lambda l: l["s"]), "\n")).alias("text"),
            p["method"].alias("method"),
            (F.size(ls) - F.size(kept)).alias("removed"),
            F.aggregate(F.filter(kept, lambda l: l["s"] != ""), F.lit(0),
                        lambda acc, l: acc + l["before"] - F.length(l["s"])).alias("squeezed"))))

    def whole(ps, hot):
        done = F.zip_with(ps, F.transform(ps, lambda p: page(p, hot)), lambda old, new: F.struct(
            new["page_number"].alias("page_number"),
            F.when((new["text"] == "") & (old["method"] == "text"), old["text"])
            .otherwise(new["text"]).alias("text"),
            new["method"].alias("method"), new["removed"].alias("removed"),
            new["squeezed"].alias("squeezed")))
        return let(done, lambda d: F.struct(
            F.transform(d, lambda p: F.struct(p["page_number"].alias("page_number"),
                                              p["text"].alias("text"),
                                              p["method"].alias("method"))).alias("pages"),
            F.aggregate(d, F.lit(0), lambda a, p: a + p["removed"]).alias("removed_lines"),
            F.aggregate(d, F.lit(0), lambda a, p: a + p["squeezed"]).alias("squeezed_chars")))

    return let(pages, lambda ps: let(
        F.transform(repeated_lines(ps), lambda c: c["item"]), lambda hot: whole(ps, hot)))


def gate(pages: Column, min_chars: int = 10) -> Column:
    """``struct<status, message>``: documents without usable text fail with a reason."""
    failed = F.transform(
        F.slice(F.filter(pages, lambda p: p["method"].isin("ocr-failed", "empty")), 1, 5),
        lambda p: p["page_number"].cast("string"))
    total = F.aggregate(pages, F.lit(0), lambda a, p: a + F.length(p["text"]))
    reason = F.concat(
        F.lit("Document contains no extractable text"),
        F.when(F.size(failed) > 0, F.concat(
            F.lit(" (pages ["), F.array_join(failed, ", "),
            F.lit("] appear to be scanned images and OCR is failed to read them)")))
        .otherwise(F.lit("")))
    return (F.when(F.size(pages) == 0, F.struct(
                F.lit("failed").alias("status"),
                F.lit("No pages could be extracted from this document").alias("message")))
            .when(total < min_chars, F.struct(
                F.lit("failed").alias("status"), reason.alias("message")))
            .otherwise(F.struct(F.lit("completed").alias("status"),
                                F.lit(None).cast("string").alias("message"))))


def page_word_counts(pages: Column) -> Column:
    return let(pages, lambda ps: F.struct(
        F.size(ps).alias("page_count"),
        F.aggregate(ps, F.lit(0), lambda a, p: a + word_count(p["text"])).alias("word_count")))


def export_text(pages: Column) -> Column:
    return F.array_join(F.transform(pages, lambda p: F.concat(
        F.lit("--- Page "), p["page_number"].cast("string"), F.lit(" ("), p["method"],
        F.lit(") ---\n"), p["text"])), "\n\n")


def recognised_pages(words: DataFrame) -> DataFrame:
    """Text and mean confidence of OCR pages from recognised words.

    Input ``doc_id, page_number, word_no, word, confidence``; words without a
    positive confidence or without text do not count.
    """
    good = words.filter((F.col("confidence") > 0) & (strip(F.col("word")) != ""))
    return good.groupBy("doc_id", "page_number").agg(
        strip(sorted_concat(F.collect_list(F.struct("word_no", "word")), "word", " ")).alias("ocr_text"),
        F.round(F.avg("confidence"), 2).alias("ocr_confidence"))


def classify_pages(pages: DataFrame, min_conf: float = 40, min_ocr_chars: int = 10,
                   min_text_chars: int = 20, ocr_cap: int | None = None,
                   max_pages: int | None = None) -> DataFrame:
    """How each page got its text: ``text``, ``ocr``, ``ocr-failed`` or ``empty``.

    Input ``doc_id, page_number, native_text, ocr_text, ocr_confidence``. Every page
    counts unless ``max_pages`` or ``ocr_cap`` (recognised pages of a document) is set.
    """
    native = strip(F.coalesce(F.col("native_text"), F.lit("")))
    is_text = F.length(native) >= min_text_chars
    readable = (~is_text & (F.coalesce("ocr_confidence", F.lit(0.0)) >= min_conf)
                & (F.length(F.coalesce("ocr_text", F.lit(""))) >= min_ocr_chars))
    allowed = readable
    if ocr_cap is not None:
        w = W.partitionBy("doc_id").orderBy("page_number").rowsBetween(W.unboundedPreceding, 0)
        allowed = readable & (F.sum(readable.cast("int")).over(w) <= ocr_cap)
    if max_pages is not None:
        pages = pages.filter(F.col("page_number") <= max_pages)
    method = (F.when(is_text, "text").when(allowed, "ocr")
              .when(native == "", "ocr-failed").otherwise("empty"))
    return (pages.withColumn("method", method)
            .select("doc_id", "page_number", "method",
                    F.when(F.col("method") == "text", native)
                    .when(F.col("method") == "ocr", F.col("ocr_text"))
                    .otherwise(F.lit("")).alias("text"),
                    F.when(F.col("method") == "ocr", F.col("ocr_confidence")).alias("ocr_confidence")))
