"""Sections and chunks of plain reports in Arrow batches.

A report of at most one page, of visible ASCII, blanks and line feeds, is cut here by one loop over its lines.
Every other text keeps the column form of ``structure`` and ``chunk``, which both forms must equal.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reportloom.functions import vocab as V
from reportloom.operators.chunk import HARD_MAX, MIN_CHUNK, TARGET
from reportloom.operators.structure import MAX_HEADING

PAGE_LIMIT = 3000
_NUMBER_ENDS = "0123456789-"

SECTION = pa.struct([("section_idx", pa.int32()), ("title", pa.string()), ("kind", pa.string()), ("page_number", pa.int32()),
                     ("text", pa.string())])
CHUNK = pa.struct([("chunk_index", pa.int32()), ("section_idx", pa.int32()), ("section_title", pa.string()), ("page_number", pa.int32()),
                   ("text", pa.string()), ("char_count", pa.int32()), ("token_estimate", pa.int32()), ("is_table_chunk", pa.bool_())])
SECTIONS_TYPE = "array<struct<section_idx:int,title:string,kind:string,page_number:int,text:string>>"
CHUNKS_TYPE = ("array<struct<chunk_index:int,section_idx:int,section_title:string,page_number:int,text:string,char_count:int,"
               "token_estimate:int,is_table_chunk:boolean>>")

_PAGE_NUMBER = re.compile(r"(?i)(?:(?:page ?)?[\divxlcm]+ ?(?:of|/) ?\d+|-? ?\d{1,4} ?-?)\Z")
_NUMBERED, _NUMBER = re.compile(V.NUMBERED_HEADING), re.compile(V.HEADING_NUMBER)
_CAPITALS = re.compile(r"[^A-Za-z]*(?:[A-Z][^A-Za-z]*){2,}\Z")
_LETTER, _CLAUSE = re.compile("[A-Za-z]"), re.compile("[.?!;]")
_GAP = re.compile(r"(?<=[.!?])[ \n]+")


def _is_plain(text: str) -> bool:
    """``text.is_plain`` for texts of visible ASCII; other texts are not plain here."""
    return text.isascii() and text.replace("\n", "").isprintable() and not (
        "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " ")


def _heading(line: str) -> tuple[bool, str | None]:
    """``structure.classify_heading`` of a trimmed line that has text."""
    if len(line) > MAX_HEADING:
        return False, None
    base = line.lower().rstrip(":").strip()
    kind, last = V.SECTION_KINDS.get(base), line[-1]
    if kind is None and line[0].isdigit() and len(line.split()) <= 10 and _NUMBERED.match(line):
        kind = V.SECTION_KINDS.get(_NUMBER.sub("", base).rstrip(":").strip())
    opens = (kind is not None or (line.isupper() and len(line.split()) <= 12 and _CAPITALS.match(line) is not None) or (
        last == ":" and len(line.split()) <= 10 and not _CLAUSE.search(line) and _LETTER.search(line) is not None))
    if opens and last == "." and len(line.split()) > 12:
        return False, None
    return opens, kind


def cut_sections(text: str | None) -> list[tuple] | None:
    """``section_idx, title, kind, page_number, text`` of the sections of a plain report; None for other texts."""
    if text is None or len(text) > PAGE_LIMIT or not _is_plain(text):
        return None
    # a page number ends in a digit or a dash
    lines = [x for x in text.split("\n") if x[-1:] not in _NUMBER_ENDS or not x or not _PAGE_NUMBER.match(x)]
    while lines and not lines[0]:
        del lines[0]
    while lines and not lines[-1]:
        del lines[-1]
    if not lines:
        return None
    out, body, head, kind, is_head, blanks = [], [], "", None, False, 0

    def close():
        title = head.rstrip(":").strip() if is_head else "Preamble"
        if not out and kind is None and title == "Document":
            title = "Preamble"
        out.append((len(out), title, kind, 1, "\n".join(body).strip()))

    for i, line in enumerate(lines):
        if not line:
            # two line feeds at most stay together
            if not blanks:
                body.append(line)
            blanks += 1
            continue
        blanks = 0
        opens, found = _heading(line)
        if opens or not i:
            if i:
                close()
            head, kind, is_head, body = line, found, opens, []
        if not opens:
            body.append(line)
    close()
    return out


def _packed(block: str) -> list[str]:
    """``chunk.pack_sentences`` of the sentences of a block."""
    if len(block) < TARGET - 1:
        # shorter than a chunk: nothing is cut
        return [_GAP.sub(" ", block)] if ". " in block or "\n" in block or "! " in block or "? " in block else [block]
    runs, size = [], 0
    for s in _GAP.split(block):
        if not size or size + len(s) > HARD_MAX:
            runs.append([s])
            size = len(s) + 1
        else:
            runs[-1].append(s)
            size += len(s) + 1
        if size >= TARGET:
            size = 0
    return [" ".join(r) for r in runs]


def pack_chunks(sections: list[tuple]) -> list[tuple]:
    """``chunk.document_chunks`` of ``cut_sections`` without tables."""
    runs = []
    for idx, title, _kind, page, text in sections:
        for block in text.split("\n\n") if text else ():
            for t in _packed(block):
                last = runs[-1] if runs else None
                if last and len(t) < MIN_CHUNK and last[0] == idx and last[4] + len(t) <= HARD_MAX:
                    last[3] += " " + t
                    last[4] += 1 + len(t)
                else:
                    runs.append([idx, title, page, t, len(t)])
    return [(i, idx, title, page, t, size, max(1, size // 4), False) for i, (idx, title, page, t, size) in enumerate(runs)]


def _lists(rows: list[list[tuple] | None], kind: pa.StructType) -> pa.Array:
    offsets, n = [], 0
    for r in rows:
        offsets.append(None if r is None else n)
        n += len(r or ())
    fields = list(zip(*(x for r in rows if r for x in r))) or [()] * kind.num_fields
    flat = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(fields, kind)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array([*offsets, n], pa.int32()), flat)


def cut_in_batches(docs: DataFrame, sections: bool, chunks: bool) -> DataFrame:
    """``docs`` with ``cut_sections`` and ``cut_chunks`` as wanted; the text stays where it is another text, else it is null."""
    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            cut = [cut_sections(t) for t in texts]
            columns = [*batch.columns]
            columns[at] = pa.array([t if c is None else None for t, c in zip(texts, cut)], pa.string())
            if sections:
                columns.append(_lists(cut, SECTION))
            if chunks:
                columns.append(_lists([None if c is None else pack_chunks(c) for c in cut], CHUNK))
            yield pa.RecordBatch.from_arrays(columns, names)

    at, names = docs.columns.index("text"), docs.columns + ["cut_sections"] * sections + ["cut_chunks"] * chunks
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(run, ", ".join(
        kinds + [f"cut_sections {SECTIONS_TYPE}"] * sections + [f"cut_chunks {CHUNKS_TYPE}"] * chunks))


def either(cut: str, other: Column) -> Column:
    """What was cut in batches, or ``other``."""
    return F.when(F.col(cut).isNotNull(), F.col(cut)).otherwise(other)
