"""First mentions of entities in plain section texts, in Arrow batches.

Texts of visible ASCII, blanks and line feeds (``PLAIN``) are searched here; every other text keeps the column form
of ``extract``, which this one must equal. A text is read twice: its words tell which of the patterns that begin with a
letter can match at all, its numbers where one that begins with a digit may start.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from reportloom.functions import vocab as V
from reportloom.functions.text import any_word

CONTEXT = 60
MEMORY = 200_000  # words and normal forms that a task remembers at a time

COLUMNS = ("entity_type", "raw_text", "normalized_text", "normalized_confidence", "source_snippet")
PLAIN = r"\A[\n -~]*+\z"

_WORD, _NUMBER = re.compile(r"[A-Za-z][A-Za-z\-]*"), re.compile(r"[0-9]+")
_I = re.IGNORECASE
_ISO, _SLASH, _DASH = (re.compile(p) for p in (V.DATE_ISO, V.DATE_SLASH, V.DATE_DASH))
_DOSE, _PRESSURE, _TEMPERATURE = (re.compile(p, _I) for p in (V.DOSE, V.BLOOD_PRESSURE, V.TEMPERATURE))
_MONTH_DATE = re.compile(V.DATE_WORDS, _I)
_BY_ENDING = re.compile(r"\b[a-z][a-z\-]{4,}" + any_word(V.MEDICATION_SUFFIXES, "i") + r"\b", _I)
_BY_NAME = re.compile(any_word(V.MEDICATION_NAMES, "i"), _I)
_ORGANIZATION, _PERSON = re.compile(V.ORGANIZATION), re.compile(V.PERSON)
_SHORT = {a: full for a, full in V.ABBREVIATIONS.items() if a.isalpha()}
_ABBREVIATION = re.compile(r"(?<![a-z])" + any_word(_SHORT, "i").replace(")", r")\b", 1) + r"\b", _I)
_MONTHS = {m.lower(): f"{i:02d}" for i, m in enumerate(V.MONTHS, 1)}


def _numbered(month: str, day: str, year: str) -> tuple[str | None, float]:
    if 1 <= int(month) <= 12 and 1 <= int(day) <= 31 and 1900 <= int(year) <= 2100:
        return f"{year}-{month.zfill(2)}-{day.zfill(2)}", 0.9
    return None, 0.3


def _temperature(g) -> tuple[str, float]:
    return f"{g[0]}°{'C' if g[1][0] in 'cC' else 'F'}", 1.0


def _dose(g) -> tuple[str, float]:
    unit = V.UNITS.get(g[1].lower())
    return f"{g[0]} {g[1] if unit is None else unit}", 0.5 if unit is None else 1.0


_MONTH_PARTS = re.compile(r"([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})")


def _month_date(text: str) -> tuple[str, float]:
    month, day, year = _MONTH_PARTS.match(text).groups()
    return f"{year}-{_MONTHS[month.lower()]}-{day.zfill(2)}", 1.0


#: by number of the rule: type, pattern, normal form and confidence of a match
RULES = (
    ("date", _ISO, lambda m: (m.group(), 1.0)),
    ("date", _MONTH_DATE, lambda m: _month_date(m.group())),
    ("date", _SLASH, lambda m: _numbered(*m.group().split("/"))),
    ("date", _DASH, lambda m: _numbered(*(m.group().split("-")[k] for k in (1, 0, 2)))),
    ("medication", _BY_ENDING, lambda m: (m.group().lower(), 0.9)),
    ("medication", _BY_NAME, lambda m: (m.group().lower(), 1.0)),
    ("dose", _DOSE, lambda m: _dose(m.groups())),
    ("vitals", _PRESSURE, lambda m: (f"{m.group(1)}/{m.group(2)} mmHg", 1.0)),
    ("vitals", _TEMPERATURE, lambda m: _temperature(m.groups())),
    ("organization", _ORGANIZATION, lambda m: (None, None)),
    ("person", _PERSON, lambda m: (None, None)),
    ("abbreviation", _ABBREVIATION, lambda m: (_SHORT[m.group().lower()], 1.0)))

_FIRST_NAMES = tuple({n.lower().split()[0] for n in V.MEDICATION_NAMES})
_PLACES = ("Hospital", "Clinic", "Center", "System", "Lab", "Institute", "University")


def _rules_of(word: str) -> int:
    """The rules that need such a word, one bit each."""
    low, rules = word.lower(), 0
    for k, needed in ((1, _MONTHS), (4, V.MEDICATION_SUFFIXES), (5, _FIRST_NAMES)):
        rules |= any(n in low for n in needed) << k
    rules |= any(p in word for p in _PLACES) << 9 | ("Dr" in word) << 10
    return rules | any(part in _SHORT for part in low.split("-")) << 11


def _at_numbers(text: str, found: list) -> None:
    """Matches of the rules that begin with a digit."""
    past = [0] * len(RULES)
    for m in _NUMBER.finditer(text):
        begin, end = m.span()
        if begin and ((c := text[begin - 1]).isalpha() or c == "_"):
            continue
        size, after = end - begin, text[end:end + 1]
        if not after:
            continue
        if after == "-":
            wanted = (0,) if size == 4 else (3,) if size < 3 else ()
        elif after == "/":
            wanted = ((2, 7) if size == 2 else (2,)) if size < 3 else (7,) if size == 3 else ()
        elif after in " \n.":
            wanted = (6, 7, 8) if 1 < size < 4 else (6,)
        elif after in "mgkui" or after in "MGKUI":
            wanted = (6,)
        elif after in "dcfDCF":
            wanted = (8,) if 1 < size < 4 else ()
        else:
            continue
        for k in wanted:
            if begin >= past[k] and (hit := RULES[k][1].match(text, begin)):
                past[k] = hit.end()
                found.append((RULES[k][0], hit.group().strip(" \n"), k, begin, hit))


def first_mentions(text: str, words: dict[str, int], normal: dict[tuple, tuple]) -> list[tuple]:
    """``COLUMNS`` of the first mentions by (type, text), in that order; ``words`` and ``normal`` are remembered results."""
    rules = 0
    for word in _WORD.findall(text):
        known = words.get(word)
        if known is None:
            if len(words) >= MEMORY:
                words.clear()
            known = words[word] = _rules_of(word)
        rules |= known
    found: list[tuple] = []
    _at_numbers(text, found)
    for k in (1, 4, 5, 9, 10, 11):
        if rules >> k & 1:
            kind, pattern, _ = RULES[k]
            found += [(kind, m.group().strip(" \n"), k, m.start(), m) for m in pattern.finditer(text)]
    found.sort(key=lambda h: h[:4])
    out, last = [], None
    for kind, raw, k, begin, m in found:
        if (kind, raw) == last:
            continue
        last = kind, raw
        match = m.group()
        if (form := normal.get((k, match))) is None:
            if len(normal) >= MEMORY:
                normal.clear()
            form = normal[k, match] = RULES[k][2](m)
        around = text[max(begin - CONTEXT, 0):m.end() + CONTEXT]
        out.append((kind, raw, *form, around.replace("\n", " ").strip(" ")))
    return out


def find_in_batches(sections: DataFrame) -> DataFrame:
    """Section key and ``COLUMNS`` of the first mentions in sections whose texts are ``PLAIN``."""
    key = ["doc_id", "section_idx", "page_number"]
    rows = sections.select(*key, "text")

    def run(batches):
        words: dict[str, int] = {}
        normal: dict[tuple, tuple] = {}
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                hits = first_mentions(text, words, normal)
                at += [i] * len(hits)
                found += hits
            where, fields = pa.array(at, pa.int32()), list(zip(*found)) or [()] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(where) for k in range(3)), *(
                pa.array(v, pa.float64() if c == "normalized_confidence" else pa.string()) for v, c in zip(fields, COLUMNS))],
                [*key, *COLUMNS])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key]
    return rows.mapInArrow(run, ", ".join(kinds + [f"{c} {'double' if c == 'normalized_confidence' else 'string'}" for c in COLUMNS]))
