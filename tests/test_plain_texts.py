"""Plain texts handled whole give what handling them line by line gives; shared beginnings match the same words."""

import random
import re

from pyspark.sql import functions as F

from reportloom.functions import text as T, vocab as V
from reportloom.operators import pages as P, structure as S

LINES = ["", "Labs", "Labs:", "LABS ::", "Past Medical History", "1. Labs", "2) notes:", "10.2. Plan", "3 / 4", "page 2 of 9", "Page 2of 9",
         "- 7 -", "12", "12345", "iv / 3", "Document", "ALLERGIES NOTED TODAY", "A1", "B", "Is this one?:", "Take these: now", "Sodium: 138 mmol/L",
         "Nothing to add.", "Élan vital:", "ÉTÉ", "Klabs", "Follow-up", "follow up :", "x" * 95 + ":", ":", "...", "Assessment and plan ",
         "a  b", "a\tb", "tail ", " Notes", "c\x07d", "e f", "g\rh", "İcu:", "Plan: ", "ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE TEN ELEVEN TWELVE THIRTEEN"]


def test_whole_and_by_line(spark):
    rng = random.Random(5)
    texts = ["", "\n", " ", "12", "Labs", "\n\nLabs\n"] + LINES
    texts += ["\n".join(rng.choices(LINES[:32] if i % 3 else LINES, k=rng.randint(1, 12))) for i in range(600)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    page = F.array(F.struct(F.lit(1).alias("page_number"), F.col("t").alias("text"), F.lit("text").alias("method")))
    got = rows.select("t", T.is_plain(F.col("t")).alias("plain"), P.cleaned_texts(page).alias("a"), P.clean_pages(page)["pages"].alias("b"),
                      S.detect_sections(page).alias("c"), S._sections_by_line(page).alias("d")).collect()
    assert 100 < sum(r.plain for r in got) < len(got)
    for r in got:
        assert r.a == r.b, r.t
        assert r.c == r.d, r.t


def test_shared_beginnings(spark):
    for words in (V.MEDICATION_SUFFIXES, V.MEDICATION_NAMES, [a for a in V.ABBREVIATIONS if a.isalpha()]):
        plain = re.compile(r"(?i)\b(?:" + "|".join(words) + r")\b")
        shared = re.compile(r"(?i)\b" + T.any_word(words, "i") + r"\b")
        for w in words:
            for probe in (w, w.upper(), w + "x", "x" + w, f"a {w}, {w}s {w}", w[:-1]):
                assert plain.findall(probe) == shared.findall(probe)
