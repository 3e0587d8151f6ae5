"""The model of personal data is learnt from all candidates."""

import pytest

pytest.importorskip("numpy")

from pyspark.sql import functions as F  # noqa: E402

from reportloom.llm import pii  # noqa: E402


def test_all_candidates_are_learnt_from(spark, monkeypatch):
    seen, write = [], pii.materialize

    def kept(df, name):
        out = write(df, name)
        seen.append(out.agg(F.sum("weight").alias("n"), F.count("*").alias("rows")).first())
        return out
    monkeypatch.setattr(pii, "materialize", kept)
    n = F.col("id").cast("string")
    texts = spark.range(15_000).select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("call +49 30 "), (F.col("id") + 1_000_000).cast("string"))).when(
        F.col("id") % 3 == 1, F.concat(F.lit("mail u"), n, F.lit("@host.org"))).otherwise(
        F.concat(F.lit("part "), (F.col("id") + 1_000_000).cast("string"))).alias("text"))
    model = pii.fit(texts.union(texts))
    # equal texts count once; what looks the same is one row
    assert seen[0].n == 15_000 and seen[0].rows < 500
    assert model.printed and {"email", "phone"} >= set(model.thresholds) > set()
