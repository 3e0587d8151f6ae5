"""Runs and sentences are cut once, whatever is built of them."""

from pyspark.sql import functions as F

from reportloom.functions import arrays as A, text as T
from reportloom.operators import chunk as C


def test_a_run_is_sliced_once(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], [1, 3])], "xs array<int>, starts array<int>").select(A.slice_runs(
        F.col("xs"), F.col("starts"), lambda run, i: F.struct(F.get(run, F.lit(0)).alias("a"), F.size(run).alias("n"), i.alias("i"))).alias("r"))
    assert [tuple(x) for x in df.first().r] == [(1, 2, 0), (3, 3, 1)]
    assert df._jdf.queryExecution().analyzed().toString().count("slice(") == 1


def test_sentences_of_plain_and_marked_texts(spark):
    texts = ["A b. C d!  E?\nF", "A\u0001b. C d", ".", "", "one", ". . a", "Dr. X. y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        T.sentence_pieces(F.col("t")).alias("got"), F.split("t", T.SENTENCE_GAP).alias("want"))
    assert all(r.got == r.want for r in df.collect())


def test_blocks_of_a_text_are_packed_apart(one):
    assert one(C.pack_text, "A b. C d.\n\n \n\nE f.") == ["A b. C d.", "E f."]
    assert one(C.pack_text, "A b.\nC d.") == ["A b. C d."] and one(C.pack_text, " ") == []
