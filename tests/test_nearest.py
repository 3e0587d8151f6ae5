"""Bucketed search against the exact one; medians against plain Python."""

import random
import statistics

import numpy as np

from reportloom.operators import manage as O, nearest as N, retrieve as R


def test_bucketed_search(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 24))
    points = [(0 if i % 3 else 1, i, [float(x) for x in centres[i % 40] + 0.4 * rng.standard_normal(24)]) for i in range(1200)]
    points += [(0, 5000 + i, points[1][2]) for i in range(300)]  # one bucket holds a fifth: copies
    points += [(0, 9000, None), (0, 9001, [1.0, 2.0]), (0, 9002, [float("nan")] * 24)]
    vectors = spark.createDataFrame(points, "scope_id int, vec_id int, embedding array<float>")
    asked = spark.createDataFrame([(i, points[i][0], points[i][2]) for i in range(0, 1200, 25)] + [(7777, 0, None)],
                                  "query_id int, scope_id int, q array<double>")
    whole = vectors.filter("vec_id < 9000")
    exact = R.dense_topk(asked.filter("q is not null"), whole, 10)
    found = N.bucketed_topk(asked, vectors, 10, bits=5, probes=6).cache()
    row = N.recall(found, exact).first()
    assert row.queries == 48 and row.recall >= 0.9
    scores = {(r.query_id, r.vec_id): r.score for r in exact.collect()}
    got = {(r.query_id, r.vec_id): r.score for r in found.collect()}
    assert all(scores[k] == got[k] for k in scores.keys() & got.keys()) and {k[0] for k in got} == {k[0] for k in scores}
    # far fewer pairs than all are looked at, and a stored table gives the same
    held = N.planes(24, 5)
    table = N.bucket_table(vectors, held)
    assert table.count() == 1500 * N.TABLES
    again = N.bucketed_topk(asked, vectors, 10, bits=5, probes=6, buckets=table)
    assert {(r.query_id, r.vec_id): r.score for r in again.collect()} == got
    few = N.probed(asked, held, 1).join(table, ["scope_id", "table", "bucket"]).select("query_id", "vec_id").distinct().count()
    assert few < 48 * 1500 / 3
    assert N.bucketed_topk(asked, vectors.limit(0)).count() == 0
    found.unpersist()


def test_probes_follow_the_vectors(spark):
    """Vectors without clusters, in many small buckets: a fixed number of probes finds too little."""
    points = np.random.default_rng(8).standard_normal((3000, 32))
    vectors = spark.createDataFrame([(0, i, [float(x) for x in p]) for i, p in enumerate(points)], "scope_id int, vec_id int, embedding array<float>")
    asked = vectors.filter("vec_id % 50 = 0").selectExpr("vec_id as query_id", "scope_id", "transform(embedding, x -> cast(x as double)) as q")
    exact = R.dense_topk(asked, vectors).cache()
    assert N.recall(N.bucketed_topk(asked, vectors, probes=N.PROBES, per_bucket=2), exact).first().recall < 0.9
    assert N.recall(N.bucketed_topk(asked, vectors, per_bucket=2), exact).first().recall >= 0.9
    exact.unpersist()


def test_medians(spark):
    rng = random.Random(6)
    rows = [("a", rng.choice([1.0, 2.0, 3.0])) for _ in range(101)] + [("b", rng.gauss(0, 1e6)) for _ in range(500)]
    rows += [("c", x) for x in (5e-324, 1e-300, 1.7e308, -1.7e308)] + [("d", 7.0), ("e", None), ("f", float("nan")), (None, 2.0), (None, 4.0)]
    rows += [("g", float(x)) for x in [0] * 300 + list(range(1, 302))] + [("h", float("inf")), ("h", 1.0), ("h", float("-inf"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    want = {}
    for key in {r[0] for r in rows}:
        own = [v for k, v in rows if k == key and v is not None and v == v]
        if own:
            want[key] = statistics.median(own)
    assert {r.k: r["median"] for r in O.group_medians(df, "k", "v", cells=8).collect()} == want
    assert O.group_medians(df.limit(0), "k", "v").count() == 0
