"""Learned and vector operators: toxicity, weak labels, personal data, top-k, shards, pipeline."""

import hashlib
import math
import random
import re
import tempfile
from collections import defaultdict

import duckdb
import numpy as np
from conftest import ordered
from pyspark.sql import functions as F

from reportloom.llm import components, hilbert, pii, toxicity, vafile, weak_quality

SF = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    model = toxicity.fit(docs, labels.filter(part != 0), fit_rows=3000)
    rows = toxicity.severities(docs, model).join(labels.filter(part == 0).withColumnRenamed("toxic", "gold"), "doc_id")
    n = {(r.gold, r.toxic): r["count"] for r in rows.groupBy("gold", "toxic").count().collect()}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.85
    assert n.get((0, True), 0) / n[0, False] < 0.01


def test_toxicity_grades_rise_and_odd_rows(spark, docs, empty):
    rng = np.random.default_rng(2)
    grade = rng.integers(0, 4, 400)
    rows = [(np.array([0, 1]), np.array([g + rng.normal(0, 0.3), 1.0])) for g in grade]
    weights, thresholds = toxicity.fit_cumulative(rows, grade, 2, 3)
    assert weights[0] > 1 and (np.diff(thresholds) > 0).all()
    clean = toxicity.fit(docs, empty.select("doc_id", F.col("label").alias("toxic")))
    assert {(r.severity, r.toxic) for r in toxicity.severities(docs, clean).collect()} == {(0.0, False)}
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (5, None), (9999, 1)],
                                  "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    flagged = toxicity.severities(docs, model).filter("not toxic").count()
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == flagged
    assert toxicity.severities(empty, model).count() == 0


def test_weak_labels_against_gold(spark, docs, empty):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    n = {(r.quality, r.kept): r["count"] for r in weak_quality.scores(table).join(labels, "doc_id").groupBy(
        "quality", "kept").count().collect()}
    assert n[0, False] / (n[0, False] + n[0, True]) > 0.9
    assert n.get((1, False), 0) / n[1, True] < 0.01
    scored = weak_quality.scores(docs, fit_rows=50)
    assert scored.count() == docs.count() and scored.filter("score is null").count() == 0
    assert weak_quality.scores(empty).count() == 0


def test_labeller_accuracies_are_recovered():
    rng = np.random.default_rng(3)
    n, good = 40_000, 0.8
    y = rng.random(n) < good
    seen = np.where(rng.random((n, 8)) < np.where(y, 0.995, 0.6)[:, None], y[:, None], ~y[:, None]).astype(int)
    seen[rng.random((n, 8)) < 0.2] = weak_quality.NONE
    patterns, counts = np.unique(seen, axis=0, return_counts=True)
    found = weak_quality.estimate(patterns, counts)
    assert abs(found.share[0] - good) < 0.02
    for bad, right in found.accuracies().values():
        assert abs(bad - 0.6) < 0.08 and right >= 0.99


def _luhn(s):
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, s[::-1]))) % 10 == 0


def _base(text):
    text, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                  if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def _listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_base_spans(spark, docs, empty):
    rng = random.Random(5)
    parts = ["1", "2", "4", "0", "9", "255", "256", "00", ".", " ", "-", "+", "(", ")", "@", "a", "b", "_", "%", "\x01", "\n",
             "é", "𝄞", "@a.b", "1.2.3.4", "4111 1111 1111 1111", "+1 (222) 333-4444"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += [None, "", "1 " * 9000, "1." * 9000, "a." * 9000 + "@b", "x@" + "a." * 9000, "+1" + "-" * 9000, "9" * 20000,
              "a" * 20000, "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "@a.b..c@d.e"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in pii.find(table, pii.Model()).collect():
        spans = _base(texts[r.doc_id])
        assert r.spans == _listed(spans) and r.base_sha256 == hashlib.sha256(_listed(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
    assert pii.find(docs, pii.Model()).count() == docs.count()
    assert pii.find(empty, pii.fit(empty)).count() == 0
    redacted = pii.redact(docs, pii.Model())
    assert redacted.columns == docs.columns
    assert "[email] [card] [ip]" not in "".join(r.text or "" for r in redacted.collect())
    assert any("[email] [phone] [card] [ip]" in (r.text or "") or "[email]" in (r.text or "") for r in redacted.collect())


def test_added_spans_keep_base_and_do_not_overlap(spark):
    model = pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    assert model.printed and set(model.thresholds) == set(pii.KINDS)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    loose = pii.Model(model.printed, dict.fromkeys(pii.KINDS, -99.0))
    texts = {r.doc_id: r.text for r in table.collect()}
    added = 0
    for r in pii.find(table, loose).collect():
        base = set(_listed(_base(texts[r.doc_id])).split(",")) - {""}
        spans = [tuple(s.split(":")) for s in r.spans.split(",") if s]
        assert base <= {":".join(s) for s in spans}
        extra = [s for s in spans if ":".join(s) not in base]
        added += len(extra)
        for _, a, b in extra:
            assert not any(int(a) < int(y) and int(x) < int(b) for x, y in (s.split(":")[1:] for s in base))
    assert added
    # an area code without a country code is a form that the rules don't see
    one = spark.createDataFrame([(1, "call (017) 555-7713 now")], "doc_id long, text string")
    assert pii.find(one, loose).first().spans == "phone:5:19"


def _top(rows, k=10):
    whole = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows
             if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for j, (i, v) in enumerate(whole):
        if i is None or i % 100:
            continue
        best = sorted((-sum(a * b for a, b in zip(v, w)), n is None, n or 0) for m, (n, w) in enumerate(whole)
                      if m != j and len(w) == len(v))[:k]
        out += [(i, rank, None if null else n, -score) for rank, (score, null, n) in enumerate(best, 1)]
    return out


def test_exact_top_k(spark):
    rng = random.Random(2)
    rows = [(i if rng.random() > 0.05 else None, [float(np.float32(rng.gauss(0, 1))) for _ in range(6)]) for i in range(400)]
    rows += [(i, [0.5] * 6) for i in range(600, 800)]
    rows += [(1000, None), (1100, [1.0, None]), (1200, [float("nan")] * 6), (1200, [float("inf")] * 6), (1300, [1.0, 2.0]),
             (1301, [1.0, -2.0]), (1400, []), (100, [0.5] * 6), (100, [0.5] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumn("q", F.lit(1))
    want = ordered(_top(rows))
    for options in ({}, {"bits": 2, "block": 50, "query_block": 3, "portion": 3}):
        assert ordered(tuple(r) for r in vafile.search(table, "id % 100 = 0", **options).collect()) == want
    assert vafile.search(table.limit(0), "id % 100 = 0").count() == 0


def test_hilbert_curve_and_shards(spark, docs, empty):
    for dims, bits in ((2, 3), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        index = hilbert.hilbert_index(cells, bits)
        assert sorted(index) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(1) == 1).all()
    for shards in (8, 200):
        rows = hilbert.assign(docs, shards=shards).collect()
        assert len(rows) == docs.count()
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(slots.get(k, [])) for k in range(shards)]
        assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))
    assert hilbert.assign(empty).count() == 0


def test_hilbert_files_prune_on_every_dimension(spark):
    folder = tempfile.mkdtemp(prefix="spark-shards-")
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    hilbert.write_shards(table, folder, files=32)
    con = duckdb.connect()
    spans = con.sql(f"select filename, min(lang), max(lang), min(n_chars), max(n_chars), count(*) from "
                    f"read_parquet('{folder}/*.parquet', filename=true) group by 1").fetchall()
    assert sum(s[5] for s in spans) == table.count()
    assert sum(a <= "fr" <= b for _, a, b, *_ in spans) < 0.8 * len(spans)
    assert sum(lo <= 9000 <= hi for *_, lo, hi, _ in spans) < 0.8 * len(spans)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(40)]
    edges += [(900, i) for i in range(901, 960)] + [(7, 7), (None, 3)]
    parent = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if None not in (a, b) and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    found = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == {x: root(x) for x in parent} and found.count() == len(parent)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    folder = tempfile.mkdtemp(prefix="spark-stages-")
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = kept[name] = spark.read.parquet(f"{folder}/{name}")
    for name in list(kept)[:-1]:
        assert kept[name].schema == first.schema
    ids = [{r.doc_id for r in t.select("doc_id").collect()} for t in (first, *kept.values())]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[2] == ids[3] == ids[4] == ids[5]
    again = [tuple(r) for r in pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32").collect()]
    assert sorted(again) == sorted(tuple(r) for r in docs.select("doc_id", "piece", "start", "length", "ids_crc32").collect())


def test_pipeline_stages_on_odd_and_empty_tables(spark, docs, empty):
    import corpus_pipeline as pipeline

    for table in (docs, empty):
        for name, stage in pipeline.STAGES:
            out = stage(spark, table, SF)
            assert name == "packing" or out.columns == table.columns
            out.write.format("noop").mode("overwrite").save()
