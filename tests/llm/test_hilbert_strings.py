"""Hilbert order of strings that share a long beginning, against plain Python."""

import random
import zlib

import numpy as np
import pytest

from reportloom.llm import hilbert


def _cuts(values, cells):
    """Last string of every run of about equal counts."""
    values = sorted((v for v in values if v is not None), key=str.encode)
    out = []
    for v in sorted(set(values), key=str.encode):
        before = sum(x.encode() < v.encode() for x in values)
        if before * cells // len(values) < (before + values.count(v)) * cells // len(values):
            out.append(v)
    return out[:cells - 1]


def _cell(value, cuts, cells):
    if value is None:
        return 0
    below = sum(value.encode() > c.encode() for c in cuts)
    return below + 1 if len(cuts) + 1 < cells else below


@pytest.mark.parametrize("bits", [2, 3])
def test_order_by_whole_strings(spark, bits):
    rng = random.Random(bits)
    rows = []
    for i in range(300):
        source = None if i % 23 == 0 else f"https://example.org/path/{rng.choice('abcdefgé')}{min(int(rng.expovariate(0.2)), 30)}"
        rows.append((i if i % 40 else None, f"text {i % 90}" if i % 31 else None, rng.choice(["en", "de", None]), source, 5))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    cells = 1 << bits
    cuts = {d: _cuts([r[k] for r in rows], cells) for d, k in (("lang", 2), ("source", 3))}
    assert hilbert.string_cuts(df, "source", cells, block=5) == cuts["source"] == hilbert.string_cuts(df, "source", cells)
    points = np.array([[_cell(r[2], cuts["lang"], cells), _cell(r[3], cuts["source"], cells)] for r in rows])
    curve = hilbert.hilbert_index(points, bits)
    want = sorted((int(c), zlib.crc32((r[1] or "").encode()), (r[0] is not None, r[0] or 0)) for c, r in zip(curve, rows))
    out = hilbert.assign(df, ("lang", "source"), shards=7, bits=bits).collect()
    got = [(r.curve, r.text_crc32, (r.doc_id is not None, r.doc_id or 0)) for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert got == want
    # two hosts of one beginning do not share a cell
    assert len({c for c, _, _ in got}) > cells


def test_missing_dimension(spark):
    with pytest.raises(ValueError, match="source"):
        hilbert.assign(spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string"), ("lang", "source"))
