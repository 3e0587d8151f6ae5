"""Long texts in bounded memory, and forms of any length."""

import re
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportloom.llm import common, pii, toxicity

_HASHED = """
import resource, sys
sys.path.insert(0, {root!r})
import numpy as np
from reportloom.llm.common import Words, _POWERS
rng = np.random.default_rng(1)
data = rng.integers(97, 123, 30_000_000).astype(np.uint8)
data[rng.integers(0, len(data), 5_000_000)] = 32
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
words = Words(data, np.array([0, len(data)]))
words.hashes(); words.hashes(1)
print(len(words), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1000, sum(len(p.kept[0]) for p in _POWERS.values()))
"""


def test_words_of_a_text_of_30_megabytes():
    """Hashing adds a few arrays of the words, not eight bytes for every byte of the text and its powers."""
    root = str(common.__file__).rsplit("/reportloom/", 1)[0]
    out = subprocess.run([sys.executable, "-c", _HASHED.format(root=root)], capture_output=True, text=True, check=True, timeout=120)
    words, added, kept = map(int, out.stdout.split())
    assert words > 3_000_000 and added < 600 and kept <= 4 * common.SEGMENT + 2


def test_hashes_do_not_depend_on_the_segment():
    text = " ".join("w" * (1 + i % 7) + str(i % 50) for i in range(60_000)).encode()
    data = np.frombuffer(text + b" " + b"x" * 200_000 + b" w1 " + b"x" * 200_000, np.uint8)
    words = common.Words(data, np.array([0, 1000, len(data)]))
    held = {}
    for a, b, h in zip(words.starts, words.ends, words.hashes().tolist()):
        assert held.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(held.values())) == len(held)


@pytest.mark.parametrize("zeros", [0, 38, 41, 400])
def test_addresses_with_long_parts(spark, zeros):
    text = f"at 1.{'0' * zeros}1.{'0' * zeros}2.3 now, and 1.{'0' * zeros}256.1.1"
    row = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), pii.Model()).first()
    assert row.n_ip == 1 and row.spans == f"ip:3:{text.index(' now')}"


def test_addresses_of_any_length_are_proposed(spark):
    local = "a" * 100 + ".b"
    text = f"mail {local} [at] {'c' * 80} [dot] org or {local}@{'d' * 150}.net"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = pii.with_candidates(pii.with_base(df, "text")).select(F.transform("_candidates", lambda c: F.struct(
        c["start"], c["end"], c["kind"])).alias("c")).first().c
    whole = {text[c[0]:c[1]] for c in found if c[2] == "email"}
    assert f"{local} [at] {'c' * 80} [dot] org" in whole and f"{local}@{'d' * 150}.net" in whole


def test_severity_against_plain_counting():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefg"), rng.integers(1, 9))) for _ in range(60)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 40))) + (" Vile! vilest" if i % 3 == 0 else "") for i in range(120)]
    model = toxicity.fit_texts(texts, np.array([i % 3 == 0 for i in range(120)]), keep=50)
    assert model.features
    for text, got in zip(texts, model.severity(texts)):
        found = re.findall(r"[^\W\d_]+", text.lower())
        line = f"<{'><'.join(found)}>"
        margin = 0.0
        for feature, at in model.features.items():
            n = sum(line.startswith(feature, k) for k in range(len(line)))
            if n:
                margin += model.weights[at] * (100 * n / len(found)) ** 0.75
        assert got == pytest.approx(float((1 / (1 + np.exp(model.thresholds - margin))).sum()))
