"""Merkle manifest and source mix against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from conftest import ordered

from reportloom.llm import merkle, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(fields):
    return _sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def _tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([_sha("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def _path(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 8
        out.append((level[first:i], level[i + 1:first + 8]))
        i //= 8
    return out


def _manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = {}
    for n in names:
        groups[n].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees[n] = _tree([_leaf(r) for r in groups[n]])
    over = _tree([trees[n][-1][0] for n in names])
    root, out = over[-1][0], []
    for g, n in enumerate(names):
        for i, r in enumerate(groups[n]):
            path = _path(trees[n], i) + _path(over, g)
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            folded = _leaf((*r[:4], text))
            for left, right in path:
                folded = _sha("".join(left) + folded + "".join(right))
            proof = _sha("".join("".join(left) + "".join(right) for left, right in path))
            out.append((r[0], trees[n][0][i], trees[n][-1][0], root, proof, folded, folded == root))
    return out


def _five(df):
    return [tuple(r) for r in df.select(*merkle.FIELDS).collect()]


def test_addresses_are_a_permutation():
    for levels in range(6):
        places = np.concatenate([merkle.address(levels, d) for d in range(levels + 1)])
        assert sorted(places.tolist()) == list(range(merkle.nodes(levels)))
    # a subtree below the split lies in one piece
    at = merkle.address(4, 4)[:64]
    inner = np.concatenate([merkle.address(4, 2)[:1], merkle.address(4, 3)[:8], at])
    assert inner.max() - inner.min() + 1 == len(inner)


def test_manifest(docs, empty):
    assert ordered(tuple(r) for r in merkle.audit(docs).collect()) == ordered(_manifest(_five(docs)))
    assert merkle.audit(empty).count() == 0
    lone = docs.filter("doc_id = 1")
    assert [tuple(r) for r in merkle.audit(lone).collect()] == _manifest(_five(lone))


def test_manifest_of_several_rounds(spark):
    """Blocks of 8 leaves: several rounds, many small languages, copies, a partial last block."""
    rows = [(i % 4900 if i % 97 else None, "a", None if i % 3 else f"l{i % 200}", None, f"Text {i % 2000}") for i in range(5000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    held = merkle.manifest(df, levels=1)
    assert len(held.groups.rounds) == 4 and len(held.over.rounds) == 3
    assert ordered(tuple(r) for r in merkle.audit(df, levels=1).collect()) == ordered(_manifest(rows))


def _targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    rest, left, stopped = sum(sizes.values()), set(names), {}
    while left:
        unit = Fraction(rest, sum(weight[s] for s in left))
        above = [s for s in left if unit * weight[s] > 3 * sizes[s]]
        if not above:
            return {**stopped, **{s: unit * weight[s] for s in left}}
        for s in above:
            left.remove(s)
            stopped[s] = 3 * sizes[s]
            rest -= 3 * sizes[s]
    return stopped


@pytest.fixture(scope="module")
def sourced(spark):
    rng = random.Random(5)
    rows = [(i if i % 41 else None, " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 60))) if i % 29 else None,
             None if i % 17 == 0 else f"s{min(int(rng.expovariate(0.5)), 9)}", "drawn", 1.5) for i in range(4000)]
    rows += rows[:20] + [(9999, "", "empty", "", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, drawn string, rate double").repartition(3)


def test_mix(sourced):
    rows = sourced.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = _targets(sizes)
    out = mixing.taken(sourced).collect()
    again = mixing.taken(sourced.repartition(7)).collect()
    assert ordered(tuple(r) for r in out) == ordered(tuple(r) for r in again)
    assert len(out) == len(rows)
    targets = {r.source_size: r.target for r in out}
    for source, size in sizes.items():
        assert targets[size] == pytest.approx(float(want[source]))
    held = defaultdict(int)
    for r in out:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies in (int(rate), int(rate) + 1)
        held[r.source_size] += r.taken
    for size, total in held.items():
        assert size < 2000 or total == pytest.approx(targets[size], rel=0.1)
    assert sum(targets[s] for s in set(sizes.values())) == pytest.approx(sum(sizes.values()))


def test_mixed_documents(sourced):
    mixed = mixing.mix(sourced)
    assert mixed.columns == sourced.columns
    taken = sum(r.taken for r in mixing.taken(sourced).collect())
    assert mixed.selectExpr("coalesce(sum(regexp_count(text, '[^ ]+')), 0)").first()[0] == taken
    assert mixing.mix(sourced.limit(0)).count() == mixing.taken(sourced.limit(0)).count() == 0
    nothing = sourced.filter("text is null or text = ''")
    assert {(r.target, r.taken) for r in mixing.taken(nothing).collect()} == {(0.0, 0)}
