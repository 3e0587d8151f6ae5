"""Operators on whole texts against brute force: substrings, SimHash, quality counts, BPE, packing."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from conftest import ordered
from tokenizers import Tokenizer

from reportloom.llm import bpe, packing, perplexity, simhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_repeated_windows(docs, pairs, empty):
    words = [WORD.findall(t or "") for _, t in pairs]
    seen = Counter(tuple(w[k:k + 35]) for w in words for k in range(len(w) - 34))
    want = []
    for (i, _), w in zip(pairs, words):
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k:k + 35])] > 1:
                gone[k:k + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    small = dict(log2_cells=18)
    got = [tuple(r) for r in substrings.removals(docs, **small).collect()]
    assert ordered(got) == ordered(want)
    # a sketch so full that it lets everything through, and one bucket, give the same
    crowded = substrings.removals(docs, log2_cells=9, buckets=1)
    assert ordered(tuple(r) for r in crowded.collect()) == ordered(want)
    assert substrings.removals(empty, **small).count() == 0
    left = substrings.without_repeats(docs, **small)
    assert left.columns == docs.columns
    kept = [(r.doc_id, hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest()) for r in left.collect()]
    assert ordered(kept) == ordered((i, h) for i, _, _, h in want)


def _fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    runs = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(marks, limit=3):
    parent = list(range(len(marks)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(marks):
        for j in range(i):
            if (a ^ marks[j]).bit_count() <= limit:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(marks))]


def test_near_duplicates(docs, pairs, empty):
    marks = [_fingerprint(t) for _, t in pairs]
    part = _components(marks)
    low = defaultdict(list)
    for (i, _), p in zip(pairs, part):
        low[p].append(i)
    least = {p: min((i for i in ids if i is not None), default=None) for p, ids in low.items()}
    want = [(i, f"{m:016x}", least[p]) for (i, _), m, p in zip(pairs, marks, part)]
    found = simhash.near_duplicates(docs)
    got = [tuple(r) for r in found.select("doc_id", simhash.hex_fingerprint(found.fp), "component_id").collect()]
    assert ordered(got) == ordered(want)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert ordered((r.doc_id,) for r in kept.collect()) == ordered((i,) for i in least.values())


@pytest.mark.parametrize("plan", [
    simhash.Plan((0xFFFF, 0xFFFF << 16, 0xFFFF << 32, 0xFFFF << 48), (0, 0, 0, 0)),
    simhash.Plan((0xFFFFFFFF, 0xFFFFFFFF << 32), (1, 1)),
    simhash.Plan((0xFFFFFFFF, 0xFFFFFFFF << 32), (2, 0)),
    simhash.Plan((0xFFFFF, 0xFFFFF << 20, 0xFFFFFF << 40), (2, -1, 0))])
@pytest.mark.parametrize("block", [3, 512])
def test_links_of_a_dense_group(spark, plan, block):
    """Chains and dense groups, for several plans, with meetings cut into many blocks."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    marks = set()
    for b in base.tolist():
        for _ in range(40):
            x = b
            for bit in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << bit
            marks.add(x)
    marks = sorted(marks)
    part = _components(marks)
    table = spark.createDataFrame([(m - (1 << 64) if m >> 63 else m,) for m in marks], "fp long")
    edges = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(table, plan, 3, block).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    parent = {m: m for m in marks}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        parent[root(a)] = root(b)
    groups = [root(m) for m in marks]
    assert len(set(zip(groups, part))) == len(set(groups)) == len(set(part))


def _base(text):
    text = text or ""
    w = WORD.findall(text)
    lines, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in lines
            lines.add(line)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered)


def test_quality(docs, pairs, empty):
    rows = perplexity.judge(docs, least=5).collect()
    assert ordered((r.doc_id, *r[1:6]) for r in rows) == ordered((i, *_base(t)) for i, t in pairs)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert any(r.kept for r in rows)
    assert perplexity.judge(empty).count() == 0


def test_language_model_is_a_distribution(docs):
    model = perplexity.fit(docs)
    gram = int(model.keys[3][len(model.keys[3]) // 2])
    for context in (gram >> 6, 0x3FFFF, 12345):
        assert abs(model.probability(np.arange(64) | context << 6).sum() - 1) < 1e-5
    counted = {r.gram: r.n for r in perplexity.count_grams(docs, run=1000).collect()}
    assert counted == {r.gram: r.n for r in perplexity.count_grams(docs).collect()}
    assert sum(counted.values()) == sum(len((r.text or "").encode()) for r in docs.collect())


def test_byte_bpe(docs, pairs, empty):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    codec = bpe.Codec.load(path, pattern)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=codec.ranks, special_tokens={})
    want = []
    for i, t in pairs:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert ordered(tuple(r) for r in bpe.digests(docs, path, pattern).collect()) == ordered(want)
    back = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    assert ordered((r.doc_id, bytes(r.data).decode()) for r in back.collect()) == ordered((i, t or "") for i, t in pairs)
    assert bpe.digests(empty, path, pattern).count() == 0


def test_merge_order_within_a_word():
    """A vocabulary whose merges can undercut each other; every word against the strict replay."""
    import itertools
    ranks = {bytes([b]): b for b in range(256)}
    for n, token in enumerate([b"bc", b"abc", b"ab", b"aa", b"aab", b"aba", b"ba", b"cab", b"aaaa", b"bab"]):
        ranks[token] = 256 + n
    codec = bpe.Codec(ranks, r"\w+")
    words = [bytes(w) for n in range(1, 7) for w in itertools.product(b"abc", repeat=n)]
    assert codec.replay(words) == [codec._alone(w) for w in words]


def test_packing(docs, pairs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, capacity=64).collect()
    want = []
    for i, t in pairs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(i, k, 64 * k, len(ids[64 * k:64 * k + 64]), zlib.crc32(np.array(ids[64 * k:64 * k + 64], "<u4").tobytes()))
                 for k in range(-(-len(ids) // 64))]
    assert ordered((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == ordered(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.05 * sum(r.length for r in rows) / 64 + 1
    assert packing.pack_documents(empty, path).count() == 0


@pytest.mark.parametrize("counts", [{}, {64: 3}, {1: 1000}, {33: 10, 31: 4, 22: 9}, {21: 7, 22: 7, 43: 7},
                                    {n: 1 + n % 5 for n in range(1, 65)}])
def test_packing_plan(counts):
    runs, total = packing.plan(counts, 64)
    bins, placed = defaultdict(list), Counter()
    for length, first, sequence, sequences, each, offset in runs.tolist():
        assert placed[length] == first
        placed[length] += sequences * each
        for s in range(sequences):
            bins[sequence + s] += [(offset + k * length, length) for k in range(each)]
    assert placed == Counter(counts) and sorted(bins) == list(range(total))
    for held in bins.values():
        assert sum(n for _, n in held) <= 64 and sum(3 * n > 64 for _, n in held) <= 2
        ends = [0, *(o + n for o, n in sorted(held))]
        assert [o for o, _ in sorted(held)] == ends[:-1]
