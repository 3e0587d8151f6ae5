"""Quality without labels: overlapping heuristics, their accuracies, and a hashed scorer.

1. Labellers look at one property each (symbols, repeats, repeated lines, capitals,
   exclamation marks, word lengths, short words, number of words) and vote good, bad or nothing.
2. Votes of all rows are counted by pattern: at most ``3**8`` patterns whatever the corpus.
3. Expectation-maximisation over the counted patterns estimates the share of good texts
   and, for each labeller, how often it is right about good and about bad texts. Bad texts
   are bad in different ways and a labeller sees few of them, so they are a mixture of kinds,
   one started from each of ``KINDS``; votes are independent given good or the kind, and no
   labeller rejects more than one good text in a hundred (without that bound the good
   class could absorb a kind). A pattern's posterior of being good follows.
4. A linear scorer over hashed features (words, word shapes, bucketed shares) is
   trained by logistic regression on the posteriors of a bounded sample (``fit_rows``
   different texts, the least by hash). It scores all rows; ``kept`` is a score of at
   least ``cutoff``.

Gold labels are not used; tests hold the scores against them.

Cases: a null text is an empty one; it has its own features (no words) and a score like any
other. Repeated rows, null ids and ties stay as they are. Without rows, or if the
posteriors of the sample are all on one side, every score is the share of good texts. Extra
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.llm.common import Words, blocks, byte_hashes, mix, per_block
from reportloom.llm.perplexity import _per_row, base_counts

LABELLERS = ("symbols", "repeats", "lines", "capitals", "marks", "length", "short", "words")
KINDS = ("symbols", "repeats", "capitals")
BAD, GOOD, NONE = 0, 1, 2
LOG2_BINS = 18

_CLASS = np.zeros(256, np.uint8)  # letters without their case, capitals, digits, anything else itself
for _b in range(256):
    _CLASS[_b] = 97 if _b >= 128 or chr(_b).islower() else 65 if chr(_b).isupper() else 48 if chr(_b).isdigit() else _b
_UPPER, _LETTER = _CLASS == 65, (_CLASS == 65) | (_CLASS == 97)


def _shares(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, dict[str, np.ndarray]]:
    words = Words(data, offsets)
    base = base_counts(data, offsets)
    n = np.maximum(base["n_words"], 1)
    lines = _per_row(data == 0x0A, offsets) + 1
    brief = np.bincount(words.doc[words.ends - words.starts <= 3], minlength=len(n))
    return words, {"symbols": base["n_symbols"] / n, "repeats": base["n_repeat_words"] / n,
                   "lines": base["n_dup_lines"] / lines,
                   "capitals": _per_row(_UPPER[data], offsets) / np.maximum(_per_row(_LETTER[data], offsets), 1),
                   "marks": _per_row(data == 0x21, offsets) / n, "length": base["word_chars"] / n,
                   "short": brief / n, "words": base["n_words"]}


def votes(share: dict[str, np.ndarray]) -> np.ndarray:
    """One row of votes per text, in the order of ``LABELLERS``."""
    def vote(bad, good):
        return np.where(bad & enough, BAD, np.where(good & enough, GOOD, NONE))
    s, enough = share, share["words"] >= 20  # shares say nothing about a few words
    return np.stack([
        vote(s["symbols"] > 0.1, s["symbols"] < 0.02), vote(s["repeats"] > 0.4, s["repeats"] < 0.15),
        vote(s["lines"] > 0.3, s["lines"] < 0.1), vote(s["capitals"] > 0.4, s["capitals"] < 0.15),
        vote(s["marks"] > 0.3, s["marks"] < 0.05), vote((s["length"] > 14) | (s["length"] < 2.5), (s["length"] > 3.5) & (s["length"] < 11)),
        vote(s["short"] < 0.03, s["short"] > 0.12), np.where(s["words"] < 1, BAD, np.where(s["words"] >= 100, GOOD, NONE))], 1)


def pattern_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(pattern, n)``: votes as a number in base 3, and how many rows vote so."""
    def of(rows, data, offsets):
        codes, n = np.unique(votes(_shares(data, offsets)[1]) @ 3 ** np.arange(len(LABELLERS)), return_counts=True)
        return {"pattern": codes, "n": n}
    schema = pa.schema([("pattern", pa.int32()), ("n", pa.int64())])
    return docs.select(F.col(text_col).alias("_text")).mapInArrow(
        per_block(of, schema, "_text"), "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


@dataclass
class Labels:
    """Shares of good texts and of each kind of bad ones, and P(a cast vote is good | class) per labeller."""
    share: np.ndarray
    says_good: np.ndarray

    def classes(self, seen: np.ndarray) -> np.ndarray:
        """P(class | votes), the good class first."""
        fit = np.log(self.share) + (seen == GOOD) @ np.log(self.says_good) + (seen == BAD) @ np.log(1 - self.says_good)
        fit = np.exp(fit - fit.max(1, keepdims=True))
        return fit / fit.sum(1, keepdims=True)

    def posterior(self, seen: np.ndarray) -> np.ndarray:
        return self.classes(seen)[:, 0]

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """How often each labeller is right about bad and about good texts."""
        bad = (1 - self.says_good[:, 1:]) @ self.share[1:] / max(self.share[1:].sum(), 1e-9)
        return {n: (float(b), float(g)) for n, b, g in zip(LABELLERS, bad, self.says_good[:, 0])}


def estimate(seen: np.ndarray, n: np.ndarray, steps: int = 300, least_right: float = 0.99) -> Labels:
    """Expectation-maximisation over vote patterns and their counts."""
    if not len(seen) or not n.sum():
        return Labels(np.array([0.5, *[0.5 / len(KINDS)] * len(KINDS)]), np.full((len(LABELLERS), 1 + len(KINDS)), 0.5))
    by_kind = np.stack([seen[:, LABELLERS.index(k)] == BAD for k in KINDS], 1).astype(float)
    post = np.concatenate([(by_kind.sum(1, keepdims=True) == 0).astype(float), by_kind], 1)
    post /= post.sum(1, keepdims=True)
    for _ in range(steps):
        weight = n[:, None] * post
        share = (weight.sum(0) + 1) / (weight.sum() + post.shape[1])
        good, bad = (seen == GOOD).T @ weight, (seen == BAD).T @ weight
        says_good = np.clip((good + 1) / (good + bad + 2), 1e-4, 1 - 1e-4)
        says_good[:, 0] = np.maximum(says_good[:, 0], least_right)
        labels = Labels(share, says_good)
        now = labels.classes(seen)
        if np.abs(now - post).max() < 1e-9:
            break
        post = now
    return labels


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features of a block (row, bin, value) and the votes of its rows."""
    words, share = _shares(data, offsets)
    rows = len(words.counts)
    shift = np.uint64(64 - LOG2_BINS)
    # shape: classes of a word's bytes, a run of one class once
    kind = _CLASS[data]
    head = np.ones(len(data), bool)
    head[1:] = kind[1:] != kind[:-1]
    head[words.starts] = True
    at = np.concatenate([[0], np.cumsum(head)])
    shapes = byte_hashes(kind[head], at[words.starts], at[words.ends])
    said = [words.hashes() >> shift, mix(shapes + np.uint64(77)) >> shift]
    key = np.concatenate([words.doc.astype(np.uint64) << np.uint64(LOG2_BINS) | s for s in said])
    key, count = np.unique(key, return_counts=True)
    row, bin_ = (key >> np.uint64(LOG2_BINS)).astype(int), (key & np.uint64((1 << LOG2_BINS) - 1)).astype(int)
    value = np.sqrt(count / np.maximum(words.counts, 1)[row])
    extra = []
    for j, name in enumerate(LABELLERS):
        level = np.minimum(np.log2(1 + share[name] * (1 if name in ("words", "length") else 100)), 20).astype(np.uint64)
        extra.append((mix(level + np.uint64(1000 * (j + 1))) >> shift).astype(int))
    return (np.concatenate([row, *([np.arange(rows)] * len(extra))]), np.concatenate([bin_, *extra]),
            np.concatenate([value, *([np.ones(rows)] * len(extra))]), votes(share))


def fit_scorer(row: np.ndarray, bin_: np.ndarray, value: np.ndarray, target: np.ndarray, ridge: float = 1.0,
               steps: int = 150, rate: float = 0.05) -> np.ndarray:
    """Weights of all bins and a bias at the end: logistic regression on soft labels, by Adam."""
    used, col = np.unique(bin_, return_inverse=True)
    theta = np.zeros(len(used) + 1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        margin = np.bincount(row, value * theta[col], len(target)) + theta[-1]
        slope = 1 / (1 + np.exp(-np.clip(margin, -40, 40))) - target
        grad = np.append(np.bincount(col, value * slope[row], len(used)) + ridge * theta[:-1], slope.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad ** 2
        theta -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    out = np.zeros((1 << LOG2_BINS) + 1)
    out[used], out[-1] = theta[:-1], theta[-1]
    return out


def fit(docs: DataFrame, text_col: str = "text", fit_rows: int = 5000) -> tuple[Labels, np.ndarray]:
    counted = pattern_counts(docs, text_col).orderBy("pattern").collect()
    codes, n = np.array([r.pattern for r in counted], int), np.array([r.n for r in counted], float)
    labels = estimate(codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3, n)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # hashes below a bound leave about fit_rows rows of any number of rows; copies count once
    share = min(1.0, 1.2 * fit_rows / max(n.sum(), 1))
    low = docs.select(text.alias("_text")).withColumn("_h", F.xxhash64("_text")).filter(
        F.col("_h") <= int(min((2 * share - 1) * 2.0 ** 63, 2 ** 63 - 1)))
    sample = low.groupBy("_h").agg(F.min("_text").alias("_text")).orderBy("_h").limit(fit_rows).select(
        "_text").toArrow().column(0)
    parts, target, base = [], [], 0
    for first, last, data, offsets in blocks(sample):
        row, bin_, value, seen = features(data, offsets)
        parts.append((row + base, bin_, value))
        target.append(labels.posterior(seen))
        base += last - first
    weights = np.zeros((1 << LOG2_BINS) + 1)
    weights[-1] = np.log(labels.share[0] / (1 - labels.share[0]))
    if parts:
        target = np.concatenate(target)
        if (target > 0.5).any() and (target <= 0.5).any():
            weights = fit_scorer(*(np.concatenate(x) for x in zip(*parts)), target)
    return labels, weights


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 5000,
           cutoff: float = 0.5) -> DataFrame:
    """Per row: id, ``posterior`` of its votes, ``score`` of the text, ``kept``."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col, fit_rows))
    schema = pa.schema([("id", pa.int64()), ("posterior", pa.float64()), ("score", pa.float64()), ("kept", pa.bool_())])

    def of(rows, data, offsets):
        labels, weights = held.value
        row, bin_, value, seen = features(data, offsets)
        margin = np.bincount(row, value * weights[bin_], rows.num_rows) + weights[-1]
        score = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        return {"id": rows.column("id"), "posterior": labels.posterior(seen), "score": score, "kept": score >= cutoff}

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text")).mapInArrow(
        per_block(of, schema, "_text"), "id long, posterior double, score double, kept boolean").withColumnRenamed("id", id_col)
