"""Toxicity as ordered severity grades: a cumulative-link (proportional odds) model.

``P(grade > k | x) = sigmoid(w . x - t_k)`` with one weight vector ``w`` for all grades and
rising thresholds ``t_0 < t_1 < ...``. The output is the expected severity, the sum of
these probabilities over k, between 0 and the highest grade.

Features are sparse: words and the character runs of 4 to 6 letters within words; a
feature's value is ``(100 * count / words) ** 0.75``, so that a few strong words in a long
text and a steady dialect both show. The ``keep`` features that tell toxic rows apart best
in the fitting rows get a weight, at least 0, with a ridge penalty; all others have none:
severity is added by what is there, never taken away. All features of a text are found in
one pass of an Aho-Corasick automaton.

Labels say toxic or not. The grades of toxic rows (1 to ``grades``) come from the labels'
own rows: the share of a row's words that occur in toxic rows far more often than in
others, cut at the quantiles of toxic rows.

Fitting uses a documented bounded sample: at most ``fit_rows`` labelled rows, the
least by a hash of their id, three quarters to fit, the rest to set the cut-off: the lowest
expected severity at which no more than ``false_rate`` of the clean held-out rows are
rejected, but ``least`` at least. Scoring covers all rows.

Cases: null and empty texts have severity of no features (clean). Labels without a text, and
null labels, are left out of the fit. Without both kinds of labels every row is
clean with severity 0. Rows stay as they are: repeated, null ids, any extra columns; a
column called ``severity`` in ``docs`` is no trouble for ``without_toxic``, which adds none.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W\d_]+")


POWER = 0.75


def _value(count, words):
    return (100 * count / words) ** POWER


def word_features(word: str) -> list[str]:
    """The word itself (marked at both ends) and its character runs."""
    edged = f"<{word}>"
    runs = [edged[i:i + n] for n in (4, 5, 6) for i in range(len(edged) - n + 1)]
    return runs if 4 <= len(edged) <= 6 else [edged, *runs]


@dataclass
class Model:
    features: dict[str, int]  # feature -> place in the weights
    weights: np.ndarray
    thresholds: np.ndarray
    cutoff: float

    def finder(self):
        """An automaton that finds the features in words set side by side, or None without features."""
        if not self.features:
            return None
        automaton = ahocorasick.Automaton()
        for feature, at in self.features.items():
            automaton.add_word(feature, at)
        automaton.make_automaton()
        return automaton

    def severity(self, texts: list[str | None], finder=None) -> np.ndarray:
        finder = finder or self.finder()
        out = np.zeros(len(texts))
        if finder is None:
            return out
        for i, text in enumerate(texts):
            words = _WORD.findall((text or "").lower())
            counts = Counter([at for _, at in finder.iter(f"<{'><'.join(words)}>")])
            margin = 0.0
            if counts:
                at = np.fromiter(counts.keys(), int, len(counts))
                margin = float(self.weights[at] @ _value(np.fromiter(counts.values(), float, len(counts)), len(words)))
            out[i] = (1 / (1 + np.exp(np.clip(self.thresholds - margin, -60, 60)))).sum()
        return out


def fit_cumulative(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, features: int, grades: int,
                   ridge: float = 0.3, steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the proportional odds model, by full-gradient Adam.

    The thresholds are a first one and positive gaps, so their order can't be lost.
    """
    row = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    col = np.concatenate([a for a, _ in rows]) if rows else np.zeros(0, int)
    val = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)
    share = np.array([(grade > k).mean() for k in range(grades)]).clip(1e-3, 1 - 1e-3)
    start = np.log((1 - share) / share)
    theta = np.concatenate([np.zeros(features), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    first, second, n = np.zeros_like(theta), np.zeros_like(theta), len(rows)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        w, t = theta[:features], theta[features] + np.concatenate([[0], np.cumsum(np.exp(theta[features + 1:]))])
        margin = np.bincount(row, val * w[col], n)
        above = sigmoid(margin[:, None] - t)  # P(grade > k)
        edge = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], 1)
        at = np.arange(n)
        chance = np.maximum(edge[at, grade] - edge[at, grade + 1], 1e-12)
        slope = edge * (1 - edge)
        d_margin = -(slope[at, grade] - slope[at, grade + 1]) / chance
        d_t = np.zeros((n, grades + 2))
        d_t[at, grade] += slope[at, grade] / chance
        d_t[at, grade + 1] -= slope[at, grade + 1] / chance
        d_t = d_t[:, 1:-1].sum(0)
        grad = np.concatenate([np.bincount(col, val * d_margin[row], features) + ridge * w, d_t[:1] * 0 + d_t.sum(),
                               np.cumsum(d_t[::-1])[::-1][1:] * np.exp(theta[features + 1:])])
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad ** 2
        theta -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        theta[:features] = np.maximum(theta[:features], 0)
    return theta[:features], theta[features] + np.concatenate([[0], np.cumsum(np.exp(theta[features + 1:]))])


def _nothing() -> Model:
    return Model({}, np.zeros(0), np.zeros(0), 0.5)


def fit_texts(texts: list[str], toxic: np.ndarray, grades: int = 3, keep: int = 1000, false_rate: float = 0.002,
              least: float = 0.3) -> Model:
    """Fit on labelled texts in the given order; the last quarter sets the cut-off."""
    split = len(texts) - len(texts) // 4
    y = np.asarray(toxic[:split], bool)
    if not y.any() or y.all():
        return _nothing()
    # a first look drops the features of fewer than five rows, by hash: most of them, and their names are never held
    mask = (1 << 22) - 1
    often = np.zeros(mask + 1, np.uint16)
    for text in texts[:split]:
        found = {hash(f) & mask for word in set(_WORD.findall(text.lower())) for f in word_features(word)}
        at = np.fromiter(found, int, len(found))
        often[at] = np.minimum(often[at] + 1, 5)
    names: dict[str, int] = {}
    rows, sizes = [], []
    for text in texts[:split]:
        words = Counter(_WORD.findall(text.lower()))
        counts = Counter()
        for word, n in words.items():
            for f in word_features(word):
                if often[hash(f) & mask] == 5:
                    counts[names.setdefault(f, len(names))] += n
        sizes.append(max(sum(words.values()), 1))
        rows.append((np.fromiter(counts.keys(), np.int32, len(counts)), np.fromiter(counts.values(), np.float32, len(counts))))
    rows = [(at, _value(n, size)) for (at, n), size in zip(rows, sizes)]
    # how far a feature's mean value in toxic rows lies from that in clean rows, in pooled deviations
    total, square, seen = np.zeros((2, len(names))), np.zeros(len(names)), np.zeros(len(names))
    for (at, v), t in zip(rows, y):
        total[int(t)][at] += v
        square[at] += v * v
        seen[at] += 1
    n = np.array([(~y).sum(), y.sum()])
    apart = total[1] / n[1] - total[0] / n[0]
    spread = np.sqrt(np.maximum(square / n.sum() - (total.sum(0) / n.sum()) ** 2, 0)) + 0.02
    score = np.where(seen >= 5, apart / spread, 0)
    chosen = np.argsort(-score, kind="stable")[:keep]
    chosen = chosen[score[chosen] > 0]
    lookup = np.full(len(names), -1)
    lookup[chosen] = np.arange(len(chosen))
    strong = score[chosen] > 0.5
    rows = [(lookup[at][lookup[at] >= 0], v[lookup[at] >= 0]) for at, v in rows]
    share = np.array([v[strong[at]].sum() for at, v in rows])
    cuts = np.quantile(share[y], np.arange(1, grades) / grades)
    grade = np.where(y, 1 + np.searchsorted(cuts, share, "right"), 0)
    weights, thresholds = fit_cumulative(rows, grade, len(chosen), grades)
    back = {i: f for f, i in names.items()}
    model = Model({back[int(c)]: i for i, c in enumerate(chosen)}, weights, thresholds, least)
    clean = np.sort(model.severity([t for t, x in zip(texts[split:], toxic[split:]) if not x]))
    if len(clean):
        spare = int(len(clean) * false_rate)
        model.cutoff = max(least, float(clean[len(clean) - 1 - spare]) + 1e-6)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        fit_rows: int = 6000, **options) -> Model:
    marked = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_toxic")).dropna()
    few = marked.orderBy(F.xxhash64(F.lit(5), "_id"), "_id", "_toxic").limit(fit_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).filter(
        "_text is not null").join(F.broadcast(few), "_id")
    # one text per label, also where ids repeat; in the order of the hash again
    table = rows.groupBy("_id", "_toxic").agg(F.min("_text").alias("_text")).orderBy(
        F.xxhash64(F.lit(5), "_id"), "_id", "_toxic").toArrow()
    if not table.num_rows:
        return _nothing()
    return fit_texts(table["_text"].to_pylist(), table["_toxic"].to_numpy() > 0, **options)


_READY: dict = {}


def _score(held, texts: pa.Array) -> np.ndarray:
    """Severities under a broadcast model; a worker builds its automaton once."""
    if held.value is not _READY.get("model"):
        _READY.update(model=held.value, finder=held.value.finder())
    parts = [held.value.severity(texts.slice(at, 512).to_pylist(), _READY["finder"]) for at in range(0, len(texts), 512)]
    return np.concatenate(parts) if parts else np.zeros(0)


def severities(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``severity`` (expected grade), ``toxic``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = _score(held, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array(found >= held.value.cutoff)],
                                             [id_col, "severity", "toxic"])
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_text")).mapInArrow(
        run, f"`{id_col}` long, severity double, toxic boolean")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` below the cut-off, with their columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_score(held, batch.column(place)) < held.value.cutoff))
    return docs.mapInArrow(run, docs.schema)
