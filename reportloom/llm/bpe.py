"""Byte-level BPE encoding and decoding by replaying merges over a corpus of words.

A text is cut into words by the vocabulary's pattern; each word's ids depend on the word
alone. ``replay`` takes a whole corpus of distinct words at once: an inverted index from
the rank of a mergeable token pair to its places in the words hands out merges in rank
order, each applied at all its places, and only pairs with the two neighbours
of a place are looked up anew. The corpus of a replay is the set of words that a task
meets for the first time in a run of rows; a bounded memory (``most`` words) carries words
over to later rows. Words could be gathered over all of the input first, but bringing
their ids back would move every (text, word) pair; as words never influence
each other, the result is the same.

A pair made by a merge can rank below that merge, and two overlapping pairs can have one
rank. Applying a merge everywhere at once could then differ from the order within the
word, so such words are replayed alone, strictly by lowest rank and leftmost place.

Cases: a null text is empty (no ids, no bytes). Rows stay as they are: repeated, with null
ids, in any number; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CODECS: dict[tuple, "Codec"] = {}


class Codec:
    """Vocabulary, mergeable pairs, and the words met so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 400_000):
        self.ranks, self.pattern, self.most = ranks, regex.compile(pattern), most
        self.tokens: dict[int, bytes] = {i: t for t, i in ranks.items()}
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pair_keys = np.array(sorted(self.pairs), np.int64)
        self.pair_ranks = np.array([self.pairs[k] for k in self.pair_keys.tolist()], np.int64)
        # tokens of two overlapping cuts, as in X+Y = Y+Z: which comes first depends on the place
        self.unclear = {rank for token, rank in ranks.items() if any(
            token.startswith(token[cut:]) for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks and token[len(token) - cut:] in ranks
            and token[:cut] != token[cut:])}
        self.known: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> "Codec":
        if (path, pattern) not in _CODECS:
            with open(path, "rb") as lines:
                ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
            _CODECS[path, pattern] = cls(ranks, pattern)
        return _CODECS[path, pattern]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it is none."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[at], -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of every word of a corpus; words are not empty."""
        data = np.frombuffer(b"".join(words), np.uint8)
        length = np.array([len(w) for w in words])
        start = np.cumsum(length + 1) - length  # a free place (symbol -1) before each word and at the end
        symbol = np.full(len(data) + len(words) + 1, -1, np.int64)
        symbol[np.arange(len(data)) + np.repeat(np.arange(1, len(words) + 1), length)] = self.bytes[data]
        after, before = np.arange(len(symbol)) + 1, np.arange(len(symbol)) - 1
        index: dict[tuple[int, int], list[np.ndarray]] = {}  # (rank, pair) -> places of its left token
        queue: list[tuple[int, int]] = []
        odd: list[np.ndarray] = []  # places whose words need the strict order

        def note(left: np.ndarray, right: np.ndarray, now: int) -> None:
            rank = self._rank(symbol[left], symbol[right])
            some = np.flatnonzero(rank >= 0)
            if not len(some):
                return
            left, rank, key = left[some], rank[some], symbol[left[some]] << 32 | symbol[right[some]]
            odd.append(left[rank < now])
            order = np.argsort(key, kind="stable")
            left, rank, key = left[order], rank[order], key[order]
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            for a, b in zip(heads.tolist(), np.append(heads[1:], len(key)).tolist()):
                entry = (int(rank[a]), int(key[a]))
                if entry[0] < now:
                    continue
                if entry not in index:
                    index[entry] = []
                    heapq.heappush(queue, entry)
                index[entry].append(left[a:b])

        note(np.arange(len(symbol) - 1), np.arange(1, len(symbol)), -1)
        while queue:
            entry = heapq.heappop(queue)
            (now, pair), held = entry, index.pop(entry)
            a, b = pair >> 32, pair & 0xFFFFFFFF
            at = np.unique(np.concatenate(held)) if len(held) > 1 else np.sort(held[0])
            at = at[symbol[at] == a]
            at = at[symbol[after[at]] == b]
            if a == b and len(at) > 1:  # in a run of equal tokens the left ones pair first
                taken, spent = [], -1
                for p, q in zip(at.tolist(), after[at].tolist()):
                    if p != spent:
                        taken.append(p)
                        spent = q
                at = np.array(taken)
            if not len(at):
                continue
            right = after[at]
            if now in self.unclear or 0 <= self.pairs.get(now << 32 | a, -1) < now:
                odd.append(at)
            symbol[at], symbol[right] = now, -2
            after[at] = after[right]
            before[after[at]] = at
            note(before[at], at, now)
            note(at, after[at], now)
        live = symbol >= 0
        count = np.add.reduceat(live, start) if len(words) else np.zeros(0, int)
        stop = 4 * np.cumsum(count)
        packed = symbol[live].astype("<u4").tobytes()
        out = [packed[a:b] for a, b in zip((stop - 4 * count).tolist(), stop.tolist())]
        odd_places = np.concatenate(odd) if odd else np.zeros(0, int)
        for w in np.unique(np.searchsorted(start, odd_places, "right") - 1).tolist():
            out[w] = self._alone(words[w])
        return out

    def _alone(self, word: bytes) -> bytes:
        ids = [int(self.bytes[b]) for b in word]
        while len(ids) > 1:
            rank, at = min(((self.pairs.get(a << 32 | b, 1 << 60), i) for i, (a, b) in enumerate(zip(ids, ids[1:]))))
            if rank == 1 << 60:
                break
            ids[at:at + 2] = [rank]
        return np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str | None], run: int = 800_000) -> list[bytes]:
        """Packed ids of every text; words are replayed together for ``run`` words of text at a time."""
        out, held, size = [], [], 0
        for i, text in enumerate(texts):
            held.append(self.pattern.findall(text or ""))
            size += len(held[-1])
            if size > run or i == len(texts) - 1:
                self._learn(held)
                get = self.known.__getitem__
                out += [b"".join(map(get, words)) for words in held]
                held, size = [], 0
        return out

    def _learn(self, held: list[list[str]]) -> None:
        if len(self.known) > self.most:
            self.known.clear()
        words = set()
        words.update(*held)
        fresh, whole = [], self.ranks
        for word in words.difference(self.known):
            raw = word.encode()
            if raw in whole:
                self.known[word] = whole[raw].to_bytes(4, "little")
            else:
                fresh.append((word, raw))
        if fresh:
            self.known.update(zip([w for w, _ in fresh], self.replay([r for _, r in fresh])))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _rows(batches, rows: int = 2048):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids)``: the token ids of every text, little-endian 32-bit."""
    def run(batches):
        codec = Codec.load(ranks, pattern)
        for part in _rows(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codec.encode(part.column(1).to_pylist()), pa.binary())],
                                             [id_col, "ids"])
    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, f"`{id_col}` long, ids binary")


def decode(encoded: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, data)``: the bytes of every row of packed ids; null ids give no bytes."""
    def run(batches):
        codec = Codec.load(ranks, pattern)
        for part in _rows(batches):
            data = [codec.decode(x or b"") for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], [id_col, "data"])
    return encoded.select(F.col(id_col).cast("long").alias(id_col), ids_col).mapInArrow(run, f"`{id_col}` long, data binary")


def digests(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_tokens``, SHA-256 of the ids, SHA-256 of the bytes decoded from them again."""
    def run(batches):
        codec = Codec.load(ranks, pattern)
        for part in _rows(batches):
            ids = codec.encode(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                 pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(
        run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")
