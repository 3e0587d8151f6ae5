"""Best-fit packing of tokenised documents into sequences of fixed capacity.

1. Texts become token ids; a document longer than the capacity is cut into pieces, the
   last of which may be shorter.
2. Pieces are counted by length: at most ``capacity`` counts, whatever the corpus.
3. ``plan`` packs the counts. Pieces above one third of the capacity meet at most twice
   in a sequence: from the longest down, each is matched with the longest partner that
   fits. Smaller pieces, longest first, go into the sequence with the smallest gap
   that holds them, else into a new one. All pieces of a length that meet sequences of the
   same gap are placed in one step, so the work depends on the capacity only. The plan
   is a table of runs: the i-th piece of a length goes to this sequence at this offset.
4. Every piece gets its number among the pieces of its length, from counts by (length,
   salt) and its rank inside its salt, so that a length that holds a third of all pieces
   is spread over many tasks. The plan (bounded by the capacity) travels with the task.

Cases: a null text is empty: one piece, the end id alone. Repeated rows are separate
documents. Rows with a null id are packed too. An empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

import bisect
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportloom.llm.common import shuffle_parts
from reportloom.plans.store import materialize

CAPACITY = 2048

_ENCODERS: dict[str, "_WordEncoder"] = {}


class _WordEncoder:
    """Ids of texts from ids of their white-space separated pieces, each encoded once.

    The tokenizer drops white space and never joins characters across it, ignores case, and
    takes a mark that ends a piece after an ASCII letter or digit as a token of its own. So a
    text's ids are those of its pieces, ASCII case can be folded first, and a piece with
    such a mark is the piece and the mark. A piece with ``<|`` may hold a special token, which
    the tokenizer knows by its case; it is encoded whole and as it stands. The memory holds ``most`` pieces and is then
    emptied.
    """

    _MARKS = {bytes([c]): bytes([c]) for c in b".,;:!?"}

    def __init__(self, path: str, most: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.most = most

    @classmethod
    def get(cls, path: str, most: int) -> "_WordEncoder":
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        _ENCODERS[path].most = most
        return _ENCODERS[path]

    def learn(self, pieces: set[bytes]) -> None:
        if len(self.known) > self.most:
            self.known.clear()
        known, marks = self.known, self._MARKS
        plain, marked = set(), []
        for p in pieces.difference(known):
            if b"<|" not in p and p[-1:] in marks and len(p) > 1 and p[-2] < 128 and chr(p[-2]).isalnum():
                marked.append(p)
                plain.update((p[:-1], marks[p[-1:]]))
            else:
                plain.add(p)
        letters, others = [], []
        for p in plain.difference(known):
            (letters if p.decode().isalpha() else others).append(p)
        self._encode_letters(letters)
        self._encode_each(others)
        for p in marked:
            known[p] = known[p[:-1]] + known[p[-1:]]

    def _encode_each(self, pieces: list[bytes]) -> None:
        for i in range(0, len(pieces), 20_000):
            some = pieces[i:i + 20_000]
            found = self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)
            self.known.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(some, found))

    def _encode_letters(self, pieces: list[bytes], run: int = 200) -> None:
        """Pieces of letters alone are one word each: encoded in runs, and cut where a word ends."""
        runs = [pieces[i:i + run] for i in range(0, len(pieces), run)]
        found = self.tokenizer.encode_batch_fast([b" ".join(r).decode() for r in runs], add_special_tokens=False)
        for words, e in zip(runs, found):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(words):
                self._encode_each(words)
                continue
            packed, ends = ids.tobytes(), (4 * ends).tolist()
            self.known.update(zip(words, map(packed.__getitem__, map(slice, [0, *ends], ends))))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of every text."""
        out, pending, size = [], [], 0
        for i, text in enumerate(texts):
            raw = (text or "").encode()
            if b"<|" in raw:
                pending.append([p if b"<|" in p else p.lower() for p in raw.split()])
            else:
                pending.append(raw.lower().split())
            size += len(pending[-1])
            if size > 500_000 or i == len(texts) - 1:
                words = set()
                words.update(*pending)
                self.learn(words)
                get = self.known.__getitem__
                out += [b"".join(map(get, p)) for p in pending]
                pending, size = [], 0
        return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False, most_words: int = 1_200_000, forget: bool = False) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``; with ``with_ids`` also ``ids``, the packed token ids.

    A worker remembers the ids of ``most_words`` words, and keeps them for its next task unless told
    to ``forget`` them, which frees memory for other stages at the price of encoding words again.
    """
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = _WordEncoder.get(tokenizer, most_words)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for i, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                    ids += tail
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[a:a + 4 * capacity]
                        rows.append((i, k, a // 4, len(own) // 4, zlib.crc32(own), own if with_ids else None))
                names = ["id", "piece", "start", "length", "ids_crc32", "ids"][:5 + with_ids]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows))[:5 + with_ids], kinds)],
                                                 names)
        if forget:
            encoder.known.clear()
            _ENCODERS.pop(tokenizer, None)

    schema = "id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs that place all pieces, and the number of sequences.

    A run is ``(length, first, sequence, sequences, each, offset)``: from the ``first``
    piece of this length on, ``each`` pieces in a row go into each of ``sequences``
    sequences from ``sequence`` on, side by side from ``offset`` on.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used, runs, total = dict.fromkeys(left, 0), [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> [(first sequence, sequences)]

    def put(length, sequence, sequences, each, offset):
        runs.append((length, used[length], sequence, sequences, each, offset))
        used[length] += sequences * each
        left[length] -= sequences * each

    def free(gap, sequence, sequences):
        if gap and sequences:
            if gap not in gaps:
                bisect.insort(order, gap)
            gaps.setdefault(gap, []).append((sequence, sequences))

    order: list[int] = []
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        for b in large:  # the longest partner first
            if not left[a]:
                break
            if b > a or a + b > capacity or not left[b]:
                continue
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if n:
                put(a, total, n, 1, 0)
                put(b, total, n, 1, a)
                free(capacity - a - b, total, n)
                total += n
        if left[a]:
            n = left[a]
            put(a, total, n, 1, 0)
            free(capacity - a, total, n)
            total += n
    for a in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[a]:
            at = bisect.bisect_left(order, a)
            if at == len(order):
                each = min(capacity // a, left[a])
                n = max(1, left[a] // each)
                put(a, total, n, each, 0)
                free(capacity - a * each, total, n)
                total += n
                continue
            gap = order[at]
            sequence, have = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            each = min(gap // a, left[a])
            n = min(have, left[a] // each)
            put(a, sequence, n, each, capacity - gap)
            free(gap - a * each, sequence, n)
            free(gap, sequence + n, have - n)
    return np.array(runs, np.int64).reshape(-1, 6), total


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces (``id, piece, start, length``, more)."""
    salts = 4 * shuffle_parts(items)
    by = ["id", "piece", "start", *(c for c in items.columns if c == "ids_crc32")]
    salted = items.withColumn("_salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)).cast("int"))
    sizes = materialize(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "piece-counts")
    before = sizes.select("length", "_salt", (F.sum("_n").over(
        Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    base = 1 << 42
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*by)) - 1
    numbered = salted.withColumn("_rank", rank).join(before, ["length", "_salt"])
    numbered = numbered.select(*items.columns, (F.col("_before") + F.col("_rank")).alias("_index"))
    kept = items.columns

    def place(batches):
        marks = runs[:, 0] * base + runs[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            index = batch.column("_index").to_numpy()
            _, first, sequence, _, each, offset = runs[np.searchsorted(marks, length * base + index, "right") - 1].T
            nth = index - first
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence + nth // each), pa.array(offset + nth % each * length)],
                [*kept, "sequence_id", "offset"])

    schema = items.schema.add("sequence_id", "long").add("offset", "long")
    return numbered.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, **memory) -> DataFrame:
    """Pieces of all documents with their places; the id column keeps its name."""
    items = materialize(pieces(docs, tokenizer, end_id, capacity, id_col, text_col, with_ids, **memory), "pieces")
    return pack(items, capacity).withColumnRenamed("id", id_col)
