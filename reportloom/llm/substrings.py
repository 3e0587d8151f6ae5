"""Removal of passages that repeat anywhere in the corpus.

A window is ``size`` consecutive words of one text. Every word covered by a window whose
word sequence also starts elsewhere is removed.

Pass 1, count-min prefilter. Of each window the *mark* is its run of ``gram`` words with
the smallest hash. Equal windows have equal marks at different places, so a window whose
mark occurs once cannot repeat; only about every tenth word starts a mark, so the sketch
counts a tenth of the windows. Every task counts its marks in sketch cells and sends the
cells it touched, slice by slice; slices are merged over the tasks in two steps. Cells
only ever count too much (collisions, and two per block at most where two is enough), so
nothing that repeats is lost. What leaves the merge is one bit per cell, "two or more":
``depth * 2**log2_cells / 8`` bytes, 32 MB as set, whatever the corpus; this bounded
table is broadcast. On a corpus that fills the sketch more windows pass and the result
stays the same.

Pass 2, exact grouping. Windows whose mark is estimated repeated travel under a 96-bit
hash of their words, packed into byte blobs by hash bucket. A block of text sends a hash
once, however often it has it (repeats within the block are known on the spot), so a
passage found in a third of all texts costs one record a block. A bucket with a hash
from two places returns the places, packed again by text, and every text gets one row; there are ``buckets`` of them, four times the
session's shuffle partitions unless given.

Cases: a null text has no words, as an empty one. Rows of equal id and text, null ids
included, are separate rows that repeat each other. Texts shorter than a window lose
nothing. An empty table gives no rows. Extra columns of any name pass through
``without_repeats`` and are not read by ``removals``.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.llm.common import Words, blocks, mix, per_block, release, row_key, shuffle_parts, sliding, span_hashes

WINDOW, GRAM = 35, 16
_SLICES = 64
_RECORD = np.dtype([("h1", "<u8"), ("h2", "<u4"), ("doc", "<u4"), ("at", "<u4")])
_KNOWN = np.uint32(0xFFFFFFFF)


def _marks(word_hash: np.ndarray, starts: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the mark of every window, and the hashes of all places that are a mark of some window."""
    n = len(word_hash)
    at = np.arange(n - gram + 1)
    grams = span_hashes(word_hash, at, at + gram)
    width = size - gram + 1
    low = sliding(np.minimum, grams, width)  # per window start
    of_window = low[starts]
    inside = np.zeros(len(low) + 2 * (width - 1), np.uint64)
    inside[starts + width - 1] = of_window
    chosen = sliding(np.maximum, inside, width) == grams
    return of_window, grams[chosen]


def _cells(marks: np.ndarray, depth: int, log2_cells: int) -> list[np.ndarray]:
    shift = np.uint64(64 - log2_cells)
    return [(mix(marks + np.uint64(0x632BE59BD9B4E019) * np.uint64(r + 1)) >> shift).astype(np.int64)
            for r in range(depth)]


def _counts(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells touched once, and more than once."""
    cells = np.sort(cells)
    head = np.ones(len(cells), bool)
    head[1:] = cells[1:] != cells[:-1]
    places = np.flatnonzero(head)
    often = np.diff(np.append(places, len(cells))) > 1
    return cells[places[~often]], cells[places[often]]


def _sliced(row: int, once: np.ndarray, more: np.ndarray, per_slice: int):
    """Cut sorted cells into slices: (slice of the sketch, cells touched once, cells touched more)."""
    edges = np.arange(_SLICES + 1) * per_slice
    a, b = np.searchsorted(once, edges), np.searchsorted(more, edges)
    for k in range(_SLICES):
        if a[k] < a[k + 1] or b[k] < b[k + 1]:
            yield (row * _SLICES + k, (once[a[k]:a[k + 1]] - edges[k]).astype("<u4").tobytes(),
                   (more[b[k]:b[k + 1]] - edges[k]).astype("<u4").tobytes())


_SKETCH = pa.schema([("slice", pa.int32()), ("salt", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])
_SKETCH_SQL = "slice int, salt int, once binary, more binary"


def _sketch_rows(rows: list[tuple], salt: int) -> pa.RecordBatch:
    s, once, more = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array([salt] * len(s), pa.int32()),
                                       pa.array(once, pa.binary()), pa.array(more, pa.binary())], schema=_SKETCH)


def _merge(per_slice: int):
    """Add up sketches, slice by slice; rows arrive sorted by slice."""
    def run(batches):
        now, cells = None, None

        def done():
            return _sketch_rows([(now, np.flatnonzero(cells == 1).astype("<u4").tobytes(),
                                  np.flatnonzero(cells > 1).astype("<u4").tobytes())], 0)
        for batch in batches:
            for s, once, more in zip(batch.column("slice").to_pylist(), batch.column("once"), batch.column("more")):
                if s != now:
                    if now is not None:
                        yield done()
                    now, cells = s, np.zeros(per_slice, np.uint8)
                for blob, add in ((once, 1), (more, 2)):
                    at = np.frombuffer(blob.as_buffer(), "<u4")
                    cells[at] = np.minimum(cells[at] + add, 2)
        if now is not None:
            yield done()
    return run


def sketch(docs: DataFrame, text_col: str = "text", size: int = WINDOW, gram: int = GRAM, depth: int = 2,
           log2_cells: int = 27, salts: int = 16) -> dict[int, bytes]:
    """Bits of the cells that count two or more: slice to compressed bytes (no bytes: no such cell)."""
    per_slice = (1 << log2_cells) // _SLICES

    def count(batches):
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                words = Words(data, offsets)
                starts = words.windows(size)
                if not len(starts):
                    continue
                _, marks = _marks(words.hashes(), starts, size, gram)
                salt = int(marks[0] % np.uint64(salts))
                rows = [x for r, cells in enumerate(_cells(marks, depth, log2_cells))
                        for x in _sliced(r, *_counts(cells), per_slice)]
                if rows:
                    yield _sketch_rows(rows, salt)
            release()

    parts = docs.select(F.col(text_col).alias("_text")).mapInArrow(count, _SKETCH_SQL)
    half = parts.repartition("slice", "salt").sortWithinPartitions("slice").mapInArrow(_merge(per_slice), _SKETCH_SQL)

    def packed(batches):
        for batch in _merge(per_slice)(batches):
            bits = np.zeros(per_slice, np.uint8)
            bits[np.frombuffer(batch.column("more")[0].as_buffer(), "<u4")] = 1
            yield pa.RecordBatch.from_arrays([batch.column("slice"), pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)])],
                                             ["slice", "bits"])

    whole = half.repartition("slice").sortWithinPartitions("slice").mapInArrow(packed, "slice int, bits binary")
    return {row.slice: bytes(row.bits) for row in whole.toLocalIterator()}


def _unpacked(slices: dict[int, bytes], depth: int, log2_cells: int) -> np.ndarray:
    """One row of bytes per sketch row."""
    out = np.zeros((depth * _SLICES, (1 << log2_cells) // _SLICES // 8), np.uint8)
    for s, bits in slices.items():
        out[s] = np.frombuffer(zlib.decompress(bits), np.uint8)
    return out.reshape(depth, -1)


def _repeated_estimate(marks: np.ndarray, bits: np.ndarray, log2_cells: int) -> np.ndarray:
    hit = np.ones(len(marks), bool)
    for row, cells in zip(bits, _cells(marks, len(bits), log2_cells)):
        hit &= (row[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
    return hit


#: windows of texts packed by bucket (``keys`` are the texts'), or, without keys, places packed by bucket
_SENT = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("packed", pa.binary())])
_PLACE = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("at", "<u4")])


def _pack_places(places: np.ndarray, buckets: int) -> list[tuple[int, None, bytes]]:
    """Places packed by the bucket of their text."""
    to = (places["k1"] % buckets).astype(np.int32)
    order = np.argsort(to, kind="stable")
    places, to = places[order], to[order]
    cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, int)
    return [(int(to[a]), None, places[a:b].tobytes()) for a, b in zip(cuts, np.append(cuts[1:], len(to)))]


def _places(keys: np.ndarray, records: np.ndarray) -> np.ndarray:
    out = np.zeros(len(records), _PLACE)
    out["k1"], out["k2"], out["at"] = keys[records["doc"], 0], keys[records["doc"], 1], records["at"]
    return out


def _send(bits, size: int, gram: int, depth: int, log2_cells: int, buckets: int):
    """Pass 2 over a block: packed windows by bucket, and the places already known to repeat."""
    def run(batches):
        table = _unpacked(bits.value, depth, log2_cells)
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in ("k1", "k2")], 1)
            for first, last, data, offsets in blocks(batch.column("_text")):
                words = Words(data, offsets)
                starts = words.windows(size)
                if not len(starts):
                    continue
                hashes = words.hashes()
                marks, _ = _marks(hashes, starts, size, gram)
                starts = starts[_repeated_estimate(marks, table, log2_cells)]
                if not len(starts):
                    continue
                rec = np.zeros(len(starts), _RECORD)
                rec["h1"] = span_hashes(hashes, starts, starts + size)
                rec["h2"] = span_hashes(words.hashes(1), starts, starts + size, 1) >> np.uint64(32)
                rec["doc"] = words.doc[starts]
                rec["at"] = starts - words.first[words.doc[starts]]
                order = np.lexsort((rec["h2"], rec["h1"]))
                rec = rec[order]
                head = np.append(True, (rec["h1"][1:] != rec["h1"][:-1]) | (rec["h2"][1:] != rec["h2"][:-1]))
                group = np.cumsum(head) - 1
                often = np.bincount(group)[group] > 1
                out = _pack_places(_places(keys[first:last], rec[often]), buckets)
                rec["doc"][often] = _KNOWN
                rec = rec[head]
                to = (rec["h1"] % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                rec, to = rec[order], to[order]
                cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
                for a, b in zip(cuts, np.append(cuts[1:], len(to))):
                    part = rec[a:b].copy()
                    own = part["doc"] != _KNOWN
                    ids, place = np.unique(part["doc"][own], return_inverse=True)
                    part["doc"][own] = place
                    out.append((int(to[a]), keys[first:last][ids].tobytes(), part.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SENT.types)], schema=_SENT)
            release()
    return run


def _group(buckets: int, run_length: int = 200_000):
    """Buckets of windows to packed places of windows seen from two or more places; rows sorted by bucket."""
    def exact(held):
        recs, keys, base = [], [], 0
        for own, packed in held:
            own = np.frombuffer(own, np.int64).reshape(-1, 2)
            part = np.frombuffer(packed, _RECORD).copy()
            part["doc"][part["doc"] != _KNOWN] += np.uint32(base)
            recs.append(part)
            keys.append(own)
            base += len(own)
        rec, keys = np.concatenate(recs), np.concatenate(keys)
        rec = rec[np.lexsort((rec["h2"], rec["h1"]))]
        head = np.append(True, (rec["h1"][1:] != rec["h1"][:-1]) | (rec["h2"][1:] != rec["h2"][:-1]))
        group = np.cumsum(head) - 1
        return _places(keys, rec[(np.bincount(group)[group] > 1) & (rec["doc"] != _KNOWN)])

    def run(batches):
        now, held, found, size = None, [], [], 0

        def packed():
            rows = _pack_places(np.concatenate(found), buckets)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                               pa.array([r[2] for r in rows], pa.binary())], ["bucket", "packed"])
        for batch in batches:
            for bucket, keys, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if keys is None:
                    found.append(np.frombuffer(blob, _PLACE))
                    size += len(found[-1])
                    continue
                if bucket != now and held:
                    found.append(exact(held))
                    size += len(found[-1])
                    held = []
                now = bucket
                held.append((keys, blob))
                if size > run_length:
                    yield packed()
                    found, size = [], 0
        if held:
            found.append(exact(held))
        if found:
            yield packed()
    return run


def _by_text(batches):
    """Packed places to one row per text; rows sorted by bucket."""
    def rows(held):
        places = np.unique(np.concatenate([np.frombuffer(b, _PLACE) for b in held]))
        heads = np.flatnonzero(np.append(True, (places["k1"][1:] != places["k1"][:-1]) | (places["k2"][1:] != places["k2"][:-1])))
        at = places["at"].astype("<u4")
        return pa.RecordBatch.from_arrays(
            [pa.array(places["k1"][heads]), pa.array(places["k2"][heads]),
             pa.array([at[a:b].tobytes() for a, b in zip(heads, np.append(heads[1:], len(at)))], pa.binary())],
            ["k1", "k2", "places"])

    now, held = None, []
    for batch in batches:
        for bucket, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now and held:
                yield rows(held)
                held = []
            now = bucket
            held.append(blob)
    if held:
        yield rows(held)


def repeated_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW,
                    gram: int = GRAM, depth: int = 2, log2_cells: int = 27, buckets: int | None = None) -> DataFrame:
    """``(k1, k2, places)``: per text the word positions at which a repeated window starts (blobs of uint32)."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(sketch(docs, text_col, size, gram, depth, log2_cells))
    buckets = buckets or 4 * shuffle_parts(docs)
    sent = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("_text")).mapInArrow(
        _send(bits, size, gram, depth, log2_cells, buckets), "bucket int, keys binary, packed binary")
    found = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _group(buckets), "bucket int, packed binary")
    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _by_text, "k1 long, k2 long, places binary")


def _kept(words: Words, rows, size: int) -> np.ndarray:
    """Which words stay, given the starts of repeated windows."""
    step = np.zeros(len(words) + size + 1, np.int32)
    for r, places in enumerate(rows.column("places").to_pylist()):
        if places:
            at = np.frombuffer(places, "<u4") + words.first[r]
            step[at] += 1
            step[at + size] -= 1
    return np.cumsum(step)[:len(words)] == 0


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, **options) -> DataFrame:
    """Per row: id, ``n_words``, ``n_removed``, ``kept_sha256`` of the kept words joined by one space."""
    places = repeated_places(docs, id_col, text_col, size, **options)
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("kept_sha256", pa.string())])

    def of(rows, data, offsets):
        words = Words(data, offsets)
        keep = _kept(words, rows, size)
        plain, bounds, _, _ = words.joined(keep)
        removed = np.bincount(words.doc[~keep], minlength=len(words.counts))
        return {"id": rows.column("id"), "n_words": words.counts, "n_removed": removed,
                "kept_sha256": [hashlib.sha256(plain[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])]}

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text"), *row_key(id_col, text_col))
    joined = rows.join(places, ["k1", "k2"], "left").select("id", "_text", "places")
    return joined.mapInArrow(per_block(of, schema, "_text"),
                             "id long, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW,
                    **options) -> DataFrame:
    """``docs`` with repeated passages removed from their texts; other columns and untouched texts as they are.

    A text that loses words is its kept words joined by one space (empty if none is left).
    """
    places = repeated_places(docs, id_col, text_col, size, **options).withColumnsRenamed(
        {"k1": "_key1", "k2": "_key2", "places": "_places"})
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{text_col}`").alias("_text"),
                       *(k.alias(f"_key{i}") for i, k in enumerate(row_key(id_col, text_col), 1)))
    joined = held.join(places, ["_key1", "_key2"], "left").select("_row", "_text", "_places")

    def run(batches):
        for batch in batches:
            for first, last, data, offsets in blocks(batch.column("_text")):
                rows = batch.slice(first, last - first)
                words = Words(data, offsets)
                keep = _kept(words, rows.rename_columns(["_row", "_text", "places"]), size)
                plain, bounds, _, _ = words.joined(keep)
                cut = np.bincount(words.doc[~keep], minlength=len(words.counts)) > 0
                texts = rows.column("_text").to_pylist()
                for r in np.flatnonzero(cut):
                    texts[r] = plain[bounds[r]:bounds[r + 1]].tobytes().decode()
                yield pa.RecordBatch.from_arrays([rows.column("_row"), pa.array(texts, pa.string())], ["_row", "_new"])
            release()

    out = joined.mapInArrow(run, _row_schema(joined))
    return out.select(*(F.col("_new").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def _row_schema(joined: DataFrame):
    from pyspark.sql.types import StringType, StructField, StructType
    return StructType([joined.schema["_row"], StructField("_new", StringType())])
