"""Near-duplicate groups by SimHash fingerprints and a generalised pigeonhole search.

1. A fingerprint per text (64 bits, majority of the hashes of its word shingles).
2. Equal fingerprints are one *class*; the search sees every class once, so thousands
   of copies cost one row.
3. ``fit_plan`` groups bits that vary together into partitions and gives every partition
   a threshold of its own. By the generalised pigeonhole principle thresholds that sum
   to ``limit - partitions + 1`` find every pair within ``limit`` bits: a pair within
   the limit that exceeded its threshold in each partition would differ in more bits
   than the limit. A threshold of -1 leaves a partition out. Dynamic programming
   picks thresholds by the estimated number of candidates and of probe rows, for
   several numbers of partitions. The plan is fitted on a bounded sample of classes
   (``fit_rows``); it decides cost only, never the result.
4. Probe: classes meet under (partition, value); where the threshold is positive one side
   also asks for every value within so many bits. Verify: the whole fingerprints.
   Inside a meeting only the edges of a spanning forest leave the task, never all
   pairs. A meeting of more than ``block`` classes is cut into blocks, and each pair of
   blocks is a group of its own, so that no task holds a large group.
5. Components of the classes by ``components``; only classes and edges are moved, no text.

Cases: a null text is empty and has fingerprint zero, as has a text without words; such
rows link like any other. Rows with a null id keep their row; they take part, but are
never the name of a component unless all its ids are null (then it is null). Repeated
rows stay repeated. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.llm.common import Words, per_block, row_key
from reportloom.llm.components import components
from reportloom.plans.store import discard, materialize

BITS = 64
#: bytes of text at a time; a shingle takes some 300 bytes while it is hashed and counted
BLOCK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def block_fingerprints(data: np.ndarray, offsets: np.ndarray, width: int = 3) -> np.ndarray:
    """Unsigned fingerprints of the texts of a block."""
    words = Words(_LOWER[data], offsets)
    plain, bounds, begin, end = words.joined()
    count = words.counts
    shingles = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    first = np.repeat(words.first[:-1], shingles) + np.arange(shingles.sum()) - np.repeat(
        np.cumsum(shingles) - shingles, shingles)
    last = first + np.repeat(np.minimum(np.maximum(count, 1), width), shingles) - 1
    text, digest = plain.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], 42) for a, b in zip(begin[first].tolist(), end[last].tolist())),
                         np.uint64, len(first)) if len(first) else np.zeros(0, np.uint64)
    out = np.zeros(len(count), np.uint64)
    rows = np.flatnonzero(shingles)
    if len(rows):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(shingles) - shingles)[rows], axis=0, dtype=np.int32)
        major = (2 * ones > shingles[rows][:, None]).astype(np.uint8)
        out[rows] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id_col, fp)`` for every row; ``fp`` is the fingerprint as a signed 64-bit integer."""
    schema = pa.schema([(id_col, pa.int64()), ("fp", pa.int64())])

    def of(rows, data, offsets):
        return {id_col: rows.column(0), "fp": block_fingerprints(data, offsets, width).view(np.int64)}

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_text")).mapInArrow(
        per_block(of, schema, "_text", BLOCK), f"`{id_col}` long, fp long")


@dataclass(frozen=True)
class Plan:
    masks: tuple[int, ...]
    thresholds: tuple[int, ...]


def _bit_groups(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Bits that vary together share a partition: each group grows by its most correlated free bit."""
    spread = bits - bits.mean(0)
    scale = np.sqrt((spread ** 2).sum(0)) + 1e-9
    alike = np.abs(spread.T @ spread) / np.outer(scale, scale)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [max(free, key=lambda b: alike[b][free].sum())]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: alike[b][group].sum())
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def _meeting_rates(bits: np.ndarray, values: np.ndarray, mask: int, group: list[int], most: int) -> np.ndarray:
    """Estimated share of class pairs within 0..most bits in a partition: independence and the sample."""
    p = bits[:, group].mean(0)
    differ = 2 * p * (1 - p)
    chance = np.zeros(most + 2)
    chance[0] = 1
    for d in differ:
        chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
        chance[0] *= 1 - d
        chance[-1] = 0
    part = values & np.uint64(mask)
    seen, pairs = np.zeros(most + 1), 0
    for shift in range(1, min(len(part), 257)):
        distance = np.bitwise_count(part ^ np.roll(part, shift))
        pairs += len(part)
        seen += [(distance <= t).sum() for t in range(most + 1)]
    return np.maximum(np.cumsum(chance[:most + 1]), seen / max(pairs, 1))


def _probe_rows(width: int, threshold: int) -> float:
    total, ways = 1.0, 1.0
    for t in range(1, threshold + 1):
        ways = ways * (width - t + 1) / t
        total += ways
    return total


def fit_plan(sample: np.ndarray, classes: int, limit: int = 3, row_cost: float = 30.0, most: int = 2) -> Plan:
    """Partitions and thresholds of least estimated cost for ``classes`` fingerprints.

    A candidate comparison costs 1, a row sent to a meeting ``row_cost``. ``most`` is
    the largest threshold considered.
    """
    sample = sample.astype(np.uint64)
    if not len(sample):
        sample = np.zeros(1, np.uint64)
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    best = None
    for parts in range(2, limit + 2):
        groups = _bit_groups(bits, parts)
        masks = [sum(1 << b for b in g) for g in groups]
        price = []  # per partition, by threshold from -1
        for group, mask in zip(groups, masks):
            rates = _meeting_rates(bits, sample, mask, group, most)
            price.append([0.0] + [classes * classes / 2 * rates[t] + row_cost * classes * (
                _probe_rows(len(group), t) + (t > 0)) for t in range(most + 1)])
        goal = limit - parts + 1 + parts  # sum of (threshold + 1)
        table = {0: (0.0, ())}
        for options in price:
            step = {}
            for used, (cost, chosen) in table.items():
                for taken, extra in enumerate(options):
                    if used + taken <= goal and (used + taken not in step or step[used + taken][0] > cost + extra):
                        step[used + taken] = (cost + extra, (*chosen, taken - 1))
            table = step
        if goal in table and (best is None or table[goal][0] < best[0]):
            best = (table[goal][0], Plan(tuple(masks), table[goal][1]))
    return best[1]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _forest(left: np.ndarray, right: np.ndarray | None, limit: int, step: int = 1024) -> list[np.ndarray]:
    """Edges that connect all that pairs within ``limit`` bits connect; compared in blocks.

    ``right`` None compares ``left`` with itself. Of the pairs found in a block each row
    keeps one at a time, until no pair joins two parts any more.
    """
    rows = left if right is None else np.concatenate([left, right])
    base = 0 if right is None else len(left)
    part, edges = np.arange(len(rows)), []
    for a in range(0, len(left), step):
        for b in range(a if right is None else base, len(rows), step):
            near = np.bitwise_count(rows[a:min(a + step, base or len(rows)), None] ^ rows[None, b:b + step]) <= limit
            while True:
                open_ = near & (part[a:a + near.shape[0], None] != part[None, b:b + near.shape[1]])
                some = np.flatnonzero(open_.any(1))
                if not len(some):
                    break
                for i, j in zip((a + some).tolist(), (b + open_[some].argmax(1)).tolist()):
                    if part[i] != part[j]:
                        part[part == part[j]] = part[i]
                        edges.append(np.array([rows[i], rows[j]], np.uint64))
    return edges


def _small_groups(fp: np.ndarray, side: np.ndarray, own: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
    """Pairs within ``limit`` bits of many small groups at once, less those that close a circle."""
    found, at, gap = [], np.arange(len(fp) - 1), 1
    while len(at):
        at = at[at + gap < len(fp)]
        at = at[group[at] == group[at + gap]]
        ahead = at + gap
        near = np.bitwise_count(fp[at] ^ fp[ahead]) <= limit
        near &= ((side[at] == 0) | (side[ahead] == 0)) & (fp[at] != fp[ahead])
        found.append(np.stack([at[near], ahead[near]], 1))
        gap += 1
    parent, keep = {}, []
    for pair in (np.concatenate(found) if found else np.zeros((0, 2), int)).tolist():
        i, j = pair
        while parent.get(i, i) != i:
            i = parent[i]
        while parent.get(j, j) != j:
            j = parent[j]
        if i != j:
            parent[j] = i
            keep.append(pair)
    return fp[np.array(keep, int).reshape(-1, 2)]


def _verifier(limit: int, small: int = 64):
    """``mapInArrow`` over rows sorted by meeting: edges of every meeting, one batch of meetings at a time."""
    def edges_of(keys: np.ndarray, fp: np.ndarray, side: np.ndarray, own: np.ndarray) -> np.ndarray:
        fp = fp.view(np.uint64)
        head = np.ones(len(fp), bool)
        head[1:] = (keys[1:] != keys[:-1]).any(1)
        group = np.cumsum(head) - 1
        size = np.bincount(group)
        few = size[group] <= small
        out = [_small_groups(fp[few], side[few], own[few], group[few], limit)]
        starts = np.flatnonzero(head)
        for g in np.flatnonzero(size > small):
            rows = slice(starts[g], starts[g] + size[g])
            f, s, o, (_, _, i, j) = fp[rows], side[rows], own[rows], keys[starts[g]]
            exact = s == 0
            found = _forest(f[exact], None, limit) if i == j else _forest(
                f[exact & (o == i)], f[exact & (o == j)], limit)
            for x, y in {(i, j), (j, i)} if not exact.all() else ():
                found += _forest(f[exact & (o == x)], f[~exact & (o == y)], limit)
            if found:
                out.append(np.stack(found))
        return np.concatenate(out)

    def run(batches):
        held = None
        for batch in batches:
            now = [np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("part", "value", "i", "j")], 1),
                   *(batch.column(c).to_numpy() for c in ("fp", "side", "own"))]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            keys = now[0]
            if not len(keys):
                continue
            same = (keys == keys[-1]).all(1)
            cut = len(keys) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = [x[cut:] for x in now]
            if cut:
                yield _edge_batch(edges_of(*(x[:cut] for x in now)))
        if held is not None:
            yield _edge_batch(edges_of(*held))
    return run


def _edge_batch(edges: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(edges[:, k].copy().view(np.int64)) for k in (0, 1)], ["a", "b"])


def links(classes: DataFrame, plan: Plan, limit: int = 3, block: int = 512) -> DataFrame:
    """Edges ``(a, b)`` between fingerprints that connect exactly what pairs within ``limit`` bits connect."""
    meetings = []
    for k, (mask, threshold) in enumerate(zip(plan.masks, plan.thresholds)):
        if threshold < 0:
            continue
        bits = [b for b in range(BITS) if mask >> b & 1]
        flips = [_signed(sum(1 << b for b in some)) for t in range(1, threshold + 1) for some in combinations(bits, t)]
        value = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        meetings.append(classes.select(F.lit(k).alias("part"), value.alias("value"), F.lit(0).alias("side"), "fp"))
        if flips:
            asked = F.explode(F.transform(F.array(*map(F.lit, flips)), lambda x: value.bitwiseXOR(x)))
            meetings.append(classes.select(F.lit(k).alias("part"), asked.alias("value"), F.lit(1).alias("side"), "fp"))
    rows = meetings[0]
    for more in meetings[1:]:
        rows = rows.union(more)
    size = rows.groupBy("part", "value").agg(F.count("*").alias("n"), F.min("side").alias("s")).filter("n > 1 and s = 0")
    size = materialize(size.select("part", "value", F.ceil(F.col("n") / block).cast("int").alias("cuts")), "meetings")
    met = rows.join(size, ["part", "value"])
    # block pairs: a row goes to every pair that has its own block
    own = F.pmod(F.xxhash64(F.lit(3), "fp"), F.col("cuts")).cast("int")
    met = met.withColumn("own", own).select(
        "part", "value", "side", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
    met = met.select("part", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     "own", "side", "fp")

    key = ["part", "value", "i", "j"]
    return met.repartition(*key).sortWithinPartitions(*key).mapInArrow(_verifier(limit), "a long, b long")


def classes_of(marked: DataFrame, id_col: str, limit: int = 3, fit_rows: int = 8192, block: int = 512) -> DataFrame:
    """``(fp, root, component_id)`` for the fingerprints of a written table: a fingerprint of
    its component that stands for it, and the smallest id in the component."""
    classes = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("low")), "classes")
    total = classes.count()
    sample = classes.select("fp").orderBy(F.xxhash64(F.lit(4), "fp")).limit(fit_rows).toArrow().column("fp")
    plan = fit_plan(sample.to_numpy().astype(np.int64).view(np.uint64), total, limit)
    edges = materialize(links(classes.select("fp"), plan, limit, block), "links")
    roots = materialize(components(edges).withColumnRenamed("node", "fp"), "roots")
    discard(edges)
    rooted = classes.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return materialize(rooted.join(lows, "root").select("fp", "root", "component_id"), "groups")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                    limit: int = 3, **options) -> DataFrame:
    """``(id_col, fp, component_id)`` per row of ``docs``."""
    marked = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    return marked.join(classes_of(marked, id_col, limit, **options), "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, limit: int = 3,
             **options) -> DataFrame:
    """``docs`` with one row of every component, the one of the smallest id (ties: by a hash of the text;
    null ids last), all columns as they are."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("id", pa.int64()), ("fp", pa.int64())])

    def of(rows, data, offsets):
        return {"k1": rows.column(0), "k2": rows.column(1), "id": rows.column(2),
                "fp": block_fingerprints(data, offsets, width).view(np.int64)}

    marked = materialize(docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias(
        "_text")).mapInArrow(per_block(of, schema, "_text", BLOCK), "k1 long, k2 long, id long, fp long"), "fingerprints")
    groups = classes_of(marked, "id", limit, **options)
    stay = marked.join(groups, "fp").groupBy("root").agg(F.min(F.struct(
        F.col("id").isNull().alias("last"), "id", "k1", "k2")).alias("s")).select(
        F.col("s.k1").alias("_key1"), F.col("s.k2").alias("_key2"))
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"),
                       *(k.alias(f"_key{i}") for i, k in enumerate(row_key(id_col, text_col), 1)))
    kept = held.join(materialize(stay, "kept"), ["_key1", "_key2"], "left_semi").dropDuplicates(["_key1", "_key2"])
    return kept.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def hex_fingerprint(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
