"""Repair of conversation structure by depth-first branch and bound.

A conversation's rows, in order of turn, are edited at least cost until the first letters of its
roles read ``(s?(ua)+)?``: Keep 0, Rerole to user or assistant 1, Delete 2 (the only edit
for blank rows and duplicates), Insert an empty user or assistant row 5; a truncated row that stays costs 5
more. The audit is the first letters of the edits in order; of the cheapest audits the least counts.

*Search.* A node is (rows read, last role): ``START``, ``SYSTEM``, ``USER`` or ``ASSISTANT``. What
may come next is the same whatever came before, and the role of an inserted or reroled row follows from
the node, so a letter names at most one edge of a node. An explicit stack holds prefixes; edges are pushed so
that they leave it in the order of their letters, hence prefixes are visited in the order of their audits.

* Suffix bounds: the least cost from every node to a goal, computed backwards row by row without
  audits. A prefix whose cost and bound exceed the limit is cut; the first limit is the bound of
  the root, afterwards the incumbent's cost.
* Dominance: a node keeps the cost of the best prefix seen there. A later prefix of the same or a higher cost
  has a greater audit as well and is eliminated. (Equal costs at one node mean equally many
  insertions, so no audit there is the beginning of another, and what follows cannot change the order.)
* Incumbent: (cost, audit) of the best complete path; a later one must be cheaper. When the stack is
  empty, it is proved best.

The bounds leave no dead ends, so a conversation of n rows takes 4 n node visits at most.

*At scale.* Conversations of at most ``rows`` rows and ``most_bytes`` of text are sorted by
conversation and turn and solved as they stream by; texts move once. A longer one (one may hold a third of all rows) is
cut into segments of ``cut`` rows by place (range partitions and counts, ``ranking``). A segment's
result is the best (cost, audit) from every entering role to every leaving one; these join
associatively, 64 segments at a time. Duplicates are found by a grouped first place. Only the digest of
the repaired text is sequential by nature: segments of text stream through one task for a conversation,
one at a time.

Cases: a null turn, role or text is one space where it is hashed or read, and null turns come first. Rows that tie in turn
are ordered by role, then by MD5 of the text; rows equal in all are interchangeable. A role with another first
letter, or none, cannot be kept. Null is a conversation of its own. Every original conversation
has a row, with zeros, an empty audit and the digest of nothing when no row is left. An empty table
gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.llm.ranking import numbered
from reportloom.plans.store import discard, materialize

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: role kept as it is: (first letter, state before) -> state after
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
GOALS = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 60
BLANKS = " \t\n\x0b\x0c\r"
CASES, DROP, EMPTY, UNMARK, REPEAT, AS_USER = 20, 0, 1, 2, 3, 4


# --- search ---------------------------------------------------------------------------

def _with_inserts(costs: list[int]) -> list[int]:
    """Costs to a goal, when rows may be inserted first; two are enough, a third returns to a role."""
    once = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
    return [min(c, INSERT + once[NEXT[q]]) for q, c in enumerate(once)]


def bounds(letters: list[str], forced: list[bool], cut: list[bool], goals) -> list[list[int]]:
    """``bounds[i][q]``: least cost from role ``q`` with row ``i`` next to a goal."""
    after = _with_inserts([0 if q in goals else NEVER for q in STATES])
    out = [after]
    for letter, must_go, truncated in zip(reversed(letters), reversed(forced), reversed(cut)):
        costs = [DELETE + after[q] for q in STATES]
        if not must_go:
            extra = TRUNCATED if truncated else 0
            for q in STATES:
                costs[q] = min(costs[q], extra + REROLE + after[NEXT[q]])
                if (to := KEPT.get((letter, q))) is not None:
                    costs[q] = min(costs[q], extra + after[to])
        after = _with_inserts(costs)
        out.append(after)
    out.reverse()
    return out


def search(letters: list[str], forced: list[bool], cut: list[bool], entry: int = START, goals=GOALS) -> tuple[int, str] | None:
    """Least (cost, audit) from ``entry`` to one of ``goals`` over all rows, or None where there is no way."""
    n, least = len(letters), bounds(letters, forced, cut, goals)
    limit = least[0][entry]
    if limit >= NEVER:
        return None
    incumbent: tuple[int, str] | None = None
    seen: dict[tuple[int, int], int] = {}
    path: list[str] = []
    stack = [(0, entry, 0, 0, "")]
    while stack:
        i, q, cost, depth, letter = stack.pop()
        if cost + least[i][q] > limit or seen.get((i, q), NEVER) <= cost:
            continue
        if incumbent is not None and cost + least[i][q] >= incumbent[0]:
            continue
        seen[i, q] = cost
        del path[depth:]
        if depth:
            path[depth - 1:] = [letter]
        if i == n and q in goals:
            incumbent = cost, "".join(path)
            limit = cost
        edges = [("I", i, NEXT[q], INSERT)]
        if i < n:
            edges.insert(0, ("D", i + 1, q, DELETE))
            if not forced[i]:
                extra = TRUNCATED if cut[i] else 0
                if (to := KEPT.get((letters[i], q))) is not None:
                    edges.append(("K", i + 1, to, extra))
                edges.append(("R", i + 1, NEXT[q], extra + REROLE))
        for letter, j, to, more in reversed(edges):
            stack.append((j, to, cost + more, depth + 1, letter))
    return incumbent


def replay(audit: str, roles: list[str], texts: list[str], entry: int = START) -> list[str]:
    """Repaired ``role:text`` rows of an audit."""
    out, at, q = [], 0, entry
    for edit in audit:
        if edit == "K":
            q = KEPT[roles[at][:1], q]
            out.append(f"{roles[at]}:{texts[at]}")
        elif edit != "D":
            q = NEXT[q]
            out.append(f"{NAMES[q]}:{texts[at] if edit == 'R' else ''}")
        at += edit != "I"
    return out


# --- counts ---------------------------------------------------------------------------

COUNTS = ["n", "head", "tail", "illegal", "low", "high", "turns", "blank", "duplicate", "truncated"]
COUNT_TYPES = ("n long, head string, tail string, illegal long, low long, high long, turns long, "
               "blank long, duplicate long, truncated long")


def count(turns: list, letters: list[str], blank: list[bool], duplicate: list[bool], cut: list[bool]) -> dict:
    """Counts of a run of rows; ``joined`` adds those of the run behind it. A row's first fault counts."""
    known = [t for t in turns if t is not None]
    return dict(n=len(letters), head=letters[0], tail=letters[-1],
                illegal=sum(a + b not in LEGAL for a, b in zip(letters, letters[1:])),
                low=known[0] if known else None, high=known[-1] if known else None, turns=len(set(known)),
                blank=sum(blank), duplicate=sum(d and not b for b, d in zip(blank, duplicate)),
                truncated=sum(c and not (b or d) for b, d, c in zip(blank, duplicate, cut)))


def joined(a: dict, b: dict) -> dict:
    out = {k: a[k] + b[k] for k in ("n", "illegal", "turns", "blank", "duplicate", "truncated")}
    out["illegal"] += a["tail"] + b["head"] not in LEGAL
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    return out | dict(head=a["head"], tail=b["tail"], low=b["low"] if a["low"] is None else a["low"],
                      high=a["high"] if b["high"] is None else b["high"])


def _gaps(c: dict) -> int:
    return 0 if c["low"] is None else c["high"] - c["low"] + 1 - c["turns"]


# --- damage and faults ------------------------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """Rows after damage: ``key, turn, role, text, mark, gone, blank, cut``.

    ``key`` is ``n`` for null, else ``v`` and the id. Dropped rows stay, marked ``gone`` and without a text,
    so that their conversation is not lost.
    """
    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % CASES
    text = F.when(F.col("case") == DROP, F.lit(None)).when(F.col("case") == EMPTY, F.lit("")).when(
        F.col("case") == UNMARK, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = conversations.select(
        F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string"))).alias("key"),
        F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), case.alias("case"))
    rows = rows.select("key", "turn", F.when(F.col("case") == AS_USER, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), "case")
    rows = rows.withColumn("copy", F.explode(F.when(F.col("case") == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))))).drop("copy")
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    return rows.select("key", "turn", "role", "text", F.unhex(F.md5("text")).alias("mark"), (F.col("case") == DROP).alias("gone"),
                       F.coalesce(last == "", F.lit(False)).alias("blank"), F.coalesce(~last.isin("", ".", "!", "?"), F.lit(False)).alias("cut"))


ORDER = ["turn", "role", "mark"]


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("mark")]


def _digest(rows: list[str]) -> str:
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()


RESULT = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RESULT_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _solved(key: str, turns: list, roles: list[str], texts: list[str], marks: list, blank: list[bool], cut: list[bool]) -> tuple:
    if not roles:
        return key, 0, 0, 0, 0, 0, 0, "", _digest([])
    seen: set = set()
    duplicate = []
    for pair in zip(roles, marks):
        duplicate.append(pair in seen)
        seen.add(pair)
    letters = [r[:1] for r in roles]
    forced = [b or d for b, d in zip(blank, duplicate)]
    cost, audit = search(letters, forced, cut)
    c = count(turns, letters, blank, duplicate, cut)
    return (key, _gaps(c), c["blank"], c["duplicate"], c["truncated"], c["illegal"], cost, audit,
            _digest(replay(audit, roles, texts)))


def _stream(batches):
    """Solve conversations that arrive sorted by key and turn, each as soon as its last row is in."""
    names = ["turn", "role", "text", "mark", "blank", "cut"]
    key, held, done = None, [[] for _ in names], []
    for batch in batches:
        keys = batch.column("key").to_pylist()
        gone = batch.column("gone").to_pylist()
        columns = [batch.column(c).to_pylist() for c in names]
        for i, k in enumerate(keys):
            if k != key:
                if key is not None:
                    done.append(_solved(key, *held))
                key, held = k, [[] for _ in names]
            if not gone[i]:
                for to, values in zip(held, columns):
                    to.append(values[i])
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], _RESULT_NAMES)
            done = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in _solved(key, *held)], _RESULT_NAMES)


# --- long conversations -------------------------------------------------------------------

SEGMENT = f"key string, seg long, {COUNT_TYPES}, paths array<struct<entry int, exit int, cost long, audit string>>"
_SEGMENT_NAMES = ["key", "seg", *COUNTS, "paths"]
_PATHS = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _segment_table(key: str, seg: int, counts: dict, paths: dict) -> pa.Table:
    listed = [dict(entry=p, exit=q, cost=c, audit=a) for (p, q), (c, a) in sorted(paths.items())]
    kinds = {"head": pa.string(), "tail": pa.string()}
    return pa.table([pa.array([key]), pa.array([seg], pa.int64()), *(pa.array([counts[c]], kinds.get(c, pa.int64())) for c in COUNTS),
                     pa.array([listed], _PATHS)], names=_SEGMENT_NAMES)


def _segment(table: pa.Table) -> pa.Table:
    table = table.sort_by("place")
    turns, letters, blank, duplicate, cut = (table.column(c).to_pylist() for c in ("turn", "letter", "blank", "duplicate", "cut"))
    forced = [b or d for b, d in zip(blank, duplicate)]
    paths = {(p, q): found for p in STATES for q in STATES if (found := search(letters, forced, cut, p, (q,))) is not None}
    return _segment_table(table.column("key")[0].as_py(), table.column("seg")[0].as_py(),
                          count(turns, letters, blank, duplicate, cut), paths)


def _chain(table: pa.Table) -> pa.Table:
    rows = table.sort_by("seg").to_pylist()
    counts, paths = None, None
    for r in rows:
        own = {(p["entry"], p["exit"]): (p["cost"], p["audit"]) for p in r["paths"]}
        if counts is None:
            counts, paths = {c: r[c] for c in COUNTS}, own
            continue
        counts, before, paths = joined(counts, r), paths, {}
        for (p, mid), (cost, audit) in before.items():
            for q in STATES:
                if (mid, q) in own:
                    more, behind = own[mid, q]
                    best = cost + more, audit + behind
                    paths[p, q] = min(paths.get((p, q), best), best)
    return _segment_table(rows[0]["key"], rows[0]["up"], counts, paths)


def _pieces(cut_rows: int):
    """Cut each conversation's audit into its segments' parts, with the role before each."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                parts = re.findall(f"(?:I*[DKR]){{1,{cut_rows}}}", row["audit"])
                parts[-1] += row["audit"][sum(map(len, parts)):]
                emitted = len(row["audit"].replace("D", ""))
                system, entries, n = emitted % 2, [], 0  # user and assistant come in pairs
                for part in parts:
                    behind = n - system
                    entries.append(START if n == 0 else SYSTEM if behind == 0 else USER if behind % 2 else ASSISTANT)
                    n += len(part.replace("D", ""))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["key"]] * len(parts)), pa.array(range(len(parts)), pa.int64()), pa.array(parts),
                     pa.array(entries, pa.int32())], ["key", "seg", "part", "entry"])
    return run


def _body(rows: pa.Table, part: pa.Table) -> pa.Table:
    rows = rows.sort_by("place")
    out = replay(part.column("part")[0].as_py(), rows.column("role").to_pylist(), rows.column("text").to_pylist(),
                 part.column("entry")[0].as_py())
    return pa.table([rows.column("key").combine_chunks()[:1], rows.column("seg").combine_chunks()[:1],
                     pa.array(["\n".join(out) if out else None], pa.string())], names=["key", "seg", "body"])


def _hashes(batches):
    """Digest of each key's bodies, which arrive in order; one batch is held at a time."""
    key, running, empty = None, None, True
    for batch in batches:
        for k, body in zip(batch.column("key").to_pylist(), batch.column("body").to_pylist()):
            if k != key:
                if key is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([running.hexdigest()])], ["key", "repaired_sha256"])
                key, running, empty = k, hashlib.sha256(), True
            if body is not None:
                running.update(body.encode() if empty else b"\n" + body.encode())
                empty = False
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([running.hexdigest()])], ["key", "repaired_sha256"])


def _repaired_long(rows: DataFrame, keys: DataFrame, cut: int) -> DataFrame:
    left = materialize(rows.join(keys, "key", "left_semi").filter(~F.col("gone")).drop("gone"), "long-rows")
    placed = materialize(numbered(left, ["key"], _order(), "long-order").withColumn("seg", F.expr(f"place div {cut}")), "long-placed")
    same = ["key", "role", "mark"]
    firsts = placed.groupBy(*same).agg(F.min("place").alias("first"))
    light = placed.drop("text").join(firsts, same).select(
        "key", "seg", "place", "turn", F.left("role", F.lit(1)).alias("letter"), "blank", "cut",
        (F.col("place") > F.col("first")).alias("duplicate"))
    now = materialize(light.groupBy("key", "seg").applyInArrow(_segment, SEGMENT), "long-segments")
    while now.groupBy("key").count().filter("count > 1").limit(1).count():
        up = now.withColumn("up", F.expr("seg div 64"))
        above = materialize(up.groupBy("key", "up").applyInArrow(_chain, SEGMENT), "long-segments")
        discard(now)
        now = above
    # the cheapest audit that ends where a conversation may end; the least of them
    ways = F.filter("paths", lambda p: (p["entry"] == START) & p["exit"].isin(*GOALS))
    best = F.array_min(F.transform(ways, lambda p: F.struct(p["cost"].alias("cost"), p["audit"].alias("audit"))))
    final = materialize(now.withColumn("best", best).select(*_SEGMENT_NAMES[:-1], "best.cost", "best.audit"), "long-repairs")
    parts = final.select("key", "audit").mapInArrow(_pieces(cut), "key string, seg long, part string, entry int")
    bodies = placed.select("key", "seg", "place", "role", "text").groupBy("key", "seg").cogroup(
        parts.groupBy("key", "seg")).applyInArrow(_body, "key string, seg long, body string")
    digests = bodies.repartition("key").sortWithinPartitions("key", "seg").mapInArrow(_hashes, "key string, repaired_sha256 string")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    found = keys.join(final.join(digests, "key"), "key", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in (
        ("gaps", gaps), *((n, F.col(n)) for n in ("blank", "duplicate", "truncated", "illegal", "cost")))]
    return found.select("key", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.lit(_digest([]))).alias("repaired_sha256"))


def repaired(conversations: DataFrame, rows: int = 4096, most_bytes: int = 16 << 20, cut: int = 512) -> DataFrame:
    """Damage ``conversations(conv_id, turn, role, text)`` and repair every conversation.

    Per conversation: ``conv_id``, ``gaps``, counts of rows ``blank``, ``duplicate``, ``truncated``, of ``illegal``
    neighbours, ``cost``, ``audit`` and ``repaired_sha256``.
    """
    damaged = damage(conversations)
    sizes = conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = materialize(sizes.filter((F.col("n") > rows) | (F.col("bytes") > most_bytes)).select(
        F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string"))).alias("key")), "long-keys")
    some = not long.isEmpty()
    short = damaged.join(long, "key", "left_anti") if some else damaged
    found = short.repartition("key").sortWithinPartitions("key", *_order()).mapInArrow(_stream, RESULT)
    if some:
        found = found.unionByName(_repaired_long(damaged, long, cut))
    kind = conversations.schema["conv_id"].dataType
    conv = F.when(F.col("key") == "n", F.lit(None)).otherwise(F.substring("key", 2, 1 << 30)).cast(kind)
    return found.select(conv.alias("conv_id"), *_RESULT_NAMES[1:])
