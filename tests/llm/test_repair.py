"""Conversation repair against enumeration of edits, and its two paths against each other."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

from conftest import ordered

from reportloom.llm import repair

FINE = re.compile("(s?(ua)+)?")
GAPS = ["", "u", "a", "uu", "ua", "au", "aa"]


def _enumerated(letters, forced, cut):
    """Least (cost, audit, roles) over every choice of edits with at most two insertions in a gap."""
    best = None
    rows = [[("D", "", 2)] + ([] if f else [("K", x, 5 * c), ("R", "u", 1 + 5 * c), ("R", "a", 1 + 5 * c)])
            for x, f, c in zip(letters, forced, cut)]
    for edits in itertools.product(*rows):
        for gaps in itertools.product(GAPS, repeat=len(letters) + 1):
            roles = gaps[0] + "".join(e[1] + g for e, g in zip(edits, gaps[1:]))
            if FINE.fullmatch(roles):
                audit = "I" * len(gaps[0]) + "".join(e[0] + "I" * len(g) for e, g in zip(edits, gaps[1:]))
                best = min(best or (1 << 30, ""), (sum(e[2] for e in edits) + 5 * sum(map(len, gaps)), audit))
    return best


def test_search_is_optimal():
    rng = random.Random(2)
    for n in (0, 1, 2, 2, 2, 2, 3, 3):
        for _ in range(6):
            rows = [(rng.choice("suatx"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]
            letters, forced, cut = ([r[k] for r in rows] for k in range(3))
            assert repair.search(letters, forced, cut) == _enumerated(letters, forced, cut)


def _layered(letters, forced, cut):
    """The same by keeping the least (cost, audit) of every last role, row by row."""
    def grown(states):
        for _ in range(2):
            for q, (c, a) in list(states.items()):
                t = "u" if q != "u" else "a"
                states[t] = min(states.get(t, (1 << 30, "")), (c + 5, a + "I"))
        return states
    now = grown({"": (0, "")})
    for x, f, t in zip(letters, forced, cut):
        after = {}

        def put(q, c, a):
            after[q] = min(after.get(q, (1 << 30, "")), (c, a))
        for q, (c, a) in now.items():
            put(q, c + 2, a + "D")
            if not f:
                want = "a" if q == "u" else "u"
                put(want, c + 1 + 5 * t, a + "R")
                if x == want or x == "s" and q == "":
                    put(x, c + 5 * t, a + "K")
        now = grown(after)
    return min(now.get(q, (1 << 30, "")) for q in ("", "a"))


def test_search_on_long_runs():
    rng = random.Random(4)
    for n in (40, 400, 3000):
        for share in (0.05, 0.5):
            rows = [(rng.choice("uuaas") if rng.random() < share else "ua"[i % 2], rng.random() < 0.1, rng.random() < 0.2) for i in range(n)]
            args = [[r[k] for r in rows] for k in range(3)]
            assert repair.search(*args) == _layered(*args)


def _plain(rows):
    """Damage and repair in plain Python; rows are (conv_id, turn, role, text)."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        own, role, text = held[conv], " " if role is None else role, " " if text is None else text
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(case, text)
        own.extend([(turn, "user" if case == 4 else role, text)] * {0: 0, 3: 2}.get(case, 1))
    out = []
    for conv, own in held.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        turns = {r[0] for r in own if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, fault = set(), []
        for _, role, text in own:
            chars = re.findall(r"[^\x20\x09-\x0D]", text)
            fault.append("blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else "")
            seen.add((role, text))
        letters = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
        cost, audit = _layered(letters, [f in ("blank", "duplicate") for f in fault], [f == "truncated" for f in fault])
        fixed, last, rest = [], "", iter(own)
        for edit in audit:
            row = next(rest) if edit != "I" else None
            if edit == "D":
                continue
            role = row[1] if edit == "K" else "assistant" if last == "u" else "user"
            fixed.append(f"{role}:{row[2] if row else ''}")
            last = role[:1]
        assert FINE.fullmatch("".join(x[0] for x in fixed))
        out.append((conv, gaps, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"), illegal, cost, audit,
                    hashlib.sha256("\n".join(fixed).encode()).hexdigest()))
    return out


SCHEMA = "conv_id long, turn long, role string, text string, key string, place long, cut boolean"


def _rows():
    rng = random.Random(8)
    texts = ["Yes.", "No!", "", " \t", None, "and then", "Why? ", "fine. ", "é.\n", "x" * 200_000 + ".", "Yes.", "ok."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "agent"]

    def row(conv, turn):
        return conv, turn, rng.choice(roles[:5] if rng.random() < 0.8 else roles), rng.choice(texts[:9] + texts[10:]), "k", 1, True
    rows = [row(c, t) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [row(None, t) for t in range(5)] + [row(70, None) for _ in range(4)] + [row(71, rng.randint(0, 3)) for _ in range(12)]
    rows += [(72, 0, "user", texts[9], "k", 1, True), (72, 1, "assistant", "Yes.", "k", 1, True)] + rows[10:14] * 2
    # one conversation with most of the rows, with tied turns, null turns and one row a hundred times
    rows += [row(99, t // 2) for t in range(1500)] + [row(99, None) for _ in range(5)] + [(99, 4, "user", "Again.", "k", 1, True)] * 100
    rng.shuffle(rows)
    return rows


def test_repair(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = ordered(_plain([r[:4] for r in rows]))
    assert ordered(tuple(r) for r in repair.repaired(df).collect()) == want
    # every conversation above a few rows or bytes goes the way of the long ones, in segments of three rows
    assert ordered(tuple(r) for r in repair.repaired(df, rows=7, most_bytes=1000, cut=3).collect()) == want
    assert repair.repaired(df.limit(0)).count() == 0
