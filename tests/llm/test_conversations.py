"""Conversation repair against a plain dynamic program over (cost, audit)."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from eventloom.llm import conversations
from eventloom.session import table

NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        own = out[conv]
        conv, turn_text, role, text = (" " if v is None else v for v in (conv, turn, role, text))
        kind = zlib.crc32(f"{conv}:{turn_text}".encode()) % 20
        text = {1: "", 2: "".join(c for c in text if c not in ".!?")}.get(kind, text)
        own += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """Least (cost, audit, repaired rows) by trying every edit of every row in every state, from the end."""
    behind = {0: (0, "", ()), 3: (0, "", ()), 2: (5, "I", ("assistant:",)), 1: (10, "II", ("user:", "assistant:"))}

    def on(cost, letter, line, rest):
        return cost + rest[0], letter + rest[1], line + rest[2]

    for (_, role, text), mark in zip(rows[::-1], marks[::-1]):
        more, here = 5 * (mark == "t"), {}

        def edit(s):
            found = [on(2, "D", (), behind[s])]
            if mark not in ("b", "d"):
                if role[:1] == NEXT[s][0][0]:
                    found.append(on(more, "K", (f"{role}:{text}",), behind[NEXT[s][1]]))
                if s == 0 and role[:1] == "s":
                    found.append(on(more, "K", (f"{role}:{text}",), behind[1]))
                found.append(on(1 + more, "R", (f"{NEXT[s][0]}:{text}",), behind[NEXT[s][1]]))
            return min(found)

        for s in range(4):
            found, state, cost, letters, lines = [edit(s)], s, 0, "", ()
            for _ in range(4):
                lines += (NEXT[state][0] + ":",)
                state, cost, letters = NEXT[state][1], cost + 5, letters + "I"
                found.append(on(cost, letters, lines, edit(state)))
            here[s] = min(found)
        behind = here
    return behind[0]


def plain(rows):
    out = []
    for conv, own in damage(rows).items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        marks, turns = faults(own), [t for t, *_ in own if t is not None]
        first = [r[:1] for _, r, _ in own]
        cost, audit, lines = cheapest(own, marks)
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, marks.count("b"), marks.count("d"), marks.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def run(df):
    return sorted([tuple(r) for r in conversations.repair(df).collect()], key=str)


def test_given_table(spark, sf_dir):
    df = table(spark, sf_dir, "conversations")
    assert run(df) == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def hard_rows(seed, n):
    rnd = random.Random(seed)
    convs = [None, *range(9), *[100] * 8]
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant", "Admin", "agent"]
    said = ["Hello.", "hi", "what? ", "", "  ", None, "a!", "b.", "c", "d. e", "x" * 30_000 + ".", "é?\n", ".", "\x85"]
    return [(rnd.choice(convs), rnd.choice([None, *range(rnd.choice([4, 60]))]), rnd.choice(roles), rnd.choice(said)) for _ in range(n)]


@pytest.mark.parametrize("block", [1, 5, 256])
def test_hard_rows_in_blocks_of_any_size(spark, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    monkeypatch.setattr(conversations, "PIECE", 64)
    rows = hard_rows(block, 500)
    df = spark.createDataFrame([(*r, 1, 2, "f") for r in rows], "conv_id long, turn long, role string, text string, pos int, block int, fault string").repartition(3)
    assert run(df) == plain(rows)


def test_one_conversation_with_all_rows(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 16)
    rnd = random.Random(3)
    rows = [(1, t, rnd.choice(["user", "assistant"]), rnd.choice([f"Say {t}.", "again.", "cut"])) for t in range(2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    assert run(df) == plain(rows)


def test_repeated_rows(spark):
    rows = [(1, 1, "user", "Same.")] * 50 + [(2, None, "user", "Same.")] * 3
    assert run(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")) == plain(rows)


def test_dial_against_relaxation():
    """Distances of single blocks equal those of plain relaxation until nothing changes."""
    rnd = random.Random(11)
    for _ in range(200):
        rows = [(rnd.choice(["s", "u", "a", "t", ""]), rnd.choice(["", "", "b", "d", "t"])) for _ in range(rnd.randrange(1, 9))]
        behind = list(conversations.END) if rnd.random() < 0.5 else [0 if s == rnd.randrange(4) else conversations.FAR for s in range(4)]
        if min(behind) == conversations.FAR:
            continue
        got = conversations.distances(rows, behind)
        want = [[conversations.FAR] * 4 for _ in rows] + [behind]
        for i in range(len(rows) - 1, -1, -1):
            keep, rerole = conversations.arcs(*rows[i])
            for s in range(4):
                ways = [2 + want[i + 1][s]]
                if keep is not None and rows[i][0] in conversations.KEEP[s]:
                    ways.append(keep + want[i + 1][conversations.KEEP[s][rows[i][0]]])
                if rerole is not None:
                    ways.append(rerole + want[i + 1][conversations.NEXT[s][1]])
                want[i][s] = min(ways)
            for _ in range(4):
                want[i] = [min(want[i][s], 5 + want[i][conversations.NEXT[s][1]]) for s in range(4)]
        assert [[min(x, conversations.FAR) for x in r] for r in want] == got


def test_dropped_whole_and_empty(spark):
    conv = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = conversations.repair(spark.createDataFrame([(conv, 0, "user", "Gone.")], "conv_id long, turn long, role string, text string")).collect()
    assert tuple(row) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert conversations.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
