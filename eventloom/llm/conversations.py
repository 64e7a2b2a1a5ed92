"""Repair of conversation structure: cheapest edits by Dial's bucket queue, audited by a walk over tight arcs.

What a conversation should look like is an automaton over its roles, `(s?(ua)+)?`; a row may be kept, given another role, or deleted,
and rows may be inserted before it. The nodes of the graph are (rows behind us, state of the automaton), the arcs are edits with
costs of at most 6, so shortest distances to the end come from a ring of buckets instead of a heap. The audit is the string of the
edits' initials; of all cheapest ones the ASCII-least is found by walking from the start along arcs that are tight (distance here =
cost + distance there), always the least letter. A letter leads to one node only, so the walk never has to turn back.

Conversations have no bound on their length, so no task holds one. Rows are range-sorted once over all conversations and cut into
blocks of at most BLOCK rows. A block gives the cheapest cost from each state at its start to each state at its end (a 4 x 4 matrix);
folding a conversation's matrices from the back gives the distances behind each block; with these each block walks from every state
that it may be entered in, and a fold from the front picks the walks that fit each other. Folds read their rows in order, one by
one, and keep a few numbers. The digest of a whole repaired conversation is the one thing that can't be made in parts: SHA-256 reads
its text in order, so the last fold streams it, block by block.

Rows: a null id, turn, role or text counts as one space where text is needed, and a null id is a conversation of its own; a
conversation's rows go by turn, nulls first, ties by role and then by the SHA-256 of the text; repeated rows are duplicates; an empty
role or one that begins with another letter than s, u, a can't be kept; a conversation whose rows are all dropped has zeros, an empty
audit and the digest of nothing; extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import hot_join, lean
from eventloom.session import discard, ship_package, staged

#: Rows of a block; bytes of repaired text that travel as one row.
BLOCK, PIECE = 256, 1 << 20
#: What the contract takes as white space, and what ends a sentence.
SPACE, STOPS = " \t\n\x0b\f\r", ".!?"
#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row. Role that comes next -> state.
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
#: What it costs to end in each state: a user row and an assistant row are missing after the system row, the latter after a user row.
END, CLOSING = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
FAR = 1 << 40
#: More than the largest arc plus the widest spread of distances between states (two insertions).
RING = 32


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, r) after the damage that crc32(`conv:turn`) % 20 names, conv as a string that tells null apart."""

    def spaced(c: str) -> Column:
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col))), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced(text_col), STOPS, "")).otherwise(spaced(text_col))
    return rows.where(kind != 0).select(
        _key(conv_col).alias("conv"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(spaced(role_col)).alias("role"),
        text.alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def _key(conv_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{conv_col}`").cast("string")), F.lit(""))


def ordered(rows: DataFrame) -> DataFrame:
    """rows (conv, turn, role, text) with their place: `pos` grows along each conversation, `block` is shared by at most BLOCK of its
    neighbouring rows. Range-sorted, so a long conversation is spread over tasks; the row number settles what is equal."""
    marked = staged(rows.select("conv", "turn", "role", "text", F.sha2("text", 256).alias("sha"), F.monotonically_increasing_id().alias("r")), "turns")
    by = ["conv", "turn", "role", "sha", "r"]
    placed = marked.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("pos", F.monotonically_increasing_id()).drop("r")
    out = staged(placed.withColumn("block", F.expr(f"pos div {BLOCK}")), "placed")
    discard(marked)
    return out


def with_faults(rows: DataFrame) -> DataFrame:
    """rows with `fault`: the first that applies of blank (b), duplicate (d) and truncated (t), else empty."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    own = F.when(F.length(bare) == 0, "b").when(~F.right(bare, F.lit(1)).isin(*STOPS), "t").otherwise("")
    again = rows.groupBy("conv", "role", "sha").agg(F.count("*").alias("n"), F.min("pos").alias("first")).where("n > 1")
    again = again.select(F.struct("conv", "role", "sha").alias("same"), "first")
    found = hot_join(rows.withColumn("same", F.struct("conv", "role", "sha")), again, "same", "left")
    return found.withColumn("fault", F.when(own == "b", "b").when(F.col("pos") > F.col("first"), "d").otherwise(own)).drop("same", "first", "sha")


def arcs(initial: str, fault: str):
    """(what keeping costs, what a new role costs), None where it can't be; a row may always be deleted."""
    if fault in ("b", "d"):
        return None, None
    more = TRUNCATED if fault == "t" else 0
    return (more if initial in ("s", "u", "a") else None), REROLE + more


def distances(rows: list[tuple[str, str]], behind) -> list[list[int]]:
    """For each row (initial, fault) and state before it, the cost of the cheapest edits to the end, and the list `behind` last.

    Dial's algorithm from the end to the start: a ring of buckets, one for each distance, emptied in turn.
    """
    m = len(rows)
    dist = [[FAR] * 4 for _ in range(m)] + [list(behind)]
    ring: list[list[tuple[int, int]]] = [[] for _ in range(RING)]
    at = min(behind)
    waiting = 0
    for s, d in enumerate(behind):
        if d < FAR:
            assert d - at < RING, "distances of states spread wider than edits allow"
            ring[d % RING].append((m, s))
            waiting += 1
    costs = [arcs(*r) for r in rows]

    while waiting:
        bucket = ring[at % RING]
        while bucket:
            i, t = bucket.pop()
            waiting -= 1
            if dist[i][t] != at:
                continue  # a shorter way was found later
            reached = []
            if i < m and t >= 2:  # insertions before row i
                reached += [(i, s, at + INSERT) for s in range(4) if NEXT[s][1] == t]
            if i:
                keep, rerole = costs[i - 1]
                reached.append((i - 1, t, at + DELETE))
                if keep is not None:
                    reached += [(i - 1, s, at + keep) for s in range(4) if KEEP[s].get(rows[i - 1][0]) == t]
                if rerole is not None and t >= 2:
                    reached += [(i - 1, s, at + rerole) for s in range(4) if NEXT[s][1] == t]
            for j, s, d in reached:
                if d < dist[j][s]:
                    dist[j][s] = d
                    ring[d % RING].append((j, s))
                    waiting += 1
        at += 1
    return dist


def walk(rows: list[tuple[str, str]], dist: list[list[int]], state: int) -> tuple[str, int]:
    """(the ASCII-least cheapest audit from a state, the state behind the last row): D, I, K, R in this order, along tight arcs."""
    out, i = [], 0
    while i < len(rows):
        here, (keep, rerole), initial = dist[i][state], arcs(*rows[i]), rows[i][0]
        if here == DELETE + dist[i + 1][state]:
            out.append("D")
            i += 1
        elif here == INSERT + dist[i][NEXT[state][1]]:
            out.append("I")
            state = NEXT[state][1]
        elif keep is not None and initial in KEEP[state] and here == keep + dist[i + 1][KEEP[state][initial]]:
            out.append("K")
            state, i = KEEP[state][initial], i + 1
        elif rerole is not None and here == rerole + dist[i + 1][NEXT[state][1]]:
            out.append("R")
            state, i = NEXT[state][1], i + 1
        else:
            raise AssertionError("no arc is tight")
    return "".join(out), state


def repaired(rows: list[tuple[str, str]], audit: str, state: int):
    """The repaired rows `role:text` of rows (role, text), by an audit that begins in a state."""
    left = iter(rows)
    for letter in audit:
        if letter == "I":
            role, state = NEXT[state]
            yield f"{role}:"
            continue
        role, text = next(left)
        if letter == "K":
            state = KEEP[state][role[:1]]
            yield f"{role}:{text}"
        elif letter == "R":
            role, state = NEXT[state]
            yield f"{role}:{text}"


def _runs(batches, *keys: str):
    """(key, rows as dictionaries) of neighbouring rows with equal keys, over all batches of a task, one run at a time."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = tuple(row[k] for k in keys)
            if own != key and held:
                yield key, held
                held = []
            key = own
            held.append(row)
    if held:
        yield key, held


def _rows(batches):
    for batch in batches:
        yield from batch.to_pylist()


def _emit(rows, schema: pa.Schema, size: int = 2048, most: int = 4 << 20):
    """Batches of at most `size` rows; one is closed early when its strings are long."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row.values() if isinstance(v, (str, bytes)))
        if len(held) == size or weight > most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_FACTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
_ENDS = ["first_initial", "last_initial", "first_turn", "last_turn"]


def _map(df: DataFrame, rows_of, fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    schema = pa.schema(fields)
    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>", pa.list_(pa.string()): "array<string>"}
    return df.mapInArrow(lean(lambda batches: _emit(rows_of(batches), schema)), ", ".join(f"{n} {names[t]}" for n, t in fields))


def _sorted(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """df with the rows of equal keys in one task, next to each other. Dealt by a hash of the keys: Spark leaves out a repartition by the
    very columns that a join below has dealt by, and may then split what it takes for skew in that join, and groups with it."""
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def _summaries(batches):
    """Of each block: its matrix of costs and what can be counted in it."""
    for (conv, block), held in _runs(batches, "conv", "block"):
        rows = [(r["initial"], r["fault"]) for r in held]
        columns = []
        for end in range(4):
            columns.append(distances(rows, [0 if s == end else FAR for s in range(4)])[0])
        turns = [r["turn"] for r in held if r["turn"] is not None]
        faults = [f for _, f in rows]
        yield {
            "conv": conv, "block": block, "costs": [columns[t][s] for s in range(4) for t in range(4)],
            "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
            "illegal": sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(rows, rows[1:])),
            "turns": len(set(turns)),
            "first_initial": rows[0][0], "last_initial": rows[-1][0],
            "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
        }


def _from_the_back(batches):
    """For each block of a conversation, last ones first: the distances behind it."""
    conv, behind = None, END
    for r in _rows(batches):
        if r["conv"] != conv:
            conv, behind = r["conv"], END
        costs = r["costs"]
        before = [min(min(costs[4 * s + t] + behind[t] for t in range(4)), FAR) for s in range(4)]
        yield {"conv": conv, "block": r["block"], "behind": list(behind), "before": before}
        behind = before


def _walks(batches):
    """Of each block: audit and last state for each state that it may be entered in."""
    for (conv, block), held in _runs(batches, "conv", "block"):
        rows, behind = [(r["initial"], r["fault"]) for r in held], held[0]["behind"]
        dist = distances(rows, behind)
        found = [walk(rows, dist, s) if dist[0][s] < FAR else ("", 0) for s in range(4)]
        yield {"conv": conv, "block": block, "audits": [a for a, _ in found], "exits": [e for _, e in found]}


def _from_the_front(batches):
    """For each block of a conversation in order: the state that it is entered in, its audit, and whether it is the first."""
    conv, state, first = None, 0, True
    for r in _rows(batches):
        first = r["conv"] != conv
        if first:
            conv, state = r["conv"], 0
        yield {"conv": conv, "block": r["block"], "state": state, "audit": r["audits"][state], "first": int(first), "exit": r["exits"][state]}
        state = r["exits"][state]


def _pieces(batches):
    """The repaired text of each block, in pieces of bounded size, each row ended by a line feed."""
    for (conv, block), held in _runs(batches, "conv", "block"):
        part, out, size = 0, [], 0
        for line in repaired([(r["role"], r["text"]) for r in held], held[0]["audit"], held[0]["state"]):
            out.append(line.encode())
            size += len(out[-1])
            if size > PIECE:
                yield {"conv": conv, "block": block, "part": part, "body": b"".join(x + b"\n" for x in out)}
                part, out, size = part + 1, [], 0
        yield {"conv": conv, "block": block, "part": part, "body": b"".join(x + b"\n" for x in out)}


def _whole(batches):
    """A row for each conversation from its blocks' audits, counts and repaired text, streamed in order."""
    out, digest, audit, pending, last, exit_state = None, None, [], b"", {}, 0

    def closed():
        # insertions at the very end; the last line feed is not part of the text
        tail, state = pending, exit_state
        for _ in CLOSING[state]:
            role, state = NEXT[state]
            tail += f"{role}:\n".encode()
        digest.update(tail[:-1])
        gaps = out.pop("top") - out.pop("bottom") + 1 - out["turns"] if out["turns"] else 0
        out.pop("turns")
        return out | {"gaps": gaps, "audit": "".join(audit) + CLOSING[exit_state], "repaired_sha256": digest.hexdigest()}

    for r in _rows(batches):
        if out is None or r["conv"] != out["conv"]:
            if out is not None:
                yield closed()
            out = {"conv": r["conv"], "cost": r["before"][0], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "bottom": None, "top": None}
            digest, audit, pending, last = hashlib.sha256(), [], b"", {}
        if r["part"] == 0:
            for k in _FACTS:
                out[k] += r[k]
            if last:
                out["illegal"] += last["last_initial"] + r["first_initial"] not in ("su", "ua", "au")
                out["turns"] -= r["first_turn"] is not None and last["last_turn"] == r["first_turn"]
            if r["first_turn"] is not None:
                out["bottom"] = r["first_turn"] if out["bottom"] is None else out["bottom"]
                out["top"] = r["last_turn"]
            audit.append(r["audit"])
            last, exit_state = r, r["exit"]
        if r["body"]:  # the last line feed may have to go, so one piece waits
            digest.update(pending)
            pending = r["body"]
    if out is not None:
        yield closed()


_KEY = [("conv", pa.string()), ("block", pa.int64())]
_NUMBERS = pa.list_(pa.int64())


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage=damaged) -> DataFrame:
    """A row for each conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    damage: (rows, conv, turn, role, text columns) -> (conv, turn, role, text), what is done to the rows before.
    """
    ship_package(conversations.sparkSession)
    placed = ordered(damage(conversations, conv_col, turn_col, role_col, text_col))
    faulty = staged(with_faults(placed).withColumn("initial", F.left("role", F.lit(1))), "faults")
    discard(placed)
    key = ["conv", "block"]
    marks = faulty.select("conv", "block", "pos", "turn", "initial", "fault")
    kinds = [("costs", _NUMBERS), *[(k, pa.int64()) for k in _FACTS], ("first_initial", pa.string()), ("last_initial", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64())]
    blocks = staged(_map(_sorted(marks, key, "pos"), _summaries, [*_KEY, *kinds]), "blocks")
    behind = staged(_map(_sorted(blocks.select("conv", "block", "costs"), ["conv"], F.desc("block")), _from_the_back, [*_KEY, ("behind", _NUMBERS), ("before", _NUMBERS)]), "behind")
    waiting = marks.select("conv", "block", "pos", "initial", "fault").join(behind.select("conv", "block", "behind").hint("merge"), key)
    walks = _map(_sorted(waiting, key, "pos"), _walks, [*_KEY, ("audits", pa.list_(pa.string())), ("exits", _NUMBERS)])
    chosen = staged(_map(_sorted(walks, ["conv"], "block"), _from_the_front, [*_KEY, ("state", pa.int64()), ("audit", pa.string()), ("first", pa.int64()), ("exit", pa.int64())]), "chosen")
    lines = faulty.select("conv", "block", "pos", "role", "text").join(chosen.select("conv", "block", "state", "audit").hint("merge"), key)
    pieces = _map(_sorted(lines, key, "pos"), _pieces, [*_KEY, ("part", pa.int64()), ("body", pa.binary())])
    facts = blocks.drop("costs").join(behind.select("conv", "block", "before").hint("merge"), key).join(chosen.select("conv", "block", "audit", "exit").hint("merge"), key)
    texts = [("audit", pa.string()), ("repaired_sha256", pa.string())]
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    whole = _map(_sorted(pieces.join(facts.hint("merge"), key), ["conv"], "block", "part"), _whole, [("conv", pa.string()), *[(n, pa.int64()) for n in numbers], *texts])
    names = conversations.select(F.col(f"`{conv_col}`").alias("id"), _key(conv_col).alias("conv")).distinct()
    empty = hashlib.sha256().hexdigest()
    return names.join(whole.hint("merge"), "conv", "left").select(
        F.col("id").alias(conv_col),
        *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
