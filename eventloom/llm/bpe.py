"""Byte-level BPE as a streaming transducer with bounded lookahead, and its incremental decoder.

A text is read left to right. For every position of a piece the transducer knows the one token that ends the
encoding of what has been read so far; it follows from the token before it, because a sequence of tokens is the
encoding of its bytes exactly when every two neighbours are compatible (the merges never join across them).
The next token can begin no further back than the longest token is long: that many positions are the lookahead. A
token is emitted as soon as every position in that span traces back through it.

Why memory does not grow with the text: how far the encodings of two prefixes can differ is bounded by the merge list
alone (Berglund and van der Merwe, "Formalizing BPE Tokenization", 2023: every merge list has a finite sufficient
lookahead). All that is held are the positions of the span and of their paths back to where they meet. The tests
search for texts that keep the paths apart for long, among repetitions of the vocabulary's own tokens; `Transducer.most`
is the number of positions held at most.

Rows: null texts are empty and have no tokens; repeated rows and ids stay; extra columns are dropped; an empty
table gives an empty result; special tokens standing in a text become their ids, as the tokenizer library has it.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import struct

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from eventloom.llm.common import ROW, lean, remembered, with_rows

#: Fixed value: how byte-level vocabularies cut a text into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of up to SHORT bytes are encoded at once and remembered, KEPT_BYTES of them and their ids at most; so many pairs.
SHORT, KEPT_BYTES, KEPT_PAIRS = 40, 6 << 20, 1 << 17


def printable_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, by rule: a visible Latin-1
    character stands for itself, the others follow from U+0100 on in order."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """A vocabulary with its merge list, indexed for the transducer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, table = whole["model"], printable_bytes()
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        size = 1 + max([*model["vocab"].values(), *self.special.values()])
        spelt = {t: bytes(map(table.__getitem__, t)) for t in model["vocab"] if t not in self.special}
        self.bytes_of: list[bytes] = [b""] * size
        for t, b in spelt.items():
            self.bytes_of[model["vocab"][t]] = b
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        #: pair of tokens -> rank of their merge; token -> left, right and rank of the merge that makes it, -1 for bytes
        self.rank: dict[int, int] = {}
        self.left, self.right, self.made_at = [-1] * size, [-1] * size, [-1] * size
        vocab = model["vocab"]
        for rank, pair in enumerate(model["merges"]):
            x, y = pair.split(" ") if isinstance(pair, str) else pair
            a, b, made = vocab[x], vocab[y], vocab[x + y]
            self.rank.setdefault(a << 20 | b, rank)
            if self.made_at[made] < 0:
                self.left[made], self.right[made], self.made_at[made] = a, b, rank
        self.pairs: dict[int, bool] = {}
        own: dict[int, bool] = {}
        for t in sorted(range(size), key=self.made_at.__getitem__):  # halves come before what is made of them
            if self.made_at[t] < 0:
                own[t] = len(self.bytes_of[t]) == 1
            else:
                a, b, rank = self.left[t], self.right[t], self.made_at[t]
                own[t] = own[a] and own[b] and self.rank[a << 20 | b] == rank and self._apart(a, b, skip_first=True)
        self.token_of = {self.bytes_of[t]: t for t, r in own.items() if r}
        self.size = [len(b) for b in self.bytes_of]
        self.lookahead = max(map(len, self.token_of))
        #: token -> the longest token that it begins with, -1 for single bytes
        self.shorter = [-1] * size
        for spelling, t in self.token_of.items():
            self.shorter[t] = next((self.token_of[spelling[:k]] for k in range(len(spelling) - 1, 0, -1) if spelling[:k] in self.token_of), -1)
        self._trie = None

    def trie(self) -> tuple[dict[int, int], list[int | None]]:
        """state * 256 + byte -> state, and the token that a state spells."""
        if self._trie is None:
            step: dict[int, int] = {}
            spells: list[int | None] = [None]
            for spelling, t in self.token_of.items():
                state = 0
                for value in spelling:
                    state = step.setdefault(state << 8 | value, len(spells))
                    if state == len(spells):
                        spells.append(None)
                spells[state] = t
            self._trie = step, spells
        return self._trie

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave a boundary between two tokens; a bounded number of answers is remembered."""
        pair = left << 20 | right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int, skip_first: bool = False) -> bool:
        """Undo the later merge of the two sides step by step; no pair that meets at the boundary may have an earlier
        merge than those undone. Merges of equal rank run left to right, so the right side is undone first where they tie."""
        rank, made_at, limit = self.rank.get, self.made_at, 1 << 60
        while True:
            if not skip_first and rank(left << 20 | right, limit) < limit:
                return False
            skip_first = False
            a, b = made_at[left], made_at[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                left, limit = self.right[left], a
            else:
                right, limit = self.left[right], b + 1

    def whole(self, raw: bytes) -> list[int]:
        """The tokens of a short piece that is here from end to end. The transducer's rule without its stream: the longest
        token that is compatible with the one before it, and a step back where no token fits. A prefix has one encoding only,
        so a position from which there was no way on need not be tried again."""
        token_of, compatible, size, shorter = self.token_of.get, self.compatible, self.size, self.shorter
        token = token_of(raw)
        if token is not None:
            return [token]
        n, at, out, closed = len(raw), 0, [], set()
        while True:
            for end in range(n, at, -1):
                token = token_of(raw[at:end])
                if token is not None:
                    break
            while True:
                if end not in closed and (not out or compatible(out[-1], token)):
                    out.append(token)
                    at = end
                    break
                token = shorter[token]
                while token < 0:
                    closed.add(at)
                    token = out.pop()
                    at -= size[token]
                    token = shorter[token]
                end = at + size[token]
            if at == n:
                return out


class Transducer:
    """Feed bytes of one piece; get token ids as soon as no later byte can change them."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.base = self.read = 0  # positions: everything before base is emitted
        self.last: dict[int, tuple[int, int]] = {}  # position -> the token that ends there, and where it begins
        self.open = [(0, 0)]  # (where a token may begin, what the trie has read of it), the longest first
        self.step, self.spells = merges.trie()
        self.most = 0  # positions held at most

    def feed(self, chunk: bytes) -> list[int]:
        out: list[int] = []
        m, last, cursors, at = self.m, self.last, self.open, self.read
        step, spells, compatible = self.step.get, self.spells, m.compatible
        for value in chunk:
            at += 1
            kept, found = [], None
            for start, state in cursors:
                state = step(state << 8 | value)
                if state is None:
                    continue
                kept.append((start, state))
                token = spells[state]
                if found is None and token is not None and (start not in last or compatible(last[start][0], token)):
                    found = last[at] = (token, start)
            if found is not None:
                kept.append((at, 0))
            cursors = kept
            if at - self.base >= 4 * m.lookahead:
                self.read, self.open = at, cursors
                self.most = max(self.most, len(last))
                out += self._emit()
                last = self.last
        self.read, self.open = at, cursors
        return out

    def _path(self, at: int) -> list[int]:
        """Ends of the tokens from the base to a position."""
        own = []
        while at > self.base:
            own.append(at)
            at = self.last[at][1]
        return own[::-1]

    def _emit(self) -> list[int]:
        """Tokens through which every position that a coming token can build on traces back."""
        path = None
        for start, _ in self.open:
            own = self._path(start)
            path = own if path is None else path[: next((i for i, (x, y) in enumerate(zip(path, own)) if x != y), min(len(path), len(own)))]
        if not path:
            return []
        out = [self.last[p][0] for p in path]
        self.base = path[-1]
        self.last = {p: t for p, t in self.last.items() if p >= self.base}  # the last emitted token stays for the pair test
        return out

    def finish(self) -> list[int]:
        """The tokens left when the piece ends."""
        return [self.last[p][0] for p in self._path(self.read)]


class _Pieces(dict):
    """piece -> its ids as little-endian 32-bit integers; a missing one is encoded. When half of what may be kept is here,
    it becomes the old half, from which pieces that come up again are taken over."""

    def __init__(self, merges: Merges):
        self.m, self.held, self.old = merges, 0, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is not None:
            self[piece] = out
            return out
        raw = piece.encode()
        if len(raw) > SHORT:
            t = Transducer(self.m)
            return b"".join([*(_packed(t.feed(raw[at : at + 4096])) for at in range(0, len(raw), 4096)), _packed(t.finish())])
        out = _packed(self.m.whole(raw))
        self.held += len(raw) + len(out)
        if self.held > KEPT_BYTES // 2:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[piece] = out
        return out


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@remembered
@functools.lru_cache(4)
def codec(path: str):
    """(vocabulary, pieces, cutter, splitter at special tokens) of a vocabulary file, once for each task of a worker."""
    m = Merges(path)
    special = sorted(m.special, key=len, reverse=True)
    return m, _Pieces(m), regex.compile(PIECES), regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None


def encode(text: str, path: str) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit integers."""
    m, pieces, cutter, special = codec(path)
    get = pieces.__getitem__
    if special is None or not any(s in text for s in m.special):
        return b"".join(map(get, cutter.findall(text)))
    out = []
    for part in special.split(text):
        if part in m.special:
            out.append(_packed([m.special[part]]))
        else:
            out += map(get, cutter.findall(part))
    return b"".join(out)


class Decoder:
    """Incremental bytes-to-text state machine: feed ids in any portions; a character comes out once its last byte is in."""

    def __init__(self, path: str):
        self.bytes_of = codec(path)[0].bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def decode(ids, path: str, portion: int = 65536) -> str:
    """The text of a sequence of ids."""
    d = Decoder(path)
    return "".join([d.feed(ids[i : i + portion]) for i in range(0, len(ids), portion)]) + d.finish()


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary as little-endian unsigned 32-bit integers) for every row."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([encode(t or "", path) for t in texts], pa.binary())], ["id", "ids"])

    rows = with_rows(docs, id_col, text_col).withColumnsRenamed({id_col: "id", text_col: "text"}).drop(ROW)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text: (doc_id, n_tokens, ids_sha256, decoded_sha256, exact)."""

    def run(batches):
        import numpy as np

        for batch in batches:
            counts, ids_sha, text_sha, exact = [], [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                packed = encode(text, path)
                back = decode(np.frombuffer(packed, "<u4").tolist(), path)
                counts.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(back.encode()).hexdigest())
                exact.append(back == text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(exact, pa.bool_())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"],
            )

    rows = with_rows(docs, id_col, text_col).withColumnsRenamed({id_col: "id", text_col: "text"}).drop(ROW)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean").withColumnRenamed("id", id_col)
