"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

A token sequence is the BPE encoding of its bytes if and only if every two neighbours in it are: the merges of their joint
bytes give just these two. So every prefix of a text has one encoding, which ends in one last token, and it extends an
encoding that ends where that token begins. The transducer's nondeterministic states are pairs (token before the boundary,
place in the trie of tokens since then); a deterministic state is the list of the live pairs. Reading a byte advances every
pair, adds the one whose trie place completes a token that suits its predecessor, and puts that token out: the last of the
encoding of all that was read. From the end of a piece these tokens, each as far back as the one before is long, are its
encoding. States and transitions are made when first met, and dropped all together at a bound.

Decoding is a second machine: bytes come out of it when their character is complete. Tokens that lead it from one boundary of characters to
another, nearly all, are known beforehand and pass in one step; the others are read byte by byte.

Defined cases: null text is empty and has no ids; repeated rows and null doc_ids are encoded each; an empty table yields no rows; columns of the
input pass through, those named as a result are replaced. Every token is taken to be what the merges make of its own bytes, as in any file of trained ranks.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_chunks, tidy, with_schema, written
from .pretokens import Kept, Recent, splitter

#: Transitions, and pieces of one of two generations with their ids, that a worker keeps: some 230 MB of memory.
MAX_TRANSITIONS, MAX_PIECES = 450_000, 240_000


class Merges:
    """The plain procedure: join the neighbours of lowest rank, leftmost first. The transducer asks it how a token came about."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def parts(self, data: bytes, least: int = 1) -> list[bytes]:
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 40))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts


class State(dict):
    """A deterministic state: its transitions by byte, as far as met, its live pairs, and the token that ends where it is reached."""

    __slots__ = ("pairs", "token")

    def __init__(self, pairs: tuple[tuple[int, int], ...]):
        self.pairs, self.token = pairs, pairs[-1][1]


class Transducer:
    """encode() reads a piece byte by byte, notes the token that each transition puts out, and picks from its end those that lead back to its beginning."""

    def __init__(self, ranks: dict[bytes, int], most: int = MAX_TRANSITIONS):
        self.merges, self.most = Merges(ranks), most
        self.bytes_of = {v: k for k, v in ranks.items()}
        # trie places are numbers; (place, byte) leads on; a place that leads nowhere is 0 in `inner`, one that ends no token is -1 in `token_at`
        trie, inner, token_at = {}, bytearray(1), [-1]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                inner[node] = 1
                to = trie.setdefault(node << 8 | b, len(token_at))
                if to == len(token_at):
                    token_at.append(-1)
                    inner.append(0)
                node = to
            token_at[node] = rank
        self.trie, self.inner, self.token_at = trie, inner, token_at
        self.size = max(ranks.values(), default=0) + 1
        self.length = [0] * self.size
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        # the halves of a token whose merge completes it; -1 for a single byte, -2 before they are asked for
        self.left, self.right = [-2] * self.size, [-2] * self.size
        self.states: dict[tuple, State] = {}
        self._reset()

    def _reset(self) -> None:
        for s in self.states.values():  # they lead to one another
            s.clear()
        # a pair: (trie place, last token or -1); the last pair of a state is the boundary itself
        self.start = State(((0, -1),))
        self.states = {self.start.pairs: self.start}
        self.moves = 0
        self.suits: dict[int, bool] = {}

    def _find_halves(self, token: int) -> None:
        parts = self.merges.parts(self.bytes_of[token], 2)
        self.left[token], self.right[token] = (self.merges.ranks[parts[0]], self.merges.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)

    def _suit(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when their joint bytes are merged.

        Undone from the end, the later of the two last merges first, what meets at the boundary changes by one half each time;
        had the two that then meet been a merge of lower rank than the one undone, it would have come first.
        """
        rank, text, inner, outer = self.merges.ranks.get, self.bytes_of, self.right, self.left
        if rank(text[a] + text[b]) is not None:
            return False
        while True:
            if inner[a] == -2:
                self._find_halves(a)
            if outer[b] == -2:
                self._find_halves(b)
            left, right = inner[a], outer[b]
            if left >= 0 and (right < 0 or a > b):
                limit, a = a, left
            elif right >= 0:  # an equal merge to the right comes after one at the boundary
                limit, b = b + 1, right
            else:
                return True
            if rank(text[a] + text[b], limit) < limit:
                return False

    def _move(self, state: State, byte: int) -> State:
        """The next state, from now on a transition."""
        live, ends = [], -1
        trie, inner, token_at = self.trie.get, self.inner, self.token_at
        for node, last in state.pairs:
            to = trie(node << 8 | byte)
            if to is None:
                continue
            if ends < 0 and (token := token_at[to]) >= 0:
                suits = last < 0 or self.suits.get(last * self.size + token)
                if suits is None:
                    suits = self.suits[last * self.size + token] = self._suit(last, token)
                if suits:
                    ends = token
            if inner[to]:
                live.append((to, last))
        if ends < 0:
            raise ValueError("the ranks lack a single byte")
        live.append((0, ends))
        key = tuple(live)
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = State(key)
        state[byte] = to
        self.moves += 1
        return to

    def encode(self, piece: bytes) -> list[int]:
        if self.moves > self.most:
            self._reset()
        state, ends = self.start, []
        for byte in piece:
            to = state.get(byte)
            if to is None:
                to = self._move(state, byte)
            ends.append(to.token)
            state = to
        out, length, at = [], self.length, len(ends)
        while at:
            token = ends[at - 1]
            out.append(token)
            at -= length[token]
        out.reverse()
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class Encoder:
    """Encodes texts, each piece of the pattern by itself."""

    def __init__(self, path: str, pattern: str, transitions: int = MAX_TRANSITIONS):
        self.ranks = read_ranks(path)
        self.split = splitter(pattern)
        self.fst = Transducer(self.ranks, transitions)
        # the ids as they are kept
        self.four = [i.to_bytes(4, sys.byteorder) for i in range(self.fst.size)]
        self.pieces = Recent(MAX_PIECES * transitions // MAX_TRANSITIONS)

    def encode(self, text: str) -> np.ndarray:
        known, pieces = self.pieces, self.split(text)
        row = list(map(known.get, pieces))
        if None in row:
            known.renew()
            four = self.four
            for i, p in enumerate(pieces):
                if row[i] is None:
                    if p not in known and known.recall(p) is None:
                        raw = p.encode()
                        rank = self.ranks.get(raw)
                        known[p] = b"".join([four[t] for t in self.fst.encode(raw)]) if rank is None else four[rank]
                    row[i] = known[p]
        return np.frombuffer(b"".join(row), np.int32)


class Decoder:
    """Turns ids into bytes, characters at a time, by the UTF-8 state machine."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.token_bytes = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token_bytes[r] = t
        # the machine's step over a whole token, from between characters: those that lead back there pass as they are
        machine = Utf8()
        self.whole = np.array([machine.passes(t) for t in self.token_bytes])

    def __call__(self, ids: np.ndarray) -> tuple[bytes, bool]:
        """The bytes of the ids, as the machine lets them out, and whether they are UTF-8 throughout."""
        u, out, at = Utf8(), [], 0
        parts = list(map(self.token_bytes.__getitem__, ids.tolist()))
        for i in np.flatnonzero(~self.whole[ids]).tolist() if len(ids) else ():
            if i > at:
                out.append(u.push_whole(b"".join(parts[at:i])))
            out.append(u.push(parts[i]))
            at = i + 1
        if at < len(parts):
            out.append(u.push_whole(b"".join(parts[at:])))
        out.append(u.close())
        return b"".join(out), u.valid

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of each id as soon as its characters are complete; what is no UTF-8 comes as U+FFFD."""
        u = Utf8()
        for i in ids:
            if s := u.push(self.token_bytes[i]):
                yield s.decode(errors="replace")
        if s := u.close():
            yield s.decode(errors="replace")


def _utf8_steps() -> list[list[int]]:
    """States: 0 between characters, 1-3 that many plain continuation bytes to come, 4-7 the second bytes that E0, ED, F0 and F4
    restrict, 8 invalid."""
    steps = [[INVALID] * 256 for _ in range(9)]
    for low, high, to in ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)):
        for b in range(low, high + 1):
            steps[0][b] = to
    for state, low, high, to in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        for b in range(low, high + 1):
            steps[state][b] = to
    return steps


INVALID = 8
STEP = _utf8_steps()


class Utf8:
    """Incremental UTF-8: push() bytes, get those of the characters that are complete by then; close() gives what is left.

    Bytes that can't belong to a character come out as they are, and from then on `valid` is false.
    """

    def __init__(self) -> None:
        self.state, self.held, self.valid = 0, bytearray(), True

    def push(self, data: bytes) -> bytes:
        out, held = bytearray(), self.held
        for b in data:
            state = STEP[self.state][b]
            if state == INVALID:
                # what was held is no character; the byte may begin another
                self.valid = False
                out += held
                held.clear()
                state = STEP[0][b]
            if state == INVALID:
                out.append(b)
                state = 0
            else:
                held.append(b)
                if state == 0:
                    out += held
                    held.clear()
            self.state = state
        return bytes(out)

    def push_whole(self, data: bytes) -> bytes:
        """push() of bytes over which the machine goes from state 0 to state 0."""
        return data if self.state == 0 else self.push(data)

    def passes(self, data: bytes) -> bool:
        state = 0
        for b in data:
            state = STEP[state][b]
        return state == 0

    def close(self) -> bytes:
        out = bytes(self.held)
        self.valid &= not out
        self.state = 0
        self.held.clear()
        return out


_encoders = Kept(Encoder)


@contextmanager
def encoder(path: str, pattern: str, transitions: int = MAX_TRANSITIONS) -> Iterator[Encoder]:
    """The worker's encoder, which further tasks find warm; with fewer transitions than usual, one for this task only."""
    if transitions < MAX_TRANSITIONS:
        yield Encoder(path, pattern, transitions)
        return
    try:
        yield _encoders.take(path, pattern)
    finally:
        _encoders.rest()


@lru_cache(2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encode(docs: DataFrame, ranks: str, pattern: str | None = None, name: str = "ids", transitions: int = MAX_TRANSITIONS) -> DataFrame:
    """docs with the ids of text, array<int>. ranks: a file of base64 tokens and ranks that every node has. transitions: fewer take less memory and more time, and are given up with the task."""
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    columns = [c for c in docs.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(ranks, pattern, transitions) as c:
            for b in batches:
                text = b.column(b.schema.get_field_index("text"))
                for first, end, _, _ in text_chunks(text):
                    ids = [c.encode(t) for t in text.slice(first, end - first).fill_null("").to_pylist()]
                    yield _with(b.slice(first, end - first), columns, name, _lists(ids))

    # tables that stay with the worker leave little to give back
    return docs.mapInArrow(run if transitions >= MAX_TRANSITIONS else tidy(run), with_schema(docs, f"`{name}` array<int>", name))


def decode(encoded: DataFrame, ranks: str, name: str = "ids", to: str = "decoded") -> DataFrame:
    """encoded with the bytes that its ids stand for, and valid_utf8."""
    columns = [c for c in encoded.columns if c not in (to, "valid_utf8")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_bytes = decoder(ranks)
        for b in batches:
            ids = b.column(b.schema.get_field_index(name))
            off, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
            out = [to_bytes(flat[off[i] : off[i + 1]]) for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(x)) for x in columns] + [pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.bool_())],
                [*columns, to, "valid_utf8"],
            )

    return encoded.mapInArrow(run, with_schema(encoded, f"`{to}` binary, valid_utf8 boolean", to, "valid_utf8"))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32()))


def _with(b: pa.RecordBatch, columns: list[str], name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in columns] + [values], [*columns, name])


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    # ids are stored first: an encoder and a decoder need not be in memory at the same time
    ids = written(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text"), "ids")
    e = decode(ids, path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return e.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
