"""Language-model scores: an interpolated modified Kneser-Ney n-gram model, counted in Spark and looked up in memory-mapped sorted hash arrays.

A text is its words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased) and one end; a start stands before them as context and is never predicted. Every text
counts for itself. An n-gram of the model's order has the number of times it occurs; a shorter one the number of different words before it, or, if it begins
with the start, the number of times it occurs. Each order has three discounts from its counts of counts, what they take from a context goes to the
order below, and the lowest order is interpolated with 1 / (known tokens + 1), which all unknown words share: the probabilities after a context add up to 1.

Counting is one job with a shuffle for each order, highest first. Tasks count the n-grams of their texts and deal them out, by hash, into ranges, one for each
partition, packed; a range is added up, written as one file of sorted 64-bit hashes with their counts, and passes on what the next order needs: of each
distinct n-gram its last words (one more word before them) and of each context its total and its numbers of successors seen once, twice and more often.
Contexts are added up by hash like everything else, so no word, however common, makes a large group. Per order four sums reach the driver.

Workers map the files from the shared folder, or a copy in an unnamed temporary file if that folder is none that the system can map. The questions of a block of
texts are made distinct and sorted, so that each file is read front to back. The arrays take about 9 bytes a distinct n-gram; scoring
is meant for models whose arrays the machines' disks and page caches bear, as any worker may ask any of them.

Words are known by 64-bit hashes. Defined cases: null and empty texts have an end only; texts of any length are counted and scored as wholes; null doc_ids are
ids like any other; repeated rows count and are scored each; without training texts all tokens are unknown and have probability 1; an order whose counts of
counts give no discounts takes 0.5, 1 and 1.5; an empty table yields no rows; columns with the names of results are replaced, others pass through.
"""

from __future__ import annotations

import json
import mmap
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, dropped, scratch_path, table, text_chunks, tidy, with_schema, written
from .wordhash import U, Words, mix

#: Words of an n-gram; ranges of hashes of the highest order for each shuffle partition, rounded up to a power of two, of which an order has a quarter of the order
#: above; tokens that a task counts and looks up at once (more, if a single text has more).
ORDER, BUCKETS, TOKENS, ASKED = 2, 2, 2_000_000, 1_000_000
START, END = U(0x53544152545F5F31), U(0x454E445F5F5F5F31)
#: What is added up for each n-gram: its count, how often it occurs, and, of its continuations as a context, their sum and how many have count 1, 2, 3 and more.
SUMS = ("adjusted", "raw", "total", "once", "twice", "more")
#: Files that a worker keeps mapped.
MAPPED = 2048
RECORDS = "level int, bucket int, data binary"


# -- arrays to bytes and back


def _delta(sorted_values: np.ndarray) -> bytes:
    """Differences with their bytes transposed, which compresses what they have in common."""
    return np.diff(sorted_values, prepend=U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _undelta(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(U).ravel(), dtype=U)


def pack(words: list[np.ndarray], sums: dict[str, np.ndarray]) -> bytes:
    """Rows of word hashes and of sums, in any order; a sum that is missing is 0."""
    known, at = np.unique(np.concatenate(words), return_inverse=True)
    n = len(words[0])
    at = at.reshape(len(words), n)
    order = np.lexsort(at[::-1])
    wide = np.uint16 if len(known) <= 1 << 16 else np.uint32
    parts, head = [_delta(known)], [len(known), n, len(words), np.dtype(wide).itemsize]
    for i in range(len(words)):
        parts.append(at[i][order].astype(wide).view(np.uint8).reshape(n, -1).T.tobytes())
    for name in SUMS:
        column = sums.get(name)
        size = 0 if column is None else next(s for s in (1, 2, 4, 8) if s == 8 or not len(column) or int(column.max()) < 1 << 8 * s)
        head.append(size)
        if size:
            parts.append(column[order].astype(f"<u{size}").tobytes())
    return np.array(head, "<u4").tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
    n_head = 4 + len(SUMS)
    known_n, n, k, wide, *sizes = np.frombuffer(data, "<u4", n_head).tolist()
    raw = zstandard.ZstdDecompressor().decompress(data[4 * n_head :])
    known, at = _undelta(raw[: 8 * known_n], known_n), 8 * known_n
    words = []
    for _ in range(k):
        index = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * wide, at).reshape(wide, n).T).view(f"<u{wide}").ravel()
        words.append(known[index])
        at += n * wide
    sums = {}
    for name, size in zip(SUMS, sizes):
        if size:
            sums[name] = np.frombuffer(raw, f"<u{size}", n, at).astype(U)
            at += n * size
    return words, sums


def keys(words: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of rows of words."""
    h = np.full(len(words[0]), len(words), U)
    for w in words:
        h = mix(h * U(0x9E3779B97F4A7C15) + w)
    return h


def added(key: np.ndarray, words: list[np.ndarray], sums: dict[str, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], dict[str, np.ndarray]]:
    """Rows of equal key as one, their sums added, in ascending order of keys."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    head = order[first]
    return key[first], [w[head] for w in words], {k: np.add.reduceat(v[order], first) if len(first) else v for k, v in sums.items()}


# -- texts to tokens


class Tokens(NamedTuple):
    """Texts one after the other, each with the start before and the end behind it; place: of a token in its text, 0 for the start; text: its number."""

    word: np.ndarray
    place: np.ndarray
    text: np.ndarray

    def grams(self, k: int, begin: int = 0, end: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Positions from begin to end at which k tokens of a text end, and those tokens."""
        at = np.flatnonzero(self.place[begin:end] >= k - 1) + begin
        return at, [self.word[at - k + 1 + j] for j in range(k)]


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    w = Words(data, offsets)
    n, first = len(offsets) - 1, w.first
    begin = first + 2 * np.arange(n + 1)
    text = np.repeat(np.arange(n), np.diff(begin))
    word = np.empty(len(w.start) + 2 * n, U)
    inside = np.ones(len(word), bool)
    inside[begin[:-1]] = inside[begin[1:] - 1] = False
    word[inside], word[begin[:-1]], word[begin[1:] - 1] = w.hashes(), START, END
    return Tokens(word, np.arange(len(word)) - begin[text], text)


def blocks(column: pa.Array) -> Iterator[tuple[int, Tokens]]:
    """(first row, tokens) of the texts of a column."""
    for first, _, data, offsets in text_chunks(column):
        yield first, tokens(data, offsets)


# -- counting


def bits_of(level: int, order: int, bits: int) -> int:
    return max(1, bits - 2 * (order - level))


def _dealt(level: int, bits: int, key: np.ndarray, words: list[np.ndarray], sums: dict[str, np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """Rows in ascending order of keys as packed records, one for each bucket."""
    ends = np.searchsorted(key >> U(64 - bits), np.arange(1 << bits, dtype=U), "right")
    begin = 0
    for b, end in enumerate(ends.tolist()):
        if end > begin:
            yield level, b, pack([w[begin:end] for w in words], {k: v[begin:end] for k, v in sums.items()})
        begin = end


def _counted(some: list[Tokens], order: int, bits: int) -> Iterator[tuple[int, int, bytes]]:
    for k in range(order, 0, -1):
        parts = []
        for t in some:
            at, words = t.grams(k)
            # of the shorter ones only those that begin with the start, which is no n-gram by itself
            wanted = t.place[at] > 0 if k == order else (t.place[at] == k - 1) & (k > 1)
            words = [w[wanted] for w in words]
            parts.append(words)
        words = [np.concatenate(w) for w in zip(*parts)]
        if len(words[0]):
            key = keys(words)
            key, words, sums = added(key, words, {"raw": np.ones(len(key), U)})
            yield from _dealt(k, bits_of(k, order, bits), key, words, sums | ({"adjusted": sums["raw"]} if k < order else {}))


def _batches(records: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Batches of a few MB."""
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r[2])
        if size > 4_000_000:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    level, b, data = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(level, pa.int32()), pa.array(b, pa.int32()), pa.array(data, pa.binary())], ["level", "bucket", "data"])


def _count_task(order: int, bits: int):
    def records(batches):
        some, n = [], 0
        for batch in batches:
            for _, t in blocks(batch.column(0)):
                some.append(t)
                n += len(t.word)
                if n >= TOKENS:
                    yield from _counted(some, order, bits)
                    some, n = [], 0
        if some:
            yield from _counted(some, order, bits)

    return tidy(lambda batches: _batches(records(batches)))


def _passed_on(level: int, order: int, bits: int, words: list[np.ndarray], sums: dict[str, np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """What the order below gets of distinct n-grams: as endings they are one more word before, as contexts they have sums."""
    n = sums["adjusted"]
    seen = n > 0
    one, nothing = seen.astype(U), np.zeros(len(n), U)
    ending = {"adjusted": one, "raw": sums["raw"], "total": nothing, "once": nothing, "twice": nothing, "more": nothing}
    context = {"adjusted": nothing, "raw": nothing, "total": n, "once": (n == 1).astype(U), "twice": (n == 2).astype(U), "more": (n > 2).astype(U)}
    lower = [np.concatenate([words[j + 1][seen], words[j][seen]]) for j in range(level - 1)]
    key = keys(lower)
    yield from _dealt(level - 1, bits_of(level - 1, order, bits), *added(key, lower, {k: np.concatenate([ending[k][seen], context[k][seen]]) for k in SUMS}))


def _level_task(level: int, order: int, bits: int, directory: str):
    """The records of a range become a file, a record about it (level below 0), and records of the level below; records of other levels go on as they are."""

    def whole(b: int, held: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        parts = [unpack(x) for x in held]
        words = [np.concatenate(w) for w in zip(*(p[0] for p in parts))]
        names = [s for s in SUMS if any(s in p[1] for p in parts)]
        sums = {s: np.concatenate([p[1].get(s, np.zeros(len(p[0][0]), U)) for p in parts]) for s in names}
        key = keys(words)
        key, words, sums = added(key, words, sums)
        if level == order:
            sums = {"adjusted": sums["raw"], "raw": sums["raw"]}
        sums = {s: sums.get(s, np.zeros(len(key), U)) for s in SUMS}
        n = sums["adjusted"]
        kept = {"key": key} | {s: sums[s] for s in SUMS if s == "adjusted" or level < order and s != "raw" or level == 1 and s == "raw"}
        facts = {"file": write_arrays(directory, kept), "counts": [int((n == i).sum()) for i in range(1, 5)], "more": int((n > 2).sum()), "sum": int(n.sum())}
        if level == 1:
            facts |= {"tokens": int(sums["raw"].sum()), "known": int((sums["raw"] > 0).sum())}
        yield -level, b, json.dumps(facts).encode()
        if level > 1:
            yield from _passed_on(level, order, bits, words, sums)

    def records(batches):
        of: dict[int, list[bytes]] = {}  # one range, or a few where there are fewer partitions
        for batch in batches:
            for lv, b, data in zip(*(c.to_pylist() for c in batch.columns)):
                if lv == level:
                    of.setdefault(b, []).append(data)
                else:
                    yield lv, b, data
        while of:
            yield from whole(*of.popitem())

    return tidy(lambda batches: _batches(records(batches)))


# -- files


def write_arrays(directory: str, columns: dict[str, np.ndarray]) -> str:
    """A file of columns of unsigned integers: keys as they are, others as single bytes, with the places and values of those of 255 and more behind them."""
    sections: dict[str, np.ndarray] = {}
    for name, v in columns.items():
        if name == "key":
            sections[name] = v
            continue
        large = np.flatnonzero(v >= U(255))
        sections |= {name: np.minimum(v, U(255)).astype(np.uint8), f"{name}@": large.astype(U), f"{name}+": v[large]}
    where, at = {}, 0
    for name, v in sections.items():
        where[name] = (v.dtype.str, at, len(v))
        at += -(-v.nbytes // 8) * 8
    head = json.dumps(where).encode()
    head += b" " * (-(len(head) + 8) % 8)
    fs, path = pafs.FileSystem.from_uri(directory)
    fs.create_dir(path, recursive=True)
    name = uuid.uuid4().hex
    with fs.open_output_stream(f"{path}/{name}.tmp", compression=None) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for v in sections.values():
            out.write(v.tobytes() + bytes(-v.nbytes % 8))
    fs.move(f"{path}/{name}.tmp", f"{path}/{name}")
    return name


class Arrays:
    """A file's columns, mapped."""

    def __init__(self, directory: str, name: str):
        fs, path = pafs.FileSystem.from_uri(directory)
        if isinstance(fs, pafs.LocalFileSystem):
            with open(f"{path}/{name}", "rb") as f:
                self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            with tempfile.TemporaryFile() as f, fs.open_input_stream(f"{path}/{name}") as source:
                while part := source.read(1 << 24):
                    f.write(part)
                f.flush()
                self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = int.from_bytes(self.map[:8], "little")
        self.columns = {k: np.frombuffer(self.map, dtype, count, 8 + n + at) for k, (dtype, at, count) in json.loads(self.map[8 : 8 + n]).items()}

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the ascending keys there are, and where."""
        held = self.columns["key"]
        at = np.minimum(np.searchsorted(held, key), len(held) - 1)
        there = held[at] == key
        return there, at[there]

    def get(self, name: str, at: np.ndarray) -> np.ndarray:
        out = self.columns[name][at].astype(float)
        large = np.flatnonzero(out == 255)
        if len(large):
            out[large] = self.columns[f"{name}+"][np.searchsorted(self.columns[f"{name}@"], at[large].astype(U))]
        return out


class Model(NamedTuple):
    """files: by level and bucket; discounts: by level, for counts 1, 2, and more; base: sum, once, twice, more of the first level; tokens, known: N and V."""

    order: int
    bits: int  # of the hash, that tell the range of an n-gram of the highest order
    directory: str
    files: dict[tuple[int, int], str]
    discounts: dict[int, tuple[float, float, float]]
    base: tuple[float, float, float, float]
    tokens: int
    known: int


def discounts(counts: list[int]) -> tuple[float, float, float]:
    """From the numbers of n-grams with counts 1, 2, 3 and 4."""
    n1, n2, n3, n4 = counts
    if min(n1, n2, n3) > 0:
        y = n1 / (n1 + 2 * n2)
        d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        if all(0 < x <= i for i, x in enumerate(d, 1)):
            return d
    return 0.5, 1.0, 1.5


def fit(docs: DataFrame, order: int = ORDER) -> Model:
    """Of all rows of docs (text)."""
    if order < 1:
        raise ValueError("order must be at least 1")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, (BUCKETS * parts - 1).bit_length())
    directory = scratch_path(spark, "kneserney")
    records = docs.select("text").mapInArrow(_count_task(order, bits), RECORDS)
    for level in range(order, 0, -1):
        dealt = records.repartitionById(1 << bits_of(level, order, bits), "bucket")
        records = dealt.mapInArrow(_level_task(level, order, bits, directory), RECORDS)
    # of the whole job only records about files are left: one for each bucket and order
    about = written(records, "kneserney-files")
    files, by_level = {}, {k: {"counts": [0] * 4, "more": 0, "sum": 0, "tokens": 0, "known": 0} for k in range(1, order + 1)}
    for r in about.collect():
        facts, s = json.loads(bytes(r.data)), by_level[-r.level]
        files[-r.level, r.bucket] = facts["file"]
        s["counts"] = [a + b for a, b in zip(s["counts"], facts["counts"])]
        for k in ("more", "sum", "tokens", "known"):
            s[k] += facts.get(k, 0)
    dropped(about)
    one = by_level[1]
    return Model(
        order, bits, directory, files, {k: discounts(s["counts"]) for k, s in by_level.items()},
        (one["sum"], one["counts"][0], one["counts"][1], one["more"]), one["tokens"], one["known"],
    )


# -- scoring


class Lookup:
    def __init__(self, model: Model):
        self.model, self.mapped = model, OrderedDict()

    def _arrays(self, level: int, b: int) -> Arrays | None:
        name = self.model.files.get((level, b))
        if name is None:
            return None
        if name in self.mapped:
            self.mapped.move_to_end(name)
        else:
            self.mapped[name] = Arrays(self.model.directory, name)
            if len(self.mapped) > MAPPED:
                self.mapped.popitem(last=False)
        return self.mapped[name]

    def __call__(self, level: int, words: list[np.ndarray], names: tuple[str, ...]) -> dict[str, np.ndarray]:
        """Sums of the n-grams, 0 where there is none."""
        key, back = np.unique(keys(words), return_inverse=True)
        out = {s: np.zeros(len(key)) for s in names}
        bs = key >> U(64 - bits_of(level, self.model.order, self.model.bits))
        cuts = np.flatnonzero(np.r_[True, bs[1:] != bs[:-1]]) if len(key) else np.zeros(0, np.int64)
        for begin, end in zip(cuts.tolist(), [*cuts.tolist()[1:], len(key)]):
            if arrays := self._arrays(level, int(bs[begin])):
                there, at = arrays.find(key[begin:end])
                for s in names:
                    out[s][begin:end][there] = arrays.get(s, at)
        return {s: v[back] for s, v in out.items()}

    def probabilities(self, t: Tokens, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """For positions from begin to end: the model's probability of the token, and how often training texts have it; 1 and 0 at a start."""
        m, n = self.model, end - begin
        p = np.full(n, 1 / (m.known + 1))
        raw = np.zeros(n)
        before = max(0, begin - 1)
        context = None
        for k in range(1, m.order + 1):
            at, words = t.grams(k, before, end)
            names = ("adjusted", *(("total", "once", "twice", "more") if k < m.order else ()), *(("raw",) if k == 1 else ()))
            got = {s: np.zeros(end - before) for s in names}
            for s, v in self(k, words, names).items():
                got[s][at - before] = v
            own = slice(begin - before, end - before)
            c = got["adjusted"][own]
            if k == 1:
                total, *seen = (np.full(n, float(x)) for x in m.base)
                raw = got["raw"][own]
            else:
                # sums of the tokens before, as contexts
                total, *seen = (np.r_[np.zeros(1 - (begin - before)), context[s]][:n] for s in ("total", "once", "twice", "more"))
            d = m.discounts[k]
            off = np.select([c <= 0, c == 1, c == 2], [0.0, d[0], d[1]], d[2])
            left = sum(x * y for x, y in zip(d, seen))
            with np.errstate(divide="ignore", invalid="ignore"):
                higher = (c - off) / total + left / total * p
            p = np.where((total > 0) & (t.place[begin:end] >= k - 1), higher, p)
            context = got
        p[t.word[begin:end] == START] = 1.0
        return p, raw


def _score_task(held, columns: list[str]):
    def run(batches):
        m = held.value
        look = Lookup(m)
        base = float(m.tokens + m.known + 1)
        for batch in batches:
            rows = batch.num_rows
            out = {"n_tokens": np.zeros(rows, np.int64), "n_known": np.zeros(rows, np.int64), "base_score": np.zeros(rows), "score": np.zeros(rows)}
            for first, t in _joined(batch.column(batch.schema.get_field_index("text"))):
                n = int(t.text[-1]) + 1
                for begin in range(0, len(t.word), ASKED):
                    end = min(begin + ASKED, len(t.word))
                    p, raw = look.probabilities(t, begin, end)
                    token, text = t.place[begin:end] > 0, t.text[begin:end]
                    each = lambda v: np.bincount(text[token], v[token], n)  # noqa: E731, B023
                    at = slice(first, first + n)
                    out["n_tokens"][at] += np.bincount(text[token], minlength=n)
                    out["n_known"][at] += np.bincount(text[token & (raw > 0)], minlength=n)
                    out["base_score"][at] += each(np.log10((raw + 1) / base))
                    out["score"][at] += each(np.log10(p))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in columns] + [pa.array(v) for v in out.values()], [*columns, *out])

    return tidy(run)


def _joined(column: pa.Array) -> Iterator[tuple[int, Tokens]]:
    """blocks() of at least ASKED tokens, where there are as many, as the more are looked up at once the fewer are distinct."""
    some, n, begin, texts = [], 0, 0, 0
    for first, t in blocks(column):
        if not some:
            begin, texts = first, 0
        some.append(t._replace(text=t.text + texts))
        texts += int(t.text[-1]) + 1
        n += len(t.word)
        if n >= ASKED:
            yield begin, Tokens(*map(np.concatenate, zip(*some)))
            some, n = [], 0
    if some:
        yield begin, Tokens(*map(np.concatenate, zip(*some)))


RESULTS = ("n_tokens", "n_known", "base_score", "score")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with n_tokens (words and end), n_known (those that training texts have), and log10 probabilities of the whole text: base_score by
    single tokens with one added to each count, score by the model."""
    columns = [c for c in docs.columns if c.lower() not in RESULTS]
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_score_task(held, columns), with_schema(docs.select(*[docs[f"`{c}`"] for c in columns]), "n_tokens bigint, n_known bigint, base_score double, score double"))


def op13_kneser_ney(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(bucket("doc_id", 7) == 2, F.lit(False))
    model = fit(docs.filter(~held_out))
    scored = score(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
