"""Token ids in sorted-string-table shards: documents keyed by identifier, looked up by binary search.

A shard is one file, written by one task for one range of doc_id:

    block*  index  filter  footer

block   zstandard frame of: restart-free entries (varint shared key bytes, varint new key bytes, varint value bytes, new key
        bytes, value bytes), keys ascending; the first key of a block is whole, later ones share a prefix with their predecessor
key     17 bytes: 0 for a null doc_id, else 1; doc_id with its sign bit flipped (0, if null) and the number of the row among those of its doc_id,
        both 64 bits, big-endian
value   64-bit count of ids before the document in its shard, then the ids, 16 or 32 bits each (footer: width), little-endian
index   zstandard frame of: for each block its first key (17 bytes), offset and length (64 bits each)
filter  Bloom filter over the doc_ids: 64-bit words, 10 bits an entry, 7 probes by double hashing
footer  88 bytes: magic, version, width, entries, ids, blocks, offsets and lengths of index and filter, crc32 of index and filter

Defined cases: null text is empty and yields the end id only; null doc_ids come first; repeated rows of a doc_id get one entry each, by
text, null before empty; an empty table yields no shard and no rows; other columns are not stored. A special token of the tokenizer that stands in a
text becomes its id, as the library has it by default; `special_as_text` makes it ordinary text.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path, table, text_chunks, written
from .pretokens import USUAL, Kept, Recent, splitter

MAGIC, VERSION = b"LOOMSST1", 2
FOOTER = struct.Struct("<8sIIQQQQQQQII")
ENTRY = struct.Struct(">BQQ")
#: Bytes of a key, and of its part that names the document.
KEY, DOC = 17, 9
#: Bytes of entries in a block before compression, unless one entry is longer.
BLOCK_BYTES = 1 << 18
MANIFEST = "path string, first_id bigint, last_id bigint, n_docs bigint, n_ids bigint"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _key(doc_id: int | None, row: int) -> bytes:
    return ENTRY.pack(0, 0, row) if doc_id is None else ENTRY.pack(1, doc_id + (1 << 63), row)


def _probes(doc_id: int | None, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(_key(doc_id, 0)[:DOC])
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(7)]


class ShardWriter:
    """Streams entries in ascending order to a new file, which appears under its name only when it is whole."""

    def __init__(self, uri: str, width: int):
        self.fs, self.path = _fs(uri)
        self.width, self.temp = width, f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.temp, compression=None)
        self.zstd = zstandard.ZstdCompressor(level=3)
        self.block, self.last, self.at = bytearray(), b"", 0
        self.index, self.ids, self.n, self.n_ids, self.keep = [], [], 0, 0, b""

    def add(self, doc_id: int | None, row: int, ids: np.ndarray) -> None:
        key, value = _key(doc_id, row), struct.pack("<Q", self.n_ids) + ids.astype(f"<u{self.width}").tobytes()
        if not self.block:
            self.first, shared = key, 0
        else:
            shared = next((i for i in range(KEY) if key[i] != self.last[i]), KEY)
        self.block += _varint(shared) + _varint(KEY - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.ids.append(doc_id)
        self.n, self.n_ids = self.n + 1, self.n_ids + len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at, len(data)

    def _flush(self) -> None:
        if self.block:
            self.index.append(self.first + struct.pack("<QQ", *self._put(self.zstd.compress(bytes(self.block)))))
            self.block = bytearray()

    def close(self) -> tuple[int, int, int, int]:
        self._flush()
        bits = np.zeros(max(1, (10 * len(set(self.ids)) + 63) // 64) * 64, bool)
        for d in set(self.ids):
            bits[_probes(d, len(bits))] = True
        index, bloom = self.zstd.compress(b"".join(self.index)), np.packbits(bits, bitorder="little").tobytes()
        at_index, at_bloom = self._put(index), self._put(bloom)
        self._put(FOOTER.pack(MAGIC, VERSION, self.width, self.n, self.n_ids, len(self.index), *at_index, *at_bloom, zlib.crc32(index), zlib.crc32(bloom)))
        self.out.close()
        self.fs.move(self.temp, self.path)
        return self.ids[0], self.ids[-1], self.n, self.n_ids


class Shard:
    """Reads a shard: footer, index and filter first, then only the blocks that are asked for."""

    def __init__(self, uri: str):
        fs, path = _fs(uri)
        self.file = fs.open_input_file(path)
        self.file.seek(self.file.size() - FOOTER.size)
        magic, version, self.width, self.n, self.n_ids, _, ia, il, ba, bl, ic, bc = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{uri} is not a shard of version {VERSION}")
        index, self.bloom = self._at(ia, il), self._at(ba, bl)
        if zlib.crc32(index) != ic or zlib.crc32(self.bloom) != bc:
            raise ValueError(f"{uri} is damaged")
        raw = zstandard.ZstdDecompressor().decompress(index) if self.n else b""
        self.blocks = [(raw[i : i + KEY], *struct.unpack("<QQ", raw[i + KEY : i + KEY + 16])) for i in range(0, len(raw), KEY + 16)]

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def _entries(self, b: int) -> Iterator[tuple[int | None, int, int, np.ndarray]]:
        raw = zstandard.ZstdDecompressor().decompress(self._at(*self.blocks[b][1:]))
        at, key = 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            fresh, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + fresh]
            at += fresh
            named, doc, row = ENTRY.unpack(key)
            yield doc - (1 << 63) if named else None, row, struct.unpack_from("<Q", raw, at)[0], np.frombuffer(raw, f"<u{self.width}", (size - 8) // self.width, at + 8)
            at += size

    def scan(self) -> Iterator[tuple[int | None, int, int, np.ndarray]]:
        """(doc_id, row, ids before it in the shard, ids) of all entries in order."""
        for b in range(len(self.blocks)):
            yield from self._entries(b)

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(doc_id, len(self.bloom) * 8))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all rows of a document."""
        if not self.blocks or not self.may_hold(doc_id):
            return []
        low, high = 0, len(self.blocks)  # the first block whose first key is not below the document's
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.blocks[mid][0] < _key(doc_id, 0) else (low, mid)
        found: list[np.ndarray] = []
        for b in range(max(0, low - 1), len(self.blocks)):
            if self.blocks[b][0][:DOC] > _key(doc_id, 0)[:DOC]:
                break
            found += [ids for d, _, _, ids in self._entries(b) if d == doc_id]
        return found


#: Distinct pre-tokens of a generation; a worker keeps the ids of two.
MEMO = 300_000


class Encoder:
    """Ids by the tokenizers library. Its byte-level pre-tokenizer splits a text first, and merges stay within a piece, so
    pieces that a worker has met are not encoded again. Special tokens that stand in a text are cut out before that."""

    def __init__(self, path: str, special_as_text: bool = False):
        import json

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        self.vocab = self.tok.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            conf = {k: v for k, v in json.load(f).items() if k != "model"}
        pre, added = conf.get("pre_tokenizer") or {}, conf.get("added_tokens") or []
        self.split, self.special, self.marks = None, {}, None
        if not special_as_text:
            self.special = {t["content"]: np.array([t["id"]], np.uint32).tobytes() for t in added}
            self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if added else None
        # added tokens that take white space or parts of words along are left to the library
        plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") and conf.get("normalizer") for t in added)
        if plain and not conf.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True):
            self.split = splitter(USUAL)
            self.opens = np.zeros(self.vocab, bool)
            self.opens[[i for t, i in self.tok.get_vocab().items() if t[0] == "Ġ"]] = True
        self.memo = Recent(MEMO)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if self.split is None:
            return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        pieces = [self._pieces(t) for t in texts]
        memo = self.memo
        memo.renew()
        memo.update(self.special)
        rows = [list(map(memo.get, ps)) for ps in pieces]
        gaps = [(r, [i for i, x in enumerate(row) if x is None]) for r, row in enumerate(rows) if None in row]
        new = [p for p in dict.fromkeys(pieces[r][i] for r, at in gaps for i in at) if memo.recall(p) is None]
        # letters after a space stay a piece of their own wherever they stand, so many of those are encoded as one text, in
        # which a token that begins with the space begins a piece
        spaced = [p for p in new if p[0] == " " and p[1:].isalpha()]
        for at in range(0, len(spaced), 500):
            some = spaced[at : at + 500]
            ids = np.array(self.tok.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = [*np.flatnonzero(self.opens[ids]).tolist()[1:], len(ids)]
            raw, begin = ids.tobytes(), 0
            for p, end in zip(some, ends, strict=True):
                memo[p] = raw[4 * begin : 4 * end]
                begin = end
        other = [p for p in new if p not in memo]
        for p, e in zip(other, self.tok.encode_batch_fast(other, add_special_tokens=False)):
            memo[p] = np.array(e.ids, np.uint32).tobytes()
        for r, at in gaps:
            row, ps = rows[r], pieces[r]
            for i in at:
                row[i] = memo[ps[i]]
        return [np.frombuffer(b"".join(row), np.uint32) for row in rows]

    def _pieces(self, text: str) -> list[str]:
        if self.marks is None or not self.marks.search(text):
            return self.split(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [*self.split(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.split(text[at:])


_encoders = Kept(Encoder)


@contextmanager
def encoder(path: str, special_as_text: bool = False) -> Iterator[Encoder]:
    """The worker's encoder, which further tasks find warm."""
    try:
        yield _encoders.take(path, special_as_text)
    finally:
        _encoders.rest()


def write_shards(docs: DataFrame, tokenizer: str, directory: str, end_id: int | None = 2, shards: int | None = None, special_as_text: bool = False) -> DataFrame:
    """Writes docs as shards below directory, ascending from shard to shard; returns and writes their manifest."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # by the key and nothing else, so that rows of one doc_id meet in one shard
    placed = row.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last, row = None, None, 0
        with encoder(tokenizer, special_as_text) as enc:
            width = 2 if max(enc.vocab, (end_id or 0) + 1) <= 1 << 16 else 4
            tail = np.array([] if end_id is None else [end_id], np.uint32)
            uri = ""
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1)
                for first, end, _, _ in text_chunks(texts, 2_000_000):
                    encoded = enc(texts.slice(first, end - first).fill_null("").to_pylist())
                    for doc, e in zip(ids[first:end], encoded):
                        if out is None:
                            uri = f"{directory}/shard-{_key(doc, 0)[:DOC].hex()}.sst"
                            out = ShardWriter(uri, width)
                        row = row + 1 if out.n and doc == last else 0
                        last = doc
                        out.add(doc, row, np.concatenate([e, tail]))
        if out is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "first_id", "last_id", "n_docs", "n_ids"), (uri, *out.close())))])

    manifest = f"{directory}/manifest"
    placed.mapInArrow(write, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, row, start (ids of all documents before it), n_tokens, tokens (packed 32-bit little-endian ids) of every entry."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per shard; each is then read by a task of its own
    placed = written(manifest.withColumn("base", before).select("path", "base"), "bases")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held, size = [], 0
                for doc, row, start, ids in Shard(path).scan():
                    held.append((doc, row, base + start, len(ids), ids.astype("<u4").tobytes()))
                    size += len(ids)
                    if size > 2_000_000:
                        yield _entries_batch(held)
                        held, size = [], 0
                if held:
                    yield _entries_batch(held)

    return placed.repartition(n, "path").mapInArrow(read, "doc_id bigint, row bigint, start bigint, n_tokens bigint, tokens binary")


def _entries_batch(held: list[tuple]) -> pa.RecordBatch:
    doc, row, start, n, tokens = zip(*held)
    return pa.RecordBatch.from_arrays(
        [pa.array(x, pa.int64()) for x in (doc, row, start, n)] + [pa.array(tokens, pa.binary())], ["doc_id", "row", "start", "n_tokens", "tokens"]
    )


def lookup(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and tokens of the wanted doc_ids, each found by its shard's first key, filter and index."""
    held = wanted.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    # a row for each shard, of which there are as many as was asked for; a null first_id is the least
    ranges = sorted((-(1 << 63) if r["first_id"] is None else r["first_id"], r["path"]) for r in manifest.select("first_id", "path").collect())
    starts = np.array([r[0] for r in ranges], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(starts, b.column(0).fill_null(-(1 << 63)).to_numpy(), "right") - 1
            some = np.flatnonzero(at >= 0)
            yield pa.RecordBatch.from_arrays([pa.array([ranges[i][1] for i in at[some]], pa.string()), b.column(0).take(pa.array(some))], ["path", "doc_id"])

    near = held.mapInArrow(place, "path string, doc_id bigint")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = {}
        for b in batches:
            out = []
            for path, doc in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if path not in shards:
                    shards.clear()
                    shards[path] = Shard(path)
                out += [(doc, ids.astype("<u4").tobytes()) for ids in shards[path].get(doc)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["doc_id", "tokens"])

    n = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return near.repartitionByRange(n, "path", "doc_id").sortWithinPartitions("path", "doc_id").mapInArrow(find, "doc_id bigint, tokens binary")


def op4_token_shards(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch_path(spark, "shards"))
    e = read_shards(spark, manifest)
    return e.select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))
