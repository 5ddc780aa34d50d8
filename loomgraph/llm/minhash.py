"""MinHash near-dedup with min-max hashing.

Each permutation of the shingles gives a text two values, the least and the greatest, so that a signature of n values costs n / 2
hash evaluations per shingle. Runs of ROWS values, no two of one permutation, are bands; texts that agree in a band are
candidates. At ROWS = 5 and BANDS = 28, two texts of similarity 0.8 share no band with a probability of 2 in 10**5, of 0.85 of
5 in 10**8.

Texts with equal shingle sets are one class, and only a class's least document goes on. First, each document is compared with one
other: that which is the least of most of its buckets. Where a bucket is left in several components, its members outside the largest
one are compared with all others of it, however many they are: both kinds are dealt into blocks by a hash of the id, and pairs of blocks
are compared by numpy on sketches of fixed size. Of each two blocks the pairs that tie them together go on; where one of these turns out not
to be similar, the bucket's blocks are gone through again for all other pairs. Links are confirmed on full sets. So every two similar texts that share a band
end in one component, and no bucket is cut off or expanded into rows.

Two sketches rule pairs out before full sets are compared: four bits of each signature value, of which a similar pair differs in more
than allowed by six standard deviations or never, and the parities of CELLS cells that the shingles fall into. Parities differ in no more
places than the sets do, so that this bound is exact.

Defined cases: a text of fewer words than a shingle is one shingle; null, empty and blank texts have no shingles and link with
nothing; repeated rows of a doc_id are copies of each other or link like other texts, and all rows of a doc_id get one component;
a null doc_id has no component and is kept; an empty table yields no rows; extra columns pass through keep_one(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, dropped, possible, table, text_chunks, tidy, without, written
from .components import components, roots
from .wordhash import U, Words, mix, shingle_sets

ROWS, BANDS = 5, 28
#: Members of a bucket that are compared at once, on average, with so many others; larger buckets have more such blocks.
BLOCK = 256
#: Parities of a set, a multiple of 64.
CELLS = 1024


@lru_cache(4)
def _hashers(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240131)
    a, b = rng.integers(1, 1 << 63, (2, count), dtype=np.uint64)
    return a | U(1), b * U(2) + U(1)


def signatures(sets: np.ndarray, offsets: np.ndarray, values: int) -> np.ndarray:
    """Rows of `values` values for the non-empty sets: all minima, then all maxima, of values / 2 permutations."""
    begin = offsets[:-1][np.diff(offsets) > 0]
    half = values // 2
    out = np.empty((len(begin), values), U)
    if len(begin):
        a, b = _hashers(half)
        for i in range(half):
            h = sets * a[i] + b[i]
            out[:, i] = np.minimum.reduceat(h, begin)
            out[:, half + i] = np.maximum.reduceat(h, begin)
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of each band, different bands having different keys."""
    bands = signature.shape[1] // rows
    s = signature.reshape(len(signature), bands, rows)
    k = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U)), (len(s), bands)).copy()
    for j in range(rows):
        k = mix(k ^ s[:, :, j]) + U(j)
    return k.view(np.int64)


def nibbles(signature: np.ndarray) -> np.ndarray:
    """The lowest four bits of each value, sixteen to a 64-bit number."""
    wide = -(-signature.shape[1] // 16) * 16
    low = np.zeros((len(signature), wide), U)
    low[:, : signature.shape[1]] = mix(signature) & U(15)
    return np.bitwise_or.reduce(low.reshape(len(low), wide // 16, 16) << (U(4) * np.arange(16, dtype=U)), axis=2).view(np.int64)


def parities(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each of CELLS cells holds an odd number of shingles, of the non-empty sets, as 64-bit numbers."""
    size = np.diff(offsets)
    begin, size = offsets[:-1][size > 0], size[size > 0]
    out = np.zeros((len(size), CELLS // 64), np.int64)
    for at in range(0, len(size), 2048):
        n = size[at : at + 2048]
        cell = (mix(sets[begin[at] : begin[at] + n.sum()] + U(2)) & U(CELLS - 1)).astype(np.int64)
        odd = np.bincount(np.repeat(np.arange(len(n)), n) * CELLS + cell, minlength=len(n) * CELLS) & 1
        out[at : at + len(n)] = np.packbits(odd.astype(np.uint8).reshape(len(n), CELLS), axis=1).view(np.int64)
    return out


def _most_different(values: int, percent: int) -> float:
    """Nibbles in which texts of that similarity differ, with six standard deviations."""
    share = (1 - percent / 100) * 15 / 16
    return values * share + 6 * (values * share * (1 - share)) ** 0.5


def _may_be_similar(a: str, b: str, values: int, percent: int):
    """Whether the sketches _a and _b, of sets of na and nb shingles, do not rule that similarity out."""
    wide = -(-values // 16)
    nibbled, odd = F.lit(0), F.lit(0)
    for i in range(wide + CELLS // 64):
        x = F.col(f"_{a}")[i].bitwiseXOR(F.col(f"_{b}")[i])
        if i < wide:
            for shift in (2, 1):
                x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
            nibbled = nibbled + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
        else:
            odd = odd + F.bit_count(x)
    return (nibbled <= _most_different(values, percent)) & ((100 + percent) * odd <= (100 - percent) * (F.col(f"n{a}") + F.col(f"n{b}")))


def _sketches(docs: DataFrame, k: int, rows: int, bands: int) -> DataFrame:
    """doc_id, n (set size), s1, s2 (digest of the set), keys (of the bands) and bits (nibbles, then parities); both empty if the set is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, off in text_chunks(b.column(1)):
                sets, at = shingle_sets(Words(data, off), k)
                n = np.diff(at)
                full = n > 0
                digests = np.zeros((2, len(n)), U)
                if full.any():
                    digests[0, full] = np.add.reduceat(mix(sets), at[:-1][full])
                    digests[1, full] = np.bitwise_xor.reduceat(mix(sets + U(1)), at[:-1][full])
                signature = signatures(sets, at, rows * bands)
                keys, bits = band_keys(signature, rows), np.c_[nibbles(signature), parities(sets, at)]
                lists = []
                for values in (keys, bits):
                    ends = np.zeros(len(n) + 1, np.int32)
                    np.cumsum(full * values.shape[1], out=ends[1:])
                    lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel())))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), pa.array(n), *[pa.array(d.view(np.int64)) for d in digests], *lists], ["doc_id", "n", "s1", "s2", "keys", "bits"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id bigint, n bigint, s1 bigint, s2 bigint, keys array<bigint>, bits array<bigint>")


def _promising(pairs: DataFrame, bits: DataFrame, values: int, percent: int) -> DataFrame:
    """The pairs (a, b) that their sketches (doc_id, n, bits) do not rule out."""
    left, right = (bits.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").filter(_may_be_similar("a", "b", values, percent)).select("a", "b")


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id and z, the compressed text, of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            for first, end, data, off in text_chunks(b.column(1)):
                raw = memoryview(data)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), pa.array([pack(raw[x:y]) for x, y in zip(off.tolist(), off[1:].tolist())], pa.binary())], ["doc_id", "z"])

    return docs.mapInArrow(tidy(run), "doc_id bigint, z binary")


def _similar(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, za, zb), in runs of equal a: those whose full sets are similar enough, as (a, b)."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        a, b, za, zb = batch.columns
        held, size, last, at = [], 0, None, []
        out = []

        def settle():
            if at:
                off = np.zeros(len(held) + 1, np.int64)
                np.cumsum([len(t) for t in held], out=off[1:])
                sets, ends = shingle_sets(Words(np.frombuffer(b"".join(held), np.uint8), off), k)
                for row, x, y in at:
                    s, t = sets[ends[x] : ends[x + 1]], sets[ends[y] : ends[y + 1]]
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(t) - both):
                        out.append(row)

        for row in range(len(batch)):
            if size > CHUNK_BYTES:
                settle()
                held, size, last, at = [], 0, None, []
            packed = za[row].as_py()
            if last is None or packed != last:
                last, mine = packed, len(held)
                held.append(unpack(packed))
                size += len(held[-1])
            held.append(unpack(zb[row].as_py()))
            size += len(held[-1])
            at.append((row, mine, len(held) - 1))
        settle()
        yield pa.RecordBatch.from_arrays([a.take(pa.array(out, pa.int64())), b.take(pa.array(out, pa.int64()))], ["a", "b"])


def _confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Texts travel compressed, that of b once for each of its pairs."""
    named = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    texts = _packed(possible(named, ids))
    left, right = texts.select(F.col("doc_id").alias("a"), F.col("z").alias("za")), texts.select(F.col("doc_id").alias("b"), F.col("z").alias("zb"))
    j = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "za", "zb")
    return j.mapInArrow(tidy(lambda batches: _similar(batches, k, percent)), "a bigint, b bigint").distinct()


def _alike_in_size(a: str, b: str, percent: int):
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text)."""
    sketch = written(_sketches(docs, k, rows, bands), "sketches")
    # classes of equal sets; their least documents stand for them from here on
    digest = ["n", "s1", "s2"]
    real = sketch.filter("n > 0 and doc_id is not null")
    least = written(real.groupBy(*digest).agg(F.min(F.struct("doc_id", "keys", "bits")).alias("r")).select(*digest, F.col("r.doc_id").alias("rep"), "r.keys", "r.bits"), "classes")
    links = _closed(least, docs, k, rows * bands, percent)
    of = least.select(*digest, "rep")
    own = sketch.select("doc_id", *digest).join(of, digest, "left").join(links, F.col("rep") == links["id"], "left")
    own = own.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("c"))
    own = written(own, "placed")
    dropped(sketch, least, links)
    # several rows of one doc_id tie what they belong to together
    tied = own.filter("doc_id is not null").groupBy("doc_id").agg(F.min("c").alias("c"), F.max("c").alias("most")).filter("c <> most")
    if not tied.isEmpty():
        of_class = own.filter("doc_id <> c").select(F.col("doc_id").alias("a"), F.col("c").alias("b"))
        again = components(of_class.unionByName(own.join(tied.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("c").alias("b"))))
        own = own.join(again, own["doc_id"] == again["id"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("c"))
    return own.select("doc_id", "n_shingles", F.col("c").alias("component_id"), F.coalesce(F.col("c") == F.col("doc_id"), F.lit(True)).alias("kept"))


def _closed(least: DataFrame, docs: DataFrame, k: int, values: int, percent: int) -> DataFrame:
    """id and component, a written table, of the linked among the classes (rep, n, keys, bits)."""
    member = least.select(F.explode("keys").alias("key"), F.col("rep").alias("doc_id"), "n")
    low = member.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("l"), F.count("*").alias("c")).filter("c > 1")
    low = written(low.select("key", F.col("l.doc_id").alias("a"), F.col("l.n").alias("na")), "low")
    bucket = written(member.join(low, "key"), "shared")
    sketches = least.select(F.col("rep").alias("doc_id"), "n", "bits")
    # each document against the least of most of its buckets
    star = bucket.filter((F.col("a") < F.col("doc_id")) & _alike_in_size("na", "n", percent)).groupBy("a", F.col("doc_id").alias("b")).agg(F.count("*").alias("c"))
    nearest = star.groupBy("b").agg(F.max(F.struct("c", (-F.col("a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b")
    tried = written(_promising(nearest, sketches, values, percent), "pairs")
    links = written(_confirmed(tried, docs, k, percent), "links")
    found = written(roots(links.select(F.col("b").alias("id"), F.col("a").alias("parent"))), "found")
    dropped(links, tried)
    tried, wanted = None, bucket.select("key", "doc_id")
    for forest in (True, False):
        # buckets in which several components are left
        part = wanted.join(found, wanted["doc_id"] == found["id"], "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("c"))
        part = written(part, "placed")
        pairs = written(_across(part, sketches, values, percent, forest), "pairs")
        asked = pairs.select("a", "b").distinct()
        links = written(_confirmed(asked if tried is None else asked.join(tried, ["a", "b"], "left_anti"), docs, k, percent), "links")
        where = pairs.select("a", "b", "ca", "cb").distinct().join(links, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        new = _joined(found, components(where))
        # where a tying pair was none, the pairs that it stood for are open
        failed = pairs.join(links, ["a", "b"], "left_anti").select("key").distinct()
        before, found = found, written(new, "found")
        dropped(part, before)
        if not forest or failed.isEmpty():
            break
        wanted = written(bucket.select("key", "doc_id").join(failed, "key", "left_semi"), "open")
        tried = asked
    dropped(low, bucket, pairs, links, wanted)
    return found


def _joined(found: DataFrame, over: DataFrame) -> DataFrame:
    """Components found, some of which a second graph (id, component) over components ties together."""
    o = over.select(F.col("id").alias("c"), F.col("component").alias("to"))
    kept = found.join(o, found["component"] == o["c"], "left").select("id", F.coalesce("to", "component").alias("component"))
    alone = over.join(found.select("id"), "id", "left_anti")
    return kept.unionByName(alone)


MEMBERS = "array<struct<doc_id:bigint,n:bigint,c:bigint,bits:array<bigint>>>"
#: Pairs of blocks that one step of numpy holds.
AT_ONCE = 16


def _across(part: DataFrame, bits: DataFrame, values: int, percent: int, forest: bool) -> DataFrame:
    """key, a, b, ca, cb: members of one bucket and of different components ca and cb that sketches do not rule out; of each two blocks, if
    forest, only those that tie them together. part: key, doc_id, c; bits: doc_id, n, bits.

    The members of a bucket's largest component are compared with all others, but not with each other.
    """
    sizes = part.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("all"), F.count("*").alias("parts")).filter("parts > 1")
    n = lambda size: F.ceil(size / BLOCK).cast("int")
    blocks = sizes.select("key", F.col("m.c").alias("main"), n(F.col("all") - F.col("m.n")).alias("some"), n(F.col("m.n")).alias("rest"))
    h = F.xxhash64("doc_id")
    place = F.when(F.col("c") == F.col("main"), F.col("some") + F.pmod(h, "rest")).otherwise(F.pmod(h, "some")).cast("int")
    member = part.join(blocks, "key").join(bits, "doc_id").select("key", "some", "rest", place.alias("i"), F.struct("doc_id", "n", "c", "bits").alias("m"))
    block = written(member.groupBy("key", "some", "rest", "i").agg(F.collect_list("m").alias("x")), "blocks")
    within = block.filter("i < some").filter(F.size("x") > 1).select("key", "x", F.array().cast(MEMBERS).alias("y"))
    first = block.filter("i < some").select("key", F.explode(F.sequence(F.col("i") + 1, F.col("some") + F.col("rest"))).alias("i"), "x")
    second = block.select("key", "i", F.col("x").alias("y"))
    both = within.unionByName(first.join(second, ["key", "i"]).select("key", "x", "y"))
    wide, most = -(-values // 16), _most_different(values, percent)

    def columns(lists: pa.Array) -> tuple[np.ndarray, ...]:
        m = lists.flatten()
        ids, n, c = (m.field(i).to_numpy() for i in range(3))
        return lists.offsets.to_numpy() - lists.offsets[0].as_py(), ids, n, c, m.field(3).flatten().to_numpy().view(U).reshape(len(ids), wide + CELLS // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), AT_ONCE):
                batch = whole.slice(start, AT_ONCE)
                (x_at, *x), (y_at, *y) = columns(batch.column(1)), columns(batch.column(2))
                out, keys = [np.zeros((0, 4), np.int64)], []
                for r in range(len(batch)):
                    ids, n, c, sketch = (v[x_at[r] : x_at[r + 1]] for v in x)
                    same = y_at[r] == y_at[r + 1]
                    ids2, n2, c2, sketch2 = (ids, n, c, sketch) if same else (v[y_at[r] : y_at[r + 1]] for v in y)
                    i, j = np.nonzero((c[:, None] != c2) & (100 * n[:, None] >= percent * n2) & (100 * n2 >= percent * n[:, None]))
                    if same:
                        i, j = i[i < j], j[i < j]
                    z = sketch[i, :wide] ^ sketch2[j, :wide]
                    z |= z >> U(2)
                    z |= z >> U(1)
                    few = np.bitwise_count(z & U(0x1111111111111111)).sum(1, dtype=np.int64) <= most
                    i, j = i[few], j[few]
                    odd = np.bitwise_count(sketch[i, wide:] ^ sketch2[j, wide:]).sum(1, dtype=np.int64)
                    near = np.flatnonzero((100 + percent) * odd <= (100 - percent) * (n[i] + n2[j]))
                    if forest:
                        near = near[np.argsort(odd[near] / (n[i] + n2[j])[near], kind="stable")]
                        near = near[_tying(c[i[near]].tolist(), c2[j[near]].tolist())]
                    i, j = i[near], j[near]
                    out.append(np.where((ids[i] < ids2[j])[:, None], np.c_[ids[i], ids2[j], c[i], c2[j]], np.c_[ids2[j], ids[i], c2[j], c[i]]))
                    keys.append(np.full(len(i), batch.column(0)[r].as_py(), np.int64))
                found = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *[pa.array(found[:, f]) for f in range(4)]], ["key", "a", "b", "ca", "cb"])

    return both.mapInArrow(tidy(run), "key bigint, a bigint, b bigint, ca bigint, cb bigint")


def _tying(a: list[int], b: list[int]) -> list[int]:
    """Places of the edges (a, b), taken in order, that tie together what earlier ones did not."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = v = root[root[v]]
        return v

    out = []
    for at, edge in enumerate(zip(a, b)):
        x, y = map(find, edge)
        if x != y:
            root[x] = y
            out.append(at)
    return out


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that are near-duplicates of an earlier document; rows equal in doc_id and text stay once."""
    found = written(near_duplicates(docs.select("doc_id", "text"), k, percent), "near")
    left = without(docs, found.filter("not kept"))
    repeated = found.filter("doc_id is not null and kept").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        return left
    return without(left, repeated).unionByName(left.join(repeated, "doc_id", "left_semi").select(*[left[f"`{c}`"] for c in left.columns]).dropDuplicates(["doc_id", "text"]))


def op3_minmax_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4)


SQL = {"op3_minmax_dedup": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS MATERIALIZED (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
    r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
    m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id, c = d.doc_id AS kept FROM documents d JOIN m ON id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""}
