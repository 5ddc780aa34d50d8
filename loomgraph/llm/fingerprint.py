"""Document fingerprints: an exact digest of the canonical text, confirmed by comparing bytes.

Canonical text: NFKC, case folded, NFKC again, runs of white space as one space, none at the ends. The fingerprint is its xxh3
digest of 128 bits in hex; equal canonical texts have equal fingerprints, and two fingerprints are alike (1.0) or not (0.0).

Defined cases: null text is empty; repeated rows are fingerprinted each and are copies of each other; a null doc_id comes first in
order; an empty table yields no rows; extra columns pass through where a function says so.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, text_chunks, with_schema, written


def canonical(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
        return " ".join(text.split())
    return " ".join(text.lower().split())


def digest(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text).encode("utf-8", "surrogatepass"))


def fingerprint(docs: DataFrame, name: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of text."""
    columns = [c for c in docs.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(b.schema.get_field_index("text"))
            out: list[str] = []
            for first, end, _, _ in text_chunks(text):
                out += map(digest, text.slice(first, end - first).fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in columns] + [pa.array(out, pa.string())], [*columns, name])

    return docs.mapInArrow(run, with_schema(docs, f"`{name}` string", name))


def exact_groups(docs: DataFrame, fingerprints: DataFrame | None = None) -> DataFrame:
    """The rows of fingerprints (docs with their fingerprint, by default) with class_id, the least doc_id of equal canonical texts.

    Rows are counted by digest first. Only digests that occur more than once have their canonical bytes compared: of each
    digest the least and the greatest bytes must be the same, and where they are not, the bytes themselves tell the classes
    apart. All of it is aggregation with partial results, so that a digest of any number of rows is no burden for a task, and rows find their class by
    their digest, so that repeated and null doc_ids keep theirs. A class of null doc_ids only has none.
    """
    fp = fingerprints if fingerprints is not None else written(fingerprint(docs.select("doc_id", "text")).drop("text"), "fingerprints")
    counted = written(fp.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")), "digests")
    shared = counted.filter("n > 1").select("fingerprint")
    some = _canonical_bytes(docs, _bitmap(shared))
    # the least and the greatest are taken before the join, so that the copies of a text combine where they are
    compared = some.groupBy("fingerprint").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high")).filter("low <> high")
    clash = written(compared.join(shared, "fingerprint", "left_semi").select("fingerprint"), "clashes")
    whole = fp.join(counted.select("fingerprint", "class_id"), "fingerprint")
    if clash.isEmpty():
        return whole
    # different texts of one digest: which bytes a row has is found by its id
    told = some.join(clash, "fingerprint", "left_semi")
    parts = told.groupBy("fingerprint", "bytes").agg(F.min("doc_id").alias("class_id"))
    of = told.join(parts, ["fingerprint", "bytes"]).groupBy("doc_id", "fingerprint").agg(F.min("class_id").alias("class_id"))
    of = of.select(F.col("doc_id").alias("_d"), F.col("fingerprint").alias("_f"), "class_id")
    rest = fp.join(of, (fp["fingerprint"] == of["_f"]) & fp["doc_id"].eqNullSafe(of["_d"])).drop("_d", "_f")
    return whole.join(clash, "fingerprint", "left_anti").unionByName(rest)


#: Bits of the filter below; it has one megabyte whatever the number of digests.
FILTER_BITS = 23


def _bitmap(shared: DataFrame) -> np.ndarray:
    """A filter of fixed size that every shared digest passes, by the first digits of the digest."""
    at = F.conv(F.substring("fingerprint", 1, 6), 16, 10).cast("long") % (1 << FILTER_BITS)
    words = shared.select(at.alias("at")).select(F.shiftright("at", 5).alias("word"), F.expr("shiftleft(1L, cast(at % 32 as int))").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << FILTER_BITS - 5, np.uint32)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def _canonical_bytes(docs: DataFrame, passing: np.ndarray) -> DataFrame:
    """doc_id, fingerprint, bytes (the canonical text, compressed: equal bytes compress to equal ones) of those that pass the filter."""
    held = docs.sparkSession.sparkContext.broadcast(passing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, words = zstandard.ZstdCompressor(level=1), held.value
        for b in batches:
            for first, end, _, _ in text_chunks(b.column(1)):
                out = []
                for doc, t in zip(b.column(0).slice(first, end - first).to_pylist(), b.column(1).slice(first, end - first).to_pylist()):
                    raw = canonical(t or "").encode("utf-8", "surrogatepass")
                    h = xxhash.xxh3_128_hexdigest(raw)
                    at = int(h[:6], 16) % (1 << FILTER_BITS)
                    if words[at >> 5] >> np.uint32(at & 31) & 1:
                        out.append((doc, h, z.compress(raw)))
                doc, h, raw = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(doc, b.schema.field(0).type), pa.array(h, pa.string()), pa.array(raw, pa.binary())], ["doc_id", "fingerprint", "bytes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string, bytes binary")


def likeness(a: str, b: str) -> float:
    """1.0 if the texts' digests and then their canonical bytes are equal, else 0.0."""
    return float(digest(a) == digest(b) and canonical(a) == canonical(b))


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the beginning of the following text, or by all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


NEXT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edge int, part int, text string"


def _compare(doc: int | None, text: str, following: str, edge: int = 0) -> tuple:
    own, new = canonical(text), edited(text, following)
    fp, efp, nfp = digest(text), digest(new), digest(following)
    return (
        doc, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), fp, efp,
        float(fp == efp and own == canonical(new)), float(fp == nfp and own == canonical(following)), edge, None, None,
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in NEXT.split(", ")])


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a sorted partition against the next; of its first (edge 1) and last (edge 2) row the texts besides."""
    before, rows, part = None, [], TaskContext.get().partitionId()
    for b in batches:
        for first, end, _, _ in text_chunks(b.column(1)):
            for doc, text in zip(b.column(0).slice(first, end - first).to_pylist(), b.column(1).slice(first, end - first).fill_null("").to_pylist()):
                if before is None:
                    rows.append((doc, None, None, None, None, None, None, 1, part, text))
                else:
                    rows.append(_compare(*before, text))
                before = doc, text
            if rows:
                yield _batch(rows)
            rows = []
    if before is not None:
        yield _batch([(before[0], None, None, None, None, None, None, 2, part, before[1])])


def _over_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if len(b):
            yield _batch([_compare(*r) for r in zip(*(c.to_pylist() for c in b.columns))])


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and how they compare with each other and with the next document's, by doc_id.

    Texts are range partitioned once. Within a partition each row meets the next; what remains is one pair for each two
    neighbouring partitions, last row and first row, joined by their order.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    all_rows = written(row.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(_along, NEXT), "next")
    # two rows a partition: the order of the edges is found from ids alone, then their texts are joined
    edges = written(all_rows.filter("edge > 0").select("doc_id", "edge", "part", "text"), "edges")
    order = Window.orderBy("part", "edge")
    ranked = edges.select("edge", "part").withColumn("next", F.lead("part").over(order))
    ranked = ranked.withColumn("least", F.first("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    pairs = ranked.filter("edge = 2").select("part", F.coalesce("next", "least").alias("to"))
    first = edges.filter("edge = 1").select(F.col("part").alias("to"), F.col("text").alias("following"))
    joined = edges.filter("edge = 2").join(pairs, "part").join(first, "to")
    over = joined.select("doc_id", "text", "following").mapInArrow(_over_edges, NEXT)
    return all_rows.filter("edge = 0").unionByName(over).drop("edge", "part", "text")


def op8_fingerprint(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    compared = written(compare_with_next(docs), "compared")
    return exact_groups(docs, compared)
