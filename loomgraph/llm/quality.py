"""Quality by compression: zstandard dictionaries of good and of bad text, and how much better either compresses a text.

Two dictionaries are trained, one on blocks of texts labelled 1 and one on blocks of as many texts labelled 0. Every block of a text is
compressed with both. The difference of the two sizes, normalised by the larger, is averaged over the text's blocks, and logistic regression on
labelled texts that the dictionaries have not seen calibrates this one number to a score.

Fitted on a sample: at most about MAX_ROWS labelled texts, half of them for the dictionaries; the calibration counts each by the number of labelled texts
that it stands for. Scores cover whole texts. Defined cases: null text is empty and scored as such; repeated rows and null doc_ids are scored each;
without both labels the score is that of the label there is, 0.5 without any; an empty table yields no rows; a column named score is replaced, other
columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket, labelled_sample, table, text_chunks, with_schema
from .logistic import Logistic, fit_logistic

#: Bytes of a block and of a dictionary, compression level, labelled rows that fitting may use.
BLOCK, DICTIONARY, LEVEL, MAX_ROWS = 256, 32 << 10, 1, 6000


class Model(NamedTuple):
    good: bytes
    bad: bytes
    calibration: Logistic


class Difference:
    """By how much better, in parts of the larger size, the good dictionary compresses a text than the bad one; block by block, averaged."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = [self._compressor(d).compress for d in (good, bad)]

    @staticmethod
    def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
        held = None
        if raw:
            held = zstandard.ZstdCompressionDict(raw)
            held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)

    def __call__(self, text: bytes) -> float:
        good, bad = self.by
        total, n = 0.0, 0
        for at in range(0, max(len(text), 1), BLOCK):
            b = text[at : at + BLOCK]
            g, q = len(good(b)), len(bad(b))
            total += (q - g) / max(g, q)
            n += 1
        return total / n


def differences(texts: pa.Array, of: Difference) -> np.ndarray:
    """One for each text, as a column."""
    out = np.zeros((len(texts), 1))
    for first, _, data, off in text_chunks(texts):
        raw = data.tobytes()
        for i in range(len(off) - 1):
            out[first + i] = of(raw[off[i] : off[i + 1]])
    return out


def dictionary(texts: list[bytes]) -> bytes:
    """Trained on the blocks of the texts; of texts too few to train on, all they hold."""
    blocks = [t[at : at + BLOCK] for t in texts for at in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)


def _dictionaries(sample: DataFrame) -> tuple[bytes, bytes]:
    """Of as many texts labelled 1 and 0, in the order of their hashes; a label's bounded number of texts makes one task."""
    ranked = sample.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("text"), "doc_id")))
    counts = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    some = ranked.filter(F.col("rank") <= min(counts.get(0, 0), counts.get(1, 0)))

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"label": rows["label"][:1], "dictionary": [dictionary([(t or "").encode() for t in rows.sort_values("rank")["text"]])]})

    made = {r[0]: bytes(r[1]) for r in some.select("label", "rank", "text").groupBy("label").applyInPandas(train, "label int, dictionary binary").collect()}
    return made.get(1, b""), made.get(0, b"")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, label (1 good, 0 bad)."""
    sample = labelled_sample(docs, labels, max_rows)
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id", "text"), F.lit(2)) == 0
    good, bad = _dictionaries(sample.filter(half))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Difference(good, bad)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(differences(b.column(2), of)[:, 0])], ["label", "weight", "d"])

    rest = sample.filter(~half).select("label", "weight", "text").mapInArrow(measure, "label int, weight double, d double").toPandas()
    got = rest.sort_values(["d", "label", "weight"])
    return Model(good, bad, fit_logistic(got[["d"]].to_numpy(float), got["label"].to_numpy(float), got["weight"].to_numpy(float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score, from 0 to 1."""
    columns = [c for c in docs.columns if c != "score"]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        of = Difference(m.good, m.bad)
        for b in batches:
            s = m.calibration(differences(b.column(b.schema.get_field_index("text")), of))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in columns] + [pa.array(s)], [*columns, "score"])

    return docs.mapInArrow(run, with_schema(docs, "score double", "score"))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = labels.filter(bucket("doc_id", 4) != 2).select("doc_id", F.col("quality").alias("label"))
    model = fit(docs, learn)
    s = score(docs.select("doc_id", "text"), model)
    return s.select("doc_id", (bucket("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
