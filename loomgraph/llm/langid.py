"""Language identification by the nearest centroid of TF-IDF weighted character n-grams.

A text is a vector of hashed n-gram counts over its folded letters, weighted by inverse document frequency and normalised. Each
language has several centroids, found by spherical k-means among its labelled texts, and a text goes to the language of the
centroid of greatest cosine. A text whose cosine stays below the radius of its language is rejected: below that, no more than
FALSE_REJECTIONS of the language's labelled texts stay that had no part in the centroids.

Counts of the whole text are used. The model is fitted on a sample: of the labelled rows at most about MAX_ROWS, shared out
evenly among the languages and chosen by a hash of doc_id. Defined cases: null text or text without a letter is `und`, score 0,
rejected; without any labelled row every text is `und`; repeated rows and null doc_ids are predicted each; an empty table yields no rows;
extra columns pass through, but for those with the names of the results, which are replaced; `names` gives the results other names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket, give_back, stratified, table, tidy, with_schema
from .wordhash import U, mix

#: Hashed features, n-gram lengths in characters, labelled rows that fitting may use, centroids of a language.
DIMS, LENGTHS, MAX_ROWS, CENTROIDS = 1 << 12, (1, 2, 3), 4000, 4
#: Folds in which labelled texts are held out; the share of those of a language that its radius rejects.
FOLDS, FALSE_REJECTIONS = 5, 0.001
#: Characters that one numpy pass holds, unless a single text is longer.
CHARS = 1_000_000


class Model(NamedTuple):
    languages: list[str]
    centroids: np.ndarray
    owner: np.ndarray
    idf: np.ndarray
    radius: np.ndarray


#: Codes of the characters below 2**16: lower case, 32 for all but letters. Others stand for themselves if they are letters.
_FOLD = np.array([ord(chr(c).lower()) if chr(c).isalpha() and len(chr(c).lower()) == 1 else (c if chr(c).isalpha() else 32) for c in range(1 << 16)], np.uint32)


def _codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = c >= 1 << 16
    out = _FOLD[np.where(high, 32, c)]
    if high.any():
        out[high] = [x if chr(x).isalpha() else 32 for x in c[high].tolist()]
    return out


def folded(text: str) -> np.ndarray:
    """Code points in lower case; runs of other characters are one space, and there is one at either end."""
    out = np.concatenate([[32], *[_codes(text[at : at + CHARS]) for at in range(0, len(text), CHARS)], [32]]).astype(np.uint32)
    return out[np.concatenate([[True], (out[1:] != 32) | (out[:-1] != 32)])]


def counts(texts: list[str]) -> np.ndarray:
    """Hashed n-gram counts, a row for each text."""
    rows = np.zeros((len(texts), DIMS), np.float32)
    for i, text in enumerate(texts):
        c = folded(text)
        for n in LENGTHS:
            # each n-gram begins in one chunk only, so that a long text counts as it would in one piece
            for at in range(0, len(c) - n + 1, CHARS):
                part = c[at : at + CHARS + n - 1].astype(U)
                h = np.zeros(len(part) - n + 1, U)
                for j in range(n):
                    h = (h << U(21)) | part[j : len(part) - n + 1 + j]
                rows[i] += np.bincount((mix(h + U(n)) >> U(52)).astype(np.int64), minlength=DIMS)
    return rows


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    v = counts(texts)
    np.log1p(v, out=v)
    v *= idf
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return v


def _k_means(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical, from starts that are far from each other."""
    c = [v.mean(0)]
    for _ in range(min(k, len(v)) - 1):
        c.append(v[np.argmin(np.max(v @ np.array(c).T, axis=1))])
    centroids = np.array(c)
    for _ in range(rounds):
        own = np.argmax(v @ centroids.T, axis=1)
        centroids = np.array([v[own == i].sum(0) for i in range(len(centroids)) if (own == i).any()])
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    return centroids


def fit(labelled: DataFrame, max_rows: int = MAX_ROWS, centroids: int = CENTROIDS) -> Model:
    """labelled: doc_id, text, lang. Languages without a text that has letters are not learned.

    The sample's counts are compressed on their way to the driver and there; they are unpacked a language at a time.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.regexp_like("text", F.lit(r"\p{L}"))).select("doc_id", "text", "lang")
    sample = stratified(rows, "lang", max_rows).mapInArrow(tidy(_sampled), "lang string, counts binary").collect()
    if not sample:
        return Model([], np.zeros((0, DIMS), np.float32), np.zeros(0, np.int64), np.ones(DIMS, np.float32), np.zeros(0))
    packed: dict[str, list[bytes]] = {}
    held = np.zeros(DIMS, np.int64)
    for r in sample:
        packed.setdefault(r["lang"], []).append(r["counts"])
        held += _unpacked(r["counts"]) != 0
    idf = np.log((1 + len(sample)) / (1 + held)).astype(np.float32) + 1
    del sample
    languages = sorted(packed)
    owner, found, radius = [], [], []
    for i, lang in enumerate(languages):
        own = _weighted(packed.pop(lang), idf)
        c = _k_means(own, centroids)
        found.append(c)
        owner += [i] * len(c)
        # how near texts come to centroids that they had no part in: each fold of them to those of the other folds
        fold = np.arange(len(own)) % FOLDS
        near = [(own[fold == f] @ _k_means(own[fold != f], centroids).T).max(1) for f in range(FOLDS) if len(own) >= FOLDS]
        radius.append(float(np.quantile(np.concatenate(near), FALSE_REJECTIONS)) if near else 0.0)
        del own
    give_back()
    return Model(languages, np.concatenate(found).astype(np.float32), np.array(owner), idf, np.array(radius))


def _weighted(packed: list[bytes], idf: np.ndarray) -> np.ndarray:
    """The vectors of one language's sample, in an order that does not depend on how its rows arrive; only these are unpacked at a time."""
    v = np.empty((len(packed), DIMS), np.float32)
    for i, z in enumerate(sorted(packed, key=lambda z: _unpacked(z).tobytes())):
        v[i] = _unpacked(z)
        v[i] *= idf
        v[i] /= max(float(np.linalg.norm(v[i])), 1e-12)
    return v


def _unpacked(z: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(z), np.float16)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang and counts: compressed logarithms, in half precision, of each text's counts."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        for at in range(0, len(b), 256):
            part = b.slice(at, 256)
            v = np.log1p(counts(part.column(1).to_pylist())).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column(2), pa.array([pack(x.tobytes()) for x in v], pa.binary())], ["lang", "counts"])


def predict(docs: DataFrame, model: Model, names: Sequence[str] = ("lang_pred", "score", "cosine", "rejected")) -> DataFrame:
    """docs with the language, a score (0 to 1), the cosine and whether it is rejected."""
    names = list(names)
    columns = [c for c in docs.columns if c not in names]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        languages = [*m.languages, "und"]
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                texts = [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                letters = np.array([any(map(str.isalpha, t)) for t in texts])
                best, score, cosine = np.full(len(texts), len(m.languages)), np.zeros(len(texts)), np.zeros(len(texts))
                rejected = np.ones(len(texts), bool)
                if len(m.languages) and letters.any():
                    sims = vectors([t for t, has in zip(texts, letters) if has], m.idf) @ m.centroids.T
                    by = np.stack([sims[:, m.owner == i].max(1) for i in range(len(m.languages))], axis=1).astype(np.float64)
                    best[letters], cosine[letters] = by.argmax(1), by.max(1)
                    e = np.exp(20 * (by - by.max(1, keepdims=True)))
                    score[letters] = 1 / e.sum(1)
                    rejected[letters] = by.max(1) < m.radius[by.argmax(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in columns]
                    + [pa.array([languages[i] for i in best], pa.string()), pa.array(score), pa.array(np.clip(cosine, 0, 1)), pa.array(rejected)],
                    [*columns, *names],
                )

    return docs.mapInArrow(tidy(run), with_schema(docs, "`{}` string, `{}` double, `{}` double, `{}` boolean".format(*names), *names))


def learning(folds: int = 5, out: int = 0) -> Column:
    return bucket("doc_id", folds) != out


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(learning()).select("doc_id", "text", "lang"))
    p = predict(docs.select("doc_id", "text"), model)
    return p.select("doc_id", (~learning()).alias("held_out"), "lang_pred", "score", "cosine", "rejected")
