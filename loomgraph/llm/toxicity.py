"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words and the first bytes of its words, hashed; a term's weight is linear, and every two terms that
stand together in a window of consecutive words add the product of their factors, so that an insult beside a mention of a group counts for
more than the two apart. A term enters with a value from 0 to 1, by how little chance explains the labels of its texts. A text scores as its highest
window and its mean window do, calibrated by logistic regression.

Windows overlap by half, so that words up to STRIDE apart meet in one wherever they stand. Fitting and score() cover every window of
every text. The machine is fitted on a sample: at most about MAX_ROWS labelled texts; two thirds fit the machine, the rest calibrate, each counting as
the number of labelled texts that it stands for. Defined cases: null text is empty, an empty text has one window without terms and the score of those;
repeated rows and null doc_ids are scored each; with one label only the score is that label, 0.5 without any; an empty table yields no rows; a column
named score is replaced, other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, labelled_sample, table, text_chunks, with_schema
from .logistic import Logistic, fit_logistic
from .wordhash import PUNCT, U, Words, mix

BITS, FACTORS, WINDOW, STRIDE, PREFIXES = 20, 4, 32, 16, (4, 5)
#: Terms that a word yields.
PER_WORD = 1 + len(PREFIXES)
MAX_ROWS, EPOCHS = 6000, 6
#: Texts of the sample in which a term must stand to be learned; evidence at which its value is a half; what of its log odds its weight is at first, spread
#: of its factors at first, decay and step of both.
LEAST_TEXTS, EVIDENCE, START, SPREAD, DECAY, RATE = 3, 20.0, 0.3, 0.2, 1e-4, 0.1


class Model(NamedTuple):
    """bias; linear weight and factors of each hashed term; which terms are learned; calibration of (highest, mean) window."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    used: np.ndarray
    calibration: Logistic


def window_count(words):
    return np.maximum(1, -(-words // STRIDE) - (WINDOW // STRIDE - 1))


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms word by word, where each window's begin, which text each window is of); every text has a window at least."""
    w = Words(data, offsets, PUNCT)
    n = np.diff(w.first)
    windows = window_count(n)
    of = np.repeat(np.arange(len(n)), windows)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin = w.first[:-1][of] + nth * STRIDE
    flat = np.empty(PER_WORD * len(w.start), np.int64)
    for i, prefix in enumerate((None, *PREFIXES)):
        flat[i::PER_WORD] = mix(w.hashes(prefix) + U(i)) >> U(64 - BITS)
    return flat, PER_WORD * begin, of


def present(flat: np.ndarray, begin: np.ndarray, of: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, term) of the used terms, in order, each once a window however often it stands there."""
    at = np.flatnonzero(used[flat])
    window = np.searchsorted(begin, at, "right") - 1
    # the window before reaches over the first half of this one
    back = np.maximum(window - 1, 0)
    both = (back < window) & (of[back] == of[window]) & (at < begin[back] + PER_WORD * WINDOW)
    pair = np.concatenate([window << BITS | flat[at], back[both] << BITS | flat[at[both]]])
    # sorted in place, then repeats left out: np.unique would hash first, which takes several times as long
    pair.sort()
    pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
    return pair >> BITS, pair & (1 << BITS) - 1


def margins(window: np.ndarray, term: np.ndarray, windows: int, bias: float, linear: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """bias + sum of w + half of ((sum of v)**2 - sum of v**2), of each window."""
    # what does not depend on the other terms is one sum; a row of factors is fetched once
    v = np.ascontiguousarray(factors[term].T, np.float64)
    z = bias + np.bincount(window, linear[term] - 0.5 * np.einsum("ij,ij->j", v, v), windows)
    for x in v:
        z += 0.5 * np.bincount(window, x, windows) ** 2
    return z


def text_features(flat: np.ndarray, begin: np.ndarray, of: np.ndarray, texts: int, m: Model) -> np.ndarray:
    z = np.clip(margins(*present(flat, begin, of, m.used), len(begin), m.bias, m.linear, m.factors), -20, 20)
    first = np.searchsorted(of, np.arange(texts))
    return np.c_[np.maximum.reduceat(z, first), np.add.reduceat(z, first) / np.diff(np.append(first, len(of)))] if texts else np.zeros((0, 2))


def _fit_machine(docs: list[np.ndarray], y: np.ndarray, seed: int = 5) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """docs: terms of a text, word by word. All terms of LEAST_TEXTS texts or more are learned, weights and factors together; the highest
    window by the model so far stands for its text, of a clean text as of a toxic one."""
    size = 1 << BITS
    seen = np.zeros((2, size))
    for d, label in zip(docs, y):
        seen[int(label), np.unique(d)] += 1
    share, n = float(np.mean(y)), seen.sum(0)
    keep = n >= LEAST_TEXTS
    # a term is worth the more, from 0 to 1, the less by chance it can stand in so many toxic and clean texts
    z2 = np.where(keep, (seen[1] - n * share) ** 2 / (np.maximum(n, 1) * share * (1 - share)), 0)
    worth = z2 / (z2 + EVIDENCE)
    odds = np.log((seen[1] + share) / (seen[0] + 1 - share)) - np.log(share / (1 - share))
    rng = np.random.default_rng(seed)
    linear, factors, bias = START * np.clip(odds, -1, 3) * worth, rng.normal(0, SPREAD, (size, FACTORS)) * worth[:, None], -2.0
    g_lin, g_fac, g_bias = np.full(size, 0.1), np.full((size, FACTORS), 0.1), 1.0
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // 64)):
            parts = [docs[i] for i in batch]
            begin, of = [], []
            at = 0
            for j, p in enumerate(parts):
                steps = range(0, PER_WORD * STRIDE * int(window_count(len(p) // PER_WORD)), PER_WORD * STRIDE)
                begin += [at + s for s in steps]
                of += [j] * len(steps)
                at += len(p)
            flat, begin, of = np.concatenate(parts), np.array(begin), np.array(of)
            window, term = present(flat, begin, of, keep)
            z = margins(window, term, len(begin), bias, linear, factors)
            first = np.searchsorted(of, np.arange(len(parts)))
            top = np.array([a + int(np.argmax(z[a:b])) for a, b in zip(first, np.append(first[1:], len(of)))])
            slope = 1 / (1 + np.exp(-np.clip(z[top], -30, 30))) - y[batch]
            for s, w in zip(slope, top):
                t = term[np.searchsorted(window, w) : np.searchsorted(window, w, "right")]
                if len(t):
                    v = factors[t]
                    dv = s * (v.sum(0) - v) + DECAY * v
                    dl = s + DECAY * linear[t]
                    g_lin[t] += dl * dl
                    g_fac[t] += dv * dv
                    linear[t] -= RATE * worth[t] * dl / np.sqrt(g_lin[t])
                    factors[t] -= RATE * worth[t, None] * dv / np.sqrt(g_fac[t])
                g_bias += s * s
                bias -= RATE * s / np.sqrt(g_bias)
    return bias, linear.astype(np.float32), factors.astype(np.float32), keep


def _sample_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From text and further columns: the text's terms instead of it."""
    for b in batches:
        out = []
        for first, end, data, off in text_chunks(b.column(0)):
            flat, begin, of = terms(data, off)
            at = np.append(begin[np.searchsorted(of, np.arange(end - first))], len(flat))
            out += [flat[a:b].astype(np.int32).tobytes() for a, b in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), *b.columns[1:]], ["terms", *b.schema.names[1:]])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, label (1 toxic, 0 not)."""
    sample = labelled_sample(docs, labels, max_rows).select("text", "label", "weight").mapInArrow(_sample_terms, "terms binary, label int, weight double")
    rows = sorted(sample.collect(), key=lambda r: (r["label"], r["terms"]))
    order = np.random.default_rng(3).permutation(len(rows))
    seqs = [np.frombuffer(rows[i]["terms"], np.int32) for i in order]
    y, weight = (np.array([rows[i][c] for i in order], float) for c in ("label", "weight"))
    cut = len(seqs) * 2 // 3
    size = 1 << BITS
    empty = Model(0.0, np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32), np.zeros(size, bool), fit_logistic(np.zeros((len(y), 2)), y, weight))
    if len(set(y[:cut])) < 2 or len(set(y[cut:])) < 2:
        return empty
    m = Model(*_fit_machine(seqs[:cut], y[:cut]), empty.calibration)
    x = np.zeros((len(seqs) - cut, 2))
    for i, s in enumerate(seqs[cut:]):
        begin = np.arange(int(window_count(len(s) // PER_WORD))) * PER_WORD * STRIDE
        x[i] = text_features(s, begin, np.zeros(len(begin), np.int64), 1, m)[0]
    return m._replace(calibration=fit_logistic(x, y[cut:], weight[cut:]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score, from 0 to 1."""
    columns = [c for c in docs.columns if c != "score"]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            out = np.zeros(len(b))
            for first, end, data, off in text_chunks(b.column(b.schema.get_field_index("text"))):
                out[first:end] = m.calibration(text_features(*terms(data, off), end - first, m))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in columns] + [pa.array(out)], [*columns, "score"])

    return docs.mapInArrow(run, with_schema(docs, "score double", "score"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = labels.filter(bucket("doc_id", 3) != 1).select("doc_id", F.col("toxic").alias("label"))
    s = score(docs.select("doc_id", "text"), fit(docs, learn))
    return s.select("doc_id", (bucket("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
