"""Classifiers: accuracy on held-out rows, and defined results for odd rows."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from llm.helpers import EDGES, frame
from pyspark.sql import functions as F

from loomgraph.llm import langid, quality, toxicity
from loomgraph.llm.wordhash import U, mix

SF = "/root/testdata/sf0.01"


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = langid.op5_language_id(spark, SF).filter("held_out").join(docs, "doc_id").filter("lang is not null")
    r = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.avg(F.col("rejected").cast("int")).alias("rejected"), F.min("score").alias("a"), F.max("score").alias("b")).first()
    assert r.right >= 0.95 and r.rejected <= 0.02 and 0 <= r.a <= r.b <= 1


@pytest.mark.parametrize("module, name, label", [(quality, "op9_quality", "quality"), (toxicity, "op2_toxicity", "toxic")])
def test_scores(spark, module, name, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    got = getattr(module, name)(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = got.filter("held_out").join(labels, "doc_id").select("score", "y", "predicted").collect()
    ones, zeros = [r.score for r in rows if r.y == 1], [r.score for r in rows if r.y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert auc >= 0.85, auc
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def _terms(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return toxicity.terms(raw, np.array([0, len(raw)]))


def test_toxic_passage_scores_alike_wherever_it_stands():
    size = 1 << toxicity.BITS
    linear, factors = np.zeros(size, np.float32), np.zeros((size, toxicity.FACTORS), np.float32)
    for word in ("alpha", "omega"):
        whole = _terms(word)[0][0]
        linear[whole], factors[whole] = 0.5, 1
    m = toxicity.Model(0.0, linear, factors, linear != 0, None)
    neutral = [f"n{i}" for i in range(100)]
    for apart in (1, 8, 16):
        passage = ["alpha", *neutral[: apart - 1], "omega"]
        top = []
        for front in range(32):
            flat, begin, of = _terms(" ".join(neutral[:front] + passage + neutral[:70]))
            top.append(toxicity.text_features(flat, begin, of, 1, m)[0, 0])
        assert np.allclose(top, 1 + toxicity.FACTORS), (apart, top)


def test_language_sample_is_small_in_the_driver(spark):
    word = lambda n: F.conv(F.pmod(F.xxhash64("id", F.lit(n)), F.lit(100_000)).cast("string"), 10, 36)
    docs = spark.range(0, 2000, 1, 4).select(F.col("id").alias("doc_id"), F.translate(F.concat_ws(" ", *[word(n) for n in range(200)]), "0123456789", "äöüßéèêñçø").alias("text"), F.concat(F.lit("l"), F.col("id") % 4).alias("lang"))
    plain = 2000 * langid.DIMS * 2
    batch = pa.RecordBatch.from_pandas(docs.select("doc_id", "text", "lang").limit(300).toPandas())
    rows = [z for b in langid._sampled(iter([batch])) for z in b.column(1).to_pylist()]
    assert sum(map(len, rows)) < 300 * langid.DIMS
    assert np.array_equal(langid._unpacked(rows[0]), np.log1p(langid.counts([batch.column(1)[0].as_py()]))[0].astype(np.float16))
    tracemalloc.start()
    try:
        m = langid.fit(docs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # packed rows, and a quarter of them as floats with the copies that clustering makes
    assert m.languages == ["l0", "l1", "l2", "l3"] and peak < 2.2 * plain, peak / plain


def test_whole_texts_are_learned():
    texts = [" ".join(f"w{i}" for i in range(5000)), "", "a b"]
    out = next(toxicity._sample_terms(iter([pa.RecordBatch.from_arrays([pa.array(texts), pa.array([1, 0, 0], pa.int32())], ["text", "label"])])))
    assert [len(t) // 4 // toxicity.PER_WORD for t in out.column(0).to_pylist()] == [5000, 0, 2]


def _margin(flat, begin, i, m):
    """The margin of a window by the definition: each two of its distinct terms add the product of their factors."""
    t = sorted({x for x in flat[begin[i] : begin[i] + toxicity.PER_WORD * toxicity.WINDOW].tolist() if m.used[x]})
    pairs = sum(float(m.factors[a] @ m.factors[b]) for n, a in enumerate(t) for b in t[n + 1 :])
    return m.bias + sum(float(m.linear[a]) for a in t) + pairs


def test_margins_against_brute_force():
    rng = np.random.default_rng(2)
    size = 1 << toxicity.BITS
    m = toxicity.Model(-0.5, rng.normal(0, 0.3, size), rng.normal(0, 0.2, (size, toxicity.FACTORS)), rng.random(size) < 0.5, None)
    for n in (0, 1, 16, 17, 33, 90):
        flat, begin, of = _terms(" ".join(rng.choice(["a", "bb", "ccc", "dddd", "eeeeee", "ffffff"], n)))
        want = [_margin(flat, begin, i, m) for i in range(len(begin))]
        got = toxicity.margins(*toxicity.present(flat, begin, of, m.used), len(begin), m.bias, m.linear, m.factors)
        assert np.allclose(got, want)
        assert np.allclose(toxicity.text_features(flat, begin, of, 1, m)[0], [max(np.clip(want, -20, 20)), np.mean(np.clip(want, -20, 20))])


def _insults(rng, i):
    """Toxic: an insult and a group in one text. Clean: two insults, two groups, or neither; so single words tell nothing."""
    words = [f"w{x}" for x in rng.integers(0, 300, 24)]
    kind = i % 4
    extra = [["insult", "group"], ["insult", "slur"], ["group", "tribe"], []][kind] if i % 8 < 4 else [["slur", "tribe"], ["slur", "insult"], ["tribe", "group"], []][kind]
    for x in extra:
        words.insert(int(rng.integers(0, len(words))), x)
    return " ".join(words), int(kind == 0)


def test_interactions_do_the_work(spark):
    rng = np.random.default_rng(7)
    rows = [(i, *_insults(rng, i)) for i in range(2400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    m = toxicity.fit(df.filter("doc_id < 1600").select("doc_id", "text"), df.filter("doc_id < 1600").select("doc_id", "label"))
    test = df.filter("doc_id >= 1600")

    def wrong(model):
        return sum((r.score >= 0.5) != r.label for r in toxicity.score(test, model).collect())

    full, without = wrong(m), wrong(m._replace(factors=np.zeros_like(m.factors)))
    assert full <= 40 and without >= full + 100, (full, without)


def test_difference_against_brute_force():
    rng = np.random.default_rng(1)
    good, bad = ([" ".join(rng.choice(words, 200)).encode() for _ in range(60)] for words in (["lovely", "prose", "reads", "well"], ["buy", "now", "$$$", "click"]))
    dictionaries = [quality.dictionary(x) for x in (good, bad)]
    of = quality.Difference(*dictionaries)
    for text in (b"", b"lovely prose", b"buy now " * 500, "h\u00e4h".encode() * 100):
        blocks = [text[i : i + quality.BLOCK] for i in range(0, len(text), quality.BLOCK)] or [b""]
        g, q = ([len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(b)) for b in blocks] for d in dictionaries)
        assert of(text) == pytest.approx(np.mean([(y - x) / max(x, y) for x, y in zip(g, q)]))
    assert of(b"lovely prose reads well") > 0 > of(b"buy now click $$$")


def test_score_is_the_calibrated_difference(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(200)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    m = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    of = quality.Difference(m.good, m.bad)
    got = {r.doc_id: (r.score, of((r.text or "").encode())) for r in quality.score(docs, m).collect()}
    by_difference = [s for s, _ in sorted(got.values(), key=lambda x: x[1])]
    assert by_difference == sorted(by_difference) and len(set(by_difference)) > 100


def _plain_counts(text):
    """N-gram counts of a text by the definition."""
    out = np.zeros(langid.DIMS)
    folded = " " + "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text) + " "
    folded = re.sub(" +", " ", folded)
    for n in langid.LENGTHS:
        for i in range(len(folded) - n + 1):
            h = 0
            for c in folded[i : i + n]:
                h = (h << 21 | ord(c)) & (1 << 64) - 1
            out[int(mix(np.array([h + n & (1 << 64) - 1], U))[0]) >> 52] += 1
    return out


def test_language_against_brute_force(monkeypatch):
    texts = ["", "A", "Der Hund, der bellt!", "l'\u00e9t\u00e9 \u00e0 la mer 12", "x" * 50 + " yz " * 30, "\u6f22\u5b57 \U0001d4d0 a"]
    want = np.stack([_plain_counts(t) for t in texts])
    assert (langid.counts(texts) == want).all()
    monkeypatch.setattr(langid, "CHARS", 7)  # chunks count each n-gram once
    assert (langid.counts(texts) == want).all()


def test_nearest_centroid_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(150)
    m = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    for r in langid.predict(docs, m).collect():
        v = np.log1p(_plain_counts(r.text or "")) * m.idf
        cos = m.centroids.astype(float) @ v / max(1e-12, np.linalg.norm(v))
        best = int(np.argmax(cos))
        assert r.lang_pred == m.languages[m.owner[best]] and abs(r.cosine - cos[best]) < 1e-4
        assert r.rejected == (cos[best] < m.radius[m.owner[best]]) or abs(cos[best] - m.radius[m.owner[best]]) < 1e-4


def test_unlearned_languages_and_junk_are_rejected(spark):
    m = langid.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    rng = np.random.default_rng(3)
    junk = ["".join(rng.choice(list("qxzjkwvp "), 200)) for _ in range(20)]
    odd = ["Это предложение на русском языке, которого модель не знает", "Αυτή είναι μια πρόταση στα ελληνικά", "これは学習されていない言語の文です", *junk]
    assert all(r.rejected for r in langid.predict(frame(spark, list(enumerate(odd))), m).collect())
    clean = langid.predict(spark.read.parquet(f"{SF}/documents.parquet"), m).agg(F.avg(F.col("rejected").cast("int"))).first()[0]
    assert clean <= 0.01


def test_odd_rows(spark):
    rows = [(i, t) for i, t in EDGES] + [(None, "a b"), (104, "one two")]
    docs = frame(spark, rows, "score string, lang_pred string, rejected string", ("s", "l", "r"))
    learn = frame(spark, [(i, "the cat and the dog " * 5 + "abc"[i % 3]) for i in range(30)] + [(i, "le chat et le chien " * 5 + "abc"[i % 3]) for i in range(30, 60)])
    model = langid.fit(learn.withColumn("lang", F.when(F.col("doc_id") < 30, "en").otherwise("fr")))
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) and 0 <= r.score <= 1
    assert {r.lang_pred for r in langid.predict(learn, model).collect()} == {"en", "fr"}
    labels = learn.select("doc_id", (F.col("doc_id") < 30).cast("int").alias("label"))
    for m in (quality, toxicity):
        fitted = m.fit(learn, labels)
        out = m.score(docs, fitted).collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
        right = m.score(learn, fitted).collect()
        assert min(r.score for r in right if r.doc_id < 30) > max(r.score for r in right if r.doc_id >= 30)
        assert m.score(docs.limit(0), fitted).count() == 0
        one = m.score(docs, m.fit(learn, labels.filter("label = 1"))).collect()
        assert min(r.score for r in one) > 0.99
        none = m.score(docs, m.fit(learn, labels.limit(0))).collect()
        assert {r.score for r in none} == {0.5}
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(learn.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}
