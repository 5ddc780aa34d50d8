import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm.helpers import EDGES, WORD, frame, lowered

from loomgraph.llm import kneserney as kn
from loomgraph.llm.common import table


def split(text):
    return ["<s>", *WORD.findall(lowered(text)), "</s>"]


class Plain:
    """The model over dictionaries, from the definition."""

    def __init__(self, texts, order):
        self.order, seqs = order, [split(t) for t in texts]
        raw = [Counter(tuple(s[i : i + k]) for s in seqs for i in range(len(s) - k + 1)) for k in range(order + 2)]
        self.words = Counter(w for s in seqs for w in s[1:])
        self.adjusted = {}
        for k in range(1, order + 1):
            if k == order:
                a = {g: n for g, n in raw[k].items() if g != ("<s>",)}
            else:
                a = Counter(g[1:] for g in raw[k + 1])
                a |= {g: n for g, n in raw[k].items() if g[0] == "<s>" and k > 1}
            self.adjusted[k] = a
        self.d = {k: kn.discounts([sum(n == i for n in a.values()) for i in (1, 2, 3, 4)]) for k, a in self.adjusted.items()}
        self.after = {k: defaultdict(lambda: [0, 0.0]) for k in self.adjusted}  # sum of counts, sum of what is taken off
        for k, a in self.adjusted.items():
            for g, n in a.items():
                self.after[k][g[:-1]][0] += n
                self.after[k][g[:-1]][1] += self.d[k][min(n, 3) - 1]

    def p(self, word, before, k=None):
        k = min(len(before) + 1, self.order) if k is None else k
        if not k:
            return 1 / (len(self.words) + 1)
        h = tuple(before[len(before) - k + 1 :])
        lower, found = self.p(word, before, k - 1), self.after[k].get(h)
        if not found:
            return lower
        n = self.adjusted[k].get((*h, word), 0)
        return (n - (self.d[k][min(n, 3) - 1] if n else 0)) / found[0] + found[1] / found[0] * lower

    def score(self, text):
        s = split(text)
        return sum(math.log10(self.p(s[i], s[:i])) for i in range(1, len(s)))


TEXTS = ["The cat sat on the mat", "the cat sat", "a dog sat on the cat", "the dog ran\ton the mat the mat", "", None, "THE cat", "a a a a a a b", "the cat sat on a dog and ran and ran"] * 2 + ["once only words here", "the mat sat"]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_plain(spark, order):
    train = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    plain = Plain(TEXTS, order)
    rows = EDGES + [(i, t) for i, t in enumerate(TEXTS[:9])] + [(50, "the unknown cat sat on unknown"), (None, "the cat"), (0, TEXTS[0])]
    model = kn.fit(train, order)
    assert (model.tokens, model.known) == (plain.words.total(), len(plain.words))
    got = kn.score(frame(spark, rows), model).collect()
    assert len(got) == len(rows)
    for r in got:
        tokens = split(r.text)[1:]
        assert (r.n_tokens, r.n_known) == (len(tokens), sum(t in plain.words for t in tokens))
        assert r.score == pytest.approx(plain.score(r.text), rel=1e-9)
        base = sum(math.log10((plain.words[t] + 1) / (plain.words.total() + len(plain.words) + 1)) for t in tokens)
        assert r.base_score == pytest.approx(base, rel=1e-9)


def test_probabilities_add_up():
    plain = Plain(TEXTS, 3)
    for before in (["<s>"], ["<s>", "the"], ["<s>", "the", "cat"], ["<s>", "nowhere", "the"]):
        assert sum(plain.p(w, before) for w in [*plain.words, "unknown"]) == pytest.approx(1)


def test_query_against_plain(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    plain = Plain([t for i, t in docs if not out(i)], kn.ORDER)
    got = {r.doc_id: r for r in kn.op13_kneser_ney(spark, sf).collect()}
    assert set(got) == {i for i, _ in docs}
    for i, text in docs:
        assert got[i].held_out == out(i) and got[i].train_tokens == plain.words.total()
        assert got[i].score == pytest.approx(plain.score(text), rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_empty_tables_and_names(spark):
    nothing = spark.createDataFrame([], "text string")
    model = kn.fit(nothing)
    r = kn.score(spark.createDataFrame([("a b", 1, "x", 2)], "text string, SCORE int, level string, bucket int"), model).collect()
    assert [x.asDict() for x in r] == [{"text": "a b", "level": "x", "bucket": 2, "n_tokens": 3, "n_known": 0, "base_score": 0.0, "score": 0.0}]
    assert kn.score(nothing, kn.fit(spark.createDataFrame([("a b",)], "text string"))).count() == 0


def test_records_round_trip():
    rng = np.random.default_rng(1)
    words = [rng.choice(rng.integers(0, 1 << 64, 40, np.uint64), 500) for _ in range(3)]
    sums = {"adjusted": rng.integers(0, 300, 500).astype(np.uint64), "total": rng.integers(0, 1 << 40, 500).astype(np.uint64)}
    rows = sorted(zip(*words, sums["adjusted"], sums["total"]))
    w, s = kn.unpack(kn.pack(words, sums))
    assert sorted(zip(*w, s["adjusted"], s["total"])) == rows and set(s) == set(sums)


def test_arrays_hold_large_counts(tmp_path):
    key = np.arange(1000, dtype=np.uint64) * np.uint64(3)
    n = np.arange(1000, dtype=np.uint64) ** np.uint64(4)
    a = kn.Arrays(f"file://{tmp_path}", kn.write_arrays(f"file://{tmp_path}", {"key": key, "n": n}))
    there, at = a.find(np.arange(0, 3100, 5, dtype=np.uint64))
    asked = np.arange(0, 3100, 5)
    assert there.tolist() == [x % 3 == 0 and x < 3000 for x in asked.tolist()]
    assert a.get("n", at).tolist() == [float((x // 3) ** 4) for x in asked[there].tolist()]


def test_blocks_cut_inside_texts(spark, monkeypatch):
    model = kn.fit(spark.createDataFrame([(t,) for t in TEXTS], "text string"), 3)
    (_, t), = kn.blocks(__import__("pyarrow").array(TEXTS))
    look = kn.Lookup(model)
    whole = look.probabilities(t, 0, len(t.word))
    parts = [look.probabilities(t, i, min(i + 7, len(t.word))) for i in range(0, len(t.word), 7)]
    assert np.allclose(whole[0], np.concatenate([p for p, _ in parts])) and np.array_equal(whole[1], np.concatenate([r for _, r in parts]))
