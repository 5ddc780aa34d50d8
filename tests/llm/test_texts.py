"""Tokens, secrets, fingerprints, mixing, and the pipeline, against plain Python."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import tiktoken
from llm.helpers import EDGES, WORD, frame, near
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgraph.llm import bpe, fingerprint as fp, mixing, pipeline, secrets, tokenshards as ts
from loomgraph.llm.common import scratch_path, table, written

MULTI, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


def _tiktoken():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, sf):
    t = _tiktoken()
    docs = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    for r in bpe.op7_byte_bpe(spark, sf).collect():
        ids = t.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_bpe_odd_rows(spark):
    t = _tiktoken()
    df = frame(spark, EDGES + [(104, "a  b c\n\n d"), (None, "日本語のテキスト" * 30)], "ids string", ("x",))
    e = bpe.decode(bpe.encode(df, MULTI), MULTI).collect()
    for r in e:
        assert list(r.ids) == t.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() and r.valid_utf8
    assert bpe.encode(df.limit(0), MULTI).count() == 0


def test_transducer_states_hold_pairs_only():
    """What is still to come out does not tell states apart, so that fewer are made; giving them all up at a bound changes no result."""
    ranks = bpe.read_ranks(MULTI)
    rng = random.Random(4)
    parts = ["the", "tion", "ing", "ö", "漢", "e", "r", "nd", "sh", "\u00e9", "🙂", "st", "0"]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 9))).encode() for _ in range(1500)]
    fst, small = bpe.Transducer(ranks), bpe.Transducer(ranks, 200)
    for w in words:
        want = [ranks[t] for t in fst.merges.parts(w)]
        assert fst.encode(w) == want and small.encode(w) == want
    assert all(len(pair) == 2 for pairs in fst.states for pair in pairs)
    assert len(fst.states) <= fst.moves + 1 and small.moves < fst.moves and fst.encode(b"") == []


def test_streaming_utf8():
    raw = "aé漢🙂".encode()
    u = bpe.Utf8()
    parts = [u.push(raw[i : i + 1]) for i in range(len(raw))]
    assert [p.decode() for p in parts if p] == list("aé漢🙂") and u.close() == b"" and u.valid


def test_decoder_goes_through_the_machine():
    t, d = _tiktoken(), bpe.decoder(MULTI)
    rng = random.Random(2)
    for _ in range(300):
        raw = bytes(rng.choice(b"ab \xc3\xa9\xf0\x9f\x99\x82\xe6\xbc\xa2\xff\x80") for _ in range(rng.randint(0, 30)))
        ids = np.array([t.encode_single_token(raw[i : i + 1]) for i in range(len(raw))], np.int32)
        out, valid = d(ids)
        try:
            raw.decode()
            good = True
        except UnicodeDecodeError:
            good = False
        assert out == raw and valid == good
        assert "".join(d.stream(ids.tolist())).encode(errors="replace").count(b"?") <= len(raw)
    text = "漢字 and 🙂 é"
    ids = t.encode_ordinary(text)
    pieces = list(d.stream(ids))
    assert "".join(pieces) == text and all("\ufffd" not in p for p in pieces)


def test_shards(spark, sf):
    tok = Tokenizer.from_file(JSON)
    start = 0
    want = {}
    for r in sorted(table(spark, sf, "documents").collect(), key=lambda r: r.doc_id):
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in ts.op4_token_shards(spark, sf).collect()} == want


def test_shard_lookup_and_odd_rows(spark):
    df = frame(spark, EDGES + [(104, "again")], "start string", ("x",))
    manifest = ts.write_shards(df, JSON, scratch_path(spark, "shards"))
    assert ts.read_shards(spark, manifest).count() == len(EDGES) + 1
    found = ts.lookup(manifest, spark.createDataFrame([(103,), (104,), (9,), (10**9,)], "doc_id bigint")).collect()
    assert sorted(r.doc_id for r in found) == [103, 104, 104]
    nameless = ts.write_shards(frame(spark, [(None, "a"), (None, None), (-5, "b"), (7, "c")]), JSON, scratch_path(spark, "shards"))
    assert sorted(str(r.doc_id) for r in ts.lookup(nameless, spark.createDataFrame([(None,), (-5,)], "doc_id bigint")).collect()) == ["-5", "None", "None"]
    empty = ts.write_shards(df.limit(0), JSON, scratch_path(spark, "shards"))
    assert ts.read_shards(spark, empty).count() == 0


KEY = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    found = [("assign", m.start(), m.end()) for m in KEY.finditer(text) if len(m[1]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


TRICKY = ["token: abcdef", "token = 'abcde' secret:abcdefg", "API_KEY=\"x.y/z+1=\" apikey : short1", "🙂 passwd:longenough AKIA" + "A1" * 8, "AKIA" + "B" * 15, "f" * 24 + "g" + "0" * 23, "password=token=secret1",
          "ſecret: abcdef toKen: abcdef", "secret:\nabcdefg", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36]


def test_secrets(spark, sf):
    docs = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    for r in secrets.op6_secret_scan(spark, sf).collect():
        spans = base_spans(docs[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_secrets_odd_rows(spark):
    rows = EDGES + [(i, t) for i, t in enumerate(TRICKY)] + [(None, TRICKY[0]), (0, TRICKY[0]), (1, "clean")]
    got = secrets.with_spans(frame(spark, rows, "spans string, n_chars bigint", ("x", 1))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in ("assign", "access", "hex")] == base_spans(r.text or "")
    extra = {s.kind for r in got for s in r.spans} - {"assign", "access", "hex"}
    assert extra == {"pem", "github"}
    clean = {r.text for r in secrets.redact(frame(spark, [(1, "my token: abcdefgh ok"), (2, None), (3, "clean")])).collect()}
    assert clean == {"my [SECRET] ok", None, "clean"}
    assert secrets.with_spans(frame(spark, []).limit(0)).count() == 0


def plain_redact(text, spans, mark="[SECRET]"):
    out, at = "", 0
    for i, (a, b) in enumerate(sorted(spans)):
        if i and a < at:
            at = max(at, b)
            continue
        out, at = out + text[at:a] + mark, b
    return out + text[at:]


def test_redact_against_plain(spark):
    """Overlapping spans, spans side by side, spans over the pieces that texts are cut from."""
    glue = ["é🙂 ", "x " * 700, "password=", "\n\n", "AKIA" + "A1" * 9, "token: " + "0123456789abcdef" * 2, "f" * 30, "secret=ab", " "]
    import random

    rng = random.Random(3)
    rows = [(i, "".join(rng.choices(glue, k=rng.choice([1, 3, 60])))) for i in range(60)] + EDGES + [(i + 90, t) for i, t in enumerate(TRICKY)]
    spans = {(r.doc_id, r.text): r.spans for r in secrets.with_spans(frame(spark, rows)).collect()}
    got = {(i, t) for i, t in rows}
    want = {(i, None if t is None else plain_redact(t, [(s.start, s.end) for s in spans[i, t]])) for i, t in got}
    assert {(r.doc_id, r.text) for r in secrets.redact(frame(spark, rows)).collect()} == want
    assert any(len(s) > 20 for s in spans.values())


def test_many_secrets_in_a_text(spark):
    """Work in proportion to the text: twice as many secrets may take thrice the time, not four times; a warm run of each counts."""
    import time

    def took(n):
        text = "".join(f"user{i} token: abcdef{i} \n" for i in range(n))
        df = frame(spark, [(1, text)]).cache()
        df.count()
        best = 1e9
        for _ in range(2):
            began = time.time()
            (r,) = secrets.redact(df).collect()
            best = min(best, time.time() - began)
        assert r.text == "".join(f"user{i} [SECRET] \n" for i in range(n))
        return best

    took(100)
    few, many = took(10_000), took(20_000)
    assert many < 3 * few + 1 and many < 12


def test_mix_takes_repeated_rows(spark):
    """Every row has its own rank, also among rows equal in all they hold."""
    rows = [(i if i % 9 else None, f"w{i} " * (i % 7), s) for s in ("a", "b", None) for i in range(300) for _ in range(2)] + [(7, "same text", "b")] * 500
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    copies = mixing.sample_copies(df).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("n"), F.first("target").alias("target")).collect()
    size = mixing.words(F.col("text"))
    mixed = {r.source: r.n for r in mixing.mix(df).groupBy("source").agg(F.sum(size).alias("n")).collect()}
    assert mixed == {r.source: r.n for r in copies} and all(abs(r.n - r.target) <= 14 for r in copies)
    assert {tuple(r) for r in mixing.mix(df).collect()} <= set(rows)


def test_trigram_queries():
    assert secrets.trigram_query(r"[0-9a-f]+") is None and secrets.trigram_query("AKIA[A-Z]+") == [frozenset({"aki", "kia"})]


def test_fingerprints(spark, sf):
    rows = sorted((r.doc_id, r.text or "") for r in table(spark, sf, "documents").collect())
    got = {r.doc_id: r for r in fp.op8_fingerprint(spark, sf).collect()}
    first = {}
    for n, (i, text) in enumerate(rows):
        new = fp.edited(text, rows[(n + 1) % len(rows)][1])
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(new.encode()).hexdigest(), fp.digest(text), fp.digest(new))
        assert r.near_edited == float(fp.canonical(text) == fp.canonical(new)) and r.near_next == float(fp.canonical(text) == fp.canonical(rows[(n + 1) % len(rows)][1]))
        assert r.class_id == first.setdefault(fp.canonical(text), i)
    assert len(got) == len(rows)


def test_fingerprint_odd_rows(spark):
    assert fp.digest("ＡＢＣ  x\n") == fp.digest(" abc X") != fp.digest("abcx")
    assert fp.fingerprint(frame(spark, EDGES, "fingerprint int", (1,))).count() == len(EDGES)
    one = fp.compare_with_next(frame(spark, [(5, "abcd")])).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(5, 1.0)]
    assert fp.compare_with_next(frame(spark, EDGES).limit(0)).count() == 0


def test_mixing(spark, sf):
    rows = mixing.op10_systematic_mix(spark, sf).collect()
    again = mixing.op10_systematic_mix(spark, sf).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    docs = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    by = defaultdict(list)
    for r in rows:
        assert r.size == len(WORD.findall(docs[r.doc_id].text or "")) and 0 <= r.taken <= 2 * r.size
        by[docs[r.doc_id].source].append(r)
    assert len(rows) == len(docs)
    total = sum(r.size for r in rows)
    assert abs(sum(v[0].target for v in by.values()) - 1.5 * total) < 1e-6 * total
    for v in by.values():
        assert v[0].source_size == sum(r.size for r in v) and v[0].target <= 2 * v[0].source_size + 1e-9
        assert abs(sum(r.taken for r in v) - v[0].target) <= 2 * max(r.size for r in v)


def test_mixing_odd_rows(spark):
    rows = [(i, t) for i, t in EDGES] + [(None, "a b"), (104, "one two")]
    df = frame(spark, rows).select("doc_id", "text", F.lit("z").alias("size"), F.when(F.col("doc_id") % 2 == 0, "s").alias("source"))
    assert mixing.sample_copies(df).count() == len(rows)
    assert mixing.mix(df).columns == df.columns
    assert mixing.sample_copies(df.limit(0)).count() == 0


def test_pipeline(spark, sf):
    """Each stage on what the one before kept."""
    docs = table(spark, sf, "documents")
    known = written(pipeline.language_id(spark, docs, sf))
    assert known.columns == docs.columns and known.count() >= 0.97 * docs.count()
    kept = written(pipeline.near_dedup(spark, known, sf))
    rows = [(r.doc_id, r.text) for r in known.collect()]
    component, _ = near(rows, 5)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in component.items() if i == c)
    safe = written(pipeline.secret_scan(spark, kept, sf))
    assert safe.count() == kept.count() and not [r for r in safe.collect() if base_spans(r.text or "")]
    mixed = written(pipeline.mix(spark, safe, sf))
    assert mixed.columns == docs.columns
    words = {r.doc_id: len(WORD.findall(r.text or "")) for r in safe.collect()}
    taken = sum(words[r.doc_id] for r in mixed.collect())
    assert abs(taken - 1.5 * sum(words.values())) <= 0.1 * sum(words.values())
    tokens = pipeline.tokenize(spark, mixed, sf).collect()
    t, text = _tiktoken(), {r.doc_id: r.text or "" for r in safe.collect()}
    assert len(tokens) == mixed.count() and all(list(r.ids) == t.encode_ordinary(text[r.doc_id]) for r in tokens)


def _table(spark, path, rows):
    """A folder of tables whose documents are these (doc_id, text, source)."""
    df = spark.createDataFrame([(i, t, None, s, None if t is None else len(t)) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


ODD = [(1, "my token: abcdefgh1 x", "a"), (1, "clean text here", "a"), (2, "same", None), (2, "same", None), (None, "password=hunter22", "b"), (None, None, "b"), (3, "", "a"), (4, "x <|endoftext|> y", "b"), (5, "Same ", "a"), (6, None, None), (7, "f" * 30 + " word " * 700, "a")]


def test_shards_query_on_odd_rows(spark, tmp_path):
    tok = Tokenizer.from_file(JSON)
    path = _table(spark, tmp_path, ODD)
    want, start = [], 0
    for i, t, _ in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in ts.op4_token_shards(spark, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert 50256 in tok.encode(ODD[7][1], add_special_tokens=False).ids


def test_secret_query_on_odd_rows(spark, tmp_path):
    path = _table(spark, tmp_path, ODD)
    got = sorted((str(r.doc_id), r.n_assign, r.n_hex, r.base_sha256) for r in secrets.op6_secret_scan(spark, path).collect())
    want = []
    for i, t, _ in ODD:
        spans = base_spans(t or "")
        want.append((str(i), sum(s[0] == "assign" for s in spans), sum(s[0] == "hex" for s in spans), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    assert got == sorted(want)


def test_trigram_index_against_brute_force(spark):
    rng = random.Random(4)
    words = ["token", "tok", "ken: abcdef", "AKIA", "akiaX", "secret", "sec", " ", "password=", "passwd", "api_key:", "xoxb-", "ghp_", "-----BEGIN PRIVATE KEY-----"]
    rows = [(i * 40_000, "".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for i in range(200)]
    rules = [r for r in secrets.RULES if secrets.trigram_query(r.pattern)]
    grams = sorted({g for r in rules for c in secrets.trigram_query(r.pattern) for g in c})
    index = secrets.trigram_index(frame(spark, rows), grams)
    assert {(r.trigram, i) for r in index.collect() for i in r.ids} == {(g, i) for i, t in rows for g in grams if g in t.lower()}
    got = {(r.kind, r.doc_id) for r in secrets.candidates(index, rules).collect()}
    assert got == {(r.kind, i) for r in rules for i, t in rows if any(all(g in t.lower() for g in c) for c in secrets.trigram_query(r.pattern))}
    assert {(r.kind, i) for r in rules for i, t in rows if re.search(r.pattern, t)} <= got


def _plain_digest(text):
    import unicodedata

    import xxhash

    once = unicodedata.normalize("NFKC", text).casefold()
    return xxhash.xxh3_128_hexdigest(" ".join(unicodedata.normalize("NFKC", once).split()).encode())


def test_fingerprint_query_on_odd_rows(spark, tmp_path):
    path = _table(spark, tmp_path, ODD)
    got = fp.op8_fingerprint(spark, path).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), _plain_digest(t or "")) for i, t, _ in ODD)
    least = {}
    for i, t, _ in ODD:
        if i is not None:
            least[_plain_digest(t or "")] = min(i, least.get(_plain_digest(t or ""), i))
    assert all(r.class_id == least.get(r.fingerprint) for r in got)


def test_plain_fingerprints(spark, sf):
    """Against a digest and an edit written here, not the operator's own."""
    rows = sorted((r.doc_id, r.text or "") for r in table(spark, sf, "documents").collect())
    got = {r.doc_id: r for r in fp.op8_fingerprint(spark, sf).collect()}
    for n, (i, t) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        assert (got[i].fingerprint, got[i].edited_fingerprint, got[i].edited_sha256) == (_plain_digest(t), _plain_digest(new), hashlib.sha256(new.encode()).hexdigest())


def _plain_mix(rows, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets and taken words by source: shares by weight, what is over the cap shared out again until none is above."""
    sizes = defaultdict(list)
    for i, t, s in rows:
        sizes[s].append(len(WORD.findall(t or "")))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[n % 3] for n, s in enumerate(order)}
    size = {s: sum(sizes[s]) for s in order}
    left, open_, target = share * sum(size.values()), set(order), {}
    left = min(left, most * sum(size.values()))
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * size[s]}
        for s in over or set(open_):
            target[s] = most * size[s] if over else level * w[s]
            left -= target[s] if over else 0
        open_ -= over or set(open_)
    return target, size


def test_mixing_against_a_plain_sampler(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([0, 1, 5, 30, 200]), rng.choice(["a", "b", "b", "b", "b", "c", None, "é"])) for i in range(600)]
    path = _table(spark, tmp_path, rows)
    got = mixing.op10_systematic_mix(spark, path).collect()
    target, size = _plain_mix(rows)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for s, v in by.items():
        assert v[0].source_size == size[s] and math.isclose(v[0].target, target[s], rel_tol=1e-9, abs_tol=1e-9)
        rate = target[s] / size[s] if size[s] else 0
        # in order of size, each stretch of documents is taken as often as its expected copies say, but for one
        copies = [r.copies for r in sorted(v, key=lambda r: r.size)]
        by_size = defaultdict(list)
        for r in v:
            by_size[r.size].append(r.copies)
        for n in by_size.values():
            assert abs(sum(n) - rate * len(n)) <= 1
        assert abs(sum(copies) - rate * len(copies)) <= 1 and set(copies) <= {math.floor(rate), math.ceil(rate)}
        assert abs(sum(r.taken for r in v) - target[s]) <= 200


CLASHES = ["gone", "_gone", "_d", "_h", "_s", "_spans", "spans", "asked", "at", "_n", "_id", "_k", "id", "copies", "k", "digest", "of", "score", "cosine", "rejected", "lang_pred", "r", "kept", "component_id", "n_shingles", "ids"]


def test_stages_on_odd_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in ODD], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit(0.25))
    docs = written(docs)
    for stage in (pipeline.language_id, pipeline.near_dedup, pipeline.secret_scan, pipeline.mix):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        rows = out.collect()
        assert all(r[c] == 0.25 for r in rows for c in CLASHES)
        assert stage(spark, docs.limit(0), "").count() == 0
        if stage is pipeline.near_dedup:
            # equal rows of a doc_id once; different texts of it, and null ids, stay; 5 shares no shingle set with 2, as case counts alike: "Same " and "same"
            assert sorted(str((r.doc_id, r.text)) for r in rows) == sorted({str((i, t)) for i, t, _ in ODD if i != 5} | {"(6, None)"})
        if stage is pipeline.secret_scan:
            assert len(rows) == len(ODD) and not any(base_spans(r.text or "") for r in rows)
    assert pipeline.tokenize(spark, docs, "").count() == len(ODD) and pipeline.tokenize(spark, docs.limit(0), "").count() == 0


def test_run_equals_the_stages(spark, sf):
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
    row = lambda r: (r.doc_id, r.lang, r.source, r.n_tokens, tuple(r.ids))
    assert sorted(map(row, docs.collect()), key=str) == sorted(map(row, corpus_pipeline.run(spark, sf).collect()), key=str)
