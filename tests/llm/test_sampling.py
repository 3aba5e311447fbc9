"""Importance resampling, whitening and inner-product search against brute force and odd inputs."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilmark.llm import importance, queries, topk, whitening

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


# Importance resampling


def brute_features(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_resample(docs, target, num, den, least, seed):
    s = Counter(b for _, t in docs for b in brute_features(t)[1])
    t = Counter(b for x in target for b in brute_features(x)[1])
    big_s, big_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in s}
    out = []
    for d, text in docs:
        n, f = brute_features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], (1 << 63) - 1 if r[0] is None else r[0], r[2], r[3]))
    for i in range(len(able) * num // den):
        able[i][5] = i + 1
    return sorted((tuple(r) for r in out), key=str)


def drawn(df):
    return sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


ODD = [None, "", " \n\t ", "one", "Two WORDS", "a b c a b c", "x " * 3000, "É é ß İ 日本 😀 q", "long" * 500 + " tail " + "z" * 70 + " z", "a-b_c.d'e", "\x00a\x7fb", "[UPPER]`lower{", "ab"]


def test_features_are_those_of_brute_force():
    r = random.Random(5)
    texts = ODD + ["".join(r.choice("aB9 -é日\n") for _ in range(r.randrange(60))) for _ in range(300)]
    places, buckets, words = importance.features(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        n, want = brute_features(t)
        assert words[i] == n and sorted(buckets[places == i]) == sorted(want), t


def test_features_of_no_texts():
    places, buckets, words = importance.features(pa.array([], pa.string()))
    assert not len(places) and not len(buckets) and not len(words)


@pytest.mark.parametrize(("share", "least"), [((5, 100), 20), ((1, 2), 1), ((1, 1), 0), ((0, 1), 0)])
def test_resampling_against_brute_force(spark, share, least):
    r = random.Random(share[1])
    words = [f"w{i}" for i in range(40)]
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, " ".join(r.choice(words) for _ in range(r.randrange(60)))) for i in range(80)] + [(None, "a b c"), (-7, "w1 w2 w3"), (3, "one"), (3, "one"), (3, "one")]
    target = ["w1 w2 w3 w4", "w1 w2", None, "日本 q"]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), share=share, least_words=least, seed=42)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert drawn(got) == brute_resample(docs, target, *share, least, 42)


def test_resampling_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "mine", 7, 8), (2, None, "yours", None, 9)], "doc_id bigint, text string, order string, rank int, at int")
    none = spark.createDataFrame([], "text string")
    got = importance.resample(docs, none, share=(1, 1), least_words=0)
    assert [(r.doc_id, r.order, r.at, r["rank"]) for r in got.orderBy("doc_id").collect()] in ([(1, "mine", 8, 1), (2, "yours", 9, 2)], [(1, "mine", 8, 2), (2, "yours", 9, 1)])
    assert importance.resample(docs.limit(0), none).count() == 0
    assert {r["rank"] for r in importance.resample(docs, none, least_words=100, share=(1, 1)).collect()} == {None}


@pytest.mark.parametrize("spread", [3, 5000, 1 << 62])
def test_kth_is_that_of_sorting(spark, spread):
    r = random.Random(spread)
    rows = [(r.randrange(-spread, spread), r.choice([-(1 << 63), (1 << 63) - 1, 0, *range(20)])) for _ in range(500)]
    df = spark.createDataFrame(rows, "s bigint, i bigint")
    want = sorted(rows, key=lambda x: (-x[0], x[1]))
    for k in (1, 2, 250, 499, 500):
        assert importance.kth(df, "s", "i", k) == want[k - 1]
    assert importance.kth(df, "s", "i", 0) is None and importance.kth(df, "s", "i", 501) is None


@tables
def test_resampling_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute_resample(docs, target, 5, 100, 20, 42)
    got = queries.op11_importance(spark, SF)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(((a, c, d, e, f) for a, _, c, d, e, f in want), key=str)
    assert set(dict(got.dtypes).values()) == {"bigint"}


# Whitening


def brute_whitening(vectors, scale, offset, components):
    rows = [[math.floor(scale * c) + offset for c in v] for v in vectors]
    fit = sorted(set(map(tuple, rows)))
    n, d = len(fit), len(fit[0])
    sums = [sum(c) for c in zip(*fit, strict=True)]
    z = [[n * c - s for c, s in zip(v, sums, strict=True)] for v in fit]
    cov = np.array([[sum(v[i] * v[j] for v in z) / n**3 for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    white = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in rows]) @ axes / np.sqrt(values)
    return n, [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in rows], white, values / np.trace(cov)


def close(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return np.allclose(a * np.sign((a * b).sum(axis=0)), b, rtol=1e-6, atol=1e-6)


@pytest.mark.parametrize("bits", [1, 19, 20, 21, 40, 61, 90, 200])
def test_limb_products_are_exact(bits):
    r = random.Random(bits)
    z = [[r.randrange(-(1 << bits), 1 << bits) for _ in range(3)] for _ in range(50)]
    got = whitening.products(np.array(z, np.int64 if bits < 62 else object), bits)
    assert [[int(c) for c in row] for row in got] == [[sum(v[i] * v[j] for v in z) for j in range(3)] for i in range(3)]


@pytest.mark.parametrize("big", [0.3, 1e6, 1e14])
def test_whitening_against_brute_force(spark, big):
    g = np.random.default_rng(3)
    vectors = (g.normal(size=(60, 5)) * np.array([1, 2, 3, 4, 5.5]) * big).tolist()
    vectors += vectors[:4] * 5
    odd = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0]), (902, [float("nan")] * 5), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame(list(enumerate(vectors)) + odd, "vec_id bigint, embedding array<double>").withColumns({"x": F.lit("mine"), "made": F.lit(2), "whitened": F.lit(3)})
    got, model = whitening.whiten(df, "embedding", components=4)
    rows = got.orderBy("vec_id").collect()
    n, deviation, white, share = brute_whitening(vectors, 64, 1_000_000, 4)
    assert model.n == n == 60 and [r.vec_id for r in rows] == list(range(len(vectors))) and {(r.x, r.made) for r in rows} == {("mine", 2)}
    assert [r.deviation and int(r.deviation) for r in rows] == [v if v < 10**38 else None for v in deviation]
    assert close([r.whitened for r in rows], white) and np.allclose(model.explained, share, rtol=1e-9) and model.identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    kind = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, None), (2, [])], [(1, [float("nan")])]):
        got, model = whitening.whiten(spark.createDataFrame(rows, kind), "embedding")
        assert got.count() == 0 and model is None
    got, model = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (1, [0.5, 1.0])], kind), "embedding")
    assert [(r.whitened, r.deviation) for r in got.collect()] == [([None, None], 0)] * 2 and model.n == 1 and model.identity_error == 0
    got, model = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [3e38, 1.0])], kind), "embedding")
    assert all(r.whitened[0] is not None and r.whitened[1] is None for r in got.collect()) and model.identity_error < 1e-9


@tables
def test_whitening_query_against_brute_force(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    n, deviation, white, share = brute_whitening([v for _, v in vectors], 64, 1_000_000, 16)
    rows = queries.op12_whitening(spark, SF).orderBy("vec_id", "component").collect()
    assert len(rows) == 16 * len(vectors) and {r.n for r in rows} == {n} and all(r.identity_error < 1e-4 for r in rows)
    assert [r.vec_id for r in rows[::16]] == [i for i, _ in vectors] and [r.deviation for r in rows[::16]] == deviation
    assert np.allclose([r.explained for r in rows[:16]], share, rtol=1e-9) and [r.component for r in rows[:16]] == list(range(1, 17))
    got = np.array([r.whitened for r in rows]).reshape(-1, 16)
    gaps = [i for i in range(16) if all(abs(share[i] - share[j]) > 1e-6 * share[i] for j in range(len(share)) if j != i)]
    assert gaps and close(got[:, gaps], white[:, gaps])


# Search


def brute_search(rows, every, scale, k):
    ints = {i: [math.floor(scale * c) for c in v] for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    out = []
    for q in ints:
        if q % every == 0:
            scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(ints[q], ints[c], strict=True)))), c) for c in ints if c != q)
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def clusters(seed, n, d, spread, size=1.0):
    """Vectors around a few directions with lengths of many sizes, copies, ties, and zeros."""
    g = np.random.default_rng(seed)
    heart = g.normal(size=(6, d))
    v = heart[g.integers(0, 6, n)] + spread * g.normal(size=(n, d))
    v = v * np.exp(g.normal(size=(n, 1))) * size
    v[g.integers(0, n, n // 4)] = v[0]
    v[n // 2] = 0
    return v


@pytest.mark.parametrize(("spread", "size"), [(0.001, 1.0), (0.3, 1.0), (3.0, 1.0), (0.3, 1e12), (0.3, 1e5)])
def test_search_against_brute_force(spark, monkeypatch, spread, size):
    monkeypatch.setattr(topk, "BUCKET", 32)
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "SEED", 24)
    rows = list(enumerate(clusters(9, 300, 8, spread, size).tolist()))
    odd = [(1000, None), (1005, [1.0] * 7 + [None]), (1010, [float("nan")] * 8), (1015, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame(rows + odd + [(None, [1.0] * 8), (2000, [])], "vec_id bigint, embedding array<double>").withColumn("score", F.lit("mine")).repartition(3)
    got = topk.search(df, F.col("vec_id") % 5 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_search(rows + odd, 5, 256, 5)


def test_survivors_lose_nothing_and_prune():
    for seed, spread in ((1, 0.01), (2, 0.2), (3, 2.0)):
        x = np.floor(256 * clusters(seed, 200, 16, spread)).astype(np.int64)
        x = x[np.argsort(-topk.lengths_of(x), kind="stable")]
        q, lengths = x[::7], topk.lengths_of(x)
        scores = topk.exact(q, x)
        least, left = np.sort(scores, axis=1)[:, -6], 0
        for bucket in (slice(0, 60), slice(60, 130), slice(130, 200)):
            kept = set()
            for some, near in topk.survivors(q, topk.needed(least, topk.lengths_of(q)), x[bucket], lengths[bucket]):
                kept |= {(int(a), int(b)) for a in some for b in near}
            inside = scores[:, bucket]
            assert {(int(a), int(b)) for a, b in zip(*np.nonzero((inside >= least[:, None]) & (least[:, None] > 0)), strict=True)} <= kept
            left += len(kept)
        assert spread > 1 or left < 0.7 * scores.size


def test_search_of_odd_tables(spark):
    kind = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, None)], [(50, [float("nan")])], [(1, [1.0]), (2, [2.0])]):
        got = topk.search(spark.createDataFrame(rows, kind), F.col("vec_id") % 50 == 0)
        assert got.count() == 0 and dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    few = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 0.0]), (3, [-1.0, 2.0]), (4, [0.0, 0.0]), (2, [0.0, 0.0])], kind)
    assert sorted(tuple(r) for r in topk.search(few, F.col("vec_id") % 50 == 0).collect()) == [(0, 1, 2, 0), (0, 2, 4, 0), (0, 3, 3, -65536)]


@tables
def test_search_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op13_topk(spark, SF).collect()) == brute_search(rows, 50, 256, 5)
