import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from engram.llm import importance, topk_search, whitening
from engram.llm.vectors import products

INF, NAN = float("inf"), float("nan")
VECTORS = "vec_id long, embedding array<double>, x int, key string, q int, score string"


def frame(spark, rows):
    """Vectors with columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, v, 0, "k", 1, "s") for i, v in rows], VECTORS).repartition(3)


def some_vectors(dims=9, n=60, seed=3):
    r = np.random.default_rng(seed)
    v = (r.normal(size=(n, dims)) * np.linspace(1, 3, dims)).tolist()
    rows = [(7 * i % 1000, x) for i, x in enumerate(v)]
    rows += [(500, v[3]), (501, v[3]), (501, v[3]), (None, v[4]), (600, None), (601, [1.0, None] + [0.0] * (dims - 2)), (602, [NAN] * dims), (603, [INF] + [0.0] * (dims - 1)), (604, [])]
    return rows


def usable(rows):
    return [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]


@pytest.mark.parametrize("d", [1, 2, 7, 64])
def test_jacobi(d):
    r = np.random.default_rng(d)
    b = r.normal(size=(d, 3 * d)) * np.logspace(0, -4, d)[:, None]
    m = b @ b.T
    e, v = whitening.jacobi(m)
    assert np.all(np.diff(e) <= 0) and np.allclose(v.T @ v, np.eye(d), atol=1e-13)
    assert np.abs(m @ v - v * e).max() <= 1e-13 * e[0]
    if d > 1:  # against the singular values of the factor, which tell the smallest eigenvalue much better than m does
        small = np.linalg.svd(b, compute_uv=False)[-1] ** 2
        assert e[-1] == pytest.approx(small, rel=1e-9)
    e, v = whitening.jacobi(np.ones((d, d)))  # of rank one
    assert e[0] == pytest.approx(d) and np.abs(e[1:]).max(initial=0) < 1e-13 * d


def test_whitening(spark):
    rows = some_vectors()
    x = {i: [math.floor(64 * c) + 1000000 for c in v] for i, v in usable(rows)}
    fit = np.array(sorted(set(map(tuple, x.values()))), np.int64)
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    centred = fit - fit.mean(0)
    want, axes = np.linalg.eigh(centred.T @ centred / n)
    want, axes = want[::-1], axes[:, ::-1]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == len(usable(rows)) * 9
    assert Counter(r.vec_id for r in got)[501] == 18  # repeated rows
    for r in got:
        k, v = r.component - 1, x[r.vec_id]
        along = float((np.array(v) - np.array(sums) / n) @ axes[:, k] / math.sqrt(want[k]))
        assert abs(abs(r.whitened) - abs(along)) < 1e-9
        assert (r.n, int(r.deviation)) == (n, sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)))
        assert r.explained == pytest.approx(want[k] / want.sum(), rel=1e-9) and r.identity_error < 1e-10


def test_whitening_odd_tables(spark):
    none = whitening.whiten(frame(spark, []))
    assert none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and none.count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert len(one) == 4 and all((r.n, r.whitened, r.explained, r.identity_error, r.deviation) == (1, None, 0.0, None, 0) for r in one)
    mixed = whitening.whiten(frame(spark, [(i, [float(i), 0.0]) for i in range(5)] + [(9, [float(i)]) for i in range(3)]), components=2).collect()
    by_id = {(r.vec_id, r.component): r for r in mixed if r.vec_id < 9}
    assert by_id[0, 2].whitened is None and by_id[0, 1].explained == pytest.approx(1) and len([r for r in mixed if r.vec_id == 9]) == 3
    far = whitening.whiten(frame(spark, [(i, [1e13 * i, float(i % 3)]) for i in range(6)])).collect()
    x = [(math.floor(64e13 * i) + 10**6, 64 * (i % 3) + 10**6) for i in range(6)]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert {(r.vec_id, int(r.deviation)) for r in far} == {(i, sum((6 * c - s) ** 2 for c, s in zip(v, sums, strict=True))) for i, v in enumerate(x)}


def nearest(rows, k, every):
    x = [(i, [math.floor(1024 * c) for c in v]) for i, v in usable(rows)]
    out = []
    for q, a in x:
        if q is not None and q % every == 0:
            found = [(-sum(s * t for s, t in zip(a, b, strict=True)), i is None, i or 0) for i, b in x if i != q and len(b) == len(a)]
            out += [(q, n + 1, None if null else i, -s) for n, (s, null, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("slices, wave_bytes", [(2, 1 << 24), (1, 1 << 24), (4, 300)])
def test_top_k(spark, slices, wave_bytes, monkeypatch):
    monkeypatch.setattr(topk_search, "CANDIDATES", 16)
    monkeypatch.setattr(topk_search, "QUERIES", 3)
    rows = some_vectors() + [(2000 + i, [0.5] * 9) for i in range(80)] + [(4000, [0.5] * 9), (4000, [0.5] * 9), (5000, [0.1, -0.2]), (5001, [-1.0, 2.0])]
    got = topk_search.top_k(frame(spark, rows), every=100, slices=slices, wave_bytes=wave_bytes)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == nearest(rows, 10, 100)


def test_top_k_odd_tables(spark):
    assert topk_search.top_k(frame(spark, [])).count() == 0
    assert topk_search.top_k(frame(spark, [(1, [1.0]), (100, None)])).count() == 0
    assert topk_search.top_k(frame(spark, [(100, [1.0]), (100, [1.0])])).count() == 0  # no candidate but the query's own
    rows = [(100 * i, [2.0 ** (7 * i), -3.0]) for i in range(4)]  # products beyond what doubles hold
    assert sorted(map(tuple, topk_search.top_k(frame(spark, rows)).collect()), key=str) == nearest(rows, 10, 100)
    most = sorted(map(tuple, topk_search.top_k(frame(spark, [(100, [1e30]), (101, [1e30]), (102, [-1e30])])).collect()))
    assert most == [(100, 1, 101, (1 << 63) - 1), (100, 2, 102, 1 - (1 << 63))]  # the nearest long
    a, b = np.array([[1 << 40, 3]]), np.array([[1 << 40], [5]])
    assert products(a, b)[0, 0] == (1 << 80) + 15


TEXTS = "doc_id long, text string, uid int, key string, b1 int, score int"


def corpus(spark, texts):
    return spark.createDataFrame([(i, t, 0, "", 0, 0) for i, t in texts], TEXTS).repartition(3)


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled(docs, target):
    s, t = Counter(b for _, d in docs for b in features(d)), Counter(b for d in target for b in features(d))
    ns, nt = sum(s.values()), sum(t.values())
    out = []
    for i, d in docs:
        f = features(d)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (ns + 10000) / ((s[b] + 1) * (nt + 10000)))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words(d)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, able[: len(able) * 5 // 100]


@pytest.mark.parametrize("segment", [4096, 7])
def test_resample(spark, segment, monkeypatch):
    monkeypatch.setattr(importance, "SEGMENT", segment)
    r = random.Random(5)
    vocabulary = [f"W{i}" for i in range(60)] + ["Élan", "ÉLAN", "naïve", "日本", "x1Y", "İ"]
    line = lambda n: r.choice([" ", "", "--"]) + r.choice([" ", ", ", "\t.\n"]).join(r.choices(vocabulary, k=n)) + r.choice(["", "!", " "])
    docs = [(i, line(r.choice([0, 1, 2, 3, 19, 20, 21, 40, 90]))) for i in range(250)]
    docs += [(1, docs[1][1]), (3, "another text of the same identifier"), (None, line(30)), (900, None), (901, ""), (902, "..."), (903, line(30)), (903, line(30))]
    target = [line(25) for _ in range(6)] + [None, ""]
    aims = spark.createDataFrame([(t, i) for i, t in enumerate(target)], "text string, key int")
    got = importance.resample(corpus(spark, docs), aims).collect()
    want, drawn = resampled(docs, target)
    assert sorted((tuple(x)[:5] for x in got), key=str) == sorted(want, key=str)
    assert [tuple(x)[:5] for x in sorted((x for x in got if x.rank is not None), key=lambda x: x.rank)] == drawn
    assert sorted(x.rank for x in got if x.rank is not None) == list(range(1, len(drawn) + 1)) and len(drawn) > 3


def test_resample_odd_tables(spark):
    empty = spark.createDataFrame([], "text string")
    assert importance.resample(corpus(spark, []), empty).count() == 0
    same = [(1, "same words " * 20)] * 100 + [(None, None)] * 3
    got = importance.resample(corpus(spark, same), empty).collect()
    assert sorted(x.rank for x in got if x.rank) == [1, 2, 3, 4, 5] and len(got) == 103
    assert {(x.n_words, x.n_features) for x in got} == {(40, 117), (0, 0)}


def test_drawn_share(spark):
    """The noise follows its law: of documents of equal weight any is drawn as likely as another, and heavier ones sooner."""
    docs = [(i, " ".join(["wanted" if i % 10 == 0 else f"other{i % 7}"] * 20)) for i in range(2000)]
    aims = spark.createDataFrame([("wanted " * 20,)], "text string")
    drawn = [x.doc_id for x in importance.resample(corpus(spark, docs), aims).where("rank IS NOT NULL").collect()]
    assert len(drawn) == 100 and all(i % 10 == 0 for i in drawn)
