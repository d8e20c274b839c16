import collections
import math
import random

import numpy as np
import pytest

from tessera.llm import mixing, topk

VECTORS = "vec_id long, embedding array<float>, rank int, score string"
DOCS = "doc_id long, text string, source string, tokens int, hash string, row int"


def brute(rows, queries, k):
    def whole(e):
        ok = e is not None and all(x is not None and math.isfinite(x) for x in e)
        return [math.floor(256 * float(np.float32(x))) for x in e] if ok else None

    good = [(i, w) for i, e in rows if i is not None and (w := whole(e)) is not None]
    out = []
    for q in sorted({i for i, _ in good} & queries):
        own = next(w for i, w in good if i == q)
        scores = sorted((-sum(a * b for a, b in zip(own, w, strict=True)), i) for i, w in good if i != q and len(w) == len(own))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return out


@pytest.mark.parametrize("seed, kind", [(1, "normal"), (2, "sparse"), (3, "ties")])
def test_search_as_brute_force(spark, monkeypatch, seed, kind):
    monkeypatch.setattr(topk, "SHARD", 60)
    monkeypatch.setattr(topk, "BLOCK", 7)
    r = random.Random(seed)
    make = {"normal": lambda: r.gauss(0, 0.3), "sparse": lambda: abs(r.gauss(0, 1)) if r.random() < 0.15 else 0.0, "ties": lambda: r.choice([-0.5, 0.0, 0.5])}[kind]
    rows = [(i, [make() for _ in range(12)]) for i in range(300)]
    rows += [(400, None), (401, [None] * 12), (402, [float("nan")] * 12), (403, [float("inf")] + [0.0] * 11), (None, [0.1] * 12), (500, [1.0, 2.0]), (510, [3.0, 1.0]), (600, [0.0] * 12)]
    df = spark.createDataFrame([(*x, 1, "s") for x in rows], VECTORS)
    queries = {i for i, _ in rows if i is not None and i % 10 == 0}
    got = topk.search(spark, df, df.where("vec_id % 10 = 0"), 5).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, queries, 5))
    assert topk.search(spark, df.limit(0), df.limit(0), 5).count() == 0


def test_search_of_large_components(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 3)
    r = random.Random(5)
    rows = [(0, [9000.0, 1.0]), (1, [8.0, 3e4]), (50, [9000.0, 2.0]), (100, [-7e4, 0.5])] + [(i, [r.uniform(-1e6, 1e6), r.choice([3e7, 1.5, -2.0])]) for i in range(2, 40)]
    df = spark.createDataFrame([(*x, 1, "s") for x in rows], VECTORS)
    got = topk.search(spark, df, df.where("vec_id % 50 = 0"), 5).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, {0, 50, 100}, 5))
    # Beyond what doubles hold exactly.
    a, b = 2.0**27 + 8, 2.0**26 + 4
    rows = [(0, [a, b, 1 / 256]), (1, [a, b, 1 / 256]), (2, [a, b, 0.0]), (3, [a, -b, 2 / 256]), (4, [-a, b, 0.0])]
    df = spark.createDataFrame([(*x, 1, "s") for x in rows], VECTORS)
    with pytest.raises(Exception, match="too large|OverflowError|overflow"):
        topk.search(spark, df, df.where("vec_id = 0"), 2).collect()
    rows = [(i, [x / 16 for x in e[:2]] + e[2:]) for i, e in rows]
    df = spark.createDataFrame([(*x, 1, "s") for x in rows], VECTORS)
    got = topk.search(spark, df, df.where("vec_id = 0"), 5).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, {0}, 5))
    empty = spark.createDataFrame([(0, [], 1, "s"), (1, [], 1, "s")], VECTORS)
    assert [tuple(x) for x in topk.search(spark, empty, empty.where("vec_id = 0"), 5).collect()] == [(0, 1, 1, 0)]


def corpus(seed, n=600):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        source = r.choices(["hot", "a", "b", "c", None], [60, 20, 10, 7, 3])[0]
        rows.append((i, r.choice(["", None]) if r.random() < 0.02 else " ".join("w" for _ in range(r.randint(1, 60))), source, 1, "h", 2))
    return rows


def by_bisection(size, entropy, repeats):
    """The target weights of sources of these sizes for a budget of their sum."""
    share = size / size.sum()

    def of(a):
        w = np.exp(a * np.log(share / share.max()))
        w /= w.sum()
        return w, -(w * np.log(w)).sum(), (w / share).max()

    low, high = 0.0, 4096.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if of(mid)[1] > entropy * math.log(len(size)) else (low, mid)
    if of(low)[2] > repeats:
        good, bad = 1.0, low
        for _ in range(100):
            mid = (good + bad) / 2
            good, bad = (mid, bad) if of(mid)[2] <= repeats else (good, mid)
        low = good
    return of(low)[0]


@pytest.mark.parametrize("sizes, entropy, repeats", [([100, 90, 110, 95], 0.9, 4.0), ([100, 90, 110, 95], 0.9, 1.3), ([1000, 5, 30, 2], 0.9, 50.0), ([1000, 5, 30, 2], 0.9, 3.0), ([7, 7, 9], 0.99, 2.0)])
def test_weights_meet_the_target_from_both_sides(spark, sizes, entropy, repeats):
    rows = [(i, "w " * n, f"s{i}", 1, "h", 2) for i, n in enumerate(sizes)]
    plan = {r.source: r.weight for r in mixing.plan(spark, spark.createDataFrame(rows, DOCS), entropy, repeats).collect()}
    want = by_bisection(np.array(sizes), entropy, repeats)
    assert np.abs(np.array([plan[f"s{i}"] for i in range(len(sizes))]) - want).max() < 1e-5
    assert np.abs(want - np.array(sizes) / sum(sizes)).max() > 1e-3


def test_schedule_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BITS", 3)
    df = spark.createDataFrame(corpus(8), DOCS)
    keyed = mixing._keyed(df.select("doc_id", "text", "source")).select("doc_id", "source", "tokens", "hash", mixing._key(0).alias("k0"), mixing._key(1).alias("k1")).collect()
    want = collections.Counter()
    size = collections.Counter()
    for r in keyed:
        size[r.source] += r.tokens
    names = sorted(size)
    for s, w in zip(names, by_bisection(np.array([size[s] for s in names]), 0.9, 3.0), strict=True):
        epochs, left = divmod(round(w * sum(size.values())), size[s])
        own = [r for r in keyed if r.source == s]
        want.update({r.doc_id: epochs if r.tokens else max(1, epochs) for r in own})
        for r in sorted((r for r in own if r.tokens), key=lambda r: (r.k0, r.k1, r.hash, r.doc_id)):
            left -= r.tokens
            if left < 0:
                break
            want[r.doc_id] += 1
    got = mixing.schedule(spark, df, entropy=0.9, repeats=3.0).collect()
    assert collections.Counter(r.doc_id for r in got) == +want
    assert {r.epoch for r in got if r.doc_id == got[0].doc_id} == set(range(want[got[0].doc_id]))


def test_the_registered_mixture_mixes(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shares = {r.source: r.tokens for r in mixing.plan(spark, docs).collect()}
    plan = {r.source: r for r in mixing.plan(spark, docs).collect()}
    total = sum(shares.values())
    assert max(abs(plan[s].weight - shares[s] / total) for s in shares) > 0.01
    out = mixing.mixed(spark, docs)
    out.write.parquet(f"{tmp_path}/m")
    read = [r.doc_id for r in spark.read.parquet(f"{tmp_path}/m").collect()]
    order = [r.doc_id for r in mixing.schedule(spark, docs).orderBy("epoch", "block", "place", "doc_id").collect()]
    assert collections.Counter(read) == collections.Counter(order) and len(set(order)) < len(order)
    assert read == order


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BITS", 3)
    rows = corpus(1)
    df = spark.createDataFrame(rows, DOCS)
    size = collections.Counter()
    for _, t, s, *_ in rows:
        size[s or "\0"] += len((t or "").split())
    plan = {r.source: r for r in mixing.plan(spark, df, entropy=0.9, repeats=3.0).collect()}
    total = sum(size.values())
    weights = np.array([plan[s].weight for s in size])
    assert abs(weights.sum() - 1) < 1e-6
    assert np.abs(weights - by_bisection(np.array([size[s] for s in size]), 0.9, 3.0)).max() < 1e-6
    out = mixing.mixed(spark, df, entropy=0.9, repeats=3.0)
    assert out.columns == df.columns
    got = out.collect()
    times = collections.Counter(r.doc_id for r in got)
    spent = collections.Counter()
    for r in got:
        spent[r.source or "\0"] += len((r.text or "").split())
    longest = 60
    for s, p in plan.items():
        assert p.budget - longest * 2 <= spent[s] <= p.budget
        own = [times[i] for i, t, x, *_ in rows if (x or "\0") == s and t]
        assert max(own) - min(own) <= 1 and min(own) == p.epochs
    assert all(times[i] >= 1 for i, t, *_ in rows if not t)
    plain = mixing.schedule(spark, df, entropy=0.9, repeats=3.0).collect()
    assert collections.Counter(r.doc_id for r in plain) == times


def test_even_sources_stay(spark):
    rows = [(i, "a b c", "xy"[i % 2], 1, "h", 2) for i in range(40)]
    assert sorted(r.doc_id for r in mixing.mixed(spark, spark.createDataFrame(rows, DOCS)).collect()) == list(range(40))
    assert mixing.mixed(spark, spark.createDataFrame([], DOCS)).count() == 0
    only = spark.createDataFrame([(1, None, None, 1, "h", 2), (1, None, None, 1, "h", 2)], DOCS)
    assert mixing.mixed(spark, only).count() == 2
