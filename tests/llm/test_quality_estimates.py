import random

import numpy as np

from tessera.llm import quality
from tessera.llm.common import Scratch

COLUMNS = "g1 string, g2 string, doc_id long, x1 long, x2 long, x3 long, x4 long"
FACTOR = quality.COVER / quality.chi2_cdf(quality.chi2_quantile(quality.COVER, 4), 6)


def estimate(x):
    """Centre and scatter, the latter with the least deviations, of vectors in units."""
    return x.mean(axis=0), np.cov(x.T, bias=True) * FACTOR + np.diag(np.square(quality.FLOOR))


def concentrated(x, centre, scatter):
    """Steps to the nearest part by plain sorting until nothing changes."""
    h = int(np.ceil(len(x) * quality.COVER))
    last = np.inf
    while True:
        d = x - centre
        d2 = np.einsum("ni,ij,nj->n", d, np.linalg.inv(scatter), d)
        centre, scatter = estimate(x[np.argsort(d2, kind="stable")[:h]])
        now = np.linalg.slogdet(scatter)[1]
        if now > last - 1e-9:
            return now, centre, scatter
        last = now


def group(r, kind, n):
    mix = np.array([[1, 0.5, 0, 0], [0, 1, 0, 0.2], [0, 0, 1, 0], [0, 0, 0, 1]])
    x = r.normal(size=(n, 4)) @ mix * [40, 20, 60, 50] + [400, 30, 10, 60]
    if kind == "clustered":
        x[: int(n * 0.2)] = r.normal(size=(int(n * 0.2), 4)) * 8 + [700, 300, 250, 200]
    if kind == "flat":
        x[:, 2:] = 0
    return np.round(x).astype(int)


def test_least_determinants_as_many_random_starts(spark):
    r = np.random.default_rng(5)
    groups = {("a", "s"): group(r, "normal", 400), ("a", "t"): group(r, "clustered", 300), ("b", "s"): group(r, "flat", 200), ("b", "*"): group(r, "clustered", 25)}
    rows, i = [], 0
    for k, x in groups.items():
        for v in x.tolist():
            rows.append((*k, i, *v))
            i += 1
    random.Random(1).shuffle(rows)
    found = {(e.g1, e.g2): e for e in quality.least_determinants(spark.createDataFrame(rows, COLUMNS).repartition(7), Scratch(spark)).collect()}
    again = {(e.g1, e.g2): e for e in quality.least_determinants(spark.createDataFrame(sorted(rows), COLUMNS).repartition(2), Scratch(spark)).collect()}
    assert found == again and set(found) == set(groups)
    for k, x in groups.items():
        x = x / quality.SCALE
        tries = [concentrated(x, *estimate(x[r.choice(len(x), 5, replace=False)])) for _ in range(60)]
        best, centre, scatter = min(tries, key=lambda t: t[0])
        e = found[k]
        # The nearest part is cut between bins of distances, so it may be a few vectors larger.
        assert e.logdet < best + 0.25, k
        mine = np.array([[e[f"c{min(i, j)}{max(i, j)}"] for j in range(4)] for i in range(4)])
        limit = quality.chi2_quantile(quality.KEEP, 4)
        far = [np.einsum("ni,ij,nj->n", x - c, np.linalg.inv(s), x - c) for c, s in ((centre, scatter), (np.array([e[f"m{i}"] for i in range(4)]), mine))]
        clear = np.abs(far[0] - limit) > 0.2 * limit
        assert ((far[0] > limit) == (far[1] > limit))[clear].all() and clear.mean() > 0.9
    # The planted cluster lies beyond the distance, the others within it.
    e, x = found["a", "t"], groups["a", "t"] / quality.SCALE
    assert (np.abs(x[:60].mean(axis=0) - [e[f"m{i}"] for i in range(4)]) > 0.5).all()


def test_equal_vectors_and_empty(spark):
    same = spark.createDataFrame([("a", "s", i, 5, 0, 0, 0) for i in range(30)], COLUMNS)
    e = quality.least_determinants(same, Scratch(spark)).collect()
    assert len(e) == 1 and abs(e[0].m0 - 5 / quality.SCALE) < 1e-12
    assert quality.least_determinants(same.limit(0), Scratch(spark)).count() == 0
