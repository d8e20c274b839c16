import random

import pytest

from tessera.llm import ngram_join

SCHEMA = "doc_id long, text string, key string, bands string"


def brute(docs, n=5, threshold=0.8):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    sets = [shingles(t) for _, t in docs]
    links = [0] * len(docs)
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, low[root(i)], links[i]) for i, (d, _) in enumerate(docs))


def corpus(seed):
    r = random.Random(seed)
    docs = []
    for _ in range(25):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.choice([1, 3, 5, 6, 40, 120]))]
        for _ in range(r.choice([1, 1, 2, 3, 40])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                w[r.randrange(len(w))] = f"x{r.randint(0, 9)}"
            docs.append(" ".join(w) if r.random() < 0.8 else "\n ".join(w).upper())
    docs += ["", None, "  \n", docs[0], docs[0]]
    r.shuffle(docs)
    return [(i * 7 % 1009, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed, block", [(1, 128), (2, 4)])
def test_as_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, "k", "b") for d in docs], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in ngram_join.classes(spark, df).collect())
    assert got == brute(docs)
    kept = sorted(r.doc_id for r in ngram_join.one_of_each(spark, df).collect())
    assert kept == sorted({c for _, c, _ in got})


def test_a_hot_bucket(spark):
    r = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    docs = [(i, " ".join(w if r.random() > 0.003 else f"x{r.randint(0, 10**6)}" for w in base)) for i in range(1500)]
    got = {x.doc_id: (x.class_id, x.n_links) for x in ngram_join.classes(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect()}
    want = {d: (c, n) for d, c, n in brute(docs)}
    assert {d: c for d, (c, _) in got.items()} == {d: c for d, (c, _) in want.items()}
    # MinHash may miss a pair at the threshold in 2000; the join links no pair that isn't one.
    assert all(want[d][1] * 0.995 <= n <= want[d][1] for d, (_, n) in got.items())


def test_repeated_rows_and_ids(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, a, "x"), (1, a, "x"), (1, a, "y"), (2, a, "z"), (3, b, "x"), (3, a, "x"), (4, b, "q"), (None, a, "n"), (None, a, "n"), (5, "", "e"), (5, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = sorted(map(tuple, ngram_join.one_of_each(spark, df).collect()), key=str)
    # 3 is the first of those with the other text; nulls take no part.
    assert [x[0] for x in kept] == [1, 3, 3, 5, None, None] and kept[0][1] == a and kept[0][2] in "xy"
    assert ngram_join.one_of_each(spark, df.limit(0)).count() == 0


def test_empty_and_null_ids(spark):
    assert ngram_join.classes(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e", "", ""), (3, "a b c d e", "", "")], SCHEMA)
    assert sorted(map(tuple, ngram_join.classes(spark, df).collect()), key=str) == [(3, 3, 0), (None, None, 0)]


def test_bands():
    bands, rows = ngram_join.bands_and_rows()
    assert 1 - (1 - 0.8**rows) ** bands >= ngram_join.RECALL


def test_texts_are_dealt_out_once(spark):
    """Rows were dealt out twice, each time with a second copy of the text, to find the least of rows that repeat an id, of which there were none."""
    rows = [(i, f"{i} b c d e f g", "x") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    plan = lambda d: ngram_join.one_of_each(spark, d)._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan(df) and "min_by" in plan(df.unionByName(df.limit(1)))
    assert sorted(map(tuple, ngram_join.one_of_each(spark, df.unionByName(df)).collect())) == rows == sorted(map(tuple, ngram_join.one_of_each(spark, df).collect()))
