import hashlib
import random
import re

import pytest

from tessera.llm import substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(docs, span):
    first = {}
    own = {}
    for i, t in docs:
        own[i, t] = w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(len(w) - span + 1):
            if i is not None:
                key = tuple(w[k : k + span])
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in own.items():
        gone = set()
        for k in range(len(w) - span + 1):
            if i is not None and first[tuple(w[k : k + span])] < i:
                gone.update(range(k, k + span))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=120):
    r = random.Random(seed)
    passages = [[r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(8, 40))] for _ in range(6)]
    docs = []
    for i in range(n):
        w = []
        for _ in range(r.randint(0, 6)):
            p = list(r.choice(passages)) if r.random() < 0.6 else [f"w{r.randint(0, 10**6)}" for _ in range(r.randint(1, 15))]
            if r.random() < 0.3 and p:
                p[r.randrange(len(p))] = "x"
            w += p[r.randint(0, 3) :]
        docs.append((r.randint(0, 3) * 1000 + i, r.choice([" ", "\n", "  ", "\t"]).join(w)))
    docs += [(9000, docs[3][1]), (-5, docs[7][1]), (None, docs[3][1]), (9001, None), (9002, ""), (9003, " ".join("a" for _ in range(200))), (9004, " ".join("a" for _ in range(150)))]
    return docs


@pytest.mark.parametrize("seed, words", [(1, 200_000), (2, 60), (3, 200), (4, 0)])
def test_as_brute_force(spark, monkeypatch, seed, words):
    monkeypatch.setattr(substrings, "SHARD_WORDS", words)
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, "en", "s", 1) for d in docs], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in substrings.digest(spark, df, span=12, gram=5).collect()), key=str)
    assert got == brute(docs, 12)
    cut = {r.doc_id: r.text for r in substrings.without_repeats(spark, df, span=12, gram=5).where("doc_id IS NOT NULL").collect()}
    sha = {r[0]: r[3] for r in got}
    for i, t in cut.items():
        assert hashlib.sha256(" ".join((t or "").split()).encode()).hexdigest() == sha[i]


def test_a_passage_of_20000_documents(spark):
    r = random.Random(9)
    passage = [f"p{i}" for i in range(70)]
    docs = [(i, " ".join([*(f"a{i}-{k}" for k in range(r.randint(0, 30))), *passage, *(f"b{i}-{k}" for k in range(20))])) for i in range(20_000)]
    df = spark.createDataFrame([(*d, "en", "s", 1) for d in docs], SCHEMA).repartition(16)
    got = substrings.digest(spark, df).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(i, 70 if i else 0) for i in range(20_000)]


def test_clashing_names(spark):
    docs = corpus(6, 40)
    rows = [(*d, "en", i, None, 3) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, spans long, _spans string, row int")
    out = substrings.without_repeats(spark, df, span=12, gram=5)
    assert out.columns == df.columns and out.count() == len(rows)
    assert sorted((r.spans, r._spans, r.row) for r in out.collect()) == [(i, None, 3) for i in range(len(rows))]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert substrings.digest(spark, df).count() == 0
    assert substrings.without_repeats(spark, df).columns == df.columns
