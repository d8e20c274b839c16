import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_ngram_join import brute as near
from test_substrings import brute as cut
from test_topk_mixing import by_bisection
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import mixing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, _spans long, spans string"


def corpus():
    r = random.Random(12)
    word = lambda: f"w{r.randint(0, 5000)}"
    passage = [f"p{i}" for i in range(60)]
    docs = []
    for i in range(160):
        w = [word() for _ in range(r.randint(30, 80))]
        if i % 8 == 0:
            for _ in range(5):
                w.insert(r.randrange(len(w)), r.choice(["vile", "foul"]))
        elif i % 8 == 1:
            w[10:10] = passage
        docs.append([i, " ".join(w), "en", r.choices(["a", "b", "c", None], [8, 4, 2, 1])[0]])
    docs += [[200 + k, docs[k][1].replace("w1", "w1 ", 1) + " end", "en", "a"] for k in (3, 5, 7)]
    docs += [[300, docs[2][1], "de", "b"], [301, "", None, None], [302, None, "en", "a"], [None, "without an id", None, "c"], [303, "word " * 5000, "en", "b"], [3, docs[3][1], "en", docs[3][3]]]
    rows = [(*d, len(d[1] or ""), "x", 1, None) for d in docs]
    labels = [(i, 1, int(i % 8 == 0)) for i in range(160)] + [(None, 1, 1), (5, None, None), (9999, 0, 1)]
    return rows, labels


def test_stages_and_run_as_plain_versions(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, COLUMNS)
    sf = str(tmp_path)
    docs.repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    seen = docs

    def stage(name):
        out = stages[name](spark, seen, sf)
        assert out.columns == docs.columns
        return spark.createDataFrame(out.collect(), docs.schema)

    def key(x):
        return (x.doc_id is None, x.doc_id, x.text or "")

    seen = stage("toxicity")
    toxic = {i for i, t, *_ in rows if {"vile", "foul"} & set((t or "").split())}
    assert sorted(x.doc_id for x in seen.collect() if x.doc_id is not None) == sorted(r[0] for r in rows if r[0] is not None and r[0] not in toxic)

    before = seen.collect()
    seen = stage("near_duplicates")
    known = sorted({(x.doc_id, x.text) for x in before if x.doc_id is not None}, key=str)
    first = {c for _, c, _ in near(known)}
    assert sorted(x.doc_id for x in seen.collect() if x.doc_id is not None) == sorted(first) and sum(x.doc_id is None for x in seen.collect()) == 1

    before = seen.collect()
    seen = stage("repeated_passages")
    want = {i: n - gone for i, n, gone, _ in cut([(x.doc_id, x.text) for x in before], 50)}
    assert {x.doc_id: len((x.text or "").split()) for x in seen.collect()} == want and sum(want.values()) < sum(len((x.text or "").split()) for x in before)

    before = sorted(seen.collect(), key=key)
    seen = stage("mixture")
    size = collections.Counter()
    for x in before:
        size[x.source] += len((x.text or "").split())
    names = sorted(size, key=str)
    weight = dict(zip(names, by_bisection(np.array([size[s] for s in names]), mixing.ENTROPY, mixing.REPEATS), strict=True))
    spent, times = collections.Counter(), collections.Counter()
    for x in seen.collect():
        spent[x.source] += len((x.text or "").split())
        times[x.doc_id] += 1
    longest = max(len((x.text or "").split()) for x in before)
    for s in names:
        budget = round(weight[s] * sum(size.values()))
        assert budget - longest <= spent[s] <= budget
        own = [times[x.doc_id] for x in before if x.source == s and (x.text or "").split()]
        assert max(own) - min(own) <= 1

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for x in seen.collect():
        ids = [*whole.encode(x.text or "", add_special_tokens=False).ids, 1]
        want[x.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    for pieces in (stages["packing"](spark, seen, sf).collect(), corpus_pipeline.run(spark, sf).collect()):
        begun, ids = collections.Counter(), collections.Counter()
        for x in pieces:
            begun[x.doc_id, x.doc_tokens] += x.start == 0
            ids[x.doc_id] += x.length
        assert +begun == collections.Counter({(d, n): k for d, n, _ in want for k in [sum(v for (a, b, _), v in want.items() if (a, b) == (d, n))]})
        assert ids == collections.Counter({d: sum(n * v for (a, n, _), v in want.items() if a == d) for d, _, _ in want})
        assert sum(x.length == x.doc_tokens and want[x.doc_id, x.doc_tokens, x.ids_crc32] == 0 for x in pieces) == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_no_documents(spark, tmp_path, name):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame([], COLUMNS), sf).count() == 0
