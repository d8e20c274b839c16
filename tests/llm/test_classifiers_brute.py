"""The classifiers' whole results against plain versions, and what they get right on rows that they were not fitted on."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.llm import language, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(9001, None, "en"), (9002, "", "en"), (None, "no id here", None), (9003, "12 34", "en"), (9004, "word " * 30_000, "en"), (1, "again the same id", "en"), (1, "again the same id", "en")]


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def with_odd(spark):
    docs = table(spark, "documents").select("doc_id", "text", "lang")
    return docs.unionByName(spark.createDataFrame(ODD, docs.schema))


def test_severity_as_a_plain_version(spark):
    docs = with_odd(spark)
    model = toxicity.fit(spark, docs, table(spark, "labels"))
    weight = dict(zip(model.words, model.weights.tolist(), strict=True))

    def plain(text):
        count = collections.Counter()
        for w in re.split(r"[\W_]+", (text or "").lower()):
            count.update({w, *(w[:n] + "*" for n in toxicity.STEMS if len(w) > n)})
        eta = sum(weight[f] * (1 + math.log(n)) for f, n in count.items() if f in weight)
        return [1 / (1 + math.exp(t - eta)) for t in model.thresholds]

    key = lambda x: (str(x[0]), x[1], x[2])
    got = sorted(((r.doc_id, r.toxic, r.expected_severity) for r in toxicity.predict(docs.select("doc_id", "text"), model).collect()), key=key)
    want = sorted(((r.doc_id, plain(r.text)[0] >= toxicity.CUT, sum(plain(r.text))) for r in docs.collect()), key=key)
    assert len(got) == len(want)
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-5 for a, b in zip(got, want, strict=True))


def test_toxic_rows_that_were_not_fitted_on(spark):
    docs, labels = table(spark, "documents").select("doc_id", "text"), table(spark, "labels")
    caught = toxic = alarms = clean = 0
    for k in range(5):
        held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == k
        model = toxicity.fit(spark, docs, labels.where(~held))
        asked = docs.join(labels.where(held).select("doc_id", F.col("toxic").alias("label")), "doc_id")
        for r in toxicity.predict(asked, model).collect():
            toxic, clean = toxic + r.label, clean + 1 - r.label
            caught, alarms = caught + (r.label and r.toxic), alarms + (not r.label and r.toxic)
    # Some rows are labelled toxic whose texts have no word that others labelled so have.
    assert caught >= 0.8 * toxic and alarms <= 0.02 * clean


def test_language_as_a_plain_version(spark):
    docs = with_odd(spark)
    model = language.fit(docs.where(~language.held_out()))
    how = zstandard.ZstdCompressionParameters.from_level(language.LEVEL, strategy=zstandard.STRATEGY_GREEDY, min_match=language.MATCH, window_log=19, write_content_size=False)
    with_dictionary = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how) for _, raw in model]

    def plain(text):
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0
        data = re.sub(r"[\W\d_]+", " ", text.lower()).encode()
        n = math.ceil(len(data) / language.BLOCK)
        step = math.ceil(len(data) / n)
        sizes = sorted((sum(len(c.compress(data[i : i + step])) for i in range(0, len(data), step)), k) for k, c in enumerate(with_dictionary))
        return model[sizes[0][1]][0], round(1 - sizes[0][0] / sizes[1][0], 6)

    got = language.languages(spark, docs).collect()
    want = collections.Counter((r.doc_id, r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0, *plain(r.text)) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.held_out, r.lang_pred, r.score) for r in got) == want
    known = {r.doc_id: r.lang for r in table(spark, "documents").collect() if r.lang}
    held = [r.lang_pred == known[r.doc_id] for r in got if r.held_out and r.doc_id in known]
    assert np.mean(held) > 0.97


@pytest.mark.parametrize("long", [False, True])
def test_a_language_of_short_texts_and_one_of_late_passages(spark, long):
    rows = [(i, "ba ko ti" if i % 2 else "schent ung ich ent", "xx" if i % 2 else "yy") for i in range(60)]
    if long:
        # The opening is the same in both; what tells them apart comes late.
        opening = " ".join(f"open{i}" for i in range(900))
        rows = [(i, opening + " " + ("bako tilu " if i % 2 else "schent ung ich ") * 900, "xx" if i % 2 else "yy") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert {k for k, _ in model} == {"xx", "yy"}
    ask = spark.createDataFrame([(1, "bako tilu bako ko ti ba"), (2, "schent ich ung ent schent")], "doc_id long, text string")
    assert [r.lang_pred for r in language.predict(ask, model).collect()] == ["xx", "yy"]
