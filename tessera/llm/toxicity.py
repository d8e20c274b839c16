"""Toxicity: cumulative-link ordinal regression of severity grades on sparse text features.

P(grade > k) = s(x.w - t_k), with one weight vector for all ordered thresholds t_1 < t_2 < ... The features are
words, and beginnings of words, that stand in more contexts of toxic than of clean labelled texts; a copied passage is one
context.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: The fit's bounds: labelled rows of each kind, the first ones by a hash of doc_id.
TOXIC_ROWS, CLEAN_ROWS = 4_000, 16_000
#: Lengths of the beginnings that are features beside whole words: a stem under several endings is one feature.
STEMS = (4, 5, 6, 7)
#: Grades above 0 that toxic rows are split into.
GRADES = 3
#: A feature stands in so many contexts of toxic texts at least, and in so many times the share of toxic contexts that clean ones have.
LEAST, LIFT = 3, 4.0
RIDGE, STEPS = 1e-5, 600
BATCH = 256
#: A document is toxic from this chance of a grade above 0.
CUT = 0.3
SPLIT = r"[^\pL\pN]+"


@dataclass
class Model:
    words: list[str]
    weights: np.ndarray
    thresholds: np.ndarray

    def chances(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - eta[:, None], -60, 60)))


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of letters and digits, and which text each is of."""
    parts = pc.split_pattern_regex(pc.utf8_lower(texts.cast(pa.large_string())), SPLIT)
    return parts.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy())


def _forms(words: pa.Array) -> list[pa.Array]:
    """Whole words, and of longer ones the beginnings, marked by a star; null where a word has none of that length."""
    size, out = pc.utf8_length(words), [words]
    for n in STEMS:
        stem = pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, n), pa.scalar("*", words.type), pa.scalar("", words.type))
        out.append(pc.if_else(pc.greater(size, n), stem, pa.scalar(None, words.type)))
    return out


def occurrences(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Each place where texts (no nulls) have a feature of the vocabulary: row, feature, the place among all words; and the words and whose they are."""
    flat, row = _tokens(texts)
    coded = flat.dictionary_encode()
    code = coded.indices.to_numpy()
    rows, features_, places = [], [], []
    for form in _forms(coded.dictionary):
        at = pc.fill_null(pc.index_in(form, vocabulary, skip_nulls=True), -1).to_numpy()[code]
        have = np.flatnonzero(at >= 0)
        rows.append(row[have])
        features_.append(at[have].astype(np.int64))
        places.append(have)
    return np.concatenate(rows), np.concatenate(features_), np.concatenate(places), flat, row


def features(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and 1 + log(count) of the vocabulary's features in texts (no nulls)."""
    row, feature, *_ = occurrences(texts, vocabulary)
    width = max(1, len(vocabulary))
    pairs, n = np.unique(row * width + feature, return_counts=True)
    row, feature = np.divmod(pairs, width)
    return row, feature, 1 + np.log(n)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, documents that have it), once for each part of a batch."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BATCH):
            flat, row = _tokens(batch.column(0).slice(lo, BATCH))
            coded = flat.dictionary_encode()
            code, held = coded.indices.to_numpy(), []
            for form in _forms(coded.dictionary):
                own = form.dictionary_encode()
                at = pc.fill_null(own.indices, -1).to_numpy()[code]
                pairs = np.unique(at[at >= 0].astype(np.int64) * BATCH + row[at >= 0])
                found, n = np.unique(pairs // BATCH, return_counts=True)
                held.append((own.dictionary.take(pa.array(found)), n))
            yield pa.RecordBatch.from_arrays([pa.chunked_array([x for x, _ in held]).combine_chunks().cast(pa.string()), pa.array(np.concatenate([n for _, n in held]), pa.int64())], names=["feature", "n"])


def _documents_of(vocabulary: pa.Array):
    """(feature, documents that have it) for features of the vocabulary, and (null, words) of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                texts = batch.column(0).slice(lo, BATCH)
                _, feature, _ = features(texts, vocabulary)
                found, n = np.unique(feature, return_counts=True)
                yield pa.RecordBatch.from_arrays([vocabulary.take(pa.array(found)).cast(pa.string()), pa.array(n, pa.int64())], names=["feature", "n"])

    return run


def _contexts(vocabulary: pa.Array):
    """(feature, the word before it, toxic, fold), once for each part of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                some = batch.slice(lo, BATCH)
                row, feature, place, flat, owner = occurrences(some.column(0), vocabulary)
                first = (place == 0) | (owner[np.maximum(place - 1, 0)] != row)
                before = flat.take(pa.array(np.maximum(place - 1, 0))).to_pylist()
                toxic, fold = (some.column(i).to_numpy()[row].tolist() for i in (1, 2))
                seen = sorted({(f, "" if one else b, t, k) for f, b, one, t, k in zip(feature.tolist(), before, first.tolist(), toxic, fold, strict=True)})
                names = vocabulary.take(pa.array([x[0] for x in seen], pa.int64())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([names, *(pa.array([x[k] for x in seen], t) for k, t in ((1, pa.string()), (2, pa.int32()), (3, pa.int32())))], names=["feature", "before", "toxic", "fold"])

    return run


def fit_ordinal(row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, width: int, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that maximise the likelihood of the grades, with a ridge, by Adam steps."""
    n = len(grade)
    # Without rows nothing is thought to be toxic.
    share = np.clip([np.mean(grade > k) for k in range(grades)], 0.5 / n, 1 - 0.5 / n) if n else np.full(grades, 1e-3)
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(grades))
    p = np.concatenate([np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        gaps = np.exp(p[width + 1 :])
        t = p[width] + np.concatenate([[0.0], np.cumsum(gaps)])
        eta = np.bincount(row, value * p[col], minlength=n) if n else np.zeros(0)
        edges = np.concatenate([[-60.0], t, [60.0]])
        up, down = (1 / (1 + np.exp(-np.clip(edges[grade + k][:n] - eta, -60, 60))) for k in (1, 0))
        chance = np.maximum(up - down, 1e-12)
        d_up, d_down = up * (1 - up) / chance, down * (1 - down) / chance
        g_eta = d_up - d_down
        g = np.zeros_like(p)
        g[:width] = np.bincount(col, value * g_eta[row], minlength=width)[:width] / max(n, 1) + RIDGE * p[:width]
        g_t = np.array([(-(d_up[grade == k]).sum() + d_down[grade == k + 1].sum()) / max(n, 1) for k in range(grades)])
        g[width] = g_t.sum()
        g[width + 1 :] = [gaps[k] * g_t[k + 1 :].sum() for k in range(grades - 1)]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return p[:width], p[width] + np.concatenate([[0.0], np.cumsum(np.exp(p[width + 1 :]))])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labels (doc_id, toxic 0 or 1) and docs (doc_id, text).

    Rows with nulls take no part. As labels have no grades, toxic rows are graded 1 to GRADES, by thirds of how many of their words
    have a feature that the other half of the sample alone calls toxic: no row takes part in its own grade. Without toxic or clean rows no word is a feature and the model calls everything what the labels do.
    """
    scratch = Scratch(spark)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    some = known.where("toxic = 1").orderBy(*order).limit(TOXIC_ROWS).unionByName(known.where("toxic = 0").orderBy(*order).limit(CLEAN_ROWS))
    # At most TOXIC_ROWS + CLEAN_ROWS rows of two numbers.
    sample = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(some), "doc_id")
    sample = scratch.write(sample.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")))
    vocabulary, lexicons = _vocabulary(sample, scratch)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = np.array([[i in lexicons[1 - k] for i in range(len(vocabulary))] for k in (0, 1)], bool).reshape(2, -1)
        for batch in batches:
            row, feature, value = features(batch.column(1), vocabulary)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (feature.astype(np.int32), value)]
            at_row, at_feature, place, *_ = occurrences(batch.column(1), vocabulary)
            toxic_there = other[batch.column(3).to_numpy()[at_row], at_feature]
            _, first = np.unique(place[toxic_there], return_index=True)
            hits = np.bincount(at_row[toxic_there][first], minlength=batch.num_rows).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(hits), *lists], names=["doc_id", "toxic", "hits", "feature", "value"])

    # Bounded as the sample is: a row for each, with its features.
    rows = sample.select("doc_id", "text", "toxic", "fold").mapInArrow(sparse, "doc_id long, toxic int, hits int, feature array<int>, value array<double>").orderBy("doc_id", F.xxhash64("feature", "value")).collect()
    hits, is_toxic = np.array([r.hits for r in rows], int), np.array([r.toxic for r in rows], int)
    steps = np.quantile(hits[is_toxic == 1], [i / GRADES for i in range(1, GRADES)]) if is_toxic.any() else []
    grade = np.where(is_toxic == 1, 1 + np.searchsorted(steps, hits, side="left"), 0)
    row = np.repeat(np.arange(len(rows)), [len(r.feature) for r in rows])
    col = np.array([w for r in rows for w in r.feature], int)
    value = np.array([x for r in rows for x in r.value], float)
    return Model(vocabulary.to_pylist(), *fit_ordinal(row, col, value, grade, len(vocabulary), GRADES))


def _vocabulary(sample: DataFrame, scratch: Scratch) -> tuple[pa.Array, list[set[int]]]:
    """The features, and the numbers of those that each fold alone calls toxic.

    What leaves the executors is features that several of the sample's toxic texts have, and then those that lift; both are
    bounded as the sample is.
    """
    none = pa.array([], pa.large_string())
    toxic, clean = (sample.where(F.col("toxic") == t) for t in (1, 0))
    n_toxic, n_clean = toxic.count(), clean.count()
    if not n_toxic or not n_clean:
        return none, [set(), set()]
    often = toxic.select("text").mapInArrow(_documents, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("t")).where(F.col("t") >= LEAST)
    t = {r.feature: r.t for r in often.collect()}
    candidates = pa.array(sorted(t), pa.large_string())
    c = {r.feature: r.c for r in clean.select("text").mapInArrow(_documents_of(candidates), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("c")).collect()}
    lifting = pa.array([f for f in candidates.to_pylist() if t[f] * n_clean > LIFT * c.get(f, 0) * n_toxic], pa.large_string())
    contexts = sample.select("text", "toxic", "fold").mapInArrow(_contexts(lifting), "feature string, before string, toxic int, fold int")
    each = contexts.groupBy("feature", "before").agg(*(F.max((F.col("toxic") == k).cast("int") * (F.col("fold") == i).cast("int")).alias(f"{'ct'[k]}{i}") for k in (0, 1) for i in (0, 1)))
    counts = each.groupBy("feature").agg(F.sum(F.greatest("t0", "t1")).alias("t"), F.sum(F.greatest("c0", "c1")).alias("c"), *(F.sum(x).alias(x) for x in ("t0", "c0", "t1", "c1")))
    rows = {r.feature: r for r in scratch.write(counts).collect()}
    # Contexts are about as many as words.
    of = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    words = [of[0], of[1]]
    ratio, total = words[1] / words[0], sum(words)

    def gain(r) -> float:
        """The likelihood ratio of a feature's share of toxic contexts."""
        expected = [(r.t + r.c) * words[k] / total for k in (1, 0)]
        return 2 * sum(x * math.log(x / e) for x, e in zip((r.t, r.c), expected, strict=True) if x)

    least = 2 * math.log(len(candidates) + 1) + 4
    chosen = sorted(f for f, r in rows.items() if r.t >= LEAST and r.t > LIFT * r.c * ratio and gain(r) >= least)
    lexicons = [{i for i, f in enumerate(chosen) if rows[f][f"t{k}"] >= 2 and rows[f][f"t{k}"] > LIFT * rows[f][f"c{k}"] * ratio} for k in (0, 1)]
    return pa.array(chosen, pa.large_string()), lexicons


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with expected_severity (0 to GRADES), grade (the most likely one) and toxic.

    docs needs text and no columns of those names. Null and empty texts have no features; an empty table stays empty.
    Every word of every text counts. A pandas UDF with the model, whose size the fit's sample bounds, does it.
    """
    vocabulary, weights = pa.array(model.words, pa.large_string()), model.weights

    @F.pandas_udf("struct<expected_severity:double,grade:int,toxic:boolean>")
    def judge(texts):
        import pandas as pd

        out = []
        for lo in range(0, max(1, len(texts)), BATCH):
            some = pa.array(texts.iloc[lo : lo + BATCH], pa.string(), from_pandas=True).fill_null("")
            row, word, value = features(some, vocabulary)
            chances = model.chances(np.bincount(row, value * weights[word], minlength=len(some)))
            each = -np.diff(np.concatenate([np.ones((len(some), 1)), chances, np.zeros((len(some), 1))], axis=1))
            out.append(pd.DataFrame({"expected_severity": chances.sum(axis=1).round(6), "grade": each.argmax(axis=1), "toxic": chances[:, 0] >= CUT}))
        return pd.concat(out, ignore_index=True)

    return docs.withColumn("_toxicity", judge("text")).select(*docs.columns, "_toxicity.*")


def severity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: doc_id, expected_severity, grade, toxic.

    docs needs doc_id and text, labels doc_id and toxic; other columns are not read. Null and empty texts are judged as texts without features, repeated rows
    return as often, a null doc_id stays null. An empty table of documents gives an empty result, one of labels a model that calls nothing toxic.
    """
    return predict(docs.select("doc_id", "text"), fit(spark, docs, labels)).drop("text")


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model doesn't call toxic, with all columns, whatever their names; the cases are those of severity()."""
    judged = predict(docs.select(F.struct("*").alias("_row"), "text"), fit(spark, docs, labels))
    return judged.where(~F.col("toxic")).select("_row.*")
