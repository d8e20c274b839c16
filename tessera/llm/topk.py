"""Exact top-k search: MaxScore over sharded postings of whole-number vectors.

A dimension of a sign is a term; a vector is in the postings of the signs it has. For a query, the parts of a score
that agree in sign are bounded by the term's largest value, the others by 0. Terms are split into essential ones, whose postings
are traversed, and the rest, whose bounds together can't reach the k-th best score; those are probed for documents
that are still competitive, largest bound first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCALE = 256.0
#: Vectors of a shard and queries of a block, on average.
SHARD, BLOCK = 4096, 512
#: Sums of whole numbers below this are exact in doubles; larger ones are made of Python's whole numbers.
EXACT = 2.0**53

BLOCKS = "dim int, {0} int, ids binary, vectors binary"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): components turned into whole numbers, held as doubles; null ids, null vectors, and those with a null or non-finite component are left out."""
    # Doubles of 2^53 and more are whole already, and floor() of Spark would make 64-bit numbers of them.
    v = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) < EXACT / SCALE, F.floor(x.cast("double") * SCALE).cast("double")).otherwise(x.cast("double") * SCALE))
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fit).select("vec_id", v.alias("v"))


def _packed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (dim, part, vec_id, v) as one row for each dim and part."""
    key, ids, values = None, [], []

    def out() -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        matrix = np.array(values, np.float64)[order]
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.array(ids, np.int64)[order].tobytes()]), pa.array([matrix.tobytes()])], names=["dim", "part", "ids", "vectors"])

    for batch in rows:
        dims, parts, own = (batch.column(i).to_pylist() for i in range(3))
        flat, ends = batch.column(3).flatten().to_numpy(), np.cumsum(batch.column(3).value_lengths().to_numpy())
        for d, p, i, end in zip(dims, parts, own, ends.tolist(), strict=True):
            if (d, p) != key:
                if ids:
                    yield out()
                key, ids, values = (d, p), [], []
            ids.append(i)
            values.append(flat[end - d : end])
    if ids:
        yield out()


def maxscore(query: np.ndarray, shard: Shard, k: int, skip: int) -> list[tuple[int, int]]:
    """The k best (score, row) of a shard for a query, ties by row. Rows whose id is skip take no part."""
    shard, query = shard.exact(query)
    n = len(shard.ids)
    terms = np.flatnonzero(query)
    own = shard.ids == skip
    k = min(k, n - int(own.sum()))
    if k <= 0:
        return []
    if not len(terms):
        return [(0, int(i)) for i in np.flatnonzero(~own)[:k]]
    sign = query[terms] > 0
    bound = np.where(sign, query[terms] * np.maximum(shard.most[terms], 0), query[terms] * np.minimum(shard.least[terms], 0))
    up = np.argsort(bound, kind="stable")
    terms, sign, bound = terms[up], sign[up], bound[up]
    below = np.cumsum(bound)
    # A first threshold: the scores of those that stand highest in the best term.
    some = shard.top(terms[-1], bool(sign[-1]))
    first = shard.matrix[some[~own[some]]] @ query
    floor = np.sort(first)[-k] if len(first) >= k else 0
    # Terms whose bounds together stay under the threshold are not essential.
    essential = int(np.searchsorted(below, floor, side="left")) if floor > 0 else 0
    score = np.zeros(n, query.dtype)
    if essential:
        touched = np.zeros(n, bool)
        for t, s in zip(terms[essential:], sign[essential:], strict=True):
            rows, values = shard.postings(t, bool(s))
            score[rows] += query[t] * values
            touched[rows] = True
        rest = below[essential - 1]
        live = np.flatnonzero(touched & ~own & (score + rest >= floor))
        # What the essential terms take away from a score, then the other terms, those of larger bounds first.
        score = score[live]
        for t, s in zip(terms[essential:], sign[essential:], strict=True):
            x = shard.columns[t][live]
            score += query[t] * (np.minimum(x, 0) if s else np.maximum(x, 0))
        keep = score + rest >= floor
        live, score = live[keep], score[keep]
        for i in range(essential - 1, -1, -1):
            score += query[terms[i]] * shard.columns[terms[i]][live]
            rest = below[i - 1] if i else 0
            keep = score + rest >= floor
            live, score = live[keep], score[keep]
    else:
        # All terms are essential: a product traverses all their postings.
        live = np.flatnonzero(~own)
        score = shard.matrix[live] @ query
    best = sorted(range(len(live)), key=lambda i: (-score[i], live[i]))[:k] if score.dtype == object else np.lexsort((live, -score))[:k]
    return [(int(score[i]), int(live[i])) for i in best]


def whole(x: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


class Shard:
    """Postings of a bounded number of vectors, sorted by id."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        self.columns = np.ascontiguousarray(matrix.T)
        self.most, self.least = (f(axis=1) if len(ids) else np.zeros(matrix.shape[1]) for f in (self.columns.max, self.columns.min))
        self.lists: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}
        self.wide: Shard | None = None

    def exact(self, query: np.ndarray) -> tuple[Shard, np.ndarray]:
        """This shard and query, or their forms in Python's whole numbers if a partial sum could leave what doubles hold exactly."""
        with np.errstate(over="ignore", invalid="ignore"):
            most = np.abs(query) @ np.maximum(np.abs(self.most), np.abs(self.least)) if self.matrix.dtype != object else 0
        if most < EXACT:
            return self, query
        if self.wide is None:
            self.wide = Shard(self.ids, whole(self.matrix))
        return self.wide, whole(query)

    def postings(self, term: int, positive: bool) -> tuple[np.ndarray, np.ndarray]:
        if (term, positive) not in self.lists:
            rows = np.flatnonzero(self.columns[term] > 0 if positive else self.columns[term] < 0)
            self.lists[term, positive] = rows, self.columns[term][rows]
        return self.lists[term, positive]

    def top(self, term: int, positive: bool, n: int = 64) -> np.ndarray:
        x = self.columns[term] if positive else -self.columns[term]
        return np.argpartition(-x.astype(float), n)[:n] if len(x) > n else np.arange(len(x))


def _search(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dim, shard, ids, vectors, q_ids, q_vectors): the k best of the shard for each query of the block."""
    for batch in batches:
        for r in batch.to_pylist():
            matrix = lambda name, of: np.frombuffer(r[name]).reshape(len(r[of]) // 8, r["dim"])  # noqa: B023, E731
            shard = Shard(np.frombuffer(r["ids"], np.int64), matrix("vectors", "ids"))
            found = []
            for q, query in zip(np.frombuffer(r["q_ids"], np.int64).tolist(), matrix("q_vectors", "q_ids"), strict=True):
                found += [(q, int(shard.ids[i]), s) for s, i in maxscore(query, shard, k, q)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * 3)], names=["query_id", "vec_id", "score"])


def search(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """One row for each of a query's k best: query_id, rank, vec_id, score.

    vectors and queries need vec_id and embedding. score is the inner product of the whole numbers floor(256 * x); ties go to the smaller vec_id, and vectors with
    the query's own vec_id don't count. Null ids, null vectors and those with a null or non-finite
    component take no part; all finite ones do, scored exactly whatever their size. A returned score beyond 64 bits raises an
    OverflowError. Vectors meet those of their own length only, and an empty vector scores 0. Repeated
    queries count once; a repeated vector counts each time. With fewer than k vectors all are returned.

    Shards of about SHARD vectors meet blocks of about BLOCK queries, each as one packed row: a task holds one pair.
    """
    from tessera.llm.common import Scratch

    scratch = Scratch(spark)
    tables = []
    for df, mean, name in ((usable(vectors), SHARD, "shard"), (usable(queries).dropDuplicates(["vec_id", "v"]), BLOCK, "block")):
        sized = df.select(F.size("v").alias("dim"), "vec_id", "v")
        counts = sized.groupBy("dim").agg(F.ceil(F.count("*") / mean).cast("int").alias("parts"))
        dealt = sized.join(counts, "dim").select("dim", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "v")
        packed = dealt.repartition("dim", "part").sortWithinPartitions("dim", "part").mapInArrow(_packed, BLOCKS.format("part"))
        tables.append(scratch.write(packed.withColumnRenamed("part", name)))
    shards, blocks = tables
    # Equal lengths and block numbers join: each shard is sent to every block of its length.
    many = blocks.groupBy("dim").agg(F.max("block").alias("last"))
    sent = shards.join(many, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), "last"))).drop("last")
    pairs = sent.join(blocks.withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors"}), ["dim", "block"]).repartition("dim", "shard", "block")
    found = pairs.select("dim", "shard", "ids", "vectors", "q_ids", "q_vectors").mapInArrow(partial(_search, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
