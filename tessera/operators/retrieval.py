"""Retrieval: BM25, dense cosine, rank fusion, and their calibrated relevance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import deletions, edit1, fold, tokens, transposed
from tessera.sources.store import Store, dealt

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF = 60
#: Numbers of all queries' vectors up to which they are one matrix, 64 MB.
BLOCK = 8_000_000


def lexical_doc(attribute_weight: int = 2) -> Column:
    """All text fields of a place; attributes stand more often, empty fields not at all."""
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    listed = lambda c: F.nullif(F.array_join(c, " "), F.lit(""))
    return F.concat_ws(" ", *map(text, ("name", "brand", "category", "sub_category", "district", "city", "address")), *[listed("attributes")] * attribute_weight, listed("tags"), text("description"))


def doc_text() -> Column:
    """The text that is embedded; empty optional fields stay as empty places."""
    c = lambda x: F.coalesce(F.col(x), F.lit(""))
    return F.concat(c("name"), F.lit(". "), c("brand"), F.lit(". "), c("category"), F.lit(" / "), c("sub_category"), F.lit(". "), c("district"), F.lit(", "), c("city"), F.lit(". Đặc điểm: "), F.array_join("attributes", ", "), F.lit(". "), F.array_join("tags", ", "), F.lit(". "), c("description"))


def content_tokens() -> Column:
    """Distinct folded words of name and brand."""
    return F.array_distinct(tokens(F.concat_ws(" ", "name", "brand")))


def raw_idf(df: DataFrame, totals: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(totals)).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))


def floored(raw: DataFrame) -> DataFrame:
    """A term of most documents gets a small share of the mean instead of a negative weight."""
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


class Bm25:
    """Statistics of documents (pos, toks). Each is a DataFrame: tf by term and document, idf by term, one row of totals.

    They are lazy: every use computes them anew from docs. stored() writes them once, for many uses.
    """

    def __init__(self, docs: DataFrame):
        self._counts(docs.select("pos", F.size("toks").alias("dl"), "toks"))
        self._statistics()

    def _counts(self, sized: DataFrame) -> None:
        self.sized, self.docs = sized, sized.select("pos", "dl")
        # An inner explode would have the optimizer filter on toks first, and make them once more for that.
        self.tf = sized.select("pos", "dl", F.explode_outer("toks").alias("term")).where("term IS NOT NULL").groupBy("term", "pos", "dl").agg(F.count("*").alias("tf"))

    def _statistics(self) -> None:
        self.totals = self.docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        self.df = self.tf.groupBy("term").agg(F.count("*").alias("df"))
        self.idf = floored(raw_idf(self.df, self.totals))

    def stored(self, store: Store) -> Bm25:
        """The same as tables of a store: each step reads what the one before it has written."""
        out = object.__new__(Bm25)
        # Documents dealt by pos are counted where they are, and postings stay with them: a common word is in all documents, so the task
        # of one word would be as long as the corpus.
        sized = store.write(self.sized, "documents")
        out._counts(dealt(sized, "pos"))
        out.sized, out.docs = sized, sized.select("pos", "dl")
        out.tf = store.write(out.tf.sortWithinPartitions("term", "pos"), "postings")
        out._statistics()
        out.totals = store.write(out.totals, "totals")
        out.df = store.write(out.df, "df")
        out.idf = store.write(floored(store.write(raw_idf(out.df, out.totals), "raw")), "idf")
        return out

    def scores(self, queries: DataFrame, within: DataFrame | None = None) -> DataFrame:
        """(query_id, pos, score) where a word matches; queries (query_id, toks) count repeated words each time. within (pos) has few documents to score alone.

        The queries' words are broadcast: postings as files are small, and Spark would broadcast those instead.
        """
        asked = queries.select("query_id", F.explode("toks").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        tf = self.tf if within is None else self.tf.join(F.broadcast(within), "pos", "left_semi")
        hits = tf.join(F.broadcast(asked.join(self.idf, "term")), "term").crossJoin(F.broadcast(self.totals))
        weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        return hits.groupBy("query_id", "pos").agg(F.sum(weight * F.col("times")).alias("score"))

    def rank(self, queries: DataFrame) -> DataFrame:
        """(query_id, pos, score, rank) for every document: those without a match follow in corpus order."""
        every = self.docs.select("pos").crossJoin(F.broadcast(queries.select("query_id"))).select("query_id", "pos", F.lit(None).cast("double").alias("score"))
        # One shuffle of a union, not a join of two sides whose sizes Spark would guess.
        scored = every.unionByName(self.scores(queries)).groupBy("query_id", "pos").agg(F.max("score").alias("score"))
        return ranked(scored.withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9)))

    def top(self, queries: DataFrame, k: int) -> DataFrame:
        """The first k of rank() without all pairs: matches, and as many of the first documents as could follow them."""
        scored = self.scores(queries).withColumn("score", F.round("score", 9))
        first = self.docs.select("pos").orderBy("pos").limit(2 * k)
        matched = self.scores(queries, first).select("query_id", "pos")
        rest = queries.select("query_id").crossJoin(F.broadcast(first)).join(F.broadcast(matched), ["query_id", "pos"], "left_anti")
        return ranked(scored.unionByName(rest.withColumn("score", F.lit(0.0)))).where(F.col("rank") <= k)


def by_score(score: str):
    """The order of a query's list: scores, then the corpus' order."""
    return Window.partitionBy("query_id").orderBy(F.desc(score), "pos")


def ranked(scored: DataFrame) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(by_score("score")))


def drop_tokens(toks: Column, drop: Column) -> Column:
    """Words without those to drop, unless nothing were left."""
    left = F.filter(toks, lambda x: ~F.array_contains(drop, x))
    return F.when(F.size(left) > 0, left).otherwise(toks)


def canonical(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, canonical): unknown words of 4 letters or more with the one vocabulary word that they are a typo of.

    A swap goes before other edits; words with several candidates of the best kind have none. Candidates meet on what
    is left after one deletion, so only they are compared, not all pairs.
    """
    unknown = words.select("term").distinct().join(vocabulary.select("term"), "term", "left_anti").where(F.length("term") >= 4)
    side = lambda df, name: df.where(F.length("term") >= 4).select("term", F.explode(deletions(F.col("term"))).alias("variant")).withColumnRenamed("term", name)
    pairs = side(unknown, "term").join(side(vocabulary.select("term").distinct(), "other"), "variant").select("term", "other").distinct().where(edit1(F.col("term"), F.col("other")))
    tier = F.when(transposed(F.col("term"), F.col("other")), 0).otherwise(1)
    best = pairs.withColumn("tier", tier).groupBy("term", "tier").agg(F.count("*").alias("n"), F.min("other").alias("canonical"))
    first = best.groupBy("term").agg(F.min(F.struct("tier", "n", "canonical")).alias("b"))
    return first.where("b.n = 1").select("term", F.col("b.canonical").alias("canonical"))


def correct(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """queries (query_id, toks) with unknown words replaced by what they are typos of."""
    words = queries.select("query_id", F.posexplode("toks").alias("at", "term"))
    fixed = words.join(canonical(words, vocabulary), "term", "left").withColumn("term", F.coalesce("canonical", "term"))
    toks = fixed.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]).alias("toks"))
    return queries.drop("toks").join(toks, "query_id", "left").withColumn("toks", F.coalesce("toks", F.array().cast("array<string>")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """To length 1; a zero vector stays."""
    scaled = lambda norm: F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))
    # The norm is bound by an array of its own: within the inner function alone it would be summed up again for each number of v.
    return F.get(F.transform(F.array(F.sqrt(dot(v, v))), scaled), F.lit(0))


def dense(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, pos, score, rank) by cosine, for queries (query_id, v) and docs (pos, v); a zero query has no list."""
    return ranked(cosines(queries, docs))


def cosines(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, pos, score) for all pairs of queries (query_id, v) and docs (pos, v).

    Queries of up to BLOCK numbers go to the executors as one matrix, by which each batch of vectors is multiplied; more are
    joined pair by pair. Sums run over the dimensions in order in both, so equal vectors have equal scores.
    """
    q = queries.select("query_id", normalized(F.col("v")).alias("q")).where(dot(F.col("q"), F.col("q")) > 0)
    if (queries.agg(F.sum(F.size("v"))).first()[0] or 0) > BLOCK:
        unit = docs.select("pos", normalized(F.col("v")).alias("d"))
        return unit.crossJoin(q).select("query_id", "pos", F.round(dot(F.col("q"), F.col("d")), 9).alias("score"))
    rows = q.collect()
    if not rows:
        return docs.select(F.lit("").alias("query_id"), "pos", F.lit(0.0).alias("score")).limit(0)
    names, matrix = [r.query_id for r in rows], np.array([r.q for r in rows])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = np.ascontiguousarray(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).T)
            norm = np.zeros(batch.num_rows)
            for own in vectors:
                norm += own * own
            vectors = vectors / np.where(norm == 0, 1.0, np.sqrt(norm))
            step = max(1, BLOCK // 8 // batch.num_rows)
            for at in range(0, len(names), step):
                score = np.zeros((len(names[at : at + step]), batch.num_rows))
                for d in range(matrix.shape[1]):
                    score += matrix[at : at + step, d, None] * vectors[None, d]
                for name, own in zip(names[at : at + step], score, strict=True):
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name, pa.string()), batch.num_rows), batch.column(0), pa.array(own)], names=["query_id", "pos", "score"])

    kind = dict(docs.dtypes)["pos"]
    plain = docs.select("pos", F.col("v").cast("array<double>").alias("v"))
    return plain.mapInArrow(multiply, f"query_id string, pos {kind}, score double").withColumn("score", F.round("score", 9))


def fused_order(lexical: DataFrame, dense: DataFrame, c: int = RRF) -> DataFrame:
    """fuse() of a lexical and a dense list with rank: ties in the order of first sight, the lexical list first."""
    first = lexical.select("query_id", "pos", F.col("rank").alias("seen"), F.lit(0).alias("list")).unionByName(dense.select("query_id", "pos", F.col("rank").alias("seen"), F.lit(1).alias("list")))
    seen = first.groupBy("query_id", "pos").agg(F.min(F.struct("list", "seen")).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 9)), "seen")
    return fuse([lexical, dense], c).join(seen, ["query_id", "pos"]).withColumn("rank", F.row_number().over(order)).drop("seen")


def fuse(lists: list[DataFrame], c: int = RRF) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, pos, rank): (query_id, pos, rrf, relevance).

    relevance is rrf as a part of what first places in all the query's lists would give.
    """
    each = [x.select("query_id", "pos", "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)]
    both = each[0]
    for x in each[1:]:
        both = both.unionByName(x)
    lists_ = both.groupBy("query_id").agg(F.count_distinct("list").alias("k"))
    sums = both.groupBy("query_id", "pos").agg(F.sum(1.0 / (c + F.col("rank"))).alias("rrf"))
    return sums.join(lists_, "query_id").select("query_id", "pos", "rrf", F.least(F.lit(1.0), F.col("rrf") / (F.col("k") / (c + 1.0))).alias("relevance"))
