"""Evaluation and tuning: gains, metrics, grouping sets, intervals, splits, weight grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.store import Store

METRICS = ("recall3", "recall5", "ndcg5", "mrr")


def qrels(expected: DataFrame) -> DataFrame:
    """(query_id, poi_id, gain) of (query_id, expected_ids): 3 for the first, 2 for the second, 1 for others; a repeated id has its last place."""
    placed = expected.select("query_id", F.posexplode("expected_ids").alias("ord", "poi_id"))
    last = placed.groupBy("query_id", "poi_id").agg(F.max("ord").alias("ord"))
    return last.select("query_id", "poi_id", F.when(F.col("ord") == 0, 3).when(F.col("ord") == 1, 2).otherwise(1).alias("gain"))


def per_query(ranked: DataFrame, rels: DataFrame) -> DataFrame:
    """recall3, recall5, ndcg5 and mrr of each query of rels, for ranked (query_id, poi_id, rank)."""
    hits = ranked.join(rels, ["query_id", "poi_id"]).groupBy("query_id").agg(
        F.count_if(F.col("rank") <= 3).alias("h3"), F.count_if(F.col("rank") <= 5).alias("h5"),
        F.sum(F.when(F.col("rank") <= 5, F.col("gain") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"), F.min("rank").alias("first"))
    ideal = rels.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain")))).groupBy("query_id").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("i") <= 5, F.col("gain") / F.log2(F.col("i") + 1.0)).otherwise(0.0)).alias("idcg"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.join(hits, "query_id", "left").select(
        "query_id", zero(F.col("h3") / F.col("n")).alias("recall3"), zero(F.col("h5") / F.col("n")).alias("recall5"),
        zero(F.col("dcg") / F.col("idcg")).alias("ndcg5"), zero(1.0 / F.col("first")).alias("mrr"))


def summary(metrics: DataFrame) -> DataFrame:
    """Means and counts over all, by difficulty and by query_category."""
    sets = metrics.groupingSets([[], ["difficulty"], ["query_category"]], "difficulty", "query_category")
    return sets.agg(F.count("*").alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in METRICS))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) of seed and keys, the same under any partitioning; plain arithmetic that other engines share."""
    x = F.lit(seed).cast("long")
    for k in keys:
        x = (x * 69069 + k.cast("long") * 7919 + 12345) % 2147483647
    for _ in range(3):
        x = (x * 48271 + 11) % 2147483647
    return x / 2147483647.0


def bootstrap(metrics: DataFrame, metric: str, resamples: int = 2000, alpha: float = 0.05, seed: int = 20260712) -> DataFrame:
    """(low, mean, high): the percentile interval of a metric's mean over resampled queries."""
    numbered = metrics.select(F.row_number().over(Window.orderBy("query_id")).alias("i"), F.col(metric).alias("m"))
    n = metrics.agg(F.count("*").alias("n"))
    draws = n.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("d", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    picked = draws.select("b", (F.floor(uniform(seed, F.col("b"), F.col("d")) * F.col("n")) + 1).alias("i")).join(F.broadcast(numbered), "i")
    means = picked.groupBy("b").agg(F.avg("m").alias("m"))
    ends = means.agg(F.percentile("m", F.lit(alpha / 2)).alias("low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("high"))
    return ends.crossJoin(metrics.agg(F.avg(metric).alias("mean"))).select(*(F.round(c, 6).alias(c) for c in ("low", "mean", "high")))


def split(queries: DataFrame, seed: str = "42", part: float = 1 / 3) -> DataFrame:
    """queries (query_id, stratum) with split: of each stratum the nearest whole number to its part is for test, by a hash's order."""
    w = Window.partitionBy("stratum")
    order = F.row_number().over(w.orderBy(F.sha2(F.concat(F.lit(seed), F.lit(":"), F.col("query_id")), 256)))
    return queries.withColumn("split", F.when(order <= F.bround(F.count("*").over(w) * part), "test").otherwise("tune"))


def grid_scores(signals: DataFrame, weights: dict[str, float], signal: str, grid: list[float], rels: DataFrame) -> DataFrame:
    """(value, ndcg5) of each weight that the grid has for a signal, in one job over the kept signals."""
    values = F.explode(F.array(*(F.lit(float(g)) for g in grid)))
    w = {k: F.lit(float(v)) for k, v in weights.items()} | {signal: F.col("value")}
    w["distance"] = F.when(F.col("anchor_lat").isNotNull(), w["distance"]).otherwise(0.0)
    top = sum((w[k] * F.col(f"sig_{k}") for k in weights), F.lit(0.0)) / sum(w.values(), F.lit(0.0))
    scored = signals.withColumn("value", values).withColumn("score", F.round(top, 9))
    rank = F.row_number().over(Window.partitionBy("value", "query_id").orderBy(F.desc("score"), "pos"))
    hits = scored.withColumn("rank", rank).where("rank <= 5").join(F.broadcast(rels), ["query_id", "poi_id"], "left")
    dcg = hits.groupBy("value", "query_id").agg(F.sum(F.coalesce("gain", F.lit(0)) / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = rels.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain")))).where("i <= 5").groupBy("query_id").agg(F.sum(F.col("gain") / F.log2(F.col("i") + 1.0)).alias("idcg"))
    return dcg.join(ideal, "query_id").groupBy("value").agg(F.round(F.avg(F.col("dcg") / F.col("idcg")), 6).alias("ndcg5"))


def coordinate_ascent(objective, weights: dict[str, float], grid=(0.05, 0.1, 0.2, 0.3, 0.4, 0.5), margin: float = 1e-3, passes: int = 2, fixed=("price",)) -> tuple[dict[str, float], float]:
    """Weights that objective(weights, signal, grid) -> {value: ndcg} likes better, one signal at a time; gains under margin don't count."""
    best = dict(weights)
    at = max(objective(best, "semantic", [best["semantic"]]).values())
    for _ in range(passes):
        moved = False
        for signal in (s for s in weights if s not in fixed):
            found = objective(best, signal, list(grid))
            value = max(sorted(found), key=lambda v: found[v])
            if found[value] > at + margin:
                best[signal], at, moved = value, found[value], True
        if not moved:
            break
    return best, at


def ablation(stages: dict[str, DataFrame], rels: DataFrame) -> DataFrame:
    """One row of mean metrics for each stage, a name and its lists (query_id, poi_id, rank), over the queries of rels.

    The lists meet rels in one join: only ranks of relevant places are aggregated.
    """
    every = None
    for name, lists in stages.items():
        one = lists.select(F.concat(F.lit(f"{name}:"), "query_id").alias("query_id"), "poi_id", "rank")
        every = one if every is None else every.unionByName(one)
    names = F.explode(F.array(*map(F.lit, stages)))
    each = per_query(every, rels.withColumn("stage", names).withColumn("query_id", F.concat("stage", F.lit(":"), "query_id")).drop("stage"))
    return each.groupBy(F.split("query_id", ":")[0].alias("stage")).agg(F.count("*").alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in METRICS))


def degraded(queries: DataFrame, typo) -> DataFrame:
    """Each query (query_id, text) clean, without diacritics, and without them and with a typo; degradation says which. typo is a function of text and a number in [0, 1)."""
    from tessera.functions.text import strip_diacritics

    bare = strip_diacritics(F.col("text"))
    u = F.conv(F.substring(F.md5("query_id"), 1, 8), 16, 10).cast("double") / 4294967296.0
    versions = {"clean": F.col("text"), "no-diacritics": bare, "typo": typo(bare, u)}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("degradation"), v.alias("text")) for k, v in versions.items())))
    return queries.select("query_id", each.alias("v")).select(F.concat_ws("/", "query_id", "v.degradation").alias("query_id"), F.col("query_id").alias("of"), "v.degradation", "v.text")


def gates(ablated: DataFrame, held_out: DataFrame, latency_p95: Column, failures: Column) -> DataFrame:
    """(gate, value, threshold, passed): recall of words alone, the fused list over its parts, the whole engine held out, latency in ms, robustness.

    ablated has rows bm25, dense and hybrid of ablation(); held_out one row of the whole engine's means.
    """
    of = lambda stage, m: F.max(F.when(F.col("stage") == stage, F.col(m)))
    a = ablated.agg(of("bm25", "recall5").alias("r"), of("hybrid", "ndcg5").alias("h"), F.greatest(of("bm25", "ndcg5"), of("dense", "ndcg5")).alias("parts"))
    one = a.crossJoin(held_out.select(F.col("ndcg5").alias("n"), F.col("recall3").alias("r3")))
    row = lambda name, value, least, ok: F.struct(F.lit(name).alias("gate"), value.cast("double").alias("value"), least.cast("double").alias("threshold"), ok.alias("passed"))
    c, x = F.col, F.lit
    rows = F.array(
        row("G1", c("r"), x(0.55), c("r") >= 0.55), row("G2", c("h"), c("parts"), c("h") > c("parts")), row("G3", c("n"), x(0.8), (c("n") >= 0.8) & (c("r3") >= 0.75)),
        row("G4", latency_p95, x(200.0), latency_p95 < 200), row("G5", failures, x(0.0), failures == 0),
    )
    return one.select(F.explode(rows).alias("g")).select("g.*")


def best_provider(scores: DataFrame) -> DataFrame:
    """The (provider, ndcg5) with the largest ndcg5, ties to the first by name; rows without a score don't count."""
    return scores.where("ndcg5 IS NOT NULL").agg(F.min(F.struct((-F.col("ndcg5")).alias("n"), "provider")).alias("b")).select("b.provider", (-F.col("b.n")).alias("ndcg5"))


def accepted(table: DataFrame, guarded: str, improved: str, slack: float = 0.005) -> DataFrame:
    """One row (guard_ok, improves, accept) of arms (arm, committed, candidate): the guarded arm may lose slack at most, the other one must gain."""
    of = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    t = table.agg((of(guarded, "candidate") >= of(guarded, "committed") - slack).alias("guard_ok"), (of(improved, "candidate") > of(improved, "committed")).alias("improves"))
    return t.withColumn("accept", F.col("guard_ok") & F.col("improves"))


def disjoint(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (shared): how many rows of equal columns both have; 0 means that the sets are disjoint."""
    return a.distinct().intersect(b.distinct()).agg(F.count("*").alias("shared"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (side, ...) that only one of two tables has, counted as often as they occur; none means that the two are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def cumulative(df: DataFrame, value: str, store: Store) -> DataFrame:
    """(value, lo, hi): of each distinct value that is not null the ranks lo + 1 to hi of its rows, in the order of values.

    Values are dealt to partitions by ranges and summed there; only one number of each partition is summed up in one place.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("c"))
    ranged = store.write(counts.repartitionByRange("value").withColumn("p", F.spark_partition_id()), "ranged")
    before = ranged.groupBy("p").agg(F.sum("c").alias("t")).withColumn("before", F.coalesce(F.sum("t").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = ranged.withColumn("hi", F.sum("c").over(Window.partitionBy("p").orderBy("value")))
    return inside.join(F.broadcast(before.select("p", "before")), "p").select("value", (F.col("hi") + F.col("before") - F.col("c")).alias("lo"), (F.col("hi") + F.col("before")).alias("hi"))


def at_rank(rank: Column) -> Column:
    """An aggregate over cumulative(): the value of a rank."""
    return F.max(F.when((F.col("lo") < rank) & (F.col("hi") >= rank), F.col("value")))


def percentile(q: float) -> Column:
    """An aggregate over cumulative() and its n: the interpolated percentile."""
    place = (F.col("n") - 1) * q
    low, high = at_rank(F.floor(place) + 1), at_rank(F.ceil(place) + 1)
    part = F.max(place - F.floor(place))
    return low + (high - low) * part
