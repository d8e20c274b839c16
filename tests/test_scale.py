"""Work that must grow no faster than the input."""

import time

import duckdb
from pyspark.sql import functions as F

from tessera.operators import parsing as P
from tessera.operators import retrieval as B
from tessera.sources.store import Store


def test_norm_is_summed_up_once_a_vector(spark):
    wide = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda i: i.cast("float")).alias("v"))
    began = time.time()
    assert abs(wide.select(F.aggregate(B.normalized(F.col("v")), F.lit(0.0), lambda s, x: s + x * x).alias("n")).first().n - 1) < 1e-9
    assert time.time() - began < 20


def test_postings_of_a_common_word_are_many_tasks(spark):
    docs = spark.range(45_000).select(F.col("id").alias("pos"), F.array(F.lit("x"), F.concat(F.lit("w"), (F.col("id") % 7).cast("string")), F.lit("x")).alias("toks"))
    empty = spark.range(1).select((F.col("id") - 1).alias("pos"), F.array().cast("array<string>").alias("toks"))
    stored = B.Bm25(docs.unionByName(empty)).stored(Store(spark))
    assert stored.tf.where("term = 'x'").select(F.input_file_name()).distinct().count() > 1
    assert stored.tf.where("term = 'x'").agg(F.count("*"), F.min("tf"), F.max("tf")).first()[:] == (45_000, 2, 2)
    assert {(x.term, x.df) for x in stored.df.where("term IN ('x', 'w0')").collect()} == {("x", 45_000), ("w0", 6_429)} and stored.totals.first().n == 45_001


def test_gazetteer_merges_names_that_fold_alike(spark):
    rows = [(0, "Quận 1", "A", "Bar", 1.0, 4.0), (1, "quan 1", "A", "BAR", 2.0, None), (2, "Quận 1", "B", "bar", None, None), (3, None, None, None, 9.0, 9.0)]
    places = spark.createDataFrame(rows, "pos long, district string, city string, name string, lat double, lon double")
    by = {(x.kind, x.key): (x.ord, x.value, x.lat, x.lon) for x in P.gazetteer(places).collect()}
    assert by[("district", "quan 1")] == (0, "Quận 1", 1.5, 4.0) and by[("district", "quan 1 a")] == (1, "Quận 1, A", 1.5, 4.0)
    assert by[("district", "quan 1 b")] == (5, "Quận 1, B", None, None) and by[("name", "bar")] == (0, "bar", None, None) and by[("city", "a")][:2] == (0, "A")


def test_set_differences_tells_places_apart_that_share_an_id(spark, sf, tmp_path):
    from tessera.plans import registry

    keys = spark.range(1_000_000, 1_000_400).unionByName(spark.range(100_000, 100_040)).select(F.col("id").alias("p_partkey"))
    part = keys.select("p_partkey", F.lit("old ring").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("MEDIUM").alias("p_type"), F.lit(7).alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.sql(registry.oracle_sql()["set_differences"]).project("side, poi_id").fetchall())
    assert sorted(map(tuple, registry.queries()["set_differences"](spark, str(tmp_path)).select("side", "poi_id").collect())) == want


def test_pairs_are_made_once_and_no_side_of_them_is_broadcast(spark, sf):
    from tessera.plans import base

    plan = base.final(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "BroadcastExchange" in plan
    sides = [x for x in plan.split("BroadcastExchange")[1:]]
    assert all("MapInArrow" not in x.split("FileScan")[0] for x in sides) and "SortMergeJoin [pos#" in plan


def test_places_and_queries_without_vectors_stay(spark, sf):
    from tessera.operators.engine import Index
    from tessera.sources import places as L

    p = L.places(spark, sf).where("pos < 30")
    vector = lambda x: F.array(F.lit(1.0), x.cast("double"))
    index = Index(spark, p, p.where("pos < 20").select("pos", vector(F.col("pos")).alias("v")))
    q = spark.createDataFrame([("a", ["quan"]), ("b", [])], "query_id string, toks array<string>")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("z", [1.0, 1.0])], "query_id string, v array<double>")
    n = p.count()
    rows = index.hybrid(q, v).collect()
    assert len(rows) == 2 * n and {x.query_id for x in rows} == {"a", "b"}
    assert sorted(x.dense_rank for x in rows if x.dense_rank) == list(range(1, p.where("pos < 20").count() + 1)) and all(x.query_id == "a" for x in rows if x.dense_rank)
    assert sorted(x.bm25_rank for x in rows if x.query_id == "b") == list(range(1, n + 1))
