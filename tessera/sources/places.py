"""Sources and sinks of place search: tables of places, query sets, vector indexes, caches, weights."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.signals import WEIGHTS

#: Places derived from part, some with a name of their own; the text runs in Spark and in other engines alike.
POI_SQL = """SELECT p_partkey AS pos,
  concat('P', lpad(CAST(p_partkey AS STRING), 6, '0')) AS poi_id,
  CASE WHEN p_partkey % 50 = 7 THEN concat(p_name, ' ', translate(CAST(p_partkey + 10000 AS STRING), '0123456789', 'abcdefghij')) ELSE p_name END AS name,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS brand,
  CASE p_type WHEN 'STANDARD' THEN 'Quán cà phê' WHEN 'PROMO' THEN 'Nhà hàng' WHEN 'ECONOMY' THEN 'Khách sạn'
    WHEN 'MEDIUM' THEN 'ATM' WHEN 'SMALL' THEN 'Trạm xăng' ELSE 'Công viên' END AS category,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE lower(p_type) END AS sub_category,
  CASE p_partkey % 4 WHEN 0 THEN 'TP.HCM' WHEN 1 THEN 'Hà Nội' WHEN 2 THEN 'Đà Nẵng' ELSE 'Đà Lạt' END AS city,
  concat('Quận ', CAST(p_partkey % 12 + 1 AS STRING)) AS district, concat(CAST(p_size AS STRING), ' Lê Lợi') AS address,
  CASE p_partkey % 4 WHEN 0 THEN 10.70e0 WHEN 1 THEN 20.95e0 WHEN 2 THEN 16.00e0 ELSE 11.90e0 END + (p_partkey * 37 % 200) / 1000.0e0 AS lat,
  CASE p_partkey % 4 WHEN 0 THEN 106.60e0 WHEN 1 THEN 105.75e0 WHEN 2 THEN 108.15e0 ELSE 108.35e0 END + (p_partkey * 53 % 200) / 1000.0e0 AS lon,
  3.8e0 + (p_partkey * 7 % 10) / 10.0e0 AS rating, 120 + (p_partkey * 131 % 15681) AS review_count,
  50 + (p_partkey * 17 % 49) AS popularity, CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE 1 + p_size % 4 END AS price_level,
  CASE p_partkey % 5 WHEN 0 THEN '24/7' WHEN 1 THEN '07:00-22:30' WHEN 2 THEN '18:00-03:00' WHEN 3 THEN '08:00-21:00' ELSE NULL END AS opening_hours,
  concat_ws(';', CASE WHEN p_partkey % 2 = 0 THEN 'wifi' END, CASE WHEN p_partkey % 3 = 0 THEN 'yên tĩnh' END,
    CASE WHEN p_partkey % 5 = 0 THEN '24/7' END, CASE WHEN p_partkey % 7 = 0 THEN 'bãi đỗ xe' END) AS attributes,
  concat_ws(';', lower(p_type), CASE WHEN p_size > 25 THEN 'lãng mạn' END) AS tags,
  concat(p_name, ' không gian ', CASE WHEN p_partkey % 3 = 0 THEN 'yên tĩnh' ELSE 'rộng rãi' END) AS description
FROM part"""


def split_list(c: Column, by: str = ";") -> Column:
    """Trimmed, non-blank parts; an empty array for null."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), f"[{by}]"), lambda x: F.trim(x)), lambda x: x != "")


def optional(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def optional_number(c: Column) -> Column:
    """A number, null where there is none (blank, words, NaN)."""
    value = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(value), value)


def optional_int(c: Column) -> Column:
    """A whole number, cut toward zero; null where there is none, or none that an int holds."""
    return F.when(F.abs(optional_number(c)) < 2.0**31, optional_number(c)).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived places, with attributes and tags as arrays."""
    raw = spark.sql(POI_SQL.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
    return raw.withColumns({"attributes": split_list(F.col("attributes")), "tags": split_list(F.col("tags"))})


def read_places(df: DataFrame) -> DataFrame:
    """Raw places (from Parquet, CSV or JSON) renamed, cast and split; blank optional fields are null, whole numbers cut toward zero."""
    names = {"poi_name": "name", "latitude": "lat", "longitude": "lon", "popularity_score": "popularity"}
    df = df.withColumnsRenamed(names)
    text = {c: F.coalesce(F.trim(F.col(c)), F.lit("")) for c in ("poi_id", "name", "category", "city", "district", "address", "description")}
    none = {c: optional(F.col(c)) for c in ("brand", "sub_category", "opening_hours")}
    number = {c: optional_number(F.col(c)) for c in ("lat", "lon", "rating", "popularity")}
    whole = {c: optional_int(F.col(c)) for c in ("review_count", "price_level")}
    return df.withColumns(text | none | number | whole | {c: split_list(F.col(c)) for c in ("attributes", "tags")})


def read_queries(df: DataFrame) -> DataFrame:
    """Raw query rows; expected ids, names and skills are split at semicolons, the other lists at commas."""
    lists = {"expected_ids": ("expected_top_poi_ids", ";"), "expected_names": ("expected_top_poi_names", ";"), "semantic_requirements": ("expected_semantic_requirements", ","), "ranking_signals": ("ranking_signals_to_use", ","), "skills_tested": ("skills_tested", ";")}
    return df.withColumns({new: split_list(F.col(old), by) for new, (old, by) in lists.items()})


def read_query_json(spark: SparkSession, path: str) -> DataFrame:
    schema = "query_id string, input_query string, query_category string, difficulty string, expected_ids array<string>, expected_names array<string>, expected_intent string, semantic_requirements array<string>, ranking_signals array<string>, skills_tested array<string>"
    return spark.read.schema(schema).json(path, multiLine=True)


def display_words(df: DataFrame, column: str = "value") -> DataFrame:
    """A text resource as folded form and its displayed forms; blank lines and # comments are skipped."""
    from tessera.functions.text import fold

    line = F.trim(F.col(column))
    good = df.select(line.alias("word")).where((F.col("word") != "") & ~F.startswith("word", F.lit("#")))
    return good.groupBy(fold(F.col("word")).alias("folded")).agg(F.sort_array(F.collect_set("word")).alias("forms"))


def cache_key(*parts: Column | str) -> Column:
    return F.sha1(F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p for p in parts)))


def missing(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Rows that a read-through cache still lacks."""
    return wanted.join(cache.select(key), key, "left_anti")


def read_through(wanted: DataFrame, path: str, compute, key: str = "key", value: str = "value") -> DataFrame:
    """wanted (key, ...) with its values: those that the cache at path lacks are computed and added to it, successes only.

    A cached row whose value is null or unreadable JSON counts as a miss, so a corrupt entry is computed anew. compute takes the
    missing rows and returns (key, value); null values are not cached.
    """
    spark = wanted.sparkSession
    cached = read_or_empty(spark, path, f"{key} string, {value} string")
    good = cached.where(F.col(key).isNotNull() & F.try_parse_json(F.col(value)).isNotNull()).groupBy(key).agg(F.max(value).alias(value))
    fresh = compute(missing(wanted, good, key)).select(key, value).where(F.col(value).isNotNull())
    fresh.write.mode("append").parquet(path)
    now = read_or_empty(spark, path, f"{key} string, {value} string").where(F.try_parse_json(F.col(value)).isNotNull())
    return wanted.join(now.groupBy(key).agg(F.max(value).alias(value)), key, "left")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at path, or none of its rows while nothing has been written there."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
    return spark.read.schema(schema).parquet(path) if found else spark.createDataFrame([], schema)


def write_places(places: DataFrame, path: str) -> None:
    """Places with the text that is embedded, as Parquet."""
    from tessera.operators.retrieval import doc_text

    places.withColumn("doc_text", doc_text()).write.mode("overwrite").parquet(path)


def copy_table(df: DataFrame, path: str) -> None:
    """A table copied unchanged, such as a taxonomy of attributes."""
    df.write.mode("overwrite").parquet(path)


def write_split(split: DataFrame, path: str, seed: str, part: float) -> None:
    """A split (query_id, split) as one JSON object: seed, test_frac, and the sorted ids of either side."""
    sides = split.groupBy().agg(*(F.array_sort(F.collect_list(F.when(F.col("split") == s, F.col("query_id")))).alias(s) for s in ("tune", "test")))
    sides.select(F.lit(seed).alias("seed"), F.lit(part).alias("test_frac"), "tune", "test").coalesce(1).write.mode("overwrite").json(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, split) of write_split()."""
    sides = spark.read.schema("seed string, test_frac double, tune array<string>, test array<string>").json(path)

    def rows(side: str) -> Column:
        return F.transform(side, lambda q: F.struct(q.alias("query_id"), F.lit(side).alias("split")))

    each = F.explode(F.concat(rows("tune"), rows("test")))
    return sides.select(each.alias("x")).select("x.*")


def write_weights(spark: SparkSession, weights: dict[str, float], ndcg: float, grid: list[float], margin: float, path: str, official: bool = False) -> None:
    """Tuned weights as JSON. Only official ones overwrite what is at path; a candidate needs a path of its own."""
    row = spark.createDataFrame([(weights, ndcg, [float(g) for g in grid], margin)], "weights map<string,double>, tuned_ndcg5_tune double, grid array<double>, margin double")
    row.select(F.struct(*(F.col("weights")[k].alias(k) for k in weights)).alias("weights"), "tuned_ndcg5_tune", "grid", "margin").coalesce(1).write.mode("overwrite" if official else "errorifexists").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report's rows as JSON lines in one file, and as a table of Markdown beside it; reports are small."""
    df.coalesce(1).write.mode("overwrite").json(f"{path}/rows")
    rows = F.concat(F.lit("| "), F.array_join(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), " | "), F.lit(" |"))
    head = [f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}"]
    body = df.select(rows.alias("value")).withColumn("o", F.monotonically_increasing_id() + 2)
    top = df.sparkSession.createDataFrame(list(enumerate(head)), "o long, value string").select("value", "o")
    top.unionByName(body).coalesce(1).sortWithinPartitions("o").select("value").write.mode("overwrite").text(f"{path}/markdown")


def write_index(vectors: DataFrame, path: str, provider: str, model: str) -> None:
    """Vectors (poi_id, pos, embedding) and a manifest with a fingerprint of their order."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    manifest = vectors.agg(F.count("*").alias("n_docs"), F.max(F.size("embedding")).alias("dim"), fingerprint().alias("fingerprint"))
    manifest.select(F.lit(provider).alias("provider"), F.lit(model).alias("model_id"), "dim", "n_docs", "fingerprint").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def fingerprint() -> Column:
    """An order-aware sum over the corpus: of hashes of (place, id). It tells corpora apart as a hash of the ordered list of
    ids would, but is an aggregate of one number that no task has to hold the list for."""
    return F.sum(F.xxhash64("pos", "poi_id").cast("decimal(38,0)")).cast("string")


def read_index(spark: SparkSession, path: str, provider: str, model: str, corpus: DataFrame) -> DataFrame:
    """The vectors, if the manifest is that of this provider, model and corpus; else ValueError."""
    m = spark.read.schema("provider string, model_id string, dim int, n_docs long, fingerprint string").json(f"{path}/manifest").first()
    now = corpus.agg(fingerprint()).first()[0]
    if (m.provider, m.model_id, m.fingerprint) != (provider, model, now):
        raise ValueError("the index was made for another provider, model or corpus")
    return spark.read.parquet(f"{path}/vectors")


def load_weights(spark: SparkSession, path: str | None = None) -> dict[str, float]:
    """Weights of a JSON file; absent files and signals fall back to the defaults."""
    if path is None:
        return dict(WEIGHTS)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return dict(WEIGHTS)
    text = "\n".join(r.value for r in spark.read.text(path).collect())
    found = json.loads(text).get("weights", {})
    return {k: float(found.get(k, v)) for k, v in WEIGHTS.items()}
