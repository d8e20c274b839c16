"""Inputs of the registered queries, in both forms: DataFrames, and the common tables of the SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.signals import TUNED, WEIGHTS
from tessera.operators import ranking as R
from tessera.operators import retrieval as B
from tessera.operators.engine import Index, rank, ranked
from tessera.sources.places import POI_SQL, places, table
from tessera.sources.store import dealt

QUERIES = [
    ("Q01", "quán cà phê yên tĩnh quận 1", 3), ("Q02", "khach san gan bien view dep", 7), ("Q03", "trạm xăng 24/7 gần đây", 11),
    ("Q04", "nhà hàng lãng mạn Đà Nẵng wifi wifi", 15), ("Q05", "cf q1 co wifi", 19), ("Q06", "công viên cho gia đình gần nhất", 23),
    ("Q07", "10.7738, 106.7012 cay xang", 27), ("Q08", "", 31), ("Q09", "baaah rộng rãi Lê Lợi", 7), ("Q10", "tp hcm quận 12 ATM giá rẻ", 39),
    ("Q11", "baafh ATM", 43), ("Q12", "mình đói bụng quá, muốn ăn gì đó", 47),
]
#: Intents by hand, for the operators that follow the parser. residual and terms: what the query has left, and its subject.
INTENTS = [
    ("Q01", "yên tĩnh", "", "Quán cà phê", None, "Quận 1", None, None, False, "Quận 1", 10.75, 106.70, "", ""),
    ("Q02", "gần biển", "wifi", "Khách sạn", "Đà Nẵng", None, None, "expensive", False, "Biển Mỹ Khê", 16.0545, 108.2470, "", "rieng"),
    ("Q03", "24/7;wifi", "", "Trạm xăng", None, None, 1320, None, True, "Hồ Gươm", 21.0287, 105.8524, "", ""),
    ("Q04", "lãng mạn;wifi", "yên tĩnh", "Nhà hàng", "Đà Nẵng", "Quận 99", None, None, False, None, None, None, "", ""),
    ("Q05", "wifi", "", "Quán cà phê", None, "Quận 1", None, "cheap", False, None, None, None, "", ""),
    ("Q06", "", "", "Công viên", "Hà Nội", None, None, None, True, "Hồ Tây", 21.0587, 105.8190, "", ""),
    ("Q07", "", "", "Trạm xăng", None, None, None, None, True, "here", 10.7738, 106.7012, "", ""),
    ("Q08", "", "", None, None, None, None, None, False, None, None, None, "", ""),
    ("Q09", "", "", None, "Đà Lạt", None, None, None, False, "far", 0.0, 0.0, "baaah", "baaah;rieng"),
    ("Q10", "", "", "ATM", "TP.HCM", "Quận 12", None, "cheap", False, None, None, None, "nosuchword", "nosuchword"),
    ("Q11", "wifi", "", "ATM", None, None, None, None, False, None, None, None, "baafh", "baafh"),
    ("Q12", "", "bãi đỗ xe", "Nhà hàng", None, None, None, None, False, None, None, None, "", ""),
]
INTENT_COLUMNS = "query_id string, req string, soft string, want_category string, want_city string, want_district string, open_after int, price_pref string, nearest boolean, anchor_name string, anchor_lat double, anchor_lon double, terms string, residual string"
#: What the texts of QUERIES mean, for the SQL of queries that start from the texts: intents, and the words that retrieval uses. An
#: anchor without coordinates is a district's centroid.
EXPECTED = [
    ("Q01", "yên tĩnh", "", "Quán cà phê", None, "Quận 1", None, None, False, "Quận 1", None, None, "", ""),
    ("Q02", "gần biển;check-in", "", "Khách sạn", None, None, None, None, False, None, None, None, "", ""),
    ("Q03", "24/7", "", "Trạm xăng", None, None, None, None, False, None, None, None, "", ""),
    ("Q04", "lãng mạn;wifi", "", "Nhà hàng", "Đà Nẵng", None, None, None, False, None, None, None, "", ""),
    ("Q05", "wifi", "", "Quán cà phê", None, "Quận 1", None, None, False, "Quận 1", None, None, "", ""),
    ("Q06", "phù hợp gia đình", "", "Công viên", None, None, None, None, True, None, None, None, "", ""),
    ("Q07", "", "", "Trạm xăng", None, None, None, None, False, "vị trí đã chọn", 10.7738, 106.7012, "", ""),
    ("Q08", "", "", None, None, None, None, None, False, None, None, None, "", ""),
    ("Q09", "", "", None, None, None, None, None, False, None, None, None, "baaah", "baaah;le;loi"),
    ("Q10", "", "", "ATM", "TP.HCM", "Quận 12", None, "cheap", False, "Quận 12", None, None, "", ""),
    ("Q11", "", "", "ATM", None, None, None, None, False, None, None, None, "baafh", "baafh"),
    ("Q12", "", "", "Nhà hàng", None, None, None, None, False, None, None, None, "", ""),
]
LEXICAL = {
    "Q01": "ca phe yen tinh", "Q02": "khach san gan vien vien dep", "Q03": "tram xang 24/7 gan day", "Q04": "nha hang lang man da nang wifi wifi", "Q05": "ca phe co wifi",
    "Q06": "cong vien cho gia tinh gan nhat", "Q07": "10 7738 106 7012 cay xang", "Q08": "", "Q09": "baaah rong rai le loi", "Q10": "tp tp hcm atm gia re",
    "Q11": "baafh atm", "Q12": "tinh doi bung qua muon an gi do",
}


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, float):
        return f"{x!r}e0"
    return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    """A table of SQL with the names of columns (a DDL string)."""
    names = ", ".join(c.split()[0] for c in columns.split(", "))
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({names})"


def fold_sql(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(replace(replace({x}, 'đ', 'd'), 'Đ', 'D'))), '[^a-z0-9/]+', ' ', 'g'))"


def toks_sql(x: str) -> str:
    return f"list_filter(string_split({fold_sql(x)}, ' '), lambda t: t <> '')"


def list_sql(x: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({x}, ''), ';'), lambda t: trim(t)), lambda t: t <> '')"


def folded_sql(x: str) -> str:
    return f"list_distinct(list_transform({list_sql(x)}, lambda t: {fold_sql('t')}))"


def haversine_sql(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371.0e0 * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


def open_sql(at: str) -> str:
    minute = lambda i, j: f"(CAST(regexp_extract(opening_hours, '^(\\d{{1,2}}):(\\d{{2}})-(\\d{{1,2}}):(\\d{{2}})$', {i}) AS INTEGER) * 60 + CAST(regexp_extract(opening_hours, '^(\\d{{1,2}}):(\\d{{2}})-(\\d{{1,2}}):(\\d{{2}})$', {j}) AS INTEGER))"
    a, b = minute(1, 2), minute(3, 4)
    return f"CASE WHEN opening_hours = '24/7' THEN TRUE WHEN opening_hours IS NULL THEN NULL WHEN {b} < {a} THEN ({at} >= {a} OR {at} <= {b}) ELSE {at} BETWEEN {a} AND {b} END"


def clamp_sql(x: str) -> str:
    return f"greatest(0.0e0, least(1.0e0, {x}))"


SIGNALS_SQL = {
    "semantic": clamp_sql("relevance"),
    "attributes": "CASE WHEN len(fr) + 0.5e0 * len(fs) > 0 THEN (len(list_intersect(fr, fa)) + 0.5e0 * len(list_intersect(fs, fa))) / (len(fr) + 0.5e0 * len(fs)) ELSE 0.5e0 END",
    "category": "CASE WHEN want_category IS NULL THEN 0.5e0 WHEN want_category = category THEN 1.0e0 ELSE 0.0e0 END",
    "distance": f"CASE WHEN km IS NULL THEN 0.5e0 ELSE {clamp_sql('pow(2.718281828e0, -km / 3.0e0)')} END",
    "rating": clamp_sql("((rating * review_count + (SELECT avg(rating) FROM poi) * 30.0e0) / (review_count + 30.0e0) - 3.5e0) / 1.5e0"),
    "popularity": clamp_sql("popularity / 100.0e0"),
    "open_now": f"CASE WHEN ({open_sql('coalesce(open_after, 840)')}) IS NULL THEN 0.5e0 WHEN {open_sql('coalesce(open_after, 840)')} THEN 1.0e0 ELSE 0.3e0 END",
    "review": "CASE WHEN len(qd) = 0 OR len(rw) = 0 THEN 0.5e0 ELSE len(list_intersect(qd, rw)) * 1.0e0 / len(qd) END",
    "price": "CASE WHEN price_pref IS NULL OR price_level IS NULL THEN 0.5e0 WHEN price_pref = 'cheap' THEN 1 - (price_level - 1) / 3.0e0 ELSE (price_level - 1) / 3.0e0 END",
}


def score_sql(weights: dict[str, float]) -> str:
    w = {k: f"CASE WHEN anchor_lat IS NULL THEN 0.0e0 ELSE {float(v)!r}e0 END" if k == "distance" else f"{float(v)!r}e0" for k, v in weights.items()}
    return f"(({' + '.join(f'({w[k]}) * sig_{k}' for k in WEIGHTS)}) / ({' + '.join(f'({w[k]})' for k in WEIGHTS)}))"


def common(intents: list[tuple], lexical: dict[str, str] | None = None) -> str:
    """The tables that queries share: places, statistics, lists, signals and the final ranks, for these intents.

    lexical has the words by which a query's text is retrieved, where they are not its own.
    """
    words = "CASE query_id " + " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in lexical.items()) + " END" if lexical else "text"
    return f"""WITH poi AS ({POI_SQL}),
qs AS ({values(QUERIES, "query_id string, text string, vec_id int")}),
area AS (SELECT name, avg(lat) AS lat, avg(lon) AS lon FROM (SELECT district AS name, lat, lon FROM poi UNION ALL SELECT district || ', ' || city, lat, lon FROM poi) GROUP BY name),
it AS (SELECT i.* EXCLUDE (anchor_lat, anchor_lon), coalesce(i.anchor_lat, area.lat) AS anchor_lat, coalesce(i.anchor_lon, area.lon) AS anchor_lon FROM ({values(intents, INTENT_COLUMNS)}) i LEFT JOIN area ON area.name = i.anchor_name AND i.anchor_lat IS NULL),
lex AS (SELECT pos, poi_id, {toks_sql("concat_ws(' ', nullif(trim(name), ''), nullif(trim(brand), ''), nullif(trim(category), ''), nullif(trim(sub_category), ''), nullif(trim(district), ''), nullif(trim(city), ''), nullif(trim(address), ''), replace(attributes, ';', ' '), replace(attributes, ';', ' '), replace(tags, ';', ' '), description)")} AS toks FROM poi),
qt AS (SELECT query_id, text, vec_id, {toks_sql('text')} AS toks FROM qs),
tf AS (SELECT term, pos, count(*) AS tf FROM (SELECT pos, unnest(toks) AS term FROM lex) GROUP BY term, pos),
dl AS (SELECT pos, len(toks) AS dl FROM lex), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
dq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
rawidf AS (SELECT term, df, ln(n - df + 0.5e0) - ln(df + 0.5e0) AS raw FROM dq, st),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25e0 * (SELECT avg(raw) FROM rawidf) ELSE raw END AS idf FROM rawidf),
qk AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({toks_sql(words)}) AS term FROM qt) GROUP BY query_id, term),
bms AS (SELECT query_id, tf.pos, sum(times * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS score FROM qk JOIN idf USING (term) JOIN tf USING (term) JOIN dl ON dl.pos = tf.pos CROSS JOIN st GROUP BY query_id, tf.pos),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM (SELECT q.query_id, p.pos, round(coalesce(score, 0), 9) AS score FROM qt q CROSS JOIN lex p LEFT JOIN bms b ON b.query_id = q.query_id AND b.pos = p.pos)),
pv AS (SELECT pos, CAST(embedding AS DOUBLE[]) AS v FROM poi JOIN embeddings ON vec_id = pos % 500),
qv AS (SELECT query_id, CAST(embedding AS DOUBLE[]) AS v FROM qs JOIN embeddings USING (vec_id)),
dnr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM (SELECT query_id, pos, round(list_cosine_similarity(qv.v, pv.v), 9) AS score FROM qv CROSS JOIN pv)),
rrf AS (SELECT query_id, pos, sum(1.0e0 / (60 + rank)) AS rrf, least(1.0e0, sum(1.0e0 / (60 + rank)) / (2 / 61.0e0)) AS relevance FROM (SELECT query_id, pos, rank FROM bmr UNION ALL SELECT query_id, pos, rank FROM dnr) GROUP BY query_id, pos),
pairs AS (SELECT it.*, poi.*, relevance, {haversine_sql('anchor_lat', 'anchor_lon', 'lat', 'lon')} AS km, {folded_sql('req')} AS fr, {folded_sql('soft')} AS fs, {folded_sql('attributes')} AS fa,
  list_distinct((SELECT toks FROM qt WHERE qt.query_id = it.query_id)) AS qd, list_distinct({toks_sql("concat_ws(' ', replace(tags, ';', ' '), description)")}) AS rw, {toks_sql("concat_ws(' ', name, brand)")} AS ct, {list_sql('terms')} AS tm, {list_sql('residual')} AS res
  FROM it CROSS JOIN poi JOIN rrf ON rrf.query_id = it.query_id AND rrf.pos = poi.pos),
sig AS (SELECT *, {', '.join(f'{v} AS sig_{k}' for k, v in SIGNALS_SQL.items())} FROM pairs),
scored AS (SELECT *, {score_sql(TUNED)} AS score FROM sig),
cor AS (SELECT query_id, coalesce(bool_and(hit), FALSE) AS subject_ok FROM (SELECT it.query_id, t.term, t.term IS NOT NULL AND t.term IN (SELECT unnest({toks_sql("concat_ws(' ', name, brand)")}) FROM poi JOIN dnr ON dnr.pos = poi.pos WHERE dnr.query_id = it.query_id AND dnr.rank <= 10) AS hit FROM it LEFT JOIN (SELECT query_id, unnest({list_sql('terms')}) AS term FROM it) t ON t.query_id = it.query_id) GROUP BY query_id),
flags AS (SELECT scored.*, subject_ok, (want_city IS NULL OR city = want_city) AND (want_district IS NULL OR district = want_district) AS f1, want_city IS NOT NULL OR want_district IS NOT NULL AS byplace,
  CASE WHEN subject_ok AND len(tm) > 0 THEN len(list_filter(tm, lambda t: NOT list_contains(ct, t))) = 0 WHEN want_category IS NOT NULL AND len(CASE WHEN subject_ok AND len(tm) > 0 THEN res ELSE list_filter(res, lambda t: NOT list_contains(tm, t)) END) = 0 THEN category = want_category ELSE TRUE END AS fs2 FROM scored JOIN cor USING (query_id)),
levels AS (SELECT *, CASE WHEN bool_or(f1 AND fs2) OVER (PARTITION BY query_id) THEN 2 WHEN bool_or(f1 AND byplace) OVER (PARTITION BY query_id) THEN 1 ELSE 0 END AS level FROM flags),
kept AS (SELECT * FROM levels WHERE (level = 2 AND f1 AND fs2) OR (level = 1 AND f1) OR level = 0),
gate AS (SELECT *, count(*) FILTER (km <= 30) OVER (PARTITION BY query_id) AS n30, count(*) FILTER (km <= 150) OVER (PARTITION BY query_id) AS n150 FROM kept),
heads AS (SELECT *, coalesce(km <= CASE WHEN n30 >= 3 THEN 30 WHEN n150 >= 3 THEN 150 END, FALSE) AS near FROM gate),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY near DESC, CASE WHEN nearest AND near THEN CAST(coalesce(category <> want_category, FALSE) AS INTEGER) ELSE 0 END, CASE WHEN nearest AND near THEN round(km, 9) ELSE 0 END, round(score, 9) DESC, pos) AS rank FROM heads)
"""


COMMON = common(INTENTS)
TEXTS = common(EXPECTED, LEXICAL)
LEXICAL_SQL = "CASE query_id " + " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in LEXICAL.items()) + " END"


def queries_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES, "query_id string, text string, vec_id int").withColumn("toks", T.tokens(F.col("text")))


def intents_df(spark: SparkSession) -> DataFrame:
    from tessera.sources.places import split_list

    it = spark.createDataFrame(INTENTS, INTENT_COLUMNS)
    lists = {"required": "req", "soft": "soft", "terms": "terms", "residual": "residual"}
    it = it.withColumns({k: split_list(F.col(v)) for k, v in lists.items()}).drop("req")
    return it.join(queries_df(spark).select("query_id", "text", F.col("toks").alias("qtoks")), "query_id").withColumn("corrected_query", F.lit(None).cast("string"))


def docs_df(spark: SparkSession, sf: str) -> DataFrame:
    return places(spark, sf).select("pos", "poi_id", T.tokens(B.lexical_doc()).alias("toks"))


_INDEXES: dict[tuple[str, str], Index] = {}


def engine(spark: SparkSession, sf: str) -> Index:
    """The index of the places in a data folder, made once a session and read by all queries."""
    key = spark.sparkContext.applicationId, sf
    if key not in _INDEXES:
        e = table(spark, sf, "embeddings").where("vec_id < 500").select("vec_id", F.col("embedding").alias("v"))
        p = places(spark, sf)
        own = dealt(p.select("pos"), "pos").withColumn("vec_id", F.col("pos") % 500)
        _INDEXES[key] = Index(spark, p, own.join(F.broadcast(e), "vec_id").select("pos", "v"))
    return _INDEXES[key]


def index(spark: SparkSession, sf: str) -> B.Bm25:
    return engine(spark, sf).bm25


def lexical(spark: SparkSession, sf: str) -> DataFrame:
    return index(spark, sf).rank(queries_df(spark))


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return queries_df(spark).join(e, "vec_id").select("query_id", "v")


def dense(spark: SparkSession, sf: str) -> DataFrame:
    return B.dense(query_vectors(spark, sf), engine(spark, sf).vectors)


def fused(spark: SparkSession, sf: str) -> DataFrame:
    return engine(spark, sf).hybrid(queries_df(spark), query_vectors(spark, sf))


def signals(spark: SparkSession, sf: str) -> DataFrame:
    return engine(spark, sf).with_signals(intents_df(spark), fused(spark, sf))


def scored(spark: SparkSession, sf: str, weights: dict[str, float] = TUNED) -> DataFrame:
    return signals(spark, sf).withColumn("score", R.score(weights))


def final(spark: SparkSession, sf: str, most: int | None = None) -> DataFrame:
    """Ranks for the intents by hand."""
    return ranked(engine(spark, sf), intents_df(spark), fused(spark, sf), query_vectors(spark, sf), most=most)


def kept(spark: SparkSession, sf: str) -> DataFrame:
    return final(spark, sf)


def searched(spark: SparkSession, sf: str, most: int | None = None) -> DataFrame:
    """Ranks from the queries' texts alone."""
    return rank(engine(spark, sf), queries_df(spark).select("query_id", "text"), query_vectors(spark, sf), most=most)


def plain(df: DataFrame) -> DataFrame:
    """Types and roundings that both engines share: whole numbers long, doubles to 6 places, lists joined."""
    kinds = {"array<string>": lambda c: F.array_join(c, "|"), "int": lambda c: c.cast("long"), "bigint": lambda c: c, "double": lambda c: F.round(c, 6), "float": lambda c: F.round(c.cast("double"), 6)}
    return df.select(*(kinds[t](F.col(c)).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes))


class Registry:
    """Queries by name, with SQL that follows COMMON, where SQL can say them."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, common: bool = True, name: str | None = None, texts: bool = False, lists: tuple[str, ...] = ()):
        def wrap(f):
            key = name or f.__name__

            @functools.wraps(f)
            def run(spark: SparkSession, sf: str) -> DataFrame:
                return plain(f(spark, sf))

            self.queries[key] = run
            if sql is not None:
                self.sql[key] = ((TEXTS if texts else COMMON) if common else "") + sql
                if lists:
                    self.sql[key] = f"SELECT * REPLACE ({', '.join(f"array_to_string({c}, '|') AS {c}" for c in lists)}) FROM ({self.sql[key]})"
            return f

        return wrap
