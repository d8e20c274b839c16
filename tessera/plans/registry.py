"""All queries of the library and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import signals as S
from tessera.functions import text as T
from tessera.operators import engine as N
from tessera.operators import evaluation as E
from tessera.operators import parsing as P
from tessera.operators import ranking as R
from tessera.operators import retrieval as B
from tessera.operators import synthesis as Y
from tessera.plans import base as X
from tessera.plans.base import COMMON, fold_sql, haversine_sql, literal, open_sql, toks_sql, values
from tessera.sources import vocabulary as V
from tessera.sources.places import cache_key, display_words, missing, optional, optional_int, places, read_places, split_list, table
from tessera.sources.store import Store

REG = X.Registry()
add = REG.add


def small(spark: SparkSession, rows, ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


# Text.

WORDS = [(i, w) for i, w in enumerate(["wifi", "wifl", "wjfi", "tihn", "tinh", "bane", "caf", "phe", "khong", "khogn", "standrad", "standar", "quan", "uqan", "lang", "promoo", "econmy", "abdc"])]
RAW = [(1, " a; b ;;  c ", "4.7", "x"), (2, None, None, "  "), (3, "", "-2.9", None), (4, ";", "12", " y "), (5, "wifi", "abc", "z")]
POINTS = [(1, "10.7738, 106.7012 cay xang"), (2, "106.7012 10.7738"), (3, "gan 21.03 105.85 va 16.0 108.2"), (4, "5.0 106.7, 10.5 106.2"), (5, "10.5;106.2"), (6, "không có"), (7, None), (8, "-10.5 106.2 1.5")]
SEQS = [(1, "quan 1 tp hcm", "quan 1"), (2, "quan 12 tp hcm", "quan 1"), (3, "ca phe", ""), (4, "", "a"), (5, "a b a c", "a c"), (6, "abc", "b")]


@add(f"SELECT doc_id, {fold_sql('text')} AS folded FROM documents", common=False)
def fold_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@add(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {toks_sql('text')} AS t FROM documents)", common=False)
def tokenize_documents(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


EXPANDED = [("cf q1 co wifi", "ca phe quan 1 co wifi"), ("gas station 24/7", "tram xang 24/7"), ("quan cf sai gon", "quan ca phe tp hcm"), ("q123 q12 hn", "q123 quan 12 ha noi"), ("", ""), ("Khách sạn ĐN bv", "khach san dn bv")]


@add(values([(i, t, {"Khách sạn ĐN bv": "khach san da nang benh vien"}.get(t, x)) for i, (t, x) in enumerate(EXPANDED)], "id long, text string, expanded string"), common=False)
def expand_abbrev(spark, sf):
    q = small(spark, [(i, t) for i, (t, _) in enumerate(EXPANDED)], "id long, text string")
    return q.select("id", "text", F.array_join(T.expand(T.tokens(F.col("text"))), " ").alias("expanded"))


@add("SELECT doc_id, strip_accents(replace(replace(text, 'đ', 'd'), 'Đ', 'D')) AS plain FROM documents", common=False)
def strip_diacritics(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.strip_diacritics(F.col("text")).alias("plain"))


@add("SELECT doc_id, text <> strip_accents(replace(replace(text, 'đ', 'd'), 'Đ', 'D')) AS marked FROM documents", common=False)
def has_diacritics_gate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.has_diacritics(F.col("text")).alias("marked"))


@add(f", w AS ({values(WORDS, 'id int, term string')}) SELECT w.term, dq.term AS other FROM w JOIN dq ON length(w.term) >= 4 AND length(dq.term) >= 4 AND damerau_levenshtein(w.term, dq.term) <= 1")
def osa_edit1_pairs(spark, sf):
    side = lambda df, n: df.select("term", F.explode(T.deletions(F.col("term"))).alias("v")).withColumnRenamed("term", n).where(F.length(n) >= 4)
    w, lex = small(spark, WORDS, "id int, term string"), X.index(spark, sf).df
    return side(w, "term").join(side(lex, "other"), "v").select("term", "other").distinct().where(T.edit1(F.col("term"), F.col("other")))


CANON = f""", w AS ({values(WORDS, 'id int, term string')}), u AS (SELECT DISTINCT term FROM w WHERE length(term) >= 4 AND term NOT IN (SELECT term FROM dq)),
  c AS (SELECT u.term, dq.term AS other, CASE WHEN length(u.term) = length(dq.term) AND levenshtein(u.term, dq.term) = 2 THEN 0 ELSE 1 END AS tier FROM u JOIN dq ON length(dq.term) >= 4 AND damerau_levenshtein(u.term, dq.term) <= 1),
  b AS (SELECT *, min(tier) OVER (PARTITION BY term) AS best FROM c), canon AS (SELECT term, min(other) AS canonical FROM b WHERE tier = best GROUP BY term HAVING count(*) = 1)"""


@add(CANON + " SELECT * FROM canon")
def canonicalize_tokens(spark, sf):
    return B.canonical(small(spark, WORDS, "id int, term string"), X.index(spark, sf).df)


@add(f"WITH s AS ({values(SEQS, 'id long, hay string, key string')}) SELECT CAST(id AS BIGINT) AS id, key <> '' AND contains(' ' || hay || ' ', ' ' || key || ' ') AS hit FROM s", common=False)
def token_seq_contains(spark, sf):
    return small(spark, SEQS, "id long, hay string, key string").select("id", T.contains_seq(T.tokens(F.col("hay")), F.col("key")).alias("hit"))


@add(values([(1, 10.7738, 106.7012), (2, 10.7738, 106.7012), (3, 21.03, 105.85), (4, 10.5, 106.7), (5, None, None), (6, None, None), (7, None, None), (8, None, None)], "id long, lat double, lon double"), common=False)
def coord_detect(spark, sf):
    p = small(spark, POINTS, "id long, text string").select("id", T.coordinates(F.col("text")).alias("p"))
    return p.select("id", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))


@add(f"WITH r AS ({values(RAW, 'id long, parts string, num string, opt string')}) SELECT CAST(id AS BIGINT) AS id, array_to_string({X.list_sql('parts')}, '|') AS parts, CAST(len({X.list_sql('parts')}) AS BIGINT) AS n FROM r", common=False)
def split_clean(spark, sf):
    p = split_list(F.col("parts"))
    return small(spark, RAW, "id long, parts string, num string, opt string").select("id", F.array_join(p, "|").alias("parts"), F.size(p).alias("n"))


@add(f"WITH r AS ({values(RAW, 'id long, parts string, num string, opt string')}) SELECT CAST(id AS BIGINT) AS id, CAST(trunc(TRY_CAST(num AS DOUBLE)) AS BIGINT) AS num, nullif(trim(opt), '') AS opt FROM r", common=False)
def opt_casts(spark, sf):
    r = small(spark, RAW, "id long, parts string, num string, opt string")
    return r.select("id", optional_int(F.col("num")).alias("num"), optional(F.col("opt")).alias("opt"))


# Documents and statistics.


@add(" SELECT pos, poi_id, CAST(len(toks) AS BIGINT) AS n, md5(array_to_string(list_sort(toks), ' ')) AS digest FROM lex")
def lexical_doc(spark, sf):
    return X.docs_df(spark, sf).select("pos", "poi_id", F.size("toks").alias("n"), F.md5(F.array_join(F.sort_array("toks"), " ").cast("binary")).alias("digest"))


@add(" SELECT pos, name || '. ' || coalesce(brand, '') || '. ' || category || ' / ' || coalesce(sub_category, '') || '. ' || district || ', ' || city || '. Đặc điểm: ' || replace(attributes, ';', ', ') || '. ' || replace(tags, ';', ', ') || '. ' || description AS doc_text FROM poi")
def doc_text(spark, sf):
    return places(spark, sf).select("pos", B.doc_text().alias("doc_text"))


@add(f" SELECT pos, array_to_string(list_sort(list_distinct({toks_sql(chr(99) + 'oncat_ws(' + repr(' ') + ', name, brand)')})), ' ') AS toks FROM poi")
def content_tokens(spark, sf):
    return places(spark, sf).select("pos", F.array_join(F.sort_array(B.content_tokens()), " ").alias("toks"))


@add(" SELECT term, df FROM dq")
def doc_freq(spark, sf):
    return X.index(spark, sf).df


@add(" SELECT DISTINCT term FROM tf")
def lexicon(spark, sf):
    return X.index(spark, sf).df.select("term")


@add(" SELECT term, df, round(idf, 6) AS idf, n, round(avgdl, 6) AS avgdl FROM idf, st")
def bm25_stats(spark, sf):
    i = X.index(spark, sf)
    return i.idf.crossJoin(F.broadcast(i.totals))


@add(" SELECT query_id, pos, round(score, 6) AS score FROM bms")
def bm25_scores(spark, sf):
    return X.index(spark, sf).scores(X.queries_df(spark))


@add(" SELECT query_id, pos, round(score, 6) AS score, rank FROM bmr WHERE rank <= 20")
def bm25_rank(spark, sf):
    return X.index(spark, sf).top(X.queries_df(spark), 20)


@add(f""", d AS (SELECT query_id, list_filter(toks, lambda t: t NOT IN ('quan', '1')) AS kept, toks FROM qt), k2 AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(CASE WHEN len(kept) > 0 THEN kept ELSE toks END) AS term FROM d) GROUP BY query_id, term)
  SELECT query_id, tf.pos, round(sum(times * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 6) AS score FROM k2 JOIN idf USING (term) JOIN tf USING (term) JOIN dl ON dl.pos = tf.pos CROSS JOIN st GROUP BY query_id, tf.pos""")
def bm25_drop(spark, sf):
    q = X.queries_df(spark).withColumn("toks", B.drop_tokens(F.col("toks"), F.array(F.lit("quan"), F.lit("1"))))
    return X.index(spark, sf).scores(q)


OOV = [("T1", "wjfi khogn"), ("T2", "standrad rong"), ("T3", "ghi wifi ecnomy"), ("T4", "")]


@add(f""", w AS (SELECT query_id, unnest({toks_sql('text')}) AS term, generate_subscripts({toks_sql("text")}, 1) AS place FROM ({values(OOV, 'query_id string, text string')})),
  u AS (SELECT DISTINCT term FROM w WHERE length(term) >= 4 AND term NOT IN (SELECT term FROM dq)),
  c AS (SELECT u.term, dq.term AS other, CASE WHEN length(u.term) = length(dq.term) AND levenshtein(u.term, dq.term) = 2 THEN 0 ELSE 1 END AS tier FROM u JOIN dq ON length(dq.term) >= 4 AND damerau_levenshtein(u.term, dq.term) <= 1),
  b AS (SELECT *, min(tier) OVER (PARTITION BY term) AS best FROM c), canon AS (SELECT term, min(other) AS canonical FROM b WHERE tier = best GROUP BY term HAVING count(*) = 1)
  SELECT query_id, string_agg(coalesce(canonical, w.term), ' ' ORDER BY place) AS toks FROM w LEFT JOIN canon USING (term) GROUP BY query_id UNION ALL SELECT 'T4', ''""")
def bm25_oov(spark, sf):
    q = small(spark, OOV, "query_id string, text string").withColumn("toks", T.tokens(F.col("text")))
    return B.correct(q, X.index(spark, sf).df).select("query_id", F.array_join("toks", " ").alias("toks"))


# Dense retrieval and fusion.


@add(" SELECT query_id, pos, round(score, 6) AS cosine FROM dnr")
def dense_cosine(spark, sf):
    return X.dense(spark, sf).select("query_id", "pos", F.col("score").alias("cosine"))


@add(" SELECT query_id, pos, rank FROM dnr WHERE rank <= 10")
def dense_topk(spark, sf):
    return X.dense(spark, sf).where("rank <= 10").select("query_id", "pos", "rank")


@add("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dim, round(list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))), 6) AS greatest FROM embeddings", common=False)
def l2_normalize(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.size("embedding").alias("dim"), F.array_max(B.normalized(F.col("embedding"))).alias("greatest"))


@add(" SELECT query_id, pos, round(rrf, 6) AS rrf FROM rrf")
def rrf_fuse(spark, sf):
    return X.fused(spark, sf).select("query_id", "pos", "rrf")


@add(" SELECT query_id, pos, round(relevance, 6) AS relevance FROM rrf")
def hybrid_relevance(spark, sf):
    return X.fused(spark, sf).select("query_id", "pos", "relevance")


@add(" SELECT query_id, pos, round(least(1.0e0, (1.0e0 / (60 + rank)) / (1 / 61.0e0)), 6) AS relevance FROM bmr")
def relevance_bm25_only(spark, sf):
    none = X.query_vectors(spark, sf).limit(0)
    return X.engine(spark, sf).hybrid(X.queries_df(spark), none).select("query_id", "pos", "relevance")


# Scalars and signals.


@add(f" SELECT pos, round({haversine_sql('lat', 'lon', '21.0287e0', '105.8524e0')}, 6) AS km FROM poi")
def haversine(spark, sf):
    return places(spark, sf).select("pos", S.haversine(F.col("lat"), F.col("lon"), F.lit(21.0287), F.lit(105.8524)).alias("km"))


@add(f" SELECT pos, round(greatest(0.0e0, least(1.0e0, pow(2.718281828e0, -{haversine_sql('lat', 'lon', '10.7723e0', '106.698e0')} / 3.0e0))), 6) AS decay FROM poi")
def distance_decay(spark, sf):
    return places(spark, sf).select("pos", S.distance(S.haversine(F.col("lat"), F.col("lon"), F.lit(10.7723), F.lit(106.698))).alias("decay"))


for _signal in S.WEIGHTS:

    def _one(spark, sf, k=_signal):
        return X.signals(spark, sf).select("query_id", "pos", F.col(f"sig_{k}").alias("signal"))

    add(f" SELECT query_id, pos, round(sig_{_signal}, 6) AS signal FROM sig", name=f"sig_{_signal}")(_one)


@add(f" SELECT pos, {open_sql('720')} AS noon, {open_sql('120')} AS night FROM poi")
def open_intervals(spark, sf):
    return places(spark, sf).select("pos", S.is_open(F.col("opening_hours"), F.lit(720)).alias("noon"), S.is_open(F.col("opening_hours"), F.lit(120)).alias("night"))


@add(" SELECT query_id, pos, round(score, 6) AS score FROM scored")
def linear_score(spark, sf):
    return X.scored(spark, sf).select("query_id", "pos", "score")


@add(f" SELECT query_id, pos, round({X.score_sql(S.WEIGHTS)}, 6) AS score FROM sig")
def default_weights_score(spark, sf):
    return X.scored(spark, sf, S.WEIGHTS).select("query_id", "pos", "score")


FULL = " SELECT query_id, pos, poi_id, rank, round(score, 6) AS score, CAST(level AS BIGINT) AS level, near FROM final WHERE rank <= 10"


@add(FULL, texts=True)
def full_rank(spark, sf):
    """From the texts of queries alone."""
    return X.searched(spark, sf, 10).select("query_id", "pos", "poi_id", "rank", "score", "level", "near")


@add(FULL)
def intent_rank(spark, sf):
    return X.final(spark, sf, 10).select("query_id", "pos", "poi_id", "rank", "score", "level", "near")


@add(" SELECT query_id, want_category, list_sort(" + X.list_sql("req") + ") AS required, want_city, want_district, CAST(open_after AS BIGINT) AS open_after, price_pref, nearest, anchor_name, round(anchor_lat, 6) AS anchor_lat, round(anchor_lon, 6) AS anchor_lon, list_sort(" + X.list_sql("residual") + ") AS residual, " + X.list_sql("terms") + " AS terms FROM it", texts=True, lists=('required', 'residual', 'terms'))
def parse_intents(spark, sf):
    p = P.parse(spark, X.queries_df(spark).select("query_id", "text"), X.engine(spark, sf).lookups)
    return p.select("query_id", "want_category", F.sort_array("required").alias("required"), "want_city", "want_district", "open_after", "price_pref", "nearest", "anchor_name", "anchor_lat", "anchor_lon", F.sort_array("residual").alias("residual"), "terms")


@add(" SELECT query_id, list_sort(string_split(CASE WHEN query_id = 'Q08' THEN '' ELSE (" + X.LEXICAL_SQL + ") END, ' ')) AS words FROM qs", texts=True, lists=('words',))
def lexical_words(spark, sf):
    """The words by which texts are retrieved: expanded, corrected, without the district."""
    e = X.engine(spark, sf)
    asked = P.parse(spark, X.queries_df(spark).select("query_id", "text"), e.lookups).select("query_id", "text", T.tokens(F.col("want_district")).alias("drop"))
    words = e.lexical(asked)
    return words.select("query_id", F.when(F.size("toks") > 0, F.sort_array("toks")).otherwise(F.array(F.lit(""))).alias("words"))


# Filters, gates, windows.


@add(" SELECT query_id, pos FROM flags WHERE f1")
def location_filter(spark, sf):
    q = X.intents_df(spark)
    ok = F.coalesce(F.col("city") == F.col("want_city"), F.lit(True)) & F.coalesce(F.col("district") == F.col("want_district"), F.lit(True))
    return places(spark, sf).select("pos", "city", "district").crossJoin(F.broadcast(q.select("query_id", "want_city", "want_district"))).where(ok).select("query_id", "pos")


@add(" SELECT query_id, pos FROM flags WHERE len(list_filter(tm, lambda t: NOT list_contains(ct, t))) = 0 AND len(tm) > 0")
def subject_filter(spark, sf):
    q = X.intents_df(spark).select("query_id", "terms").where(F.size("terms") > 0)
    return places(spark, sf).select("pos", B.content_tokens().alias("ctoks")).crossJoin(F.broadcast(q)).where(F.size(F.array_except("terms", "ctoks")) == 0).select("query_id", "pos")


@add(" SELECT query_id, pos FROM flags WHERE want_category = category AND len(list_filter(res, lambda t: NOT list_contains(tm, t))) = 0")
def category_filter(spark, sf):
    """With all content terms discredited."""
    q = X.intents_df(spark).where(F.size(F.array_except("residual", "terms")) == 0).select("query_id", F.col("want_category").alias("category"))
    return places(spark, sf).join(q, "category").select("query_id", "pos")


@add(" SELECT query_id, list_sort(CASE WHEN subject_ok AND len(tm) > 0 THEN res ELSE list_filter(res, lambda t: NOT list_contains(tm, t)) END) AS unexplained FROM flags GROUP BY ALL", lists=('unexplained',))
def discredited(spark, sf):
    """What is left unexplained of a query once its vectors have had their say."""
    ok = R.corroborated(X.intents_df(spark).select("query_id", "terms"), X.dense(spark, sf), X.engine(spark, sf).places)
    by_subject = F.col("subject_ok") & (F.size("terms") > 0)
    left = F.when(by_subject, F.col("residual")).otherwise(F.array_except("residual", "terms"))
    return X.intents_df(spark).join(ok, "query_id").select("query_id", F.sort_array(left).alias("unexplained"))


@add(" SELECT query_id, CAST(max(level) AS BIGINT) AS level, count(*) AS n FROM kept GROUP BY query_id")
def relaxation(spark, sf):
    return X.kept(spark, sf).groupBy("query_id").agg(F.max("level").alias("level"), F.count("*").alias("n"))


@add(" SELECT query_id, subject_ok FROM cor")
def corroboration(spark, sf):
    return R.corroborated(X.intents_df(spark).select("query_id", "terms"), X.dense(spark, sf), X.engine(spark, sf).places)


@add(" SELECT query_id, count(*) FILTER (near) AS near, count(*) AS n FROM heads GROUP BY query_id")
def anchor_gate(spark, sf):
    return X.final(spark, sf).groupBy("query_id").agg(F.count_if("near").alias("near"), F.count("*").alias("n"))


@add(" SELECT query_id, pos, rank, round(km, 6) AS km FROM final WHERE nearest AND rank <= 20")
def anchor_nearest(spark, sf):
    return X.final(spark, sf, 20).where("nearest").select("query_id", "pos", "rank", "km")


@add(" SELECT pos FROM poi WHERE lon BETWEEN 105.8e0 AND 106.7e0 AND lat BETWEEN 10.75e0 AND 21.0e0")
def window_bbox(spark, sf):
    return places(spark, sf).where(R.in_window(bbox=R.parse_bbox("105.8,10.75,106.7,21.0"))).select("pos")


@add(f" SELECT pos FROM poi WHERE category = 'ATM' AND {haversine_sql('21.0287e0', '105.8524e0', 'lat', 'lon')} * 1000 <= 9000")
def window_radius(spark, sf):
    return places(spark, sf).where(R.in_window(category="ATM", lat=21.0287, lon=105.8524, meters=9000)).select("pos")


WINDOW = "category = 'ATM' AND lat BETWEEN 20.0e0 AND 22.0e0 AND lon BETWEEN 105.0e0 AND 106.5e0"


@add(f""", f AS (SELECT query_id, pos, score, rank, 'search' AS source FROM final WHERE {WINDOW}), miss AS (SELECT DISTINCT query_id FROM final WHERE query_id NOT IN (SELECT query_id FROM f)),
  s AS (SELECT query_id, pos, 0.0e0 AS score, row_number() OVER (PARTITION BY query_id ORDER BY round({haversine_sql('21.0e0', '105.8e0', 'lat', 'lon')}, 9), popularity DESC, pos) AS rank, 'fallback' AS source FROM miss CROSS JOIN poi WHERE {WINDOW}),
  u AS (SELECT * FROM f UNION ALL SELECT * FROM s), v AS (SELECT query_id, pos, round(score, 6) AS score, source, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM u) SELECT * FROM v WHERE rank <= 5""")
def fallback_order(spark, sf):
    w = R.in_window(bbox=(105.0, 20.0, 106.5, 22.0), category="ATM")
    return R.with_fallback(X.final(spark, sf), places(spark, sf), w, 21.0, 105.8, 5).select("query_id", "pos", "score", "source", "rank")


@add(" SELECT query_id, pos, 0.0e0 AS score, rank FROM bmr WHERE rank <= 10")
def keyword_lane(spark, sf):
    return X.index(spark, sf).top(X.queries_df(spark), 10).select("query_id", "pos", F.lit(0.0).alias("score"), "rank")


@add(" SELECT query_id, pos, k.rank AS rank_keyword, s.rank AS rank_semantic, k.rank - s.rank AS delta FROM (SELECT * FROM bmr WHERE rank <= 10) k FULL JOIN (SELECT query_id, pos, rank FROM final WHERE rank <= 10) s USING (query_id, pos)")
def lane_rank_delta(spark, sf):
    k = X.index(spark, sf).top(X.queries_df(spark), 10).select("query_id", "pos", F.col("rank").alias("rank_keyword"))
    s = X.final(spark, sf, 10).select("query_id", "pos", F.col("rank").alias("rank_semantic"))
    return k.join(s, ["query_id", "pos"], "full").withColumn("delta", F.col("rank_keyword") - F.col("rank_semantic"))


# Parsing.


def phrase_sql(kind_table: dict, kind: str) -> str:
    return values([(kind, i, T.py_fold(k), T.compatible_pattern(k), v) for i, k, v in V.keys(kind_table)], "kind string, ord int, key string, pattern string, value string")


HAY = f""", hy AS (SELECT query_id, text, ' ' || array_to_string(toks, ' ') || ' ' AS hay, ' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}/]+', ' ', 'g')) || ' ' AS shown FROM qt)"""


def hits_sql(table_: dict, kind: str) -> str:
    return HAY + f", ph AS ({phrase_sql(table_, kind)}), hits AS (SELECT query_id, ord, key, value FROM hy JOIN ph ON contains(hay, ' ' || key || ' ') AND regexp_matches(shown, pattern))"


def plain_hits(spark, kind: str) -> DataFrame:
    """Matches without abbreviations and typos, so that SQL can say them too."""
    q = X.queries_df(spark).withColumn("hay", T.padded(F.col("toks")))
    return q.join(F.broadcast(P.phrases(spark).where(F.col("kind") == kind).select("ord", "key", "pattern", "value")), P.matches(F.col("hay"), F.col("text"), F.col("key"), F.col("pattern"))).select("query_id", "ord", "key", "value")


def best_hit(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg(F.min_by("value", F.struct((-F.length("key")).alias("l"), "ord")).alias("value"))


for _kind, _table in (("category", V.CATEGORIES), ("need", V.NEEDS)):

    def _best(spark, sf, k=_kind):
        return best_hit(plain_hits(spark, k))

    add(hits_sql(_table, _kind) + " SELECT query_id, value FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(key) DESC, ord) AS r FROM hits) WHERE r = 1", name=f"keyword_{_kind}")(_best)


@add(hits_sql(V.ATTRIBUTES, "attribute") + " SELECT query_id, array_to_string(list_sort(list_distinct(list(value))), ';') AS attrs FROM hits GROUP BY query_id")
def keyword_attrs(spark, sf):
    return plain_hits(spark, "attribute").groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("value")), ";").alias("attrs"))


@add(hits_sql(V.PRICES, "price") + " SELECT query_id, CASE WHEN bool_or(value = 'cheap') THEN 'cheap' ELSE 'expensive' END AS price_pref FROM hits GROUP BY query_id")
def price_pref(spark, sf):
    return plain_hits(spark, "price").groupBy("query_id").agg(F.when(F.max(F.col("value") == "cheap"), "cheap").otherwise("expensive").alias("price_pref"))


@add(""", g AS (SELECT pos, lat, lon, district AS name, 0 AS o FROM poi UNION ALL SELECT pos, lat, lon, district || ', ' || city, 1 FROM poi)
  SELECT """ + fold_sql("name") + """ AS key, arg_min(name, pos * 2 + o) AS name, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM g GROUP BY 1""")
def district_centroids(spark, sf):
    return P.districts(places(spark, sf)).select("key", "name", "lat", "lon")


@add(HAY + f""", lm AS ({values([(i, n, T.compatible_pattern(n), lat, lon) for i, (n, lat, lon) in enumerate(V.LANDMARKS)], 'ord int, name string, pattern string, lat double, lon double')}),
  g AS (SELECT pos, lat, lon, district AS name, 0 AS o FROM poi UNION ALL SELECT pos, lat, lon, district || ', ' || city, 1 FROM poi), ds AS (SELECT {fold_sql('name')} AS key, min(pos * 2 + o) AS ord, arg_min(name, pos * 2 + o) AS name, avg(lat) AS lat, avg(lon) AS lon FROM g GROUP BY 1),
  tiers AS (SELECT query_id, 0 AS tier, ord, name, lat, lon FROM hy JOIN lm ON regexp_matches(shown, pattern) UNION ALL SELECT query_id, 1, ord, name, lat, lon FROM hy JOIN ds ON contains(hay, ' ' || key || ' '))
  SELECT query_id, name, round(lat, 6) AS lat, round(lon, 6) AS lon FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, ord) AS r FROM tiers) WHERE r = 1""")
def gazetteer_resolve(spark, sf):
    q = X.queries_df(spark).withColumn("hay", T.padded(F.col("toks")))
    marks = P.phrases(spark).where("kind = 'landmark'").withColumnRenamed("value", "name")
    m = q.join(F.broadcast(marks), F.rlike(T.display(F.col("text")), F.col("pattern"))).groupBy("query_id").agg(F.min_by(F.struct("name", "lat", "lon"), "ord").alias("m"))
    d = q.join(F.broadcast(P.districts(places(spark, sf))), F.contains("hay", F.concat(F.lit(" "), "key", F.lit(" ")))).groupBy("query_id").agg(F.min_by(F.struct("name", "lat", "lon"), "ord").alias("d"))
    return q.select("query_id").join(m, "query_id", "left").join(d, "query_id", "left").select("query_id", F.coalesce("m", "d").alias("a")).where("a IS NOT NULL").select("query_id", "a.*")


@add(f" SELECT query_id, array_to_string(list_filter(list_distinct(toks), lambda t: 1 = 0), ' ') || coalesce((SELECT string_agg(term, ' ' ORDER BY term) FROM (SELECT DISTINCT unnest(toks) AS term) WHERE length(term) >= 2 AND NOT regexp_matches(term, '^\\d+$') AND term NOT IN ({', '.join(map(literal, V.STOPWORDS))})), '') AS residual FROM qt")
def residual_terms(spark, sf):
    left = F.filter(F.array_distinct("toks"), lambda t: ~t.isin(*V.STOPWORDS) & (F.length(t) >= 2) & ~t.rlike("^\\d+$"))
    return X.queries_df(spark).select("query_id", F.array_join(F.sort_array(left), " ").alias("residual"))


@add(f" SELECT term, count(*) AS df FROM (SELECT DISTINCT pos, unnest({toks_sql(chr(99) + 'oncat_ws(' + repr(' ') + ', name, brand)')}) AS term FROM poi) WHERE regexp_matches(term, '^[a-z]{{3,}}$') GROUP BY term HAVING count(*) <= 2")
def distinctive_terms(spark, sf):
    words = places(spark, sf).select("pos", F.explode(B.content_tokens()).alias("term")).where("term RLIKE '^[a-z]{3,}$'")
    return words.groupBy("term").agg(F.count("*").alias("df")).where("df <= 2")


# Explanations and projections.

REASONS = f""", rs AS (SELECT query_id, pos, rank, list_filter([
  CASE WHEN len(list_intersect(fr, fa)) > 0 THEN array_to_string(list_transform(list_filter({X.list_sql('req')}, lambda a: list_contains(fa, {fold_sql('a')})), lambda a: '✓ ' || a), ', ') END,
  CASE WHEN anchor_name IS NULL THEN NULL WHEN district = want_district AND starts_with(anchor_name, want_district) THEN 'trong ' || want_district
    WHEN km >= 1 THEN 'cách ' || anchor_name || ' ' || printf('%.1f km', km) ELSE 'cách ' || anchor_name || ' ' || CAST(CAST(round(km * 100) * 10 AS INTEGER) AS VARCHAR) || ' m' END,
  printf('%.1f', rating) || '★ · ' || replace(format('{{:,}}', review_count), ',', '.') || ' đánh giá',
  CASE WHEN opening_hours = '24/7' THEN 'mở 24/7' WHEN opening_hours IS NOT NULL THEN 'mở đến ' || regexp_extract(opening_hours, '-(.*)$', 1) END], lambda x: x IS NOT NULL) AS rs FROM final WHERE rank <= 5)"""


@add(REASONS + " SELECT query_id, pos, rank, array_to_string(rs[1:4], ' | ') AS reasons FROM rs")
def reasons(spark, sf):
    return X.final(spark, sf, 5).select("query_id", "pos", "rank", F.array_join(R.reasons(), " | ").alias("reasons"))


@add(" SELECT pos, CAST(CASE WHEN list_contains(string_split(attributes, ';'), 'wifi') THEN 2 ELSE 3 END AS BIGINT) AS n_bad FROM poi")
def validate_reasons(spark, sf):
    said = F.array(F.lit("✓ wifi"), F.lit("✓ hồ bơi"), F.lit("9.9★ · 1 đánh giá"), F.concat(F.format_string("%.1f", F.col("rating")), F.lit("★ · "), T.thousands(F.col("review_count")), F.lit(" đánh giá")))
    return places(spark, sf).select("pos", F.size(R.violations(said)).alias("n_bad"))


@add(" SELECT query_id, rank, '{\"id\":\"poi:' || poi_id || '\",\"label\":\"' || name || ', ' || district || '\",\"category\":\"' || category || '\"}' AS place FROM final WHERE rank <= 3")
def place_result_json(spark, sf):
    place = F.to_json(F.struct(F.concat(F.lit("poi:"), "poi_id").alias("id"), F.concat_ws(", ", "name", "district").alias("label"), "category"))
    return X.final(spark, sf, 3).select("query_id", "rank", place.alias("place"))


@add(" SELECT pos, replace(format('{:,}', review_count), ',', '.') AS shown FROM poi")
def fmt_int(spark, sf):
    return places(spark, sf).select("pos", T.thousands(F.col("review_count")).alias("shown"))


# Evaluation: queries are vectors, relevant are the first five of their label.

EVAL = """, ev AS (SELECT vec_id, label FROM embeddings WHERE vec_id < 20), rel AS (SELECT 'V' || ev.vec_id AS query_id, e.vec_id AS poi_id, row_number() OVER (PARTITION BY ev.vec_id ORDER BY e.vec_id) AS ord FROM ev JOIN embeddings e ON e.label = ev.label AND e.vec_id <> ev.vec_id),
  rels AS (SELECT query_id, poi_id, CASE ord WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS gain FROM rel WHERE ord <= 5),
  er AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, poi_id) AS rank FROM (SELECT 'V' || a.vec_id AS query_id, b.vec_id AS poi_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < 20 AND a.vec_id <> b.vec_id)),
  ideal AS (SELECT query_id, count(*) AS n, sum(CASE WHEN i <= 5 THEN gain / log2(i + 1.0e0) ELSE 0 END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS i FROM rels) GROUP BY query_id),
  hit AS (SELECT query_id, count(*) FILTER (rank <= 3) AS h3, count(*) FILTER (rank <= 5) AS h5, sum(CASE WHEN rank <= 5 THEN gain / log2(rank + 1.0e0) ELSE 0 END) AS dcg, min(rank) AS first FROM er JOIN rels USING (query_id, poi_id) GROUP BY query_id),
  metrics AS (SELECT query_id, coalesce(h3 * 1.0e0 / n, 0) AS recall3, coalesce(h5 * 1.0e0 / n, 0) AS recall5, coalesce(dcg / idcg, 0) AS ndcg5, coalesce(1.0e0 / first, 0) AS mrr FROM ideal LEFT JOIN hit USING (query_id)),
  strata AS (SELECT *, CASE CAST(substr(query_id, 2) AS INTEGER) % 3 WHEN 0 THEN 'Easy' WHEN 1 THEN 'Medium' ELSE 'Hard' END AS difficulty, CASE CAST(substr(query_id, 2) AS INTEGER) % 4 WHEN 0 THEN 'a' ELSE 'b' END AS query_category FROM metrics)"""


def rels_df(spark, sf) -> DataFrame:
    from pyspark.sql.window import Window

    e = table(spark, sf, "embeddings")
    pairs = F.broadcast(e.where("vec_id < 20").select(F.col("vec_id").alias("q"), "label")).join(e.select("vec_id", "label"), "label").where("q <> vec_id")
    first = pairs.withColumn("ord", F.row_number().over(Window.partitionBy("q").orderBy("vec_id"))).where("ord <= 5")
    expected = first.groupBy(F.concat(F.lit("V"), "q").alias("query_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "vec_id"))), lambda x: x["vec_id"]).alias("expected_ids"))
    return E.qrels(expected)


def vector_ranks(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").alias("v"))
    q = e.where("pos < 20").select(F.concat(F.lit("V"), "pos").alias("query_id"), "v")
    found = B.dense(q, e).where(F.concat(F.lit("V"), "pos") != F.col("query_id"))
    return B.ranked(found.drop("rank")).select("query_id", F.col("pos").alias("poi_id"), "rank")


def metrics_df(spark, sf) -> DataFrame:
    n = F.substring("query_id", 2, 9).cast("int")
    m = E.per_query(vector_ranks(spark, sf), rels_df(spark, sf))
    return m.withColumns({"difficulty": F.when(n % 3 == 0, "Easy").when(n % 3 == 1, "Medium").otherwise("Hard"), "query_category": F.when(n % 4 == 0, "a").otherwise("b")})


@add(EVAL + " SELECT query_id, poi_id, CAST(gain AS BIGINT) AS gain FROM rels")
def eval_gains(spark, sf):
    return rels_df(spark, sf)


@add(EVAL + " SELECT query_id, round(recall3, 6) AS recall3, round(recall5, 6) AS recall5 FROM metrics")
def recall_at_k(spark, sf):
    return metrics_df(spark, sf).select("query_id", "recall3", "recall5")


@add(EVAL + " SELECT query_id, round(ndcg5, 6) AS ndcg5 FROM metrics")
def ndcg_at_5(spark, sf):
    return metrics_df(spark, sf).select("query_id", "ndcg5")


@add(EVAL + " SELECT query_id, round(mrr, 6) AS mrr FROM metrics")
def mrr(spark, sf):
    return metrics_df(spark, sf).select("query_id", "mrr")


@add(EVAL + " SELECT difficulty, query_category, count(*) AS n, round(avg(recall3), 6) AS recall3, round(avg(recall5), 6) AS recall5, round(avg(ndcg5), 6) AS ndcg5, round(avg(mrr), 6) AS mrr FROM strata GROUP BY GROUPING SETS ((), (difficulty), (query_category))")
def eval_grouping_sets(spark, sf):
    return E.summary(metrics_df(spark, sf))


def uniform_sql(seed: int, *keys: str) -> str:
    x = f"CAST({seed} AS BIGINT)"
    for k in keys:
        x = f"((({x}) * 69069 + ({k}) * 7919 + 12345) % 2147483647)"
    for _ in range(3):
        x = f"((({x}) * 48271 + 11) % 2147483647)"
    return f"({x} / 2147483647.0e0)"


@add(EVAL + f""", num AS (SELECT row_number() OVER (ORDER BY query_id) AS i, ndcg5 AS m FROM metrics), nn AS (SELECT count(*) AS n FROM num), draws AS (SELECT b, CAST(floor({uniform_sql(20260712, 'b', 'd')} * n) AS BIGINT) + 1 AS i FROM nn, (SELECT CAST(unnest(range(1, 501)) AS BIGINT) AS b), LATERAL (SELECT CAST(unnest(range(1, n + 1)) AS BIGINT) AS d)),
  means AS (SELECT b, avg(m) AS m FROM draws JOIN num USING (i) GROUP BY b) SELECT round(quantile_cont(m, 0.025), 6) AS low, round((SELECT avg(m) FROM num), 6) AS mean, round(quantile_cont(m, 0.975), 6) AS high FROM means""")
def bootstrap_ci(spark, sf):
    return E.bootstrap(metrics_df(spark, sf), "ndcg5", 500)


@add("""WITH s AS (SELECT 'D' || doc_id AS query_id, lang AS stratum FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('42:' || query_id)) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM s)
  SELECT query_id, stratum, CASE WHEN r <= round_even(n / 3.0e0, 0) THEN 'test' ELSE 'tune' END AS split FROM o""", common=False)
def stratified_split(spark, sf):
    q = table(spark, sf, "documents").select(F.concat(F.lit("D"), "doc_id").alias("query_id"), F.col("lang").alias("stratum"))
    return E.split(q)


@add(" SELECT query_id, text FROM qs WHERE query_id IN ('Q02', 'Q05', 'Q09', 'nope')")
def split_semi(spark, sf):
    test = small(spark, [("Q02",), ("Q05",), ("Q09",), ("nope",)], "query_id string")
    return X.queries_df(spark).join(F.broadcast(test), "query_id", "left_semi").select("query_id", "text")


PREL = ", prel AS (SELECT it.query_id, poi_id, CASE WHEN popularity >= 95 THEN 3 ELSE 1 END AS gain FROM it JOIN poi ON poi.category = it.want_category AND popularity >= 90)"
HYBRID = ", hyb AS (SELECT rrf.query_id, rrf.pos, row_number() OVER (PARTITION BY rrf.query_id ORDER BY round(rrf, 9) DESC, bmr.rank) AS rank FROM rrf JOIN bmr ON bmr.query_id = rrf.query_id AND bmr.pos = rrf.pos), rnd AS (SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY md5('0:' || query_id || ':' || pos), pos) AS rank FROM qs CROSS JOIN poi)"
LANES = {"random": "rnd", "bm25": "bmr", "dense": "dnr", "hybrid": "hyb", "full": "final"}
MEANS = """ SELECT stage, count(*) AS n, round(avg(coalesce(h3 * 1.0e0 / m, 0)), 6) AS recall3, round(avg(coalesce(h5 * 1.0e0 / m, 0)), 6) AS recall5, round(avg(coalesce(dcg / idcg, 0)), 6) AS ndcg5, round(avg(coalesce(1.0e0 / first, 0)), 6) AS mrr
  FROM (SELECT unnest(['random', 'bm25', 'dense', 'hybrid', 'full']) AS stage) CROSS JOIN (SELECT query_id, count(*) AS m, sum(CASE WHEN i <= 5 THEN gain / log2(i + 1.0e0) ELSE 0 END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS i FROM prel) GROUP BY query_id) ideal
  LEFT JOIN (SELECT engine AS stage, query_id, count(*) FILTER (rank <= 3) AS h3, count(*) FILTER (rank <= 5) AS h5, sum(CASE WHEN rank <= 5 THEN gain / log2(rank + 1.0e0) ELSE 0 END) AS dcg, min(rank) AS first FROM lanes JOIN poi USING (pos) JOIN prel USING (query_id, poi_id) GROUP BY ALL) hits USING (stage, query_id) GROUP BY stage"""


def place_rels(spark, sf) -> DataFrame:
    wanted = X.intents_df(spark).select("query_id", F.col("want_category").alias("category"))
    return X.engine(spark, sf).places.where("popularity >= 90").join(F.broadcast(wanted), "category").select("query_id", "poi_id", F.when(F.col("popularity") >= 95, 3).otherwise(1).alias("gain"))


def stage_lists(spark, sf) -> dict[str, DataFrame]:
    """Every stage's ranks of the places that are relevant to a query, as (query_id, poi_id, rank); words, vectors and their fusion come of one pass."""
    store, ids = Store(spark), X.engine(spark, sf).places.select("pos", "poi_id")
    relevant = store.write(ids.hint("merge").join(place_rels(spark, sf).select("query_id", "poi_id").distinct(), "poi_id"), "relevant")
    own = lambda lists: lists.join(relevant.hint("merge"), ["query_id", "pos"])
    order = B.Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 9)), "bm25_rank")
    both = X.fused(spark, sf).withColumn("hybrid_rank", F.row_number().over(order)).select("query_id", "pos", "bm25_rank", "dense_rank", "hybrid_rank")
    both = store.write(own(both), "both")
    rest = {"random": N.random_order(X.queries_df(spark), ids), "full": X.final(spark, sf)}
    lists = {k: both.withColumn("rank", F.col(f"{k}_rank")) for k in ("bm25", "dense", "hybrid")} | {k: own(v.select("query_id", "pos", "rank")) for k, v in rest.items()}
    return {k: lists[k].select("query_id", "poi_id", "rank") for k in LANES}


@add(PREL + HYBRID + ", lanes AS (" + " UNION ALL ".join(f"SELECT '{k}' AS engine, query_id, pos, rank FROM {v}" for k, v in LANES.items()) + ")" + MEANS)
def ablation(spark, sf):
    return E.ablation(stage_lists(spark, sf), place_rels(spark, sf))


@add(HYBRID + " SELECT query_id, pos, rank FROM hyb WHERE rank <= 20")
def rrf_order(spark, sf):
    v = X.dense(spark, sf)
    return B.fused_order(X.lexical(spark, sf), v).where("rank <= 20").select("query_id", "pos", "rank")


@add(HYBRID + " SELECT query_id, pos, rank FROM rnd WHERE rank <= 20")
def random_order(spark, sf):
    return N.random_order(X.queries_df(spark), places(spark, sf)).where("rank <= 20")


@add("SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS top, count(*) AS n FROM events", common=False)
def quantiles(spark, sf):
    c = E.cumulative(table(spark, sf, "events"), "value", Store(spark))
    n = c.agg(F.max("hi").alias("n"))
    return c.crossJoin(F.broadcast(n)).agg(E.percentile(0.5).alias("p50"), E.percentile(0.95).alias("p95"), F.max("value").alias("top"), F.max("n").alias("n"))


@add(", r AS (SELECT value, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM events) SELECT round(max(value) FILTER (i = CAST(floor(n * 0.95e0) AS BIGINT)), 6) AS p95_index, round(max(value) FILTER (i = CAST(round_even((n - 1) * 0.95e0, 0) AS BIGINT) + 1), 6) AS p95_nearest FROM r")
def quantiles_by_rank(spark, sf):
    c = E.cumulative(table(spark, sf, "events"), "value", Store(spark))
    n = c.agg(F.max("hi").alias("n"))
    return c.crossJoin(F.broadcast(n)).agg(E.at_rank(F.floor(F.col("n") * 0.95)).alias("p95_index"), E.at_rank(F.bround((F.col("n") - 1) * 0.95) + 1).alias("p95_nearest"))


@add(""", g AS (SELECT 'G' || i AS gate FROM (SELECT unnest(range(1, 6)) AS i))""" + PREL + HYBRID + ", lanes AS (" + " UNION ALL ".join(f"SELECT '{k}' AS engine, query_id, pos, rank FROM {v}" for k, v in LANES.items()) + "), m AS (" + MEANS + """),
  o AS (SELECT max(recall5) FILTER (stage = 'bm25') AS r, max(ndcg5) FILTER (stage = 'hybrid') AS h, greatest(max(ndcg5) FILTER (stage = 'bm25'), max(ndcg5) FILTER (stage = 'dense')) AS p, max(ndcg5) FILTER (stage = 'full') AS n, max(recall3) FILTER (stage = 'full') AS r3 FROM m)
  SELECT gate, CASE gate WHEN 'G1' THEN r WHEN 'G2' THEN h WHEN 'G3' THEN n WHEN 'G4' THEN 57.0e0 ELSE 0.0e0 END AS value, CASE gate WHEN 'G1' THEN 0.55e0 WHEN 'G2' THEN p WHEN 'G3' THEN 0.8e0 WHEN 'G4' THEN 200.0e0 ELSE 0.0e0 END AS threshold,
  CASE gate WHEN 'G1' THEN r >= 0.55e0 WHEN 'G2' THEN h > p WHEN 'G3' THEN n >= 0.8e0 AND r3 >= 0.75e0 ELSE TRUE END AS passed FROM g, o""")
def gate_report(spark, sf):
    a = Store(spark).write(E.ablation(stage_lists(spark, sf), place_rels(spark, sf)), "stages")
    return E.gates(a.where("stage <> 'full'"), a.where("stage = 'full'"), F.lit(57.0), F.lit(0))


# Parts of responses.


@add(" SELECT query_id, rank, list_transform(list_sort([" + ", ".join(f"{{'v': -round(sig_{k}, 9), 'o': {i}, 'k': '{k}'}}" for i, k in enumerate(S.WEIGHTS)) + "])[1:3], lambda x: x.k) AS names FROM final WHERE rank <= 3", lists=('names',))
def top_signals(spark, sf):
    return X.final(spark, sf, 3).select("query_id", "rank", R.top_signals().alias("names"))


METRES = "CAST(round_even(" + haversine_sql("21.0287e0", "105.8524e0", "lat", "lon") + " * 1000, 0) AS BIGINT)"


@add(f" SELECT query_id, rank, 'poi:' || poi_id AS id, name || ', ' || district AS label, address, category, round(lat, 6) AS lat, round(lon, 6) AS lon, {METRES} AS metres, round_even(score, 4) AS score FROM final WHERE rank <= 5")
def place_rows(spark, sf):
    p = X.final(spark, sf, 5).withColumn("source", F.lit("search")).select("query_id", "rank", N.place_row((21.0287, 105.8524)).alias("r"))
    return p.select("query_id", "rank", "r.id", "r.label", "r.address", "r.category", "r.coordinates.lat", "r.coordinates.lon", F.col("r.distanceMeters").alias("metres"), "r.score")


@add(f" SELECT 'poi:' || poi_id AS id, name || ', ' || district AS label, address AS description, round(lat, 6) AS lat, {METRES} AS metres FROM poi")
def client_suggestions(spark, sf):
    p = places(spark, sf).withColumns({"score": F.lit(0.0), "source": F.lit("search")}).select(N.place_row((21.0287, 105.8524)).alias("result"))
    return N.suggestions(p).select("id", "label", "description", "coordinates.lat", F.col("meta.distanceMeters").alias("metres"))


@add(" SELECT query_id, want_category AS category, " + X.list_sql("req") + " AS attrs, anchor_name AS anchor, want_city AS city, CASE WHEN open_after IS NOT NULL THEN lpad(CAST(open_after // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(open_after % 60 AS VARCHAR), 2, '0') END AS open_after FROM it", lists=('attrs',))
def intent_echo(spark, sf):
    e = X.intents_df(spark).select("query_id", N.intent_echo().alias("e"))
    return e.select("query_id", "e.category", F.col("e.requiredAttrs").alias("attrs"), F.col("e.anchor.name").alias("anchor"), "e.city", F.col("e.openAfter").alias("open_after"))


@add(""" SELECT qs.query_id, text AS query, count(*) AS n, 4 AS limit_applied, string_agg('poi:' || poi_id, ' ' ORDER BY rank) AS ids, CAST(NULL AS VARCHAR) AS corrected, round(max(round_even(sig_price, 4)) FILTER (rank = 1), 4) AS price_of_first
  FROM qs JOIN final USING (query_id) WHERE rank <= 4 GROUP BY ALL""", texts=True)
def search_responses(spark, sf):
    """The envelope of semantic search, one row a query."""
    r = N.responses(X.searched(spark, sf, 4).withColumn("source", F.lit("search")), 4, semantic=True)
    return r.select("query_id", "query", F.col("meta.count").alias("n"), F.col("meta.limitApplied").alias("limit_applied"), F.array_join(F.transform("results", lambda x: x["id"]), " ").alias("ids"), F.col("meta.correctedQuery").alias("corrected"), F.get("results", F.lit(0))["breakdown"]["price"].alias("price_of_first"))


REQUESTS = [("r1", "cà phê", None, None, None, None, 50), ("r2", "  ", None, None, None, None, None), ("r3", "atm", 10.0, None, None, None, 0), ("r4", "atm", 10.0, 106.0, -1.0, None, 3), ("r5", "atm", None, None, 5.0, None, 3), ("r6", "atm", None, None, None, "1,2,3", 3), ("r7", "atm", 10.0, 106.0, 0.0, "1,2,3,4", None), ("r8", None, None, None, None, None, 3), ("r9", "atm", None, None, None, "1,2,x,4", -7)]
REQUEST_COLUMNS = "request_id string, q string, lat double, lon double, radius_meters double, bbox string, limit int"


@add(f"""WITH r AS ({values([x[:6] + (x[6],) for x in REQUESTS], REQUEST_COLUMNS.replace('limit int', 'lim int'))}), b AS (SELECT *, string_split(bbox, ',') AS box FROM r)
  SELECT request_id, CAST(greatest(1, least(20, coalesce(lim, 10))) AS BIGINT) AS lim, CASE WHEN trim(coalesce(q, '')) = '' THEN 'q' WHEN (lat IS NULL) <> (lon IS NULL) THEN 'lat' WHEN radius_meters IS NOT NULL AND (lat IS NULL OR radius_meters < 0) THEN 'radiusMeters' WHEN bbox IS NOT NULL AND (len(box) <> 4 OR len(list_filter(box, lambda x: TRY_CAST(x AS DOUBLE) IS NULL)) > 0) THEN 'bbox' END AS wrong,
  CASE WHEN wrong IS NOT NULL THEN 'invalid_request' END AS code FROM b""", common=False)
def request_errors(spark, sf):
    r = N.checked_requests(small(spark, REQUESTS, REQUEST_COLUMNS))
    said = F.col("error.message")
    wrong = F.when(said.contains("'q'"), "q").when(said.startswith("lat"), "lat").when(said.startswith("radius"), "radiusMeters").when(said.startswith("bbox"), "bbox")
    return r.select("request_id", F.col("limit").alias("lim"), wrong.alias("wrong"), F.col("error.code").alias("code"))


CORRECTIONS = [(1, "quan ca phe", "  quán  cà phê\n"), (2, "quán cà phê", "QUÁN CÀ PHÊ"), (3, "atm", "zzz unrelated"), (4, "atm", "   "), (5, "atm", "atm " * 60), (6, "atm", None), (7, "gan ho guom", "gần Hồ Gươm"), (8, "Đà Lạt", "đà lạt")]


@add(f"""WITH c AS ({values(CORRECTIONS, 'id int, original string, value string')}), n AS (SELECT *, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS clean FROM c),
  r AS (SELECT *, CASE WHEN value IS NULL THEN NULL WHEN clean = '' THEN 'empty' WHEN length(clean) > 200 THEN 'too-long' WHEN lower(clean) = lower(original) THEN 'no-op' WHEN len(list_intersect({toks_sql('clean')}, {toks_sql('original')})) = 0 THEN 'no-overlap' END AS reason FROM n)
  SELECT CAST(id AS BIGINT) AS id, CASE WHEN reason IS NULL THEN clean END AS text, reason FROM r""", common=False)
def corrected_query_checks(spark, sf):
    c = small(spark, CORRECTIONS, "id int, original string, value string").select("id", T.corrected_query(F.col("original"), F.col("value")).alias("c"))
    return c.select("id", "c.text", "c.reason")


@add(""", u AS (SELECT query_id, bool_or(length(t) >= 4 AND t NOT IN (SELECT term FROM dq)) AS oov FROM (SELECT query_id, unnest(toks) AS t FROM qt) GROUP BY query_id)
  SELECT query_id, text = strip_accents(replace(replace(text, 'đ', 'd'), 'Đ', 'D')) OR coalesce(oov, FALSE) AS degraded FROM qt LEFT JOIN u USING (query_id)""")
def degradation_gate(spark, sf):
    q = X.queries_df(spark)
    unknown = q.select("query_id", F.explode("toks").alias("term")).where(F.length("term") >= 4).join(X.index(spark, sf).df, "term", "left_anti").select("query_id").distinct().withColumn("oov", F.lit(True))
    return q.join(unknown, "query_id", "left").select("query_id", P.needs_model(F.col("text"), F.coalesce("oov", F.lit(False))).alias("degraded"))


RESOLVED = [("Q05", '{"corrected_query": "quán cà phê quận 1 có wifi", "attributes": ["yên tĩnh"]}'), ("Q09", '{"category": "Công viên", "corrected_query": "cong vien baaah"}'), ("Q08", '{"category": "ATM", "price_pref": "free"}'), ("Q11", "not json"), ("Q02", '{"corrected_query": "san bay"}'), ("Q12", '```json\n{"price_pref": "cheap", "open_after": "22:15"}\n```')]
RESOLVED_WANT = [("Q01", "Quán cà phê", "yên tĩnh", None, None, None, ""), ("Q02", "Khách sạn", "check-in;gần biển", None, None, None, ""), ("Q05", "Quán cà phê", "wifi;yên tĩnh", None, None, "quán cà phê quận 1 có wifi", ""), ("Q08", "ATM", "", None, None, None, ""), ("Q09", None, "", None, None, None, "baaah;le;loi"), ("Q11", "ATM", "", None, None, None, "baafh"), ("Q12", "Nhà hàng", "", "cheap", 1335, None, "")]


@add(values(RESOLVED_WANT, "query_id string, want_category string, required string, price_pref string, open_after long, corrected_query string, residual string"), common=False)
def resolve_intents(spark, sf):
    """Replies of a model resolved with the rules; the SQL side states what is expected, as it can't parse."""
    e = X.engine(spark, sf)
    r = P.resolve(spark, X.queries_df(spark).select("query_id", "text"), small(spark, RESOLVED, "query_id string, raw string"), e.lookups, e.bm25.df)
    kept = r.where(F.col("query_id").isin(*(x[0] for x in RESOLVED_WANT)))
    return kept.select("query_id", "want_category", F.array_join(F.sort_array("required"), ";").alias("required"), "price_pref", "open_after", "corrected_query", F.array_join(F.sort_array("residual"), ";").alias("residual"))


@add(f""", cw AS ({values([(T.py_fold(w), T.compatible_pattern(w)) for w in V.COMMON], 'term string, pattern string')}), sh AS (SELECT query_id, toks, ' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}/]+', ' ', 'g')) || ' ' AS shown FROM qt)
  SELECT query_id, list_sort(list(DISTINCT term)) AS words FROM sh JOIN cw ON list_contains(toks, term) AND regexp_matches(shown, pattern) GROUP BY query_id""", lists=('words',))
def common_flags(spark, sf):
    """Common words of queries, where their diacritics agree."""
    shown = X.queries_df(spark).select("query_id", T.display(F.col("text")).alias("shown"), F.explode("toks").alias("term"))
    hit = shown.join(X.engine(spark, sf).lookups.common, "term").where(F.rlike("shown", F.col("pattern")))
    return hit.groupBy("query_id").agg(F.sort_array(F.collect_set("term")).alias("words"))


# Sets, reports and checks.


@add("WITH s AS (SELECT 'D' || doc_id AS query_id, lang AS stratum FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('42:' || query_id)) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM s), x AS (SELECT query_id, r <= round_even(n / 3.0e0, 0) AS test FROM o) SELECT count(*) AS shared FROM (SELECT query_id FROM x WHERE test INTERSECT SELECT query_id FROM x WHERE NOT test)", common=False)
def disjoint_splits(spark, sf):
    x = E.split(table(spark, sf, "documents").select(F.concat(F.lit("D"), "doc_id").alias("query_id"), F.col("lang").alias("stratum")))
    return E.disjoint(x.where("split = 'test'").select("query_id"), x.where("split = 'tune'").select("query_id"))


@add(" SELECT 'left' AS side, poi_id FROM poi WHERE category = 'ATM' AND rating > 4.2e0 AND city <> 'Hà Nội' UNION ALL SELECT 'right', poi_id FROM poi WHERE category = 'ATM' AND rating <= 4.2e0 AND city = 'Hà Nội'")
def set_differences(spark, sf):
    p = places(spark, sf).where("category = 'ATM'")
    # poi_id is cut to six digits, so beyond a million places several share one: rows are told apart by pos.
    return E.differences(p.where("rating > 4.2").select("pos", "poi_id"), p.where("city = 'Hà Nội'").select("pos", "poi_id")).select("side", "poi_id")


PROVIDERS = [("local", 0.71), ("other", 0.74), ("third", 0.74), ("down", None)]


@add(f"WITH p AS ({values(PROVIDERS, 'provider string, ndcg5 double')}) SELECT min(provider) AS provider, ndcg5 FROM p WHERE ndcg5 = (SELECT max(ndcg5) FROM p) GROUP BY ndcg5", common=False)
def best_provider(spark, sf):
    return E.best_provider(small(spark, PROVIDERS, "provider string, ndcg5 double"))


ARMS = [("tune@111", 0.801, 0.797), ("tune@1000", 0.7, 0.69), ("synth@1000", 0.61, 0.64)]


@add(f"WITH a AS ({values(ARMS, 'arm string, committed double, candidate double')}), t AS (SELECT max(candidate) FILTER (arm = 'tune@111') >= max(committed) FILTER (arm = 'tune@111') - 0.005e0 AS guard_ok, max(candidate) FILTER (arm = 'synth@1000') > max(committed) FILTER (arm = 'synth@1000') AS improves FROM a) SELECT *, guard_ok AND improves AS accept FROM t", common=False)
def acceptance(spark, sf):
    return E.accepted(small(spark, ARMS, "arm string, committed double, candidate double"), "tune@111", "synth@1000")


@add()
def stress(spark, sf):
    """Every query clean, without diacritics, and with a typo, ranked from its text: mean metrics of each kind."""
    q = E.degraded(X.queries_df(spark).select("query_id", "text"), Y.with_typo)
    v = X.query_vectors(spark, sf)
    ids = q.select("query_id", "of", "degradation")
    found = N.rank(X.engine(spark, sf), q.select("query_id", "text"), ids.join(v.withColumnRenamed("query_id", "of"), "of").select("query_id", "v"))
    rels = ids.join(place_rels(spark, sf).withColumnRenamed("query_id", "of"), "of").select("query_id", "poi_id", "gain")
    m = E.per_query(found.select("query_id", "poi_id", "rank"), rels).join(ids, "query_id")
    return m.groupBy("degradation").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in E.METRICS))


RAW_PLACES = """SELECT CAST(p_partkey AS STRING) AS poi_id, concat('  ', p_name, ' ') AS poi_name, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_brand END AS brand, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN 'abc' WHEN 3 THEN 'NaN' WHEN 4 THEN '3.9' ELSE CAST(p_size AS STRING) END AS price_level,
  CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '4.5' WHEN 2 THEN 'x' ELSE ' 3 ' END AS rating, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' a; ;b ' ELSE '' END AS tags FROM part"""


@add(f"WITH raw AS ({RAW_PLACES}) SELECT poi_id, trim(poi_name) AS name, nullif(trim(brand), '') AS brand, CASE WHEN isnan(TRY_CAST(trim(price_level) AS DOUBLE)) THEN NULL ELSE CAST(trunc(TRY_CAST(trim(price_level) AS DOUBLE)) AS BIGINT) END AS price_level, TRY_CAST(trim(rating) AS DOUBLE) AS rating, {X.list_sql('tags')} AS tags FROM raw", common=False, lists=('tags',))
def read_raw_places(spark, sf):
    raw = spark.sql(RAW_PLACES.replace("FROM part", "FROM {part}"), part=table(spark, sf, "part"))
    rest = {c: F.lit(None).cast("string") for c in ("category", "city", "district", "address", "description", "sub_category", "opening_hours", "latitude", "longitude", "popularity_score", "review_count", "attributes")}
    return read_places(raw.withColumns(rest)).select("poi_id", "name", "brand", "price_level", "rating", "tags")


@add("SELECT item_id, replace(text, 'the', '***') AS hidden, replace(replace(substr(text, 1, 40), '/', '_'), ':', '_') AS safe FROM benchmark", common=False)
def redacted(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.redacted(F.col("text"), "the").alias("hidden"), T.safe_name(F.substring("text", 1, 40)).alias("safe"))


# Model output as data.

OUTPUTS = [
    ("Q01", '```json\n{"category": "Nhà hàng", "attributes": ["wifi", "hồ bơi"], "price_pref": "cheap", "open_after": "22:30"}\n```'),
    ("Q02", 'Here: {"category": "Sân bay", "attributes": [], "price_pref": "free", "open_after": "25:00"} ok'),
    ("Q03", "not json"), ("Q05", '{"attributes": ["yên tĩnh", "wifi"], "corrected_query": "cà phê quận 1"}'), ("Q08", '{"category": "ATM"}'),
]
VALID = [("Q01", "Nhà hàng", "cheap", "22:30", "wifi", "attribute:hồ bơi"), ("Q02", None, None, None, "", "category;price_pref;open_after"), ("Q03", None, None, None, "", ""), ("Q05", None, None, None, "yên tĩnh;wifi", ""), ("Q08", "ATM", None, None, "", "")]


@add(values(VALID, "query_id string, category string, price_pref string, open_after string, attributes string, dropped string"), common=False)
def llm_validate(spark, sf):
    v = P.validated(small(spark, OUTPUTS, "query_id string, raw string"))
    return v.select("query_id", "category", "price_pref", "open_after", F.array_join("attributes", ";").alias("attributes"), F.array_join("dropped", ";").alias("dropped"))


@add(f""", v AS ({values(VALID, 'query_id string, category string, price_pref string, open_after string, attributes string, dropped string')})
  SELECT it.query_id, coalesce(want_category, category) AS want_category, coalesce(it.price_pref, v.price_pref) AS price_pref, CAST(coalesce(it.open_after, CAST(split_part(v.open_after, ':', 1) AS INTEGER) * 60 + CAST(split_part(v.open_after, ':', 2) AS INTEGER)) AS BIGINT) AS open_after,
  array_to_string(list_sort(list_distinct(list_concat({X.list_sql('req')}, {X.list_sql('attributes')}))), ';') AS required FROM it LEFT JOIN v USING (query_id)""")
def merge_intent(spark, sf):
    m = P.merged(X.intents_df(spark), P.validated(small(spark, OUTPUTS, "query_id string, raw string")))
    return m.select("query_id", "want_category", "price_pref", "open_after", F.array_join(F.sort_array("required"), ";").alias("required"))


GUARD = [("a", "ATM", "wifi", "x", "ATM", "wifi;late", "x"), ("b", "ATM", "", "", None, "", ""), ("c", None, "wifi", "", "ATM", "", ""), ("d", None, "", "x", None, "", "x;y"), ("e", None, "", "", "ATM", "", "")]


@add(f"WITH g AS ({values(GUARD, 'id string, c1 string, r1 string, t1 string, c2 string, r2 string, t2 string')}) SELECT id, (c1 IS NOT NULL AND c2 IS NULL) OR len(list_filter({X.list_sql('r1')}, lambda x: NOT list_contains({X.list_sql('r2')}, x))) > 0 OR len({X.list_sql('t2')}) > len({X.list_sql('t1')}) AS worse FROM g", common=False)
def rewrite_guard(spark, sf):
    g = small(spark, GUARD, "id string, c1 string, r1 string, t1 string, c2 string, r2 string, t2 string")
    intent = lambda i: F.struct(F.col(f"c{i}").alias("category"), split_list(F.col(f"r{i}")).alias("required"), split_list(F.col(f"t{i}")).alias("residual"))
    return g.select("id", intent(1).alias("before"), intent(2).alias("after")).select("id", P.degrades("before", "after").alias("worse"))


GRID = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5]

@add(PREL + f""", gv AS (SELECT unnest([{', '.join(f'{g}e0' for g in GRID)}]) AS value), gs AS (SELECT value, query_id, poi_id, pos, round({X.score_sql(S.TUNED | {'popularity': 0.0}).replace('0.0e0 * sig_popularity', 'value * sig_popularity').replace('(0.0e0) * sig_popularity', '(value) * sig_popularity')}, 9) AS s0, sig.* EXCLUDE (query_id, poi_id, pos) FROM sig CROSS JOIN gv),
  gr AS (SELECT value, query_id, poi_id, row_number() OVER (PARTITION BY value, query_id ORDER BY round(({' + '.join(f"(CASE WHEN anchor_lat IS NULL THEN 0.0e0 ELSE {S.TUNED[k]}e0 END) * sig_{k}" if k == 'distance' else (f'value * sig_{k}' if k == 'popularity' else f'{S.TUNED[k]}e0 * sig_{k}') for k in S.WEIGHTS)}) / ({' + '.join('(CASE WHEN anchor_lat IS NULL THEN 0.0e0 ELSE ' + str(S.TUNED[k]) + 'e0 END)' if k == 'distance' else ('value' if k == 'popularity' else f'{S.TUNED[k]}e0') for k in S.WEIGHTS)}), 9) DESC, pos) AS rank FROM gs),
  gd AS (SELECT value, query_id, sum(coalesce(gain, 0) / log2(rank + 1.0e0)) AS dcg FROM gr LEFT JOIN prel USING (query_id, poi_id) WHERE rank <= 5 GROUP BY value, query_id),
  gi AS (SELECT query_id, sum(gain / log2(i + 1.0e0)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS i FROM prel) WHERE i <= 5 GROUP BY query_id)
  SELECT value, round(avg(dcg / idcg), 6) AS ndcg5 FROM gd JOIN gi USING (query_id) GROUP BY value""")
def tune_grid_scores(spark, sf):
    return E.grid_scores(X.signals(spark, sf), S.TUNED, "popularity", GRID, place_rels(spark, sf))


# Synthetic data.

WEIGHTED = [("a", 3), ("b", 3), ("c", 1), ("d", 2), ("e", 7)]


@add(f"WITH w AS ({values(WEIGHTED, 'key string, weight int')}), q AS (SELECT key, weight * 100.0e0 / sum(weight) OVER () AS q FROM w), f AS (SELECT key, q, CAST(floor(q) AS BIGINT) AS n, 100 - sum(floor(q)) OVER () AS rest FROM q) SELECT key, n + CASE WHEN row_number() OVER (ORDER BY round(q - n, 9) DESC, key DESC) <= rest THEN 1 ELSE 0 END AS n FROM f", common=False)
def apportion(spark, sf):
    return Y.apportion(small(spark, WEIGHTED, "key string, weight int"), 100)


@add(" SELECT city, round(min(lat), 6) AS min_lat, round(max(lat), 6) AS max_lat, round(min(lon), 6) AS min_lon, round(max(lon), 6) AS max_lon, array_to_string(list_sort(list_distinct(list(district))), '|') AS districts, count(*) AS n FROM poi GROUP BY city")
def city_boxes(spark, sf):
    return Y.city_boxes(places(spark, sf))


LATE = "coalesce(opening_hours = '24/7' OR split_part(split_part(opening_hours, '-', 2), ':', 1)::INT * 60 + split_part(split_part(opening_hours, '-', 2), ':', 2)::INT < split_part(split_part(opening_hours, '-', 1), ':', 1)::INT * 60 + split_part(split_part(opening_hours, '-', 1), ':', 2)::INT OR split_part(split_part(opening_hours, '-', 2), ':', 1)::INT >= 23, FALSE)"
LATE = f"CASE WHEN opening_hours IS NULL THEN FALSE WHEN opening_hours = '24/7' THEN TRUE ELSE {LATE} END"


@add(f" SELECT pos, {LATE} AS late FROM poi")
def late_hours(spark, sf):
    return places(spark, sf).select("pos", Y.open_late(F.col("opening_hours")).alias("late"))


@add(f""", s AS (SELECT 'S1' AS query_id, poi_id, row_number() OVER (ORDER BY rating DESC, popularity DESC, pos) AS ord FROM poi WHERE category = 'ATM' AND city = 'Hà Nội' AND list_contains(string_split(attributes, ';'), 'wifi')
  UNION ALL SELECT 'S2', poi_id, row_number() OVER (ORDER BY coalesce(price_level, 99), rating DESC, pos) FROM poi WHERE category = 'Quán cà phê' AND {LATE}
  UNION ALL SELECT 'S3', poi_id, row_number() OVER (ORDER BY coalesce(price_level, 0) DESC, rating DESC, pos) FROM poi WHERE price_level IN (3, 4)) SELECT * FROM s WHERE ord <= 8""")
def synth_predicate_labels(spark, sf):
    specs = [("S1", Y.predicate(category="ATM", city="Hà Nội", attributes=("wifi",)), "quality"), ("S2", Y.predicate(category="Quán cà phê", late=True), "price_asc"), ("S3", Y.predicate(price=(3, 4)), "price_desc")]
    return Y.labels(places(spark, sf), specs)


@add(f"WITH c AS (SELECT key, weight, i AS ord, sum(weight) OVER (ORDER BY i) AS high, sum(weight) OVER () AS total FROM ({values([(i, k, w) for i, (k, w) in enumerate(WEIGHTED)], 'i int, key string, weight int')})), d AS (SELECT p_partkey AS draw_id, {uniform_sql(7, 'CAST(p_partkey AS BIGINT)')} AS u FROM part) SELECT draw_id, key AS choice FROM d JOIN c ON u * total >= high - weight AND u * total < high", common=False)
def weighted_choice(spark, sf):
    draws = table(spark, sf, "part").select(F.col("p_partkey").alias("draw_id"), E.uniform(7, F.col("p_partkey")).alias("u"))
    return Y.weighted_choice(draws, small(spark, [(i, k, w) for i, (k, w) in enumerate(WEIGHTED)], "ord int, key string, weight int"))


U = lambda f, i: uniform_sql(5, "CAST(p_partkey AS BIGINT)", str(f), f"CAST({i} AS BIGINT)")
POOL = [("wifi", 5.0), ("yên tĩnh", 4.0), ("lãng mạn", 1.0), ("check-in", 2.0), ("gần biển", 3.0)]
POOL_SQL = "[" + ", ".join(f"{{'name': '{n}', 'weight': {w}e0}}" for n, w in POOL) + "]"


def pool_df(spark):
    return F.array(*(F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w in POOL))


@add(f"""WITH p AS (SELECT p_partkey, p_size % 3 = 0 AS coast, {POOL_SQL} AS pool FROM part), q AS (SELECT *, list_filter(pool, lambda x: x.name <> 'gần biển' OR coast) AS own FROM p),
  k AS (SELECT p_partkey, unnest(range(0, len(own))) AS i, own, least(len(own), 2 + CAST(floor({uniform_sql(5, "CAST(p_partkey AS BIGINT)", "3")} * 4) AS BIGINT)) AS n FROM q),
  r AS (SELECT p_partkey, own[i + 1].name AS name, n, row_number() OVER (PARTITION BY p_partkey ORDER BY round(-pow({U(4, 'i')}, 1.0e0 / own[i + 1].weight), 9), i) AS r FROM k)
  SELECT p_partkey AS pos, string_agg(name, ';' ORDER BY r) AS names FROM r WHERE r <= n GROUP BY p_partkey""", common=False)
def sampled_attributes(spark, sf):
    """2 to 5 attributes by weight without replacement, the coastal one on the coast alone."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), (F.col("p_size") % 3 == 0).alias("coast"))
    own = F.filter(pool_df(spark), lambda x: (x["name"] != Y.COASTAL) | F.col("coast"))
    p = p.withColumn("own", own)
    n = F.least(F.size("own"), F.lit(2) + F.floor(E.uniform(5, F.col("pos"), F.lit(3)) * 4).cast("int"))
    return p.select("pos", F.array_join(Y.sampled(F.col("own"), n, lambda i: E.uniform(5, F.col("pos"), F.lit(4), i)), ";").alias("names"))


@add(f"""WITH u AS (SELECT p_partkey AS pos, {uniform_sql(9, 'CAST(p_partkey AS BIGINT)', '14')} AS a, {uniform_sql(9, 'CAST(p_partkey AS BIGINT)', '15')} AS b FROM part)
  SELECT pos, round(greatest(3.8e0, least(4.7e0, 4.3e0 + 0.25e0 * sqrt(-2 * ln(1 - a)) * cos(2 * 3.141592653589793e0 * b))), 6) AS rating, CAST(round(exp(ln(120) + a * (ln(9000) - ln(120)))) AS BIGINT) AS reviews FROM u""", common=False)
def drawn_numbers(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), E.uniform(9, F.col("p_partkey"), F.lit(14)).alias("a"), E.uniform(9, F.col("p_partkey"), F.lit(15)).alias("b"))
    return p.select("pos", Y.gauss(F.col("a"), F.col("b"), 4.3, 0.25, 3.8, 4.7).alias("rating"), Y.log_uniform(F.col("a"), F.lit(120.0), F.lit(9000.0)).alias("reviews"))


STYLED = "trim(regexp_replace(p_name || ' ở ' || 'Quận ' || (p_partkey % 12 + 1), '\\s+', ' ', 'g'))"


@add(f"""WITH s AS (SELECT p_partkey AS pos, ['none', 'diacritics', 'abbrev', 'mixed'][p_partkey % 4 + 1] AS style, p_name, p_type, p_partkey FROM part)
  SELECT pos, style, CASE style WHEN 'none' THEN {STYLED} WHEN 'diacritics' THEN strip_accents({STYLED}) WHEN 'abbrev' THEN p_name || ' ở q' || (p_partkey % 12 + 1) ELSE lower(p_type) || ' ở Quận ' || (p_partkey % 12 + 1) END AS text,
  CASE WHEN p_partkey % 3 = 0 THEN 'Easy' WHEN p_partkey % 3 = 1 THEN 'Medium' ELSE 'Hard' END AS difficulty FROM s""", common=False)
def styled_queries(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part").withColumn("style", F.get(F.array(*map(F.lit, ("none", "diacritics", "abbrev", "mixed"))), (k % 4).cast("int")))
    number = (k % 12 + 1).cast("string")
    text = Y.with_style(F.col("p_name"), F.col("style"), F.concat(F.lit("Quận "), number), F.concat(F.lit("q"), number), F.lower("p_type"), F.lit(0.5))
    family = F.get(F.array(*map(F.lit, ("brand", "attribute-seek", "price"))), (k % 3).cast("int"))
    return p.select(k.alias("pos"), "style", text.alias("text"), Y.difficulty(family, F.lit(None), F.array(), F.col("style")).alias("difficulty"))


@add()
def synth_places(spark, sf):
    return Y.generated(places(spark, sf), 300, 7).select("poi_id", "name", "category", "city", "district", "lat", "lon", "rating", "review_count", "popularity", "price_level", "opening_hours", F.array_join("attributes", ";").alias("attributes"))


@add()
def synth_queries(spark, sf):
    q = Y.queries(places(spark, sf), 300, 7, X.queries_df(spark))
    return q.select("query_id", "input_query", "family", "style", "difficulty", F.array_join("expected_ids", ";").alias("expected_ids"), "skills")


@add()
def weighted_sample(spark, sf):
    items = places(spark, sf).select(F.col("city").alias("group"), F.col("poi_id").alias("item"), F.col("popularity").alias("weight"), "pos")
    return Y.weighted_sample(items, 5, E.uniform(11, F.col("pos"))).select("group", "item")


@add(" SELECT pos, CASE WHEN length(name) >= 4 THEN substr(name, 1, 1) || substr(name, 3, 1) || substr(name, 2, 1) || substr(name, 4) ELSE name END AS typo FROM poi")
def typo_swap(spark, sf):
    return places(spark, sf).select("pos", Y.swapped(F.col("name"), F.lit(2)).alias("typo"))


@add(" SELECT source, category, count(*) AS n FROM (SELECT 'official' AS source, category FROM poi UNION ALL SELECT 'synthetic', category FROM poi WHERE pos % 3 = 0) GROUP BY ALL")
def union_corpora(spark, sf):
    p = places(spark, sf)
    both = p.withColumn("source", F.lit("official")).unionByName(p.where("pos % 3 = 0").withColumn("source", F.lit("synthetic")))
    return both.groupBy("source", "category").agg(F.count("*").alias("n"))


@add(f", g AS ({values([(1, 'quán cà phê yên tĩnh quận 1'), (2, 'QUAN CA PHE YEN TINH QUAN 1'), (3, 'bãi biển')], 'id int, text string')}) SELECT CAST(id AS BIGINT) AS id, text FROM g WHERE text NOT IN (SELECT text FROM qs) AND {fold_sql('text')} NOT IN (SELECT {fold_sql('text')} FROM qs)")
def unseen_queries(spark, sf):
    made = small(spark, [(1, "quán cà phê yên tĩnh quận 1"), (2, "QUAN CA PHE YEN TINH QUAN 1"), (3, "bãi biển")], "id int, text string")
    old = X.queries_df(spark).select(T.fold(F.col("text")).alias("f")).distinct()
    return made.withColumn("f", T.fold(F.col("text"))).join(F.broadcast(old), "f", "left_anti").select("id", "text")


@add("SELECT doc_id, sha1('local:m1:' || text) AS key FROM documents", common=False)
def cache_key_sha1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", cache_key("local", "m1", F.col("text")).alias("key"))


@add("SELECT doc_id FROM documents WHERE doc_id % 2 = 1", common=False)
def cache_misses(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return missing(d, d.where("doc_id % 2 = 0"), "doc_id")


@add(" SELECT q.query_id, count(f.pos) AS n FROM qs q LEFT JOIN final f ON f.query_id = q.query_id AND f.rank <= 10 GROUP BY q.query_id", texts=True)
def robustness_nonempty(spark, sf):
    return X.queries_df(spark).select("query_id").join(X.searched(spark, sf, 10).select("query_id", "pos"), "query_id", "left").groupBy("query_id").agg(F.count("pos").alias("n"))


COMMON_WORDS = [("# a comment",), ("nhất",), ("nhật",), ("",), ("  đi ",), ("đi",)]


@add(values([("nhat", "nhất|nhật"), ("di", "đi")], "folded string, forms string"), common=False)
def common_words(spark, sf):
    d = display_words(small(spark, COMMON_WORDS, "value string"))
    return d.select("folded", F.array_join("forms", "|").alias("forms"))


def queries():
    return dict(REG.queries)


def oracle_sql():
    return dict(REG.sql)


__all__ = ["COMMON", "oracle_sql", "queries"]
