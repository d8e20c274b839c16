import math
import random
import re
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import signals as S
from tessera.functions import text as T
from tessera.operators import evaluation as E
from tessera.operators import parsing as P
from tessera.operators import retrieval as B
from tessera.operators import synthesis as Y
from tessera.plans import registry
from tessera.plans.base import engine
from tessera.sources import places as L
from tessera.sources import vocabulary as V
from tessera.streaming.rank_stream import query_stream, rank_stream

TABLES = "documents embeddings events part benchmark".split()
QUICK = ["fold_documents", "tokenize_documents", "expand_abbrev", "osa_edit1_pairs", "canonicalize_tokens", "bm25_oov", "token_seq_contains", "coord_detect", "split_clean", "opt_casts", "bm25_rank", "bm25_drop", "haversine", "sig_attributes", "full_rank", "intent_rank", "parse_intents", "discredited", "fallback_order", "keyword_category", "gazetteer_resolve", "reasons", "eval_grouping_sets", "bootstrap_ci", "stratified_split", "llm_validate", "merge_intent", "rewrite_guard", "tune_grid_scores", "apportion", "late_hours", "synth_predicate_labels", "weighted_choice", "ablation", "rrf_order", "quantiles", "quantiles_by_rank", "top_signals", "place_rows", "request_errors", "corrected_query_checks", "degradation_gate", "resolve_intents", "common_flags", "set_differences", "read_raw_places", "sampled_attributes", "drawn_numbers", "styled_queries"]


def norm(v):
    if isinstance(v, list):
        return tuple(map(norm, v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", QUICK)
def test_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=str)
    assert sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str) == want


def column(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_text(spark):
    assert column(spark, "Nhà Hàng  Bờ-Sông", T.fold) == "nha hang bo song"
    assert column(spark, "Đường Số 9/2", T.tokens) == ["duong", "so", "9/2"]
    assert column(spark, "ks q3 hn", lambda c: T.expand(T.tokens(c))) == ["khach", "san", "quan", "3", "ha", "noi"]
    assert column(spark, "quan cf gas station", lambda c: T.expand(T.tokens(c))) == ["quan", "ca", "phe", "tram", "xang"]
    assert column(spark, unicodedata.normalize("NFD", "Hồ Tây"), T.composed) == "Hồ Tây"
    assert column(spark, "plain ascii, only: 24/7!", T.fold) == "plain ascii only 24/7"
    for name in ("Phố Cổ", "Quận 1", "Đà Lạt, Lâm Đồng"):
        assert column(spark, name, T.pattern) == T.compatible_pattern(name)


def test_fold_as_python(spark):
    r = random.Random(2)
    letters = "abcXYZ019/ .,-đĐáàảãạăắẵấậéèẽẹêếềệíìịóòõọôốộơớợúùũụưứựýỳỵñüßçø" + "\u0301\u0323\t\n"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(400)]
    got = [x.f for x in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.fold(F.col("t")).alias("f")).collect()]
    assert got == [T.py_fold(t) for t in texts]


def edits(w, other=""):
    """All words at one edit of w over its own letters, another word's, and a few more."""
    letters = set(w) | set(other) | set("xz")
    out = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
    out |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
    return out | {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)}


def test_canonical(spark):
    r = random.Random(3)
    vocabulary = sorted({"".join(r.choice("abcd") for _ in range(r.randint(3, 6))) for _ in range(60)})
    words = sorted({r.choice(sorted(edits(w))) for w in vocabulary for _ in range(3)})

    def want(w):
        if w in vocabulary or len(w) < 4:
            return None
        near = [v for v in vocabulary if len(v) >= 4 and v in edits(w, v)]
        swaps = [v for v in near if len(v) == len(w) and sorted(v) == sorted(w)]
        tier = swaps or near
        return tier[0] if len(tier) == 1 else None

    rows = B.canonical(spark.createDataFrame([(w,) for w in words], "term string"), spark.createDataFrame([(v,) for v in vocabulary], "term string")).collect()
    assert {r.term: r.canonical for r in rows} == {w: want(w) for w in words if want(w)}


@pytest.mark.parametrize("text, phrase, want", [("trạm rua xe", "rửa xe", True), ("rùa xe", "rửa xe", False), ("barcode", "bar", False), ("sân bay", "san bay", False), ("san bay", "sân bay", True)])
def test_compatible(spark, text, phrase, want):
    hay = F.concat(F.lit(" "), T.fold(F.col("t")), F.lit(" "))
    assert column(spark, text, lambda c: P.matches(hay, c, F.lit(T.py_fold(phrase)), F.lit(T.compatible_pattern(phrase)))) is want


def test_signals(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    for hours in ("09:15-17:45", "21:00-05:30", "24/7", "closed", "", "9-5", None):
        for at in (0, 540, 555, 1064, 1065, 1066, 1300):
            if hours in ("closed", "", "9-5", None):
                want = 0.5
            elif hours == "24/7":
                want = 1.0
            else:
                a, b = (int(x[:2]) * 60 + int(x[3:]) for x in hours.split("-"))
                want = 1.0 if (a <= at <= b if a <= b else at >= a or at <= b) else 0.3
            assert one(S.open_now(F.lit(hours).cast("string"), F.lit(at))) == want, (hours, at)
    assert [round(one(S.price(F.lit("expensive"), F.lit(x))), 6) for x in (1, 2, 4)] == [0, 0.333333, 1]
    a = math.radians(10.5)
    want = 2 * 6371 * math.asin(math.sqrt(math.sin(math.radians(0.25)) ** 2 + math.cos(a) * math.cos(math.radians(11)) * math.sin(math.radians(0.5)) ** 2))
    assert abs(one(S.haversine(F.lit(10.5), F.lit(106.0), F.lit(11.0), F.lit(107.0))) - want) < 1e-9
    assert [one(Y.open_late(F.lit(h).cast("string"))) for h in ("closed", "24/7", "20:00-02:00", "08:00-23:00", "08:00-22:59", None)] == [False, True, True, True, False, False]


def test_metrics(spark):
    r = random.Random(4)
    expected, lists = {}, {}
    for q in range(6):
        expected[f"q{q}"] = r.sample("ABCDEFGH", r.randint(1, 6))
        lists[f"q{q}"] = r.sample("ABCDEFGHXYZ", r.randint(0, 9))
    rels = E.qrels(spark.createDataFrame(list(expected.items()), "query_id string, expected_ids array<string>"))
    ranked = spark.createDataFrame([(q, x, i) for q, xs in lists.items() for i, x in enumerate(xs, 1)], "query_id string, poi_id string, rank int")
    for m in E.per_query(ranked, rels).collect():
        gain = {x: {0: 3, 1: 2}.get(i, 1) for i, x in enumerate(expected[m.query_id])}
        own = lists[m.query_id]
        dcg = sum(gain.get(x, 0) / math.log2(i + 2) for i, x in enumerate(own[:5]))
        best = sum(g / math.log2(i + 2) for i, g in enumerate(sorted(gain.values(), reverse=True)[:5]))
        first = next((i for i, x in enumerate(own, 1) if x in gain), None)
        assert m.ndcg5 == pytest.approx(dcg / best) and m.mrr == pytest.approx(1 / first if first else 0)
        assert m.recall3 == pytest.approx(len(set(own[:3]) & set(gain)) / len(gain)) and m.recall5 == pytest.approx(len(set(own[:5]) & set(gain)) / len(gain))


def test_raw_places_with_blanks_and_words(spark):
    names = "poi_id poi_name category city district address description brand sub_category opening_hours latitude longitude rating popularity_score review_count price_level attributes tags".split()
    row = ("p1", " A ", "ATM", "x", "y", "", None, " ", "", "closed", "", "abc", "NaN", " 7 ", "12.9", "", "a;;b ", None)
    got = L.read_places(spark.createDataFrame([row], ", ".join(f"{n} string" for n in names))).first()
    assert (got.name, got.brand, got.lat, got.lon, got.rating, got.popularity, got.review_count, got.price_level, got.attributes, got.tags) == ("A", None, None, None, None, 7.0, 12, None, ["a", "b"], [])


def test_parse(spark, sf):
    rows = [("a", "khach san yen tihn"), ("b", "cây xăng gần nhất quận 12"), ("c", "11.95, 108.44 công viên giá rẻ"), ("d", "tôi bị cảm"), ("e", ""), ("f", None), ("g", "quán cà phê nhất gần hồ gươm"), ("h", "quán cà phê phở có"), ("i", "cửa hàng baaah"), ("j", "nhà hàng ở đà nẳng")]
    e = engine(spark, sf)
    got = {r.query_id: r for r in P.parse(spark, spark.createDataFrame(rows, "query_id string, text string"), e.lookups).collect()}
    assert len(got) == len(rows)
    assert (got["a"].want_category, got["a"].required, got["a"].residual) == ("Khách sạn", ["yên tĩnh"], [])
    assert (got["b"].want_category, got["b"].nearest, got["b"].want_district, got["b"].anchor_name) == ("Trạm xăng", True, "Quận 12", "Quận 12")
    assert (got["c"].want_category, got["c"].price_pref, got["c"].anchor_lat, got["c"].anchor_lon) == ("Công viên", "cheap", 11.95, 108.44)
    assert got["e"].want_category is None and got["e"].anchor_name is None and got["f"].text == "" and got["f"].residual == []
    assert (got["g"].anchor_name, got["g"].residual) == ("Hồ Gươm", [])
    assert got["h"].anchor_name is None and got["i"].terms == ["baaah"] and got["j"].want_city is None


def test_parse_as_plain_python(spark, sf):
    """Random queries of the vocabularies' phrases, names and other words against a parser without Spark."""
    e, r = engine(spark, sf), random.Random(6)
    places = e.places.orderBy("pos").collect()
    names = [p.name for p in places if p.pos % 50 == 7]
    pool = [k for t in (V.CATEGORIES, V.NEEDS, V.ATTRIBUTES, V.PRICES) for ks in t.values() for k in ks] + V.NEAREST + [n for n, *_ in V.LANDMARKS] + names + ["Quận 3", "q7", "Hà Nội", "Đà Lạt", "Quận 12, Hà Nội", "zzqq", "nhất", "ở", "12", "cf", "sg", "rùng"]
    texts = []
    for _ in range(60):
        words = [r.choice(pool) for _ in range(r.randint(1, 4))]
        t = " ".join(words)
        texts.append(T.py_fold(t) if r.random() < 0.3 else t)
    got = {x.query_id: x for x in P.parse(spark, spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, text string"), e.lookups).collect()}
    target, known = ({x.term for x in df.collect()} for df in (e.lookups.target, e.lookups.known))
    rare = {x.term for x in e.lookups.rare.collect()}
    have = {p.category for p in places}
    shown = lambda s: re.findall(r"[^\W_]+(?:/[^\W_]+)*", s.lower())

    def near(w):
        found = [v for v in target if len(v) >= 4 and v in edits(w, v)]
        swaps = [v for v in found if len(v) == len(w) and sorted(v) == sorted(w) and sum(a != b for a, b in zip(v, w, strict=True)) == 2]
        tier = swaps or found
        return tier[0] if len(tier) == 1 else w

    def inside(words, key):
        return any(words[i : i + len(key)] == key for i in range(len(words) - len(key) + 1))

    for i, text in enumerate(texts):
        raw, toks = shown(text), []
        folded = [T.py_fold(w) for w in raw]
        j = 0
        while j < len(folded):
            pair = " ".join(folded[j : j + 2])
            if j + 1 < len(folded) and pair in V.ABBREVIATIONS:
                toks += V.ABBREVIATIONS[pair].split()
                j += 2
                continue
            w = folded[j]
            toks += ["quan", w[1:]] if re.fullmatch(r"q\d{1,2}", w) else V.ABBREVIATIONS.get(w, w).split()
            j += 1
        fix = {w: near(w) if len(w) >= 4 and w not in known else w for w in toks + folded}
        hay = [fix[w] for w in toks] + [fix[w] for w in folded]

        def agrees(phrase, raw=raw, folded=folded):
            key, own = T.py_fold(phrase).split(), shown(phrase)
            fits = lambda a, b: len(a) == len(b) and all(x == y or T.py_fold(x) == x for x, y in zip(a, b, strict=True))
            return any(folded[k : k + len(key)] == key and all(map(fits, raw[k : k + len(key)], own)) for k in range(len(folded) - len(key) + 1))

        def matches(phrase, hay=hay, folded=folded, agrees=agrees):
            key = T.py_fold(phrase).split()
            return inside(hay, key) and (not inside(folded, key) or agrees(phrase))

        used = set()
        category = None
        for t in (V.CATEGORIES, V.NEEDS):
            keys = sorted(((k, c) for c, ks in t.items() for k in ks), key=lambda x: -len(T.py_fold(x[0])))
            hit = next(((k, c) for k, c in keys if c in have and matches(k)), None)
            if hit and not category:
                category = hit[1]
                used |= set(T.py_fold(hit[0]).split())
        required = {c for c, ks in V.ATTRIBUTES.items() for k in ks if matches(k)}
        for t in (V.ATTRIBUTES, V.PRICES, {"n": V.NEAREST}):
            used |= {w for ks in t.values() for k in ks if matches(k) for w in T.py_fold(k).split()}
        x = got[str(i)]
        assert x.want_category == category, text
        assert set(x.required) == required, text
        price = {c for c, ks in V.PRICES.items() for k in ks if matches(k)}
        assert x.price_pref == ("cheap" if "cheap" in price else "expensive" if price else None), text
        assert x.nearest == any(map(matches, V.NEAREST)), text
        landmark = next((n for n, *_ in V.LANDMARKS if agrees(n)), None)
        if landmark:
            assert x.anchor_name == landmark, text
        districts = dict.fromkeys(k for p in places for k in (p.district, f"{p.district}, {p.city}"))
        assert x.want_district == next((d for d in districts if matches(d)), None), text
        cities = dict.fromkeys(p.city for p in places)
        assert x.want_city == next((c for c in cities if matches(c)), None), text
        anchor = landmark or x.want_district or next((n for n in dict.fromkeys(p.name for p in places) if agrees(n)), None)
        assert x.anchor_name == anchor, text
        for y in (x.want_city, x.want_district, anchor):
            used |= set(T.py_fold(y or "").split())
        common = {T.py_fold(w) for w in V.COMMON if agrees(w)}
        left = [w for w in dict.fromkeys(toks) if w not in used and fix[w] not in used and w not in V.STOPWORDS and w not in common and len(w) >= 2 and not w.isdigit()]
        assert x.residual == left, text
        assert x.terms == [w for w in left if re.fullmatch("[a-z]{3,}", w) and w in rare], text


def test_caches_sinks_and_reports(spark, tmp_path):
    want = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, n int")
    calls = []

    def compute(rows):
        calls.append(sorted(x.key for x in rows.collect()))
        return rows.select("key", F.when(F.col("key") != "c", F.concat(F.lit('{"v": "'), "key", F.lit('"}'))).alias("value"))

    first = L.read_through(want, f"{tmp_path}/cache", compute).collect()
    assert {x.key: x.value for x in first} == {"a": '{"v": "a"}', "b": '{"v": "b"}', "c": None}
    spark.createDataFrame([("d", "{broken")], "key string, value string").write.mode("append").parquet(f"{tmp_path}/cache")
    L.read_through(want.unionByName(spark.createDataFrame([("d", 4)], "key string, n int")), f"{tmp_path}/cache", compute).collect()
    assert calls == [["a", "b", "c"], ["c", "d"]]
    split = spark.createDataFrame([("q1", "tune"), ("q2", "test"), ("q3", "tune")], "query_id string, split string")
    L.write_split(split, f"{tmp_path}/split", "42", 0.33)
    assert sorted(map(tuple, L.read_split(spark, f"{tmp_path}/split").collect())) == sorted(map(tuple, split.collect()))
    L.write_weights(spark, {"semantic": 0.4, "price": 0.2}, 0.8, [0.1], 1e-3, f"{tmp_path}/w")
    assert L.load_weights(spark, f"{tmp_path}/w")["semantic"] == 0.4 and L.load_weights(spark, f"{tmp_path}/none") == S.WEIGHTS
    with pytest.raises(Exception, match="exist"):
        L.write_weights(spark, {"semantic": 0.5}, 0.8, [0.1], 1e-3, f"{tmp_path}/w")
    L.write_report(spark.createDataFrame([("bm25", 0.5)], "stage string, ndcg5 double"), f"{tmp_path}/r")
    text = [x.value for x in spark.read.text(f"{tmp_path}/r/markdown").collect()]
    assert text == ["| stage | ndcg5 |", "|---|---|", "| bm25 | 0.5 |"]


def test_generated_places_and_queries(spark, sf):
    from tessera.plans.base import queries_df

    official = L.places(spark, sf)
    made = Y.generated(official, 200, 7)
    rows = made.collect()
    assert len(rows) == 200 and len({x.poi_id for x in rows}) == 200 and sorted(rows) == sorted(Y.generated(official.repartition(3), 200, 7).collect())
    for x in rows:
        assert 2 <= len(x.attributes) <= 5 and len(set(x.attributes)) == len(x.attributes) and set(x.attributes) <= set(Y.POOLS[x.category]["attributes"])
        assert Y.COASTAL not in x.attributes or x.city == Y.COAST
        assert 3.8 <= x.rating <= 4.7 and 50 <= x.popularity <= 98 and Y.POOLS[x.category]["reviews"][0] <= x.review_count <= Y.POOLS[x.category]["reviews"][1]
        assert "24/7" not in x.attributes or x.opening_hours == "24/7"
    every = official.unionByName(made, allowMissingColumns=True)
    met = Y.narrowed(Y.specs(every, 200, 7), every)
    by = {}
    for x in met.collect():
        by.setdefault(x.query_id, []).append(x)
    places = {p.poi_id: p for p in every.collect()}
    assert len(by) > 20
    for found in by.values():
        s = found[0]
        attrs = set(s.attrs) | set(s.more[: max(0, s.level - 1)])
        district = s.district or (s.own_district if s.level else None)

        def meets(p, s=s, attrs=attrs, district=district):
            late = p.opening_hours and (p.opening_hours == "24/7" or p.opening_hours[6:] < p.opening_hours[:5] or p.opening_hours[6:8] >= "23")
            hours = {None: True, "247": p.opening_hours == "24/7", "late": bool(late)}[s.hours_mode]
            name = not s.fragment or f" {T.py_fold(s.fragment)} " in f" {T.py_fold(p.name + ' ' + (p.brand or ''))} "
            return p.city == s.city and (not s.category or p.category == s.category) and (not district or p.district == district) and attrs <= set(p.attributes) and hours and name

        # The labels are all places that meet the predicate, the target among them.
        assert {x.p_poi_id for x in found} == {i for i, p in places.items() if meets(p)} and s.target in {x.p_poi_id for x in found} and len(found) <= Y.MOST
    q = Y.queries(every, 200, 7, queries_df(spark)).collect()
    assert q and len({T.py_fold(x.input_query) for x in q}) == len(q) and {x.style for x in q} <= set(Y.STYLES) and all(1 <= len(x.expected_ids) <= Y.MOST for x in q)


def test_rank_with_model_replies_and_focus(spark, sf):
    from tessera.operators.engine import rank, responses
    from tessera.plans.base import query_vectors

    q = spark.createDataFrame([("Q05", "cf q1 co wifi"), ("Q08", "")], "query_id string, text string")
    replies = spark.createDataFrame([("Q05", '{"corrected_query": "quán cà phê quận 1 có wifi"}')], "query_id string, raw string")
    found = rank(engine(spark, sf), q, query_vectors(spark, sf), outputs=replies, focus=(10.8, 106.7))
    rows = responses(found.withColumn("source", F.lit("search")), 3, (10.8, 106.7), semantic=True).collect()
    by = {x.query_id: x for x in rows}
    assert by["Q05"].meta.correctedQuery == "quán cà phê quận 1 có wifi" and by["Q05"].query == "cf q1 co wifi" and by["Q08"].meta.correctedQuery is None
    assert len(by["Q05"].results) == 3 and all(r.category == "Quán cà phê" for r in by["Q05"].results) and by["Q08"].intent.anchor.lat == 10.8
    assert by["Q05"].results[0].reasons and by["Q05"].results[0].id.startswith("poi:")


def test_top_is_rank(spark, sf):
    from tessera.plans.base import index, queries_df

    i = index(spark, sf)
    whole = {tuple(r) for r in i.rank(queries_df(spark)).where("rank <= 7").collect()}
    assert {tuple(r) for r in i.top(queries_df(spark), 7).select("query_id", "pos", "score", "rank").collect()} == whole


def test_index_guard(spark, sf, tmp_path):
    corpus = L.places(spark, sf).select("poi_id", "pos").limit(50)
    L.write_index(corpus.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0))), str(tmp_path), "local", "m")
    assert L.read_index(spark, str(tmp_path), "local", "m", corpus).count() == 50
    with pytest.raises(ValueError):
        L.read_index(spark, str(tmp_path), "cloud", "m", corpus)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"query_id": "x", "text": "Cà phê"}\n')
    run = rank_stream(query_stream(spark, str(tmp_path / "in")), lambda q: q.select("query_id", T.fold(F.col("text")).alias("f")), str(tmp_path / "out"), str(tmp_path / "check"))
    run.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).select("query_id", "f").collect()[0].f == "ca phe"


def test_ascent():
    best, at = E.coordinate_ascent(lambda w, s, grid: {v: 0.5 + 0.1 * (s == "semantic" and v == 0.4) for v in grid}, {"semantic": 0.3, "price": 0.2})
    assert best == {"semantic": 0.4, "price": 0.2} and at == 0.6
