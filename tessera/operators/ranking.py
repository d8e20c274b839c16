"""Ranking: signals and their mean, relaxing constraints, gates, windows, fallbacks, explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import signals as S
from tessera.functions.text import fold, tokens
from tessera.operators.retrieval import content_tokens
from tessera.sources.store import Store

RADII, ENOUGH = (30.0, 150.0), 3


def folded(a: Column) -> Column:
    return F.array_distinct(F.transform(F.coalesce(a, F.array().cast("array<string>")), fold))


def prepared(places: DataFrame) -> DataFrame:
    """places with what signals and filters need of them, folded once a place: ctoks (name and brand), fattrs, rtoks (tags and description), times (of opening_hours)."""
    own_words = F.array_distinct(F.concat(F.flatten(F.transform("tags", tokens)), tokens(F.col("description"))))
    return places.withColumns({"ctoks": content_tokens(), "fattrs": folded(F.col("attributes")), "rtoks": own_words, "times": S.times(F.col("opening_hours"))})


def with_signals(pairs: DataFrame, mean_rating: Column) -> DataFrame:
    """Pairs of an intent and a place with the nine signals and the kilometres to the anchor.

    Needs relevance, the columns of prepared(), and the intent's frequired and fsoft (folded), want_category, anchor_lat, anchor_lon,
    open_after (minutes), price_pref, qtoks.
    """
    km = S.haversine(F.col("anchor_lat"), F.col("anchor_lon"), F.col("lat"), F.col("lon"))
    each = {
        "semantic": S.clamp(F.col("relevance")),
        "attributes": S.attributes(F.col("frequired"), F.col("fsoft"), F.col("fattrs")),
        "category": S.category(F.col("want_category"), F.col("category")),
        "distance": S.distance(F.col("km")),
        "rating": S.rating(F.col("rating"), F.col("review_count"), mean_rating),
        "popularity": S.popularity(F.col("popularity")),
        "open_now": S.open_score(F.col("times"), F.coalesce("open_after", F.lit(S.NOW))),
        "review": S.review(F.array_distinct("qtoks"), F.col("rtoks")),
        "price": S.price(F.col("price_pref"), F.col("price_level")),
    }
    return pairs.withColumn("km", km).withColumns({f"sig_{k}": v for k, v in each.items()})


def with_folded(intents: DataFrame) -> DataFrame:
    """intents with frequired and fsoft, folded once an intent."""
    return intents.withColumns({"frequired": folded(F.col("required")), "fsoft": folded(F.col("soft"))})


def top_signals(most: int = 3) -> Column:
    """The names of a row's largest signals, ties in the order of their list."""
    each = F.array(*(F.struct((-F.round(f"sig_{k}", 9)).alias("v"), F.lit(i).alias("o"), F.lit(k).alias("name")) for i, k in enumerate(S.WEIGHTS)))
    return F.transform(F.slice(F.array_sort(each), 1, most), lambda x: x["name"])


def score(weights: dict[str, float]) -> Column:
    return S.total({k: F.col(f"sig_{k}") for k in S.WEIGHTS}, weights, F.col("anchor_lat").isNotNull())


def corroborated(terms: DataFrame, top: DataFrame, places: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, subject_ok): whether each content term (query_id, terms) is in name or brand of one of the k best (query_id, pos, rank)."""
    seen = F.broadcast(top.where(F.col("rank") <= k)).join(places.select("pos", F.explode("ctoks").alias("term")), "pos").select("query_id", "term").distinct()
    asked = terms.select("query_id", F.explode("terms").alias("term")).distinct()
    found = asked.join(seen.withColumn("hit", F.lit(True)), ["query_id", "term"], "left").groupBy("query_id").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("subject_ok"))
    return terms.select("query_id").join(found, "query_id", "left").withColumn("subject_ok", F.coalesce("subject_ok", F.lit(False)))


#: The columns of an intent and a place that gated() reads, besides km and score.
ORDERS = ("category", "want_category", "nearest")


def filters() -> dict[int, Column]:
    """What a pair meets at each level: 2 all filters, 1 the place alone, 0 none."""
    place = F.coalesce(F.col("city") == F.col("want_city"), F.lit(True)) & F.coalesce(F.col("district") == F.col("want_district"), F.lit(True))
    by_subject = F.col("subject_ok") & (F.size("terms") > 0)
    unexplained = F.size(F.when(by_subject, F.col("residual")).otherwise(F.array_except("residual", "terms"))) > 0
    by_category = ~by_subject & F.col("want_category").isNotNull() & ~unexplained
    subject = F.when(by_subject, F.size(F.array_except("terms", "ctoks")) == 0).when(by_category, F.col("category") == F.col("want_category")).otherwise(F.lit(True))
    return {2: F.coalesce(place & subject, F.lit(False)), 1: place, 0: F.lit(True)}


def decided(pairs: DataFrame) -> DataFrame:
    """(query_id, level, radius) for pairs of a query and all places, of what is known without scores: one row a query.

    level is the strictest of filters() that some place meets; radius, of RADII, the first that has ENOUGH of the places that level leaves, or null.
    """
    km = S.haversine(F.col("anchor_lat"), F.col("anchor_lon"), F.col("lat"), F.col("lon"))
    meets = filters()
    each = pairs.select("query_id", km.alias("km"), (F.col("want_city").isNotNull() | F.col("want_district").isNotNull()).alias("_p"), *(f.alias(f"_f{i}") for i, f in meets.items()))
    counts = [F.count_if(F.col(f"_f{i}") & (F.col("km") <= r)).alias(f"_n{i}_{j}") for i in meets for j, r in enumerate(RADII)]
    by = each.groupBy("query_id").agg(F.max("_f2").alias("_any2"), F.max(F.col("_f1") & F.col("_p")).alias("_any1"), *counts)
    by = by.withColumn("level", F.when(F.col("_any2"), 2).when(F.col("_any1"), 1).otherwise(0))
    near = lambda j: F.when(F.col("level") == 2, F.col(f"_n2_{j}")).when(F.col("level") == 1, F.col(f"_n1_{j}")).otherwise(F.col(f"_n0_{j}"))
    return by.select("query_id", "level", F.when(near(0) >= ENOUGH, RADII[0]).when(near(1) >= ENOUGH, RADII[1]).alias("radius"))


def constrained(pairs: DataFrame, decided: DataFrame) -> DataFrame:
    """Pairs that the hard filters leave, and the level at which they did: 2 for all filters, 1 without the last, 0 for none.

    Location first, then the subject or else the category, if nothing is left unexplained; where nothing is left the filter
    added last goes. Content terms that the vectors don't corroborate are discredited: they are no subject, and don't count as
    unexplained. Needs want_city, want_district, want_category, terms, residual, ctoks, subject_ok; decided() of all places.
    """
    keep = F.lit(False)
    for i, f in filters().items():
        keep = keep | ((F.col("level") == i) & f)
    return pairs.join(F.broadcast(decided.select("query_id", "level")), "query_id").where(keep)


def gated(scored: DataFrame, decided: DataFrame) -> DataFrame:
    """Final ranks of (query_id, pos, score, km, nearest, category, want_category).

    The first radius with ENOUGH places makes a near head, the far tail follows; nearest orders the head by category and
    kilometres. Without an anchor (km null) or enough places scores alone count. The radius is that of decided().
    """
    near = F.coalesce(F.col("km") <= F.col("radius"), F.lit(False))
    sorts = F.col("nearest") & F.col("near")
    out = scored.join(F.broadcast(decided.select("query_id", "radius")), "query_id").withColumn("near", near).drop("radius")
    off = F.when(sorts, F.coalesce(F.col("category") != F.col("want_category"), F.lit(False)).cast("int")).otherwise(0)
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), off, F.when(sorts, F.round("km", 9)).otherwise(0.0), F.desc(F.round("score", 9)), "pos")
    return out.withColumn("rank", F.row_number().over(order))


def in_window(bbox: tuple[float, float, float, float] | None = None, category: str | None = None, lat: float | None = None, lon: float | None = None, meters: float | None = None) -> Column:
    """The caller's window: bbox as least and greatest longitude and latitude, bounds included; a radius of 0 counts."""
    out = F.lit(True)
    if category is not None:
        out = out & (F.col("category") == category)
    if bbox is not None:
        out = out & F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3])
    if meters is not None and lat is not None:
        out = out & (S.haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")) * 1000 <= meters)
    return out


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    parts = [float(x) for x in text.split(",")]
    if len(parts) != 4:
        raise ValueError("a bbox has four numbers")
    return tuple(parts)


def request(q: str | None, lat: float | None = None, lon: float | None = None, radius_meters: float | None = None, limit: int = 10) -> dict:
    """A checked request, or ValueError."""
    if not (q or "").strip():
        raise ValueError("q is empty")
    if (lat is None) != (lon is None):
        raise ValueError("lat and lon go together")
    if radius_meters is not None and (lat is None or radius_meters < 0):
        raise ValueError("a radius needs a place and isn't negative")
    return {"q": q, "lat": lat, "lon": lon, "radius_meters": radius_meters, "limit": max(1, min(20, limit))}


def with_fallback(ranked: DataFrame, places: DataFrame, window: Column, lat: float | None, lon: float | None, limit: int) -> DataFrame:
    """(query_id, pos, score, source, rank): ranked places in the window, or where a query has none the window's places by distance, then popularity."""
    order = lambda *by: F.row_number().over(Window.partitionBy("query_id").orderBy(*by))
    # The ranks are made once: each query keeps its first rows inside, or else some row outside, which says that there is none inside.
    inside = ranked.select("query_id", "pos", "score", "rank", F.coalesce(window, F.lit(False)).alias("inside"))
    first = Store(ranked.sparkSession).write(inside.withColumn("n", order(F.desc("inside"), "rank")).where(F.col("n") <= limit), "first")
    hit = first.where("inside").select("query_id", "pos", "score", "rank", F.lit("search").alias("source"))
    none = first.groupBy("query_id").agg(F.max("inside").alias("inside")).where("NOT inside").select("query_id")
    km = S.haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")) if lat is not None else F.lit(0.0)
    spare = places.where(window).crossJoin(F.broadcast(none)).withColumn("rank", order(F.round(km, 9), F.desc("popularity"), "pos")).where(F.col("rank") <= limit)
    both = hit.unionByName(spare.select("query_id", "pos", F.lit(0.0).alias("score"), "rank", F.lit("fallback").alias("source")))
    return both.withColumn("rank", order("rank")).where(F.col("rank") <= limit)


def distance_text(km: Column) -> Column:
    return F.when(km >= 1, F.format_string("%.1f km", km)).otherwise(F.concat(F.bround(km * 1000, -1).cast("int").cast("string"), F.lit(" m")))


def reasons(most: int = 4) -> Column:
    """Up to most reasons, each read off a value: attributes that match, the place, rating and reviews, hours."""
    own = folded(F.col("attributes"))
    matched = F.filter("required", lambda a: F.array_contains(own, fold(a)))
    inside = (F.col("district") == F.col("want_district")) & F.startswith("anchor_name", F.col("want_district"))
    end = F.regexp_extract("opening_hours", "^\\d{1,2}:\\d{2}-(\\d{1,2}:\\d{2})$", 1)
    from tessera.functions.text import thousands

    each = F.array(
        F.when(F.size(matched) > 0, F.array_join(F.transform(matched, lambda a: F.concat(F.lit("✓ "), a)), ", ")),
        F.when(F.col("anchor_name").isNotNull(), F.when(F.coalesce(inside, F.lit(False)), F.concat(F.lit("trong "), "want_district")).otherwise(F.concat(F.lit("cách "), "anchor_name", F.lit(" "), distance_text(F.col("km"))))),
        F.concat(F.format_string("%.1f", F.col("rating")), F.lit("★ · "), thousands(F.col("review_count")), F.lit(" đánh giá")),
        F.when(F.trim("opening_hours") == "24/7", F.lit("mở 24/7")).when(end != "", F.concat(F.lit("mở đến "), end)),
    )
    return F.slice(F.filter(each, lambda x: x.isNotNull()), 1, most)


def violations(said: Column) -> Column:
    """Reasons that the place doesn't back: foreign attributes, other ratings or numbers of reviews."""
    from tessera.functions.text import thousands

    def bad(x: Column) -> Column:
        named = F.filter(F.split(x, ", "), lambda a: F.startswith(a, F.lit("✓ ")))
        foreign = F.exists(named, lambda a: ~F.array_contains(folded(F.col("attributes")), fold(F.substring(a, F.lit(3), F.length(a)))))
        stars = F.regexp_extract(x, "(\\d\\.\\d)★", 1)
        count = F.regexp_extract(x, "([\\d.]+) đánh giá", 1)
        return foreign | ((stars != "") & (stars != F.format_string("%.1f", F.col("rating")))) | ((count != "") & (count != thousands(F.col("review_count"))))

    return F.filter(said, bad)
