"""Synthetic data: apportionment, city boxes, weighted choice, typos, labels that are complete by construction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.functions.signals import minutes
from tessera.operators.evaluation import cumulative, uniform
from tessera.sources.store import Store


def apportion(weights: DataFrame, total: int) -> DataFrame:
    """(key, weight) with whole numbers that add up to total: floors, and one more for the largest remainders, ties by key descending."""
    every = Window.partitionBy()
    share = weights.withColumn("quota", F.col("weight") * total / F.sum("weight").over(every))
    floors = share.withColumn("n", F.floor("quota")).withColumn("left", total - F.sum("n").over(every))
    order = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("quota") - F.col("n"), 9)), F.desc("key")))
    return floors.select("key", (F.col("n") + (order <= F.col("left")).cast("long")).alias("n"))


def city_boxes(places: DataFrame) -> DataFrame:
    box = places.groupBy("city").agg(*(f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))), F.sort_array(F.collect_set("district")).alias("d"), F.count("*").alias("n"))
    return box.withColumn("districts", F.array_join("d", "|")).drop("d")


def weighted_choice(draws: DataFrame, choices: DataFrame) -> DataFrame:
    """(draw_id, u) with u in [0, 1) and the choice (key, weight, ord) whose part of the cumulative weights it falls into."""
    upto = F.sum("weight").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    ranges = choices.withColumn("high", upto).withColumn("low", F.col("high") - F.col("weight")).withColumn("all", F.sum("weight").over(Window.partitionBy()))
    at = F.col("u") * F.col("all")
    return draws.join(F.broadcast(ranges), (at >= F.col("low")) & (at < F.col("high"))).select("draw_id", F.col("key").alias("choice"))


def weighted_sample(items: DataFrame, k: int, u: Column) -> DataFrame:
    """k rows of each group (group, item, weight) without replacement, by the largest u^(1 / weight)."""
    order = Window.partitionBy("group").orderBy(F.desc(F.pow(u, 1.0 / F.col("weight"))), "item")
    return items.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def swapped(word: Column, at: Column) -> Column:
    """A typo: the characters at and after place at (from 1) swapped, in words of 4 or more."""
    typo = F.concat(F.substring(word, F.lit(1), at - 1), F.substring(word, at + 1, F.lit(1)), F.substring(word, at, F.lit(1)), F.substring(word, at + 2, F.length(word)))
    return F.when(F.length(word) >= 4, typo).otherwise(word)


def open_late(hours: Column) -> Column:
    """Open all day, past midnight, or until 23:00 at least."""
    start, end = (minutes(F.get(F.split(hours, "-"), F.lit(i))) for i in (0, 1))
    return F.coalesce(F.when(F.trim(hours) == "24/7", F.lit(True)).otherwise((end < start) | (end >= 23 * 60)), F.lit(False))


def predicate(category: str | None = None, city: str | None = None, district: str | None = None, attributes: tuple[str, ...] = (), late: bool = False, price: tuple[int, ...] = ()) -> Column:
    out = F.lit(True)
    for c, v in (("category", category), ("city", city), ("district", district)):
        if v is not None:
            out = out & (F.col(c) == v)
    for a in attributes:
        out = out & F.array_contains("attributes", a)
    if late:
        out = out & open_late(F.col("opening_hours"))
    if price:
        out = out & F.col("price_level").isin(*price)
    return F.coalesce(out, F.lit(False))


#: Orders of labels: quality (rating, then popularity), rating (then reviews), price_asc and price_desc (then rating; a place without a price comes last).
def labels(places: DataFrame, specs: list[tuple[str, Column, str]], most: int = 8) -> DataFrame:
    """(query_id, poi_id, ord): the places of each (query_id, predicate, order), in its order, at most so many.

    All specs are met in one pass over the places: each place is dealt to those whose predicate it meets, and windows by spec
    keep the first ones; Spark limits the groups before the shuffle.
    """
    asked = F.array(*(F.when(where, F.struct(F.lit(q).alias("query_id"), F.lit(order).alias("order"))) for q, where, order in specs))
    met = places.withColumn("spec", F.explode(F.filter(asked, lambda x: x.isNotNull()))).select("*", "spec.*")
    return placed(met, most).select("query_id", "poi_id", "ord")


def placed(met: DataFrame, most: int) -> DataFrame:
    """met (query_id, order, and a place's columns) with ord, the place in the query's order, up to most."""
    first = F.when(F.col("order") == "price_asc", F.coalesce("price_level", F.lit(99)).cast("double")).when(F.col("order") == "price_desc", -F.coalesce("price_level", F.lit(0)).cast("double")).otherwise(0.0)
    third = F.when(F.col("order") == "quality", -F.col("popularity").cast("double")).when(F.col("order") == "rating", -F.col("review_count").cast("double")).otherwise(0.0)
    window = Window.partitionBy("query_id").orderBy(first, F.desc("rating"), third, "pos")
    return met.withColumn("ord", F.row_number().over(window)).where(F.col("ord") <= most)


def tightened(places: DataFrame, levels: list[Column], most: int = 6) -> Column:
    """The number of the first level that at most so many places meet, from counts made in one pass; the last one if none does."""
    counts = places.agg(*(F.count_if(c).alias(f"n{i}") for i, c in enumerate(levels))).first()
    return next((i for i in range(len(levels)) if 0 < counts[f"n{i}"] <= most), len(levels) - 1)


# Places.

#: What generated places are made of; another domain brings its own. Weights of attributes, chains and cores of names, hours, and bands of reviews.
POOLS = {
    "Quán cà phê": {"attributes": {"wifi": 5, "yên tĩnh": 4, "phù hợp làm việc": 3, "lãng mạn": 1, "check-in": 2, "mở khuya": 1}, "chains": ["Cà Phê Bốn Mùa", "Nắng Sớm"], "tags": ["cà-phê", "bàn-ngoài", "nhạc-nhẹ", "bánh-ngọt"], "hours": ["07:00-22:00", "06:30-21:30"], "late": ["17:00-01:00"], "reviews": (200, 9000), "prices": {1: 2, 2: 4, 3: 3, 4: 1}},
    "Nhà hàng": {"attributes": {"phù hợp gia đình": 5, "lãng mạn": 2, "bãi đỗ xe": 3, "gần biển": 2, "mở khuya": 2}, "chains": ["Bếp Quê", "Hương Đồng"], "tags": ["món-nóng", "hải-sản", "đặt-bàn"], "hours": ["10:00-22:00", "09:30-21:00"], "late": ["18:00-03:00", "17:00-02:00"], "reviews": (200, 9000), "prices": {1: 1, 2: 3, 3: 3, 4: 2}},
    "Khách sạn": {"attributes": {"24/7": 4, "gần biển": 4, "wifi": 5, "bãi đỗ xe": 3, "yên tĩnh": 2}, "chains": ["Sao Mai", "Biển Lặng"], "tags": ["phòng-rộng", "hồ-bơi", "giá-tốt"], "hours": ["24/7", "06:00-23:00"], "late": [], "reviews": (150, 6000), "prices": {1: 1, 2: 3, 3: 3, 4: 3}},
    "ATM": {"attributes": {"24/7": 6, "bãi đỗ xe": 2, "wifi": 1}, "chains": ["Ngân Hàng Sông Hồng", "Ngân Hàng Cửu Long"], "tags": ["rút-tiền", "trong-nhà"], "hours": ["07:00-22:00"], "late": [], "reviews": (120, 1200), "prices": {1: 6, 2: 3, 3: 1}},
    "Trạm xăng": {"attributes": {"24/7": 4, "bãi đỗ xe": 3, "wifi": 1}, "chains": ["Xăng Dầu Miền Trung", "Xăng Dầu Ven Sông"], "tags": ["bơm-lốp", "rửa-xe", "nước-uống"], "hours": ["05:00-22:00", "06:00-23:00"], "late": [], "reviews": (120, 1500), "prices": {1: 4, 2: 4, 3: 2}},
    "Công viên": {"attributes": {"phù hợp gia đình": 5, "yên tĩnh": 3, "check-in": 3, "bãi đỗ xe": 2}, "chains": [], "tags": ["cây-xanh", "đi-bộ", "hồ-nước"], "hours": ["05:00-22:00", "24/7"], "late": [], "reviews": (300, 5000), "prices": {1: 1}},
}
STREETS = ["Hoa Sữa", "Bờ Kè", "Hàng Me", "Cây Điệp"]
MOODS = ["ấm cúng", "thoáng mát", "giản dị"]
COAST, COASTAL = "Đà Nẵng", "gần biển"


def picked(pool: Column, u: Column) -> Column:
    """An entry of an array by u in [0, 1)."""
    return F.get(pool, F.floor(u * F.size(pool)).cast("int"))


def weighted_pick(pool: Column, u: Column) -> Column:
    """The name of an array of (name, weight) into whose part of the cumulative weights u falls."""
    total = F.aggregate(pool, F.lit(0.0), lambda a, x: a + x["weight"])
    start = F.struct(F.lit(0.0).alias("upto"), F.lit(None).cast("string").alias("name"))
    step = lambda a, x: F.when(a["name"].isNotNull(), a).otherwise(F.struct((a["upto"] + x["weight"]).alias("upto"), F.when(u * total < a["upto"] + x["weight"], x["name"]).alias("name")))
    return F.aggregate(pool, start, step)["name"]


def sampled(pool: Column, n: Column, u) -> Column:
    """n names of an array of (name, weight) without replacement: the largest u(i)^(1 / weight), with u a function of the place in the pool."""
    keyed = F.transform(pool, lambda x, i: F.struct(F.round(-F.pow(u(i), 1.0 / x["weight"]), 9).alias("k"), i.alias("i"), x["name"].alias("name")))
    return F.transform(F.slice(F.array_sort(keyed), F.lit(1), n), lambda x: x["name"])


def gauss(u: Column, v: Column, mean: float, deviation: float, low: float, high: float) -> Column:
    """A clamped normal number of two uniform ones."""
    z = F.sqrt(-2 * F.log(1 - u)) * F.cos(F.lit(2 * 3.141592653589793) * v)
    return F.greatest(F.lit(low), F.least(F.lit(high), mean + deviation * z))


def log_uniform(u: Column, low: Column, high: Column) -> Column:
    return F.round(F.exp(F.log(low) + u * (F.log(high) - F.log(low)))).cast("int")


def pools_df(spark, pools: dict = POOLS) -> DataFrame:
    rows = [(i, c, [(a, float(w)) for a, w in p["attributes"].items()], p["chains"], p["tags"], p["hours"], p["late"], *p["reviews"], [(str(k), float(w)) for k, w in p["prices"].items()]) for i, (c, p) in enumerate(pools.items())]
    pair = "array<struct<name:string,weight:double>>"
    return spark.createDataFrame(rows, f"o int, category string, attributes_pool {pair}, chains array<string>, tags_pool array<string>, hours_pool array<string>, late_pool array<string>, low int, high int, prices_pool {pair}")


def generated(official: DataFrame, n: int, seed: int, pools: dict = POOLS) -> DataFrame:
    """n synthetic places in the boxes and districts of the official ones' cities, with their mix of cities and categories.

    Every value comes from a hash of seed, place number and field, so any partitioning gives the same places. Attributes are 2 to 5 of the
    category's, the coastal one in its city alone; hours follow the attributes; names are a chain or the category, and a street or district.
    """
    spark = official.sparkSession
    pool = pools_df(spark, pools)
    share = pool.select("category").join(official.groupBy("category").count(), "category", "left").select(F.col("category").alias("key"), F.coalesce("count", F.lit(1)).alias("weight"))
    each = pool.join(apportion(share, n).withColumnRenamed("key", "category"), "category")
    numbered = each.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n").withColumn("id", F.col("o") * n + F.col("j"))
    u = lambda field, *more: uniform(seed, F.col("id"), F.lit(field), *more)
    boxes = F.broadcast(city_boxes(official).groupBy().agg(F.sort_array(F.collect_list(F.struct("city", F.col("n").cast("double").alias("weight"), "min_lat", "max_lat", "min_lon", "max_lon", F.split("districts", "[|]").alias("districts")))).alias("cities")))
    p = numbered.crossJoin(boxes)
    city = weighted_pick(F.transform("cities", lambda c: F.struct(c["city"].alias("name"), c["weight"].alias("weight"))), u(1))
    p = p.withColumn("city", city).withColumn("box", F.get(F.filter("cities", lambda c: c["city"] == F.col("city")), F.lit(0)))
    p = p.withColumn("district", picked(F.col("box.districts"), u(2)))
    p = p.withColumn("pool", F.filter("attributes_pool", lambda a: (a["name"] != COASTAL) | (F.col("city") == COAST)))
    p = p.withColumn("attributes", sampled(F.col("pool"), F.least(F.size("pool"), F.lit(2) + F.floor(u(3) * 4).cast("int")), lambda i: u(4, i)))
    street = picked(F.array(*map(F.lit, STREETS)), u(5))
    chain = picked(F.col("chains"), u(6))
    name = F.concat_ws(" ", F.coalesce(chain, F.col("category")), F.when(u(7) < 0.5, F.col("district")).otherwise(street))
    hours = F.when(F.array_contains("attributes", "24/7"), "24/7").when(F.array_contains("attributes", "mở khuya") & (F.size("late_pool") > 0), picked(F.col("late_pool"), u(8))).otherwise(picked(F.col("hours_pool"), u(8)))
    mood = picked(F.array(*map(F.lit, MOODS)), u(9))
    said = F.concat_ws(" ", F.col("category"), F.lit("ở"), F.concat(F.col("district"), F.lit(",")), F.concat(F.col("city"), F.lit(":")), F.concat_ws(", ", F.slice("attributes", 1, 3), F.concat(F.lit("không gian "), mood)))
    inside = lambda a, b, x: F.round(F.col(f"box.{a}") + x * (F.col(f"box.{b}") - F.col(f"box.{a}")), 6)
    tags = F.transform(F.slice(F.array_sort(F.transform("tags_pool", lambda t, i: F.struct(F.round(u(10, i), 9).alias("k"), t.alias("t")))), F.lit(1), F.lit(2)), lambda x: x["t"])
    return p.select(
        F.format_string("SYN%06d", F.col("id")).alias("poi_id"), (F.lit(10_000_000) + F.col("id")).cast("long").alias("pos"), name.alias("name"), F.coalesce(chain, F.col("category")).alias("brand"), "category", F.lower("category").alias("sub_category"), "city", "district",
        F.concat((F.floor(u(11) * 320) + 1).cast("string"), F.lit(" "), street, F.lit(", "), F.col("district")).alias("address"), inside("min_lat", "max_lat", u(12)).alias("lat"), inside("min_lon", "max_lon", u(13)).alias("lon"),
        F.round(gauss(u(14), u(15), 4.3, 0.25, 3.8, 4.7), 1).alias("rating"), log_uniform(u(16), F.col("low"), F.col("high")).alias("review_count"), F.round(gauss(u(17), u(18), 72, 13, 50, 98)).cast("int").alias("popularity"),
        weighted_pick(F.col("prices_pool"), u(19)).cast("int").alias("price_level"), hours.alias("opening_hours"), "attributes", tags.alias("tags"), said.alias("description"),
    )


# Queries.

#: Families of generated queries with their weights, and the words that say what a family asks for.
FAMILIES = {"attribute-seek": 30, "category-location": 23, "brand": 15, "paraphrase": 8, "superlative": 7, "price": 6, "open-late": 6}
ASKING = {"superlative": "được đánh giá cao", "cheap": "giá rẻ", "upscale": "sang trọng", "late": "mở khuya", "247": "24/7"}
STYLES = {"none": 45, "diacritics": 22, "typo": 12, "both": 6, "abbrev": 9, "mixed": 6}
#: Categories and attributes in English, for the mixed style.
ENGLISH = {"Quán cà phê": "coffee", "Nhà hàng": "restaurant", "Khách sạn": "hotel", "ATM": "atm", "Trạm xăng": "gas station", "Công viên": "park"}
ENGLISH_ATTRIBUTES = {"wifi": "wifi", "yên tĩnh": "quiet", "lãng mạn": "romantic", "bãi đỗ xe": "parking", "24/7": "24/7"}
CITY_SHORT = {"TP.HCM": "hcm", "Hà Nội": "hn", "Đà Nẵng": "dn", "Đà Lạt": "dl"}
TIGHT, MOST = 6, 8


def _table(d: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


def specs(places: DataFrame, n: int, seed: int) -> DataFrame:
    """n draws of a family and a target place, each with the predicate that the family makes of its target.

    Columns: query_id, family, target, category, city, district, attrs (required), more (attributes that may tighten), hours_mode, fragment, order,
    direction, need. A draw whose target doesn't suit its family is left out, as are later draws of equal predicates.
    """
    spark = places.sparkSession
    draws = spark.range(1, n + 1).select(F.col("id").alias("draw"))
    u = lambda field: uniform(seed, F.col("draw"), F.lit(field))
    families = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(float(w)).alias("weight")) for k, w in FAMILIES.items()))
    # Places are numbered by ranges of pos; a draw names a number.
    numbered = cumulative(places, "pos", Store(spark)).select(F.col("value").alias("pos"), F.col("hi").alias("number"))
    count = places.agg(F.count_distinct("pos").alias("n"))
    wanted = draws.crossJoin(F.broadcast(count)).select("draw", weighted_pick(families, u(1)).alias("family"), (F.floor(u(2) * F.col("n")) + 1).alias("number"), u(3).alias("u3"), u(4).alias("u4"))
    t = wanted.join(numbered, "number").join(places, "pos")
    late, allday = open_late(F.col("opening_hours")), F.trim("opening_hours") == "24/7"
    family = F.col("family")
    suits = (
        F.when(family == "attribute-seek", F.size("attributes") > 0).when(family == "paraphrase", F.col("category").isin(*_needs())).when(family == "price", F.col("price_level").isNotNull())
        .when(family == "open-late", late).when(family == "brand", F.length("name") >= 3).otherwise(F.lit(True))
    )
    by_brand = family == "brand"
    words = F.split("name", " ")
    fragment = F.when(F.col("u3") < 0.34, F.coalesce("brand", "name")).when((F.col("u3") < 0.67) & (F.size(words) >= 2), F.array_join(F.slice(words, 1, 2), " ")).otherwise(F.col("name"))
    attrs = F.when(family == "attribute-seek", F.array(picked(F.col("attributes"), F.col("u3")))).otherwise(F.array().cast("array<string>"))
    direction = F.when(family == "price", F.when(F.col("u3") < 0.5, "cheap").otherwise("upscale"))
    out = t.where(F.coalesce(suits, F.lit(False))).select(
        F.format_string("SQ%06d", F.col("draw")).alias("query_id"), "draw", family.alias("family"), F.col("poi_id").alias("target"), F.when(~by_brand, F.col("category")).alias("category"), "city",
        F.when(~((family == "category-location") & (F.col("u3") >= 0.6)), F.col("district")).alias("district"), attrs.alias("attrs"), F.array_except("attributes", attrs).alias("more"), F.col("district").alias("own_district"),
        F.when(family == "open-late", F.when(allday, "247").otherwise("late")).alias("hours_mode"), F.when(by_brand, fragment).alias("fragment"),
        F.when(family == "superlative", "rating").when(direction == "cheap", "price_asc").when(direction == "upscale", "price_desc").otherwise("quality").alias("order"), direction.alias("direction"),
        F.when(family == "paraphrase", picked(F.try_element_at(F.create_map(*(x for k, v in _needs().items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.col("category")), F.col("u4"))).alias("need"), "u4",
    )
    same = ["family", "category", "city", "district", "attrs", "hours_mode", "fragment", "order"]
    return out.withColumn("_r", F.row_number().over(Window.partitionBy(*same).orderBy("draw"))).where("_r = 1").drop("_r")


def _needs() -> dict[str, list[str]]:
    from tessera.sources.vocabulary import NEEDS

    return {k: list(v) for k, v in NEEDS.items()}


def narrowed(specs_: DataFrame, places: DataFrame) -> DataFrame:
    """specs with the first predicate that at most TIGHT places meet, and its places: all columns of both, and level.

    A predicate is narrowed to its target's district, then by its further attributes one by one. The levels are nested, so one join tells of each
    place the deepest level that it meets, and counts of those choose the level. A spec that more than MOST places meet even at the end is left out.
    Names are met by their folded words, cities by equality: places of other cities are never compared.
    """
    p = places.select("*", T.padded(T.tokens(F.concat_ws(" ", "name", "brand"))).alias("_name"))
    hours = F.when(F.col("s.hours_mode") == "247", F.trim("p.opening_hours") == "24/7").when(F.col("s.hours_mode") == "late", open_late(F.col("p.opening_hours"))).otherwise(F.lit(True))
    meets = (
        F.coalesce(F.col("p.category") == F.col("s.category"), F.col("s.category").isNull()) & F.coalesce(F.col("p.district") == F.col("s.district"), F.col("s.district").isNull())
        & (F.size(F.array_except("s.attrs", "p.attributes")) == 0) & F.coalesce(hours, F.lit(False)) & (F.col("s.fragment").isNull() | F.contains(F.col("p._name"), T.padded(T.tokens(F.col("s.fragment")))))
    )
    joined = specs_.alias("s").join(p.alias("p"), (F.col("s.city") == F.col("p.city")) & meets)
    # How many of the further attributes, from the first on, the place has: the depth that it reaches in the district.
    miss = F.array_position(F.transform("s.more", lambda a: F.array_contains("p.attributes", a)), F.lit(False))
    reach = F.when(F.col("p.district") != F.col("s.own_district"), 0).otherwise(1 + F.when(miss == 0, F.size("s.more")).otherwise(miss - 1)).cast("int")
    pairs = joined.select(*(F.col(f"s.{c}") for c in specs_.columns), *(F.col(f"p.{c}").alias(f"p_{c}") for c in places.columns), reach.alias("reach"))
    first = F.when(F.col("district").isNotNull(), 1).otherwise(0)
    counts = pairs.groupBy("query_id", "reach").agg(F.count("*").alias("n"), F.first(first).alias("first"), F.first(F.size("more")).alias("deepest"))
    upto = counts.withColumn("met", F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("reach"))))
    levels = upto.groupBy("query_id").agg(F.first("first").alias("first"), F.first("deepest").alias("deepest"), F.collect_list(F.struct("reach", "met")).alias("m"))
    at = lambda level: F.coalesce(F.array_max(F.transform(F.filter("m", lambda x: x["reach"] >= level), lambda x: x["met"])), F.lit(0))
    choices = F.sequence(F.col("first"), F.greatest(F.col("first"), F.col("deepest") + 1))
    chosen = levels.withColumn("level", F.coalesce(F.get(F.filter(choices, lambda k: at(k) <= TIGHT), F.lit(0)), F.element_at(choices, -1)))
    chosen = chosen.withColumn("met", at(F.col("level"))).where((F.col("met") > 0) & (F.col("met") <= MOST)).select("query_id", "level")
    return pairs.join(chosen, "query_id").where(F.col("reach") >= F.col("level"))


def with_style(text: Column, style: Column, place: Column, short: Column, english: Column, u: Column) -> Column:
    """What a query asks for and where, in one of the styles: plain, without diacritics, with a typo, both, with the place abbreviated, or in part English."""
    core, at = F.when((style == "mixed") & english.isNotNull(), english).otherwise(text), F.when((style == "abbrev") & short.isNotNull(), short).otherwise(place)
    whole = F.trim(F.regexp_replace(F.concat_ws(" ", core, F.lit("ở"), at), "\\s+", " "))
    bare = F.when(style.isin("diacritics", "both"), T.strip_diacritics(whole)).otherwise(whole)
    return F.when(style.isin("typo", "both"), with_typo(bare, u)).otherwise(bare)


def with_typo(text: Column, u: Column) -> Column:
    """text with two neighbouring characters of one word of 4 or more swapped; unchanged without such a word."""
    words = F.split(text, " ")
    able = F.filter(F.transform(words, lambda w, i: F.when(F.length(w) >= 4, i)), lambda i: i.isNotNull())
    chosen = picked(able, u)
    at = lambda w: (F.floor(u * 7919) % (F.length(w) - 1)).cast("int") + 1
    typo = F.array_join(F.transform(words, lambda w, i: F.when(i == chosen, swapped(w, at(w))).otherwise(w)), " ")
    return F.when(F.size(able) > 0, typo).otherwise(text)


def difficulty(family: Column, district: Column, attrs: Column, style: Column) -> Column:
    """Easy for names and a plain category in a district, Medium with attributes or a whole city, Hard for what has to be inferred; one more for two degradations."""
    base = F.when(family == "brand", 0).when(family == "category-location", F.when(district.isNotNull() & (F.size(attrs) == 0), 0).otherwise(1)).when(family == "attribute-seek", 1).otherwise(2)
    return F.get(F.array(*map(F.lit, ("Easy", "Medium", "Hard"))), F.least(F.lit(2), base + (style == "both").cast("int")))


def queries(places: DataFrame, n: int, seed: int, official: DataFrame | None = None) -> DataFrame:
    """Generated queries whose labels are complete by construction: query_id, input_query, family, style, difficulty, expected_ids, skills.

    Texts that official queries (text) have, and repeated texts, are left out.
    """
    met = narrowed(specs(places, n, seed), places)
    u = lambda field: uniform(seed, F.col("draw"), F.lit(field))
    used = F.concat("attrs", F.slice("more", F.lit(1), F.greatest(F.col("level") - 1, F.lit(0))))
    place_columns = [F.col(f"p_{c}").alias(c) for c in ("poi_id", "rating", "review_count", "popularity", "price_level", "pos")]
    ranks = placed(met.select("query_id", "order", *place_columns), MOST).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "poi_id"))), lambda x: x["poi_id"]).alias("expected_ids"))
    one = met.groupBy("query_id").agg(*(F.first(c).alias(c) for c in ("draw", "family", "category", "city", "direction", "hours_mode", "fragment", "need", "level")), F.first(used).alias("used"), F.first(F.when(F.col("level") >= 1, F.coalesce("district", "own_district")).otherwise(F.col("district"))).alias("district"))
    asking = F.when(F.col("family") == "superlative", ASKING["superlative"]).otherwise(F.try_element_at(_table(ASKING), F.coalesce("direction", "hours_mode")))
    core = F.when(F.col("family") == "brand", F.col("fragment")).otherwise(F.concat_ws(" ", F.coalesce("need", "category"), F.array_join("used", " "), asking))
    known = F.transform("used", lambda a: F.try_element_at(_table(ENGLISH_ATTRIBUTES), a))
    english = F.when(F.col("family").isin("attribute-seek", "category-location") & F.forall(known, lambda a: a.isNotNull()), F.concat_ws(" ", F.try_element_at(_table(ENGLISH), F.col("category")), F.array_join(known, " ")))
    number = F.regexp_extract("district", "^Quận (\\d+)$", 1)
    short = F.when(F.col("district").isNotNull(), F.when(number != "", F.concat(F.lit("q"), number))).otherwise(F.try_element_at(_table(CITY_SHORT), F.col("city")))
    options = F.array(*(F.struct(F.lit(k).alias("name"), (F.lit(float(w)) * (F.when(short.isNotNull(), 1).otherwise(0) if k == "abbrev" else F.when(english.isNotNull(), 1).otherwise(0) if k == "mixed" else F.lit(1))).alias("weight")) for k, w in STYLES.items()))
    styled = one.withColumn("style", weighted_pick(options, u(6)))
    place = F.coalesce("district", "city")
    text = with_style(core, F.col("style"), place, short, english, u(7))
    skills = _table({"diacritics": "Diacritics", "typo": "Typo", "both": "Diacritics;Typo", "abbrev": "Abbreviation", "mixed": "MixedLanguage"})
    out = styled.join(ranks, "query_id").select("query_id", text.alias("input_query"), "family", "style", difficulty(F.col("family"), F.col("district"), F.col("used"), F.col("style")).alias("difficulty"), "expected_ids", F.try_element_at(skills, F.col("style")).alias("skills"))
    out = out.withColumn("_f", T.fold(F.col("input_query"))).withColumn("_r", F.row_number().over(Window.partitionBy("_f").orderBy("query_id"))).where("_r = 1")
    if official is not None:
        out = out.join(official.select(T.fold(F.col("text")).alias("_f")).distinct(), "_f", "left_anti")
    return out.drop("_f", "_r")
