"""The rule parser: queries to intents by joins with small vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources import vocabulary as V
from tessera.sources.store import Store


def phrases(spark: SparkSession) -> DataFrame:
    """(kind, ord, key, pattern, value, lat, lon): all phrases of the vocabularies and the landmarks, some hundred rows."""
    rows = [(kind, i, T.py_fold(k), T.compatible_pattern(k), v, None, None) for kind, table in (("category", V.CATEGORIES), ("need", V.NEEDS), ("attribute", V.ATTRIBUTES), ("price", V.PRICES), ("nearest", {"nearest": V.NEAREST})) for i, k, v in V.keys(table)]
    rows += [("landmark", i, T.py_fold(n), T.compatible_pattern(n), n, lat, lon) for i, (n, lat, lon) in enumerate(V.LANDMARKS)]
    return spark.createDataFrame(rows, "kind string, ord long, key string, pattern string, value string, lat double, lon double")


def districts(places: DataFrame) -> DataFrame:
    """Centroids under the district's name, which merges cities, and under district and city: (key, ord, name, lat, lon)."""
    # Names are summed up as they are written, which leaves few to fold.
    own = places.groupBy("district", "city").agg(F.min("pos").alias("pos"), F.sum("lat").alias("lat"), F.count("lat").alias("nlat"), F.sum("lon").alias("lon"), F.count("lon").alias("nlon"))
    named = F.explode(F.array(F.struct(F.col("district").alias("name"), F.lit(0).alias("o")), F.struct(F.concat_ws(", ", "district", "city").alias("name"), F.lit(1).alias("o"))))
    each = own.select("pos", "lat", "nlat", "lon", "nlon", named.alias("n")).select("pos", "lat", "nlat", "lon", "nlon", "n.*")
    mean = lambda c: F.try_divide(F.sum(c), F.sum(f"n{c}")).alias(c)
    return each.groupBy(T.fold(F.col("name")).alias("key")).agg(F.min(F.struct("pos", "o")).alias("ord"), F.min_by("name", F.struct("pos", "o")).alias("name"), mean("lat"), mean("lon"))


def gazetteer(places: DataFrame) -> DataFrame:
    """Cities, districts and names of places in the columns of phrases(); first places go first, of equal names the last place counts."""
    area = districts(places).select(F.lit("district").alias("kind"), (F.col("ord.pos") * 2 + F.col("ord.o")).cast("long").alias("ord"), "key", F.col("name").alias("value"), "lat", "lon")
    none = F.lit(None).cast("double")
    cities = places.groupBy("city").agg(F.min("pos").alias("pos"), F.max("pos").alias("last"))
    names = places.groupBy("name").agg(F.min("pos").alias("pos"), F.max("pos").alias("last"), F.max_by(F.struct("name", "lat", "lon"), "pos").alias("p"))
    city = cities.groupBy(T.fold(F.col("city")).alias("key")).agg(F.min("pos").cast("long").alias("ord"), F.max_by("city", "last").alias("value")).select(F.lit("city").alias("kind"), "ord", "key", "value", none.alias("lat"), none.alias("lon"))
    name = names.groupBy(T.fold(F.col("name")).alias("key")).agg(F.min("pos").cast("long").alias("ord"), F.max_by("p", "last").alias("p")).select(F.lit("name").alias("kind"), "ord", "key", F.col("p.name").alias("value"), "p.lat", "p.lon")
    both = area.unionByName(city).unionByName(name).where("key <> ''")
    return both.select("kind", "ord", "key", T.pattern(F.col("value")).alias("pattern"), "value", "lat", "lon")


def matches(hay: Column, raw: Column, key: Column, pattern: Column) -> Column:
    """A folded phrase in the haystack; where the raw text has it as typed, its diacritics must agree."""
    inside = F.contains(hay, F.concat(F.lit(" "), key, F.lit(" ")))
    typed = F.contains(F.concat(F.lit(" "), T.fold(raw), F.lit(" ")), F.concat(F.lit(" "), key, F.lit(" ")))
    return (key != "") & inside & (~typed | F.rlike(T.display(raw), pattern))


class Lookups:
    """What the parser looks up, as tables that are written once.

    phrases: vocabularies, landmarks, cities, districts and names under their folded keys; target and known: words that a typo may be
    corrected to, and that are no typos; rare: words of at most MOST_PLACES names or brands; common: folded common words with the patterns of
    their forms; longest: words of the longest key.
    """

    MOST_PLACES = 2

    def __init__(self, spark: SparkSession, places: DataFrame, common: DataFrame | None = None, store: Store | None = None):
        store = store or Store(spark)
        have = places.select(F.col("category").alias("value")).distinct()
        fixed = phrases(spark)
        named = fixed.where("kind IN ('category', 'need')").join(have, "value", "left_semi")
        every = fixed.where("kind NOT IN ('category', 'need')").unionByName(named).unionByName(gazetteer(places))
        self.phrases = store.write(every, "phrases")
        self.longest = self.phrases.agg(F.max(F.size(F.split("key", " ")))).first()[0]
        words = lambda df: df.select(F.explode(F.split("key", " ")).alias("term"))
        target = words(fixed.where("kind IN ('category', 'attribute', 'landmark')")).unionByName(words(self.phrases.where("kind IN ('city', 'district')")))
        self.target = store.write(target.where("term <> ''").distinct(), "target")
        plain = spark.createDataFrame([(w,) for w in V.COMMON], "word string") if common is None else common.select("word")
        folded = plain.select(T.fold(F.col("word")).alias("term"), T.pattern(F.col("word")).alias("pattern")).where("term <> ''")
        self.common = store.write(folded.distinct(), "common")
        stop = spark.createDataFrame([(w,) for w in V.STOPWORDS], "term string")
        self.known = store.write(self.target.unionByName(words(self.phrases.where("kind = 'name'"))).unionByName(stop).unionByName(self.common.select("term")).distinct(), "known")
        own = F.col("ctoks") if "ctoks" in places.columns else F.array_distinct(T.tokens(F.concat_ws(" ", "name", "brand")))
        content = places.select(F.explode(own).alias("term"))
        self.rare = store.write(content.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") <= self.MOST_PLACES), "rare")


def grams(toks: Column, longest: int) -> Column:
    """All runs of up to so many words, each joined by spaces."""
    of = lambda n: F.when(F.size(toks) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(toks) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(toks, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(max(1, longest))), of)))


def corrected(queries: DataFrame, lookups: Lookups) -> DataFrame:
    """queries (query_id, toks, ftoks) with fixes, a map of unknown words of 4 letters and more to the word that each is a typo of."""
    from tessera.operators.retrieval import canonical

    words = queries.select("query_id", F.explode(F.array_union("toks", "ftoks")).alias("term"))
    unknown = words.select("term").distinct().join(lookups.known, "term", "left_anti")
    fixes = words.join(canonical(unknown, lookups.target), "term").groupBy("query_id").agg(F.map_from_entries(F.collect_set(F.struct("term", "canonical"))).alias("fixes"))
    return queries.join(fixes, "query_id", "left").withColumn("fixes", F.coalesce("fixes", F.create_map().cast("map<string,string>")))


def parse(spark: SparkSession, queries: DataFrame, lookups: Lookups) -> DataFrame:
    """One intent for each query (query_id, text); ids are unique.

    Columns: query_id, text, toks, want_category, required, soft, want_city, want_district, open_after, price_pref, nearest,
    anchor_name, anchor_lat, anchor_lon, residual, terms, corrected_query. A named category goes before a needed one; the longest phrase
    goes first. An anchor is a coordinate pair, else a landmark, a district's centroid, or a place's name. residual has
    the words that nothing explains, stop words and common words aside; terms are those of them that few names have.

    All phrases are found by one join of the query's runs of words with the keys, so tables of any size are looked up without a nested loop.
    """
    none = F.array().cast("array<string>")
    q = queries.select("query_id", F.coalesce(T.composed(F.col("text")), F.lit("")).alias("text"))
    q = q.withColumn("ftoks", T.tokens(F.col("text"))).withColumn("toks", T.expand(F.col("ftoks")))
    q = corrected(q, lookups)
    fixed = lambda t: F.coalesce(F.try_element_at("fixes", t), t)
    q = q.withColumn("shown", T.display(F.col("text"))).withColumn("hay", F.concat(F.transform("toks", fixed), F.transform("ftoks", fixed)))

    runs = lambda c, typed: q.select("query_id", "shown", F.explode(grams(F.col(c), lookups.longest)).alias("key"), F.lit(typed).alias("typed"))
    found = runs("hay", False).unionByName(runs("ftoks", True)).groupBy("query_id", "shown", "key").agg(F.max("typed").alias("typed"), F.max(~F.col("typed")).alias("inside"))
    hits = found.join(lookups.phrases, "key").withColumn("agrees", F.rlike("shown", F.col("pattern")))
    # Landmarks and names are looked for in the query as typed, all else in the expanded and corrected words too.
    typed_only = F.col("kind").isin("landmark", "name")
    hits = hits.where(F.when(typed_only, F.col("typed") & F.col("agrees")).otherwise(F.col("inside") & (~F.col("typed") | F.col("agrees"))))

    kind = lambda *k: F.col("kind").isin(*k)
    longest = F.struct(F.col("kind"), (-F.length("key")).alias("l"), F.col("ord"))
    place = F.struct("value", "key", "lat", "lon")
    first = lambda k, what=place: F.min_by(F.when(kind(k), what), F.when(kind(k), F.col("ord")))
    attributes = F.array_sort(F.collect_list(F.when(kind("attribute"), F.struct((-F.length("key")).alias("l"), F.col("ord"), F.col("value")))))
    parts = hits.groupBy("query_id").agg(
        F.min_by(F.when(kind("category", "need"), place), F.when(kind("category", "need"), longest)).alias("c"),
        F.array_distinct(F.transform(attributes, lambda x: x["value"])).alias("required"),
        F.max(F.when(kind("price"), F.when(F.col("value") == "cheap", 2).otherwise(1))).alias("p"),
        F.max(kind("nearest")).alias("nearest"), first("city").alias("city"), first("district").alias("district"), first("landmark").alias("landmark"), first("name").alias("name"),
        F.flatten(F.collect_set(F.when(kind("attribute", "price", "nearest"), F.split("key", " ")))).alias("okeys"),
    )
    joined = q.join(parts, "query_id", "left")
    point = T.coordinates(F.col("text"))
    pair = F.when(point.isNotNull(), F.struct(F.lit(V.HERE).alias("value"), F.lit("").alias("key"), point["lat"].alias("lat"), point["lon"].alias("lon")))
    joined = joined.withColumn("a", F.coalesce(pair, "landmark", "district", "name"))
    named = [F.coalesce(F.split(c, " "), none) for c in ("c.key", "city.key", "district.key")]
    joined = joined.withColumn("consumed", F.concat(*named, F.coalesce("okeys", none), F.coalesce(T.tokens(F.col("a.value")), none)))

    flagged = q.select("query_id", "shown", F.explode(F.array_distinct("ftoks")).alias("term")).join(lookups.common, "term").where(F.rlike("shown", F.col("pattern"))).groupBy("query_id").agg(F.collect_set("term").alias("flagged"))
    joined = joined.join(flagged, "query_id", "left")
    keep = lambda t: ~F.array_contains("consumed", t) & ~F.array_contains("consumed", fixed(t)) & ~t.isin(*V.STOPWORDS) & ~F.array_contains(F.coalesce("flagged", none), t) & (F.length(t) >= 2) & ~t.rlike("^\\d+$")
    required = F.coalesce("required", none)
    out = joined.select(
        "query_id", "text", "toks", F.col("c.value").alias("want_category"), required.alias("required"), none.alias("soft"), F.col("city.value").alias("want_city"), F.col("district.value").alias("want_district"),
        F.when(F.array_contains(required, "mở khuya"), 22 * 60).alias("open_after"), F.when(F.col("p") == 2, "cheap").when(F.col("p") == 1, "expensive").alias("price_pref"), F.coalesce("nearest", F.lit(False)).alias("nearest"),
        F.col("a.value").alias("anchor_name"), F.col("a.lat").alias("anchor_lat"), F.col("a.lon").alias("anchor_lon"), F.filter(F.array_distinct("toks"), keep).alias("residual"), F.lit(None).cast("string").alias("corrected_query"),
    )
    subject = out.select("query_id", F.posexplode("residual").alias("at", "term")).where("term RLIKE '^[a-z]{3,}$'").join(lookups.rare, "term").groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]).alias("terms"))
    return out.join(subject, "query_id", "left").withColumn("terms", F.coalesce("terms", none))


def resolve(spark: SparkSession, queries: DataFrame, outputs: DataFrame, lookups: Lookups, lexicon: DataFrame, always: bool = False) -> DataFrame:
    """Intents of queries (query_id, text) with the replies (query_id, raw) of a language model, in the columns of parse().

    A reply counts for a query that is degraded (needs_model(); or for all, if always) and whose reply is an object. Its corrected
    query is parsed instead of the text, unless that parse explains less; then its fields fill what the rules left open.
    Where it brings the category, residual words that name that category are explained. text stays the original one.
    """
    words = queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")).where(F.length("term") >= 4)
    unknown = words.join(lexicon.select("term"), "term", "left_anti").select("query_id").distinct().withColumn("oov", F.lit(True))
    gate = queries.join(unknown, "query_id", "left").where(F.lit(always) | needs_model(F.col("text"), F.coalesce("oov", F.lit(False)))).select("query_id", "text")
    replies = validated(gate.join(outputs.select("query_id", "raw"), "query_id")).where("is_object")
    plain = parse(spark, queries, lookups)
    again = parse(spark, replies.where("corrected_query IS NOT NULL").select("query_id", F.col("corrected_query").alias("text")), lookups)
    shape = lambda p: F.struct(F.col(f"{p}.want_category").alias("category"), F.col(f"{p}.required").alias("required"), F.col(f"{p}.residual").alias("residual"))
    adopted = again.alias("n").join(plain.alias("o"), "query_id").select("n.*", shape("o").alias("before"), shape("n").alias("after")).where(~degrades("before", "after")).drop("before", "after")
    fields = [c for c in plain.columns if c not in ("query_id", "text", "corrected_query")]
    both = plain.join(adopted.select("query_id", F.struct("text", *fields).alias("n")), "query_id", "left")
    chosen = both.select("query_id", "text", *(F.when(F.col("n").isNotNull(), F.col("n")[c]).otherwise(F.col(c)).alias(c) for c in fields), F.col("n.text").alias("corrected_query"))
    rules = chosen.select("query_id", F.col("want_category").alias("_rule"))
    out = merged(chosen, replies).join(rules, "query_id")
    named = F.create_map(*(x for c in V.CATEGORIES for x in (F.lit(c), F.array(*(F.lit(w) for w in category_words(c))))))
    says = F.when(F.col("_rule").isNull(), F.coalesce(F.try_element_at(named, F.col("want_category")), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    left = F.filter("residual", lambda t: ~F.array_contains(says, t))
    return out.withColumn("residual", left).withColumn("terms", F.array_intersect("terms", "residual")).select(*plain.columns)


def category_words(category: str) -> list[str]:
    """The folded words of all phrases that name or need a category."""
    return sorted({w for table in (V.CATEGORIES, V.NEEDS) for k in table.get(category, ()) for w in T.py_fold(k).split()})


# Parses that a language model made, as data.

def lenient_json(c: Column) -> Column:
    """The object in a reply: fences and talk around it go."""
    return F.regexp_extract(F.regexp_replace(c, "(?s)```(?:json)?", ""), "(?s)\\{.*\\}", 0)


def validated(outputs: DataFrame) -> DataFrame:
    """(query_id, raw[, text]) as fields of the closed vocabularies, null where a value is foreign, with what was dropped.

    is_object says whether raw holds a JSON object. With text, the original query, corrected_query is checked against it.
    """
    reply = lenient_json(F.col("raw"))
    fields = F.from_json(reply, "corrected_query string, category string, attributes array<string>, price_pref string, open_after string")
    is_object = F.coalesce(F.startswith(F.trim(reply), F.lit("{")) & F.try_parse_json(reply).isNotNull(), F.lit(False))
    original = F.col("text") if "text" in outputs.columns else F.lit(None).cast("string")
    o = outputs.select("query_id", original.alias("_text"), is_object.alias("is_object"), fields.alias("o")).select("query_id", "_text", "is_object", "o.*")
    attributes = F.coalesce("attributes", F.array().cast("array<string>"))
    known = F.array(*map(F.lit, V.ATTRIBUTES))
    checks = {"category": F.col("category").isin(*V.CATEGORIES), "price_pref": F.col("price_pref").isin("cheap", "expensive"), "open_after": F.col("open_after").rlike("^([01]\\d|2[0-3]):([0-5]\\d)$")}
    query = T.corrected_query(F.col("_text"), F.col("corrected_query"))
    query = F.when(F.col("_text").isNull(), F.struct(F.col("corrected_query").alias("text"), F.lit(None).cast("string").alias("reason"))).otherwise(query)
    dropped = F.concat(F.filter(F.array(*(F.when(F.col(k).isNotNull() & ~v, k) for k, v in checks.items()), F.when(query["reason"].isNotNull(), F.concat(F.lit("corrected_query:"), query["reason"]))), lambda x: x.isNotNull()), F.transform(F.array_except(attributes, known), lambda a: F.concat(F.lit("attribute:"), a)))
    return o.select("query_id", "is_object", query["text"].alias("corrected_query"), *(F.when(v, F.col(k)).alias(k) for k, v in checks.items()), F.array_intersect(attributes, known).alias("attributes"), dropped.alias("dropped"))


def merged(intents: DataFrame, outputs: DataFrame) -> DataFrame:
    """Rule intents (query_id, want_category, required, price_pref, open_after) filled by validated(); rules go first, attributes are united, places stay."""
    o = outputs.select("query_id", F.col("category").alias("_c"), F.col("attributes").alias("_a"), F.col("price_pref").alias("_p"), (F.split("open_after", ":")[0].cast("int") * 60 + F.split("open_after", ":")[1].cast("int")).alias("_o"))
    j = intents.join(o, "query_id", "left")
    none = F.array().cast("array<string>")
    return j.withColumns({"want_category": F.coalesce("want_category", "_c"), "required": F.array_union("required", F.coalesce("_a", none)), "price_pref": F.coalesce("price_pref", "_p"), "open_after": F.coalesce("open_after", "_o")}).drop("_c", "_a", "_p", "_o")


def needs_model(text: Column, unknown: Column) -> Column:
    """Whether a query is degraded: no diacritics at all, or a word of 4 letters or more that the lexicon lacks (unknown)."""
    return ~T.has_diacritics(text) | unknown


def degrades(before: str, after: str) -> Column:
    """Whether a rewrite lost a category or an attribute or left more unexplained, for two intent structs."""
    b, a = F.col(before), F.col(after)
    return (b["category"].isNotNull() & a["category"].isNull()) | (F.size(F.array_except(b["required"], a["required"])) > 0) | (F.size(a["residual"]) > F.size(b["residual"]))
