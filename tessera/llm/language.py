"""Language ID: a text is of the language whose zstandard dictionary of raw content makes it smallest."""

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import small_batches

#: The bounds of the fit: languages, the most frequent ones; documents of each, the first ones by a hash; characters
#: of a document, as passages from places all over it; bytes of a dictionary.
LANGUAGES, DOCS, CHARS, PASSAGE, BYTES = 512, 192, 4_000, 500, 112_640
#: Greedy matches of 4 bytes or more: short ones tell languages apart.
LEVEL, MATCH = 3, 4
#: Bytes compressed at a time, at most: a text's own history must not take the place of the dictionary.
BLOCK = 8192
#: A choice is rejected if the second-best size is larger by less than this part of it.
MARGIN = 0.02
UNKNOWN = "und"
OTHER = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    """What is compressed: the whole text, lower-cased, with one space for each run of other than letters."""
    return OTHER.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def blocks(data: bytes) -> list[bytes]:
    """data in parts of equal size, as few as BLOCK allows."""
    step = -(-len(data) // -(-len(data) // BLOCK))
    return [data[i : i + step] for i in range(0, len(data), step)]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def passages(text: Column) -> Column:
    """A text of CHARS characters at most, or as many in passages of PASSAGE characters that lie evenly over it."""
    n = CHARS // PASSAGE
    step = (F.length(text) - PASSAGE) / float(n - 1)
    parts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(text, F.floor(i * step).cast("int") + 1, F.lit(PASSAGE)))
    return F.when(F.length(text) <= CHARS, text).otherwise(F.array_join(parts, " "))


def fit(docs: DataFrame) -> list[tuple[str, bytes]]:
    """(language, raw content) of each language of docs (doc_id, text, lang), languages with more documents first.

    Every labelled text with a letter can be chosen, however short. Only LANGUAGES * DOCS keys and their passages leave the executors.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    often = {r.lang: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    order = Window.partitionBy("lang").orderBy("_h", "doc_id")
    keys = known.where(F.col("lang").isin(list(often))).select("lang", "doc_id", F.xxhash64("doc_id", "text").alias("_h"))
    first = keys.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= DOCS).dropDuplicates(["lang", "doc_id", "_h"])
    # At most DOCS keys for each language: the texts that they are of are found without a shuffle.
    texts = known.select("lang", "doc_id", F.xxhash64("doc_id", "text").alias("_h"), "text")
    chosen = texts.join(F.broadcast(first), (texts.lang == first.lang) & texts.doc_id.eqNullSafe(first.doc_id) & (texts._h == first._h)).select(texts.lang, "rank", "text").distinct()
    # Passages are cut from chosen texts only: distinct() lies between them and the join.
    rows = chosen.select("lang", "rank", passages(F.col("text")).alias("text")).distinct().orderBy("lang", F.desc("rank"), "text").collect()
    found = defaultdict(list)
    for r in rows:
        found[r.lang].append(r.text)
    # A dictionary's end is nearest to the text: what is cut off is of the last ranks.
    return [(lang, plain(" ".join(dict.fromkeys(found[lang])))[-BYTES:]) for lang in sorted(found, key=lambda x: (-often[x], x))]


def predict(docs: DataFrame, model: list[tuple[str, bytes]]) -> DataFrame:
    """docs with lang_pred, score and rejected.

    lang_pred is the language of the smallest size, among equals the one with more documents; `und` if text is null
    or has no letter, or no language was learned. score is (second - best) / second, 1 with one language alone and 0
    for `und`. rejected says that the margin is under MARGIN, or that the text is `und`. Whole texts are compressed,
    in blocks that each begin with the dictionary alone, and the sizes of all blocks are summed.
    """

    @F.pandas_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard

        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, strategy=zstandard.STRATEGY_GREEDY, min_match=MATCH, window_log=19, write_content_size=False)
        compressors = []
        for _, raw in model:
            content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=how)
            compressors.append(zstandard.ZstdCompressor(dict_data=content, compression_params=how))
        for texts in batches:
            out = []
            for text in texts:
                if not model or not text or not any(map(str.isalpha, text)):
                    out.append((UNKNOWN, 0.0, True))
                    continue
                data = blocks(plain(text))
                sizes = [sum(len(c.compress(x)) for x in data) for c in compressors]
                best = min(range(len(sizes)), key=sizes.__getitem__)
                second = min(sizes[:best] + sizes[best + 1 :], default=None)
                score = 1.0 if second is None else (second - sizes[best]) / second
                out.append((model[best][0], round(score, 6), score < MARGIN))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    return docs.withColumn("_lang", judge("text")).select(*docs.columns, "_lang.*")


def languages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score, rejected.

    docs needs doc_id, text and lang; other columns are not read. Documents whose crc32(doc_id as text) mod 5 is 0 are held
    out of the fit; a null doc_id is not held out. Repeated rows return as often and are one text to the fit. An empty table gives
    an empty result.
    """
    parts = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    small_batches(spark)
    model = fit(parts.where(~F.col("held_out")))
    return predict(parts.select("doc_id", "held_out", "text"), model).drop("text")
