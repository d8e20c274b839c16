"""Text functions as column expressions: folding, tokens, abbreviations, typos, coordinates."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.sources.vocabulary import ABBREVIATIONS


@functools.cache
def _tables() -> tuple[str, str]:
    """All characters that decompose into one letter and marks, and those letters."""
    src, dst = "đĐ", "dD"
    for c in range(0xC0, 0x2C00):
        base = "".join(x for x in unicodedata.normalize("NFD", chr(c)) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != chr(c):
            src, dst = src + chr(c), dst + base
    return src, dst


#: The characters of folded words. As single characters, not ranges, the regular expression finds each by one look-up.
KEPT = "abcdefghijklmnopqrstuvwxyz0123456789/"


def strip_diacritics(c: Column) -> Column:
    """Case stays. Texts of ASCII alone are left as they are."""
    return F.when(c.rlike("[^\\x00-\\x7F]"), F.regexp_replace(F.translate(c, *_tables()), "\\p{Mn}+", "")).otherwise(c)


def fold(c: Column) -> Column:
    """Lower-cased words of a-z, 0-9 and / without diacritics, one space between them."""
    return F.trim(F.regexp_replace(F.lower(strip_diacritics(c)), f"[^{KEPT}]+", " "))


def py_fold(s: str) -> str:
    """fold() for the entries of small vocabularies."""
    import re

    s = "".join(x for x in unicodedata.normalize("NFD", s.replace("đ", "d").replace("Đ", "D")) if unicodedata.category(x) != "Mn")
    return re.sub("[^a-z0-9/]+", " ", s.lower()).strip()


def tokens(c: Column) -> Column:
    """The folded words of a text, an empty array for null."""
    return F.filter(F.split(F.coalesce(fold(c), F.lit("")), " "), lambda x: x != "")


def has_diacritics(c: Column) -> Column:
    return c != strip_diacritics(c)


def expand(toks: Column) -> Column:
    """Abbreviations spelled out, from left to right, pairs of words before single ones; q7 becomes quan 7."""
    table = F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv))
    pair = lambda i: F.try_element_at(table, F.concat(F.get(toks, i), F.lit(" "), F.get(toks, i + 1)))
    one = lambda i: F.coalesce(F.try_element_at(table, F.get(toks, i)), F.when(F.get(toks, i).rlike("^q\\d{1,2}$"), F.concat(F.lit("quan "), F.substring(F.get(toks, i), 2, 9))), F.get(toks, i))
    start = F.struct(F.lit(-1).alias("skip"), F.lit("").alias("text"))

    def step(a: Column, i: Column) -> Column:
        add = F.struct(F.when(pair(i).isNotNull(), i + 1).otherwise(a["skip"]).alias("skip"), F.concat(a["text"], F.lit(" "), F.coalesce(pair(i), one(i))).alias("text"))
        return F.when(a["skip"] == i, a).otherwise(add)

    places = F.when(F.size(toks) > 0, F.sequence(F.lit(0), F.size(toks) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.split(F.aggregate(places, start, step)["text"], " "), lambda x: x != "")


def padded(toks: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))


def contains_seq(toks: Column, key: Column) -> Column:
    """Whether the words of key follow each other in toks."""
    return (key != "") & F.contains(padded(toks), F.concat(F.lit(" "), key, F.lit(" ")))


def display(c: Column) -> Column:
    """Lower-cased words with their diacritics, padded; for composed characters."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}/]+", " ")), F.lit(" "))


def compatible_pattern(key: str) -> str:
    """A pattern of the ways to type a phrase: each letter with its own diacritics or without any."""
    import re

    def one(c: str) -> str:
        base = py_fold(c)
        return re.escape(c) if base == c or not base else f"[{c}{base}]"

    words = re.findall(r"[^\W_]+(?:/[^\W_]+)*", unicodedata.normalize("NFC", key).lower())
    return " " + " ".join("".join(one(c) if c != "/" else "/" for c in w) for w in words) + " "


def pattern(c: Column) -> Column:
    """compatible_pattern() for a column of composed phrases, such as names that the data bring."""
    words = F.trim(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}/]+", " "))
    # No marks of their own are left in words, so a letter and its plain form stand at the same place. Both texts are made once, not once a letter.
    both = F.zip_with(F.split(words, ""), F.split(strip_diacritics(words), ""), lambda x, y: F.when(x != y, F.concat(F.lit("["), x, y, F.lit("]"))).otherwise(x))
    return F.concat(F.lit(" "), F.when(words.rlike("[^\\x00-\\x7F]"), F.array_join(both, "")).otherwise(words), F.lit(" "))


@functools.cache
def _composed():
    import unicodedata as u

    @F.pandas_udf("string")
    def nfc(texts):
        return texts.map(lambda t: u.normalize("NFC", t), na_action="ignore")

    return nfc


def composed(c: Column) -> Column:
    """Letters and the marks after them as one character each; for queries, which are the small side."""
    return _composed()(c)


def corrected_query(original: Column, value: Column) -> Column:
    """struct(text, reason): a model's correction of a query, or why it is none.

    White space is collapsed; empty ones, those over 200 characters, those that differ in case alone, and those that share no
    folded word with the original are refused. null is no correction and no refusal.
    """
    clean = F.trim(F.regexp_replace(value, "\\s+", " "))
    reason = F.when(clean == "", "empty").when(F.length(clean) > 200, "too-long").when(F.lower(clean) == F.lower(original), "no-op").when(~F.arrays_overlap(tokens(clean), tokens(original)), "no-overlap")
    return F.struct(F.when(reason.isNull(), clean).alias("text"), F.when(value.isNotNull(), reason).alias("reason"))


def redacted(c: Column, secret: str) -> Column:
    """A message without a key that it may quote."""
    return F.replace(c, F.lit(secret), F.lit("***")) if secret else c


def safe_name(c: Column) -> Column:
    """A model's name as part of a path."""
    return F.translate(c, "/:", "__")


def transposed(a: Column, b: Column) -> Column:
    """Whether b is a with two neighbouring, different characters swapped."""
    swapped = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a)))
    return (a != b) & (F.length(a) == F.length(b)) & (F.length(a) > 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: swapped(i) == b)


def edit1(a: Column, b: Column) -> Column:
    """Whether one insertion, deletion, substitution or swap of neighbours at most makes b of a."""
    return (F.levenshtein(a, b, 1) >= 0) | transposed(a, b)


def deletions(w: Column) -> Column:
    """A word and all words that lack one of its characters: words at distance 1 share one of these."""
    return F.array_distinct(F.concat(F.array(w), F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))


def coordinates(c: Column) -> Column:
    """struct(lat, lon) of the first pair of neighbouring decimals that lies in the country's bounds, either way round."""
    found = F.regexp_extract_all(c, F.lit("(-?\\d+\\.\\d+)(?=[\\s,]+(-?\\d+\\.\\d+))"), F.lit(1))
    other = F.regexp_extract_all(c, F.lit("(-?\\d+\\.\\d+)(?=[\\s,]+(-?\\d+\\.\\d+))"), F.lit(2))
    inside = lambda a, b: a.between(8.0, 24.0) & b.between(102.0, 110.0)

    def point(x: Column, y: Column) -> Column:
        a, b = x.cast("double"), y.cast("double")
        return F.when(inside(a, b), F.struct(a.alias("lat"), b.alias("lon"))).when(inside(b, a), F.struct(b.alias("lat"), a.alias("lon")))

    return F.get(F.filter(F.zip_with(found, other, point), lambda p: p.isNotNull()), F.lit(0))


def thousands(c: Column) -> Column:
    return F.replace(F.format_number(c, 0), F.lit(","), F.lit("."))
