"""Quality rules: robust multivariate outliers, by DataFrame and SQL functions only.

Statistics of each text are turned into a vector; a minimum-covariance-determinant estimate for each language
and source gives its centre and scatter, and a document whose Mahalanobis distance is too large is rejected. The
estimate is searched from several starts: each is concentrated on the nearest part of its group until that no longer
changes, and of all covering parts so found the one whose scatter has the least determinant is taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import BLANK, Scratch

SYMBOLS = "#*$%&|<>"
#: Vectors are held as whole numbers of 1 / SCALE, so all sums are exact and do not depend on their order.
SCALE = 256
#: The part of a group that the estimate covers, and the size below which groups are pooled: 5 for each component.
COVER, LEAST_GROUP = 0.75, 20
#: Starts: medians, and STARTS - 1 elemental subsets of one row more than there are components, drawn by a hash. All are
#: concentrated until none changes; a search that still changes after ROUNDS takes the best that it has seen.
STARTS, ROUNDS = 4, 30
#: Least standard deviation of each component: rarer values than the group ever shows are not outliers by themselves.
FLOOR = (0.06, 0.05, 0.15, 0.15)
#: Probability with which a normal vector is kept.
KEEP = 0.999999
BINS = 4096
NAMES = ("x1", "x2", "x3", "x4")
POOL = "*"


def text_statistics(docs: DataFrame) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words of column text, beside all other columns.

    Words are runs of other than ASCII white space. A null text has none. The windows of 8 words are compared by
    64-bit hashes inside one row: the work is n log n for a text of n words, and nothing is shuffled.
    """
    blank = "\\u0020\\u0009\\u000A\\u000B\\u000C\\u000D"
    gets = ", ".join(f"get(_h, i + {k})" for k in range(8))
    plain = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    words = plain.withColumn("_words", F.expr(f"CASE WHEN trim(BOTH '{blank}' FROM _text) = '' THEN CAST(array() AS array<string>) ELSE split(trim(BOTH '{blank}' FROM _text), '[{BLANK}]+') END".replace("\\x", "\\\\x")))
    base = words.withColumn("_lines", F.expr(f"filter(split(_text, '\\n'), l -> trim(BOTH '{blank}' FROM l) <> '')")).select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.expr("transform(_words, w -> xxhash64(w))").alias("_h"),
    )
    windows = base.withColumn("_w", F.expr(f"CASE WHEN size(_h) >= 8 THEN transform(sequence(0, size(_h) - 8), i -> xxhash64({gets})) ELSE CAST(array() AS array<bigint>) END"))
    sorted_ = windows.withColumn("_s", F.expr("CASE WHEN size(array_distinct(_w)) < size(_w) THEN sort_array(transform(_w, (v, i) -> struct(v, i AS p))) END"))
    places = sorted_.withColumn("_p", F.expr("CASE WHEN _s IS NOT NULL THEN sort_array(transform(filter(sequence(0, size(_s) - 1), k -> (k > 0 AND get(_s, k).v = get(_s, k - 1).v) OR (k < size(_s) - 1 AND get(_s, k).v = get(_s, k + 1).v)), k -> get(_s, k).p)) END"))
    covered = F.expr("CASE WHEN _p IS NOT NULL THEN aggregate(sequence(1, size(_p) - 1), 8L, (a, k) -> a + least(8, get(_p, k) - get(_p, k - 1))) ELSE 0L END")
    return places.withColumn("n_repeat_words", covered).drop("_h", "_w", "_s", "_p")


def _vector() -> list[Column]:
    ratio = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    parts = (F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), ratio("n_symbols", "word_chars"), ratio("n_dup_lines", "n_lines"), ratio("n_repeat_words", "n_words"))
    return [F.round(x * SCALE).cast("long").alias(n) for n, x in zip(NAMES, parts, strict=True)]


def chi2_cdf(x: float, dof: int) -> float:
    """The chi-square distribution for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dof // 2))


def chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < p else (low, mid)
    return low


def _distance() -> Column:
    """The squared Mahalanobis distance of x1..x4 from m1..m4 with scatter c11..c44, by Cholesky's factor.

    Each step is bound to a name, so the formula grows with the cube of 4 and not beyond.
    """
    p, out = len(NAMES), []
    for i in range(p):
        for j in range(i + 1):
            inner = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            out.append((f"l{i}{j}", f"sqrt(greatest(c{i}{i}{inner}, 1e-9D))" if i == j else f"(c{j}{i}{inner}) / l{j}{j}"))
    for i in range(p):
        out.append((f"y{i}", f"(x{i + 1} / {SCALE}D - m{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(i)) + f") / l{i}{i}"))
    return out, " + ".join(f"y{i} * y{i}" for i in range(p))


def _with_distance(df: DataFrame) -> DataFrame:
    steps, total = _distance()
    keep = df.columns
    for name, how in steps:
        df = df.withColumn(name, F.expr(how))
    return df.select(*keep, F.expr(total).alias("d2"))


def _with_determinant(estimate: DataFrame) -> DataFrame:
    """estimate with logdet, the logarithm of its scatter's determinant, from the diagonal of Cholesky's factor."""
    keep = estimate.columns
    for name, how in _distance()[0]:
        if name[0] == "l":
            estimate = estimate.withColumn(name, F.expr(how))
    return estimate.select(*keep, F.round(sum((2 * F.log(f"l{i}{i}") for i in range(len(NAMES))), F.lit(0.0)), 9).alias("logdet"))


P = len(NAMES)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _sums() -> list[Column]:
    return [F.sum(x).alias(f"s{i}") for i, x in enumerate(NAMES)] + [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"s{i}{j}") for i, j in PAIRS]


def _estimates(sums: DataFrame, factor: float) -> DataFrame:
    """Centre and scatter of each group and start from its exact sums, with the least deviations added."""
    centre = [F.expr(f"s{i} / n / {SCALE}D").alias(f"m{i}") for i in range(P)]
    scatter = [F.expr(f"greatest(s{i}{j} / n - (s{i} / n) * (s{j} / n), {'0D' if i == j else '-1e300D'}) / {SCALE * SCALE}D * {factor}D + {FLOOR[i] ** 2 if i == j else 0.0}D").alias(f"c{i}{j}") for i, j in PAIRS]
    return _with_determinant(sums.select("g1", "g2", "start", *centre, *scatter))


def _starts(fit: DataFrame, scratch: Scratch) -> DataFrame:
    """The first estimates of each group: medians with deviations from them, and elemental subsets."""
    mid = scratch.write(fit.groupBy("g1", "g2").agg(*(F.percentile(x, F.lit(0.5)).alias(f"q{i}") for i, x in enumerate(NAMES))))
    spread = fit.join(mid, ["g1", "g2"]).groupBy("g1", "g2").agg(*(F.first(f"q{i}").alias(f"q{i}") for i in range(P)), *(F.percentile(F.abs(F.col(x) - F.col(f"q{i}")), F.lit(0.5)).alias(f"d{i}") for i, x in enumerate(NAMES)))
    out = _with_determinant(spread.select("g1", "g2", F.lit(0).alias("start"), *(F.expr(f"q{i} / {SCALE}D").alias(f"m{i}") for i in range(P)), *(F.expr(f"pow(1.4826D * d{i} / {SCALE}D, 2) + {FLOOR[i] ** 2}D" if i == j else "0D").alias(f"c{i}{j}") for i, j in PAIRS)))
    for start in range(1, STARTS):
        drawn = Window.partitionBy("g1", "g2").orderBy(F.xxhash64(F.lit(start), "doc_id", *NAMES), "doc_id", *NAMES)
        subset = fit.withColumn("_r", F.row_number().over(drawn)).where(F.col("_r") <= P + 1)
        out = out.unionByName(_estimates(subset.groupBy("g1", "g2").agg(F.lit(start).alias("start"), F.count("*").alias("n"), *_sums()), 1.0))
    return out


def least_determinants(fit: DataFrame, scratch: Scratch) -> DataFrame:
    """The estimate of each group (g1, g2) of fit (g1, g2, doc_id, x1..x4): m0..m3, c00..c33, logdet.

    A step takes the COVER nearest vectors of a group by the last estimate, and their mean and covariance. The nearest are
    found by counts and sums of BINS distances: a group of any size is never gathered.
    """
    factor = COVER / chi2_cdf(chi2_quantile(COVER, P), P + 2)
    names = [f"s{i}" for i in range(P)] + [f"s{i}{j}" for i, j in PAIRS]
    group = Window.partitionBy("g1", "g2", "start")
    estimate, seen = scratch.write(_starts(fit, scratch)), []
    for _ in range(ROUNDS):
        near = _with_distance(fit.join(estimate.drop("logdet"), ["g1", "g2"])).withColumn("bin", F.least(F.floor(F.log1p("d2") * 256), F.lit(BINS - 1)).cast("int"))
        bins = near.groupBy("g1", "g2", "start", "bin").agg(F.count("*").alias("n"), *_sums())
        upto = bins.withColumn("below", F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))).withColumn("all", F.sum("n").over(group))
        chosen = upto.where(F.coalesce("below", F.lit(0)) < F.ceil(F.col("all") * COVER))
        now = scratch.write(_estimates(chosen.groupBy("g1", "g2", "start").agg(F.sum("n").alias("n"), *(F.sum(x).alias(x) for x in names)), factor))
        seen.append(now)
        moved = now.alias("a").join(estimate.alias("b"), ["g1", "g2", "start"]).where(F.abs(F.col("a.logdet") - F.col("b.logdet")) > 1e-9)
        # Searches that no longer move stop; those that have come to one place as another of their group would go the same way.
        moving = moved.groupBy("g1", "g2", F.col("a.logdet").alias("logdet")).agg(F.min("start").alias("start"))
        estimate = scratch.write(now.join(moving.drop("logdet"), ["g1", "g2", "start"], "left_semi"))
        if estimate.isEmpty():
            break
    every = seen[0]
    for x in seen[1:]:
        every = every.unionByName(x)
    columns = [f"m{i}" for i in range(P)] + [f"c{i}{j}" for i, j in PAIRS] + ["logdet"]
    best = every.groupBy("g1", "g2").agg(F.min(F.struct("logdet", "start", *(c for c in columns if c != "logdet"))).alias("b"))
    return scratch.write(best.select("g1", "g2", *(F.col(f"b.{c}").alias(c) for c in columns)))


def outliers(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2.

    docs needs doc_id, text, lang and source; other columns, whatever their names, are not read. The base rules
    reject texts of under 20 words and texts in which over 30 % of the words lie in repeated windows. All
    others, by language and source (nulls are a value of their own), get an estimate that covers COVER of their
    group; groups under LEAST_GROUP are pooled by language, then all together. kept is false beyond the
    distance that KEEP of normal vectors stay within. Repeated rows count as often as they occur and each returns a row.
    Empty and null texts fail the base rules; an empty table gives an empty result. The estimates read only a
    table of four whole numbers for each document, of which every round makes counts and sums by group, start and
    one of BINS distances: a group of any size is never gathered in one place.
    """
    scratch = Scratch(spark)
    stats = text_statistics(docs.select("doc_id", "text", F.coalesce("lang", F.lit("\0")).alias("g1"), F.coalesce("source", F.lit("\0")).alias("g2"))).drop("text")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = scratch.write(stats.withColumn("base_failed", failed).select("*", *_vector()))
    fit = stats.where(~F.col("base_failed"))

    # Small groups are pooled, first by language, then all together. As each document falls in exactly one pool, none is left out.
    pools = scratch.write(fit.groupBy("g1", "g2").count())
    first = pools.select("g1", "g2", "count", F.when(F.col("count") >= LEAST_GROUP, F.col("g2")).otherwise(POOL).alias("h2"))
    second = first.groupBy("g1", "h2").agg(F.sum("count").alias("n")).select("g1", "h2", F.when((F.col("n") >= LEAST_GROUP) | (F.col("h2") != POOL), F.col("g1")).otherwise(POOL).alias("h1"))
    groups = scratch.write(first.join(second, ["g1", "h2"]).select("g1", "g2", "h1", "h2"))
    fit = scratch.write(fit.join(groups, ["g1", "g2"]).select("doc_id", F.col("h1").alias("g1"), F.col("h2").alias("g2"), *NAMES))

    estimate = least_determinants(fit, scratch)
    far = groups.join(estimate.drop("logdet").withColumnsRenamed({"g1": "h1", "g2": "h2"}), ["h1", "h2"]).drop("h1", "h2")
    judged = _with_distance(stats.join(far, ["g1", "g2"], "left"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= chi2_quantile(KEEP, P), F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.when(~F.col("base_failed"), F.round("d2", 6)).alias("distance2"))
