"""Mixing sources to target weights: a temperature on token shares, realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import BLANK, Scratch

#: The entropy of the weights as a part of the most that the sources allow, and how often a source may be repeated.
ENTROPY, REPEATS = 0.9, 4.0
#: The exponent lies between 0 and STEEPEST and is bisected to 1 / FINE; each job halves the range HALVINGS times.
STEEPEST, FINE, HALVINGS = 4096.0, 1 << 20, 4
#: A source's documents fall into 2^BITS blocks by their hash, in each of LEVELS levels.
BITS, LEVELS = 10, 2
SEED = 20_240_229


def tokens(text: Column) -> Column:
    """The number of words: runs of other than ASCII white space."""
    blank = " \u0009\u000a\u000b\u000c\u000d"
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(blank))
    return F.when(bare == "", 0).otherwise(F.regexp_count(bare, F.lit(f"[{BLANK}]+")) + 1).cast("long")


def exponent(sources: DataFrame, budget: float, entropy: float = ENTROPY, repeats: float = REPEATS) -> float:
    """The exponent a of weights w ~ share^a whose entropy is entropy * log(sources): under 1 it evens shares out, over 1 it sharpens them.

    The entropy falls with a, so it is bisected, from both sides of 1 alike. Where no exponent has it (equal sources, or
    a target under that of the largest sources alone) a is 1. If a source were repeated more than repeats times, a is moved
    toward 1 until none is; if even 1 repeats them more, as the budget is too large, a is 1. An aggregation of the sources, which
    need not fit the driver, measures several exponents at once. The result is within 1 / FINE of the exact one.
    """
    total, least, most, n = sources.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens"), F.count("*")).first()
    if not n or least == most:
        return 1.0
    known: dict[float, tuple[float, float]] = {}

    def measure(exponents: list[float]) -> None:
        """Entropy and largest repetition for each; shares are taken of the largest source, so nothing overflows."""
        parts, new = [], [a for a in exponents if a not in known]
        for i, a in enumerate(new):
            log = F.lit(a) * F.log(F.col("tokens") / float(most))
            parts += [F.sum(F.exp(log)).alias(f"z{i}"), F.sum(F.exp(log) * log).alias(f"h{i}")]
        r = sources.agg(*parts).first() if new else None
        for i, a in enumerate(new):
            z, h = r[f"z{i}"], r[f"h{i}"]
            # w / tokens is largest for the smallest source if a < 1 and for the largest one if a > 1.
            largest = max(1.0 / (z * most), math.exp(a * math.log(least / most)) / (z * least))
            known[a] = (math.log(z) - h / z, budget * largest)

    def bisect(low: float, high: float, above) -> float:
        """Where above() turns from true to false between low and high."""
        while high - low > 1 / FINE:
            step = (high - low) / (1 << HALVINGS)
            tried = [low + step * i for i in range(1, 1 << HALVINGS)]
            measure(tried)
            for a in tried:
                if above(*known[a]):
                    low = a
                else:
                    high = a
                    break
        return (low + high) / 2

    target = entropy * math.log(n)
    measure([0.0, 1.0, STEEPEST])
    if not known[STEEPEST][0] <= target <= known[0.0][0]:
        return 1.0
    a = bisect(0.0, STEEPEST, lambda h, _: h > target)
    measure([a])
    if known[a][1] > repeats and known[1.0][1] <= repeats:
        a = bisect(a, 1.0, lambda _, r: r > repeats) if a < 1 else bisect(1.0, a, lambda _, r: r <= repeats)
    elif known[a][1] > repeats:
        a = 1.0
    return a


def _digit(level: int) -> Column:
    return F.shiftrightunsigned("hash", 64 - BITS * (level + 1)).bitwiseAND(F.lit((1 << BITS) - 1))


def _key(level: int) -> Column:
    """The permuted place of a block in its source's last epoch."""
    return F.xxhash64(F.lit(SEED + 1 + level), "source", _digit(level))


def _keyed(docs: DataFrame) -> DataFrame:
    """row (all columns), doc_id, source, tokens, hash."""
    known = docs.select(F.struct("*").alias("row"), "doc_id", F.coalesce(F.col("source"), F.lit("\0")).alias("source"), tokens(F.col("text")).alias("tokens"))
    return known.withColumn("hash", F.xxhash64(F.lit(SEED), "doc_id", "source", "tokens"))


def plan(spark: SparkSession, docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None) -> DataFrame:
    """One row for each source with tokens: source, tokens, weight, budget, epochs, and where its last epoch ends.

    docs needs doc_id, text and source. budget is the number of tokens of the mixture, by default that of docs. A
    source's part of it is whole epochs, in each of which all its documents come once, and a part of one more: blocks of
    documents in a permuted order, cut in the last block by the documents' hashes. A null source is a source of
    its own. An empty table gives an empty plan.
    """
    scratch = Scratch(spark)
    hashed = scratch.write(_keyed(docs.select("doc_id", "text", "source")).drop("row"))
    sources = scratch.write(hashed.groupBy("source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0"))
    total, most = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.max("tokens"), F.lit(1))).first()
    budget = float(total) if budget is None else float(budget)
    a = exponent(sources, budget, entropy, repeats)
    powered = F.exp(F.lit(a) * F.log(F.col("tokens") / float(most)))
    weight = powered / float(sources.agg(F.sum(powered)).first()[0] or 1.0)
    share = F.round(weight * budget).cast("long")
    sources = sources.select("source", "tokens", F.round(weight, 9).alias("weight"), share.alias("budget"))
    sources = scratch.write(sources.select("*", F.floor(F.col("budget") / F.col("tokens")).alias("epochs"), (F.col("budget") % F.col("tokens")).alias("left")))

    # The block in which the last epoch ends, level by level. A level sums at most 2^BITS blocks of each source.
    ends = sources.select("source", "left")
    rows = hashed.where("tokens > 0").join(ends.select("source"), "source")
    cuts: list[DataFrame] = []
    for level in range(LEVELS):
        sums = rows.groupBy("source", _key(level).alias("k")).agg(F.sum("tokens").alias("t"))
        upto = F.sum("t").over(Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
        placed = sums.withColumn("before", F.coalesce(upto, F.lit(0))).join(ends, "source").where("before <= left")
        cut = placed.groupBy("source").agg(F.max(F.struct("k", "before")).alias("c"))
        cut = scratch.write(cut.select("source", F.col("c.k").alias(f"cut{level}"), F.col("c.before").alias("before")))
        cuts.append(cut.select("source", f"cut{level}"))
        ends = scratch.write(ends.join(cut, "source").select("source", (F.col("left") - F.col("before")).alias("left")))
        rows = rows.join(cuts[-1], "source").where(_key(level) == F.col(f"cut{level}")).drop(f"cut{level}")
    # In the last block documents follow their hashes; as many come as fit.
    order = Window.partitionBy("source").orderBy("hash", "doc_id")
    fits = rows.groupBy("source", "hash", "doc_id").agg(F.sum("tokens").alias("t")).withColumn("upto", F.sum("t").over(order)).join(ends, "source").where("upto <= left")
    last = scratch.write(fits.groupBy("source").agg(F.max(F.struct("hash", "doc_id")).alias("last")))

    for cut in [*cuts, last]:
        sources = sources.join(cut, "source", "left")
    return scratch.write(sources.drop("left"))


def with_copies(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """keyed with the number of times that each row comes.

    Documents without words cost no tokens and come in every whole epoch, once at least; sources without tokens come once. Rows
    that are equal in doc_id, source and tokens share their fate. The plan has a row for each source: Spark broadcasts it
    if it is small, and the texts are then not shuffled.
    """
    ends = ["epochs", *(f"cut{level}" for level in range(LEVELS)), "last"]
    inside = F.struct("hash", "doc_id") <= F.col("last")
    for level in reversed(range(LEVELS)):
        inside = (_key(level) < F.col(f"cut{level}")) | ((_key(level) == F.col(f"cut{level}")) & F.coalesce(inside, F.lit(False)))
    copies = F.when(F.col("epochs").isNull(), 1).when(F.col("tokens") == 0, F.greatest("epochs", F.lit(1))).otherwise(F.col("epochs") + F.coalesce(inside, F.lit(False)).cast("int"))
    return keyed.join(plan.select("source", *ends), "source", "left").withColumn("copies", copies.cast("int")).drop(*ends)


def _dealt(keyed: DataFrame, plan_: DataFrame) -> DataFrame:
    """keyed with a row for each time that a document comes, and the epoch, block and place in whose order they are read.

    A block is permuted as one in each epoch: blocks of sources mix, and a document's copies are epochs apart.
    """
    dealt = with_copies(keyed, plan_).where("copies > 0")
    each = dealt.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    block = F.xxhash64(F.lit(SEED), "epoch", F.shiftrightunsigned("hash", 64 - BITS))
    return each.withColumns({"block": block, "place": F.xxhash64(F.lit(SEED), "epoch", "hash")})


def schedule(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """One row for each time a document comes: doc_id, source, tokens, epoch, block, place.

    docs needs doc_id, text and source; other columns are not read. Reading in the order of epoch, block and place visits
    the blocks in an order that differs between epochs. Null and empty texts have no tokens and come in every whole epoch, once
    at least; a null source is a source; a null doc_id is an id like others; rows that repeat an id, source and number of tokens come as
    often each; an empty table gives no rows.
    """
    dealt = _dealt(_keyed(docs.select("doc_id", "text", "source")).drop("row"), plan(spark, docs, **how))
    return dealt.select("doc_id", F.when(F.col("source") != "\0", F.col("source")).alias("source"), "tokens", "epoch", "block", "place")


def mixed(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """docs as the mixture has it: each row as often as schedule() says, all columns kept, in the order of epoch, block and place.

    Rows are dealt to partitions by ranges of that order and sorted, so written files keep it. The cases are those of
    schedule(); docs may have columns of any names.
    """
    dealt = _dealt(_keyed(docs), plan(spark, docs, **how))
    order = ("epoch", "block", "place", "doc_id")
    return dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("row.*")
