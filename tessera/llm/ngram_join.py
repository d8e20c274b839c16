"""N-gram Jaccard join: MinHash bands propose pairs, full n-gram sets confirm them.

Exact copies are counted first and stand as one. The bands of each distinct text are shuffled by their hashes;
texts that share a bucket are compared in tasks of at most two blocks, each task once for all the bands in which its
members meet, and each pair in one task only. A task returns a count of links for each member and edges that
join its members, never its pairs. As every link of different texts counts, a group of n different near copies takes n^2
comparisons; in blocks of BLOCK, each set is sent n / BLOCK times.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, components

GRAM, THRESHOLD = 5, 0.8
#: The chance with which a pair at the threshold itself shares a band.
RECALL = 0.9995
#: Mean members of a block, and their n-grams in all; larger buckets have several blocks.
BLOCK, BLOCK_GRAMS = 512, 1_000_000


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 63) -> tuple[int, int]:
    """The most rows a band, and as many bands, by which a pair at the threshold is found with that chance."""
    for rows in range(16, 0, -1):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands <= most and bands * rows <= 160:
            return bands, rows
    raise ValueError("no bands for so low a threshold")


def grams(text: str | None, n: int = GRAM) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams of lower-cased words. A text of 1 to n - 1 words is one gram."""
    tokens = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not tokens:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    m = max(1, len(one) - n + 1)
    h = np.zeros(m, np.uint64)
    for i in range(min(n, len(one))):
        h = (h ^ one[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def _constants(k: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = [xxhash.xxh3_64_intdigest(str(i).encode()) for i in range(k)]
    return np.array([s & 0xFFFFFFFF for s in seeds], np.uint32), np.array([s >> 32 | 1 for s in seeds], np.uint32)


def band_hashes(grams_: np.ndarray, bands: int, rows: int, constants: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One 64-bit hash for each band: of the least values of its rows."""
    low = (grams_ ^ (grams_ >> np.uint64(32))).astype(np.uint32)
    x, a = constants
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        v = (low[i : i + 2048, None] ^ x) * a
        v ^= v >> np.uint32(15)
        least = np.minimum(least, (v * np.uint32(0x2C1B3C6D)).min(axis=0))
    out = np.full(bands, 0x9E3779B97F4A7C15, np.uint64) * np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        out = (out ^ least.reshape(bands, rows)[:, r]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def _key(text: str | None) -> bytes:
    """What texts of the same words in the same order share."""
    return xxhash.xxh3_128_digest(b" ".join((text or "").lower().encode("utf-8", "surrogatepass").split()))


def _signatures(gram: int, bands: int, rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    constants = _constants(bands * rows)
    for batch in batches:
        keys, sizes, found = [], [], []
        for text in batch.column(1).to_pylist():
            g = grams(text, gram)
            keys.append(_key(text) if len(g) else None)
            sizes.append(len(g))
            found.append(band_hashes(g, bands, rows, constants) if len(g) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "key", "n_grams", "bands"])


def _sets(gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of rows whose text is the one that key stands for."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        own = batch.filter(pa.array([_key(t) == k for t, k in zip(texts, batch.column("key").to_pylist(), strict=True)], pa.bool_()))
        sets = pa.array([grams(t, gram).tobytes() for t in own.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("rep", "copies", "bands")), sets], names=["rep", "copies", "bands", "grams"])


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each set of a shares with each set of b. Values that only one of the sets has cost no column."""
    values, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in [*a, *b]])
    often = np.bincount(at, minlength=len(values)) > 1
    column = np.cumsum(often) - 1
    keep = often[at]
    at, owner, width = column[at[keep]], owner[keep], int(often.sum())
    out = np.zeros((len(a), len(b)), np.float32)
    by_column = np.argsort(at, kind="stable")
    at, owner = at[by_column], owner[by_column]
    for lo in range(0, width, 8192):
        i, j = np.searchsorted(at, [lo, lo + 8192])
        dense = np.zeros((len(a) + len(b), min(8192, width - lo)), np.float32)
        dense[owner[i:j], at[i:j] - lo] = 1
        out += dense[: len(a)] @ dense[len(a) :].T
    return out


def _compare(threshold: float, rows: list[tuple]) -> list[tuple[int, int, int]]:
    """Of one task: (rep, its links to others here, the least rep that it is joined to here).

    rows: (left, rep, copies, bands, mask, grams). A pair counts in the task of the first band in which it meets.
    """
    left = [r for r in rows if r[0] != 1]
    right = [r for r in rows if r[0] != 0]
    same = all(r[0] == 2 for r in rows)
    sets = [[np.frombuffer(r[5], np.uint64) for r in side] for side in (left, right)]
    common = intersections(*sets)
    sizes = [np.array([len(s) for s in side]) for side in sets]
    links = common >= threshold * (sizes[0][:, None] + sizes[1][None, :] - common) - 1e-6
    bands = [np.array([r[3] for r in side], np.int64) for side in (left, right)]
    reps = [np.array([r[1] for r in side], np.int64) for side in (left, right)]
    links &= reps[0][:, None] < reps[1][None, :] if same else reps[0][:, None] != reps[1][None, :]
    mask = rows[0][4]
    count: dict[int, int] = {}
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in np.argwhere(links).tolist():
        met = np.flatnonzero(bands[0][i] == bands[1][j])
        if not len(met) or not mask >> int(met[0]) & 1:
            continue
        x, y = left[i], right[j]
        count[x[1]] = count.get(x[1], 0) + y[2]
        count[y[1]] = count.get(y[1], 0) + x[2]
        p, q = sorted((root(x[1]), root(y[1])))
        parent[q] = p
    return [(x, n, root(x)) for x, n in count.items()]


def _verify(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, side, rep, copies, bands, mask, grams) sorted by task; rows that repeat a doc_id and its text count once."""
    key, held, seen, out = None, [], set(), []
    for batch in batches:
        for task, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if task != key:
                if len(held) > 1:
                    out += _compare(threshold, held)
                key, held, seen = task, [], set()
            name = (row[0], row[1], hash(row[5]))
            if name not in seen:
                seen.add(name)
                held.append(tuple(row))
        if len(out) > 1000:
            yield _links(out)
            out = []
    if len(held) > 1:
        out += _compare(threshold, held)
    yield _links(out)


def _links(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 3)], names=["rep", "links", "low"])


def classes(spark: SparkSession, docs: DataFrame, gram: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row for each document: doc_id, class_id, n_links.

    docs needs doc_id and text; other columns are not read. Two documents are linked if the Jaccard similarity of
    their sets of n-grams of lower-cased words is at least threshold (a text of fewer words is one n-gram). class_id
    is the smallest doc_id of those joined by links; n_links counts the other documents that are linked to one,
    copies included. Null and empty texts have no n-grams: they are alone, without links. A null doc_id takes no
    part and gets a null class and no links. Rows that repeat a doc_id are counted as copies where their texts agree; where
    they don't, each row has the class of its own text.
    """
    scratch = Scratch(spark)
    bands, rows = bands_and_rows(threshold, recall)
    known = docs.where("doc_id IS NOT NULL")
    signed = scratch.write(known.select("doc_id", "text").mapInArrow(partial(_signatures, gram, bands, rows), "doc_id long, key binary, n_grams int, bands array<long>"))
    texts = scratch.write(signed.where("key IS NOT NULL").groupBy("key", "n_grams", "bands").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))

    # Buckets of two texts or more, dealt to blocks; their members as sorted lists.
    placed = texts.select("rep", "n_grams", F.posexplode("bands").alias("band", "hash"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("grams") / BLOCK_GRAMS)).cast("int")
    often = placed.groupBy("band", "hash").agg(F.count("*").alias("n"), F.sum("n_grams").alias("grams")).where("n > 1").select("band", "hash", blocks.alias("blocks"))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    members = placed.join(often, ["band", "hash"]).groupBy("band", "hash", "blocks", block.alias("block")).agg(F.sort_array(F.collect_list("rep")).alias("reps"))
    # Each two blocks of a bucket meet: a block goes to the tasks of its row and column.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = members.withColumn("other", other).select("band", "hash", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "reps")
    met = dealt.groupBy("band", "hash", "i", "j").agg(F.max(F.when(F.col("block") == F.col("i"), F.col("reps"))).alias("left"), F.max(F.when(F.col("block") == F.col("j"), F.col("reps"))).alias("right"))
    met = met.where("left IS NOT NULL AND right IS NOT NULL AND (i < j OR size(left) > 1)")
    tasks = met.groupBy("left", "right").agg(F.bit_or(F.expr("shiftleft(1L, band)")).alias("mask"))
    # side: 0 of the left block, 1 of the right one, 2 of a block that meets itself.
    sides = F.when(F.col("left") == F.col("right"), F.transform("left", lambda r: F.struct(F.lit(2).alias("side"), r.alias("rep")))).otherwise(F.concat(F.transform("left", lambda r: F.struct(F.lit(0).alias("side"), r.alias("rep"))), F.transform("right", lambda r: F.struct(F.lit(1).alias("side"), r.alias("rep")))))
    task = F.struct(F.xxhash64("left", "right"), F.xxhash64("right", F.lit(1), "left"))
    asked = scratch.write(tasks.select(task.alias("task"), "mask", F.explode(sides).alias("m")).select(F.expr("concat(hex(task.col1), hex(task.col2))").alias("task"), "mask", "m.side", "m.rep"))

    wanted = texts.join(asked.select("rep").distinct(), "rep").select("rep", "key", "copies", "bands")
    sets = known.select(F.col("doc_id").alias("rep"), "text").join(wanted, "rep").mapInArrow(partial(_sets, gram), "rep long, copies long, bands array<long>, grams binary")
    rows_ = asked.join(sets, "rep").select("task", "side", "rep", "copies", "bands", "mask", "grams")
    found = scratch.write(rows_.repartition("task").sortWithinPartitions("task").mapInArrow(partial(_verify, threshold), "rep long, links long, low long"))

    roots = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")), scratch)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    by_key = texts.join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    by_key = by_key.select("key", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.select("doc_id", "key").join(by_key, "key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out.unionByName(docs.where("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each class, that of the smallest doc_id; of rows that repeat it and its text, the first by a hash of all columns.

    All columns stay, whatever their names, and so do all rows of a null doc_id. Where rows of one doc_id differ in text, each of
    the texts stays if that doc_id is the smallest of a class. An empty table stays empty.
    """
    scratch = Scratch(spark)
    each = classes(spark, docs).groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.col("class_id") == F.col("doc_id")).alias("first"))
    kept = scratch.write(each.where("first").select("doc_id", "rows"))
    # The whole row is dealt out once, with its text once; ids of several rows are a table of their own, mostly an empty one.
    rows = docs.select("doc_id", F.struct("*").alias("row"))
    out = rows.join(kept.where(F.col("rows") == 1), "doc_id", "left_semi").select("row")
    again = scratch.write(kept.where(F.col("rows") > 1).select("doc_id"))
    if not again.isEmpty():
        # A smaller hash goes first, and rows of equal hashes are as good as equal.
        several = rows.join(again, "doc_id", "left_semi").groupBy("doc_id", F.col("row")["text"].alias("text"))
        out = out.unionByName(several.agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row"))
    return out.select("row.*").unionByName(docs.where("doc_id IS NULL"))
