"""Substring dedup: suffix automata of reference shards, against which documents are streamed.

The whole corpus is its own reference, and its size has no bound, so automata of all of it cannot be broadcast.
Shards of the reference are made instead so that all that can match lies in one of them: two documents that share
SPAN words share one of the fingerprints that either text selects, and each fingerprint belongs to the shard of the
first document that has it. Only words near shared fingerprints go there. A shard's documents are streamed
against its automaton in the order of their ids, and what an automaton has not seen yet is then added to it.

A passage that a large part of the corpus has makes a shard that no automaton can hold. Its runs are cut into their
windows of SPAN words instead, whose 128-bit hashes find each window's first document by a partial aggregation: the work
is in proportion to the words of the shard, and no task holds more than its rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: Words of a span that counts as repeated, and of a fingerprint.
SPAN, GRAM = 50, 20
#: Words that one automaton takes; the windows of larger shards are compared by their hashes.
SHARD_WORDS = 50_000
BATCH = 256


def words(text: str | None) -> list[bytes]:
    """Runs of other than ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def fingerprints(tokens: list[bytes], span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the selected grams: the least hash, leftmost, of each run of span words."""
    n = len(tokens)
    if n < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, n)
    h, width = one, 1
    # A gram's hash is built from those of its halves.
    parts, at = [], 0
    while width <= gram:
        if gram & width:
            parts.append((h, at))
            at += width
        if 2 * width <= gram:
            h = _mix(h[: n - 2 * width + 1] * np.uint64(0x9E3779B97F4A7C15) + h[width:])
        width *= 2
    m = n - gram + 1
    grams = np.zeros(m, np.uint64)
    for part, at in parts:
        grams = _mix(grams * np.uint64(0xC2B2AE3D27D4EB4F) + part[at : at + m])
    views = np.lib.stride_tricks.sliding_window_view(grams, span - gram + 1)
    places = np.concatenate([np.argmin(views[i : i + 4096], axis=1) + np.arange(i, min(i + 4096, len(views))) for i in range(0, len(views), 4096)])
    places = np.unique(places)
    return grams[places], places


class Automaton:
    """A suffix automaton of several word sequences; each state knows who owns its first end."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [-1]

    def _clone(self, p: int, q: int, word: bytes) -> int:
        """A state of q's strings that are no longer than those that p and word make."""
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.owner.append(self.owner[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = new
            p = self.link[p]
        return new

    def add(self, tokens: list[bytes], owner: int) -> None:
        """A sequence. Strings that the automaton has keep their owner."""
        p = 0
        for word in tokens:
            q = self.next[p].get(word)
            if q is not None:
                p = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word)
                continue
            new = len(self.next)
            self.next.append({})
            self.length.append(self.length[p] + 1)
            self.owner.append(owner)
            self.link.append(0)
            while p >= 0 and (q := self.next[p].get(word)) is None:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word)
            p = new

    def matches(self, tokens: list[bytes], span: int, before: int) -> list[tuple[int, int]]:
        """The maximal spans [from, to) covered by runs of span words that an owner under before has."""
        next_, link, length, owner = self.next, self.link, self.length, self.owner
        found: list[tuple[int, int]] = []
        state = size = 0
        for i, word in enumerate(tokens, 1):
            q = next_[state].get(word)
            while q is None and state:
                state = link[state]
                size = length[state]
                q = next_[state].get(word)
            if q is None:
                size = 0
                continue
            state, size = q, size + 1
            if size >= span:
                s = state
                while length[link[s]] >= span:
                    s = link[s]
                if owner[s] < before:
                    if found and i - span <= found[-1][1]:
                        found[-1] = (found[-1][0], i)
                    else:
                        found.append((i - span, i))
        return found


def _fresh(n: int, seen: list[tuple[int, int]], span: int) -> list[tuple[int, int]]:
    """The parts of n words with the runs of span words that aren't inside of seen spans."""
    out, at = [], 0
    for a, b in seen:
        if a > at:
            out.append((max(0, at - span + 1) if at else 0, min(n, a + span - 1)))
        at = b
    if at < n:
        out.append((max(0, at - span + 1) if at else 0, n))
    return [(a, b) for a, b in out if b - a >= span]


PRINTS = "fp long, doc_id long"
PLACES = "fp long, doc_id long, at int"
RUNS = "shard long, doc_id long, start int, n int, run binary"
FOUND = "doc_id long, start int, stop int"
WINDOWS = "h1 long, h2 long, doc_id long, at int"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _rows(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = _arrow(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)], schema=schema)


def _places(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                some = batch.slice(lo, BATCH)
                prints, ids, at = [], [], []
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    h, p = fingerprints(words(text), span, gram)
                    prints.append(h.view(np.int64))
                    ids.append(np.full(len(h), doc_id, np.int64))
                    at.append(p.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (prints, ids, at)], schema=_arrow(PLACES))

    return run


def _runs(span: int, gram: int):
    reach = span - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                some, rows = batch.slice(lo, BATCH), []
                for doc_id, text, shared in zip(*(some.column(i).to_pylist() for i in range(3)), strict=True):
                    tokens = words(text)
                    # Neighbouring fingerprints of one shard make one run.
                    for shard, own in itertools.groupby(sorted((x["shard"], x["at"]) for x in shared), key=lambda x: x[0]):
                        start = stop = -1
                        for _, at in [*own, (shard, 1 << 40)]:
                            a, b = max(0, at - reach), min(len(tokens), at + span)
                            if start >= 0 and a <= stop - span + 1:
                                stop = b
                                continue
                            if start >= 0:
                                rows.append((shard, doc_id, start, stop - start, b" ".join(tokens[start:stop])))
                            start, stop = a, b
                yield _rows(rows, RUNS)

    return run


def _stream(span: int):
    """Streams sorted runs (shard, doc_id, start, run) against the automaton of their shard; returns spans of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, automaton = None, Automaton()
        waiting: list[tuple[int, list[bytes], list[tuple[int, int]]]] = []
        out: list[tuple] = []
        for batch in batches:
            for shard, doc_id, start, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if shard != key:
                    key, automaton, waiting = shard, Automaton(), []
                tokens = text.split(b" ")
                if waiting and waiting[-1][0] != doc_id:
                    # What a document brings is added once all of it has been streamed.
                    for owner, own, seen in waiting:
                        for a, b in _fresh(len(own), seen, span):
                            automaton.add(own[a:b], owner)
                    waiting = []
                seen = automaton.matches(tokens, span, doc_id)
                out += ((doc_id, start + a, start + b) for a, b in seen)
                waiting.append((doc_id, tokens, seen))
            if len(out) > 1000:
                yield _rows(out, FOUND)
                out = []
        yield _rows(out, FOUND)

    return run


def window_hashes(runs: list[list[bytes]], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each window of span words inside a run: two independent 64-bit hashes, the number of its run, its place there."""
    sizes = np.array([len(x) for x in runs])
    flat = [t for x in runs for t in x]
    m = max(0, len(flat) - span + 1)
    run = np.repeat(np.arange(len(runs)), sizes)[:m]
    place = np.arange(m) - np.repeat(np.cumsum(sizes) - sizes, sizes)[:m]
    inside = place + span <= sizes[run]
    hashes = []
    for seed in (0, 1):
        one = np.fromiter((xxhash.xxh3_64_intdigest(t, seed) for t in flat), np.uint64, len(flat))
        h = np.zeros(m, np.uint64)
        for i in range(span):
            h = _mix((h ^ one[i : i + m]) * np.uint64(0x9E3779B97F4A7C15))
        hashes.append(h[inside].view(np.int64))
    return hashes[0], hashes[1], run[inside], place[inside]


def _windows(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                ids, starts, texts = batch.slice(lo, BATCH).columns
                h1, h2, own, place = window_hashes([x.split(b" ") for x in texts.to_pylist()], span)
                columns = (h1, h2, ids.to_numpy()[own], (starts.to_numpy()[own] + place).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=_arrow(WINDOWS))

    return run


def repeated_spans(spark: SparkSession, docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, spans): the word ranges {a, b} of each document that are to go, sorted; they may overlap.

    A word goes if a run of span words covers it whose sequence also starts in a document of a smaller doc_id.
    """
    scratch = Scratch(spark)
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    places = scratch.write(docs.mapInArrow(_places(span, gram), PLACES))
    # A fingerprint of two documents or more belongs to its first document's shard. It is a table, so that Spark can split a
    # frequent fingerprint's places in the join, which it can't where the same shuffle also feeds an aggregation.
    shared = scratch.write(places.groupBy("fp").agg(F.min("doc_id").alias("shard"), F.max("doc_id").alias("last")).where("shard < last").select("fp", "shard"))
    own = places.join(shared, "fp").groupBy("doc_id").agg(F.collect_list(F.struct("shard", "at")).alias("shared"))
    runs = scratch.write(docs.join(own, "doc_id").select("doc_id", "text", "shared").mapInArrow(_runs(span, gram), RUNS))
    scratch.drop(places)
    scratch.drop(shared)
    large = scratch.write(runs.groupBy("shard").agg(F.sum("n").alias("words")).where(F.col("words") > SHARD_WORDS).select("shard"))
    small = runs.join(large, "shard", "left_anti").select("shard", "doc_id", "start", "run")
    removed = small.repartition("shard").sortWithinPartitions("shard", "doc_id", "start").mapInArrow(_stream(span), FOUND)
    # The windows of large shards: their first documents are a table too, for the same reason as above.
    windows = scratch.write(runs.join(large, "shard").select("doc_id", "start", "run").mapInArrow(_windows(span), WINDOWS))
    first = scratch.write(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h1", "h2", "first"))
    later = windows.join(first, ["h1", "h2"]).where("doc_id > first").groupBy("doc_id").agg(F.array_distinct(F.collect_list("at")).alias("at"))
    # Windows that meet make one span, from a first to a last start.
    at, gap = F.sort_array("at"), F.lit(span)
    later = later.select("doc_id", at.alias("at"))
    heads = F.filter("at", lambda x, i: (i == 0) | (x > F.get("at", i - 1) + gap))
    tails = F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1) > x + gap))
    spans = F.explode(F.zip_with(heads, tails, lambda x, y: F.struct(x.alias("start"), (y + gap).cast("int").alias("stop"))))
    later = later.select("doc_id", spans.alias("s")).select("doc_id", "s.*")
    return removed.unionByName(later).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))


def _cut(text: str | None, spans: list[dict] | None) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    tokens = words(text)
    if not spans:
        return tokens, len(tokens)
    keep, at = [], 0
    for x in spans:
        if x["start"] > at:
            keep += tokens[at : x["start"]]
        at = max(at, x["stop"])
    return keep + tokens[at:], len(tokens)


def digest(spark: SparkSession, docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256.

    docs needs doc_id and text; other columns are not read. Null and empty texts have no words and lose none.
    A null doc_id is not smaller or larger than another: its text stays and removes nothing. Rows that repeat a doc_id are
    one document whose spans all hold for each of them. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keep, n = _cut(text, spans)
                rows.append((doc_id, n, n - len(keep), hashlib.sha256(b" ".join(keep)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    spans = repeated_spans(spark, docs, span, gram)
    return docs.select("doc_id", "text").join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(spark: SparkSession, docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """docs with its texts cut, all columns kept. What stands between the words that stay stays as it was.

    The cases are those of digest(). A document that loses all its words stays, with an empty text.
    """
    pattern = "[^\\x20\\x09-\\x0D]+"

    @F.pandas_udf("string")
    def cut(texts, spans):
        import re

        import pandas as pd

        out = []
        for text, own in zip(texts, spans, strict=True):
            if own is None or len(own) == 0:
                out.append(text)
                continue
            at = [m.span() for m in re.finditer(pattern, text)]
            keep, last = [], 0
            for x in own:
                a, b = max(last, x["start"]), x["stop"]
                if a < b:
                    keep.append(text[at[last][0] if last else 0 : at[a][0]])
                    last = b
            keep.append(text[at[last][0] :] if last < len(at) else "")
            out.append("".join(keep))
        return pd.Series(out, dtype=object)

    # Rows stand as one column, so that no name of theirs can clash.
    own = docs.select("doc_id", "text", F.struct("*").alias("row"))
    joined = own.join(repeated_spans(spark, docs, span, gram), "doc_id", "left")
    text = F.when(F.col("spans").isNotNull(), cut("text", "spans")).otherwise(F.col("text"))
    return joined.select("row", text.alias("text")).select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
