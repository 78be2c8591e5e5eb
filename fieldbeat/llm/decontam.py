"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a run of five words (a seed) become pairs. In a pair,
the longest matches that do not overlap are marked again and again, found by running
Karp-Rabin hashes, until none of five words is left. A document is contaminated if the marked
words cover enough of an item, in whatever order its passages come.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField

from fieldbeat.functions.joins import split_join
from fieldbeat.llm.shared import (
    in_batches,
    lists,
    pack,
    replaced,
    slices,
    stage,
    texts,
    unpack,
    with_fields,
)

#: Words of a seed and of the shortest match; an item of fewer words must occur as a whole.
LEAST_WORDS = 5
#: Part of an item's words that a document must cover.
COVERAGE = 0.8
#: Bits of the filter that documents' seeds pass first: 2 MB, whatever the benchmark's size.
FILTER_BITS = 24
#: Distinct words a task remembers.
REMEMBERED = 100_000

WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters and digits in lower case."""
    return WORD.findall(text.lower())


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = value
        return value


def hashed(words: Sequence[str], known: _Hashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def grams(each: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` words, from the words' own hashes."""
    n = max(0, len(each) - size + 1)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = (total ^ each[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(32)
    return total


def tiles(item: Sequence[str], text: Sequence[str | None], least: int) -> list[tuple[int, int, int]]:
    """(length, start in item, start in text) of the tiles, longest first.

    ``None`` in the text matches nothing. Of equally long matches the one that is first in the
    item, then in the text, is taken.
    """
    free_item, free_text = [True] * len(item), [w is not None for w in text]
    found, size = [], min(len(item), len(text))
    while size >= least:
        waiting = [(-n, i, j) for n, i, j in _matches(item, text, free_item, free_text, size)]
        heapify(waiting)
        while waiting:
            n, i, j = heappop(waiting)
            start = 0
            parts = []
            for k in range(-n):
                if not (free_item[i + k] and free_text[j + k]):
                    parts.append((start, k))
                    start = k + 1
            if not parts:
                found.append((-n, i, j))
                free_item[i : i - n] = free_text[j : j - n] = [False] * -n
                continue
            for a, b in [*parts, (start, -n)]:  # what earlier tiles have left of the match
                if b - a >= size:
                    heappush(waiting, (a - b, i + a, j + a))
        size = max(size // 2, least) if size > least else 0
    return found


def _running(values: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(start, hash) of every stretch of ``size`` free words, each hash from the one before."""
    base, mod = 1_000_003, (1 << 61) - 1
    out, total, length = pow(base, size - 1, mod), 0, 0
    for end, value in enumerate(values):
        if not free[end]:
            total = length = 0
            continue
        if length == size:
            total = (total - values[end - size] * out) % mod
        else:
            length += 1
        total = (total * base + value) % mod
        if length == size:
            yield end - size + 1, total


def _matches(item, text, free_item, free_text, size) -> Iterator[tuple[int, int, int]]:
    """Matches of at least ``size`` free words that cannot be made longer at either end."""
    at, known = defaultdict(list), _Hashes()
    for i, h in _running([known[w] for w in item], free_item, size):
        at[h].append(i)
    for j, h in _running([known[w] if w is not None else 0 for w in text], free_text, size):
        for i in at.get(h, ()):
            if i and j and free_item[i - 1] and free_text[j - 1] and item[i - 1] == text[j - 1]:
                continue  # part of the match that starts earlier
            n = 0
            while (i + n < len(item) and j + n < len(text) and free_item[i + n]
                   and free_text[j + n] and item[i + n] == text[j + n]):
                n += 1
            if n >= size:  # else the hashes were equal by chance
                yield n, i, j


def coverage(item: Sequence[str], text: Sequence[str | None]) -> float:
    """Part of the item's words that lie in tiles; 0 for an item without words."""
    if not item:
        return 0.0
    return sum(t[0] for t in tiles(item, text, min(LEAST_WORDS, len(item)))) / len(item)


def read_items(benchmark: DataFrame, key: str = "item_id", column: str = "text") -> DataFrame:
    """(item, key, words, seeds): benchmark rows numbered, with their words and seed hashes.

    Rows whose text is null or has no word can match nothing and are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_seen = _Hashes()
        for batch in batches:
            words = [words_of(t) for t in texts(batch, "text")]
            found = [grams(hashed(w, words_seen), min(LEAST_WORDS, len(w))) if w else np.empty(0, np.uint64)
                     for w in words]
            yield replaced(batch, words=pa.array(words, pa.list_(pa.string())),
                           seeds=lists(np.concatenate(found).view(np.int64),
                                       [len(f) for f in found], pa.int64()))

    rows = benchmark.select(F.col(key).alias("key"), F.col(column).alias("text"))
    fields = StructField("words", ArrayType(StringType())), StructField("seeds", ArrayType(LongType()))
    read = in_batches(rows, run, with_fields(rows.schema, *fields))
    return stage(read.where("size(words) > 0").select(
        F.monotonically_increasing_id().alias("item"), "key", "words", "seeds"))


def find_seeds(docs: DataFrame, items: DataFrame, column: str = "text") -> DataFrame:
    """Adds ``seeds`` (hashes of runs of words that may occur in an item) and ``runs`` (the
    stretches of words they cover). Existing columns of these names are replaced; null and
    empty texts have none."""
    bits = (
        items.select(F.explode("seeds").alias("seed"))
        .select(F.shiftrightunsigned("seed", 64 - FILTER_BITS).alias("at"))
        .groupBy(F.shiftright("at", 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits")).collect())
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in bits:
        table[r["word"]] = r["bits"]
    sizes = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(LEAST_WORDS))).distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast((table.view(np.uint64), sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lengths = shared.value
        words_seen = _Hashes()
        for batch in batches:
            for part in slices(batch, column):
                seeds, runs = [], []
                for text in texts(part, column):
                    words = words_of(text)
                    each = hashed(words, words_seen)
                    inside, hits = np.zeros(len(words) + 1, np.int64), []
                    for size in lengths:
                        found = grams(each, size)
                        at = found >> np.uint64(64 - FILTER_BITS)
                        hit = np.flatnonzero(known[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))
                        hits.append(found[hit])
                        np.add.at(inside, hit, 1)
                        np.add.at(inside, hit + size, -1)
                    hits = np.unique(np.concatenate(hits)) if hits else np.empty(0, np.uint64)
                    covered = np.cumsum(inside)[:-1] > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]])))
                    seeds.append(hits.view(np.int64))
                    runs.append([" ".join(words[a:b]) for a, b in edges.reshape(-1, 2)])
                yield replaced(
                    part, seeds=lists(np.concatenate(seeds), [len(s) for s in seeds], pa.int64()),
                    runs=pa.array(runs, pa.list_(pa.string())))

    fields = StructField("seeds", ArrayType(LongType())), StructField("runs", ArrayType(StringType()))
    return in_batches(docs, run, with_fields(docs.schema, *fields))


def matches(seeded: DataFrame, items: DataFrame, row: str) -> DataFrame:
    """(row, key, coverage) for each row of ``seeded`` and item that it covers.

    ``seeded`` is the staged result of ``find_seeds``; ``row`` identifies its rows.
    """
    pairs = (
        split_join(
            seeded.select(F.col(row).alias("row"), F.explode("seeds").alias("seed")),
            items.select("item", F.size("words").alias("n"), F.explode("seeds").alias("seed")),
            "seed")
        .groupBy("row", "item").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
        # A seed covers five words at most: fewer cannot be enough.
        .where(F.col("shared") * LEAST_WORDS >= F.col("n") * COVERAGE)
        .select("row", "item")
    )
    with_words = split_join(pairs, items.select("item", "key", "words"), "item")
    with_runs = split_join(with_words, seeded.select(F.col(row).alias("row"), "runs"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for words, runs in zip(batch.column("words").to_pylist(),
                                   batch.column("runs").to_pylist(), strict=True):
                text: list[str | None] = []
                for r in runs:
                    text += [*r.split(" "), None]
                found.append(coverage(words, text))
            yield replaced(batch.select(["row", "key"]), coverage=pa.array(found, pa.float64()))

    fields = with_runs.select("row", "key").schema
    return in_batches(with_runs, run, with_fields(fields, StructField("coverage", DoubleType()))).where(F.col("coverage") >= COVERAGE)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "item_id",
                 column: str = "text") -> DataFrame:
    """The documents with ``item_ids`` (the items each covers, sorted; empty if none) and
    ``coverage`` (the best one; null if none, so null means clean). Existing columns of these
    names are replaced.

    One row per input row, repeated rows and null ids included. An empty benchmark leaves all
    documents clean. An item whose key is null contaminates like any other, but is not listed.
    """
    kept = [c for c in docs.columns if c not in ("item_ids", "coverage")]
    items = read_items(benchmark, key)
    seeded = stage(
        find_seeds(pack(docs.select(*kept), column), items, column)
        .withColumn("row", F.monotonically_increasing_id()))
    best = matches(seeded, items, "row").groupBy("row").agg(
        F.sort_array(F.collect_set("key")).alias("item_ids"), F.max("coverage").alias("coverage"))
    joined = seeded.drop("seeds", "runs").join(best, "row", "left")
    none = F.array().cast(best.schema["item_ids"].dataType)
    return unpack(joined, kept, F.coalesce("item_ids", none).alias("item_ids"), F.col("coverage"))
