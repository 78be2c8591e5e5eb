"""SimHash fingerprints, and groups of fingerprints within a few bits of each other.

Links come from an index in Gray order. Distinct fingerprints are sorted by Gray rank and dealt
out in ranges of equal size, so neighbours share many bits. A range is a node: the bits that
all its fingerprints share, and their values. Nodes are factored again into upper nodes, and
the fingerprints of a range into lower ones. A search goes down from the top, adds up the bits
in which it differs from the shared ones, and leaves a whole group as soon as there are too many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from fieldbeat.functions.joins import split_join
from fieldbeat.llm.graph import stars
from fieldbeat.llm.shared import in_batches, raw, replaced, slices, stage, with_fields

#: Fingerprints of a range, and the number of ranges, which bounds the index that is broadcast
#: to two long numbers for each of 65,536 ranges.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 4096, 128, 1 << 16
#: Children of a node.
FAN = 16
SEED = 42


def fingerprint(text: bytes, words: int) -> int:
    """The signed 64-bit fingerprint of one text.

    A-Z in lower case, words between ASCII white space, shingles of ``words`` words, repeats
    included; fewer words are one shingle, no words give zero.
    """
    found = text.lower().split()
    if not found:
        return 0
    shingles = zip(*(found[i:] for i in range(words))) if len(found) >= words else [found]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(b" ".join(s), SEED) for s in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        part = hashes[start : start + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, column: str = "text", words: int = 3,
                 to: str = "fingerprint") -> DataFrame:
    """Adds each whole text's fingerprint as ``to`` (an existing column is replaced).

    Null and empty texts, and texts of white space, have fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                found = [fingerprint(t, words) for t in raw(part, column)]
                yield replaced(part, **{to: pa.array(found, pa.int64())})

    return in_batches(df, run, with_fields(df.schema, StructField(to, LongType())))


def groups(df: DataFrame, order: str, bits: int, column: str = "fingerprint") -> DataFrame:
    """(fingerprint, lowest): for each distinct fingerprint the lowest ``order`` value in its group.

    Fingerprints that differ in ``bits`` bits or fewer are linked; a group is all that can be
    reached by links. Null fingerprints are left out, null order values lose to any other.
    """
    own = stage(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("fingerprint"))
                .agg(F.min(order).alias("lowest")))
    star = stars(links(own.select("fingerprint"), bits))
    members = stage(star.unionByName(star.select(F.col("root").alias("node"), "root").distinct()))
    of_group = (
        members.join(own, members["node"] == own["fingerprint"])
        .groupBy("root").agg(F.min("lowest").alias("group_lowest"))
    )
    grouped = split_join(members, of_group, "root").select(
        F.col("node").alias("fingerprint"), "group_lowest")
    return own.join(grouped, "fingerprint", "left").select(
        "fingerprint", F.coalesce("group_lowest", "lowest").alias("lowest"))


def links(distinct: DataFrame, bits: int) -> DataFrame:
    """(a, b): links that connect what all pairs within ``bits`` bits connect.

    Of the links inside one node only a spanning forest is returned.
    """
    n = distinct.count()
    ranges = min(MOST_RANGES, max(LEAST_RANGES, -(-n // RANGE_ROWS)))
    placed = stage(
        distinct.select("fingerprint", gray_rank(F.col("fingerprint")).alias("rank"))
        .repartitionByRange(ranges, "rank").sortWithinPartitions("rank")
        .select("fingerprint", F.spark_partition_id().alias("node"))
    )
    # One row a range: at most MOST_RANGES.
    nodes = (
        placed.groupBy("node").agg(F.bit_and("fingerprint").alias("all"),
                                   F.bit_or("fingerprint").alias("any"))
        .orderBy("node").collect()
    )
    top = placed.sparkSession.sparkContext.broadcast(
        tuple(np.array([r[i] for r in nodes], np.int64) for i in range(3)))
    visits = in_batches(placed, lambda b: _visits(b, top.value, bits),
                        "node int, own boolean, fingerprint long")
    dealt = visits.repartition("node").sortWithinPartitions("node", F.desc("own"))
    return in_batches(dealt, lambda b: _search(b, bits), "a long, b long")


def gray_rank(value: Column) -> Column:
    """Position in Gray order of a 64-bit pattern, as a long that sorts the same way."""
    for shift in (1, 2, 4, 8, 16, 32):
        value = value.bitwiseXOR(F.shiftrightunsigned(value, shift))
    return value.bitwiseXOR(F.lit(-(1 << 63)))


class Index:
    """Nodes in Gray order with their upper nodes, from the bits set in all and in any of each."""

    def __init__(self, in_all: np.ndarray, in_any: np.ndarray):
        self.levels = [(in_all.view(np.uint64), in_any.view(np.uint64))]
        while len(self.levels[-1][0]) > FAN:
            both, either = self.levels[-1]
            starts = np.arange(0, len(both), FAN)
            self.levels.append((np.bitwise_and.reduceat(both, starts),
                                np.bitwise_or.reduceat(either, starts)))

    def near(self, wanted: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into wanted, node) for nodes whose shared bits differ in at most ``bits``."""
        wanted = wanted.view(np.uint64)
        width = len(self.levels[-1][0])
        q = np.repeat(np.arange(len(wanted)), width)
        node = np.tile(np.arange(width), len(wanted))
        for level in range(len(self.levels) - 1, -1, -1):
            both, either = self.levels[level]
            shared = ~(both ^ either)
            close = np.bitwise_count((wanted[q] ^ both[node]) & shared[node]) <= bits
            q, node = q[close], node[close]
            if level:
                q = np.repeat(q, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                inside = node < len(self.levels[level - 1][0])
                q, node = q[inside], node[inside]
        return q, node


def _numpy(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _visits(batches: Iterator[pa.RecordBatch], top: tuple, bits: int) -> Iterator[pa.RecordBatch]:
    """Every fingerprint at its own range, and at each later range that may hold a near one."""
    ids, both, either = top
    index = Index(both, either) if len(ids) else None
    for batch in batches:
        prints, own = _numpy(batch, "fingerprint"), _numpy(batch, "node")
        for start in range(0, len(prints), 2048):
            part, home = prints[start : start + 2048], own[start : start + 2048]
            q, at = index.near(part, bits)
            later = ids[at] >= home[q]
            q, at = q[later], ids[at[later]].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(at == home[q]), pa.array(part[q])],
                ["node", "own", "fingerprint"])


class _Range:
    """The fingerprints of one range, and which of them are known to be connected."""

    def __init__(self, members: np.ndarray):
        order = np.argsort(_rank(members))
        self.members = members[order]
        self.index = Index(self.members, self.members)
        self.parent = list(range(len(members)))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def connect(self, pairs: np.ndarray) -> None:
        for a, b in np.unique(pairs, axis=0).tolist():
            self.parent[self.find(a)] = self.find(b)

    def inner(self, bits: int) -> None:
        for start in range(0, len(self.members), 512):
            q, at = self.index.near(self.members[start : start + 512], bits)
            q = q + start
            self.connect(np.stack([q, at], axis=1)[q < at])

    def outer(self, wanted: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Each wanted fingerprint with its first near member; its further ones are connected."""
        q, at = self.index.near(wanted, bits)
        order = np.lexsort((at, q))
        q, at = q[order], at[order]
        first = np.ones(len(q), bool)
        first[1:] = q[1:] != q[:-1]
        head = at[first][np.cumsum(first) - 1] if len(q) else at
        self.connect(np.stack([head, at], axis=1)[~first])
        return wanted[q[first]], self.members[at[first]]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        root = np.array([self.find(i) for i in range(len(self.members))], np.int64)
        linked = root != np.arange(len(root))
        return self.members[linked], self.members[root[linked]]


def _rank(prints: np.ndarray) -> np.ndarray:
    rank = prints.view(np.uint64).copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _search(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows come by node, its own fingerprints first: only those are held in memory."""

    def edges(pair: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

    def built() -> _Range:
        made = _Range(np.concatenate(own))
        made.inner(bits)
        return made

    current, own, held = None, [], None
    for batch in batches:
        nodes, mine, prints = (_numpy(batch, n) for n in ("node", "own", "fingerprint"))
        change = np.flatnonzero((nodes[1:] != nodes[:-1]) | (mine[1:] != mine[:-1])) + 1
        for start, end in zip([0, *change], [*change, len(nodes)], strict=True):
            if start == end:
                continue
            if nodes[start] != current:
                if own:
                    yield edges((held or built()).forest())
                current, own, held = nodes[start], [], None
            if mine[start]:
                own.append(prints[start:end])
            elif own:
                held = held or built()
                for at in range(start, end, 512):
                    yield edges(held.outer(prints[at : min(end, at + 512)], bits))
    if own:
        yield edges((held or built()).forest())
