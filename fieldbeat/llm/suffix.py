"""Removal of long repeats by a hash-compared suffix sort.

Every string of ``length`` bytes that occurs twice has the same anchor at the same place in both:
the first of the lowest hashes of its ``seed`` bytes. So only suffixes that start at anchors are
sorted, and only those whose anchor occurs again. What surrounds an anchor, as far as a string
with this anchor reaches, is its context. Contexts that occur twice are repeats as a whole.
The others are sorted twice, by what follows the anchor and by what comes before it. Neighbours'
common extensions to both sides, found by binary search over polynomial prefix hashes and then
verified on the bytes, tell which strings around the anchor both have. What neighbours leave
open, which only happens where neither has both the longest extensions, is compared with the
seed's commonest context, and after that settled by looking for those single strings in the
seed's other contexts; which of these are equal is told by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField

from fieldbeat.llm.shared import (
    discard,
    in_batches,
    pack,
    raw,
    slices,
    stage,
    unpack,
    with_fields,
)

#: Bytes a task hashes at once.
HASHED_BYTES = 1 << 20
#: Contexts of a seed that a task compares with its open strings, and how many of these it knows by
#: hash; both bound its memory, not the result.
PART, MOST_OPEN = 4096, 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Sizes(NamedTuple):
    """Bytes of a repeat, and of the seed that its anchor starts."""

    length: int
    seed: int

    @property
    def reach(self) -> int:
        """How far a string may start before its anchor."""
        return self.length - self.seed


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefixes(values: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes along the last axis, the empty one first."""
    terms = (values.astype(np.uint64) + np.uint64(1)) * _powers(BASE, values.shape[-1])
    sums = np.cumsum(terms, axis=-1, dtype=np.uint64)
    return np.concatenate([np.zeros((*values.shape[:-1], 1), np.uint64), sums], axis=-1)


def anchors(parts: list[bytes], z: Sizes) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text the anchors' places, the hashes of their seeds and those of their contexts."""
    empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(parts), np.uint8)
    n, width = len(data), z.reach + 1
    if n < z.length:
        return [empty for _ in parts]
    sums = prefixes(data)
    hashes = _mixed((sums[z.seed:] - sums[:-z.seed]) * _powers(INVERSE, n - z.seed + 1))
    # The lowest hash of each string, its place in the low bits: the first place wins a tie.
    place = np.uint64((1 << n.bit_length()) - 1)
    keys = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
    m = len(keys)
    grid = np.concatenate([keys, np.full(-m % width, np.iinfo(np.uint64).max)]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    lowest = np.minimum(back[: m - width + 1], ahead[width - 1 : m]) & place
    text = np.repeat(np.arange(len(parts)), sizes)
    first = np.arange(n - z.length + 1)
    found = np.unique(lowest[text[first] == text[first + z.length - 1]]).astype(np.int64)
    owner = text[found]
    low = np.maximum(starts[owner], found - z.reach)
    high = np.minimum(starts[owner] + sizes[owner], found + z.length)
    view = memoryview(data)
    context = np.array([
        xxhash.xxh3_64_intdigest(view[a:b], seed=c)
        for a, b, c in zip(low.tolist(), high.tolist(), (found - low).tolist(), strict=True)
    ], np.uint64).view(np.int64)
    cuts = np.searchsorted(found, [*starts, n])
    seeds = hashes.view(np.int64)
    return [
        (found[a:b] - s, seeds[found[a:b]], context[a:b])
        for a, b, s in zip(cuts, cuts[1:], starts, strict=False)]


def _keys(column: str) -> list[Column]:
    """Texts are known by 96 bits of their content, which no other split of the input changes."""
    return [F.xxhash64(column).alias("k1"), F.hash(column).alias("k2")]


def _anchored(batches: Iterator[pa.RecordBatch], z: Sizes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", HASHED_BYTES):
            found = anchors(raw(part, "text"), z)
            yield pa.RecordBatch.from_arrays(
                [part.column("k1"), part.column("k2"),
                 pa.array([np.concatenate(f).tobytes() for f in found], pa.binary())],
                ["k1", "k2", "anchors"])


def _exploded(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """A row an anchor: seed, context and copies, and with ``whole`` the text and place too."""
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            data = [np.frombuffer(b, np.int64).reshape(3, -1) for b in part.column("anchors").to_pylist()]
            sizes = [d.shape[1] for d in data]
            place, seed, context = np.concatenate(data, axis=1)

            def spread(name: str, part=part, sizes=sizes) -> pa.Array:
                return pa.array(np.repeat(part.column(name).to_numpy(zero_copy_only=False), sizes))

            columns = {"seed": pa.array(seed), "context": pa.array(context), "copies": spread("copies")}
            if whole:
                columns |= {"k1": spread("k1"), "k2": spread("k2"), "place": pa.array(place.astype(np.int32))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _contexts(batches: Iterator[pa.RecordBatch], z: Sizes) -> Iterator[pa.RecordBatch]:
    """What follows each wanted anchor, and in reverse what comes before it."""
    for batch in batches:
        for text, wanted in zip(raw(batch, "text"), batch.column("wanted").to_pylist(), strict=True):
            place = [w["place"] for w in wanted]
            yield pa.RecordBatch.from_arrays([
                pa.array([w["seed"] for w in wanted], pa.int64()),
                pa.array([w["context"] for w in wanted], pa.int64()),
                pa.array([w["n"] for w in wanted], pa.int64()),
                pa.array([text[p : p + z.length] for p in place], pa.binary()),
                pa.array([text[max(0, p - z.reach) : p][::-1] for p in place], pa.binary()),
            ], ["seed", "context", "n", "after", "before"])


def common(data: list[bytes], other: list[bytes]) -> np.ndarray:
    """Length of the common prefix of each pair, by binary search over prefix hashes; where equal
    hashes belong to different bytes, the bytes decide."""
    width = max(map(len, [*data, *other]), default=0)
    if not width:
        return np.zeros(len(data), np.int64)
    a, b = (np.frombuffer(b"".join(x.ljust(width, b"\0") for x in y), np.uint8)
            .reshape(len(data), width) for y in (data, other))
    low = np.zeros(len(data), np.int64)
    high = np.minimum([len(x) for x in data], [len(x) for x in other]).astype(np.int64)
    longest, rows = high.copy(), np.arange(len(data))
    x, y = prefixes(a), prefixes(b)
    while (low < high).any():
        middle = (low + high + 1) // 2
        equal = x[rows, middle] == y[rows, middle]
        low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
    wrong = (a != b) & (np.arange(width) < low[:, None])
    collided = wrong.any(axis=1)
    low[collided] = wrong[collided].argmax(axis=1)
    return np.minimum(low, longest)


_NEIGHBOUR = ("seed long, context long, single boolean, lo array<int>, hi array<int>,"
              " follows int, precedes int, after binary, before binary")


def _neighbours(batches: Iterator[pa.RecordBatch], z: Sizes) -> Iterator[pa.RecordBatch]:
    """Rows come in order. A row for each context: from both neighbours, the ranges of starts
    (bytes before the anchor) at which they have the same string, and the longest extensions.
    The first and the last row of the task keep their bytes, to be compared across tasks."""
    names = ["seed", "context", "single", "after", "before"]
    held: dict[str, list] = {n: [] for n in names}
    lead: tuple[int, int, int, int] | None = None  # how the first held row meets the one before
    begun = False

    def rows(last: bool) -> pa.RecordBatch:
        nonlocal lead, begun
        n = len(held["seed"])
        after, before, seed = held["after"], held["before"], np.array(held["seed"])
        follows, precedes = common(after[:-1], after[1:]), common(before[:-1], before[1:])
        same = seed[:-1] == seed[1:]
        follows, precedes = np.where(same, follows, 0), np.where(same, precedes, 0)
        met = [lead or (1, 0, 0, 0)] + [
            (z.length - f, p, f, p) for f, p in zip(follows.tolist(), precedes.tolist(), strict=True)]
        done = n if last else n - 1
        if last:
            met.append((1, 0, 0, 0))
        out = []
        for i in range(done):
            pair = [m for m in met[i : i + 2] if m[0] <= m[1]]
            edge = (i == 0 and not begun) or (last and i == n - 1)
            if held["single"][i] or edge:
                out.append((
                    held["seed"][i], held["context"][i], held["single"][i], [m[0] for m in pair],
                    [m[1] for m in pair], max(m[2] for m in met[i : i + 2]),
                    max(m[3] for m in met[i : i + 2]),
                    after[i] if edge else None, before[i] if edge else None))
        begun = begun or done > 0
        lead = met[-1]
        for name in names:
            held[name] = held[name][done:]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32()),
                 pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        columns = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            [c.split()[0] for c in _NEIGHBOUR.split(", ")])

    for batch in batches:
        for start in range(0, batch.num_rows, 2048):
            part = batch.slice(start, 2048)
            for name in names:
                held[name] += part.column(name).to_pylist()
            if len(held["seed"]) > 1:
                yield rows(False)
    if held["seed"]:
        yield rows(True)


def _settled(batches: Iterator[pa.RecordBatch], z: Sizes) -> Iterator[pa.RecordBatch]:
    """Joins a context's ranges; lists the starts that its longest extensions leave open."""
    for batch in batches:
        spans, left_open = [], []
        columns = (batch.column(n).to_pylist() for n in ("lo", "hi", "follows", "precedes"))
        for lo, hi, follows, precedes in zip(*columns, strict=True):
            known = np.zeros(z.reach + 2, np.int64)
            for a, b in zip([x for y in lo for x in y], [x for y in hi for x in y], strict=True):
                known[a] += 1
                known[b + 1] -= 1
            known = np.cumsum(known)[:-1] > 0
            possible = np.zeros(z.reach + 1, bool)
            possible[z.length - follows : precedes + 1] = True
            edges = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]])))
            spans.append([{"lo": a, "hi": b - 1} for a, b in edges.reshape(-1, 2).tolist()])
            left_open.append(np.flatnonzero(possible & ~known).tolist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("seed"), batch.column("context"), pa.array(spans, _SPANS),
             pa.array(left_open, pa.list_(pa.int32())), batch.column("follows"), batch.column("precedes")],
            ["seed", "context", "spans", "open", "follows", "precedes"])


_SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
_SPAN_TYPE = "array<struct<lo:int,hi:int>>"


def _compared(batches: Iterator[pa.RecordBatch], z: Sizes) -> Iterator[pa.RecordBatch]:
    """Contexts against the commonest one of their seed: the starts that this leaves open."""
    for batch in batches:
        most = batch.column("most").to_pylist()
        after, before = batch.column("after").to_pylist(), batch.column("before").to_pylist()
        follows = common(after, [m["after"] for m in most])
        precedes = common(before, [m["before"] for m in most])
        own = np.array([m["context"] for m in most]) == batch.column("context").to_numpy(zero_copy_only=False)
        lo = np.where(own, 1, z.length - follows)
        hi = np.where(own, 0, precedes)
        left_open = [
            [s for s in starts or () if not a <= s <= b]
            for starts, a, b in zip(batch.column("open").to_pylist(), lo.tolist(), hi.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in ("seed", "context", "after", "before", "starts")),
             pa.array(left_open, pa.list_(pa.int32())), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())],
            ["seed", "context", "after", "before", "starts", "open", "lo", "hi"])


def _string(after: bytes, before: bytes, start: int, z: Sizes) -> bytes | None:
    """The string that starts so many bytes before the anchor, if the text has all of it."""
    if start <= len(before) and z.length - start <= len(after):
        return before[:start][::-1] + after[: z.length - start]
    return None


def _own_strings(batches: Iterator[pa.RecordBatch], z: Sizes) -> Iterator[pa.RecordBatch]:
    """Start and hash of the strings that contexts leave open, and into how many parts their seed's
    contexts are split."""
    for batch in batches:
        columns = (batch.column(n).to_pylist() for n in ("seed", "after", "before", "open", "parts"))
        out = [
            (seed, start, xxhash.xxh3_64_intdigest(string) - (1 << 63), parts)
            for seed, after, before, left_open, parts in zip(*columns, strict=True) for start in left_open
            if (string := _string(after, before, start, z)) is not None]
        yield _batch(out, {"seed": pa.int64(), "start": pa.int32(), "hash": pa.int64(), "parts": pa.int64()})


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


def _matched(batches: Iterator[pa.RecordBatch], z: Sizes) -> Iterator[pa.RecordBatch]:
    """Rows come by seed and part: first the strings that are open in the seed, as start and hash,
    then contexts. A row for each string of a context that is one of the open ones, its own
    included, with its bytes. Beyond a bound, all of a seed's strings count as open."""
    here, known, every = None, set(), False
    kinds = {"seed": pa.int64(), "context": pa.int64(), "start": pa.int32(), "open": pa.bool_(),
             "string": pa.binary()}
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch, out = whole.slice(at, 1024), []
            columns = (batch.column(n).to_pylist() for n in (
                "seed", "part", "start", "hash", "context", "after", "before", "starts", "open"))
            for seed, part, start, code, context, after, before, starts, left_open in zip(*columns, strict=True):
                if here != (seed, part):
                    here, known, every = (seed, part), set(), False
                if after is None:
                    every = every or len(known) >= MOST_OPEN
                    if not every:
                        known.add((start, code))
                    continue
                own = set(left_open or ())
                for s in starts:
                    string = _string(after, before, s, z)
                    if string is not None and (
                            every or (s, xxhash.xxh3_64_intdigest(string) - (1 << 63)) in known):
                        out.append((seed, context, s, s in own, string))
            yield _batch(out, kinds)


def _repeated(docs: DataFrame, z: Sizes) -> DataFrame:
    """(k1, k2, spans): for each text with repeats the ranges of bytes that they cover."""
    found = in_batches(docs.where(F.octet_length("text") >= z.length), lambda b: _anchored(b, z),
                       "k1 long, k2 int, anchors binary")
    texts = stage(found.groupBy("k1", "k2").agg(
        F.count("*").alias("copies"), F.first("anchors").alias("anchors")))
    # Seeds that occur again, and whether with more than one context.
    seeds = stage(
        in_batches(texts, lambda b: _exploded(b, False), "seed long, context long, copies long")
        .groupBy("seed").agg(F.sum("copies").alias("n"), F.min("context").alias("a"), F.max("context").alias("b"))
        .where("n > 1").select("seed", (F.col("a") != F.col("b")).alias("mixed")))
    every = in_batches(texts, lambda b: _exploded(b, True),
                       "seed long, context long, copies long, k1 long, k2 int, place int")
    again = stage(every.join(seeds, "seed"))
    discard(texts, seeds)
    classes = stage(
        again.groupBy("seed", "context").agg(
            F.sum("copies").alias("n"), F.first("mixed").alias("mixed"),
            F.min(F.struct("k1", "k2", "place")).alias("at")))
    wanted = classes.where("mixed").groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct(
        F.col("at.place").alias("place"), "seed", "context", "n")).alias("wanted"))
    once = docs.where(F.octet_length("text") >= z.length).groupBy("k1", "k2").agg(F.first("text").alias("text"))
    contexts = stage(in_batches(
        once.join(wanted, ["k1", "k2"]).select("text", "wanted"), lambda b: _contexts(b, z),
        "seed long, context long, n long, after binary, before binary"))
    settled = _settle(contexts, z)
    whole = F.array(F.struct(F.lit(0).alias("lo"), F.lit(z.reach).alias("hi"))).cast(_SPAN_TYPE)
    spans = stage(
        classes.where("n > 1").select("seed", "context", whole.alias("spans"))
        .unionByName(settled))
    covered = (
        again.join(spans, ["seed", "context"]).select("k1", "k2", "place", F.inline("spans"))
        .select("k1", "k2", F.struct(
            (F.col("place") - F.col("hi")).alias("start"),
            (F.col("place") - F.col("lo") + z.length).alias("end")).alias("span"))
        .groupBy("k1", "k2").agg(F.collect_list("span").alias("spans")))
    result = stage(covered)
    discard(again, classes, contexts, spans)
    return result


def _settle(contexts: DataFrame, z: Sizes) -> DataFrame:
    """(seed, context, spans) for the single contexts: ranges of starts of repeated strings."""
    met = []
    kept = contexts.withColumn("single", F.col("n") == 1).drop("n")
    for first, second in (("after", "before"), ("before", "after")):
        ordered = kept.repartitionByRange("seed", first, second).sortWithinPartitions("seed", first, second)
        met.append(stage(in_batches(ordered, lambda b: _neighbours(b, z), _NEIGHBOUR)))
        # Across tasks: two rows of each.
        edges = met[-1].where(F.col("after").isNotNull()).select("seed", "context", "single", "after", "before")
        edges = edges.repartition(1).sortWithinPartitions("seed", first, second)
        met.append(stage(in_batches(edges, lambda b: _neighbours(b, z), _NEIGHBOUR)))
    every = met[0]
    for more in met[1:]:
        every = every.unionByName(more)
    joined = every.where("single").groupBy("seed", "context").agg(
        F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"),
        F.max("follows").alias("follows"), F.max("precedes").alias("precedes"))
    settled = stage(in_batches(
        joined, lambda b: _settled(b, z),
        f"seed long, context long, spans {_SPAN_TYPE}, open array<int>, follows int, precedes int"))
    discard(*met)
    # Strings at a start that some context of the seed leaves open, of all contexts whose
    # longest extensions reach that far; those that are repeated as a whole reach everywhere.
    starts = stage(settled.select("seed", F.explode("open").alias("start")).groupBy("seed").agg(
        F.collect_set("start").alias("starts")))
    reach = settled.select("seed", "context", "open", "follows", "precedes").unionByName(
        contexts.where("n > 1").select("seed", "context"), allowMissingColumns=True)
    reached = F.filter("starts", lambda s: F.coalesce(
        (s >= z.length - F.col("follows")) & (s <= F.col("precedes")), F.lit(True)))
    asked = stage(reach.join(starts, "seed").select(
        "seed", "context", "open", reached.alias("starts")).where("size(starts) > 0"))
    asked = stage(contexts.join(asked, ["seed", "context"]))
    # Most of them meet a seed's commonest context, as edited copies do their original.
    common_ones = stage(asked.groupBy("seed").agg(
        F.max_by(F.struct("context", "after", "before"), "n").alias("most")))
    fields = ("seed long, context long, after binary, before binary, starts array<int>,"
              " open array<int>, lo int, hi int")
    asked = stage(in_batches(asked.join(common_ones, "seed"), lambda b: _compared(b, z), fields))
    starts = stage(asked.select("seed", F.explode("open").alias("start")).groupBy("seed").agg(
        F.collect_set("start").alias("still")))
    left = asked.join(starts, "seed").withColumn("starts", F.array_intersect("starts", "still")).where(
        "size(starts) > 0").drop("still", "lo", "hi")
    parts = left.groupBy("seed").agg((F.floor(F.count("*") / PART) + 1).alias("parts"))
    left = stage(left.join(parts, "seed"))
    # Strings that are open meet all contexts of their seed that may have them; few do.
    own = in_batches(left.where("size(open) > 0"), lambda b: _own_strings(b, z),
                     "seed long, start int, hash long, parts long")
    asking = own.distinct().select(
        "seed", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "start", "hash")
    asked_of = left.select("seed", F.pmod("context", "parts").alias("part"), "context", "after", "before",
                           "starts", "open")
    both = asking.unionByName(asked_of, allowMissingColumns=True).repartition("seed", "part")
    strings = stage(in_batches(
        both.sortWithinPartitions("seed", "part", F.col("after").isNotNull()), lambda b: _matched(b, z),
        "seed long, context long, start int, open boolean, string binary"))
    string = ["seed", "start", "string"]
    twice = stage(strings.groupBy(*string).agg(
        F.count("*").alias("n"), F.max("open").alias("open")).where("n > 1 AND open").select(*string))
    more = strings.where("open").join(twice, string, "left_semi").groupBy("seed", "context").agg(
        F.collect_set("start").alias("starts"))
    met_common = asked.where("lo <= hi").select("seed", "context", F.array(F.struct("lo", "hi")).alias("also"))
    none = F.array().cast(_SPAN_TYPE)
    single = F.transform("starts", lambda s: F.struct(s.alias("lo"), s.alias("hi")))
    return (
        settled.select("seed", "context", "spans").join(more, ["seed", "context"], "left")
        .join(met_common, ["seed", "context"], "left")
        .select("seed", "context", F.concat(
            "spans", F.coalesce(single, none), F.coalesce("also", none)).alias("spans"))
        .where("size(spans) > 0"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            out = []
            for text, spans in zip(raw(part, "text"), part.column("spans").to_pylist(), strict=True):
                change = np.zeros(len(text) + 1, np.int64)
                for s in spans or []:
                    change[max(0, s["start"])] += 1
                    change[min(len(text), s["end"])] -= 1
                gone = np.cumsum(change)[:-1] > 0
                runs = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if runs else text
                out.append((len(text), len(text) - len(kept), runs, kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column("rest"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["rest", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(df: DataFrame, column: str = "text", length: int = 200, seed: int = 32) -> DataFrame:
    """The rows without their text, with ``n_bytes`` (of the text in UTF-8), ``n_removed``,
    ``n_spans`` (maximal removed runs) and ``kept`` (the other bytes, in order). Existing columns
    of these names are replaced.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else, too, in the same
    or another text, overlaps included. Null counts as empty; shorter texts keep all. One row per
    input row; repeated rows are copies of each other, so long ones lose everything.
    """
    added = ("n_bytes", "n_removed", "n_spans", "kept")
    kept = [c for c in df.columns if c not in (column, *added)]
    text = F.coalesce(column, F.lit("")).alias("text")
    packed = pack(df.select(*kept, text), "text")
    packed = packed.select("text", "rest", *_keys("text"))
    spans = _repeated(packed.select("text", "k1", "k2"), Sizes(length, seed))
    joined = packed.join(spans, ["k1", "k2"], "left").select("text", "rest", "spans")
    fields = [StructField(n, LongType()) for n in added[:3]] + [StructField("kept", BinaryType())]
    cleaned = in_batches(joined, _kept, with_fields(packed.select("rest").schema, *fields))
    return unpack(cleaned, kept, *added)
