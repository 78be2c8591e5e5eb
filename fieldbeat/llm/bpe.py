"""Byte-level BPE: encoding with a bitmap rank queue, and decoding.

A piece of text starts as single bytes in a linked list. Every adjacent pair with a rank waits
in the bucket of its rank. A bitmap over the ranks, with a second bitmap over its words, gives
the lowest rank that waits by two find-first-set steps. An entry whose pair has changed since
is stale and skipped. A merge costs the same in a piece of any length, so very long pieces (a
hundred thousand letters without a space) take time in proportion to their length. The new
pieces of some megabyte of text go through one queue together.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField

from fieldbeat.llm.shared import in_batches, lists, replaced, slices, texts, with_fields

#: Distinct pieces a Python worker remembers before it starts anew; bounds its memory, not the
#: result.
REMEMBERED = 200_000
#: Longer pieces are encoded each time they occur.
REMEMBERED_CHARS = 48
#: Text bytes whose new pieces go through one queue, and from how many bytes of these on all
#: places of a rank merge at once.
TOGETHER, MANY_BYTES = 2 << 20, 1 << 16
#: A bitmap word has 2**8 bits, a top-level word has one bit for each of them.
WORD_BITS = 8
WORD_MASK = (1 << WORD_BITS) - 1


class Vocabulary:
    """Ranks of byte strings, and the strings by rank."""

    def __init__(self, lines: bytes):
        pairs = [line.split() for line in lines.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.words = [0] * ((max(self.tokens, default=0) >> WORD_BITS) + 1)
        # The bytes of all tokens in a row, and where each one's are.
        count = max(self.tokens, default=-1) + 1
        self.places, self.sizes = np.full(count, -1, np.int32), np.zeros(count, np.int32)
        self.data = np.frombuffer(b"".join(self.tokens.values()), np.uint8)
        at = 0
        for rank, token in self.tokens.items():
            self.places[rank], self.sizes[rank] = at, len(token)
            at += len(token)
        # What each two tokens merge to, and which tokens may merge on at a rank below their own.
        self.count, get = count, self.ranks.get
        found = [(a * count + b, rank) for token, rank in self.ranks.items() for i in range(1, len(token))
                 if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None]
        found.sort()
        self.pairs = np.array([k for k, _ in found] + [np.iinfo(np.int64).max], np.int64)
        self.merged_to = np.array([r for _, r in found] + [-1], np.int64)
        self.early = np.zeros(count, bool)
        for part in (self.pairs[:-1] // max(1, count), self.pairs[:-1] % max(1, count)):
            self.early[part[self.merged_to[:-1] < part]] = True
        self.bytes = np.array([get(bytes([b]), -2) for b in range(256)], np.int64)
        self.two_bytes = np.full(1 << 16, -1)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.two_bytes[token[0] * 256 + token[1]] = rank

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece: its own, or those left after all merges, lowest rank first."""
        return tuple(self.encode_all([piece])[0])

    def encode_all(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece. Pieces share one queue but never merge with each other: of each
        one the pairs go by rank, and from left to right, as they would alone."""
        known = [self.ranks.get(p) for p in pieces]
        open_pieces = [p for p, i in zip(pieces, known, strict=True) if i is None and p]
        few = sum(map(len, open_pieces)) < MANY_BYTES
        merged = iter((self._merged if few else self._merged_together)(open_pieces) if open_pieces else ())
        return [[i] if i is not None else next(merged) if p else []
                for p, i in zip(pieces, known, strict=True)]

    def _merged(self, pieces: list[bytes]) -> list[list[int]]:
        get, words = self.ranks.get, self.words
        # All pieces in one text, with a place between them at which nothing merges.
        text = b"\0".join(pieces) + b"\0"
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        stops = np.cumsum(sizes + 1) - 1
        n = len(text)
        stop = bytearray(n)
        np.frombuffer(stop, np.uint8)[stops] = 1
        data = np.frombuffer(text, np.uint8).astype(np.int64)
        first = np.full(n, -1)
        first[:-1] = self.two_bytes[data[:-1] * 256 + data[1:]]
        first[stops], first[stops - 1] = -1, -1
        before = np.arange(-1, n - 1)
        before[0], before[stops[:-1] + 1] = -1, -1
        end, before, waiting = list(range(1, n + 1)), before.tolist(), first.tolist()
        # The places of each rank, in order; a bit for each rank that waits.
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        ranks, cuts = np.unique(first[at], return_index=True)
        buckets = dict(zip(ranks.tolist(), map(np.ndarray.tolist, np.split(at, cuts[1:])), strict=True)) if len(at) else {}
        top, bucket_of = 0, buckets.get
        for rank in buckets:
            words[rank >> WORD_BITS] |= 1 << (rank & WORD_MASK)
            top |= 1 << (rank >> WORD_BITS)
        while top:
            w = (top & -top).bit_length() - 1
            word = words[w]
            rank = (w << WORD_BITS) + (word & -word).bit_length() - 1
            words[w] = word = word & (word - 1)
            if not word:
                top &= top - 1
            places = buckets.pop(rank)
            places.sort()
            lowest = rank
            for done, i in enumerate(places, 1):
                if waiting[i] != rank:
                    continue
                j = end[i]
                k = end[i] = end[j]
                waiting[j] = -1
                # The pairs of the new token with the one after it and the one before it.
                if stop[k]:
                    waiting[i] = -1
                else:
                    before[k] = i
                    waiting[i] = new = get(text[i : end[k]], -1)
                    if new >= 0:
                        bucket = bucket_of(new)
                        if bucket is not None:
                            bucket.append(i)
                        else:
                            buckets[new] = [i]
                            w = new >> WORD_BITS
                            if not words[w]:
                                top |= 1 << w
                            words[w] |= 1 << (new & WORD_MASK)
                            if new < lowest:
                                lowest = new
                h = before[i]
                if h >= 0:
                    waiting[h] = new = get(text[h:k], -1)
                    if new >= 0:
                        bucket = bucket_of(new)
                        if bucket is not None:
                            bucket.append(h)
                        else:
                            buckets[new] = [h]
                            w = new >> WORD_BITS
                            if not words[w]:
                                top |= 1 << w
                            words[w] |= 1 << (new & WORD_MASK)
                            if new < lowest:
                                lowest = new
                if lowest < rank and done < len(places):
                    # A lower rank comes first; the rest of this one waits again.
                    buckets[rank] = places[done:]
                    words[rank >> WORD_BITS] |= 1 << (rank & WORD_MASK)
                    top |= 1 << (rank >> WORD_BITS)
                    break
        out, i = [], 0
        for size in sizes.tolist():
            last, ids = i + size, []
            while i < last:
                ids.append(get(text[i : end[i]]))
                i = end[i]
            out.append(ids)
            i += 1
        return out


    def _merged_together(self, pieces: list[bytes]) -> list[list[int]]:
        """The same for many pieces, by the same queue: all places of the rank that is next merge
        at once. Places that would overlap take turns from the left, and where merging a rank may
        let a lower one wait, only the first place of each piece merges before the queue is asked
        again."""
        words = self.words
        text = b"\0".join(pieces) + b"\0"
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        stops = np.cumsum(sizes + 1) - 1
        n = len(text)
        stop = np.zeros(n, bool)
        stop[stops] = True
        data = np.frombuffer(text, np.uint8).astype(np.int64)
        waiting = np.full(n, -1)
        waiting[:-1] = self.two_bytes[data[:-1] * 256 + data[1:]]
        waiting[stops], waiting[stops - 1] = -1, -1
        tokens, owner = self.bytes[data], np.repeat(np.arange(len(pieces)), sizes + 1)
        end, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        before[0], before[stops[:-1] + 1] = -1, -1
        buckets: dict[int, list[np.ndarray]] = {}
        top = 0

        def wait(ranks: np.ndarray, places: np.ndarray) -> None:
            nonlocal top
            order = ranks.argsort(kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, part in zip(ranks[[0, *cuts]].tolist(), np.split(places, cuts), strict=True):
                if rank in buckets:
                    buckets[rank].append(part)
                else:
                    buckets[rank] = [part]
                    words[rank >> WORD_BITS] |= 1 << (rank & WORD_MASK)
                    top |= 1 << (rank >> WORD_BITS)

        at = np.flatnonzero(waiting >= 0)
        if len(at):
            wait(waiting[at], at)
        while top:
            w = (top & -top).bit_length() - 1
            word = words[w]
            rank = (w << WORD_BITS) + (word & -word).bit_length() - 1
            words[w] = word = word & (word - 1)
            if not word:
                top &= top - 1
            parts = buckets.pop(rank)
            places = parts[0] if len(parts) == 1 else np.concatenate(parts)
            places = np.unique(places[waiting[places] == rank])
            if not len(places):
                continue
            # Of places that follow each other the first, the third … merge.
            if self.early[rank]:
                first = np.unique(owner[places], return_index=True)[1]
                later, i = np.delete(places, first), places[first]
                if len(later):
                    wait(np.full(len(later), rank), later)
            else:
                index = np.arange(len(places))
                begins = np.ones(len(places), bool)
                begins[1:] = end[places[:-1]] != places[1:]
                i = places[(index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 0]
            j = end[i]
            k = end[j]
            tokens[i], end[i], waiting[j], tokens[j] = rank, k, -1, -1
            before[k] = i
            after = np.where(stop[k], -1, self.pair_ranks(rank, tokens[k]))
            waiting[i] = after
            h = before[i]
            left = h >= 0
            h = h[left]
            ahead = self.pair_ranks(tokens[h], rank)
            waiting[h] = ahead
            ranks, moved = np.concatenate([after, ahead]), np.concatenate([i, h])
            good = ranks >= 0
            if good.any():
                wait(ranks[good], moved[good])
        alive = (tokens >= 0) & ~stop
        counts = np.bincount(owner[alive], minlength=len(pieces))
        ids = tokens[alive].tolist()
        ends = np.cumsum(counts).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def pair_ranks(self, first: np.ndarray | int, second: np.ndarray | int) -> np.ndarray:
        """The rank that each two tokens merge to, or -1."""
        wanted = np.asarray(first * self.count + second)
        place = np.searchsorted(self.pairs, wanted)
        return np.where(self.pairs[place] == wanted, self.merged_to[place], -1)


class Remembered(dict):
    """Ids by piece of text, as the bytes of 32-bit numbers; those of long pieces only for one
    part of a batch."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.long = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        return self.long[piece]

    def learn(self, pieces: set[str]) -> None:
        self.long = {}
        if len(self) > REMEMBERED:
            self.clear()
        new = list(pieces.difference(self))
        for piece, ids in zip(new, self.vocabulary.encode_all([p.encode() for p in new]), strict=True):
            (self if len(piece) <= REMEMBERED_CHARS else self.long)[piece] = array("i", ids).tobytes()


@lru_cache(maxsize=1)
def _remembered(lines: bytes) -> Remembered:
    """One per worker and vocabulary, kept from task to task."""
    return Remembered(Vocabulary(lines))


def read_ranks(path: str) -> bytes:
    """The rank file's lines, read by the driver. A vocabulary has some ten thousand entries
    whatever the size of the data, so tasks get it by broadcast."""
    with open(path, "rb") as file:
        return file.read()


def _encoded(batches: Iterator[pa.RecordBatch], ranks: bytes, pattern: str, column: str,
             to: str) -> Iterator[pa.RecordBatch]:
    find, known = regex.compile(pattern).findall, _remembered(ranks)
    for batch in batches:
        for part in slices(batch, column, TOGETHER):
            pieces = [find(t) for t in texts(part, column)]
            known.learn(set().union(*pieces))
            found = [np.frombuffer(b"".join(map(known.__getitem__, p)), np.int32) for p in pieces]
            ids = lists(np.concatenate(found), [len(x) for x in found], pa.int32())
            yield replaced(part, **{to: ids})


def _decoded(batches: Iterator[pa.RecordBatch], ranks: bytes, column: str,
             to: str) -> Iterator[pa.RecordBatch]:
    """Copies the bytes of all tokens of some texts at once, from one array that has them all."""
    vocabulary = _remembered(ranks).vocabulary
    places, sizes, data = vocabulary.places, vocabulary.sizes, vocabulary.data
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            values = part.column(column)
            flat = values.flatten()
            if flat.null_count or len(flat) and not (
                    0 <= pc.min(flat).as_py() and pc.max(flat).as_py() < len(places)
                    and places[flat.to_numpy()].min() >= 0):
                raise KeyError("an id is not in the vocabulary")
            ids = flat.to_numpy(zero_copy_only=False).astype(np.int64)
            size = sizes[ids]
            ends = np.cumsum(size)
            moved = np.repeat(places[ids] - (ends - size), size)
            moved += np.arange(len(moved), dtype=moved.dtype)
            counts = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
            decoded = pa.Array.from_buffers(
                pa.large_binary(), len(part), [None, pa.py_buffer(cuts.astype(np.int64)),
                                               pa.py_buffer(data[moved])])
            yield replaced(part, **{to: decoded.cast(pa.binary())})


def _ids(name: str) -> StructField:
    return StructField(name, ArrayType(IntegerType()))


def encode(df: DataFrame, ranks: bytes, pattern: str, column: str = "text",
           to: str = "ids") -> DataFrame:
    """Adds the token ids of each whole text as ``to`` (an existing column is replaced).

    Each match of ``pattern`` is encoded on its own. Null and empty texts have no ids. Rows
    stay as they are, repeated ones too.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    return in_batches(df, lambda b: _encoded(b, shared.value, pattern, column, to),
                      with_fields(df.schema, _ids(to)))


def decode(df: DataFrame, ranks: bytes, column: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the bytes of each id list as ``to`` (an existing column is replaced).

    Null and empty lists give no bytes; an id that is not in the vocabulary, or null, fails.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    return in_batches(df, lambda b: _decoded(b, shared.value, column, to),
                      with_fields(df.schema, StructField(to, BinaryType())))


def encode_and_decode(df: DataFrame, ranks: bytes, pattern: str, column: str = "text",
                      ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode``, then ``decode`` of its ids, without the text, in one pass: the ids do not go
    through the JVM in between, and a task needs one Python worker."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _decoded(_encoded(batches, shared.value, pattern, column, ids), shared.value, ids, decoded):
            yield batch.drop_columns([column])

    fields = with_fields(df.drop(column).schema, _ids(ids), StructField(decoded, BinaryType()))
    return in_batches(df, run, fields)
