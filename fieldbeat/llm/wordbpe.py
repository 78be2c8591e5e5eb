"""BPE over words: speculate and verify, and decoding.

A word's tokens are first guessed by longest match from the left. A guess is right if and only
if every two neighbours in it are compatible, that is if merging the two tokens' text alone
gives just these two. Whether they are is found by undoing merges at the boundary, for all
distinct pairs of a batch at once. Only words with a wrong guess are merged pair by pair.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField
from tokenizers import Tokenizer

from fieldbeat.llm.shared import in_batches, lists, replaced, slices, texts, with_fields

#: Distinct words a Python worker remembers before it starts anew, and the longest remembered;
#: these bound its memory, not the result.
REMEMBERED, REMEMBERED_CHARS = 500_000, 48
#: Text bytes whose words are looked at together.
TOGETHER = 4 << 20
#: Above all ranks.
NEVER = np.iinfo(np.int32).max


def _byte_chars() -> dict[int, str]:
    """The character that stands for each byte: printable Latin-1 stands for itself, the other
    bytes in their order for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _common() -> str:
    """Ranges of the characters that all Unicode tables at hand agree on: those of Unicode 3.2,
    and the blocks of pictures."""
    old = unicodedata.ucd_3_2_0.category
    known = np.array([old(chr(c)) != "Cn" for c in range(0x110000)])
    known[0x1F000:0x1FB00] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2).tolist())


@lru_cache(maxsize=2)
def _splitter(spec: str) -> Tokenizer:
    return Tokenizer.from_str(spec)


class Vocabulary:
    """Tokens, merges and what splits a text, read from a tokenizer file.

    Understands files of one kind: byte-level BPE with a mark at the end of words, over texts
    that are composed, lower-cased and split by one pattern, white space dropped. Others fail.
    Characters that newer Unicode tables may treat otherwise are left to the library to
    normalize and split; tokens are always found here.
    """

    def __init__(self, file: bytes):
        spec = json.loads(file)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if not (model["type"] == "BPE" and end and kinds == ["NFC", "Replace", "Lowercase"]
                and not model.get("continuing_subword_prefix") and not model.get("ignore_merges")
                and not model["dropout"] and split["behavior"] == "Removed" and split["invert"]
                and level["type"] == "ByteLevel" and not level["add_prefix_space"]
                and spec.get("decoder") is None and spec.get("post_processor") is None):
            raise ValueError("not a tokenizer file of the kind this reads")
        self.key = hashlib.sha256(file).hexdigest()
        self.pattern = split["pattern"]["Regex"]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        vocab = model["vocab"]
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        chars = _byte_chars()
        self.table = str.maketrans({chr(b): c for b, c in chars.items() if chr(b) != c})
        self.bytes = str.maketrans({c: chr(b) for b, c in chars.items() if chr(b) != c})
        self.inner_char = {c: vocab[c] for c in chars.values()}
        self.last_char = {c: vocab[c + end] for c in chars.values()}
        #: Rank and result of each pair that merges, and how each token came to be.
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.rank = np.full(size, -1, np.int32)
        self.left, self.right = np.zeros(size, np.int32), np.zeros(size, np.int32)
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair, made = (vocab[a], vocab[b]), vocab[a + b]
            if pair in self.merges or self.rank[made] >= 0 or max(self.rank[list(pair)]) >= rank:
                raise ValueError("a token has several merges, or comes before its parts")
            self.merges[pair] = rank, made
            self.rank[made], self.left[made], self.right[made] = rank, *pair
        keys = np.array([a * size + b for a, b in self.merges], np.int64)
        order = keys.argsort()
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.key_ranks = np.append(order.astype(np.int32), NEVER)
        # Only tokens that merging their own text gives can be guessed.
        self.inner: dict[str, int] = {}
        self.last: dict[str, int] = {}
        self.longest: dict[str, int] = {}
        for token, i in vocab.items():
            if self.rank[i] < 0 and token in self.inner_char:
                self.inner[token] = i
            elif token.endswith(end) and len(token) > len(end):
                if self.merged(token.removesuffix(end)) == [i]:
                    self.last[token.removesuffix(end)] = i
            elif self.merged(token, whole=False) == [i]:
                self.inner[token] = i
                self.longest[token[:2]] = max(len(token), self.longest.get(token[:2], 0))
        self.longest_last = max(map(len, self.last), default=0)
        self.rare = f"[^{_common()}]"
        # What splits a text, for the library, with an empty model.
        self.splitter = json.dumps(spec | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}})

    def words(self, text: str, find: Callable, rare: regex.Pattern) -> list[str]:
        """The words of a text without special tokens."""
        if text.isascii():
            return find(text.lower())
        if rare.search(text):
            library = _splitter(self.splitter)
            pieces = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
            return [word.translate(self.bytes).encode("latin-1").decode() for word, _ in pieces]
        # Each letter is lowered by itself: a sigma that ends a word, too.
        return find(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def spelled(self, word: str) -> str:
        """The word with a character for each byte."""
        if word.isascii() and word.isprintable():
            return word
        return word.encode().decode("latin-1").translate(self.table)

    def guess(self, word: str) -> list[int]:
        """Longest match from the left; the last token is one that ends words."""
        last, inner, longest = self.last, self.inner, self.longest
        token, n, i, out = last.get(word), len(word), 0, []
        while token is None:
            size = min(longest.get(word[i : i + 2], 1), n - i - 1)
            found = inner.get(word[i : i + size])
            while found is None:
                size -= 1
                found = inner.get(word[i : i + size])
            out.append(found)
            i += size
            if n - i <= self.longest_last:
                token = last.get(word[i:])
        out.append(token)
        return out

    def merged(self, word: str, whole: bool = True) -> list[int]:
        """Merges pair by pair, lowest rank first, equal ranks from left to right."""
        tokens = [self.inner_char[c] for c in word]
        if whole:
            tokens[-1] = self.last_char[word[-1]]
        n, merges = len(tokens), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n))
        waiting = []
        for i in range(n - 1):
            merge = merges.get((tokens[i], tokens[i + 1]))
            if merge:
                waiting.append((merge[0], i, merge[1]))
        heapify(waiting)
        while waiting:
            rank, i, made = heappop(waiting)
            j = after[i]
            if j >= n or tokens[i] < 0 or merges.get((tokens[i], tokens[j])) != (rank, made):
                continue
            tokens[i], tokens[j], k = made, -1, after[j]
            after[i], before[k] = k, i
            for h, m in ((before[i], i), (i, k)):
                if h >= 0 and m < n:
                    merge = merges.get((tokens[h], tokens[m]))
                    if merge:
                        heappush(waiting, (merge[0], h, merge[1]))
        return [t for t in tokens if t >= 0]

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether merging their text alone gives these two.

        Merges are undone at the boundary, the latest first: of two with one rank that is the
        second token's. What then meets there must not have merged before: with a lower rank
        than the merge undone, or with the same if that one lies to the right.
        """
        good = np.ones(len(first), bool)
        at = np.arange(len(first))
        a, b = first.astype(np.int64), second.astype(np.int64)
        limit = np.full(len(first), NEVER, np.int64)
        while len(at):
            wanted = a * len(self.tokens) + b
            place = np.searchsorted(self.keys, wanted)
            rank = np.where(self.keys[place] == wanted, self.key_ranks[place], NEVER)
            bad = rank < limit
            good[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            undo_first = ra > rb
            limit = np.where(undo_first, ra, rb + 1)
            a, b = np.where(undo_first, self.right[a], a), np.where(undo_first, b, self.left[b])
        return good

    def encode(self, words: list[str]) -> list[list[int]]:
        """The tokens of each of these words: guessed, checked, and merged where the guess fails."""
        words = [self.spelled(w) for w in words]
        guesses = [self.guess(w) for w in words]
        sizes = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((t for g in guesses for t in g), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(words)), sizes)
        inside = np.flatnonzero(word[1:] == word[:-1])
        pairs, which = np.unique(flat[inside] * len(self.tokens) + flat[inside + 1], return_inverse=True)
        good = self.compatible(pairs // len(self.tokens), pairs % len(self.tokens))
        for w in np.unique(word[inside[~good[which]]]):
            guesses[w] = self.merged(words[w])
        return guesses


class Remembered(dict):
    """Ids by word, as the bytes of 32-bit numbers; those of long words only for one batch."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.long = vocabulary, {}

    def __missing__(self, word: str) -> bytes:
        return self.long[word]

    def learn(self, words: set[str]) -> None:
        self.long = {}
        if len(self) > REMEMBERED:
            self.clear()
        new = [w for w in words if w not in self]
        for w, ids in zip(new, self.vocabulary.encode(new), strict=True):
            (self if len(w) <= REMEMBERED_CHARS else self.long)[w] = np.array(ids, np.int32).tobytes()


_WORKER: dict[str, Remembered] = {}


def _remembered(vocabulary: Vocabulary) -> Remembered:
    """One per worker, kept from task to task, for the vocabulary last used."""
    if vocabulary.key not in _WORKER:
        _WORKER.clear()
        _WORKER[vocabulary.key] = Remembered(vocabulary)
    return _WORKER[vocabulary.key]


@lru_cache(maxsize=2)
def read_vocabulary(path: str) -> Vocabulary:
    """Read by the driver. A vocabulary has some ten thousand entries whatever the size of the
    data, so tasks get it by broadcast."""
    with open(path, "rb") as file:
        return Vocabulary(file.read())


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, column: str,
             to: str) -> Iterator[pa.RecordBatch]:
    known, find = _remembered(vocabulary), regex.compile(vocabulary.pattern).findall
    rare = regex.compile(vocabulary.rare)
    special = vocabulary.special
    mark = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
    ids_of = {s: np.array([i], np.int32).tobytes() for s, i in special.items()}
    for batch in batches:
        for part in slices(batch, column, TOGETHER):
            found: list[list[list[str] | str]] = []  # a text: words, special token, words, …
            for text in texts(part, column):
                pieces = mark.split(text) if mark and any(s in text for s in special) else [text]
                found.append([p if i % 2 else vocabulary.words(p, find, rare) for i, p in enumerate(pieces)])
            known.learn({w for pieces in found for p in pieces[::2] for w in p})
            coded = [
                np.frombuffer(b"".join(
                    ids_of[p] if i % 2 else b"".join(map(known.__getitem__, p))
                    for i, p in enumerate(pieces)), np.int32)
                for pieces in found
            ]
            yield replaced(part, **{to: lists(np.concatenate(coded), [len(x) for x in coded], pa.int32())})


def _decoded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, column: str,
             to: str) -> Iterator[pa.RecordBatch]:
    tokens = vocabulary.tokens
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            values = part.column(column)
            flat = values.flatten().to_numpy(zero_copy_only=False)
            if len(flat) and not (0 <= np.nanmin(flat) <= np.nanmax(flat) < len(tokens) and flat.dtype.kind == "i"):
                raise ValueError("an id is not in the vocabulary")
            cuts = np.cumsum(values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            decoded = [" ".join(map(tokens.__getitem__, ids.tolist())) for ids in np.split(flat, cuts[:-1])]
            yield replaced(part, **{to: pa.array(decoded, pa.string())})


def _ids(name: str) -> StructField:
    return StructField(name, ArrayType(IntegerType()))


def encode(df: DataFrame, vocabulary: Vocabulary, column: str = "text", to: str = "ids") -> DataFrame:
    """Adds the token ids of each whole text as ``to`` (an existing column is replaced).

    Special tokens written out in a text are found, but none are added. Null and empty texts,
    and texts of white space only, have no ids. Rows stay as they are, repeated ones too.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    return in_batches(df, lambda b: _encoded(b, shared.value, column, to),
                      with_fields(df.schema, _ids(to)))


def decode(df: DataFrame, vocabulary: Vocabulary, column: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text of each id list as ``to`` (an existing column is replaced): the tokens as
    the file writes them, joined by spaces, special ones too.

    Null and empty lists give an empty text; an id that is not in the vocabulary, or null, fails.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    return in_batches(df, lambda b: _decoded(b, shared.value, column, to),
                      with_fields(df.schema, StructField(to, StringType())))


def encode_and_decode(df: DataFrame, vocabulary: Vocabulary, column: str = "text",
                      ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode``, then ``decode`` of its ids, without the text, in one pass: the ids do not go
    through the JVM in between, and a task needs one Python worker."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = _encoded(batches, shared.value, column, ids)
        for batch in _decoded(coded, shared.value, ids, decoded):
            yield batch.drop_columns([column])

    fields = with_fields(df.drop(column).schema, _ids(ids), StructField(decoded, StringType()))
    return in_batches(df, run, fields)
