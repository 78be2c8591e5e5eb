"""Secret scans: fixed patterns, and formats learned from what they find.

Values that the patterns find are labelled credentials. A bounded sample of each kind becomes
a prefix tree of classes of characters, whose statistically compatible states are merged into a
probabilistic automaton (by Hoeffding's bound on the frequencies of stopping and of each next
class). Two more automata are learned from samples of the other tokens, short and long ones.
Every token is a candidate, and a credential if it fits a format as well as labelled values do
that the format was not learned from, if that gives it 40 bits at least, and if the format explains
it better than the other tokens' automata do.

No bar depends on how many candidates are credentials: those that fit a format are left out of
what the other tokens' automata learn. Plain words and numbers always stay in.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import log, sqrt

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from fieldbeat.llm.shared import in_batches, replaced, slices, texts, with_fields

KINDS = ("assign", "access", "hex")
#: Kind of the spans that only a learned format gives.
LEARNED = "learned"
# The base patterns, with the least size of what they find.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

#: A candidate is a run of these characters, or its part outside the base matches, that is at
#: least as long as the shortest value of a base pattern.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
LEAST_TOKEN = LEAST_ASSIGN
#: Other tokens are sampled apart below and from this length on, as long ones are rare.
LONG = 16
#: Words and numbers: what a credential's format cannot claim for itself.
PLAIN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9+/_=-]+")
NUMBER = re.compile(r"[0-9+/_=-]+")
#: Distinct values of a kind, and other tokens, that automata are learned from.
SAMPLE_ROWS = 400
#: A kind with fewer distinct values teaches nothing.
LEAST_VALUES = 20
#: Confidence of the merge test, and the words that either state must have for it to tell.
MERGE_ALPHA, LEAST_COUNT = 0.05, 20
#: Added to the count of every character of a class that a state has seen.
SMOOTH = 0.05
#: Probability of a character that a state has never seen.
UNSEEN = 1e-4
#: Least mean gain a character over the other tokens' automata, in nats.
LEAST_GAIN = 1.0
#: A token fits a format down to this quantile of held-out labelled values' mean log likelihood
#: a character, less a margin; never below that of random characters less LEAST_GAIN.
FIT_QUANTILE, MARGIN = 0.05, 0.25
LEAST_FIT = -log(64) - LEAST_GAIN
#: A credential is hard to guess: characters that its format gives 40 bits at least.
MOST_GUESSABLE = -40 * log(2)
DIGITS, SMALL, CAPITALS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Candidates that are scored at once.
TOKENS_AT_ONCE = 1 << 16

#: Columns of ``find_base``.
FOUND = (
    "base array<struct<kind:string,start:int,end:int>>, values array<struct<kind:string,value:string>>,"
    " candidates array<struct<start:int,token:string>>")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base matches, in this order; end is exclusive."""
    spans = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text)
                  if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def folded(token: str) -> str:
    """A token whose letters are all capital, in small ones: a format's case is free as a whole."""
    return token.lower() if token == token.upper() else token


def _kind(char: str) -> str:
    """The class of a character: digit, small letter, capital, or the character itself."""
    return "0" if char in DIGITS else "a" if char in SMALL else "A" if char in CAPITALS else char


class Automaton:
    """A probabilistic automaton over classes of characters, with each state's own frequencies of
    the characters of a class, and how often it stops.

    The prefix tree of the values' classes is merged level by level: a state joins the first one of
    its level that it is compatible with. States of different levels stay apart, so a format
    keeps its length.
    """

    def __init__(self, words: Sequence[str]):
        words = [folded(w) for w in words]
        kinds = ["".join(map(_kind, w)) for w in words]
        # The words that pass each state of a level, the largest first.
        level = [list(range(len(words)))]
        self.rows: list[tuple[dict[str, tuple[float, int]], float]] = []
        first, depth = 0, 0
        while level:
            after: list[list[int]] = []
            moves = [self._following(state, kinds, depth) for state in level]
            # Children join in order of size, so that small ones find the large ones settled.
            targets: dict[tuple[int, str], int] = {}
            children = sorted(((i, c) for i, m in enumerate(moves) for c in m), key=lambda x: (
                -len(moves[x[0]][x[1]]), x))
            for i, c in children:
                child = moves[i][c]
                at = next((j for j, other in enumerate(after)
                           if self._compatible(child, other, kinds, depth + 1)), None)
                if at is None:
                    at = len(after)
                    after.append([])
                after[at] = after[at] + child
                targets[i, c] = at
            for i, state in enumerate(level):
                self.rows.append(self._row(
                    state, moves[i], words, depth, {c: first + len(level) + targets[i, c] for c in moves[i]}))
            first += len(level)
            level, depth = after, depth + 1

    @staticmethod
    def _following(state: list[int], kinds: list[str], depth: int) -> dict[str, list[int]]:
        """The words that go on, by the class of their next character."""
        out: dict[str, list[int]] = {}
        for w in state:
            if depth < len(kinds[w]):
                out.setdefault(kinds[w][depth], []).append(w)
        return out

    def _compatible(self, a: list[int], b: list[int], kinds: list[str], depth: int) -> bool:
        """Whether no frequency of classes or of stopping differs by more than chance allows, here
        and further on, as far as both have enough words to tell."""
        pairs = [(a, b, depth)]
        while pairs:
            a, b, depth = pairs.pop()
            n, m = len(a), len(b)
            if min(n, m) < LEAST_COUNT:
                continue
            bound = sqrt(log(2 / MERGE_ALPHA) / 2) * (1 / sqrt(n) + 1 / sqrt(m))
            x, y = self._following(a, kinds, depth), self._following(b, kinds, depth)
            shares = [(len(x.get(c, ())), len(y.get(c, ()))) for c in x.keys() | y.keys()]
            shares.append((n - sum(s for s, _ in shares), m - sum(t for _, t in shares)))
            if any(abs(s / n - t / m) > bound for s, t in shares):
                return False
            pairs += [(x[c], y[c], depth + 1) for c in x.keys() & y.keys()]
        return True

    @staticmethod
    def _row(state: list[int], moves: dict[str, list[int]], words: list[str], depth: int,
             targets: dict[str, int]) -> tuple[dict[str, tuple[float, int]], float]:
        """For each character its log probability and the next state, and that of stopping."""
        out, n = {}, len(state)
        for c, passing in moves.items():
            members = {"0": DIGITS, "a": SMALL, "A": CAPITALS}.get(c, c)
            counts = Counter(words[w][depth] for w in passing)
            whole = len(passing) + SMOOTH * len(members)
            for char in members:
                share = (counts[char] + SMOOTH) / whole
                out[char] = log(max(share * len(passing) / n, UNSEEN)), targets[c]
        stops = n - sum(map(len, moves.values()))
        return out, log(max(stops / max(1, n), UNSEEN))

    def score(self, word: str) -> float:
        """Log likelihood; a character its state has never seen costs log UNSEEN and stays."""
        chars, stop = self.parts(word)
        return chars + stop

    def parts(self, word: str, least: float = float("-inf")) -> tuple[float, float]:
        """Log likelihoods of the characters and of stopping; given up below ``least``."""
        total, state, unseen, rows = 0.0, 0, log(UNSEEN), self.rows
        for char in folded(word):
            step = rows[state][0].get(char)
            if step is None:
                total += unseen
            else:
                total += step[0]
                state = step[1]
            if total < least:
                break
        return total, rows[state][1]


@dataclass
class Formats:
    """Automata of the kinds with the fit each asks for, and automata of other tokens."""

    kinds: list[tuple[Automaton, float]]
    other: list[Automaton] = field(default_factory=list)

    def fitting(self, token: str) -> float:
        """The best log likelihood of the formats that the token fits; -inf if it fits none, or is
        too short for a credential of the format."""
        best = float("-inf")
        for automaton, fit in self.kinds:
            least = fit * len(token)
            chars, stop = automaton.parts(token, least)
            if least <= chars <= MOST_GUESSABLE:
                best = max(best, chars + stop)
        return best

    def credential(self, token: str) -> bool:
        best = self.fitting(token)
        if best == float("-inf"):
            return False
        other = max((a.score(token) for a in self.other), default=log(UNSEEN) * len(token))
        if NUMBER.fullmatch(token):
            other = max(other, -log(10) * len(token))
        return best - other >= LEAST_GAIN * (len(token) + 1)


def _format(values: Sequence[str]) -> tuple[Automaton, float]:
    """The automaton of labelled values, and the fit it asks for: each half of the values is
    scored by an automaton of the other half."""
    halves = values[::2], values[1::2]
    fits = sorted(
        automaton.parts(v)[0] / len(v)
        for automaton, half in ((Automaton(halves[1]), halves[0]), (Automaton(halves[0]), halves[1]))
        for v in half)
    return Automaton(values), max(LEAST_FIT, fits[int(FIT_QUANTILE * (len(fits) - 1))] - MARGIN)


def find_base(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds ``base`` (spans by start, then kind), ``values`` (what the base matches hold) and
    ``candidates`` (tokens outside the base matches). Existing columns of these names
    are replaced. Null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                base, values, candidates = [], [], []
                for text in texts(part, column):
                    spans = base_spans(text)
                    base.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
                    values.append([{"kind": KINDS[k], "value": _value(text[s:e], k)} for s, k, e in spans])
                    candidates.append(list(_candidates(text, spans)))
                yield replaced(part, base=pa.array(base, _SPANS), values=pa.array(values, _VALUES),
                               candidates=pa.array(candidates, _TOKENS))

    return in_batches(df, run, with_fields(df.schema, *StructType.fromDDL(FOUND)))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_VALUES = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))
_TOKENS = pa.list_(pa.struct([("start", pa.int32()), ("token", pa.string())]))


def _value(found: str, kind: int) -> str:
    return ASSIGN.match(found)[2] if kind == 0 else found


def _candidates(text: str, spans: list[tuple[int, int, int]]) -> Iterator[dict]:
    """Both lists go from left to right, so one pass compares them."""
    k, reach = 0, 0  # spans before k start before what is left of the run; reach is how far they go
    for m in CANDIDATE.finditer(text):
        at = max(m.start(), reach)
        while k < len(spans) and spans[k][0] < m.end():
            if spans[k][0] - at >= LEAST_TOKEN:
                yield {"start": at, "token": text[at : spans[k][0]]}
            reach = max(reach, spans[k][2])
            at = max(at, reach)
            k += 1
        if m.end() - at >= LEAST_TOKEN:
            yield {"start": at, "token": text[at : m.end()]}


def learn(found: DataFrame) -> Formats:
    """Automata from the result of ``find_base``: a bounded sample of distinct values a kind.

    Sampled by hash, so the same values give the same automata in any order of rows. A kind
    with fewer than LEAST_VALUES has no automaton; without any, no candidate is a secret.
    """
    labelled = found.select(F.inline("values"))
    others = found.select(F.explode("candidates.token").alias("value"))
    formats = Formats([])
    for kind in KINDS:
        values = _sampled(labelled.where(F.col("kind") == kind))
        if len(values) >= LEAST_VALUES:
            formats.kinds.append(_format(values))
    if formats.kinds:
        for part in (F.length("value") < LONG, F.length("value") >= LONG):
            formats.other.append(Automaton([
                t for t in _sampled(others.where(part))
                if PLAIN.fullmatch(t) or formats.fitting(t) == float("-inf")]))
    return formats


def _sampled(rows: DataFrame) -> list[str]:
    order = F.xxhash64("value")
    picked = (
        rows.where(F.length("value") <= 512).groupBy("value").agg(F.lit(1).alias("one"))
        .orderBy(order, "value").limit(SAMPLE_ROWS).collect())
    return [r["value"] for r in picked]


def _with_learned(batches: Iterator[pa.RecordBatch], known: Formats) -> Iterator[pa.RecordBatch]:
    order = {k: i for i, k in enumerate((*KINDS, LEARNED))}
    for batch in batches:
        more: dict[int, list[dict]] = {}
        for row, start, size in _credentials(batch.column("candidates"), known):
            more.setdefault(row, []).append({"kind": LEARNED, "start": start, "end": start + size})
        spans = [
            sorted([*(base or []), *more.get(i, [])], key=lambda s: (s["start"], order[s["kind"]]))
            for i, base in enumerate(batch.column("base").to_pylist())]
        yield replaced(batch, spans=pa.array(spans, _SPANS))


def _credentials(candidates: pa.ListArray, known: Formats) -> Iterator[tuple[int, int, int]]:
    """(row, start, length) of the candidates that are credentials. Each distinct token is scored
    once, and only those found become Python objects together."""
    if not known.kinds:
        return
    rows, tokens = pc.list_parent_indices(candidates), candidates.flatten()
    for at in range(0, len(tokens), TOKENS_AT_ONCE):
        part = tokens.slice(at, TOKENS_AT_ONCE)
        coded = pc.struct_field(part, "token").dictionary_encode()
        is_one = pa.array([known.credential(t.as_py()) for t in coded.dictionary], pa.bool_())
        hits = pc.indices_nonzero(is_one.take(coded.indices))
        found = part.take(hits)
        for row, c in zip(rows.slice(at, TOKENS_AT_ONCE).take(hits).to_pylist(), found.to_pylist(), strict=True):
            yield row, c["start"], len(c["token"])


def _redacted(batches: Iterator[pa.RecordBatch], column: str, spans: str,
              mark: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, column):
            clean = []
            for text, found in zip(part.column(column).to_pylist(),
                                   part.column(spans).to_pylist(), strict=True):
                if text and found:
                    pieces, at = [], 0
                    for s in found:
                        if s["start"] >= at:
                            pieces += [text[at : s["start"]], mark]
                        at = max(at, s["end"])
                    text = "".join(pieces) + text[at:]
                clean.append(text)
            names = part.schema.names
            yield part.set_column(names.index(column), column, pa.array(clean, pa.string()))


def _spanned(found: DataFrame) -> StructType:
    return with_fields(found.schema, StructField("spans", found.schema["base"].dataType))


def add_learned(found: DataFrame, formats: Formats) -> DataFrame:
    """Adds ``spans``: the base ones and every candidate of a learned format, by start and kind."""
    shared = found.sparkSession.sparkContext.broadcast(formats)
    return in_batches(found, lambda b: _with_learned(b, shared.value), _spanned(found))


def redact(df: DataFrame, column: str = "text", spans: str = "spans", mark: str = "[SECRET]") -> DataFrame:
    """Puts ``mark`` in the place of every span of the text; overlapping ones become one."""
    return in_batches(df, lambda b: _redacted(b, column, spans, mark), df.schema)


def mask(found: DataFrame, formats: Formats, column: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``add_learned``, then ``redact``, in one pass with one Python worker a task."""
    shared = found.sparkSession.sparkContext.broadcast(formats)
    return in_batches(
        found, lambda b: _redacted(_with_learned(b, shared.value), column, "spans", mark), _spanned(found))


def joined(spans: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
