"""Language identification: sparse multinomial logistic regression on character n-grams.

Texts become TF-IDF vectors of hashed character n-grams. Document frequencies come from all
labelled documents that may be learned from; the weights from a bounded sample of them, by
follow-the-regularised-leader with L1 and L2 penalties; the temperature from the part of the
sample that the weights have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from fieldbeat.llm.shared import in_batches, lists, replaced, slices, texts, with_fields

#: Hash buckets of n-grams, and the lengths of n-grams.
BUCKETS_BITS = 14
BUCKETS = 1 << BUCKETS_BITS
LENGTHS = (1, 2, 3)
#: Labelled rows a language may bring to the sample: as many are expected, twice as many for all
#: languages together are the bound.
SAMPLE_ROWS = 500
#: One of so many sampled rows sets the temperature.
CALIBRATION = 5
ALPHA, BETA, L1, L2, EPOCHS, SEED = 0.5, 1.0, 0.002, 0.002, 4, 7
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a text's n-grams; empty if it has no letter.

    Lower case; every run of other characters than letters counts as one space.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    codes = np.where(letter, codes, 32)[kept].astype(np.uint64)
    counts = np.zeros(BUCKETS, np.int64)
    gram = np.zeros(len(codes), np.uint64)
    for length in range(1, max(LENGTHS) + 1):
        gram = (gram[: len(gram) - (length > 1)] << np.uint64(21)) ^ codes[length - 1 :]
        if length in LENGTHS and len(gram):
            mixed = (gram + np.uint64(length)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            bucket = (mixed >> np.uint64(64 - BUCKETS_BITS)).astype(np.int64)
            counts += np.bincount(bucket, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    """Languages in order, and per bucket the inverse document frequency and weights."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def vector(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[buckets]
        return x / max(np.sqrt(x @ x), 1e-12)

    def logits(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(buckets, counts) @ self.weights[buckets]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language (the first in order on a tie) and its probability."""
        buckets, counts = ngrams(text or "")
        if not len(buckets) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(buckets, counts) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max())
    return e / e.sum()


def train(languages: list[str], idf: np.ndarray,
          rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """The model from (language index, buckets, counts) rows."""
    model = Model(languages, idf, np.zeros((BUCKETS, len(languages))))
    held = rows[::CALIBRATION] if len(rows) >= 2 * CALIBRATION else []
    learned = [r for i, r in enumerate(rows) if not held or i % CALIBRATION]
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)
    shuffled = np.random.default_rng(SEED)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        rate = (BETA + np.sqrt(n[at])) / ALPHA + L2
        return -np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0) / rate

    vectors = [(y, at, model.vector(at, counts)) for y, at, counts in learned]
    for _ in range(EPOCHS):
        for k in shuffled.permutation(len(vectors)):
            y, at, x = vectors[k]
            w = weights(at)
            error = softmax(x @ w)
            error[y] -= 1
            g = np.outer(x, error)
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    model.weights = weights(slice(None))
    if held:
        model.temperature = _temperature(
            np.array([model.logits(at, counts) for _, at, counts in held]),
            np.array([y for y, _, _ in held]))
    return model


def _temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of the lowest log loss, by golden section on its logarithm."""

    def loss(log_t: float) -> float:
        scaled = logits / np.exp(log_t)
        scaled -= scaled.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(scaled).sum(axis=1)) - scaled[np.arange(len(truth)), truth]))

    low, high, golden = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Learns from the rows whose text and language are not null.

    ``key`` only decides which rows are sampled. Repeated rows count as often as they occur.
    Without any row, or any letter, the model knows no language.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"),
        F.xxhash64(F.col(key), F.lit(SEED)).alias("order"))
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for t in texts(part, "text"):
                    found[ngrams(t)[0]] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["bucket", "n"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                grams = [ngrams(t) for t in texts(part, "text")]
                sizes = [len(at) for at, _ in grams]
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), part.column("order")]
                    + [lists(np.concatenate([g[i] for g in grams]), sizes, pa.int32()) for i in (0, 1)],
                    ["lang", "order", "buckets", "counts"])

    n = sum(totals.values())
    df = np.zeros(BUCKETS)
    seen = in_batches(rows.select("text"), frequencies, "bucket long, n long")
    for r in seen.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        df[r["bucket"]] = r["n"]
    idf = np.log((1 + n) / (1 + df)) + 1

    share = F.create_map(*[
        x for name, total in totals.items() for x in (F.lit(name), F.lit(min(1.0, SAMPLE_ROWS / total)))])
    picked = rows.where(
        F.pmod(F.col("order"), F.lit(1 << 20)) < F.ceil(share[F.col("lang")] * (1 << 20)))
    sample = in_batches(
        picked, vectors, "lang string, order long, buckets array<int>, counts array<int>")
    bound = 2 * SAMPLE_ROWS * len(languages)
    index = {name: i for i, name in enumerate(languages)}
    rows_ = [
        (index[r["lang"]], np.array(r["buckets"], np.int64), np.array(r["counts"], np.int64))
        for r in sample.orderBy("order", "lang").limit(bound).collect() if r["buckets"]
    ]
    if not rows_:
        return Model([], idf, np.zeros((BUCKETS, 0)))
    return train(languages, idf, rows_)


def predict(df: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (0 to 1); existing columns of these names are replaced.

    ``und`` with score 0 where the text is null or has no letter, or the model knows no language.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in slices(batch, column):
                found = [known.predict(t) for t in texts(part, column)]
                yield replaced(part, lang_pred=pa.array([f[0] for f in found], pa.string()),
                               score=pa.array([f[1] for f in found], pa.float64()))

    fields = StructField("lang_pred", StringType()), StructField("score", DoubleType())
    return in_batches(df, run, with_fields(df.schema, *fields))


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: all but one in four by the checksum of their id."""
    return docs.where("crc32(cast(doc_id AS string)) % 4 != 2")
