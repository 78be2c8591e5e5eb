"""From raw documents to token ids, in five stages.

Every stage takes all documents the one before has kept. The first four return the columns of
documents, whatever these are: what a stage computes stays apart from them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbeat.llm import bpe, decontam, langid, queries, secrets, simhash
from fieldbeat.llm.shared import pack, stage, unpack

#: Least probability of the predicted language.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no text, no letter, or no language likelier than the
    rest together. Where no row has a label to learn from, nothing can be told and all stay."""
    model = langid.fit(langid.learnable(docs))
    if not model.languages:
        return docs
    told = langid.predict(pack(docs, "text"), model)
    return unpack(told.where(F.col("score") >= LEAST_SCORE), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the lowest id, null last. Of
    repeated ids the first row stays."""
    prints = simhash.fingerprints(pack(docs, "text", "doc_id"), words=queries.SIMHASH_WORDS)
    prints = stage(prints.withColumn("order", F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id",
        F.monotonically_increasing_id().alias("row"))))
    best = simhash.groups(prints.select("fingerprint", "order"), "order", queries.SIMHASH_BITS)
    kept = best.select(F.col("lowest.row").alias("row")).distinct()
    rows = prints.withColumn("row", F.col("order.row")).join(kept, "row", "left_semi")
    return unpack(rows, docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    told = decontam.contaminated(pack(docs, "text"), benchmark)
    return unpack(told.where(F.col("coverage").isNull()), docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; ``n_chars`` follows the changed texts."""
    found = stage(secrets.find_base(pack(docs, "text")))
    masked = secrets.mask(found, secrets.learn(found)).drop("base", "values", "candidates")
    length = F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("rest.n_chars"))
    return unpack(masked, docs.columns,
                  n_chars=length.cast(docs.schema["n_chars"].dataType))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text they decode to."""
    ranks = bpe.read_ranks(queries.RANKS_FILE)
    coded = bpe.encode_and_decode(
        docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mask_secrets", mask_secrets),
    ("tokenize", tokenize),
]

#: The learned stages, Gray-order links, tiling and merges have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's result written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = step(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs)
    return docs
