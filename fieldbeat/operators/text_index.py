"""An inverted index over trigrams, for searches by contained text.

Every three characters in a row of a text, in small letters, point to its row. A text that contains
a pattern has all trigrams of the pattern's literal parts, so a search reads the postings of these
few trigrams, meets the rows that have them all, and compares only these with the pattern. A
pattern without a literal part of three characters is compared with all rows. Results are the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbeat.functions.columns import like_pattern
from fieldbeat.sources.tables import Tables

GRAM = 3
POSTING = "gram string, field string, id string"
FIELDS = ("merchant_name", "region", "area", "category")


def _grams(text: Column) -> Column:
    """The distinct trigrams of a text; none for a shorter or null one."""
    count = F.length(text) - (GRAM - 1)
    places = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(GRAM))))


def postings(table: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(gram, field, id): a row for each trigram of each field of a row."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), _grams(F.lower(F.col(f))).alias("grams")) for f in fields])
    rows = table.select("id", F.inline(each))
    return rows.select(F.explode("grams").alias("gram"), "field", "id")


def write_index(table: DataFrame, path: str, fields: Sequence[str] = FIELDS) -> None:
    """Stores the postings by trigram, so that a search opens only the files that have its own. A
    trigram with very many rows is split by the rows' ids."""
    postings(table, fields).repartitionByRange("gram", "id").sortWithinPartitions("gram", "field").write.mode(
        "overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTING).parquet(path)


def pattern_grams(pattern: str) -> list[str]:
    """Trigrams that every match of an ILIKE pattern has. Only ASCII ones, whose small letters are
    the same everywhere."""
    parts, escaped = [""], False
    for char in pattern:
        if not escaped and char in "%_":
            parts.append("")
        elif not escaped and char == "\\":
            escaped = True
            continue
        else:
            parts[-1] += char
        escaped = False
    grams = {p[i : i + GRAM].lower() for p in parts for i in range(len(p) - GRAM + 1)}
    return sorted(g for g in grams if g.isascii())


def candidates(tables: Tables, index: DataFrame, text: str, fields: Sequence[str] = FIELDS) -> Tables:
    """The tables with only those merchants of which a field may contain the text: for any search
    of ``merchants`` that compares these fields. All of them if the text has no trigram."""
    grams = pattern_grams(like_pattern(text))
    if not grams:
        return tables
    wanted = index.where(F.col("gram").isin(grams) & F.col("field").isin(*fields))
    ids = wanted.groupBy("field", "id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
    return tables.replace(merchants=tables.merchants.join(ids.select("id").distinct(), "id", "left_semi").select(
        tables.merchants.columns))
