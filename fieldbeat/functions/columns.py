"""Column expressions shared by the operators. All are built-in, code-generated functions."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIGH_PRIORITY = 70


def make_id(prefix: str, number: Column) -> Column:
    """``prefix`` and the number; numbers below 10 get one leading zero."""
    pad = F.when(number < 10, F.lit("0")).otherwise(F.lit(""))
    return F.concat(F.lit(prefix), pad, number.cast("string"))


def id_number(column: Column, prefix: str) -> Column:
    """The number behind the prefix. Fails on any other id, and on a number beyond a long,
    rather than losing or changing its row."""
    digits = F.substr(column, F.lit(len(prefix) + 1))
    number = F.when(column.rlike(f"^{prefix}[0-9]+$"), digits.try_cast("bigint"))
    malformed = F.raise_error(F.concat(F.lit("malformed id: "), column)).cast("bigint")
    return F.when(column.isNotNull(), F.coalesce(number, malformed))


LOW_BITS, HIGH_BITS = 45, 18


def pack(high: Column, low: Column) -> Column:
    """One sort key from two non-negative numbers: by ``high`` (below 2**18), then by ``low``
    (below 2**45). Fails on any other number, which would run into the other one or the sign.
    """

    def checked(number: Column, bits: int) -> Column:
        outside = F.raise_error(F.lit(f"number not in 0 to 2**{bits}")).cast("bigint")
        return F.when((number >= 0) & (number < 2**bits), number.cast("bigint")).when(
            number.isNotNull(), outside)

    return F.shiftleft(checked(high, HIGH_BITS), LOW_BITS) + checked(low, LOW_BITS)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON object with all its columns, nulls included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def day(value: date) -> Column:
    return F.lit(value).cast("date")


def instant(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def null_if_zero(column: Column) -> Column:
    return F.when(column != 0, column)


def like_pattern(text: str) -> str:
    """Pattern for "contains ``text``"; ``%`` and ``_`` in the text stay wildcards.

    SQL takes ``\\x`` as a plain ``x``, where Spark raises an error unless ``x`` is
    a wildcard or a backslash, so those backslashes are dropped here. A backslash at
    the very end quotes the closing ``%``, in both.
    """
    out, chars = [], iter(f"%{text}%")
    for char in chars:
        if char == "\\":
            quoted = next(chars, "")
            out.append(char + quoted if quoted in ("%", "_", "\\") else quoted)
        else:
            out.append(char)
    return "".join(out)


def contains_text(column: Column, text: str) -> Column:
    return column.ilike(like_pattern(text))


def clean_name(text: str) -> str:
    """Strips quotes and spaces around a name typed by a person or passed by a tool."""
    return text.strip("'\" ")


def clamp(limit: int, cap: int) -> int:
    return max(1, min(limit, cap))


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` with one decimal, half away from zero; null if ``whole`` is 0."""
    ratio = (part * 100).cast("decimal(20,0)") / F.nullif(whole, F.lit(0)).cast("decimal(18,0)")
    return F.round(ratio, 1).cast("decimal(10,1)")


def mean_score(total: Column, count: Column) -> Column:
    """Two-decimal mean from an exact sum and a count.

    ``avg`` on decimals keeps six decimals and rounds twice, which flips the second
    decimal in large groups; sum and count do not.
    """
    mean = total.cast("decimal(20,2)") / F.nullif(count, F.lit(0)).cast("decimal(18,0)")
    return F.round(mean, 2).cast("decimal(5,2)")
