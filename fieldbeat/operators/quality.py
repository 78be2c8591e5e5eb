"""Integrity checks and the profile of the tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbeat.functions.columns import day
from fieldbeat.functions.joins import narrow
from fieldbeat.operators.manager import area_summary
from fieldbeat.schema import RULES, Rules
from fieldbeat.sources.tables import Tables


def _row_rules(rules: Rules) -> list[tuple[str, str | None, Column]]:
    """(rule, parent, value) per rule on single rows: the offending value as text, empty for a
    missing one, and null where the row keeps the rule. References all give their value: whether
    ``parent`` has it is looked up later."""
    found = [(f"{c} not null", None, F.when(F.col(c).isNull(), F.lit(""))) for c in rules.not_null]
    found += [
        (f"{c} allowed", None, F.when(~F.col(c).isin(*values), F.col(c)))
        for c, values in rules.allowed.items()
    ]
    found += [
        (f"{c} length", None, F.when(F.char_length(c) > length, F.col(c)))
        for c, length in rules.max_length.items()
    ]
    return found + [(f"{c} in {parent}", parent, F.col(c)) for c, parent in rules.references.items()]


def ruled_columns(name: str) -> list[str]:
    """The columns of a table that its rules read."""
    rules = RULES[name]
    return sorted({c for key in rules.unique for c in key}.union(
        rules.not_null, rules.allowed, rules.references, rules.max_length))


def _broken_rows(name: str, table: DataFrame) -> DataFrame:
    """(table_name, rule, parent, value, n): rows that break rules on single rows, counted per value,
    and all references, which have a ``parent``."""
    rules, parents, values = zip(*_row_rules(RULES[name]), strict=True)
    met = F.filter(
        F.array(*[F.struct(F.lit(at).alias("at"), v.alias("value")) for at, v in enumerate(values)]),
        lambda rule: rule["value"].isNotNull())
    counted = table.select(F.inline(met)).groupBy("at", "value").agg(F.count("*").alias("n"))

    def named(texts: Sequence[str | None]) -> Column:
        return F.get(F.array(*[F.lit(t).cast("string") for t in texts]), F.col("at"))

    rule = named(rules)
    return counted.select(
        F.lit(name).alias("table_name"), rule.alias("rule"), named(parents).alias("parent"),
        F.when(~rule.endswith(" not null"), F.col("value")).alias("value"), "n")


def _without_known(broken: DataFrame, ids: DataFrame) -> DataFrame:
    """Leaves out the references that ``ids`` (parent, value) has.

    An outer join, because Spark would push an anti join below the union of tables and read the
    ids once for each of them.
    """
    known = ids.distinct().withColumn("_known", F.lit(True))
    return broken.join(known, ["parent", "value"], "left").where(F.col("_known").isNull()).select(
        "table_name", "rule", "value", "n")


def _ids(table: DataFrame, parent: str) -> DataFrame:
    return table.select(F.lit(parent).alias("parent"), F.col("id").alias("value"))


def _same_keys(name: str, key: tuple[str, ...], counted: DataFrame) -> DataFrame:
    return counted.where(F.col("n") > 1).select(
        F.lit(name).alias("table_name"), F.lit(f"{','.join(key)} unique").alias("rule"),
        F.concat_ws(",", *key).alias("value"), "n")


def check_constraints(tables: Tables, names: tuple[str, ...] = tuple(RULES)) -> DataFrame:
    """(table_name, rule, value, n): broken keys, references, value sets, lengths and nulls.

    ``value`` is the offending value and ``n`` its number of rows. Every rule counts rows
    per value first, so a value on many rows is one row before it is joined or reported. A
    table is read once for all rules on single rows and references, once for each key, and once
    for its ids if others refer to them.
    """
    broken = reduce(DataFrame.unionByName, [_broken_rows(name, getattr(tables, name)) for name in names])
    parents = {parent for name in names for parent in RULES[name].references.values()}
    if parents:
        broken = _without_known(broken, reduce(DataFrame.unionByName, [
            _ids(getattr(tables, parent), parent) for parent in sorted(parents)]))
    return reduce(DataFrame.unionByName, [
        _same_keys(name, key, getattr(tables, name).dropna(subset=list(key)).groupBy(*key).agg(
            F.count("*").alias("n")))
        for name in names for key in RULES[name].unique
    ], broken.select("table_name", "rule", "value", "n"))


def check_batch(tables: Tables, added: Mapping[str, DataFrame]) -> DataFrame:
    """What ``check_constraints`` would say of the rows that a batch adds, by table name.

    Of a key ``n`` counts all its rows, stored or added, else the added rows with the value.
    Only the added rows are checked. Stored tables are read for the keys and ids that the batch
    names: by a semi join on their hashes, so a small batch does not shuffle them, and a large
    one lets Spark filter them by a Bloom filter of these hashes.
    """
    broken = reduce(DataFrame.unionByName, [_broken_rows(name, rows) for name, rows in added.items()])
    ids, on_keys = [], []
    for parent in sorted({p for name in added for p in RULES[name].references.values()}):
        named = reduce(DataFrame.unionByName, [
            rows.select(F.col(c).alias("value")) for name, rows in added.items()
            for c, p in RULES[name].references.items() if p == parent])
        ids.append(narrow(_ids(getattr(tables, parent), parent), named, "value"))
        if parent in added:
            ids.append(_ids(added[parent], parent))
    if ids:
        broken = _without_known(broken, reduce(DataFrame.unionByName, ids))
    for name, rows in added.items():
        for key in RULES[name].unique:
            new = rows.select(*key).dropna()
            stored = narrow(getattr(tables, name).select(*key).dropna(), new, *key)
            counted = new.withColumn("_new", F.lit(1)).unionByName(stored.withColumn("_new", F.lit(0)))
            on_keys.append(_same_keys(name, key, counted.groupBy(*key).agg(
                F.count("*").alias("n"), F.max("_new").alias("_new")).where(F.col("_new") == 1)))
    return reduce(DataFrame.unionByName, on_keys, broken.select("table_name", "rule", "value", "n"))


def _count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.asc_nulls_last(column))


def users_by_role(tables: Tables, as_of: date) -> DataFrame:
    return _count_by(tables.users, "role")


def merchants_by_tier(tables: Tables, as_of: date) -> DataFrame:
    return _count_by(tables.merchants, "tier")


def merchants_by_region(tables: Tables, as_of: date) -> DataFrame:
    return _count_by(tables.merchants, "region")


def signals_today(tables: Tables, as_of: date) -> DataFrame:
    signals = tables.merchant_signals.where(F.col("signal_date") == day(as_of))
    return signals.agg(F.count("*").alias("n"))


def top_merchants(tables: Tables, as_of: date) -> DataFrame:
    scores = tables.daily_scores.where(F.col("score_date") == day(as_of))
    names = tables.merchants.select(F.col("id").alias("merchant_id"), "merchant_name", "tier")
    return scores.join(names, "merchant_id").orderBy(F.asc_nulls_last("rank")).limit(5).select(
        "merchant_name", "tier", "priority_score", "rank")


def recommendation_status(tables: Tables, as_of: date) -> DataFrame:
    return _count_by(
        tables.recommendations.where(F.col("recommendation_date") == day(as_of)), "status")


def areas(tables: Tables, as_of: date) -> DataFrame:
    order = [F.asc_nulls_last("region"), F.asc_nulls_last("area")]
    return area_summary(tables, as_of).orderBy(*order).limit(5)


# The seven sanity reports over the tables, each from (tables, as_of).
PROFILE: dict[str, Callable[[Tables, date], DataFrame]] = {
    report.__name__: report
    for report in (
        users_by_role, merchants_by_tier, merchants_by_region, signals_today, top_merchants,
        recommendation_status, areas,
    )
}
