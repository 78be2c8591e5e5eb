"""What the plans must and must not contain."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from fieldbeat.functions.joins import left_join_many, split_join
from fieldbeat.operators import context, merchants
from fieldbeat.operators.changes import apply_status_updates
from fieldbeat.operators.scope import Caller
from fieldbeat.plans.queries import QUERIES
from tests.small import AS_OF, MODEL, NOW

SF_DIR = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# These store before they read: their jobs run while the query is built, and what is left is a read.
# ``test_kept_rollups`` and ``test_buckets`` look at the plans that do the work.
STORED = {"s05_kept", "s05_kept_dsps", "s05_kept_dashboards", "s03_bucketed", "s04_bucketed", "m07_bucketed"}
PLANNED = [name for name in QUERIES if name not in STORED]


@pytest.fixture(scope="module")
def plans(spark):
    # Without broadcasts, as for tables of any size.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    texts = {name: physical(contract.queries()[name](spark, SF_DIR)) for name in PLANNED}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return texts


@pytest.mark.parametrize("name", PLANNED)
def test_no_python_and_no_cross_join(plans, name):
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval",
                 "BatchEvalPython", "MapInPandas", "FlatMapGroups"):
        assert node not in plans[name], node


@pytest.mark.parametrize("name", ["q03_prioritized_manager", "q05_history_manager", "q13_manager"])
def test_manager_scope_is_a_semi_join(plans, name):
    assert "LeftSemi" in plans[name]


@pytest.mark.parametrize("name", [
    "q03_prioritized_all", "q03_prioritized_manager", "q03_prioritized_dsp", "q04_details_all",
    "q04_details_manager", "q02_roll_forward", "q23_chat_all"])
def test_top_rows_are_cut_before_the_shuffle(plans, name):
    assert "Partial" in plans[name] and "WindowGroupLimit" in plans[name]


@pytest.mark.parametrize("name", ["q03_prioritized_admin", "q09_visits", "q10_search", "q11_audit",
                                  "q21_users", "q23_chat"])
def test_limits_are_top_k(plans, name):
    assert "TakeOrderedAndProject" in plans[name]


def test_dashboards_read_few_columns_and_rank_nothing(plans):
    assert "row_number" not in plans["q14_admin"]
    assert "o_totalprice" not in plans["q14_admin"]


def test_filters_and_columns_reach_the_scan(plans):
    scan = next(line for line in plans["q18_visits_admin"].splitlines() if "events.parquet" in line)
    assert "GreaterThanOrEqual(ts" in scan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in scan


def final_plan(df) -> str:
    df.collect()
    return physical(df).split("== Initial Plan ==")[0]


@pytest.fixture
def small_skew_limits(spark):
    """Limits at which a few thousand rows count as a large, skewed shuffle partition."""
    limits = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {name: spark.conf.get(name, None) for name in limits}
    for name, value in limits.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def hot_and_grouped(spark):
    """Rows of which a third has one key, and a table grouped by the key."""
    rows = spark.range(0, 60_000, 1, 8).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("k0"))
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 2000).cast("string"))).alias("k"))
    info = spark.range(0, 4000, 1, 8).groupBy(
        F.concat(F.lit("k"), (F.col("id") % 2000).cast("string")).alias("k")).agg(F.count("*").alias("n"))
    return rows, info


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_hot_keys_are_split(spark, small_skew_limits, how):
    rows, info = hot_and_grouped(spark)
    assert "skew=true" in final_plan(split_join(rows, info, "k", how))
    assert "skew=true" not in final_plan(rows.join(info, "k", how))    # what it is for


def test_hot_right_sides_are_split(spark, small_skew_limits):
    rows, info = hot_and_grouped(spark)
    assert "skew=true" in final_plan(left_join_many(info, rows, "k"))


def test_status_changes_of_one_recommendation_are_split(spark, make_tables, small_skew_limits):
    batch = spark.range(0, 30_000, 1, 8).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, F.lit("r01"))
        .otherwise(F.concat(F.lit("r1"), F.col("id").cast("string"))).alias("rec_id"),
        F.lit("DONE").alias("status"), F.lit("u04").alias("user_id"), F.lit("DSP").alias("role"))
    result = apply_status_updates(make_tables(**MODEL), batch, AS_OF, NOW)
    assert "skew=true" in final_plan(result.rejects)
    assert result.rejects.count() == 20_000 and result.visits.count() == 10_000
    assert result.table.where("status = 'Done'").count() == 3


@pytest.fixture
def hot_merchant(spark, make_tables):
    """A third of the recommendations, scores and visits belongs to one merchant."""
    tables = make_tables(**MODEL)

    def many(table, n=60_000):
        number = F.when(F.col("n") % 3 == 0, F.lit("01")).otherwise(
            F.concat(F.lit("9"), (F.col("n") % 2000).cast("string")))
        rows = spark.range(0, n, 1, 8).withColumnRenamed("id", "n").withColumn(
            "merchant_id", F.concat(F.lit("m"), number))
        given = {"id": F.concat(F.lit(PREFIX[table]), F.col("n").cast("string")), "merchant_id": F.col("merchant_id"),
                 "dsp_id": F.lit("u04"), "visit_date": F.date_sub(F.lit(AS_OF), (F.col("n") % 900).cast("int")),
                 "score_date": F.date_sub(F.lit(AS_OF), (F.col("n") / 3).cast("int")),
                 "recommendation_date": F.date_sub(F.lit(AS_OF), (F.col("n") % 90).cast("int"))}
        schema = getattr(tables, table).schema
        return rows.select(*[
            given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    return tables.replace(**{t: many(t) for t in PREFIX})


PREFIX = {"recommendations": "r", "daily_scores": "ds", "visit_history": "vh"}


def wanted(spark):
    return spark.range(0, 3000, 1, 4).select(
        F.when(F.col("id") == 0, F.lit("m01")).otherwise(F.concat(F.lit("m"), F.col("id").cast("string")))
        .alias("merchant_id"))


def test_hot_merchants_of_scoped_reads_are_split(spark, hot_merchant, small_skew_limits):
    caller = Caller("u02", "Manager")
    assert "skew=true" in final_plan(merchants.merchant_details(hot_merchant, caller, AS_OF))
    assert "skew=true" in final_plan(merchants.merchant_history(hot_merchant, caller, wanted(spark)))
    context_plan = final_plan(context.brief_context(hot_merchant, caller, AS_OF, wanted(spark)))
    assert "skew=true" in context_plan


def test_context_reads_visits_at_most_twice(spark, plans):
    query = contract.queries()["q25_context"](spark, SF_DIR)
    query.collect()
    plan = physical(query).split("== Initial Plan ==")[0]
    assert sum("events.parquet" in line for line in plan.splitlines()) <= 2
