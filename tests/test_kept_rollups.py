"""Kept roll-ups against the full ones, over batches and interruptions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldbeat.operators import dashboards, manager
from fieldbeat.plans import kept_rollups
from fieldbeat.plans.kept_rollups import KeptRollups
from tests.small import AS_OF, MODEL

RESULTS = "seq long, rec_id string, status string"
GIVEN = "seq long, merchant_id string, assigned_dsp_id string"


@pytest.fixture
def tables(make_tables):
    return make_tables(**MODEL)


@pytest.fixture
def kept(spark, tables, tmp_path):
    made = KeptRollups(spark, str(tmp_path / "kept"), 4)
    made.create(tables, AS_OF)
    return made


def content(df):
    return sorted(str(r.asDict()) for r in df.collect())


def assert_kept(kept, tables):
    users = tables.users
    assert content(kept.area_summary()) == content(manager.area_summary(tables, AS_OF))
    assert content(kept.dsp_performance(users)) == content(manager.dsp_performance(tables, AS_OF))
    for role in ("DSP", "Manager"):
        assert content(kept.dashboards_for_all(users, role)) == content(
            dashboards.dashboards_for_all(tables, role, AS_OF))


def with_statuses(make_tables, changes):
    """The model after the changes (rec_id, status), in order."""
    last = {f"r0{n}": status for n, status in changes}
    recs = [{**r, "status": last.get(r["id"], r["status"])} for r in MODEL["recommendations"]]
    return make_tables(**{**MODEL, "recommendations": recs})


def results(make_df, changes):
    return make_df(RESULTS, [{"seq": i, "rec_id": f"r0{n}", "status": s} for i, (n, s) in enumerate(changes)])


def test_statuses_batch_after_batch(kept, tables, make_df, make_tables):
    done = []
    # Twice changed in a batch, there and back, of another day, unknown, and with no row on the day.
    for n, batch in enumerate([[(2, "Done"), (4, "New"), (2, "Deferred")], [(2, "New"), (5, "New"), (9, "Done")],
                               [(6, "Done"), (7, "Done"), (8, "New")], []]):
        before = with_statuses(make_tables, done)
        changes = kept_rollups.status_changes(before, results(make_df, batch), AS_OF)
        assert kept.take_statuses(changes, f"b{n}")
        assert not kept.take_statuses(changes, f"b{n}")
        done += batch
        after = with_statuses(make_tables, done)
        assert content(kept.area_summary()) == content(manager.area_summary(after, AS_OF))
    assert_kept(kept, after)


def test_a_dsp_that_loses_all_merchants_no_longer_counts(kept, make_df, make_tables):
    moved = {"m03": "u04", "m05": "u08"}
    given = make_df(GIVEN, [
        {"seq": 1, "merchant_id": "m03", "assigned_dsp_id": "u06"},
        *[{"seq": 2, "merchant_id": m, "assigned_dsp_id": u} for m, u in moved.items()],
        {"seq": 3, "merchant_id": "m99", "assigned_dsp_id": "u04"}])
    assert kept.take_assignments(kept_rollups.assignments(given), "a")
    merchants = [{**m, "assigned_dsp_id": moved.get(m["id"], m["assigned_dsp_id"])} for m in MODEL["merchants"]]
    after = make_tables(**{**MODEL, "merchants": merchants})
    assert content(kept.area_summary()) == content(manager.area_summary(after, AS_OF))
    back = make_df(GIVEN, [{"seq": 1, "merchant_id": "m03", "assigned_dsp_id": "u05"},
                           {"seq": 2, "merchant_id": "m05", "assigned_dsp_id": "u06"}])
    assert kept.take_assignments(kept_rollups.assignments(back), "b")
    assert_kept(kept, make_tables(**MODEL))


@pytest.mark.parametrize("dies", ["sums", "merchants"])
def test_a_batch_that_dies_on_the_way_is_applied_once(kept, tables, make_df, make_tables, monkeypatch, dies):
    batch = [(2, "Done"), (4, "Deferred"), (6, "In Progress")]
    changes = kept_rollups.status_changes(tables, results(make_df, batch), AS_OF)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(getattr(kept, dies), "_write", lost)
        with pytest.raises(RuntimeError, match="lost"):
            kept.take_statuses(changes, "a")
    assert kept.take_statuses(changes, "a")
    after = with_statuses(make_tables, batch)
    assert content(kept.area_summary()) == content(manager.area_summary(after, AS_OF))


def test_only_touched_merchants_are_written(kept, tables, make_df):
    from tests.test_buckets import files

    before = files(kept.merchants)
    changes = kept_rollups.status_changes(tables, results(make_df, [(2, "Done")]), AS_OF)
    assert kept.take_statuses(changes, "a")
    assert len({b for b, found in files(kept.merchants).items() if found != before.get(b)}) == 1


def test_plan_of_the_difference(spark, kept, tables, make_df):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        changes = kept_rollups.status_changes(tables, results(make_df, [(2, "Done")]), AS_OF)
        rows = kept.merchants.rows()
        more = changes.select("id", F.col("done").alias("_done"))
        new = rows.join(more, "id", "left").withColumn("done", F.col("done") + F.coalesce("_done", F.lit(0)))
        difference = kept_rollups.add((kept_rollups.sums(new), 1), (kept_rollups.sums(rows), -1))
        plan = difference._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval", "MapInPandas"):
        assert node not in plan
    assert "Bucketed: true" in plan and "partial_sum" in plan


def test_no_merchants(spark, make_tables, make_df, tmp_path):
    tables = make_tables(users=MODEL["users"])
    made = KeptRollups(spark, str(tmp_path / "kept"), 4)
    made.create(tables, AS_OF)
    made.take_statuses(kept_rollups.status_changes(tables, results(make_df, [(2, "Done")]), AS_OF), "a")
    assert_kept(made, tables)
