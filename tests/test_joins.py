"""Joins that must not put what grows with the input into one place."""

from rawframe.plans import catalogue, frames


def _plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_gathered_knots_are_not_broadcast(spark):
    for query in (frames.lens_gains, frames.lens_warps):
        assert "Broadcast" not in _plan(query(spark, "/root/testdata/sf0.001"))


def test_knots_are_made_where_their_lens_is(spark):
    own, knots = frames._lenses(spark, "/root/testdata/sf0.1")
    assert own.rdd.getNumPartitions() == knots.rdd.getNumPartitions() == 4
    for query in (frames.lens_gains, frames.lens_warps):
        exchanges = [line for line in _plan(query(spark, "/root/testdata/sf0.1")).splitlines() if "Exchange" in line]
        assert exchanges and all("REPARTITION_BY_NUM" in line for line in exchanges)


def test_profiles_are_judged_once_a_kind_of_picture(spark):
    plan = catalogue.profile_select(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    assert windows and not any("picture" in line for line in windows)
