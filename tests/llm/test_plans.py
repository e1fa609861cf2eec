"""What the driver has to hold: the size of the plans of problem 4, the stages of problem 2."""

from test_groups import brute, shapes
from weftline.llm import components, survivor


def test_plans_of_groups_stay_small(spark, monkeypatch):
    """No plan reads more tables than a few and one per phase."""
    leaves = []
    kept = components.written
    monkeypatch.setattr(components, "written", lambda df: (leaves.append(df._jdf.queryExecution().analyzed().collectLeaves().size()), kept(df))[1])
    links = shapes(3)
    got = {r.record_id: r.group_id for r in components.connected_groups(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == brute(links) and max(leaves) <= 16


def test_found_survivors_take_no_vote(spark, sf_dir, monkeypatch):
    """Every stage of the query counts: the order alone decides, so nothing is aligned."""
    monkeypatch.setattr(survivor, "_round", lambda *a: (_ for _ in ()).throw(AssertionError("a vote without effect")))
    plan = survivor.p2_found(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan
