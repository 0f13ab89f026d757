"""Organisational mining on logs that the registered ones don't cover."""

from eventloom.operators import org


def test_similarity_of_resources_without_a_common_activity(spark):
    rows = [("x", "r1")] * 3 + [("y", "r2")] * 2 + [("x", "r3"), ("y", "r3"), ("y", "r3"), ("z", "r3")]
    got = {(r.a, r.b): r.similarity for r in org.similar_activities(spark.createDataFrame(rows, "activity string, resource string")).collect()}
    assert got == {("r1", "r2"): -0.5, ("r1", "r3"): -0.5, ("r2", "r3"): 1.0}
