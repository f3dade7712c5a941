"""Nodes many steps away."""

from traceloom.operators.graph import reachable


def test_reachable_has_no_limit_of_steps(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(20, 0), (5, 5), (40, 41)], "src long, dst long")
    roots = spark.createDataFrame([(0,)], "node long")
    assert {(r.node, r.depth) for r in reachable(spark, edges, roots).collect()} == {(i, i) for i in range(21)}
    assert reachable(spark, edges, roots, most=3).count() == 4
    nations = spark.createDataFrame([(n, (2 * n + 1) % 25) for n in range(25)], "src long, dst long")
    assert reachable(spark, nations, spark.createDataFrame([(3,)], "node long")).count() == 20
