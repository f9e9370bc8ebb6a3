"""Changes between snapshots and reach by rounds, case by case."""

from retail_lens.operators import changes


def test_differences_of_bags_nulls_and_hot_keys(spark):
    schema = "k long, a long, b string"
    before = [(1, 1, "x"), (2, 1, None), (3, 1, "x"), (4, 1, "x"), (4, 2, "y"), (5, 1, "x"), (None, 1, "x"), (7, None, "x"), (8, 1, "x"), (8, 1, "x")] + [(9, 1, "x")] * 500
    after = [(1, 1, "x"), (2, 1, ""), (3, 2, "x"), (4, 2, "y"), (4, 1, "x"), (6, 1, "x"), (None, 2, "x"), (7, None, "x"), (8, 1, "x")] + [(9, 1, "x")] * 500
    got = changes.differences(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema), ["k"], ["a", "b"])
    assert {r.k: r.change for r in got.collect()} == {2: "changed", 3: "changed", 5: "gone", 6: "new", None: "changed", 8: "changed"}
    none = spark.createDataFrame([], schema)
    assert changes.differences(none, none, ["k"], ["a"]).count() == 0


def test_reach_stops_at_rounds_target_or_nothing_new(spark):
    links = spark.createDataFrame([(i, i) for i in range(1, 9)] + [(i + 1, i) for i in range(1, 9)] + [(1, 1), (None, 1), (1, None), (50, 99), (51, 99)], "node long, via long")
    seeds = spark.createDataFrame([(1,), (1,), (None,)], "node long")
    go = lambda **x: {r.node: r["round"] for r in changes.reached(seeds, links, **x).collect()}
    assert go(rounds=3) == {1: 0, 2: 1, 3: 2, 4: 3} and go(rounds=99) == {i: i - 1 for i in range(1, 10)} and go(rounds=99, target=3) == {1: 0, 2: 1, 3: 2} and go(rounds=0) == {1: 0}
    assert changes.reached(seeds.limit(0), links, 3).count() == 0
