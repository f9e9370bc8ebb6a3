"""Order statistics against pandas and the statistics module, with one group of half of all values."""

import random
import statistics

import pandas as pd
import pytest

from retail_lens import ranks


@pytest.fixture(scope="module")
def values():
    rng = random.Random(5)
    rows = [("hot", round(rng.gauss(100, 40), 1)) for _ in range(3000)] + [("one", 7.0), ("two", 3.0), ("two", 1.0), ("same", 5.0), ("same", 5.0), ("same", 5.0), ("same", 5.0), (None, 2.0), (None, 4.0), ("nothing", None)]
    rows += [(f"g{i % 40}", None if rng.random() < 0.1 else float(rng.randint(-20, 20))) for i in range(3000)]
    rng.shuffle(rows)
    return rows


def by_group(values):
    out = {}
    for g, v in values:
        if v is not None:
            out.setdefault(g, []).append(v)
    return {g: sorted(v) for g, v in out.items()}


def test_quartiles_and_quantiles_of_groups_of_any_size(spark, values):
    df = spark.createDataFrame(values, "g string, v double").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        r = ranks.ranked(df, ["g"], "v")
        got = r.groupBy("g").agg(*(ranks.exclusive_quartile("v", i, 6).alias(f"e{i}") for i in (1, 2, 3)), *(ranks.quantile("v", p).alias(f"q{int(p * 100)}") for p in (0.0, 0.1, 0.5, 1.0))).collect()
        hot = r.where("g = 'hot'").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = by_group(values)
    assert {x.g for x in got} == set(want)
    for x in got:
        v = want[x.g]
        if len(v) >= 4:
            assert [x.e1, x.e2, x.e3] == pytest.approx(statistics.quantiles(v, n=4, method="exclusive"), abs=2e-6)
        else:
            assert [x.e1, x.e2, x.e3] == [v[0], statistics.median(v), v[-1]]
        assert [x.q0, x.q10, x.q50, x.q100] == pytest.approx([pd.Series(v).quantile(p) for p in (0, 0.1, 0.5, 1)])
    assert {(x.v, x.before, x.n, x.total) for x in hot} == {(v, want["hot"].index(v), want["hot"].count(v), 3000) for v in set(want["hot"])}


def test_percentile_ranks_equal_pandas(spark, values):
    rng = random.Random(6)
    rows = [(i, values[i][1], rng.choice([1.0, 2.0, None]), None) for i in range(500)]
    got = ranks.percentile_ranks(spark.createDataFrame(rows, "i long, a double, b double, c double"), "i", ["a", "b", "c"]).toPandas().set_index("i").sort_index()
    want = pd.DataFrame(rows, columns=["i", "a", "b", "c"]).set_index("i").astype(float).rank(pct=True)
    want = want[want.notna().any(axis=1)]
    pd.testing.assert_frame_equal(got.astype(float), want.rename(columns=lambda c: f"rank_{c}"), check_names=False)


def test_no_rows_and_no_list_of_a_group(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert ranks.ranked(empty, ["g"], "v").count() == 0
    plan = ranks.ranked(spark.range(100).selectExpr("id % 2 AS g", "id AS v"), ["g"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan
    spans = [line for line in plan.splitlines() if "Window" in line and "span" not in line]
    assert all("own" in line for line in spans)  # only the spans' sums meet by group alone


def test_spans_have_bounded_rows_however_many_there_are(spark, monkeypatch):
    """One group of 400 values in spans of about 20, more than the session has shuffle partitions."""
    from retail_lens import ranks

    monkeypatch.setattr(ranks, "TASK_ROWS", 20)
    seen, saved = [], ranks.saved
    monkeypatch.setattr(ranks, "saved", lambda df, name: seen.append((name, saved(df, name))) or seen[-1][1])
    r = ranks.ranked(spark.range(800).selectExpr("'g' AS g", "id % 400 AS v"), ["g"], "v").collect()
    assert sorted((x.v, x.n, x.before, x.total) for x in r) == [(i, 2, 2 * i, 800) for i in range(400)]
    assert dict(seen)["spans"].select("span").distinct().count() > 10
