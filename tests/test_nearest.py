"""The nearest point against all distances, where the sphere is awkward and where points crowd."""

import math
import random

from pyspark.sql import functions as F

from retail_lens.operators import customers
from retail_lens.operators import nearest as op
from retail_lens.plans.facts import facts


def miles(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 3958.8 * math.asin(min(1.0, math.sqrt(h)))


def plain(queries, points, radius):
    out = []
    for q, lat, lng, skip in queries:
        if lat is None or lng is None:
            out.append((q, None, None, None))
            continue
        away = [(round(miles(lat, lng, p[2], p[3]), 6), p[1], p[0], miles(lat, lng, p[2], p[3])) for p in points if p[2] is not None and p[3] is not None and (skip is None or p[0] != skip)]
        first = min(away, default=(None, None))
        out.append((q, first[1], first[0], sum(a[3] <= radius for a in away)))
    return sorted(out, key=lambda r: r[0])


def held(spark, queries, points, radius, monkeypatch=None):
    q = spark.createDataFrame(queries, "q_id long, lat double, lng double, skip long")
    p = spark.createDataFrame(points, "key long, name string, lat double, lng double")
    got = op.nearest(q, p, radius)
    assert got.columns == ["q_id", "lat", "lng", "skip", "nearest", "nearest_key", "nearest_miles", "nearby"]
    got = sorted((r.q_id, r.nearest, r.nearest_miles, r.nearby) for r in got.collect())
    want = plain(queries, points, radius)
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want]
    assert all(g[2] == w[2] or abs(g[2] - w[2]) <= 2e-6 for g, w in zip(got, want, strict=True))


def test_poles_date_line_ties_and_missing_places(spark, monkeypatch):
    monkeypatch.setattr(op, "LEAF", 2)
    rng = random.Random(3)
    odd = [(90, 0), (90, 77), (-90, 10), (89.9, -170), (-89.99, 45), (0, 180), (0, -180), (0.1, 179.95), (-0.1, -179.95), (45, 0), (45, 90), (51.5, -0.1)]
    points = [(i, f"n{i % 7}", float(a), float(b)) for i, (a, b) in enumerate(odd)]
    points += [(100 + i, f"n{i:03}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)] + [(300, "lost", None, 5.0), (301, "lost", 5.0, None)]
    points += [(400 + i, f"same{9 - i}", 10.0, 20.0) for i in range(9)] + [(3, "again", 12.0, 21.0)]
    queries = [(i, float(a), float(b), i if i % 2 else None) for i, (a, b) in enumerate(odd)]
    queries += [(100 + i, rng.uniform(-90, 90), rng.uniform(-180, 180), 100 + i % 60) for i in range(40)]
    queries += [(200, None, 1.0, None), (201, 1.0, None, 4), (202, 10.0, 20.0, 409), (203, 10.0, 20.0, 408), (203, 10.0, 20.0, 408), (204, 10.0, 20.5, None), (205, 0.0, 0.0, 12345)]
    for radius in (15.0, 900.0, 30000.0):
        held(spark, queries, points, radius)


def test_crowds_far_away_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(op, "LEAF", 8)
    rng = random.Random(4)
    crowd = [(i, f"c{i}", 40 + rng.random() / 50, -74 + rng.random() / 50) for i in range(400)] + [(1000 + i, f"hot{i}", 40.01, -73.99) for i in range(300)]
    queries = [(i, 40 + rng.random() / 20, -74 + rng.random() / 20, i) for i in range(50)] + [(90, -40.0, 106.0, None), (91, 0.0, 0.0, 5), (92, 40.01, -73.99, 1000), (93, 40.01, -73.99, None)]
    held(spark, queries, crowd, 1.0)
    held(spark, queries[:3], [], 1.0)
    held(spark, [], crowd[:5], 1.0)
    held(spark, [(1, 5.0, 5.0, 7)], [(7, "only itself", 5.0, 5.0)], 1.0)


def test_a_query_meets_few_nodes_and_no_join_is_without_keys(spark):
    points = spark.range(4000).selectExpr("id AS key", "concat('p', id) AS name", "-60 + (id * 37 % 1200) / 10D AS lat", "-170 + (id * 61 % 3400) / 10D AS lng")
    tree = op.quadtree(points)
    assert len(tree.levels) == 2 and tree.spots.agg(F.sum("n")).first()[0] == 4000
    assert max(r["n"] for r in tree.spots.groupBy("depth", "cell").agg(F.count("*").alias("n")).collect()) <= op.LEAF
    assert facts(op._spots(points)).products == 0
    plan = op._spots(points)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # ranks are cut before the shuffle, and after


def test_places_that_many_share_meet_once(spark):
    """40 x 3,000 shops and people in a few places: pairs are of places, and every row counts."""
    shops = spark.range(40).select("id", (30 + F.col("id") % 4 / 10).alias("lat"), F.lit(-100.0).alias("lng"))
    people = spark.range(3000).select((30 + F.col("id") % 3).alias("c_lat").cast("double"), F.when(F.col("id") % 3 < 2, -100.0).alias("c_lng"))
    got = customers.nearby(shops, people, 15.0)
    assert sorted((r.id, r.within, round(r.nearest, 1)) for r in got.collect()) == [(i, 1000, round(i % 4 * 6.90943, 1)) for i in range(40) if i % 4 < 3]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.find("count(1) AS n") > plan.find("Join Inner, ((row")  # people are counted below the join of cells
