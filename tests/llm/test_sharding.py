"""Resharding: the flow against brute force, and layouts that hold every row once, in even shards."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from retail_lens.llm import common, sharding
from tests.llm import helpers


def cheapest(supply, room, cost):
    """The least cost, by trying all ways to send each unit."""
    units = [i for i, s in enumerate(supply) for _ in range(s)]
    best = None
    for to in itertools.product(range(len(room)), repeat=len(units)):
        if all(to.count(j) <= r for j, r in enumerate(room)):
            c = sum(cost[i][j] for i, j in zip(units, to, strict=True))
            best = c if best is None else min(best, c)
    return best


def test_flow_is_cheapest():
    rng = np.random.default_rng(7)
    for _ in range(40):
        a, b = rng.integers(1, 4, 2)
        supply = rng.integers(0, 3, a).tolist()
        room = sharding.shares(sum(supply) + int(rng.integers(0, 3)), rng.random(b) + 0.1)
        cost = rng.integers(0, 6, (a, b)).astype(float)
        flow = sharding.min_cost_flow(supply, room, cost)
        assert flow.min() >= 0 and flow.sum(1).tolist() == supply and (flow.sum(0) <= room).all()
        assert (flow * cost).sum() == cheapest(supply, room, cost)
    with pytest.raises(ValueError, match="room"):
        sharding.min_cost_flow([3], [1, 1], np.zeros((1, 2)))
    big = sharding.min_cost_flow([10**15, 5, 0], [10**15 // 2, 10**15 // 2 + 5], np.array([[0, 1], [1, 0], [1, 1.0]]))
    assert big.tolist() == [[10**15 // 2, 10**15 // 2], [0, 5], [0, 0]]


def rows_of(df):
    return [(r.shard, r.slot, r.doc_id, r.text, r.size) for r in df.select("shard", "slot", "doc_id", "text", "size").collect()]


def laid_out(spark, rows, shard, weights, cost=None):
    """(layout before, rows before, layout after, rows after), whose rows are the same, in gapless slots."""
    before = sharding.write_layout(helpers.frame(spark, rows), shard, F.octet_length(F.coalesce("text", F.lit(""))) + 1, common.scratch_dir(spark, "layout"))
    after = sharding.reshard(spark, before, weights, cost)
    was, now = (rows_of(sharding.read_layout(spark, x)) for x in (before, after))
    for x in (was, now):
        assert sorted((r[2:4] for r in x), key=repr) == sorted((r[:2] for r in rows), key=repr)
        for s in {r[0] for r in x}:
            slots = sorted(r[1] for r in x if r[0] == s)
            assert slots == list(range(len(slots)))
    assert all(0 <= r[0] < len(weights) for r in now)
    return before, was, after, now


def sizes(rows, n):
    return [sum(r[4] for r in rows if r[0] == s) for s in range(n)]


ROWS = helpers.documents() + [(5, "twice", "en", "s", 0, "h", "r", "sc")] * 3 + [(None, "no id", "en", "s", 0, "h", "r", "sc")] * 2
EVEN = [(i, f"{i} " * (5 + i % 40), "en", "s", 0, "h", "r", "sc") for i in range(3000)]


def test_more_and_fewer_shards_and_rows_without_one(spark):
    largest = max(len((r[1] or "").encode()) for r in ROWS) + 1
    for shard, n in ((F.lit(None).cast("int"), 4), (F.lit(2), 5), (F.pmod(F.xxhash64("text"), F.lit(9)), 3), (F.lit(7), 1)):
        now = sizes(laid_out(spark, ROWS, shard, [1.0] * n)[3], n)
        assert max(now) <= sum(now) / n + largest


def test_shards_come_to_their_weights_and_only_the_excess_moves(spark):
    shard = F.when(F.col("doc_id") < 1800, 0).when(F.col("doc_id") < 2000, 1).otherwise(2)
    before, was, after, now = laid_out(spark, EVEN, shard, [2.0, 1.0, 1.0])
    old, new = sizes(was, 3), sizes(now, 3)
    want = sharding.shares(sum(old), [2.0, 1.0, 1.0])
    assert all(abs(a - b) <= 200 for a, b in zip(new, want, strict=True))
    at = {r[2]: r[0] for r in was}
    moved = sum(r[4] for r in now if at[r[2]] != r[0])
    assert abs(moved - sum(max(0, a - b) for a, b in zip(old, want, strict=True))) <= 600
    files = {r.file for r in sharding.manifest(spark, after).collect()}
    kept = {r.file for r in sharding.manifest(spark, before).collect() if r.shard == 1}
    assert kept <= files  # a shard that loses nothing keeps its files as they are
    assert sharding.reshard(spark, after, [new[0], new[1], new[2]]) == after  # it fits: nothing is written
    assert sizes(rows_of(sharding.read_layout(spark, before)), 3) == old  # the old manifest still stands


def test_whole_blocks_and_dear_transfers(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 64)
    cost = np.array([[0, 9, 1, 9], [9, 0, 9, 9]], float)
    _, was, after, now = laid_out(spark, EVEN, (F.col("doc_id") % 10 == 0).cast("int"), [1.0] * 4, cost)
    assert all(abs(s - sum(sizes(now, 4)) / 4) <= 200 for s in sizes(now, 4))
    again = sharding.reshard(spark, after, [1.0] * 2)  # a third generation, of two shards
    third = rows_of(sharding.read_layout(spark, again))
    assert again.generations == 3 and len(third) == len(EVEN) and abs(sizes(third, 2)[0] - sizes(third, 2)[1]) <= 200


def test_one_hot_row_key_is_split(spark):
    rows = [(1, "the same text " * 5, "en", "s", 0, "h", "r", "sc")] * 4000
    _, _, _, now = laid_out(spark, rows, F.lit(0), [1.0] * 8)
    assert max(sizes(now, 8)) - min(sizes(now, 8)) <= 2 * 71


def test_empty_tables_clashing_columns_and_too_many_shards(spark):
    df = spark.sql("SELECT 1L AS doc_id, 'ab' AS text, 'x' AS Shard, 9 AS SIZE, 'kept' AS slots, 'kept' AS file, 'kept' AS row, 'kept' AS to")
    path = lambda: common.scratch_dir(spark, "layout")
    layout = sharding.write_layout(df, F.lit(3), F.lit(-5), path())
    row = sharding.read_layout(spark, sharding.reshard(spark, layout, [1.0, 1.0])).first()
    assert (row.shard, row["size"], row.slots, row.file, row.to) == (0, 0, "kept", "kept", "kept")
    empty = sharding.write_layout(df.limit(0), F.lit(3), F.lit(1), path())
    assert sharding.read_layout(spark, sharding.reshard(spark, empty, [1.0, 1.0])).count() == 0
    with pytest.raises(ValueError, match="shards"):
        sharding.reshard(spark, layout, [1.0] * (sharding.MAX_SHARDS + 1))


def test_registered_query(spark):
    from retail_lens.llm.queries import queries

    sf = "/root/testdata/sf0.001"
    got = queries()["op12_sharding"](spark, sf).collect()
    want = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "octet_length(coalesce(text, '')) + 1L AS size", "crc32(coalesce(text, '')) AS text_crc32").collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == sorted(tuple(r) for r in want)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    for s in range(16):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - sum(r["size"] for r in got) / 16) <= max(r["size"] for r in own)
