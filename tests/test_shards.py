import pytest

from gaugeflow.operators.shards import rank_blocks, running_total


def test_blocks_cover_each_row_once_and_know_their_neighbours(spark):
    df = spark.range(100).selectExpr("id % 10 as k", "id as v").repartition(7)
    rows = rank_blocks(df, ["k", "v"], block_rows=8, halo=3).collect()
    core = sorted((r.pos, r.k, r.v) for r in rows if r.core)
    assert [p for p, _, _ in core] == list(range(100))
    assert [(k, v) for _, k, v in core] == sorted((i % 10, i) for i in range(100))
    for block in {r.block for r in rows if r.core}:
        own = {r.pos for r in rows if r.block == block}
        first, last = min(p for p in own if p // 8 == block), max(p for p in own if p // 8 == block)
        assert own == set(range(max(first - 3, 0), min(last + 4, 100)))


def test_blocks_refuse_less_than_two_halos(spark):
    with pytest.raises(ValueError):
        rank_blocks(spark.range(3), ["id"], 4, 3)


@pytest.mark.parametrize("groups", [["g"], []])
def test_running_total(spark, groups):
    df = spark.range(1000).selectExpr("if(id % 3 = 0, null, id % 3) as g", "id as v").repartition(5)
    got = {(r.g, r.v): r.s for r in running_total(df, groups, ["v"], "v", "s").collect()}
    sums, expected = {}, {}
    for v in range(1000):
        g = v % 3 or None
        at = g if groups else 0
        sums[at] = sums.get(at, 0) + v
        expected[g, v] = sums[at]
    assert got == expected


def test_running_total_of_nothing(spark):
    assert running_total(spark.range(0), [], ["id"], "id", "s").count() == 0
