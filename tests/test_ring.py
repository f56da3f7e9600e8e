"""Placement, failover and health."""

import pytest

from shardloom.config import Shard, from_mapping
from shardloom.errors import NotFoundError, ParseError, UnhealthyError
from shardloom.plans.cluster import Cluster
from shardloom.plans.ring import Ring, place, skew

KEYS = [f"SYM-{i:04d}" for i in range(2000)]


def test_tokens_follow_weight_and_nodes():
    assert len(Ring([Shard(1, weight=2, virtual_nodes=10), Shard(2, virtual_nodes=10)])) == 30
    assert len(Ring([Shard(1, weight=0, virtual_nodes=0)])) == 1


def test_placement_is_stable_and_uses_all_shards():
    ring = Ring([Shard(1), Shard(2), Shard(3)])
    assert {ring.shard_of(k) for k in KEYS} == {1, 2, 3}
    assert [ring.shard_of(k) for k in KEYS] == [Ring([Shard(3), Shard(1), Shard(2)]).shard_of(k) for k in KEYS]


def test_weights():
    ring = Ring([Shard(1, weight=3, virtual_nodes=64), Shard(2, virtual_nodes=64)])
    owned = [ring.shard_of(k) for k in KEYS]
    assert 2.0 <= owned.count(1) / owned.count(2) <= 4.0


def test_removing_a_shard_moves_its_keys_only():
    whole, less = Ring([Shard(1), Shard(2), Shard(3)]), Ring([Shard(1), Shard(2)])
    assert all(whole.shard_of(k) == less.shard_of(k) for k in KEYS if whole.shard_of(k) != 3)


def test_failover():
    ring = Ring([Shard(1), Shard(2), Shard(3)])
    for k in KEYS[:200]:
        own = ring.shard_of(k)
        other = ring.failover(k, {own})
        assert other not in (own, None) and other == ring.failover(k, {own})
    assert ring.failover("x", {1, 2, 3}) is None
    assert Ring([]).shard_of("x") is None


def test_column_and_join_agree_with_the_ring(spark):
    ring = Ring([Shard(1), Shard(2, weight=2), Shard(7)])
    df = spark.createDataFrame([(k,) for k in KEYS[:300]], "symbol string")
    for found in (place(df, ring, "symbol"), df.withColumn("_shard", ring.column(df["symbol"]))):
        assert {r["symbol"]: r["_shard"] for r in found.collect()} == {k: ring.shard_of(k) for k in KEYS[:300]}


def test_skew_of_many_keys(spark):
    ring = Ring([Shard(1), Shard(2)])
    df = spark.createDataFrame([(k,) for k in KEYS], "symbol string")
    row = skew(df.withColumn("_shard", ring.column(df["symbol"]))).first()
    assert row["total"] == len(KEYS) and row["cv"] <= 0.15


def test_health():
    config = from_mapping({"shards": [{"id": 1}, {"id": 2}], "routing": {"shard_key": "symbol"}}, {"SHARDLOOM__HEALTH__MIN_HEALTHY_SHARDS": "2"})
    c = Cluster.of(config)
    assert c.report(1, read=True) is c
    down = c.report(1, read=False)
    assert down.excluded() == {1} and down.excluded("write") == set() and c.excluded() == set()
    with pytest.raises(UnhealthyError):
        down.healthy()
    with pytest.raises(NotFoundError):
        c.report(9, read=False)
    with pytest.raises(ParseError):
        from_mapping({"shards": [{"id": 1}, {"id": 1}]}, {})


def test_failover_through_the_cluster():
    c = Cluster.of(from_mapping({"shards": [{"id": 1}, {"id": 2}]}, {})).report(1, read=False)
    assert {c.shard_of(k).id for k in KEYS[:50]} == {2}
