"""Stored slot maps: rebalanced by few moves, used again, and placing every row once."""

from __future__ import annotations

from collections import Counter

from tessera.llm import sharding

from .fixtures import empty, frame


def gapless(got) -> Counter:
    places = Counter((r["shard"], r["slot"]) for r in got)
    counts = Counter(s for s, _ in places)
    assert set(places) == {(s, i) for s, n in counts.items() for i in range(n)} and set(places.values()) == {1}
    return counts


def test_rebalance_moves_few_slots(spark, tmp_path):
    path = str(tmp_path / "map")
    first = sharding.store_map(sharding.deal(sharding.slot_sizes(sharding.records(frame(spark, [(i, "w" * (i % 50)) for i in range(3000)]))), 8), path)
    old = {r["virtual_slot"]: r["shard"] for r in first.collect()}
    assert len(old) == sharding.SLOTS and set(Counter(old.values())) == set(range(8))
    docs = frame(spark, [(i, "w" * (i % 50)) for i in range(3300)])
    rows = sharding.records(docs)
    sizes = {r["virtual_slot"]: r["slot_bytes"] for r in sharding.slot_sizes(rows).collect()}
    edited = sharding.store_map(sharding.rebalance(first, sharding.slot_sizes(rows), 8), path)
    new = {r["virtual_slot"]: r["shard"] for r in edited.collect()}
    assert {r["version"] for r in edited.collect()} == {2} and set(new) == set(old)
    assert sum(new[v] != old[v] for v in old) < 60
    loads = [sum(b for v, b in sizes.items() if new[v] == s) for s in range(8)]
    assert max(loads) - min(loads) <= max(sizes.values())
    got = sharding.shard_documents(docs, 8, map_path=path).collect()
    assert len(got) == docs.count() and {r["version"] for r in got} == {2} and all(r["shard"] == new[r["virtual_slot"]] for r in got)
    gapless(got)
    fewer = {r["virtual_slot"]: r["shard"] for r in sharding.rebalance(edited, sharding.slot_sizes(rows), 7).collect()}
    assert set(fewer) == set(old) and set(fewer.values()) == set(range(7))


def test_a_stored_map_is_used_again(spark, tmp_path):
    path = str(tmp_path / "map")
    small, large = frame(spark, [(i, "a") for i in range(50)]), frame(spark, [(i, "a") for i in range(900)])
    before = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(small, 8, map_path=path).collect()}
    for _ in range(2):
        got = sharding.shard_documents(large, 8, map_path=path).collect()
        assert len(got) == large.count() and sharding.load_map(spark, path).count() == sharding.SLOTS
        gapless(got)
        assert all(r["shard"] == before[r["doc_id"]] for r in got if r["doc_id"] in before)
    assert sharding.shard_documents(empty(spark), map_path=path).count() == 0
