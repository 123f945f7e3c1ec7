"""Two writers of one version of a slot map, and a map of an empty table."""

from __future__ import annotations

import pytest

from tessera.llm import sharding

from .fixtures import empty, frame


def test_a_version_has_one_writer(spark, tmp_path):
    path = str(tmp_path / "map")
    rows = sharding.records(frame(spark, [(i, "w" * (i % 50)) for i in range(500)]))
    first = sharding.store_map(sharding.deal(sharding.slot_sizes(rows), 8), path)
    grown, moved = sharding.grow(first, 8), sharding.rebalance(first, sharding.slot_sizes(rows), 5)
    sharding.store_map(grown, path)
    with pytest.raises(FileExistsError):
        sharding.store_map(moved, path)
    latest = sharding.load_map(spark, path)
    assert latest.count() == sharding.SLOTS and {r["version"] for r in latest.collect()} == {2} and {r["shard"] for r in latest.collect()} == set(range(9))
    assert sharding.load_map(spark, path, 1).count() == sharding.SLOTS
    assert not [f for f in (tmp_path / "map").iterdir() if f.name.startswith("_draft")]


def test_a_map_of_nothing(spark, tmp_path):
    path = str(tmp_path / "map")
    assert sharding.shard_documents(empty(spark), map_path=path).count() == 0
    docs = frame(spark)
    assert sharding.shard_documents(docs, map_path=path).count() == docs.count()
