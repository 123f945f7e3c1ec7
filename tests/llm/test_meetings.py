"""Fingerprints of giant buckets meet at values: the same components as by all pairs."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import components, simhash

from .test_operators import brute_components


def clustered() -> set[int]:
    rng = np.random.default_rng(12)
    points = {int(x) for x in rng.integers(0, 2**63, 15, dtype=np.uint64)} | {0, 2**64 - 1}
    for center in list(points)[:4]:
        for _ in range(40):
            x = center
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(b)
            points.add(x)
    return points


def groups(roots: dict[int, int]) -> list[list[int]]:
    out = defaultdict(list)
    for p, r in roots.items():
        out[r].append(p)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("part, meeting", [(2048, 1), (8, 3), (8, 2146)])
def test_components_by_meetings(spark, part, meeting):
    points = clustered()
    df = spark.createDataFrame([(simhash._signed(p),) for p in points], "fp long")
    roots = {r["node"]: r["root"] for r in components.components(simhash.links(df, part=part, meeting=meeting)).collect()}
    assert groups({p: roots.get(simhash._signed(p), simhash._signed(p)) for p in points}) == groups(brute_components(sorted(points)))


def test_meetings_join_no_distant_pair(spark):
    points = clustered()
    df = spark.createDataFrame([(simhash._signed(p),) for p in points], "fp long")
    found = simhash.meetings(df).collect()
    assert found and all(((r["u"] ^ r["v"]) & (2**64 - 1)).bit_count() <= simhash.RADIUS for r in found)
    assert simhash.meetings(df.limit(0)).count() == 0


def test_the_values_counted():
    assert len(simhash._within(2)) + len(simhash._within(1)) == simhash.MEETING
