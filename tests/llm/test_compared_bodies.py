"""Exact de-duplication shuffles the texts that it compares, and no others, at every size."""

from __future__ import annotations

import random

import pytest

from tessera.llm import exact_dedup

from .fixtures import collected

F = exact_dedup.F


@pytest.fixture
def threshold(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    yield lambda value: spark.conf.set(name, value)
    spark.conf.set(name, before)


def documents(spark, n):
    """``n`` texts, an eighth of which have a copy."""
    rng = random.Random(n)
    texts = [rng.randbytes(1500).hex() for _ in range(n)]
    return spark.createDataFrame([*enumerate(texts), *((n + i, t) for i, t in enumerate(texts[::8]))], "doc_id long, text string").repartition(4).localCheckpoint()


def shuffled(spark, run):
    """Bytes that the stages of ``run`` write to shuffles."""
    context = spark.sparkContext._jsc.sc()

    def total():
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_shuffles_grow_as_the_input(spark, threshold):
    small, large = documents(spark, 400), documents(spark, 2000)
    threshold("10m")  # the rows to compare fit a broadcast
    a = shuffled(spark, lambda: exact_dedup.exact_dedup(small).collect())
    threshold("-1")  # they don't
    b = shuffled(spark, lambda: exact_dedup.exact_dedup(large).collect())
    assert b < 7 * a, (a, b)
    assert b < 0.6 * 2250 * 3000, (a, b)


def test_results_beyond_the_broadcasts_limit(spark, threshold):
    threshold("-1")
    got = collected(exact_dedup.exact_dedup(documents(spark, 80)), "doc_id", "keep_id", "group_size", "kept")
    copy = {i: 80 + i // 8 for i in range(0, 80, 8)}
    keep = {i: copy.get(i, i) for i in range(90)}
    assert got == sorted(((i, keep[i], 2 if i in copy or i >= 80 else 1, keep[i] == i) for i in range(90)), key=repr)


@pytest.mark.parametrize("most", [exact_dedup.MOST_BITMAPS, 1])
def test_no_text_to_compare_is_filtered_out(spark, monkeypatch, most):
    monkeypatch.setattr(exact_dedup, "MOST_BITMAPS", most)
    bodies = spark.range(60000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("sha"))
    for step in (7, 60000, 60001):
        named = bodies.filter(f"id % {step} = {min(step, 60000) - 1}").select(F.col("sha").alias("_sha"))
        found = exact_dedup._likely(bodies, named)
        assert found.columns == bodies.columns
        ids = [r["id"] for r in found.select("id").collect()]
        wanted = {i for i in range(60000) if i % step == min(step, 60000) - 1}
        assert len(ids) == len(set(ids)) and wanted <= set(ids)
        if most > 1:
            assert len(ids) <= 1.2 * len(wanted) + 6000
