"""Held-out accuracy of the classifier, and the pipeline against its brute-force stages."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import packing, quality, secrets, tokens
from tessera.llm.common import stash

from .fixtures import empty, frame
from .test_operators import brute_components, brute_fingerprint, brute_linked, check_packing


@pytest.fixture(scope="module")
def medium():
    return "/root/testdata/sf0.01"


def test_held_out_accuracy(spark, medium):
    docs, labels = spark.read.parquet(f"{medium}/documents.parquet"), spark.read.parquet(f"{medium}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [i for i in truth if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) >= 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}


def test_labels_of_the_held_out_fold_change_nothing(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    score = lambda known: sorted((r["doc_id"], r["score"]) for r in quality.score_quality(docs, known).collect())
    assert score(labels) == score(flipped)


def test_quality_of_awkward_rows(spark):
    docs = frame(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(None, 1, None), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs, some).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (0, 1, 2, 3)}) == 1
    assert quality.score_quality(empty(spark), some).count() == 0
    assert quality.keep_good(empty(spark), some).count() == 0


def test_network_is_calibrated():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 6))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rng.random(4000) < p).astype(float)
    net = quality.Network(x, y, epochs=15)
    assert abs(net(x).mean() - y.mean()) < 0.05 and np.abs(net(x) - p).mean() < 0.1


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stash(stage(spark, tables[-1], sf_dir), name.replace(" ", "-")))
    assert all(t.columns == docs.columns for t in tables[:-1])
    after = [{r["doc_id"]: r["text"] for r in t.collect()} for t in tables[:-1]]
    scores = quality.score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    assert after[1] == {r["doc_id"]: rows[r["doc_id"]] for r in scores if r["predicted"]}
    last = {t: max(i for i, x in after[1].items() if x == t) for t in after[1].values()}
    assert after[2] == {i: t for t, i in last.items()}
    prints = {i: brute_fingerprint(t) for i, t in after[2].items()}
    roots = brute_components(sorted(set(prints.values())))
    least = defaultdict(lambda: 10**18)
    for i, f in prints.items():
        least[roots[f]] = min(least[roots[f]], i)
    assert after[3] == {i: after[2][i] for i in least.values()}
    for i, t in after[3].items():
        out, at = "", 0
        for a, _, b in brute_linked(t):
            if a >= at:
                out += t[at:a] + secrets.MASK
            at = max(at, b)
        assert after[4][i] == out + t[at:]
    assert after[4].keys() == after[3].keys()
    used, lowest = check_packing(tables[-1].collect(), list(after[4].items()), packing.SEQUENCE)
    assert used <= lowest + 2
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sum(r["length"] for r in whole.collect()) == sum(len(tokens.encode(t)) + 1 for t in after[4].values())
