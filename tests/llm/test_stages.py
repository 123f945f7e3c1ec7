"""Every stage of the pipeline on awkward rows against a brute-force version, and on empty tables."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tessera.llm import packing, quality, secrets

from .fixtures import empty, frame
from .test_linking import brute
from .test_operators import brute_components, brute_fingerprint, check_packing, sha

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("labels")
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(None, 1, None), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def whole(df):
    return Counter(tuple(r) for r in df.collect())


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_quality(spark, folder):
    docs = frame(spark)
    scores = quality.score_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"), with_digest=True).collect()
    good = {(r["doc_id"], r["text_sha256"]) for r in scores if r["predicted"]}
    want = Counter(tuple(r) for r in docs.collect() if (r["doc_id"], sha(r["text"] or "")) in good)
    assert whole(STAGES["quality classifier"](spark, docs, folder)) == want


def test_exact_copies(spark, folder):
    docs = frame(spark)
    groups = defaultdict(list)
    for i, t in rows(docs):
        groups[t or ""].append(i)
    want = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    got = rows(STAGES["exact dedup"](spark, docs, folder))
    assert len(got) == len(want) and {t or "": i for i, t in got} == want


def test_near_copies(spark, folder):
    docs = frame(spark)
    found = rows(docs)
    roots = brute_components(sorted({brute_fingerprint(t or "") for _, t in found}))
    groups = defaultdict(list)
    for i, t in found:
        groups[roots[brute_fingerprint(t or "")]].append((i is None, i or 0, sha(t or "")))
    want = sorted(min(g) for g in groups.values())
    got = STAGES["SimHash near-dedup"](spark, docs, folder)
    assert sorted((i is None, i or 0, sha(t or "")) for i, t in rows(got)) == want and got.columns == docs.columns


def test_masked_secrets(spark, folder):
    docs = frame(spark)
    want = Counter()
    for r in docs.collect():
        out, at, text = "", 0, r["text"] or ""
        spans = brute(text)
        for a, _, b in spans:
            if a >= at:
                out += text[at:a] + secrets.MASK
            at = max(at, b)
        new = out + text[at:]
        want[tuple({**r.asDict(), **({"text": new, "n_chars": len(new)} if spans else {})}.values())] += 1
    assert whole(STAGES["secret scans"](spark, docs, folder)) == want


def test_packed(spark, folder):
    docs = frame(spark)
    used, least = check_packing(STAGES["best-fit packing"](spark, docs, folder).collect(), [(i, t or "") for i, t in rows(docs)], packing.SEQUENCE)
    assert used <= least + 1


def test_empty_tables_pass_every_stage(spark, folder):
    docs = empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0, name
        if name != "best-fit packing":
            assert out.columns == docs.columns
