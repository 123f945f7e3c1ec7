"""Sampled segmentations: stored and long segments, windows, whole texts, and the inclusion of every sample."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import subwords

from .fixtures import empty, frame, texts
from .test_operators import brute_segmentations


def samples(keys, rows, k=3):
    return [[(round(a, 6), round(b, 3), s.tolist()) for a, b, _, s in found] for found in subwords.sample_batch(keys, rows, k)]


@pytest.fixture
def fresh():
    subwords._store.cache_clear()
    yield
    subwords._store.cache_clear()


ROWS = [t.encode() for t in filter(None, texts())] + ["naïve ▁ café ".encode() * 40, b"ab\x00c d\n\n\te", "日本語のテキスト 한국어".encode() * 9]


def test_batches_windows_and_a_full_store_change_nothing(fresh, monkeypatch):
    keys = list(range(len(ROWS)))
    whole = samples(keys, ROWS)
    alone = [samples([k], [t])[0] for k, t in zip(keys, ROWS)]
    assert alone == whole
    monkeypatch.setattr(subwords, "WINDOW", 37)
    monkeypatch.setattr(subwords, "ROOM", 600)
    monkeypatch.setattr(subwords, "SLICE", 100)
    assert samples(keys, ROWS) == whole


@pytest.mark.parametrize("long, stretch", [(0, 64 << 10), (0, 7), (30, 50)])
def test_long_segments_are_sampled_alike(fresh, monkeypatch, long, stretch):
    keys = list(range(len(ROWS)))
    want = subwords.sample_batch(keys, ROWS, 3)
    subwords._store.cache_clear()
    monkeypatch.setattr(subwords, "LONG", long)
    monkeypatch.setattr(subwords, "STRETCH", stretch)
    got = subwords.sample_batch(keys, ROWS, 3)
    for a, b in zip(want, got):
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert x[3].tolist() == y[3].tolist() and abs(x[1] - y[1]) < 1e-2 and abs(x[0] - y[0]) < 1e-3


def test_chances_sum_to_one_over_every_segmentation(fresh):
    for text in ("ab", "the a", "né 😀", "aaaa", "▁a"):
        chances = brute_segmentations(text)
        found = subwords.sample_batch([5], [text.encode()], len(chances) + 2)[0]
        assert {tuple(s[3].tolist()) for s in found} == set(chances)
        assert abs(sum(np.exp(s[1]) for s in found) - 1) < 1e-5


def test_a_long_unbroken_text_comes_back(fresh):
    rng = random.Random(4)
    for text in ("a" * 200_000, "".join(rng.choice("etaoin") for _ in range(300_000))):
        found = subwords.sample_batch([1], [text.encode()], 3)[0]
        assert len({s[3].tobytes() for s in found}) == 3
        for s in found:
            data, _ = subwords.decoded(s[3], np.array([0, len(s[3])]))
            assert data[1:].tobytes() == text.encode()


def test_rows_of_awkward_documents(spark):
    docs = frame(spark)
    got = subwords.sample_segmentations(docs, keep_ids=True).collect()
    for r in got:
        assert r["n_pieces"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["round_trip"]
        assert r["log_prob"] <= 1e-4 and r["log_inclusion"] <= 0
    by_row = Counter((r["doc_id"], r["sample"]) for r in got)
    rows = Counter(r["doc_id"] for r in docs.collect())
    assert all(by_row[i, 0] == n for i, n in rows.items())
    back = {(r["doc_id"], subwords.decode(r["ids"])) for r in got}
    assert back == {(r["doc_id"], r["text"] or "") for r in docs.collect()}
    assert subwords.sample_segmentations(empty(spark), keep_ids=True).count() == 0
