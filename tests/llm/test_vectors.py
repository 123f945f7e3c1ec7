"""Word vectors, document vectors and the network's probabilities, computed again one by one."""

from __future__ import annotations

import math
import re

import numpy as np

from tessera.llm import common, quality

from .fixtures import frame

TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\x20\x09-\x0dA-Za-z0-9\x80-\xff]+")


def bucket(token: bytes) -> int:
    value = sum((b + 1) * pow(0x5851F42D4C957F2D, i, 1 << 64) for i, b in enumerate(token))
    value = (value + len(token) * 0x9E3779B97F4A7C15) % (1 << 64)
    return int(common.mix(np.array([value], np.uint64))[0]) % quality.BUCKETS


def documents(spark):
    docs = frame(spark)
    return docs, [[bucket(t) for t in TOKEN.findall((r["text"] or "").encode())] for r in docs.collect()], [(r["text"] or "").encode() for r in docs.collect()]


def brute_vectors(tokens):
    sums = {}
    index = quality.index_vectors()
    assert (np.abs(index).sum(axis=1) == quality.NONZERO).all()
    for row in tokens:
        for i, b in enumerate(row):
            for j in range(max(0, i - quality.REACH), min(len(row), i + quality.REACH + 1)):
                if j != i:
                    sums[b] = sums.get(b, 0) + index[row[j]]
    return {b: v / max(np.linalg.norm(v), 1e-9) for b, v in sums.items()}, index


def test_word_and_document_vectors(spark):
    docs, tokens, texts = documents(spark)
    want, index = brute_vectors(tokens)
    got = quality.word_vectors(docs)
    for b in range(quality.BUCKETS):
        assert np.allclose(got[b], want.get(b, 0), atol=1e-5)
    vecs = {(r["doc_id"], bytes(r["vec"])) for r in quality.document_vectors(docs, got).collect()}
    for (doc_id, row), text in zip(zip([r["doc_id"] for r in docs.collect()], tokens), texts):
        expected = np.zeros(quality.WIDTH)
        if row:
            expected[: quality.DIM] = np.mean([want.get(b, np.zeros(quality.DIM)) for b in row], axis=0)
            expected[quality.DIM : 2 * quality.DIM] = np.mean([index[b] for b in row], axis=0)
            for j, step in enumerate((1, 2)):
                expected[2 * quality.DIM + 5 + j] = sum(a == b for a, b in zip(row, row[step:])) / len(row)
        if text:
            blank, digit, upper = (len(re.findall(p, text)) for p in (rb"[\x20\x09-\x0d]", rb"[0-9]", rb"[A-Z]"))
            mark = len(re.findall(rb"[^\x20\x09-\x0dA-Za-z0-9\x80-\xff]", text))
            expected[2 * quality.DIM : 2 * quality.DIM + 5] = [blank / len(text), digit / len(text), mark / len(text), upper / len(text), math.log1p(len(text)) / 10]
        assert any(i == doc_id and np.allclose(np.frombuffer(v, "<f4"), expected, atol=2e-4) for i, v in vecs), text[:60]


def test_probabilities_of_the_network():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + rng.normal(size=400) * 0.3 > 0).astype(float)
    net = quality.Network(x, y, epochs=5)
    for row, p in zip(x[:20], net(x[:20])):
        z = [(v - m) / s for v, m, s in zip(row, net.mean, net.scale)]
        hidden = [math.tanh(sum(a * w for a, w in zip(z, column)) + b) for column, b in zip(net.weights[0].T, net.weights[1])]
        logit = sum(h * w for h, w in zip(hidden, net.weights[2])) + float(net.weights[3])
        assert abs(p - 1 / (1 + math.exp(-logit / net.temperature))) < 1e-9
    assert 0.25 <= net.temperature <= 8
