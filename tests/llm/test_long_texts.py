"""One text of twenty million bytes, its copy and a shorter copy of its start, through every operator."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from tessera.llm import exact_dedup, packing, quality, secrets, sharding, simhash, substrings, subwords, telephony, tokens

SIZE = 20_000_000


@pytest.fixture(scope="module")
def text():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(2, 10))) for _ in range(30_000)]
    out, size = [], 0
    while size < SIZE:
        out.append(rng.choice(vocabulary))
        size += len(out[-1].encode()) + 1
    return " ".join(out)


@pytest.fixture(scope="module")
def docs(spark, text, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long") / "documents.parquet")
    rows = [(1, text), (2, text[: SIZE // 4] + " tail"), (3, text), (4, "short text"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_lengths_and_packing(docs, text):
    n = len(tokens.encode(text))
    histogram = {r["length"]: r["docs"] for r in tokens.length_histogram(docs).collect()}
    assert histogram[n] == 2 and sum(histogram.values()) == 5
    pieces = [r for r in packing.pack(docs).collect() if r["doc_id"] == 1]
    assert sum(r["length"] for r in pieces) == n + 1 and len(pieces) == -(-(n + 1) // packing.SEQUENCE)


def test_samples(docs, text):
    got = [r for r in subwords.sample_segmentations(docs).collect() if r["doc_id"] in (1, 3)]
    assert len(got) == 6 and all(r["round_trip"] for r in got) and len({(r["doc_id"], r["ids_crc32"]) for r in got}) == 6


def test_duplicates(docs, text):
    near, exact = by_id(simhash.near_duplicates(docs)), by_id(exact_dedup.exact_dedup(docs))
    assert near[1]["fingerprint"] == near[3]["fingerprint"] == f"{simhash.fingerprint(text):016x}" and near[3]["component_id"] == 1
    assert (exact[1]["keep_id"], exact[1]["group_size"], exact[1]["kept"]) == (3, 2, False) and exact[3]["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    cut = by_id(substrings.drop_repeats(docs))
    words = len(text.encode().split())
    assert (cut[1]["n_words"], cut[1]["n_removed"]) == (words, 0) and (cut[3]["n_words"], cut[3]["n_removed"]) == (words, words)
    assert cut[2]["n_words"] - cut[2]["n_removed"] <= 2


def test_the_rest(spark, docs, text):
    size = len(text.encode())
    placed = by_id(sharding.shard_documents(docs))
    assert placed[1]["size"] == size + 1 and placed[1]["text_crc32"] == zlib.crc32(text.encode())
    media = by_id(telephony.decode_audio(telephony.store_audio(docs)))
    assert media[1]["payload_sha256"] == hashlib.sha256(telephony.payload(text.encode())).hexdigest() and media[1]["n_bytes"] == size and media[1]["feature"] == media[3]["feature"]
    assert by_id(secrets.find_secrets(docs))[1]["spans"] == ""
    scores = by_id(quality.score_quality(docs, spark.createDataFrame([(1, 1), (2, 1), (4, 0), (5, 0)], "doc_id long, quality int")))
    assert scores[1]["score"] == scores[3]["score"] and len(scores) == 5
