"""One row of each group of near copies, and no other text, whatever its doc_id."""

from __future__ import annotations

from collections import Counter

from tessera.llm import exact_dedup, simhash

from .fixtures import empty, frame

T = " ".join(f"word{i}" for i in range(60))
OTHER = " ".join(f"other{i * i}" for i in range(50))


def kept(spark, rows):
    docs = frame(spark, rows, repeated=False)
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    return sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)


def test_a_shared_doc_id_keeps_its_other_text(spark):
    assert kept(spark, [(1, T), (5, T), (5, OTHER)]) == [(1, T), (5, OTHER)]


def test_ties_repeats_and_null_ids_leave_one_row(spark):
    assert kept(spark, [(3, T), (3, T), (None, T), (None, OTHER), (None, OTHER)]) == [(3, T), (None, OTHER)]
    near = T.upper()  # of equal fingerprint
    assert [i for i, _ in kept(spark, [(4, near), (4, T), (9, near)])] == [4]
    assert kept(spark, [(2, None), (1, ""), (7, " \n")]) == [(1, "")]


def test_empty_tables(spark):
    for stage in (simhash.keep_one, exact_dedup.keep_one):
        assert stage(empty(spark)).count() == 0 and stage(empty(spark)).columns == empty(spark).columns


def test_long_texts_count_every_shingle(monkeypatch):
    text = " ".join(f"w{i * 7919 % 1013}" for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "COUNTED", 17)
    assert simhash.fingerprint(text) == whole


def test_rows_of_awkward_documents(spark):
    docs = frame(spark)
    found = Counter(r["component_id"] for r in simhash.near_duplicates(docs).collect())
    null = found.pop(None)  # the two texts without ids are no copies of any other
    assert null == 2 and simhash.keep_one(docs).count() == len(found) + null
