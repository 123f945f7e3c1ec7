"""The classifier's decision holds for rows with null and repeated ids."""

from __future__ import annotations

from collections import Counter

from tessera.llm import quality

from .fixtures import frame


def test_rows_go_by_their_own_text(spark):
    good, bad = "plain words of a clear sentence about rivers", "zz zz zz zz zz click click click"
    rows = [(i, f"{good if i % 2 else bad} {i}") for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    docs = frame(spark, [*rows, (None, bad + " 500"), (None, good + " 501"), (700, good + " 502"), (700, bad + " 503")], repeated=False)
    scored = {r["text_sha256"]: r["predicted"] for r in quality.score_quality(docs, labels, with_digest=True).collect()}
    assert set(scored.values()) == {0, 1}
    kept = Counter(r["text"] for r in quality.keep_good(docs, labels).collect())
    for text in (r["text"] for r in docs.collect()):
        assert kept[text] == text.startswith(good), text
