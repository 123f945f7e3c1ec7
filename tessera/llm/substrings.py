"""Repeated passages: Rabin-Karp hashes of every window of 13 words.

A word covered by a window whose words also start a window in a document with a
smaller doc_id is removed; windows are judged on the input.

All windows are hashed, but only those that can repeat travel.  A window holds
eight successive six-word grams; the least of their hashes is its anchor, and
equal windows have equal anchors.  Anchors, far fewer than windows, are counted
first (combinable least and greatest mark of the texts that hold them); only
windows whose anchor two texts share are then counted by their 128-bit hash.
Windows with a smaller first document come back to their document, where
overlapping ones merge into maximal intervals.  Of equal texts only that of the
least doc_id sends windows: of the others every window starts there too.  The
texts are dealt out by document, and each job uses that exchange once.

A word's two 64-bit hashes come from bijective mixes of its bytes, not from a sum
of powers modulo 2**64, under which some words are equal by construction.

Defined results: a null text has no words; rows of one doc_id are no documents
with a smaller id to each other; a null doc_id is smaller than none and loses
nothing; texts below 13 words stay whole; an empty table gives an empty table;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, id_text, mix, slices, span_hashes, stash, words

WINDOW = 13
#: Words of a gram; a window holds WINDOW - GRAM + 1 of them.
GRAM = 6

#: What names a document's row on its way: another text of the same doc_id is another.
KEY = ["doc_id", "digest"]

_STEP, _OTHER = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5


def rolling(values: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hash of every run of ``size`` values (Horner, modulo 2**64)."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = values[:n].copy()
    for j in range(1, size):
        out = out * np.uint64(base) + values[j : j + n]
    return mix(out)


def _starts(bounds: np.ndarray, window: int) -> np.ndarray:
    """Word numbers at which a whole window of one row starts."""
    counts = np.maximum(np.diff(bounds) - window + 1, 0)
    first = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return first + np.arange(counts.sum())


def _anchored(data: np.ndarray, offsets: np.ndarray, window: int, gram: int, count: int = 1):
    """Row bounds, ``count`` hashes of each word, window starts and their anchors."""
    starts, ends, bounds = words(data, offsets)
    hashes = span_hashes(data, starts, ends, count)
    grams = rolling(hashes[0], gram, _STEP)
    at = _starts(bounds, window)
    anchors = grams[at]
    for j in range(1, window - gram + 1):
        np.minimum(anchors, grams[at + j], out=anchors)
    return bounds, hashes, at, anchors


def _anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bounds, _, at, anchors = _anchored(*flat(batch.column("text")), window, gram)
            row = np.searchsorted(bounds, at, side="right") - 1
            new = np.ones(len(at), bool)
            new[1:] = (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])
            row, anchors = row[new], anchors[new]
            digest, other = (batch.column(c).to_numpy().view(np.uint64)[row] for c in ("digest", "other"))
            mark = digest * (anchors | np.uint64(1)) + other  # by both digests: unequal texts differ under each anchor anew
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors.view(np.int64)), pa.array(mark.view(np.int64)), *(batch.column(c).take(pa.array(row)) for c in KEY)], names=["anchor", "mark", *KEY]
            )

    return run


def _windows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bounds, hashes, at, anchors = _anchored(*flat(batch.column("text")), window, gram, 2)
            first = np.searchsorted(at, bounds)
            shared = batch.column("shared")
            keep = [np.isin(anchors[first[i] : first[i + 1]], np.asarray(shared[i].values, np.int64).view(np.uint64)) for i in range(batch.num_rows)]
            at = at[np.concatenate(keep)]
            row = np.searchsorted(bounds, at, side="right") - 1
            h1, h2 = (rolling(h, window, step)[at] if len(at) else at.astype(np.uint64) for h, step in zip(hashes, (_OTHER, _STEP)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), *(batch.column(c).take(pa.array(row)) for c in KEY), pa.array((at - bounds[row]).astype(np.int32))],
                names=["h1", "h2", *KEY, "at"],
            )

    return run


def removed_mask(n_words: int, at: np.ndarray, window: int) -> np.ndarray:
    """Which words the windows starting at ``at`` cover."""
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, np.minimum(at + window, n_words), -1)
    return np.cumsum(steps[:-1]) > 0


def intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of removed words, (first, beyond the last)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


_CUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _cut(window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, text, at, copy in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "at", "copy"))):
                found = text.encode().split()
                if copy:
                    at = range(max(len(found) - window + 1, 0))
                mask = removed_mask(len(found), np.array(at, np.int64), window) if at else np.zeros(len(found), bool)
                cuts = intervals(mask)
                if cuts:
                    kept, last = [], 0
                    for lo, hi in cuts:
                        kept += found[last:lo]
                        last = hi
                    kept += found[last:]
                else:
                    kept = found
                joined = b" ".join(kept)
                rows.append((doc_id, len(found), len(found) - len(kept), hashlib.sha256(joined).hexdigest(), [{"first": a, "beyond": b} for a, b in cuts], joined.decode()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("beyond", pa.int64())])), pa.string()]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "intervals", "kept"]
            keep = 6 if keep_text else 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows))[:keep], kinds)], names=names[:keep])

    return run


def _of_document(texts: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``texts`` with what was ``found`` in them.

    Null-safe equality keeps an inner join from filtering null ids before its
    exchange, so that inner and left joins of the texts use the same one.
    """
    found = found.withColumnsRenamed({"doc_id": "_id", "digest": "_digest"})
    return texts.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("digest").eqNullSafe(F.col("_digest")), how).drop("_id", "_digest")


def _copies(texts: DataFrame) -> DataFrame:
    """The key of every row whose text a document with a smaller doc_id has as a whole."""
    known = stash(texts.select(*KEY, F.sha2("text", 256).alias("sha")), "digests")
    least = stash(known.groupBy("sha").agg(F.min("doc_id").alias("least")), "least")  # read back, a text of very many rows can be split in the join
    return stash(known.join(least, "sha").filter("doc_id > least").select(*KEY).distinct(), "copies")


def drop_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256; with ``keep_text``
    also intervals (removed words, first and beyond) and kept (the text left)."""
    texts = id_text(docs).withColumn("digest", F.xxhash64("text"))
    copies = _copies(texts)
    marked = texts.withColumn("other", F.xxhash64(F.lit(1), "text")).filter(F.col("doc_id").isNotNull())
    anchors = marked.mapInArrow(_anchors(window, gram), "anchor long, mark long, doc_id long, digest long")
    shared = anchors.groupBy("anchor").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).filter("a <> b").select("anchor")
    shared = stash(shared, "shared")  # read back, it comes to the join by an exchange of its own, so a skewed anchor can be split
    lists = anchors.select("anchor", *KEY).join(shared, "anchor").groupBy(KEY).agg(F.collect_set("anchor").alias("shared"))
    lists = stash(lists.join(copies, KEY, "left_anti"), "anchors")
    windows = _of_document(texts, lists, "inner").mapInArrow(_windows(window, gram), "h1 long, h2 long, doc_id long, digest long, at int")
    first = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("h1", "h2", "first")
    first = stash(first, "repeated")  # likewise for skewed windows
    again = windows.join(first, ["h1", "h2"]).filter("doc_id > first").groupBy(KEY).agg(F.collect_set("at").alias("at"))
    found = again.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True)
    return _of_document(texts, found, "left").mapInArrow(_cut(window, keep_text), _CUT + (", intervals array<struct<first:long,beyond:long>>, kept string" if keep_text else ""))
