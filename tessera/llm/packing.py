"""Best-fit packing of documents into sequences: best-two-fit.

Pieces shorter than a sequence are packed by their lengths alone: the histogram
of lengths, one row a length, is all that best-two-fit needs.  A bin is filled
greedily with the longest unpacked length that fits; then its shortest document
gives way to the two unpacked ones that fill the expanded gap most tightly.  A
filling is repeated as often as the histogram allows, so the work depends on the
sequence length and not on the number of documents.  The plan, a table of rank
intervals per length whose size has the same bound, is broadcast; a piece finds
its bin by its rank among the pieces of its length.  Ranks come from a count per
(length, bucket) and a rank within it, where buckets are as many as keep each
small, so a length that most documents share is spread out.

Defined results: a null text counts as empty and packs as its end mark alone;
repeated rows are packed each; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, slices, stash
from .tokens import token_bytes

SEQUENCE = 1024
END = 2
#: Pieces of one length that one bucket holds on average, at most.
BUCKET_ROWS = 50_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter."""
    first = n % size or min(n, size)
    yield 0, first
    for start in range(first, n, size):
        yield start, size


def _pieces(size: int, end: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = token_bytes(text, end)
                for k, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, k, start, length, zlib.crc32(part), part))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*rows)) or [()] * 6
            keep = 6 if keep_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:keep], kinds)], names=names[:keep])

    return run


def plan_bins(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-two-fit over a histogram: (lengths of a bin, number of such bins).

    ``counts[n]`` is the number of pieces of length n; ``len(counts) - 1`` is the
    sequence length.
    """
    size, counts, plan = len(counts) - 1, counts.copy(), []
    while True:
        some = np.flatnonzero(counts)
        if not len(some):
            return plan
        left, filled, gap = counts, [], size
        left = counts.copy()
        while True:
            fitting = np.flatnonzero(left[: gap + 1])
            if not len(fitting):
                break
            n = int(fitting[-1])
            times = min(gap // n, int(left[n]))
            filled += [n] * times
            left[n] -= times
            gap -= n * times
        if gap and len(filled) > 1:
            room, best = gap + filled[-1], (filled[-1], None)
            open_ = np.flatnonzero(left[:room])
            at_most = np.full(room + 1, -1)  # the longest open length up to n
            at_most[open_] = open_
            at_most = np.maximum.accumulate(at_most)
            for a in open_.tolist():
                b = int(at_most[room - a])
                if b == a and left[a] < 2:
                    b = int(at_most[a - 1]) if a else -1
                if b > 0 and a + b > best[0]:
                    best = (a + b, (a, b))
            if best[1]:
                filled[-1:] = best[1]
        used = np.bincount(filled, minlength=size + 1)
        times = int(min(counts[n] // used[n] for n in set(filled)))
        plan.append((tuple(filled), times))
        counts -= used * times


def intervals(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank beyond the last, first bin, offset in the bin)."""
    rows, ranks, bins = [], {}, 0
    for filled, times in plan:
        offset = 0
        for n in filled:
            lo = ranks.get(n, 0)
            rows.append((n, lo, lo + times, bins, offset))
            ranks[n] = lo + times
            offset += n
        bins += times
    return rows


def ranked(pieces: DataFrame, buckets: int) -> DataFrame:
    """Add rank: 0, 1, ... among the pieces of equal length."""
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return rows.withColumn("within", F.row_number().over(within)).join(firsts, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("within") - 1).drop("bucket", "within", "first")


def pack(docs: DataFrame, size: int = SEQUENCE, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and
    ids (little-endian unsigned 32-bit) with ``keep_ids``.
    """
    spark = docs.sparkSession
    texts = id_text(docs)
    pieces = stash(texts.mapInArrow(_pieces(size, end, keep_ids), PIECES + (", ids binary" if keep_ids else "")), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    counts = np.zeros(size + 1, np.int64)
    for n, c in histogram.items():
        counts[n] = c
    buckets = max(1, -(-int(counts.max()) // BUCKET_ROWS))
    table = spark.createDataFrame(intervals(plan_bins(counts)), "length long, lo long, hi long, bin long, offset long")
    rows = ranked(pieces, buckets).alias("p").join(
        F.broadcast(table).alias("t"), (F.col("p.length") == F.col("t.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    )
    out = ["doc_id", "piece", "start", "p.length", "ids_crc32", (F.col("bin") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset"]
    return rows.select(*out, *(["ids"] if keep_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its token ids, from ``pack(..., keep_ids=True)``; a group
    is one sequence and so at most ``SEQUENCE`` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length")).select(
        "sequence_id", "length", F.expr("aggregate(parts, cast('' as binary), (s, x) -> concat(s, x.ids))").alias("ids")
    )
