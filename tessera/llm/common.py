"""Shared plumbing of the training-data operators.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, which
every executor and the driver share, so a lost executor never loses them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import scratch_path
from ..session import ship_package

#: Bytes of text that one numpy pass takes; a longer text is one pass of its own.
SLICE_BYTES = 2 << 20


def stash(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text (null: empty), whatever other columns are there."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``docs`` with its own columns: of the rows of each (doc_id, text_sha256) of
    ``kept``, null ids included, one."""
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    sha = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), docs["doc_id"].cast("long").alias("_id"), sha.alias("_sha"))
    rows = rows.join(kept, rows["_id"].eqNullSafe(kept["_id"]) & (rows["_sha"] == kept["_sha"]), "left_semi")
    one = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_sha").orderBy("_id")))
    return one.filter("_n = 1").select("_row.*")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (null: empty), and each row's offset."""
    if array.null_count:
        array = pc.fill_null(array, "" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    array = array.cast(pa.large_binary())
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row: starts, ends, and the rows' bounds in them."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes of a span from which on ``span_hashes`` leaves it to a cryptographic hash.
LONG_SPAN = 512
_SPAN_SEEDS = (0x6A09E667F3BCC908, 0xBB67AE8584CAA73B)
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, count: int = 1) -> list[np.ndarray]:
    """``count`` (1 or 2) independent 64-bit hashes of many spans of one buffer.

    Eight bytes at a time are added and mixed by a bijection, so no algebra ties a
    span to another, as prefix sums modulo a power of two would.
    """
    blocks = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))  # unaligned loads
    lengths = ends - starts
    out = [mix(lengths.astype(np.uint64) + np.uint64(seed)) for seed in _SPAN_SEEDS[:count]]
    long = np.flatnonzero(lengths >= LONG_SPAN)
    live = np.flatnonzero((lengths < LONG_SPAN) & (lengths > 0)) if len(long) else np.flatnonzero(lengths)
    at, left = starts[live], lengths[live]
    while len(live):
        block = blocks[at] & _LOW_BYTES[np.minimum(left, 8)]
        for j, values in enumerate(out):
            values[live] = mix((values[live] ^ block) * np.uint64(_SPAN_SEEDS[1 - j] | 1))
        more = np.flatnonzero(left > 8)
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in long.tolist():
        whole = np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=16).digest(), "<u8")
        for values, value in zip(out, whole):
            values[i] = value
    return out


class SpanHash:
    """Polynomial hashes modulo 2**64 of many spans of one buffer, from prefix sums.

    For buckets, where two spans may share a value: some pairs do by construction.
    """

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        size = max(n, min(2 * len(self.up), SLICE_BYTES + 1))
        for name, base in (("up", self.base), ("down", self.inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) < n + 1:
            self._grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: shifts and odd multiplications."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))
