"""Exact de-duplication by composable polynomial fingerprints.

A text's fingerprint is the pair of values of its bytes, read as the digits of a
polynomial, modulo two primes below 2**31.  It composes: the fingerprint of a
concatenation is ``left * BASE**len(right) + right``, so the chunks of a huge
document are hashed by different tasks and their length-shifted values summed.
Texts of equal fingerprint and length are then compared chunk by chunk: per
chunk position the least and the greatest chunk of the whole group must be the
same, a combinable aggregate that never gathers a group.  Bitmaps of the hashes of
the texts to compare spare most others the shuffle.  A group that fails is split by
its texts' SHA-256.

Defined results: a null text counts as empty; equal rows (also of one doc_id)
form a group of which one row stays; a null doc_id is less than any other; an
empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, id_text, keep_rows, slices, stash

PRIMES = np.array([2147483647, 2147483629], np.uint64)
BASES = (1000003, 1327217885)
#: Bytes that one matrix row holds; 256 products below 2**40 are exact in float64.
BLOCK = 256
#: Documents beyond this many bytes are hashed in parallel chunks of this size.
CHUNK_BYTES = 4 << 20
#: Bytes of the chunks that groups are compared by.
COMPARE_BYTES = 64 << 10
#: Bits of one of Spark's bitmaps; of these, bits for each text to compare.
BITMAP_BITS, BITS_A_TEXT = 32768, 16
#: Bitmaps (of 4 KB) at most, a power of two; with more texts than fit, more others pass, which the join drops.
MOST_BITMAPS = 4096

KEY = ["h1", "h2", "n_bytes"]


def _powers(step: int, count: int) -> np.ndarray:
    out = np.empty((count, 2), np.uint64)
    for j, (base, prime) in enumerate(zip(BASES, PRIMES.tolist())):
        factor, value = pow(base, step, prime), 1
        for i in range(count):
            out[i, j] = value
            value = value * factor % prime
    return out


_DIGITS = _powers(1, BLOCK)[::-1].astype(np.float64)
_shifts = _powers(BLOCK, 4096)


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, 2) fingerprints of the byte rows; an empty row has (0, 0)."""
    global _shifts
    lengths = np.diff(offsets)
    blocks = -(-lengths // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros((len(lengths), 2), np.uint64)
    if not first[-1]:
        return out
    digits = np.zeros(int(first[-1]) * BLOCK, np.float64)  # padded in front: leading zeros change nothing
    for i in np.flatnonzero(lengths).tolist():
        end = int(first[i + 1]) * BLOCK
        digits[end - lengths[i] : end] = data[offsets[i] : offsets[i + 1]]
        digits[end - lengths[i] : end] += 1
    if blocks.max() > len(_shifts):
        _shifts = _powers(BLOCK, int(blocks.max()) + 1024)
    values = (digits.reshape(-1, BLOCK) @ _DIGITS).astype(np.uint64) % PRIMES
    left = np.repeat(first[1:], blocks) - 1 - np.arange(first[-1])
    values = values * _shifts[left] % PRIMES
    some = np.flatnonzero(blocks)
    out[some] = np.add.reduceat(values, first[some], axis=0) % PRIMES
    return out


def combine(left: tuple[int, int], right: tuple[int, int], right_bytes: int) -> tuple[int, int]:
    """The fingerprint of a concatenation, from those of its parts."""
    return tuple((a * pow(b, right_bytes, p) + c) % p for a, b, c, p in zip(left, BASES, right, PRIMES.tolist()))


def _append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace ``body`` by its fingerprint, shifted by ``after`` bytes."""
    for batch in slices(batches, "body"):
        fp = fingerprints(*flat(batch.column("body")))
        after = batch.column("after").to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(after).tolist():
            for j in (0, 1):
                fp[i, j] = int(fp[i, j]) * pow(BASES[j], int(after[i]), int(PRIMES[j])) % int(PRIMES[j])
        names = [n for n in batch.schema.names if n not in ("body", "after")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), *(pa.array(fp[:, j].astype(np.int64)) for j in (0, 1))], names=[*names, "h1", "h2"]
        )


def _hashed(df: DataFrame) -> DataFrame:
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in ("body", "after"))
    return df.mapInArrow(_append, f"{kept}, h1 long, h2 long")


def _fingerprinted(texts: DataFrame, chunk_bytes: int) -> DataFrame:
    """doc_id, text_sha256, n_bytes, h1, h2 of every row."""
    rows = texts.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").cast("long").alias("n_bytes"), F.encode("text", "UTF-8").alias("body"))
    plain = _hashed(rows.filter(F.col("n_bytes") <= chunk_bytes).withColumn("after", F.lit(0).cast("long")))
    huge = rows.filter(F.col("n_bytes") > chunk_bytes).withColumn("row", F.monotonically_increasing_id())
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_bytes - 1) div {chunk_bytes}")))
    parts = huge.withColumn("at", at).select(
        "doc_id", "text_sha256", "n_bytes", "row", F.expr(f"substring(body, cast(at * {chunk_bytes} + 1 as int), {chunk_bytes})").alias("body"),
        F.expr(f"greatest(n_bytes - (at + 1) * {chunk_bytes}, 0L)").alias("after"), "at",
    )
    whole = _hashed(parts.repartition("row", "at")).groupBy("doc_id", "text_sha256", "n_bytes", "row").agg(
        *((F.sum(h) % F.lit(int(p))).alias(h) for h, p in zip(("h1", "h2"), PRIMES))
    )
    return plain.unionByName(whole.drop("row"))


def _likely(bodies: DataFrame, named: DataFrame) -> DataFrame:
    """All rows of ``bodies`` whose ``sha`` is a ``_sha`` of ``named``, and few others:
    each of the latter sets a bit of the bitmaps, which are broadcast."""
    wanted = -(-named.count() * BITS_A_TEXT // BITMAP_BITS)
    bitmaps = min(1 << max(0, wanted - 1).bit_length(), MOST_BITMAPS)
    place = lambda sha: F.xxhash64(sha).bitwiseAND(F.lit(bitmaps * BITMAP_BITS - 1)).alias("_at")
    number = F.shiftright("_at", BITMAP_BITS.bit_length() - 1)  # never null, unlike a quotient: no filter that hashes each text again
    bits = named.select(place("_sha")).groupBy(number.alias("_bitmap")).agg(F.bitmap_construct_agg(F.expr(f"_at % {BITMAP_BITS}")).alias("_bits"))
    byte = f"ascii(decode(substring(_bits, cast(_at % {BITMAP_BITS} div 8 as int) + 1, 1), 'ISO-8859-1'))"
    found = bodies.select("*", place("sha")).join(F.broadcast(bits), number == F.col("_bitmap"))
    return found.filter(f"getbit({byte}, cast(_at % 8 as int)) = 1").select(*bodies.columns)


def unequal(texts: DataFrame, rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Keys of ``groups`` under which two texts differ, found by a chunkwise comparison;
    ``rows`` are the texts' fingerprints."""
    named = rows.join(groups.select(KEY), KEY, "left_semi").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), *KEY).distinct()
    named = stash(named, "named")  # read back, a hot key of the join can be split
    # Only the bodies to compare are shuffled, and at every size: the plan doesn't turn at a broadcast's limit.
    bodies = _likely(texts.select("doc_id", "text", F.coalesce(F.sha2("text", 256), F.lit("")).alias("sha")), named).withColumn("bytes", F.encode("text", "UTF-8"))
    same = bodies.join(named.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")))
    # Grouped by a struct, the chunks don't inherit the join's partitioning: a large group's rows can be split and are combined per task.
    parts = same.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"greatest(n_bytes - 1, 0L) div {COMPARE_BYTES}")))).select(
        F.struct(*KEY).alias("key"), "at", F.expr(f"substring(bytes, cast(at * {COMPARE_BYTES} + 1 as int), {COMPARE_BYTES})").alias("part")
    )
    return parts.groupBy("key", "at").agg(F.min("part").alias("least"), F.max("part").alias("most")).filter("least <> most").select("key.*").distinct()


def exact_dedup(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    The row with the largest doc_id of a group of equal texts is the one kept.
    """
    texts = id_text(docs)
    rows = stash(_fingerprinted(texts, chunk_bytes).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    several = stash(rows.groupBy(KEY).count().filter("count > 1"), "several")
    bad = stash(unequal(texts, rows, several).withColumn("split", F.lit(True)), "unequal")
    rows = rows.join(bad, KEY, "left").withColumn("part", F.when(F.col("split"), F.col("text_sha256")).otherwise(F.lit(""))).drop("split")
    key = [*KEY, "part"]
    groups = rows.groupBy(key).agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    groups = stash(groups, "groups")  # read back, the join's rows of one large group can be split
    return rows.join(groups, key).select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"), "text_sha256", "n_bytes"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with its own columns, one row of each group of equal texts."""
    return keep_rows(docs, exact_dedup(docs).filter("kept"))
