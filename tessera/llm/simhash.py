"""Near-duplicates: SimHash fingerprints joined by covering locality-sensitive hashing.

Fingerprint: A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, the
three-word shingles (repeats included, words joined by a space; fewer words: all
of them) are hashed by XXH64 with seed 42, and a bit is set if it is set in over
half of the hashes.  A text without words has fingerprint zero.

Covering: every bit gets a random non-zero vector over r + 1 bits, and for each
of the 2**(r+1) - 1 non-zero v there is a mask of the bits whose vector has an
odd product with v.  However r bits are chosen, some v is orthogonal to their r
vectors, so that mask avoids them all: any two fingerprints within r bits agree
on the masked bits of at least one table.  No pair is missed.

Equal fingerprints are one node from the start.  Buckets of one fingerprint
drop out by a combinable count.  A larger bucket is searched breadth first, each
found node against those not reached yet, and gives a spanning forest instead of
pairs; beyond ``PART`` fingerprints it is dealt into parts, and every two parts
of it are searched together, so no task gets a bucket of unbounded size and no
link is lost.  Where that would copy a fingerprint more often than it has
neighbours, ``MEETING``, the bucket's fingerprints meet at values instead: each goes
to all values within two bits, and is joined to the least that is within one bit of
the value.  Two within three bits meet at a value, two that are joined are within
three, and a value has no more members than neighbours, so the work stays in
proportion to the fingerprints.

Defined results: null and empty texts have fingerprint zero and link to each
other; repeated rows share a node; a component whose doc_ids are all null has a
null id; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, keep_rows, slices, stash
from .components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Hashes whose bits are counted at a time.
COUNTED = 1 << 16
#: Fingerprints of a bucket's part.
PART = 2048
#: Parts from which on a bucket's fingerprints meet at values: 1 + 64 + 64 * 63 / 2 values within two bits of each, and 1 + 64 within one.
MEETING = 2146


def fingerprint(text: str, k: int = SHINGLE, seed: int = SEED) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    span = min(k, len(words))
    of = xxhash.xxh64_intdigest
    hashes = [of(joined[a:b], seed) for a, b in zip(starts[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), COUNTED):
        part = np.array(hashes[lo : lo + COUNTED], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_ = 2 * counts > len(hashes)
    return int(np.packbits(set_, bitorder="little").view("<u8")[0])


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        values = np.fromiter(map(fingerprint, batch.column("text").to_pylist()), np.uint64, batch.num_rows)
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(values.view(np.int64))], names=[*kept, "fp"])


def covering_masks(radius: int = RADIUS, bits: int = 64, seed: int = 20) -> list[int]:
    """2**(radius+1) - 1 masks; within ``radius`` bits some mask sees no difference."""
    vectors = np.random.default_rng(seed).integers(1, 2 ** (radius + 1), bits)
    return [sum(1 << i for i, m in enumerate(vectors.tolist()) if (m & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(points: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Spanning links of the unsigned points within ``radius`` bits of each other."""
    rest = points
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        root = queue[0]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= radius
            if near.any():
                found = rest[near]
                queue.extend(found)
                rest = rest[~near]
                for x in found.tolist():
                    yield x, int(root)


def _linked(radius: int):
    """Links within the groups (t, key, a, b); equal groups stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, points = None, []
        links: list[tuple[int, int]] = []

        def flush() -> None:
            if points:
                links.extend(_forest(np.concatenate(points), radius))

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in zip(*links)], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(c).to_numpy() for c in ("t", "key", "a", "b")], axis=1)
            fps = batch.column("fp").to_numpy().view(np.uint64)  # bits of signed numbers are counted without the sign
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1).tolist(), len(fps)]
            for lo, hi in zip(cuts, cuts[1:]):
                name = tuple(group[lo].tolist())
                if name != held:
                    flush()
                    held, points = name, []
                points.append(fps[lo:hi])
            if len(links) > 100_000:
                yield batch_of()
                links.clear()
        flush()
        if links:
            yield batch_of()

    return run


def _within(bits: int, width: int = 64) -> list[int]:
    """All numbers of at most ``bits`` set bits."""
    return [sum(1 << i for i in chosen) for n in range(bits + 1) for chosen in combinations(range(width), n)]


def meetings(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: links that join all of ``points`` (distinct fp) within ``radius`` bits, through values between them."""

    def values(bits: int) -> DataFrame:
        steps = F.array(*(F.lit(_signed(m)) for m in _within(bits)))
        return points.select("fp", F.explode(steps).alias("step")).select("fp", F.col("fp").bitwiseXOR(F.col("step")).alias("value"))

    least = values(radius // 2).groupBy("value").agg(F.min("fp").alias("v"))
    return values(radius - radius // 2).join(least, "value").filter("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def links(points: DataFrame, radius: int = RADIUS, part: int = PART, meeting: int = MEETING) -> DataFrame:
    """u, v: links that join all of ``points`` (distinct fp) within ``radius`` bits."""
    masks = [_signed(m) for m in covering_masks(radius)]
    tables = F.explode(F.array(*(F.struct(F.lit(t).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks))))
    entries = points.select("fp", tables.alias("e")).select("e.t", "e.key", "fp")
    crowded = stash(entries.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "crowded")  # read back, a large bucket can be split in the join
    crowded = crowded.withColumn("parts", F.expr(f"(n + {part - 1}) div {part}"))
    rows = entries.join(crowded.filter(F.col("parts") < meeting), ["t", "key"]).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select("t", "key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "fp")
    group = ["t", "key", "a", "b"]
    found = rows.repartition(*group).sortWithinPartitions(*group, "fp").mapInArrow(_linked(radius), "u long, v long")
    huge = crowded.filter(F.col("parts") >= meeting)
    if huge.isEmpty():
        return found
    return found.unionByName(meetings(stash(entries.join(huge, ["t", "key"]).select("fp").distinct(), "huge"), radius))


def _rooted(docs: DataFrame, radius: int, with_digest: bool = False) -> DataFrame:
    """doc_id, fp and root (the same for all that reach each other) of every row; ``with_digest`` adds text_sha256."""
    texts = id_text(docs)
    if with_digest:
        texts = texts.withColumn("text_sha256", F.sha2("text", 256))
    rows = stash(texts.mapInArrow(_fingerprinted, "doc_id long, " + ("text_sha256 string, " if with_digest else "") + "fp long"), "simhash")
    points = stash(rows.select("fp").distinct(), "points")
    roots = stash(components(links(points, radius)), "roots")
    named = stash(points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "named")
    return rows.join(named, "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable)."""
    rooted = _rooted(docs, radius)
    least = stash(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")  # read back, a giant component can be split in the join
    return rooted.join(least, "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with its own columns, one row of each component: that of the least
    doc_id, null last, then of the least SHA-256 of its text."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_sha256"))
    return keep_rows(docs, _rooted(docs, radius, with_digest=True).groupBy("root").agg(first.alias("first")).select("first.*"))
