"""Sharding through fixed virtual slots.

Records hash into a fixed number of virtual slots; bytes and rows are summed per
slot; a versioned slot-to-shard map, one small table, says which shard a slot
belongs to.  Version 1 deals the slots out by size, largest first, each to the
lightest shard, and empty slots in turn.  A rebalance edits the map: it moves
slots from heavy to light shards and writes the next version; its greedy loop
runs over the map on the driver, all else is DataFrame and SQL expressions.

A record's place within its shard is the rows of the shard's earlier slots plus
its rank in its own slot, so no task ever orders more than one slot.

Defined results: a null text has no bytes and the CRC of an empty text; equal
rows take successive places; a null doc_id hashes as any value does; an empty
table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import scratch_path
from .common import stash

#: Virtual slots; fixed for the life of a data set.
SLOTS = 4096


def slot_of(doc_id: Column, text_crc32: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc_id, text_crc32), F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    return rows.withColumn("virtual_slot", slot_of(F.col("doc_id"), F.col("text_crc32"), slots))


def slot_sizes(rows: DataFrame) -> DataFrame:
    """Rows and bytes of each virtual slot; at most one row a slot."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"))


def all_slots(slot_map: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """The map with a row for each of the slots; those it lacks are empty and dealt in turn."""
    version = slot_map.agg(F.coalesce(F.max("version"), F.lit(1)).alias("_version"))
    every = slot_map.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot")).crossJoin(F.broadcast(version))
    return every.join(F.broadcast(slot_map), "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("shard", F.pmod("virtual_slot", F.lit(shards))).cast("int").alias("shard"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("slot_bytes", "slot_rows")), F.col("_version").alias("version"),
    )


def deal(sizes: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Map version 1: slots by falling bytes, each to the shard with the fewest so far.

    The fold runs over an array of at most ``SLOTS`` entries.
    """
    order = F.array_sort(F.collect_list(F.struct((-F.col("slot_bytes")).alias("less"), "virtual_slot", "slot_bytes", "slot_rows")))
    folded = sizes.agg(order.alias("slots")).selectExpr(
        f"""aggregate(slots, named_struct('loads', array_repeat(0L, {shards}), 'dealt', cast(array() as array<int>)),
                (s, x) -> named_struct(
                    'loads', transform(s.loads, (v, i) -> if(i = array_position(s.loads, array_min(s.loads)) - 1, v + x.slot_bytes, v)),
                    'dealt', concat(s.dealt, array(cast(array_position(s.loads, array_min(s.loads)) - 1 as int)))),
                s -> transform(slots, (x, i) -> named_struct('virtual_slot', x.virtual_slot, 'shard', s.dealt[i],
                    'slot_bytes', x.slot_bytes, 'slot_rows', x.slot_rows))) as dealt"""
    )
    return all_slots(folded.selectExpr("inline(dealt)").withColumn("version", F.lit(1)), shards, slots)


def grow(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next map version with one more shard, numbered ``shards``.

    Of every old shard the smallest slots go, up to its share of the new shard's
    bytes, and of its empty slots a like share; no slot moves between old shards.
    """
    total = Window.partitionBy("shard", F.col("slot_bytes") == 0)
    mine = total.orderBy("slot_bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    weight = F.greatest("slot_bytes", F.lit(1))
    given = F.sum(weight).over(mine) * (shards + 1) <= F.sum(weight).over(total)
    return slot_map.withColumn("shard", F.when(given, F.lit(shards)).otherwise(F.col("shard"))).withColumn("version", F.col("version") + 1)


def rebalance(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next map version after sizes changed.

    Slots of shards that are no more go to the lightest ones.  Then single slots go
    from the heaviest to the lightest shard, each the one that comes nearest to what
    the two are off the mean, until they differ by no more than the largest slot.
    The loop is greedy and sees at most ``SLOTS`` rows, on the driver.
    """
    now = sizes.select("virtual_slot", F.col("slot_bytes").alias("b"), F.col("slot_rows").alias("n"))
    rows = slot_map.join(F.broadcast(now), "virtual_slot", "left").select("virtual_slot", "shard", "version", F.coalesce("b", F.lit(0)).alias("b"), F.coalesce("n", F.lit(0)).alias("n")).collect()
    size, home = {r.virtual_slot: r.b for r in rows}, {r.virtual_slot: r.shard for r in rows}
    loads, mean, largest = [0] * shards, sum(size.values()) / shards, max(size.values(), default=0)
    for v, s in home.items():
        if s < shards:
            loads[s] += size[v]

    def move(v: int, to: int) -> None:
        if home[v] < shards:
            loads[home[v]] -= size[v]
        home[v] = to
        loads[to] += size[v]

    for v in sorted((v for v in home if home[v] >= shards), key=lambda v: (-size[v], v)):
        move(v, loads.index(min(loads)))
    while max(loads) - min(loads) > largest:
        heavy, light = loads.index(max(loads)), loads.index(min(loads))
        want = min(loads[heavy] - mean, mean - loads[light])
        move(min((v for v in home if home[v] == heavy and size[v]), key=lambda v: (abs(size[v] - want), v)), light)
    edited = [(r.virtual_slot, home[r.virtual_slot], r.b, r.n, r.version + 1) for r in rows]
    return slot_map.sparkSession.createDataFrame(edited, "virtual_slot int, shard int, slot_bytes long, slot_rows long, version int")


def _exists(spark, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def store_map(slot_map: DataFrame, path: str) -> DataFrame:
    """Add a version of the map under ``path``; earlier versions stay readable.

    A version is claimed by creating a file that must not exist, and appears whole by a
    rename: of two writers of one version the second gets an error.
    """
    spark = slot_map.sparkSession
    version = slot_map.agg(F.max("version")).first()[0]
    folder, draft = _folder(spark, path), f"_draft-{uuid.uuid4().hex}"
    slot_map.drop("version").coalesce(1).write.parquet(f"{path}/{draft}")
    try:
        if not folder.create(f"_claims/{version}"):
            raise FileExistsError(f"version {version} of the slot map is taken")
        folder.rename(draft, f"version={version}")
    finally:
        folder.delete(draft)
    return load_map(spark, path)


class _folder:
    """A folder of the cluster's file system."""

    def __init__(self, spark, path: str) -> None:
        self._path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        self._fs = self._path("x").getFileSystem(spark._jsc.hadoopConfiguration())

    def create(self, name: str) -> bool:
        """False where the file is there already."""
        return self._fs.createNewFile(self._path(name))

    def rename(self, old: str, new: str) -> None:
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"{old} could not be renamed to {new}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


def load_map(spark, path: str, version: int | None = None) -> DataFrame:
    """A version of the stored map, the latest by default."""
    maps = spark.read.parquet(path)
    last = maps.agg(F.max("version")).first()[0] if version is None else version
    return maps.filter(F.col("version") == F.lit(last if last is not None else 0))


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Add shard, version and slot, the gapless place in the shard.

    Places count the rows that are there now, not those of the time of the map.
    The map has at most ``SLOTS`` rows, so it is broadcast.
    """
    present = rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("present"))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.join(present, "virtual_slot", "left").select("virtual_slot", "shard", "version", F.coalesce(F.sum("present").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("rank", rank).join(F.broadcast(starts), "virtual_slot").withColumn("slot", F.col("first") + F.col("rank") - 1).drop("first", "rank")


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Every document's shard under the law ``bytes``, through a stored map.

    The latest map under ``map_path`` is used as it is, with its own shards; where
    there is none, version 1 is dealt to ``shards`` and stored.

    Columns: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: this
    law balances bytes and isn't a function of the key), virtual_slot, version.
    """
    spark = docs.sparkSession
    rows = stash(records(docs, slots), "records")
    if map_path and _exists(spark, map_path):
        slot_map = load_map(spark, map_path)
        slot_map = all_slots(slot_map, slot_map.agg(F.max("shard")).first()[0] + 1, slots)
    else:
        slot_map = store_map(deal(slot_sizes(rows), shards, slots), map_path or scratch_path(spark, "slot-map"))
    return place(rows, slot_map).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "version"
    )
