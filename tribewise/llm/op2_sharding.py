"""Sharding over fixed virtual slots.

Records hash into a fixed number of slots, bytes and rows are summed per slot,
and a small versioned table says which shard holds a slot.  Only that table is
edited when shards are added or loads drift: a slot moves as a whole, and no
record is hashed anew.

The slot table has ``n_slots`` rows whatever the input, so it may pass through
the driver and be broadcast.  Law: bytes of the shards are near equal (slots go,
largest first, to the lightest shard).

Cases: null text has size 1 and the checksum of nothing; null and repeated ids
are hashed with their size and checksum; equal rows share a slot; an empty table
gives no rows and a map of empty slots; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, text_or_empty, written

N_SLOTS = 4096
MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes long, n_rows long"


def slotted(docs: DataFrame, n_slots: int = N_SLOTS, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, size, text_crc32 and virtual_slot of every record."""
    text = text_or_empty(text_col)
    base = docs.select(F.col(key), (F.octet_length(text).cast("long") + 1).alias("size"),
                       F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    return base.withColumn("virtual_slot", F.pmod(F.xxhash64(key, "size", "text_crc32"), F.lit(n_slots)).cast("int"))


def slot_loads(rows: DataFrame, n_slots: int = N_SLOTS) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of every slot, empty ones included; at most ``n_slots`` rows reach the driver."""
    got = {r["virtual_slot"]: (r["b"], r["n"]) for r in rows.groupBy("virtual_slot")
           .agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    return [(s, *got.get(s, (0, 0))) for s in range(n_slots)]


def first_map(loads: list[tuple[int, int, int]], n_shards: int) -> dict[int, int]:
    """Slot -> shard: largest slot first, each to the shard that has the fewest bytes, then rows."""
    heap = [(0, 0, s) for s in range(n_shards)]
    placed = {}
    for slot, b, n in sorted(loads, key=lambda x: (-x[1], x[0])):
        have, rows, shard = heapq.heappop(heap)
        placed[slot] = shard
        heapq.heappush(heap, (have + b, rows + n, shard))
    return placed


def rebalanced(placed: dict[int, int], loads: list[tuple[int, int, int]], n_shards: int) -> dict[int, int]:
    """Edit a map for ``n_shards`` shards: slots leave shards above the mean (or shards that go away), no others move."""
    size = {s: b for s, b, _ in loads}
    mean = sum(size.values()) / n_shards
    held = defaultdict(list)
    for slot, shard in sorted(placed.items()):
        held[shard].append(slot)
    out, loose = dict(placed), []
    for shard, slots in held.items():
        have = sum(size[s] for s in slots)
        for slot in sorted(slots, key=lambda s: (size[s], s), reverse=True):
            if shard >= n_shards or have - size[slot] >= mean:
                have -= size[slot]
                loose.append(slot)
    load = dict.fromkeys(range(n_shards), 0)
    gone = set(loose)
    for slot, shard in placed.items():
        if slot not in gone:
            load[shard] += size[slot]
    heap = sorted((b, s) for s, b in load.items())
    for slot in sorted(loose, key=lambda s: (-size[s], s)):
        b, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (b + size[slot], shard))
    return out


def store_map(spark: SparkSession, path: str, version: int, placed: dict[int, int],
              loads: list[tuple[int, int, int]]) -> DataFrame:
    """Append one version to the map table and return that version."""
    rows = [(version, s, placed[s], b, n) for s, b, n in loads]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return read_map(spark, path, version)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map; the newest if none is named."""
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.filter(F.col("version") == version)


def assign(rows: DataFrame, slot_map: DataFrame, key: str = "doc_id") -> DataFrame:
    """Shard of each row and its position in the shard, gapless from 0.

    Rows are numbered within their virtual slot; the map's row counts give the
    number of rows of the shard in slots before it.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.select("virtual_slot", "shard", F.col("version").alias("map_version"),
                             F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("virtual_slot").orderBy(F.col(key).asc_nulls_first(), "size", "text_crc32")
    numbered = rows.withColumn("_n", F.row_number().over(within) - 1)
    return (numbered.join(F.broadcast(starts), "virtual_slot")  # n_slots rows
            .withColumn("slot", F.col("_start") + F.col("_n")).drop("_start", "_n"))


def sharded(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, key: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """All records with size, checksum, shard and position; the map is version 1 of a new table."""
    spark = docs.sparkSession
    rows = written(slotted(docs, n_slots, key, text_col), "slots")
    loads = slot_loads(rows, n_slots)
    slot_map = store_map(spark, shared_path(spark, "slot-map"), 1, first_map(loads, n_shards), loads)
    return assign(rows, slot_map, key).withColumn("law", F.lit("bytes"))
