"""Sharding over fixed virtual slots.

Every record hashes into one of thousands of virtual slots. Bytes and rows are summed per slot (a result of a fixed
number of rows, however large the input), and a versioned map says which shard owns each slot. Rebalancing edits the
map: it moves whole slots and never rehashes a record.

Groups of equal texts are spread by their ids: under the law ``bytes`` a shard has to get an equal part of a group that
holds a third of all bytes, so such groups do not stay together. A record is what is written of a row, and where a record is
there several times, its copies are told apart by a number from 0. A slot is the hash of a record and its copy, so the
stored map finds and moves any record, in whatever files it lies. Copies are counted, not listed: equal records meet as a
count, and are dealt out in runs of ``RUN``.

Edge cases: a null text has no bytes (size 1, the CRC of the empty string); a null id hashes by the rest of the row; very
long texts count whole; repeated rows get different places, and rows that tie in a slot any order of places; an empty
table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, shared_dir, utf8_crc32

SLOTS = 8192
RUN = 1000  # copies of a record that a row stands for while they are dealt out


@dataclass(frozen=True)
class SlotMap:
    """Slot ``i`` belongs to shard ``owner[i]``."""

    version: int
    shards: int
    owner: tuple[int, ...]

    def loads(self, weight: dict[int, int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.owner):
            out[shard] += weight.get(slot, 0)
        return out

    def rows(self) -> list[tuple[int, int, int, int]]:
        return [(self.version, self.shards, slot, shard) for slot, shard in enumerate(self.owner)]


def plan_map(weight: dict[int, int], shards: int, slots: int = SLOTS) -> SlotMap:
    """First map: the heaviest slot next, always to the lightest shard; ties to smaller numbers."""
    if not 0 < shards <= slots:
        raise ValueError("there must be at least one shard, and no more shards than slots")
    owner, heap = [0] * slots, [(0, 0, s) for s in range(shards)]
    for slot in sorted(range(slots), key=lambda s: (-weight.get(s, 0), s)):
        load, count, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (load + weight.get(slot, 0), count + 1, shard))
    return SlotMap(1, shards, tuple(owner))


def grow_map(old: SlotMap, weight: dict[int, int]) -> SlotMap:
    """One more shard: the old shards hand over slots until each is at the new mean; nothing moves between old shards."""
    owner, new = list(old.owner), old.shards
    target, loads = sum(weight.values()) / (old.shards + 1), old.loads(weight)
    for slot in sorted(range(len(owner)), key=lambda s: (-weight.get(s, 0), s)):
        w = weight.get(slot, 0)
        if w and loads[owner[slot]] - w >= target:
            loads[owner[slot]] -= w
            owner[slot] = new
    return SlotMap(old.version + 1, old.shards + 1, tuple(owner))


def rebalance_map(old: SlotMap, weight: dict[int, int], tolerance: float = 0.02) -> SlotMap:
    """Same shards, new weights: move slots from the heaviest to the lightest shard until all are near the mean."""
    owner, loads = list(old.owner), old.loads(weight)
    held: list[list[int]] = [[] for _ in range(old.shards)]
    for slot, shard in enumerate(owner):
        held[shard].append(slot)
    mean = sum(loads) / old.shards
    for _ in range(len(owner)):
        hi, lo = max(range(old.shards), key=loads.__getitem__), min(range(old.shards), key=loads.__getitem__)
        gap = loads[hi] - loads[lo]
        movable = [s for s in held[hi] if 0 < weight.get(s, 0) < gap]
        if loads[hi] <= mean * (1 + tolerance) or not movable:
            break
        slot = min(movable, key=lambda s: (abs(gap / 2 - weight[s]), s))
        held[hi].remove(slot)
        held[lo].append(slot)
        owner[slot] = lo
        loads[hi] -= weight[slot]
        loads[lo] += weight[slot]
    return SlotMap(old.version + 1, old.shards, tuple(owner))


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Add a version to the stored map; older versions stay readable."""
    schema = "version int, shards int, slot int, shard int"
    spark.createDataFrame(slot_map.rows(), schema).coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, the newest by default."""
    rows = spark.read.parquet(path)
    if version is None:
        version = rows.agg(F.max("version")).first()[0]
    got = rows.filter(F.col("version") == version).orderBy("slot").collect()
    return SlotMap(version, got[0]["shards"], tuple(r["shard"] for r in got))


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, the number of the copy and its virtual slot, as a written table."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    record = ["doc_id", "text_crc32", "size"]
    records = docs.select("doc_id", size.alias("size"), utf8_crc32(F.col("text")).alias("text_crc32")).groupBy(*record).agg(F.count(F.lit(1)).alias("copies"))
    runs = records.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN))))
    runs = runs.hint("rebalance")  # a record that is there very often has many runs
    copies = runs.withColumn("copy", F.explode(F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, F.col("copies")) - 1)))
    slot = F.pmod(F.xxhash64(*record, "copy"), F.lit(slots)).cast("int")
    return materialize(copies.select("doc_id", "size", "text_crc32", "copy", slot.alias("virtual_slot")), "slotted")


def slot_weights(rows: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """Bytes and rows of each slot: at most as many entries as there are slots."""
    got = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    return {r["virtual_slot"]: r["bytes"] for r in got}, {r["virtual_slot"]: r["n"] for r in got}


def assign(rows: DataFrame, slot_map: SlotMap, counts: dict[int, int]) -> DataFrame:
    """Shard and gapless place in the shard. A slot's first place is the number of rows in its shard's earlier slots."""
    first, at = [], [0] * slot_map.shards
    for slot, shard in enumerate(slot_map.owner):
        first.append((slot, shard, at[shard]))
        at[shard] += counts.get(slot, 0)
    table = rows.sparkSession.createDataFrame(first, "virtual_slot int, shard int, first long")
    order = W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "copy")
    return (
        rows.withColumn("nth", F.row_number().over(order))
        .join(F.broadcast(table), "virtual_slot")  # one row a slot, a fixed number
        .withColumn("slot", F.col("first") + F.col("nth") - 1)
        .drop("first", "nth")
    )


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = SLOTS, store: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Assign every row of ``docs``; the map is stored under ``store`` if given. Shards get near equal bytes."""
    rows = slotted(docs, slots)
    weight, counts = slot_weights(rows)
    slot_map = plan_map(weight, shards, slots)
    if store:
        save_map(docs.sparkSession, slot_map, store)
        slot_map = load_map(docs.sparkSession, store)
    return assign(rows, slot_map, counts), slot_map


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all documents into shards 0 to 7 under the law ``bytes``, and where each goes when the map is edited for a ninth."""
    import uuid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = f"{shared_dir(spark)}/corpusloom/slot-map-{uuid.uuid4().hex}"
    out, slot_map = shard_documents(docs, 8, SLOTS, store)
    save_map(spark, grow_map(slot_map, slot_weights(out)[0]), store)
    grown = load_map(spark, store)
    owners = spark.createDataFrame(list(enumerate(grown.owner)), "virtual_slot int, shard_of_nine int")
    return out.join(F.broadcast(owners), "virtual_slot").select(  # one row a slot, a fixed number
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slot_map.version).alias("map_version"), "shard_of_nine",
    )
