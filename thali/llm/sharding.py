"""Sharding by fixed virtual slots.

Every record hashes by its id to one of ``SLOTS`` virtual slots.  Bytes and
rows are aggregated per slot, and a versioned table says which shard holds which
slot.  Rebalancing edits that table: it writes the next version, in which only
the moved slots differ.  The table and the per-slot sums have ``SLOTS`` rows
however large the input is, so they may pass the driver.

A slot that alone would fill more than a ``HOT``-th of a shard, as that of an id
that very many rows have, is no unit to deal out: its rows hash by their own
number in the stored table instead.

Defined results: a null text has 0 bytes and the checksum of no bytes; a null
id hashes like a value of its own; repeated rows are records of their own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thali.llm.common import shared_folder, stored

SLOTS = 8192
ROW_BYTES = 16
HOT = 8


@dataclass(frozen=True)
class SlotMap:
    """Shard of each virtual slot; ``version`` counts the edits."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, rid) of every row."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(
        docs["doc_id"], (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int").alias("virtual_slot"), F.monotonically_increasing_id().alias("rid"))


def spread(rows: DataFrame, n_shards: int, slots: int = SLOTS) -> DataFrame:
    """``rows`` (stored, so that ``rid`` is fixed) with those of hot slots dealt
    over all slots."""
    sums = slot_sums(rows).collect()
    most = sum(r["bytes"] for r in sums) / (HOT * n_shards)
    hot = [r["virtual_slot"] for r in sums if r["bytes"] > most and r["n_rows"] > 1]  # fewer than HOT * n_shards
    own = F.pmod(F.xxhash64("rid"), F.lit(slots)).cast("int")
    return rows.withColumn("virtual_slot", F.when(F.col("virtual_slot").isin(hot), own).otherwise(F.col("virtual_slot"))) if hot else rows


def slot_sums(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each virtual slot that has any: at most ``SLOTS`` rows."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))


def first_map(n_shards: int, slots: int = SLOTS) -> SlotMap:
    """First version, before anything is known of the records: slots in turn."""
    return SlotMap(1, n_shards, tuple(s % n_shards for s in range(slots)))


def rebalance(old: SlotMap, slot_bytes: dict[int, int], n_shards: int) -> SlotMap:
    """Next version for ``n_shards``: slots of removed shards and what a shard
    holds above the mean move, largest first, to the emptiest shards."""
    shard_of = list(old.shard_of)
    held: dict[int, list[int]] = {s: [] for s in range(n_shards)}
    moving = []
    for slot, shard in enumerate(shard_of):
        (held[shard] if shard < n_shards else moving).append(slot)
    size = lambda v: slot_bytes.get(v, 0)
    mean = sum(map(size, range(len(shard_of)))) / n_shards
    load = {s: sum(map(size, own)) for s, own in held.items()}
    for s, own in held.items():
        for slot in sorted(own, key=lambda v: (-size(v), v)):
            if size(slot) and load[s] - size(slot) >= mean:
                load[s] -= size(slot)
                moving.append(slot)
    heap = [(b, s) for s, b in load.items()]
    heapq.heapify(heap)
    for slot in sorted(moving, key=lambda v: (-size(v), v)):
        b, s = heapq.heappop(heap)
        shard_of[slot] = s
        heapq.heappush(heap, (b + size(slot), s))
    return SlotMap(old.version + 1, n_shards, tuple(shard_of))


def save_map(spark: SparkSession, m: SlotMap, folder: str) -> None:
    """Writes ``folder/version=N``; versions are never changed."""
    rows = [(slot, shard, m.n_shards) for slot, shard in enumerate(m.shard_of)]
    spark.createDataFrame(rows, "virtual_slot int, shard int, n_shards int").coalesce(1).write.parquet(f"{folder}/version={m.version}")


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
    """The named version, or the latest."""
    table = spark.read.schema("virtual_slot int, shard int, n_shards int, version int").parquet(folder)
    version = version or table.agg(F.max("version")).first()[0]
    rows = table.where(F.col("version") == version).orderBy("virtual_slot").collect()
    return SlotMap(version, rows[0]["n_shards"], tuple(r["shard"] for r in rows))


def place(rows: DataFrame, m: SlotMap) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, the record's place in its shard
    (0, 1, ...): the virtual slots of a shard follow one another, and the rows
    of a virtual slot are numbered by id."""
    spark = rows.sparkSession
    table = spark.createDataFrame(list(enumerate(m.shard_of)), "virtual_slot int, shard int")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = (slot_sums(rows).join(F.broadcast(table), "virtual_slot")
              .select("virtual_slot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("start")))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "rid")
    return (rows.withColumn("_n", F.row_number().over(within) - 1)
            .join(F.broadcast(starts), "virtual_slot")
            .withColumn("slot", (F.col("start") + F.col("_n")).cast("long")).drop("_n", "start", "rid"))


def shard_by_bytes(docs: DataFrame, n_shards: int, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """Every row with its size, checksum, shard, place, the version of the slot
    map and whether its slot was moved since the first version.

    The maps are in ``folder`` (by default below the shared folder).  A folder
    that has one already keeps it: the latest version is edited to what the slots
    hold now and to ``n_shards``.
    """
    spark = docs.sparkSession
    rows = spread(stored(records(docs, slots), "records"), n_shards, slots)
    sums = {r["virtual_slot"]: r["bytes"] for r in slot_sums(rows).collect()}
    if folder is None:
        folder = f"{shared_folder(spark)}/thali-llm/{uuid.uuid4().hex}/slot-map"
        save_map(spark, first_map(n_shards, slots), folder)
    old = load_map(spark, folder)
    new = rebalance(old, sums, n_shards)
    save_map(spark, new, folder)
    moved = [s for s, (a, b) in enumerate(zip(old.shard_of, new.shard_of)) if a != b]
    out = place(rows, load_map(spark, folder))
    return out.withColumns({"map_version": F.lit(new.version), "moved": F.col("virtual_slot").isin(moved) if moved else F.lit(False)})
