"""Sharding by fixed virtual slots.

Rows are hashed by their id into thousands of slots, whose number never changes. Bytes and rows
are summed for each slot, and a versioned map, stored beside the data, says which shard holds
which slot. Rebalancing edits the latest map: few slots move, from the fullest shards to the
emptiest, until all are near the mean, and all others stay where they are. Everything but the
map, which is as long as the number of slots, is DataFrame work.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Virtual slots; the bound of everything that the driver holds here.
SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """Shard of each slot; every edit gives the next version."""

    version: int
    shards: tuple[int, ...]

    @classmethod
    def even(cls, n_shards: int, n_slots: int = SLOTS) -> SlotMap:
        """First version: slots dealt in turn."""
        return cls(1, tuple(slot % n_shards for slot in range(n_slots)))

    def rebalanced(self, sizes: list[int], n_shards: int, tolerance: float = 0.002) -> SlotMap:
        """Next version, with every shard's bytes within ``tolerance`` of the mean where slots allow it.

        Slots of shards that are no more go to the least filled shard, the largest first. Then, one
        at a time, a slot of the fullest shard goes to an emptier one, or changes places with a
        smaller slot there: the one that leaves both nearest to the mean. A shard of one slot above
        the mean stays as it is. Ties go to the shard and slot of lower number, so the result
        depends on the map, the sizes and the number of shards alone.
        """
        shards = list(self.shards)
        held: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]  # size and slot, rising
        homeless = []
        for slot, shard in enumerate(shards):
            if shard < n_shards:
                held[shard].append((sizes[slot], slot))
            else:
                homeless.append((-sizes[slot], slot))
        loads = [sum(size for size, _ in slots) for slots in held]
        for slots in held:
            slots.sort()

        def put(slot: int, shard: int) -> None:
            insort(held[shard], (sizes[slot], slot))
            loads[shard] += sizes[slot]
            shards[slot] = shard

        def take(slot: int, shard: int) -> None:
            del held[shard][bisect_left(held[shard], (sizes[slot], slot))]
            loads[shard] -= sizes[slot]

        for _, slot in sorted(homeless):
            put(slot, min(range(n_shards), key=lambda k: (loads[k], k)))

        left = set(range(n_shards))
        while len(left) > 1:
            mean = sum(loads[k] for k in left) / len(left)
            farthest = max(left, key=lambda k: (abs(loads[k] - mean), -k))
            if abs(loads[farthest] - mean) <= tolerance * mean:
                break
            change = _best_change(held, loads, mean, farthest, left)
            if change is None:  # nothing helps this one; the others have a mean of their own
                left.remove(farthest)
                continue
            fullest, emptier, slot, back = change
            take(slot, fullest)
            if back is not None:
                take(back, emptier)
                put(back, fullest)
            put(slot, emptier)
        return SlotMap(self.version + 1, tuple(shards))

    def column(self, slot: Column) -> Column:
        """Shard of a slot, by a constant array."""
        return _constant(self.shards, "int")[slot]

    def frame(self, spark: SparkSession) -> DataFrame:
        """``version, slot, shard``, for writing."""
        slots = spark.range(len(self.shards)).withColumnRenamed("id", "slot")
        return slots.select(F.lit(self.version).alias("version"), "slot", self.column(F.col("slot").cast("int")).alias("shard"))

    @classmethod
    def read(cls, stored: DataFrame) -> SlotMap:
        """The latest version of stored maps."""
        version = stored.agg(F.max("version")).first()[0]
        rows = stored.filter(F.col("version") == version).orderBy("slot").select("shard").collect()
        return cls(version, tuple(row[0] for row in rows))

    @classmethod
    def latest(cls, spark: SparkSession, folder: str) -> SlotMap | None:
        """The latest version in a folder, by any store that Spark reads; None where there is none."""
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return cls.read(spark.read.schema("version int, slot long, shard int").parquet(folder))


def _best_change(
    held: list[list[tuple[int, int]]], loads: list[int], mean: float, shard: int, left: set[int]
) -> tuple[int, int, int, int | None] | None:
    """For ``shard`` and another of ``left``: the fuller, the emptier, the slot that goes and the one that comes back.

    A change must lower the larger of the two shards' distances from the mean.
    """
    full = loads[shard] > mean
    for other in sorted(left - {shard}, key=lambda k: (loads[k] if full else -loads[k], k)):
        giver, taker = (shard, other) if full else (other, shard)
        over, under = loads[giver] - mean, mean - loads[taker]
        worst = max(abs(over), abs(under))
        wanted = min(over, under) if min(over, under) > 0 else (over + under) / 2
        best = None
        backs: list[tuple[int, int | None]] = [(0, None)]
        for single in (True, False):
            for size, back in backs:
                at = bisect_left(held[giver], (wanted + size, -1))
                for there, slot in held[giver][max(0, at - 1) : at + 1]:
                    moved = there - size
                    if max(abs(over - moved), abs(under - moved)) < worst and (best is None or abs(moved - wanted) < best[0]):
                        best = abs(moved - wanted), slot, back
            if best is not None or not single:
                break
            backs = [(size, slot) for size, slot in held[taker] if size]
        if best is not None:
            return giver, taker, best[1], best[2]
    return None


def _constant(values, kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def sized(docs: DataFrame, n_slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot`` of each row; see ``shard``."""
    key, text = F.col(id_col), F.col(text_col)
    # rows without an id are dealt by their text, not all to one slot
    hashed = F.when(key.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key))
    return docs.select(
        key.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.pmod(hashed, F.lit(n_slots)).cast("int").alias("virtual_slot"),
    )


def shard(
    docs: DataFrame, n_shards: int = 40, n_slots: int = SLOTS, before: SlotMap | None = None, maps: str | None = None, **columns: str
) -> tuple[DataFrame, SlotMap]:
    """Every row with its shard and its place in that shard, and the map that says so.

    The map is the next version of ``before``, or of the latest one in the folder ``maps``, or of
    the even first one; with ``maps`` it is stored there and read back. The shards' bytes are near
    equal. ``slot`` numbers a shard's rows from 0 without gaps: its virtual slots one after the
    other, and rows of a virtual slot by id, size and checksum; rows that tie in all three are
    alike. A null text has size 16 and the checksum of no bytes; rows without an id are dealt by
    their text; repeated rows have places of their own; an empty table gives no rows. Other
    columns are not read.
    """
    spark = docs.sparkSession
    rows = sized(docs, n_slots, **columns)
    totals = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    held = {row["virtual_slot"]: row for row in totals}
    sizes = [held[slot]["bytes"] if slot in held else 0 for slot in range(n_slots)]
    if before is None:
        before = (SlotMap.latest(spark, maps) if maps else None) or SlotMap.even(n_shards, n_slots)
    slot_map = before.rebalanced(sizes, n_shards)
    if maps:
        slot_map.frame(spark).coalesce(1).write.mode("append").parquet(maps)
        slot_map = SlotMap.latest(spark, maps)

    first, filled = [0] * n_slots, [0] * n_shards
    for slot, to in enumerate(slot_map.shards):
        first[slot] = filled[to]
        filled[to] += held[slot]["rows"] if slot in held else 0
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    placed = rows.select(
        "*",
        slot_map.column(F.col("virtual_slot")).alias("shard"),
        (_constant(first, "long")[F.col("virtual_slot")] + F.row_number().over(order) - 1).alias("slot"),
        F.lit(slot_map.version).alias("map_version"),
    )
    return placed, slot_map
