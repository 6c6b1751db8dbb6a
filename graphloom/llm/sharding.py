"""Sharding over fixed virtual slots.

A record's hash names one of SLOTS slots, for good. Bytes are summed by slot, and a versioned map says which shard holds a
slot. Only the map is edited when shards are added or loads drift: records never hash anew. The law that holds is `bytes`:
the map deals slots to shards, largest first, each to the least loaded shard, so that sizes come out near equal.

Defined results: a null text has no bytes, and a record costs 8 more; id and text are hashed together, so
that records of one id, or of none, spread; rows that agree in both share a slot; an empty table gives a map with every slot empty;
columns named shard, virtual_slot and map_version are replaced, all others are carried along.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import staged, staged_path

#: The number of virtual slots never changes; it bounds every table by slot.
SLOTS = 8192
OVERHEAD = 8


@dataclass(frozen=True)
class SlotMap:
    """Shard and bytes of each slot, with the version of this edit."""

    version: int
    shards: int
    shard: tuple[int, ...]
    bytes: tuple[int, ...]

    @classmethod
    def dealt(cls, sizes: dict[int, int], shards: int, slots: int = SLOTS) -> SlotMap:
        heap = [(0, s) for s in range(shards)]
        held = [0] * slots
        for slot in sorted(range(slots), key=lambda v: (-sizes.get(v, 0), v)):
            load, s = heapq.heappop(heap)
            held[slot] = s
            heapq.heappush(heap, (load + sizes.get(slot, 0), s))
        return cls(1, shards, tuple(held), tuple(sizes.get(v, 0) for v in range(slots)))

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for s, b in zip(self.shard, self.bytes, strict=True):
            out[s] += b
        return out

    def rebalanced(self, sizes: dict[int, int], shards: int | None = None) -> SlotMap:
        """The next version, for new sizes or more shards: single slots leave shards that hold too much, all others stay."""
        shards = shards or self.shards
        if shards < self.shards:
            raise ValueError("shards can only be added")
        held, load = list(self.shard), [0] * shards
        for v, s in enumerate(held):
            load[s] += sizes.get(v, 0)
        mean = sum(load) / shards
        own: dict[int, list[int]] = {}
        for v, s in enumerate(held):
            own.setdefault(s, []).append(v)
        to = [(x, s) for s, x in enumerate(load) if x < mean]
        heapq.heapify(to)
        for s in sorted(own, key=lambda x: -load[x]):
            for v in sorted(own[s], key=lambda x: (-sizes.get(x, 0), x)):
                b = sizes.get(v, 0)
                if not to or load[s] - b < mean or b == 0:
                    continue
                low, t = heapq.heappop(to)
                if low + b <= mean * 1.001 or low + b < load[s]:
                    held[v], load[s], load[t] = t, load[s] - b, low + b
                if load[t] < mean:
                    heapq.heappush(to, (load[t], t))
        return SlotMap(self.version + 1, shards, tuple(held), tuple(sizes.get(v, 0) for v in range(len(held))))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, v, s, b) for v, (s, b) in enumerate(zip(self.shard, self.bytes, strict=True))]
        return spark.createDataFrame(rows, "version int, virtual_slot int, shard int, bytes long").coalesce(1)

    def store(self, spark: SparkSession, path: str) -> None:
        self.table(spark).write.mode("overwrite").parquet(f"{path}/version={self.version:06d}")


def stored(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """The named version of a stored map, or the newest."""
    df = spark.read.option("basePath", path).parquet(path).drop("version") if version is None else None
    if version is None:
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        names = [x.getPath().getName() for x in fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(fs)]
        version = max(int(n.partition("=")[2]) for n in names if n.startswith("version="))
    df = spark.read.parquet(f"{path}/version={version:06d}")
    rows = df.orderBy("virtual_slot").collect()  # as many rows as there are slots
    return SlotMap(version, max((r.shard for r in rows), default=0) + 1, tuple(r.shard for r in rows), tuple(r.bytes for r in rows))


def virtual_slot(id_col: Column, text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(id_col.cast("string"), F.lit("~")), F.coalesce(text, F.lit(""))), F.lit(slots)).cast("int")


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def slot_sizes(rows: DataFrame, slot: str, size: str) -> dict[int, int]:
    return {r[0]: r[1] for r in rows.groupBy(slot).agg(F.sum(size)).collect()}  # at most a row for each slot


def shard_table(docs: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, size, text_crc32, law, shard, slot (its place in the shard, gapless from 0), virtual_slot, map_version."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("__text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = staged(rows.select("__id", record_size(F.col("__text")).alias("__size"), F.crc32(F.encode(text, "UTF-8")).alias("__crc"), virtual_slot(F.col("__id"), F.col("__text")).alias("__slot")), "shard-rows")
    counts = rows.groupBy("__slot").agg(F.sum("__size").alias("b"), F.count(F.lit(1)).alias("n")).collect()  # at most a row for each slot
    path = staged_path(spark, "slot-map")
    SlotMap.dealt({r["__slot"]: r["b"] for r in counts}, shards).store(spark, path)
    held = stored(spark, path)
    start, rank = [0] * shards, {}
    n = {r["__slot"]: r["n"] for r in counts}
    for v, s in enumerate(held.shard):
        rank[v], start[s] = start[s], start[s] + n.get(v, 0)
    table = spark.createDataFrame([(v, s, rank[v], held.version) for v, s in enumerate(held.shard)], "__slot int, shard int, __start long, map_version int")
    inside = Window.partitionBy("__slot").orderBy("__id", "__crc", "__size")
    out = rows.withColumn("__n", F.row_number().over(inside) - 1).join(F.broadcast(table), "__slot")  # SLOTS rows
    return out.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("__start") + F.col("__n")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("__slot").alias("virtual_slot"), "map_version")


def sharded_documents(docs: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with shard, virtual_slot and map_version: sizes are summed by slot in one pass and the map, a row for each slot, is joined in the next."""
    spark = docs.sparkSession
    slot, size = virtual_slot(F.col(id_col), F.col(text_col)), record_size(F.col(text_col))
    held = SlotMap.dealt(slot_sizes(docs.select(slot.alias("__slot"), size.alias("__size")), "__slot", "__size"), shards)
    path = staged_path(spark, "slot-map")
    held.store(spark, path)
    table = spark.createDataFrame([(v, s, v, held.version) for v, s in enumerate(held.shard)], "__slot int, __shard int, __virtual int, __version int")
    out = docs.withColumn("__slot", slot).join(F.broadcast(table), "__slot")  # SLOTS rows
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "virtual_slot", "map_version")), F.col("__shard").alias("shard"), F.col("__virtual").alias("virtual_slot"), F.col("__version").alias("map_version"))
