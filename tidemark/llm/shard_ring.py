"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, with DataFrame functions only.

The ring has a fixed number of slots. A shard's virtual nodes own the slots up to the
next node anticlockwise, and a document belongs to the arc of the hash of its id and its
text's checksum, so that many rows of one id, or without one, stand in many places. A shard holds
its bound of rows and no more; the rows of an arc that overflow it continue clockwise to
the next node of a shard that still has room. The bounds are the number of rows over the
number of shards, rounded up for the first shards and down for the others, so every shard
ends up full: counts differ by one at most (law ``rows``).

Loads are counted by slot. Which arcs overflow, and where to, depends on those counts
alone; they are bounded by the ring, never by the data. Rows are ranked inside arcs by
cells, so that no task holds an arc.

Null and empty texts have size 1. Repeated rows stay: rows equal in all columns are
counted together and dealt out again. Null ids are placed by their text. An empty table gives an empty result. All columns but the text are kept.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ranked


@dataclass(frozen=True)
class Ring:
    shards: int = 8
    nodes: int = 64
    slots: int = 16_384
    seed: str = "ring-1"


#: Columns that the result gets; any of these names in the input go.
MADE = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
#: Rows above which equal rows are dealt out in two steps.
MANY = 100_000


def listed(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of fixed size from the driver."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def arcs(spark: SparkSession, ring: Ring) -> list[tuple[int, int]]:
    """The nodes (slot, shard), clockwise. Of nodes in one slot the smallest shard's stays."""
    nodes = spark.range(ring.shards * ring.nodes).select((F.col("id") % ring.shards).alias("shard"), (F.col("id") / ring.shards).cast("long").alias("node"))
    at = nodes.select("shard", F.pmod(F.xxhash64(F.lit(ring.seed), "shard", "node"), F.lit(ring.slots)).alias("slot"))
    found = {r.slot: r.shard for r in at.groupBy("slot").agg(F.min("shard").alias("shard")).collect()}
    return [(slot, found[slot]) for slot in sorted(found)]


def bounds(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def overflowed(loads: list[int], owner: list[int], room: list[int]) -> list[dict]:
    """Parts of arcs by rank: from, to (exclusive), shard and the first slot number there. One step clockwise a round, arcs in ring order."""
    room, used, out = list(room), [0] * len(room), []
    going = [(arc, 0, n, arc) for arc, n in enumerate(loads) if n]
    while going:
        on = []
        for arc, lo, hi, at in going:
            shard = owner[at]
            take = min(hi - lo, room[shard])
            if take:
                out.append({"arc": arc, "lo": lo, "hi": lo + take, "shard": shard, "first": used[shard]})
                room[shard] -= take
                used[shard] += take
            if lo + take < hi:
                on.append((arc, lo + take, hi, (at + 1) % len(owner)))
        going = on
    return out


def sharded(docs: DataFrame, ring: Ring = Ring()) -> DataFrame:
    """Every row of docs without its text, with size, text_crc32, law, shard, slot and grown_shard."""
    spark = docs.sparkSession
    other = [c for c in docs.columns if c not in ("text", *MADE)]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*other).alias("_row"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    place = F.xxhash64(F.lit(ring.seed), F.col("_row.doc_id"), F.col("text_crc32"))
    rows = cut(rows.withColumn("_unit", F.shiftrightunsigned(place, 11) / float(1 << 53)))
    slot = F.floor(F.col("_unit") * ring.slots)
    counted = {r.slot: (r.n, r.most, r.rows) for r in rows.groupBy(slot.alias("slot")).agg(F.sum("_n").alias("n"), F.max("_n").alias("most"), F.count(F.lit(1)).alias("rows")).collect()}
    nodes = arcs(spark, ring)
    arc_of, at = [], 0
    for s in range(ring.slots):
        while at < len(nodes) and nodes[at][0] < s:
            at += 1
        arc_of.append(at % len(nodes))
    loads = [0] * len(nodes)
    for s, (n, _, _) in counted.items():
        loads[arc_of[s]] += n
    parts = overflowed(loads, [shard for _, shard in nodes], bounds(sum(loads), ring.shards))
    by_slot = listed(spark, [{"_slot": s, "_arc": a} for s, a in enumerate(arc_of)], "_slot:long,_arc:int")
    by_arc = listed(spark, parts, "arc:int,lo:long,hi:long,shard:int,first:long")
    # The last arc wraps past slot 0; ranks follow the ring position all the same.
    at = rows.withColumn("_slot", slot).join(F.broadcast(by_slot), "_slot").drop("_slot")
    order = ["_unit", *[c for c in rows.columns if c not in ("_unit", "_n")]]
    at = ranked(at, "_arc", "_unit", order, "_n", sum(x for _, _, x in counted.values()))
    one = F.lit(1).cast("long")
    if max((most for _, most, _ in counted.values()), default=0) > MANY:
        at = at.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - one, F.lit(MANY).cast("long")))).repartition("_unit", "_chunk")
        at = at.withColumn("before", F.col("before") + F.col("_chunk")).withColumn("_n", F.least(F.lit(MANY).cast("long"), F.col("_n") - F.col("_chunk")))
    at = at.withColumn("_rank", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("_n") - one)))
    out = at.join(F.broadcast(by_arc), (F.col("_arc") == F.col("arc")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
    return out.select(
        "_row.*",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("first") + F.col("_rank") - F.col("lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
