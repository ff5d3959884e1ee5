"""Filling fixed-capacity containers with items of varying length: cost-balanced packing.

Items are dealt by hash into shards of a bounded number of characters. Each shard opens the least number of
containers that could hold it and takes its items in descending length; an item goes to the container of lowest
cost (linear plus quadratic attention cost of its items) among those with room, or to a new one if none has.
An item longer than the capacity is cut at multiples of it: full pieces are containers of their own and the
rest is packed like any item.

Defined cases
  * repeated rows (same key) are one item; null and empty texts are no items; blank ones are;
  * a null key is dropped with its row: it names no item;
  * equal lengths are taken in order of key and piece, so the result is the same on every run;
  * an empty table gives no rows; other columns are not read. Lengths are in characters.

Only key and length are shuffled, never the text. Unused space is at most about one container a shard.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

OUT = "container_id long, chunk_id string, piece_no int, start_char long, n_chars long, place int"


def pack(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1.0) -> list[tuple[int, int]]:
    """(container, place) of each item; ``lengths`` must be in descending order and at most ``capacity``.

    Containers wait in a heap by cost. One without room for the item at hand is parked by its room and comes
    back when items have become short enough, so each item costs O(log n).
    """
    if not lengths:
        return []
    n = max(1, math.ceil(sum(lengths) / capacity))
    cost, room, held = [0.0] * n, [capacity] * n, [0] * n
    ready = [(0.0, i) for i in range(n)]
    parked: list[tuple[int, int]] = []  # (-room, container)
    out = []
    for size in lengths:
        while parked and -parked[0][0] >= size:
            i = heapq.heappop(parked)[1]
            heapq.heappush(ready, (cost[i], i))
        i = -1
        while ready:
            i = heapq.heappop(ready)[1]
            if room[i] >= size:
                break
            if room[i]:
                heapq.heappush(parked, (-room[i], i))
            i = -1
        if i < 0:
            i = len(cost)
            cost.append(0.0)
            room.append(capacity)
            held.append(0)
        out.append((i, held[i]))
        held[i] += 1
        room[i] -= size
        cost[i] += linear * size + quadratic * size * size / capacity
        heapq.heappush(ready, (cost[i], i))
    return out


def containers(df: DataFrame, key: str = "chunk_id", text: str = "raw_content", capacity: int = 6000, shard_chars: int = 12_000_000) -> DataFrame:
    items = df.select(df[key].cast("string").alias("chunk_id"), F.length(df[text]).cast("long").alias("n")).filter("chunk_id is not null and n > 0")
    items = cut_lineage(items.groupBy("chunk_id").agg(F.max("n").alias("n")))  # repeated rows; keys and lengths, so the texts are read once
    total, count = items.agg(F.sum("n"), F.count("*")).first()
    shards = max(1, math.ceil((total or 0) / shard_chars), math.ceil(count / 200_000))
    pieces = items.select(
        "chunk_id",
        "n",
        F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(capacity).cast("long"))).alias("piece_no", "start_char"),
    ).select("chunk_id", "piece_no", "start_char", F.least(F.lit(capacity), F.col("n") - F.col("start_char")).alias("n_chars"))
    shard = F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).alias("shard")

    def fill(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n_chars", "descending"), ("chunk_id", "ascending"), ("piece_no", "ascending")])
        base = (t.column("shard")[0].as_py() << 32) if t.num_rows else 0
        placed = pack(t.column("n_chars").to_pylist(), capacity)
        return pa.table(
            {
                "container_id": pa.array([base + c for c, _ in placed], pa.int64()),
                "chunk_id": t.column("chunk_id"),
                "piece_no": t.column("piece_no").cast(pa.int32()),
                "start_char": t.column("start_char"),
                "n_chars": t.column("n_chars"),
                "place": pa.array([p for _, p in placed], pa.int32()),
            }
        )

    return pieces.select(shard, "*").groupBy("shard").applyInArrow(fill, OUT)


def fill_report(packed: DataFrame, capacity: int = 6000) -> DataFrame:
    """Containers, characters and the share of unused space."""
    per = packed.groupBy("container_id").agg(F.sum("n_chars").alias("used"), F.count("*").alias("items"))
    return per.agg(
        F.count("*").alias("n_containers"),
        F.sum("items").alias("n_items"),
        F.sum("used").alias("n_chars"),
        F.max("used").alias("most_used"),
        F.round(1 - F.sum("used") / (F.count("*") * capacity), 6).alias("unused_share"),
    )
