"""Balanced shards of indivisible groups by Karmarkar-Karp differencing.

Equal texts form a group. Groups are dealt to blocks of bounded size by their digest; in each block a heap holds partial
partitions (a tuple of `shards` sums with the members behind each), and the two of largest spread are combined in
opposite order until one is left. A block's tuple is then a member of the next level, where blocks are combined in the
same way, until one tuple remains; on the way back each member's part is looked up level by level. No task or driver
sees more than one block.

Defined results: a null text has zero bytes and is one group with itself only by its null (apart from empty texts);
equal rows stay together; fewer groups than shards leave shards empty; an empty table gives an empty one.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import numbered, settle

SHARDS, BLOCK = 16, 2048


def differencing(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine rows of sums (n x k) into one: the parts' totals, and for each row and column the part it went to."""
    n, k = sums.shape
    order = np.argsort(sums, axis=1, kind="stable")
    where = np.empty((n, k), np.int64)
    parts: dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]] = {}
    heap = []
    for i in range(n):
        s = sums[i, order[i]]
        parts[i] = s, [[(i, int(c))] if sums[i, c] else [] for c in order[i]]
        heap.append((int(s[0] - s[-1]), i))
        where[i] = np.argsort(order[i])
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        (s, a), (t, b) = (parts.pop(heapq.heappop(heap)[1]) for _ in range(2))
        total = s + t[::-1]
        b = b[::-1]
        joined = []
        for x, y in zip(a, b, strict=True):
            if len(x) < len(y):
                x, y = y, x
            x.extend(y)
            joined.append(x)
        up = np.argsort(total, kind="stable")
        parts[made] = total[up], [joined[j] for j in up]
        heapq.heappush(heap, (int(total[up][0] - total[up][-1]), made))
        made += 1
    total, members = parts.popitem()[1]
    for part, own in enumerate(members):
        for i, c in own:
            where[i, c] = part
    return total, where


def _level(items: DataFrame, shards: int) -> DataFrame:
    """node, sums and block: a block's tuple, and for each node the part of each of its columns."""

    def fn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        total, where = differencing(np.array(frame["sums"].tolist(), np.int64).reshape(-1, shards))
        return pd.DataFrame({"block": frame["block"], "node": frame["node"], "parts": where.tolist(), "total": [total.tolist()] + [None] * (len(frame) - 1)})

    return items.groupBy("block").applyInPandas(fn, "block long, node string, parts array<int>, total array<long>")


def assign(groups: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """node and shard of groups (node, size)."""
    items = groups.select("node", F.concat(F.array(F.col("size").cast("long")), F.array_repeat(F.lit(0).cast("long"), shards - 1)).alias("sums"))
    levels, n = [], groups.count()
    while True:
        blocks = max(1, -(-n // block))
        done = settle(_level(items.withColumn("block", F.pmod(F.xxhash64("node", F.lit(len(levels))), F.lit(blocks))), shards))
        levels.append(done)
        if blocks == 1:
            break
        items = done.filter("total is not null").select(F.col("block").cast("string").alias("node"), F.col("total").alias("sums"))
        n = blocks
    upper = levels[-1].select(F.col("node"), F.col("parts"))
    for lower in levels[-2::-1]:
        up = upper.select(F.col("node").cast("long").alias("block"), F.col("parts").alias("on"))
        upper = settle(lower.join(up, "block").select("node", F.expr("transform(parts, p -> on[p])").alias("parts")))
    return upper.select("node", F.col("parts")[0].alias("shard"))


def shard(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard, a row for each row."""
    sized = settle(docs.select(
        F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), F.coalesce(F.sha2(F.col(text), 256), F.lit("null")).alias("node"),
    ))
    placed = sized.join(assign(sized.groupBy("node").agg(F.sum("size").alias("size")), shards, block), "node")
    out = numbered(placed, ["shard"], ["doc_id", "node"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
