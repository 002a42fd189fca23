"""Operator 8: resharding by minimum-cost flow, keeping equal texts together.

Rows stand in old shards by a hash of their text.  Each old shard is cut into `cells` blocks by
more bits of the hash, so equal texts share a block.  Groups of equal texts that outweigh an eighth of
a shard (at most 8 * shards of them by bytes and as many by rows) become blocks of their own,
cut by doc_id, so no group overfills a task; the blocks of a group that fits a shard are moved as one,
as long as shards come out near equal.  Blocks' bytes and rows, a fixed number of figures, go to the
driver.  There

1. a minimum-cost flow from old shards (their bytes) to new ones (their capacities), free for
   bytes that stay, finds the transfers that move the fewest bytes;
2. each transfer is met by whole blocks;
3. what the blocks' grain leaves over is evened out by single moves and swaps.

Rows then get shard and slot from their block's entry and their rank in the block: one shuffle, of
a few numbers for each row, none of the texts.  `rewrite` writes the shards whose rows change.

Defined cases: a null text has size 16 and stands alone; an empty text is a text; a null doc_id
is kept; repeated rows are rows of their own; an empty table gives an empty result; other columns
are ignored by the placement and kept by `rewrite`.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LAW = "bytes"


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow from sources to sinks that ships all supply at least cost (successive shortest paths).

    Potentials keep reduced costs from 0 up, so each path is found by Dijkstra's method.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("supply exceeds capacity")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    pot = [0] * (n + m)
    while any(left):
        dist, back = [float("inf")] * (n + m), [-1] * (n + m)
        heap = []
        for i in range(n):
            if left[i]:
                dist[i] = 0
                heap.append((0, i))
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            if u < n:
                steps = ((n + j, cost[u][j]) for j in range(m))
            else:
                steps = ((i, -cost[i][u - n]) for i in range(n) if flow[i][u - n])
            for v, c in steps:
                nd = d + c + pot[u] - pot[v]
                if nd < dist[v]:
                    dist[v], back[v] = nd, u
                    heapq.heappush(heap, (nd, v))
        end = min((n + j for j in range(m) if room[j]), key=lambda v: dist[v] + pot[v])
        most = dist[end]
        for v in range(n + m):
            pot[v] += min(dist[v], most)
        path, v = [], end
        while back[v] >= 0:
            path.append((back[v], v))
            v = back[v]
        amount = min(left[v], room[end - n], *(flow[b][a - n] for a, b in path if a >= n), 1 << 62)
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[v] -= amount
        room[end - n] -= amount
    return flow


def assign(old: np.ndarray, size: np.ndarray, shards: int, capacity: list[int] | None = None) -> np.ndarray:
    """The new shard of each block, from its old shard and its bytes."""
    total = int(size.sum())
    was = np.bincount(old, size, shards).astype(np.int64) if len(old) else np.zeros(shards, np.int64)
    sources = len(was)
    target = np.array(capacity if capacity else [total // shards + (j < total % shards) for j in range(shards)], np.int64)
    flow = min_cost_flow(was.tolist(), target.tolist(), [[int(i != j) for j in range(shards)] for i in range(sources)])
    new = old.copy()
    for i in range(sources):
        own = np.flatnonzero(old == i)
        own = own[np.argsort(-size[own], kind="stable")]
        free = np.ones(len(own), bool)
        for j in np.argsort([-f for f in flow[i]], kind="stable"):
            need = flow[i][j]
            if j == i or not need:
                continue
            for k in np.flatnonzero(free):  # largest that fits, so few blocks meet a transfer
                if 0 < size[own[k]] <= need:
                    new[own[k]], free[k], need = j, False, need - int(size[own[k]])
                if not need:
                    break
    return even_out(new, size, target)


def even_out(new: np.ndarray, size: np.ndarray, target: np.ndarray, steps: int = 4000) -> np.ndarray:
    """Moves and swaps of single blocks between the fullest and the emptiest shard, while they help."""
    load = np.bincount(new, size, len(target)).astype(np.int64) - target
    for _ in range(steps):
        a, b = int(load.argmax()), int(load.argmin())
        gap = int(load[a] - load[b])
        if gap < 2:
            break
        x, y = np.flatnonzero((new == a) & (size > 0)), np.flatnonzero((new == b) & (size > 0))
        sx, sy = size[x], np.r_[0, np.sort(size[y])]
        order = np.r_[-1, y[np.argsort(size[y], kind="stable")]]
        best = None
        at = np.searchsorted(sy, sx - gap // 2)
        for shift in (-1, 0):
            k = np.clip(at + shift, 0, len(sy) - 1)
            left = np.abs(gap - 2 * (sx - sy[k]))
            i = int(left.argmin()) if len(left) else -1
            if i >= 0 and left[i] < gap and (best is None or left[i] < best[0]):
                best = (int(left[i]), x[i], order[k[i]])
        if best is None:
            break
        new[best[1]] = b
        load[a] -= size[best[1]]
        load[b] += size[best[1]]
        if best[2] >= 0:
            new[best[2]] = a
            load[a] += size[best[2]]
            load[b] -= size[best[2]]
    return new


def together(blocks: list, group_of: dict[int, tuple[int, int]], shards: int, total: int) -> np.ndarray:
    """The new shard of each block (old_shard, cell, bytes), the blocks of a heavy group of equal texts moved as one.

    group_of: for a cell of a heavy group its first cell and the group's bytes.  A group stays whole if it fits a
    shard.  Only if shards then differ by more than half a percent are groups above a half, a quarter or an eighth of a shard
    divided.
    """
    if not blocks:
        return np.zeros(0, np.int64)
    for part in (1, 2, 4, 8):
        units: dict[tuple[int, int], int] = {}
        unit_of = []
        for r in blocks:
            first, weight = group_of.get(r["cell"], (r["cell"], 0))
            unit_of.append(units.setdefault((r["old_shard"], first if weight * shards * part <= total else r["cell"]), len(units)))
        size = np.bincount(unit_of, [r["bytes"] for r in blocks], len(units)).astype(np.int64)
        new = assign(np.array([old for old, _ in units], np.int64), size, shards)
        load = np.bincount(new, size, shards)
        if 200 * np.abs(load - total / shards).max() <= total / shards:
            break
    return new[unit_of]


def _text_hash(text: Column, doc_id: Column) -> Column:
    return F.when(text.isNull(), F.xxhash64(F.lit("null"), doc_id)).otherwise(F.xxhash64(text))


def place(spark: SparkSession, docs: DataFrame, shards: int = 40, cells: int = 1024, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, old_shard, shard, slot[, row]) of every row.

    keep: columns to bring along, as a struct `row`.
    """
    text, rest = F.col("text"), [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []
    raw = F.coalesce(text, F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), _text_hash(text, F.col("doc_id")).alias("h"), *rest,
    )
    groups = rows.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    whole = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    bytes_, n = whole["bytes"] or 0, whole["n"]
    # at most 8 * shards groups pass either bound
    heavy = groups.where((F.col("bytes") * 8 * shards > bytes_) | (F.col("n") * 8 * shards > n)).orderBy("h").collect()
    parts = [max(-(-64 * shards * r["bytes"] // max(1, bytes_)), -(-64 * shards * r["n"] // max(1, n))) for r in heavy]
    base = [cells + sum(parts[:k]) for k in range(len(parts))]
    split = spark.createDataFrame([(r["h"], b, p) for r, b, p in zip(heavy, base, parts, strict=True)], "g long, base int, parts int")
    old = F.pmod("h", F.lit(shards)).cast("int").alias("old_shard")
    cell = F.coalesce(F.col("base") + F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"), F.pmod(F.shiftrightunsigned("h", 20), F.lit(cells)).cast("int")).alias("cell")
    rows = rows.join(F.broadcast(split), rows["h"] == split["g"], "left").select("doc_id", "size", "text_crc32", old, cell, *(["row"] if keep else []))
    blocks = rows.groupBy("old_shard", "cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # at most shards * (cells + 130) rows
    blocks.sort(key=lambda r: (r["old_shard"], r["cell"]))
    group_of = {b + i: (b, r["bytes"]) for r, b, p in zip(heavy, base, parts, strict=True) for i in range(p)}
    new = together(blocks, group_of, shards, bytes_)
    slots, table = [0] * shards, []
    for r, s in zip(blocks, new.tolist(), strict=True):
        table.append((r["old_shard"], r["cell"], s, slots[s]))
        slots[s] += r["n"]
    plan = spark.createDataFrame(table, "old_shard int, cell int, shard int, base long")
    rank = F.row_number().over(Window.partitionBy("old_shard", "cell").orderBy("doc_id", "size", "text_crc32")) - 1
    out = rows.withColumn("rank", rank).join(F.broadcast(plan), ["old_shard", "cell"])
    return out.select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("base") + F.col("rank")).cast("long").alias("slot"), *(["row"] if keep else []))


def rewrite(placed: DataFrame, path: str, rows_per_file: int = 1_000_000) -> list[int]:
    """Write the shards that gain or lose rows, in slot order, under path/shard=N; returns them.

    placed: from `place` with `keep`.  Shards that keep exactly their rows are not written.
    """
    moved = placed.where("shard != old_shard")
    changed = sorted({r["s"] for r in moved.select(F.explode(F.array("shard", "old_shard")).alias("s")).distinct().collect()})  # at most the number of shards
    out = placed.where(F.col("shard").isin(changed)) if changed else placed.limit(0)
    out = out.withColumn("file", F.floor(F.col("slot") / rows_per_file)).repartition("shard", "file").sortWithinPartitions("shard", "slot")
    out.select("shard", "slot", "row.*").write.partitionBy("shard").parquet(path)
    return changed
