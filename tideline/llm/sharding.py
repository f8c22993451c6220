"""Operator 3: byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

A partial partition is a tuple of shard sizes. Differencing combines the two
partial partitions of largest spread, the largest shard of one with the smallest
of the other, until one is left. Groups are dealt by hash to tasks of about
TASK_ROWS groups, each of which differences its own. A group that is large against
a whole task could not be made up for there; such groups, at most one in
TASK_ROWS / (4 * shards), are assigned first, by the same rule, and every task starts
from its share of what they put on the shards, so that the small groups fill up. One task
comes last: it starts from the sizes that all others reached, as the partial partition of largest
spread, so that what the tasks leave is made up for as in a single pass.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.plans.storage import shared_folder, written

SHARDS = 16
TASK_ROWS = 8_192
BUCKET_ROWS = 2_000


def differenced(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each item's part, sizes of the combined partition).

    ``sizes`` has one row of shard sizes per item; so has the first result, whose
    row says to which combined shard each of the item's parts goes.
    """
    items, shards = sizes.shape
    heap = []
    state: dict[int, np.ndarray] = {}
    children: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for i in range(items):
        order = np.argsort(-sizes[i], kind="stable")
        state[i] = sizes[i][order]
        children.append((-1, i, order, order))
        heap.append((int(state[i][-1] - state[i][0]), i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        joined = state.pop(a) + state.pop(b)[::-1]
        order = np.argsort(-joined, kind="stable")
        place = np.empty(shards, dtype=np.int64)
        place[order] = np.arange(shards)
        node = len(children)
        children.append((a, b, place, place[::-1]))
        state[node] = joined[order]
        heapq.heappush(heap, (int(state[node][-1] - state[node][0]), node))
    target: dict[int, np.ndarray] = {heap[0][1]: np.arange(shards)}
    parts = np.empty((items, shards), dtype=np.int64)
    for node in range(len(children) - 1, -1, -1):
        a, b, one, two = children[node]
        to = target.pop(node)
        if a < 0:
            parts[b][one] = to
        else:
            target[a], target[b] = to[one], to[two]
    return parts, state[heap[0][1]]


def _dealt(groups: DataFrame, shards: int, tasks: int, start: list[int], total: int) -> DataFrame:
    """(item, size, shard): each task differences its groups with its share of ``start``, the shards' sizes so far."""

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "item"], kind="stable")
        own = frame["size"].to_numpy(dtype=np.int64)
        load = np.array([int(already * int(own.sum()) // max(1, total)) for already in start], dtype=np.int64)
        open_, filling = _filled(load, own)
        rest = len(own) - len(filling)
        sizes = np.zeros((rest + 1, len(open_)), dtype=np.int64)
        sizes[0] = load[open_]
        sizes[1:, 0] = own[:rest]
        parts, _ = differenced(sizes)
        label = open_[np.argsort(parts[0])]
        shard = np.concatenate([label[parts[1:, 0]], np.array(filling[::-1], dtype=np.int64)])
        return pd.DataFrame({"item": frame["item"], "size": own, "shard": shard})

    dealt = groups.withColumn("task", F.pmod(F.xxhash64("item"), F.lit(tasks)))
    return dealt.groupBy("task").applyInPandas(combine, "item string, size long, shard int")


def _filled(load: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(shards that are still to be filled, shard of each of the largest groups that fill one alone, largest first).

    A shard above the mean of those to be filled gets nothing more, and a group above it gets a
    shard of its own, as long as several are left. Otherwise their spread would be the largest in every
    step and the others would only be dealt out in turn. ``own`` is in rising order.
    """
    open_, filling = list(range(len(load))), []
    rest = int(own.sum())
    while len(open_) > 1:
        mean = (int(load[open_].sum()) + rest) / len(open_)
        fullest = max(open_, key=lambda shard: load[shard])
        if load[fullest] > mean:
            open_.remove(fullest)
        elif len(filling) < len(own) and own[-1 - len(filling)] > mean:
            emptiest = min(open_, key=lambda shard: load[shard])
            rest -= int(own[-1 - len(filling)])
            filling.append(emptiest)
            open_.remove(emptiest)
        else:
            break
    return np.array(open_, dtype=np.int64), filling


def balanced_groups(groups: DataFrame, shards: int = SHARDS, task_rows: int = TASK_ROWS) -> DataFrame:
    """(item, size, shard) for groups given as (item string, size long), which is read several times."""
    task_rows = max(task_rows, 8 * shards)
    count, total = groups.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, -(-count // task_rows))
    if tasks == 1:
        return _dealt(groups, shards, 1, [0] * shards, total)
    folder = shared_folder(groups.sparkSession)
    least = total // (4 * shards * tasks)
    large = balanced_groups(groups.where(F.col("size") > least), shards, task_rows)
    large = written(large, f"{folder}/large")
    already = _reached(large, shards)
    small = groups.where(F.col("size") <= least)
    last = F.pmod(F.xxhash64(F.lit("last"), "item"), F.lit(tasks)) == 0
    most = _dealt(small.where(~last), shards, tasks, already, total - sum(already))
    most = written(large.union(most), f"{folder}/most")
    reached = _reached(most, shards)
    return most.union(_dealt(small.where(last), shards, 1, reached, total - sum(reached)))


def _reached(dealt: DataFrame, shards: int) -> list[int]:
    sums = {r["shard"]: r["size"] for r in dealt.groupBy("shard").agg(F.sum("size").alias("size")).collect()}
    return [sums.get(shard, 0) for shard in range(shards)]


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, task_rows: int = TASK_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, size, text_crc32, group, shard, slot) for every row; equal texts share a shard.

    A group is as large as all its copies, so one above the mean shard fills a
    shard of its own and the others balance among themselves. Size is the UTF-8
    bytes plus 1; null texts have size 1, no crc32 and form a group of their own,
    as do empty ones. Slots count every shard's rows from 0, in buckets of about
    BUCKET_ROWS rows plus the rows of earlier buckets. Repeated rows and null ids
    get slots like others; an empty table gives no rows; other columns are not read.
    """
    folder = shared_folder(docs.sparkSession)
    data = F.encode(F.col(text_col), "UTF-8")
    rows = docs.select(
        id_col,
        (F.coalesce(F.octet_length(data), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.coalesce(F.sha2(data, 256), F.lit("")).alias("group"),
    )
    rows = written(rows, f"{folder}/rows")
    groups = rows.groupBy(F.col("group").alias("item")).agg(F.sum("size").alias("size"))
    groups = written(groups, f"{folder}/groups")
    if rows.isEmpty():
        return rows.select("*", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"))
    shard = balanced_groups(groups, shards, task_rows).select(F.col("item").alias("group"), "shard")
    placed = written(rows.join(shard, "group"), f"{folder}/placed")
    buckets = max(1, -(-placed.count() // (BUCKET_ROWS * shards)))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64(id_col, "group"), F.lit(buckets)))
    sums = placed.groupBy("shard", "bucket").count()
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "bucket").orderBy(id_col, "group")
    numbered = placed.withColumn("slot", F.row_number().over(within) - 1).join(sums, ["shard", "bucket"])
    return numbered.select(
        id_col, "size", "text_crc32", "group", "shard", (F.col("slot") + F.col("before")).cast("long").alias("slot")
    )
