"""Operator 10: approximate nearest neighbours by inner product, a navigable small-world graph per shard.

Distinct vectors are dealt by hash to shards of about SHARD_ROWS. Each shard builds a
hierarchical navigable small-world graph (Malkov and Yashunin 2018) that is stored as flat
arrays: vectors in order of falling level, and for each level a table of neighbour numbers
with a fixed number of columns. A new node descends through the graph built so far and links to
a spread of the nodes that its walk found. A vector is divided by the largest norm and given one
more component that makes its length 1, so that the nearest by angle is the one of largest inner
product. Insertions and searches run in blocks, all rows of a block taking a step at a time.
Every shard is a partition of its own. Every query goes to every shard; the shards' best are
rescored in double precision on the original vectors and merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.plans.storage import shared_folder, written

SHARD_ROWS = 16_384
LINKS = 24
BUILD_WIDTH = 64
SEARCH_WIDTH = 200
BLOCK = 512
#: Nodes of each row whose neighbours a step of a walk looks at.
STEP = 4
SEED = 97


class SmallWorld:
    """The graph of one shard, in flat arrays."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH, seed: int = SEED):
        count = len(vectors)
        draws = np.random.default_rng(seed).random(count)
        levels = np.minimum(np.floor(-np.log(1.0 - draws) / np.log(links)).astype(np.int64), 8)
        self.order = np.argsort(-levels, kind="stable")
        self.points = np.ascontiguousarray(vectors[self.order], dtype=np.float32)
        ranked = levels[self.order]
        self.links: list[np.ndarray] = []
        for level in range(int(ranked[0]) + 1 if count else 0):
            members = int((ranked >= level).sum())
            self.links.append(np.full((members, links * 2 if level == 0 else links), -1, dtype=np.int32))
        done = 0
        while done < count:
            size = min(BLOCK, max(16, done), count - done)
            self._insert(done, size, links, width)
            done += size

    def _insert(self, done: int, size: int, links: int, width: int) -> None:
        """Inserts the next ``size`` nodes after the first ``done``, on all their levels.

        Every node descends from node 0, greedily above its own levels; on these, its links are spread over the
        ``width`` nodes that its walk found and its nearest in the block, which no walk can meet yet.
        """
        own = np.arange(done, done + size)
        queries = self.points[own]
        near = queries @ queries.T
        np.fill_diagonal(near, -np.inf)
        entry = np.zeros(size, dtype=np.int64)
        for level in range(len(self.links) - 1, -1, -1):
            table = self.links[level]
            before, here = min(done, len(table)), max(0, min(size, len(table) - done))
            found = np.zeros((here, 0), dtype=np.int64)
            found_likes = np.zeros((here, 0), dtype=np.float32)
            if done and here:
                found, found_likes = self._walk(queries[:here], entry[:here], level, width, before)
                entry[:here] = found[:, 0]
            if done and here < size:
                entry[here:] = self._walk(queries[here:], entry[here:], level, 1, before)[0][:, 0]
            if here:
                keep = min(here, links * 2)
                ids = np.argpartition(-near[:here, :here], keep - 1, axis=1)[:, :keep]
                likes = np.take_along_axis(near[:here], ids, axis=1)
                ids = np.where(np.isinf(likes), -1, ids + done)
                ids, likes = np.hstack([ids, found]), np.hstack([likes, found_likes])
                chosen, chosen_likes = self._spread(ids, likes, links)
                table[own[:here], :links] = chosen
                self._link_back(table, own[:here], chosen, chosen_likes)

    def _entries(self, queries: np.ndarray, level: int) -> np.ndarray:
        """Where to enter ``level``: the nearest node that a greedy walk meets on the levels above."""
        entry = np.zeros(len(queries), dtype=np.int64)
        for upper in range(len(self.links) - 1, level, -1):
            entry = self._walk(queries, entry, upper, 1, len(self.links[upper]))[0][:, 0]
        return entry

    def _walk(
        self, queries: np.ndarray, entry: np.ndarray, level: int, width: int, members: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best nodes found for each query, best first, and their likeness; -1 fills up."""
        rows, table = len(queries), self.links[level]
        at_once = min(width, STEP)
        # The number of the step's column that reached a node first, from 1.
        seen = np.zeros((rows, members), dtype=np.int16)
        ids = np.full((rows, width), -1, dtype=np.int64)
        likes = np.full((rows, width), -np.inf, dtype=np.float32)
        spent = np.ones((rows, width), dtype=bool)
        ids[:, 0], spent[:, 0] = entry, False
        likes[:, 0] = np.einsum("ij,ij->i", queries, self.points[entry])
        seen[np.arange(rows), entry] = 1
        active = np.arange(rows)
        while True:
            active = active[~spent[active].all(axis=1)]
            if not len(active):
                break
            open_likes = np.where(spent[active], -np.inf, likes[active])
            steps = np.argpartition(-open_likes, at_once - 1, axis=1)[:, :at_once]
            closed = np.isinf(np.take_along_axis(open_likes, steps, axis=1))
            spent[active[:, None], steps] = True
            next_ids = table[ids[active[:, None], steps]]
            next_ids[closed] = -1
            next_ids = next_ids.reshape(len(active), -1)
            row, column = np.nonzero((next_ids >= 0) & (seen[active[:, None], next_ids] == 0))
            node = next_ids[row, column]
            seen[active[row], node] = column + 1
            own = seen[active[row], node] == column + 1
            row, column, node = row[own], column[own], node[own]
            new_ids = np.full(next_ids.shape, -1, dtype=np.int64)
            new_ids[row, column] = node
            likeness = np.full(next_ids.shape, -np.inf, dtype=np.float32)
            likeness[row, column] = np.einsum("ij,ij->i", queries[active[row]], self.points[node])
            pool = np.hstack([likes[active], likeness])
            best = np.argpartition(-pool, width - 1, axis=1)[:, :width]
            likes[active] = np.take_along_axis(pool, best, axis=1)
            ids[active] = np.take_along_axis(np.hstack([ids[active], new_ids]), best, axis=1)
            spent[active] = np.take_along_axis(np.hstack([spent[active], new_ids < 0]), best, axis=1)
        order = np.argsort(-likes, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(likes, order, axis=1)

    def _spread(self, ids: np.ndarray, likes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to ``most`` of each row's candidates, best first, that are nearer to the row than to one chosen before.

        Places left over go to the best of the others.
        """
        order = np.argsort(-likes, axis=1, kind="stable")
        ids, likes = np.take_along_axis(ids, order, axis=1), np.take_along_axis(likes, order, axis=1)
        rows, width = ids.shape
        points = self.points[ids]
        between = points @ points.transpose(0, 2, 1)
        real = ids >= 0
        chosen = np.zeros((rows, width), dtype=bool)
        closest = np.full((rows, width), -np.inf, dtype=np.float32)
        count = np.zeros(rows, dtype=np.int64)
        for at in range(width):
            take = real[:, at] & (likes[:, at] > closest[:, at]) & (count < most)
            chosen[take, at] = True
            count += take
            closest[take] = np.maximum(closest[take], between[take, at])
        rank = np.argsort(np.where(real, ~chosen, 2), axis=1, kind="stable")[:, :most]
        out = np.full((rows, most), -1, dtype=np.int64)
        out_likes = np.full((rows, most), -np.inf, dtype=np.float32)
        out[:, : rank.shape[1]] = np.where(
            np.take_along_axis(real, rank, axis=1), np.take_along_axis(ids, rank, axis=1), -1
        )
        out_likes[:, : rank.shape[1]] = np.take_along_axis(likes, rank, axis=1)
        return out, out_likes

    def _link_back(self, table: np.ndarray, own: np.ndarray, chosen: np.ndarray, likes: np.ndarray) -> None:
        """Adds the block's nodes to their neighbours' rows; rows that overflow are spread anew, with room for more."""
        real = chosen >= 0
        to, new = chosen[real], np.repeat(own, real.sum(axis=1))
        order = np.argsort(to, kind="stable")
        to, new = to[order], new[order]
        nodes, starts, counts = np.unique(to, return_index=True, return_counts=True)
        columns = table.shape[1]
        for at in range(0, len(nodes), BLOCK):
            part, first, many = nodes[at : at + BLOCK], starts[at : at + BLOCK], counts[at : at + BLOCK]
            extra = np.full((len(part), int(many.max())), -1, dtype=np.int64)
            place = np.arange(extra.shape[1])
            filled = place < many[:, None]
            extra[filled] = new[(first[:, None] + place)[filled]]
            have = table[part].astype(np.int64)
            extra[(extra[:, :, None] == have[:, None, :]).any(axis=2)] = -1
            both = np.hstack([have, extra])
            room = (both >= 0).sum(axis=1) <= columns
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
            table[part[room]] = packed[room, :columns]
            if not room.all():
                tight, crowd = part[~room], both[~room]
                likeness = np.einsum("ij,ikj->ik", self.points[tight], self.points[crowd])
                likeness[crowd < 0] = -np.inf
                table[tight] = -1
                kept = columns * 3 // 4
                table[tight, :kept] = self._spread(crowd, likeness, kept)[0]

    def search(self, queries: np.ndarray, most: int, width: int = SEARCH_WIDTH) -> np.ndarray:
        """Numbers of the ``most`` nearest vectors found for each query; -1 fills up."""
        out = np.full((len(queries), most), -1, dtype=np.int64)
        if not self.links:
            return out
        for at in range(0, len(queries), BLOCK):
            part = np.ascontiguousarray(queries[at : at + BLOCK], dtype=np.float32)
            entry = self._entries(part, 0)
            found = self._walk(part, entry, 0, max(width, most), len(self.points))[0][:, :most]
            out[at : at + BLOCK] = np.where(found >= 0, self.order[found], -1)
        return out


def usable(vector: Column) -> Column:
    """Neither null nor zero, and no component null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    most: int = 20,
    shard_rows: int = SHARD_ROWS,
    links: int = LINKS,
    build_width: int = BUILD_WIDTH,
    search_width: int = SEARCH_WIDTH,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, id, score): the ``most`` vectors of largest inner product found for each query.

    A query is never its own candidate. Vectors that are null, empty, zero or hold a null
    or non-finite component take no part, nor do rows without an id; an id that comes
    more than once counts once, with its smallest vector; ties go to the smaller id. Equal
    vectors are one node of the graph, and their ids are added from its ``most`` + 1
    smallest. Vectors must have one length. Empty inputs give no rows; other columns are not
    read.
    """
    spark = vectors.sparkSession
    folder = shared_folder(spark)

    def clean(frame: DataFrame) -> DataFrame:
        kept = frame.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
        kept = kept.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(vector_col).alias("vector"))
        return kept.withColumn("vector", F.col("vector").cast("array<double>"))

    asked = written(clean(queries), f"{folder}/queries")
    same = Window.partitionBy("vector").orderBy("id")
    members = clean(vectors).withColumn("place", F.row_number().over(same)).where(F.col("place") <= most + 1)
    members = written(members, f"{folder}/members")
    nodes = members.where("place = 1").select("id", "vector")
    squares = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    count, largest = nodes.agg(F.count("*"), F.sqrt(F.max(squares))).first()
    shards = max(1, -(-count // shard_rows))
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    stored = nodes.select(shard.alias("shard"), F.lit(0).alias("kind"), "id", "vector")
    sent = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "vector"
    )
    rows = stored.union(sent).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind", "id")
    scale = largest or 1.0

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        graph, names, points, current = None, np.zeros(0, np.int64), np.zeros((0, 0)), None
        for batch in batches:
            groups = batch.groupby(["shard", "kind"], sort=True)
            for (number, kind), group in groups:
                if number != current:
                    ids, parts, graph, current = [], [], None, number
                block = np.stack(group["vector"].to_numpy()).astype(np.float64)
                if kind == 0:
                    ids.append(group["id"].to_numpy())
                    parts.append(block)
                    continue
                if not ids:
                    continue
                if graph is None:
                    names, points = np.concatenate(ids), np.concatenate(parts)
                    unit = points / scale
                    last = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", unit, unit)))
                    graph = SmallWorld(np.hstack([unit, last[:, None]]), links, build_width)
                length = np.linalg.norm(block, axis=1, keepdims=True)
                asks = np.hstack([block / length, np.zeros((len(block), 1))])
                found = graph.search(asks, most + 1, search_width)
                query, place = np.nonzero(found >= 0)
                node = found[query, place]
                yield pd.DataFrame(
                    {
                        "query_id": group["id"].to_numpy()[query],
                        "node": names[node],
                        "score": np.einsum("ij,ij->i", block[query], points[node]),
                    }
                )

    found = rows.mapInPandas(search, "query_id long, node long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most + 1).drop("place")
    named = members.select(
        "id", F.first("id").over(same.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("node")
    )
    listed = found.join(named, "node").where(F.col("id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = listed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
