"""Operator 11: hard negatives from Hilbert-ordered blocks with zone maps.

Vectors become integers. Candidates are ordered by label and by their place on a Hilbert
curve, and written as a Parquet table whose rows are numbered in that order: FILE_ROWS
consecutive numbers are a file, BLOCK_ROWS of these a block. A zone map keeps the least and the
largest component of every dimension for each block and label. Interval arithmetic on a zone map
bounds the inner products of an anchor with all rows of the block; an anchor reads the
blocks whose bounds meet one of its windows of scores.

The anchors' own files give a first bound: the score of the fifth best row of their label there.
The first reading finds the positives above it, the second the negatives between two shares of
each positive's score. Only blocks that some anchor of a chunk needs are joined with that
chunk, so a task holds a file's needed blocks and a chunk of anchors, whatever the size of a label
or of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.plans.storage import Scratch

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
BLOCK_ROWS = 256
#: 64 blocks, whose choice is one long of bits.
FILE_ROWS = 64 * BLOCK_ROWS
TASK_ROWS = 4 * FILE_ROWS
CHUNK_ANCHORS = 1_024
LANE_FILES = 64
#: Bits of a component and dimensions that the curve's key takes.
CURVE_BITS, CURVE_DIMS = 4, 64
#: Integer components stay below this, so that double products are exact.
MOST_COMPONENT = 1 << 20
#: Anchors that a task scores at once.
BATCH = 256
_FAR = 1 << 62


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of cell numbers on the Hilbert curve, as rows of bytes that sort like it.

    Skilling's transform (2004): rotations of the sub-cubes are undone from the highest bit
    down, then the Gray code; the bits are read plane by plane.
    """
    x = cells.astype(np.uint32).T.copy()
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        low = np.uint32((1 << bit) - 1)
        for d in range(dims):
            inverted = (x[d] >> np.uint32(bit) & 1).astype(bool)
            swapped = np.where(inverted, 0, (x[0] ^ x[d]) & low).astype(np.uint32)
            x[0] ^= np.where(inverted, low, swapped)
            x[d] ^= swapped
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> np.uint32(bit) & 1, np.uint32((1 << bit) - 1), np.uint32(0))
    x ^= turn
    planes = [(x >> np.uint32(bit) & 1).astype(np.uint8) for bit in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T, axis=1)


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.int32).reshape(-1, dims).astype(np.float64)


def _integers(vectors: DataFrame, anchor: Column, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, q, anchor) of the rows that take part."""
    vector = F.col(vector_col).cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    small = F.forall(vector, lambda x: F.abs(x * scale) < MOST_COMPONENT)
    rows = vectors.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where(sound)
    checked = F.when(small, vector).otherwise(
        F.raise_error(F.lit(f"a component of {MOST_COMPONENT} or more after scaling")).cast("array<double>")
    )
    return rows.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("string").alias("label"),
        F.transform(checked, lambda x: F.floor(x * scale).cast("int")).alias("q"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )


def _keyed(rows: DataFrame, dims: int, least: int, most: int) -> DataFrame:
    """(id, label, q, anchor, key): components as bytes, filled up with zeros, and the curve's key."""

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            q = np.zeros((len(batch), dims), dtype=np.int32)
            for at, row in enumerate(batch["q"]):
                q[at, : len(row)] = row
            part = q[:, :CURVE_DIMS].astype(np.int64) - least
            cells = (part << CURVE_BITS) // (most - least + 1)
            keys = hilbert_keys(np.clip(cells, 0, (1 << CURVE_BITS) - 1), CURVE_BITS)
            yield pd.DataFrame(
                {
                    "id": batch["id"].astype("Int64"),
                    "label": batch["label"],
                    "q": [row.tobytes() for row in q],
                    "anchor": batch["anchor"],
                    "key": [row.tobytes() for row in keys],
                }
            )

    return rows.mapInPandas(key, "id long, label string, q binary, anchor boolean, key binary")


def _zones_and_seeds(ordered: DataFrame, dims: int, positives: int) -> DataFrame:
    """A zone map per block and label, and the anchors of each file with their first bound."""

    def scan(file: pd.DataFrame) -> pd.DataFrame:
        file = file.sort_values("row")
        q, labels = _matrix(file["q"], dims), file["label"].to_numpy()
        numbers, blocks = file["row"].to_numpy(), file["row"].to_numpy() % FILE_ROWS // BLOCK_ROWS
        found = []
        for (block, label), at in file.reset_index(drop=True).groupby([blocks, labels]).groups.items():
            low, high = q[at].min(axis=0), q[at].max(axis=0)
            zone = (low.astype(np.int32).tobytes(), high.astype(np.int32).tobytes())
            found.append((numbers[0] // FILE_ROWS, int(block), label, *zone, None, None, None, None))
        marked = np.flatnonzero(file["anchor"].to_numpy())
        for start in range(0, len(marked), BATCH):
            rows = marked[start : start + BATCH]
            scores = q[rows] @ q.T
            scores[labels[rows][:, None] != labels] = -np.inf
            scores[np.arange(len(rows)), rows] = -np.inf
            best = np.full(len(rows), -np.inf)
            if len(q) >= positives:
                best = np.partition(scores, len(q) - positives, axis=1)[:, len(q) - positives]
            for row, seed in zip(rows, best, strict=True):
                one = file.iloc[row]
                bound = int(seed) if np.isfinite(seed) else -_FAR
                found.append((None, None, one["label"], None, None, one["row"], one["id"], one["q"], bound))
        names = ["file", "block", "label", "low", "high", "row", "id", "q", "seed"]
        return pd.DataFrame(found, columns=names).astype(
            {n: "Int64" for n in ("file", "block", "row", "id", "seed")}
        )

    kinds = "file long, block int, label string, low binary, high binary, row long, id long, q binary, seed long"
    return ordered.groupBy(F.floor(F.col("row") / FILE_ROWS).alias("of")).applyInPandas(scan, kinds)


def _visits(zones: DataFrame, anchors: DataFrame, dims: int, same: bool, chunks: int, lanes: int) -> DataFrame:
    """(file, chunk, row, blocks): the blocks of a file that an anchor has to read, as bits.

    ``anchors`` has windows of scores (lows, highs); ``same`` asks for rows of the anchor's
    label, else for those of others. Every anchor looks at every zone map, chunk by lane.
    """

    def choose(zone: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names = ["file", "chunk", "row", "blocks"]
        if not len(zone) or not len(asked):
            return pd.DataFrame([], columns=names)
        zone = zone.sort_values("file", kind="stable")
        low, high, q = _matrix(zone["low"], dims), _matrix(zone["high"], dims), _matrix(asked["q"], dims)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        most, least = up @ high.T + down @ low.T, up @ low.T + down @ high.T
        alike = asked["label"].to_numpy()[:, None] == zone["label"].to_numpy()
        needed = np.zeros(most.shape, dtype=bool)
        width = asked["lows"].str.len().max()
        for at in range(int(width)):
            lows = np.array([x[at] if at < len(x) else _FAR for x in asked["lows"]])[:, None]
            highs = np.array([x[at] if at < len(x) else -_FAR for x in asked["highs"]])[:, None]
            needed |= (lows <= highs) & (most >= lows) & (least <= highs)
        needed &= alike == same
        bits = np.where(needed, np.uint64(1) << zone["block"].to_numpy().astype(np.uint64), np.uint64(0))
        files = zone["file"].to_numpy()
        firsts = np.flatnonzero(np.diff(files, prepend=files[0] - 1))
        masks = np.bitwise_or.reduceat(bits, firsts, axis=1)
        rows, at = np.nonzero(masks)
        return pd.DataFrame(
            {
                "file": files[firsts][at],
                "chunk": asked["chunk"].to_numpy()[rows],
                "row": asked["row"].to_numpy()[rows],
                "blocks": masks[rows, at].view(np.int64),
            }
        )

    dealt = zones.withColumn("lane", F.pmod(F.xxhash64("file"), F.lit(lanes)))
    left = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = anchors.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    cells = left.groupBy("chunk", "lane").cogroup(right.groupBy("chunk", "lane"))
    return cells.applyInPandas(choose, "file long, chunk int, row long, blocks long")


def _best(ordered: DataFrame, visits: DataFrame, anchors: DataFrame, dims: int, same: bool, keep: int) -> DataFrame:
    """(row, number, other, other_id, score): the first ``keep`` rows of every window of an anchor."""

    def read(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names = ["row", "number", "other", "other_id", "score"]
        found = [pd.DataFrame({n: pd.Series([], dtype="Int64") for n in names})]
        if not len(rows) or not len(asked):
            return found[0]
        rows = rows.sort_values(["id", "row"], na_position="last")
        c, labels, numbers = _matrix(rows["q"], dims), rows["label"].to_numpy(), rows["row"].to_numpy()
        ids = rows["id"].astype("Int64").array
        last = len(rows) - np.arange(len(rows), dtype=np.float64)
        for start in range(0, len(asked), BATCH):
            part = asked.iloc[start : start + BATCH]
            scores = _matrix(part["q"], dims) @ c.T
            fits = (part["label"].to_numpy()[:, None] == labels) == same
            fits &= part["row"].to_numpy()[:, None] != numbers
            packed = np.abs(scores).max() < 1 << 38  # score and order of ids in one exact double
            ranked = scores * (len(rows) + 1) + last if packed else scores
            for at in range(int(part["lows"].str.len().max())):
                lows = np.array([x[at] if at < len(x) else _FAR for x in part["lows"]])[:, None]
                highs = np.array([x[at] if at < len(x) else -_FAR for x in part["highs"]])[:, None]
                inside = np.where(fits & (scores >= lows) & (scores <= highs), ranked, -np.inf)
                if packed and len(rows) > keep:
                    first = np.argpartition(inside, len(rows) - keep, axis=1)[:, len(rows) - keep :]
                elif packed:
                    first = np.tile(np.arange(len(rows)), (len(part), 1))
                else:
                    first = np.argsort(-inside, axis=1, kind="stable")[:, :keep]
                of, column = np.nonzero(np.isfinite(np.take_along_axis(inside, first, axis=1)))
                other = first[of, column]
                found.append(
                    pd.DataFrame(
                        {
                            "row": part["row"].to_numpy()[of],
                            "number": at,
                            "other": numbers[other],
                            "other_id": ids[other],
                            "score": scores[of, other].astype(np.int64),
                        }
                    ).astype("Int64")
                )
        return pd.concat(found)

    needed = visits.groupBy("file", "chunk").agg(F.bit_or("blocks").alias("needed"))
    file = F.floor(F.col("row") / FILE_ROWS)
    block = F.floor(F.col("row") % FILE_ROWS / BLOCK_ROWS).cast("int")
    blocks = ordered.select("row", "id", "label", "q", file.alias("file"), block.alias("block")).join(needed, "file")
    blocks = blocks.where(F.expr("getbit(needed, block) = 1")).drop("needed", "block")
    asked = visits.select(F.col("file").alias("of_file"), F.col("chunk").alias("of_chunk"), "row")
    asked = asked.join(anchors.drop("chunk"), "row")
    cells = blocks.groupBy("file", "chunk").cogroup(asked.groupBy("of_file", "of_chunk"))
    scored = cells.applyInPandas(read, "row long, number int, other long, other_id long, score long")
    first = Window.partitionBy("row", "number").orderBy(F.desc("score"), F.asc_nulls_last("other_id"), "other")
    return scored.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= keep)


def mine_hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` marks the anchors; every other row is a candidate for each of them. Components
    become floor(``scale`` * x), a score is an inner product of these. Positives are the first rows
    of the anchor's label, negatives the first rows of other labels with a score from ``low`` to
    ``high`` hundredths of the positive's; higher scores come first, ties by id, null ids last.

    Rows with a null label, a null vector or a null or non-finite component take no part.
    Rows that repeat an id are rows of their own: such anchors are mined once each, and are
    candidates for each other. Components missing at the end of a shorter vector count as
    zero. Components of 2 ** 20 or more after scaling raise, as scores would not be exact.
    An empty table, or one without anchors, has no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = scratch.write(_integers(vectors, anchor, scale, id_col, vector_col, label_col), "rows")
    nothing = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    known = rows.agg(
        F.count("*"), F.max(F.size("q")), F.min(F.array_min("q")), F.max(F.array_max("q")), F.max(F.col("anchor").cast("int"))
    ).first()
    if not known[0] or not known[4]:
        return spark.createDataFrame([], nothing)
    dims = max(1, known[1])
    keyed = scratch.write(_keyed(rows, dims, known[2] or 0, known[3] or 0), "keyed")
    scratch.drop("rows")
    order = ("label", "key", "id")
    ordered = keyed.repartitionByRange(-(-known[0] // TASK_ROWS), *order).sortWithinPartitions(*order)
    ordered = scratch.write(ordered.select(F.monotonically_increasing_id().alias("row"), "id", "label", "q", "anchor"), "ordered")
    scratch.drop("keyed")

    scanned = scratch.write(_zones_and_seeds(ordered, dims, positives), "scanned")
    zones = scanned.where("file IS NOT NULL").select("file", "block", "label", "low", "high")
    anchors = scanned.where("file IS NULL").select("row", "id", "label", "q", "seed")
    files, many = scanned.agg(F.count_distinct("file"), F.count("row")).first()
    lanes = -(-files // LANE_FILES)
    dealt = anchors.repartitionByRange(-(-many // CHUNK_ANCHORS), "row").select(
        F.spark_partition_id().alias("chunk"),
        "row", "id", "label", "q",
        F.array("seed").alias("lows"),
        F.array(F.lit(_FAR)).alias("highs"),
    )
    dealt = scratch.write(dealt, "anchors")
    chunks = dealt.agg(F.max("chunk")).first()[0] + 1

    visits = scratch.write(_visits(zones, dealt, dims, True, chunks, lanes), "visits-1")
    found = scratch.write(_best(ordered, visits, dealt, dims, True, positives), "positives")
    shares = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("ranked"))
    asked = dealt.drop("lows", "highs").join(shares, "row").select(
        "chunk", "row", "id", "label", "q",
        F.transform("ranked", lambda x: _hundredths(x["score"] * low, True)).alias("lows"),
        F.transform("ranked", lambda x: _hundredths(x["score"] * high, False)).alias("highs"),
    )
    asked = scratch.write(asked, "asked")
    visits = scratch.write(_visits(zones, asked, dims, False, chunks, lanes), "visits-2")
    mined = scratch.write(_best(ordered, visits, asked, dims, False, negatives), "negatives")
    scratch.drop("visits-1", "visits-2", "ordered", "scanned", "asked")
    pairs = found.select(
        "row", (F.col("rank") - 1).alias("number"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return (
        mined.select("row", "number", "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(pairs, ["row", "number"])
        .join(dealt.select("row", F.col("id").alias("anchor_id")), "row")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def _hundredths(value: Column, up: bool) -> Column:
    """value / 100 as a whole number, rounded up or down."""
    down = F.pmod(-value if up else value, F.lit(100))
    return ((value + down if up else value - down) / 100).cast("long")
