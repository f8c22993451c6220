"""Operator 2: near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Unit vectors are centred, projected on their principal axes and turned by a rotation that
brings them as near as possible to the corners of a cube (Gong and Lazebnik 2011); the signs
are a code of at most 64 bits. Mean, axes and rotation are learned from SAMPLE_ROWS vectors of
smallest hashed id; every vector is coded and indexed. The code is cut into four parts, each
a table (Norouzi et al. 2012): a vector is stored under its four parts and looked up under these
and every part that differs in one bit. So all pairs of at most seven differing bits meet, and
most of more. A pair that meets in several tables counts in the first. Of pairs that meet, those
whose unit vectors are too far apart already in LANES of the rotated coordinates, kept in a byte
each, are left out at once: the distance in some coordinates is no more than that in all. The rest are
compared by the cosine of the original vectors in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.components import connected_components
from tideline.llm.neighbours import usable
from tideline.plans.storage import Scratch

COSINE = 0.98
SAMPLE_ROWS = 20_000
ROTATIONS = 50
PARTS, PART_BITS = 4, 16
SEED = 41
#: Rotated coordinates kept in a byte each, eight to a machine word, and the steps of a byte in a length of one.
LANES, STEPS = 16, 127.5
LANE_NAMES = ("lanes", "lanes2")
#: Keys looked up in one pass over a table, and passes over it at most.
PASS_KEYS, MOST_PASSES = 32_000_000, 4


def learned_rotation(sample: np.ndarray, rounds: int = ROTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of iterative quantisation; the projection's columns give the bits."""
    bits = min(sample.shape[1], PARTS * PART_BITS)
    mean = sample.mean(axis=0)
    _, _, axes = np.linalg.svd(np.cov((sample - mean).T).reshape(sample.shape[1], -1))
    reduced = (sample - mean) @ axes[:bits].T
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    for _ in range(rounds):
        corners = np.where(reduced @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(corners.T @ reduced)
        turn = (left @ right).T
    return mean, axes[:bits].T @ turn


def _coded(classes: DataFrame, mean: np.ndarray, projection: np.ndarray) -> DataFrame:
    """(class, label, code, lanes, lanes2)."""
    # Coordinates from all parts: pairs that meet have the signs of one part in common.
    some = projection[:, np.argsort(np.arange(projection.shape[1]) % PART_BITS, kind="stable")[:LANES]]

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = np.stack(batch["vector"].to_numpy()).astype(np.float64)
            rows /= np.abs(rows).max(axis=1, keepdims=True)
            rows /= np.linalg.norm(rows, axis=1, keepdims=True)
            signs = np.zeros((len(rows), 64), dtype=np.uint8)
            signs[:, : projection.shape[1]] = (rows - mean) @ projection >= 0
            codes = np.packbits(signs, axis=1, bitorder="little").view(np.int64).ravel()
            lanes = np.zeros((len(rows), LANES), dtype=np.uint8)
            lanes[:, : some.shape[1]] = np.clip(np.floor((rows @ some + 1) * STEPS), 0, 255)
            words = lanes.view(np.int64).T
            yield pd.DataFrame(
                {"class": batch["class"], "label": batch["label"], "code": codes}
                | {name: word.copy() for name, word in zip(LANE_NAMES, words, strict=True)}
            )

    kind = classes.schema["label"].dataType.simpleString()
    return classes.select("class", "label", "vector").mapInPandas(
        code, f"class long, label {kind}, code long, " + ", ".join(f"{name} long" for name in LANE_NAMES)
    )


def least_hashed(classes: DataFrame, number: int, rows: int) -> DataFrame:
    """(vector, norm) of the ``rows`` classes of smallest hash, in its order; ``number`` is that of all.

    Each task of a sorted limit sends as many rows to the driver, so only little more than the
    rows are sorted: hashes are even, and the part below a bound is made larger until it has enough.
    """
    hashed = classes.withColumn("hashed", F.xxhash64("label", "digest"))
    share = 1.2 * rows / max(1, number)
    while share < 1:
        below = hashed.where(F.col("hashed") < int(share * 2**64) - 2**63)
        if below.count() >= rows:
            hashed = below
            break
        share *= 2
    return hashed.orderBy("hashed", "digest").limit(rows).select("vector", "norm")


def _part(code: str | Column, number: int) -> Column:
    mask = F.lit((1 << PART_BITS) - 1).cast("long")
    return F.shiftrightunsigned(code, number * PART_BITS).bitwiseAND(mask)


def _near_lanes(one: list[Column], two: list[Column], cosine: float) -> Column:
    """Whether the lanes leave the cosine possible: rounding down turns each difference by less than a step."""
    squares = []
    for word, word2 in zip(one, two, strict=True):
        for shift in range(0, 64, 8):
            apart = F.shiftright(word, shift).bitwiseAND(255) - F.shiftright(word2, shift).bitwiseAND(255)
            squares.append(apart * apart)
    most = (math.sqrt(max(0.0, 2 - 2 * cosine) + 1e-9) * STEPS + math.sqrt(LANES)) ** 2
    return sum(squares[1:], squares[0]) <= int(most)


def _meeting_pairs(coded: DataFrame, cosine: float, tables: range = range(PARTS), slices: int = 1, number: int = 0) -> DataFrame:
    """(class, class2) of equal label whose codes have a part within one bit; each pair once.

    Only those that meet in the tables, under keys of one of the slices; without pairs that the lanes show to be too far apart.
    """
    part = F.explode(F.array(*[F.struct(F.lit(t).alias("table"), _part("code", t).alias("own")) for t in tables])).alias("at")
    parts = coded.select("*", part).select(*coded.columns, "at.table", F.col("at.own").alias("key"))
    stored = parts.toDF(*[f"{name}_" for name in parts.columns])
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << bit).cast("long") for bit in range(PART_BITS)])
    asked = parts.withColumn("flip", F.explode(flips)).withColumn("key", F.col("key").bitwiseXOR(F.col("flip"))).drop("flip")
    if slices > 1:
        asked = asked.where(F.col("key") % slices == number)
        stored = stored.where(F.col("key_") % slices == number)
    differ = F.col("code").bitwiseXOR(F.col("code_"))
    first = F.lit(True)
    for table in range(PARTS):
        apart = F.bit_count(_part(differ, table)) > 1
        first = first & (apart | (F.col("table") <= table))
    on = (
        (F.col("label") == F.col("label_"))
        & (F.col("table") == F.col("table_"))
        & (F.col("key") == F.col("key_"))
        & (F.col("class") < F.col("class_"))
        & _near_lanes([F.col(name) for name in LANE_NAMES], [F.col(f"{name}_") for name in LANE_NAMES], cosine)
        & first
    )
    return asked.join(stored, on).select("class", F.col("class_").alias("class2"))


def _pair_passes(number: int) -> list[tuple[range, int, int]]:
    """(tables, slices, slice) of each pass over the keys of ``number`` classes, so that one pass's keys at a time are moved."""
    keys = number * (1 + PART_BITS)
    if PARTS * keys <= PASS_KEYS:
        return [(range(PARTS), 1, 0)]
    slices = min(MOST_PASSES, -(-keys // PASS_KEYS))
    return [(range(table, table + 1), slices, at) for table in range(PARTS) for at in range(slices)]


def embedding_components(
    vectors: DataFrame,
    cosine: float = COSINE,
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Vectors link if their labels are equal and not null and their cosine is at least
    ``cosine``. Null, empty and zero vectors, those with a null or non-finite component, rows
    without a label and rows without an id link with nothing: they have no links and are
    their own component. Equal vectors of a label are one class, whatever their number; rows
    that repeat an id are vectors of their own. Vectors must have one length. An empty
    table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(
        F.col(id_col).alias("id"),
        F.col(label_col).alias("label"),
        vector.alias("vector"),
        (usable(vector) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).alias("linked"),
        F.md5(F.to_json(vector).cast("binary")).alias("digest"),
    )
    able = rows.where("linked")
    classes = able.groupBy("label", "digest").agg(
        F.min("id").cast("long").alias("least"), F.count("*").alias("size"), F.min("vector").alias("vector")
    )
    # Ids may repeat, so a class has a number of its own, fixed as the table is written.
    classes = classes.withColumn("class", F.monotonically_increasing_id())
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    classes = classes.withColumn("vector", F.transform("vector", lambda x: x / largest))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x))
    classes = scratch.write(classes.withColumn("norm", norm), "classes")
    number = classes.count()
    sample = least_hashed(classes, number, sample_rows).collect()
    if len(sample) < 2:
        links = spark.createDataFrame([], "class long, class2 long")
    else:
        learned = np.array([r["vector"] for r in sample]) / np.array([r["norm"] for r in sample])[:, None]
        coded = scratch.write(_coded(classes, *learned_rotation(learned)), "codes")
        pairs = [
            scratch.write(_meeting_pairs(coded, cosine, *some), f"pairs-{at}") for at, some in enumerate(_pair_passes(number))
        ]
        pairs_met = reduce(DataFrame.union, pairs)
        ids = pairs_met.select("class").union(pairs_met.select("class2")).distinct()
        # Both ends of a pair need vectors, but few classes are in one.
        needed = scratch.write(classes.select("class", "vector", "norm").join(ids, "class", "left_semi"), "needed")
        links = _linked(pairs_met, needed, cosine)
    links = scratch.write(links, "links")
    if len(sample) >= 2:
        scratch.drop("codes", "needed", *[f"pairs-{at}" for at in range(len(pairs))])
    both = links.union(links.select("class2", "class"))
    sizes = classes.select(F.col("class").alias("class2"), "size")
    counts = both.join(sizes, "class2").groupBy("class").agg(F.sum("size").alias("others"))
    roots = connected_components(links, "class", "class2")
    placed = (
        classes.select("label", "digest", "class", "size", "least")
        .join(counts, "class", "left")
        .join(roots, F.col("class") == F.col("node"), "left")
        .withColumn("root", F.coalesce("root", "class"))
    )
    placed = scratch.write(placed.drop("node"), "placed")
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(names, "root").select(
        "label", "digest", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id"
    )
    found = able.select("id", "label", "digest").join(named, ["label", "digest"]).select(
        "id", "n_links", "component_id"
    )
    alone = rows.where(~F.col("linked")).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id")
    )
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    return found.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", kept)


def _linked(pairs: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """The pairs whose original vectors have the cosine."""
    one = classes.select("class", "vector", "norm")
    two = one.toDF("class2", "vector2", "norm2")
    dot = F.aggregate(F.zip_with("vector", "vector2", lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    both = pairs.join(one, "class").join(two, "class2")
    return both.where(dot / (F.col("norm") * F.col("norm2")) >= cosine).select("class", "class2")
