"""Hard negatives against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, step=10, positives=5, negatives=10):
    rows = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    dims = max((len(r[1]) for r in rows), default=0)
    q = [[math.floor(256 * float(np.float32(x))) for x in r[1]] + [0] * (dims - len(r[1])) for r in rows]
    found = []
    for a, (anchor, _, label) in enumerate(rows):
        if anchor is None or anchor % step:
            continue
        scores = [(sum(x * y for x, y in zip(q[a], v, strict=True)), rows[i][0], i) for i, v in enumerate(q)]
        ranked = sorted(scores, key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for score, positive, _ in [s for s in ranked if s[2] != a and rows[s[2]][2] == label][:positives]:
            fits = [s for s in ranked if rows[s[2]][2] != label and 30 * score <= 100 * s[0] <= 90 * score]
            found += [(anchor, positive, k + 1, n[1], score, n[0]) for k, n in enumerate(fits[:negatives])]
    return sorted(found, key=repr)


def result(spark, rows, step=10):
    vectors = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "row", "q", "file", "anchor")})
    found = hard_negatives.mine_hard_negatives(vectors, F.col("vec_id") % step == 0)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def clouds(seed, many, dims=6, labels=3):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((8, dims))
    rows = []
    for i in range(many):
        v = centres[draw.integers(8)] + 0.4 * draw.standard_normal(dims)
        rows.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(draw.integers(labels))))
    return rows


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (5, 2)])
def test_the_curve_visits_every_cell_a_step_at_a_time(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = [k.tobytes() for k in hard_negatives.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    ordered = cells[sorted(range(len(cells)), key=lambda i: keys[i])]
    assert (np.abs(np.diff(ordered, axis=0)).sum(axis=1) == 1).all()


def test_equals_brute_force(spark):
    rows = clouds(1, 700)
    expected = brute(rows)
    assert len(expected) > 1000
    assert result(spark, rows) == expected


def test_small_blocks_are_chosen_by_their_bounds(spark, monkeypatch):
    for name, value in dict(BLOCK_ROWS=4, FILE_ROWS=256, TASK_ROWS=300, CHUNK_ANCHORS=10, LANE_FILES=1, BATCH=3).items():
        monkeypatch.setattr(hard_negatives, name, value)
    rows = clouds(2, 900)
    assert result(spark, rows) == brute(rows)


def test_bounds_leave_blocks_unread(spark):
    draw = np.random.default_rng(5)
    zones, asked = [], []
    for block in range(64):
        centre = draw.integers(-100, 100, 8)
        zones.append((0, block, "a", (centre - 3).astype(np.int32).tobytes(), (centre + 3).astype(np.int32).tobytes(), centre))
    query = zones[7][5].astype(np.int32)
    score = int(query @ query)
    asked = spark.createDataFrame(
        [(0, 1, "a", bytearray(query.tobytes()), [score - 10], [score + 10])],
        "chunk int, row long, label string, q binary, lows array<long>, highs array<long>",
    )
    frame = spark.createDataFrame([(z[0], z[1], z[2], bytearray(z[3]), bytearray(z[4])) for z in zones], "file long, block int, label string, low binary, high binary")
    mask = hard_negatives._visits(frame, asked, 8, True, 1, 1).first()["blocks"]
    bounds = [sum(max(a * (c - 3), a * (c + 3)) for a, c in zip(query, z[5], strict=True)) for z in zones]
    least = [sum(min(a * (c - 3), a * (c + 3)) for a, c in zip(query, z[5], strict=True)) for z in zones]
    needed = {z[1] for z, up, low in zip(zones, bounds, least, strict=True) if up >= score - 10 and low <= score + 10}
    assert {b for b in range(64) if mask >> b & 1} == needed
    assert 7 in needed and len(needed) < 32


def test_odd_rows(spark):
    draw = random.Random(4)
    rows = [(i, [draw.choice([0.0, 0.5, -0.5, 1.0]) for _ in range(3)], draw.choice([0, 0, 0, 1])) for i in range(60)]
    rows += rows[10:14] * 2 + [(None, [0.5, 0.5, 0.0], 1), (None, [0.5, 0.5, 0.0], 0), (100, [0.5], 0), (110, [], 1)]
    rows += [(120, None, 1), (130, [0.1, None, 0.2], 1), (140, [0.1, float("nan"), 0.2], 0), (150, [float("inf"), 0.0, 0.0], 0)]
    rows += [(160, [1.0, 0.0, 0.0], None), (170, [-1.0, -1.0, -1.0], 5), (180, [0.0, 0.0, 0.0], 0)]
    expected = brute(rows)
    assert expected and any(r[3] is None for r in expected)
    assert result(spark, rows) == expected
    assert result(spark, []) == [] and result(spark, [(1, [1.0], 1)]) == []
    assert result(spark, [(0, [1.0], 1)]) == [] and result(spark, [(0, [], 1), (1, [], 2), (2, [], 1)]) == brute([(0, [], 1), (1, [], 2), (2, [], 1)])


def test_large_components(spark):
    rows = [(i, [float(1000 + i), float(-i)], i % 2) for i in range(40)]
    assert result(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="after scaling"):
        result(spark, [(0, [1e9], 1), (1, [1.0], 1)])
