"""Embedding dedup: what reaches the driver, and which pairs are kept before vectors join them."""

import numpy as np
from plans import planned
from pyspark.sql import functions as F

from tideline.llm import embedding_dedup


def vectors_of(spark, count, seed=5):
    draw = np.random.default_rng(seed)
    points = draw.standard_normal((count, 24))
    points[count // 2 :] = points[: count - count // 2] + 0.06 * draw.standard_normal((count - count // 2, 24))
    rows = [(i, point.tolist(), i % 2) for i, point in enumerate(np.concatenate([points, points[:5]]))]
    return points, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_the_sample_is_cut_before_it_is_sorted(spark):
    classes = spark.range(4_000).selectExpr("id % 3 AS label", "md5(cast(id AS string)) AS digest", "array(id, 1D) AS vector", "1D AS norm")
    hashed = F.xxhash64("label", "digest")
    for rows in (1, 50, 3_900, 5_000):
        expected = classes.orderBy(hashed, "digest").limit(rows).select("vector", "norm").collect()
        found = embedding_dedup.least_hashed(classes, 4_000, rows)
        assert found.collect() == expected
        assert rows > 3_000 or "Filter" in planned(found)
    assert embedding_dedup.least_hashed(classes.where("false"), 0, 10).collect() == []


def test_pairs_too_far_apart_are_left_out_and_passes_find_the_same(spark, monkeypatch):
    points, vectors = vectors_of(spark, 400)
    kept, meeting = [], embedding_dedup._meeting_pairs

    def counted(*args):
        kept.append(meeting(*args).count())
        return meeting(*args)

    monkeypatch.setattr(embedding_dedup, "_meeting_pairs", counted)
    found = sorted(map(tuple, embedding_dedup.embedding_components(vectors).collect()))
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    near = sum(unit[i] @ unit[j] >= 0.98 and (i - j) % 2 == 0 for i in range(400) for j in range(i))
    assert len(kept) == 1 and 0 < near <= kept[0] <= 2 * near
    monkeypatch.setattr(embedding_dedup, "PASS_KEYS", 5_000)
    assert sorted(map(tuple, embedding_dedup.embedding_components(vectors).collect())) == found
    assert len(kept) == 1 + embedding_dedup.PARTS * 2 and sum(kept[1:]) == kept[0]


def test_lanes_never_hide_a_near_pair(spark):
    draw = np.random.default_rng(8)
    turn, _ = np.linalg.qr(draw.standard_normal((64, 64)))
    rows = draw.standard_normal((500, 64))
    others = rows + draw.uniform(0, 1.2, (500, 1)) * draw.standard_normal((500, 64))
    sides = []
    for side in (rows, others):
        classes = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(side)], "class long, label int, vector array<double>")
        sides.append(embedding_dedup._coded(classes, np.zeros(64), turn))
    names = embedding_dedup.LANE_NAMES
    pairs = sides[0].alias("one").join(sides[1].alias("two"), "class")
    fits = embedding_dedup._near_lanes([F.col(f"one.{n}") for n in names], [F.col(f"two.{n}") for n in names], 0.98)
    kept = {r["class"] for r in pairs.where(fits).collect()}
    cosine = (rows * others).sum(1) / np.linalg.norm(rows, axis=1) / np.linalg.norm(others, axis=1)
    near = set(np.flatnonzero(cosine >= 0.98).tolist())
    assert near and near <= kept and len(kept) < 400
