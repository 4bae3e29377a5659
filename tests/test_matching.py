"""Descriptor matches by blocked products against a plain loop."""

import numpy as np
import pytest

from waymark.operators.matching import nearest_two, ratio_match


def plain(pairs, rows, ratio):
    out = []
    for a, b in pairs:
        for image, d, va in rows:
            if image != a or va is None or not all(x is not None and np.isfinite(x) for x in va):
                continue
            other = [(float(np.sqrt(sum((x - y) ** 2 for x, y in zip(va, vb, strict=True)))), e) for i, e, vb in rows
                     if i == b and vb is not None and len(vb) == len(va) and all(x is not None and np.isfinite(x) for x in vb)]
            two = sorted(other)[:2]
            if len(two) == 2 and two[0][0] < ratio * two[1][0]:
                out.append((a, b, d, two[0][1], round(two[0][0], 9), round(two[1][0], 9)))
    return sorted(out)


def got(spark, pairs, rows, ratio, tile):
    p, d = spark.createDataFrame(pairs, "image_a int, image_b int"), spark.createDataFrame(rows, "image int, desc_id bigint, vec array<float>")
    return sorted((r[0], r[1], r[2], r[3], round(r[4], 9), round(r[5], 9)) for r in ratio_match(p, d, ratio, tile).collect())


@pytest.mark.parametrize("tile", [3, 7, 1024])
def test_tiles(spark, tile):
    rng = np.random.default_rng(4)
    rows = [(k % 3, k, [float(np.float32(x)) for x in rng.normal(size=6) * (1000 if k % 5 else 1)]) for k in range(60)]
    rows += [(0, 100 + k, rows[3 * k + 1][2]) for k in range(5)] + [(1, 200 + k, rows[3 * k + 1][2]) for k in range(5)]  # equal vectors: ties go to the smaller id
    rows += [(0, 300, None), (1, 301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1, 302, [float("nan")] * 6), (0, 303, [1.0, 2.0]), (1, 304, [1.0, 2.5]), (1, 305, [9.0, 9.0]), (4, 306, [0.0] * 6)]
    pairs = [(0, 1), (1, 2), (0, 4), (4, 0), (0, 9)]
    assert got(spark, pairs, rows, 0.9, tile) == plain(pairs, rows, 0.9) != []


def test_no_rows(spark):
    assert got(spark, [(0, 1)], [], 0.9, 4) == [] and got(spark, [], [(0, 1, [1.0])], 0.9, 4) == []


def test_close_distances():
    """Two candidates that the product cannot tell apart are told apart by measuring them."""
    a = np.full((1, 4), 1e8)
    b = a + np.array([[3e-4, 0, 0, 0], [2e-4, 0, 0, 0], [1e-4, 0, 0, 0], [5.0, 0, 0, 0]])
    index, dist = nearest_two(a, b)
    assert index.tolist() == [[2, 1]] and dist[0, 0] < dist[0, 1]


def test_plan_has_no_row_for_each_pair(spark):
    rows = [(k % 2, k, [float(k), 1.0]) for k in range(400)]
    d = spark.createDataFrame(rows, "image int, desc_id bigint, vec array<float>")
    out = ratio_match(spark.createDataFrame([(0, 1)], "image_a int, image_b int"), d, 0.8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "Window" not in plan and "MapInArrow" in plan
