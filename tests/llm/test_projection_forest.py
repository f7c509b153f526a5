"""The forest against comparing all vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from complaintflow.llm import projection_forest as op

ROWS = "vec_id long, embedding array<float>, label int, class_id int"


def exact(rows, is_query, k=10):
    """Per query row: (score, vec_id) of its k nearest, its own row left out."""
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    found = []
    for at, (i, v) in enumerate(good):
        if is_query(i):
            near = sorted((math.sqrt(((w - v) ** 2).sum()), j) for other, (j, w) in enumerate(good) if other != at and len(w) == len(v))
            found += [(i, rank, j, d) for rank, (d, j) in enumerate(near[:k], 1)]
    return sorted(found)


def got(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], ROWS).repartition(3)


def same(a, b):
    return [x[:3] for x in a] == [x[:3] for x in b] and all(x[3] == pytest.approx(y[3], rel=1e-12, abs=1e-12) for x, y in zip(a, b))


def test_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100, None), (101, []), (102, [0.0] * 6), (103, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (104, [float("nan")] * 6), (105, [float("inf")] + [0.0] * 5),
             (None, [1.0] * 6), (110, [1.0, 2.0]), (120, [2.0, 2.0]), (130, [5.0])]
    rows += [(200 + i, rows[7][1]) for i in range(30)] + [(7, rows[7][1]), (20, rows[21][1]), (-10, rows[3][1])]
    wanted = exact(rows, lambda i: i % 10 == 0)
    assert same(got(op.nearest_neighbours(frame(spark, rows), F.col("vec_id") % 10 == 0)), wanted)
    assert {x[0] for x in wanted} >= {110, 120, 20, -10} and 130 not in {x[0] for x in wanted}
    assert got(op.nearest_neighbours(frame(spark, rows).limit(0), F.lit(True))) == []


def test_copies_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(op, "PIECE_ROWS", 16)
    rng = random.Random(2)
    points = [[float(rng.randint(-3, 3)) for _ in range(3)] + [1.0] for _ in range(120)]
    rows = [(i, points[0] if i % 3 == 0 else rng.choice(points)) for i in range(900)]
    found = got(op.nearest_neighbours(frame(spark, rows), F.col("vec_id") % 20 == 0, leaf_rows=40, recall=1.0))
    assert same(found, exact(rows, lambda i: i % 20 == 0))


def test_few_rows_in_the_visited_leaves(spark, monkeypatch):
    monkeypatch.setattr(op, "_probe", lambda *a: 1)
    monkeypatch.setattr(op, "LEAF_SAMPLE", 1)
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(4).astype(np.float32).tolist()) for i in range(64)]
    found = got(op.nearest_neighbours(frame(spark, rows), F.col("vec_id") % 8 == 0, leaf_rows=4, trees=1))
    assert same(found, exact(rows, lambda i: i % 8 == 0))


def test_the_queue_takes_the_cheapest_subtree_of_all_trees():
    rng = np.random.default_rng(4)
    sample = rng.standard_normal((500, 8))
    forest = op.Forest(sample, 3, 4)
    placed = forest.leaves(sample)
    counts = [np.bincount(placed[:, t], minlength=16) for t in range(3)]
    assert all(c.sum() == 500 and c.min() >= 25 for c in counts)
    for v, visited in zip(sample[:20], forest.visits(sample[:20], 48)):
        costs = {}
        for t in range(3):
            for leaf in range(16):
                node, cost = leaf + 15, 0.0
                while node:
                    above = (node - 1) // 2
                    m = v @ forest.normals[t, above] - forest.medians[t, above]
                    cost += m * m if (m > 0) != (node == 2 * above + 2) else 0.0
                    node = above
                costs[t, leaf] = cost
        assert sorted(visited) == sorted(costs) and [costs[x] for x in visited] == pytest.approx(sorted(costs.values()))
    first = next(forest.visits(sample[:1], 3))
    assert set(first) == {(t, placed[0, t]) for t in range(3)}


def test_clustered_vectors_need_few_leaves(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    rows = [(i, (centres[i % 40] + 0.05 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(4000)]
    seen = []
    probe = op._probe
    op._probe = lambda *a: seen.append(probe(*a)) or seen[-1]
    try:
        found = got(op.nearest_neighbours(frame(spark, rows), F.col("vec_id") % 100 == 0, leaf_rows=64))
    finally:
        op._probe = probe
    wanted = exact(rows, lambda i: i % 100 == 0)
    assert len({x[:1] + x[2:3] for x in found} & {x[:1] + x[2:3] for x in wanted}) >= 0.9 * len(wanted) and len(found) == len(wanted)
    assert seen[0] <= 0.4 * 4 * 64


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, size):
    table = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
    wanted = exact([(r["vec_id"], r["embedding"]) for r in table.collect()], lambda i: i % 100 == 0)
    found = got(op.query(spark, f"/root/testdata/{size}"))
    hits = {(q, v): d for q, _, v, d in wanted}
    assert len(found) == len(wanted)
    assert sum((q, v) in hits for q, _, v, _ in found) >= 0.9 * len(wanted)
    assert all(d == pytest.approx(hits[q, v], rel=1e-12) for q, _, v, d in found if (q, v) in hits)
