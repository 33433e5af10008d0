"""Comparing datasets within a tolerance."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandlake.functions.geometry import GEOMETRY_TYPE
from bandlake.operators import annotations as A


def dataset(spark, shapes):
    images = spark.createDataFrame([("d", 1, "a.png", 9, 9, 0), ("d", 2, "b.png", 9, 9, 1)], "dataset_id string, image_id long, file_name string, width long, height long, ord long")
    categories = spark.createDataFrame([("d", 1, "x", 0), ("d", 2, "y", 1)], "dataset_id string, category_id long, name string, ord long")
    rows = [("d", k, image, category, geometry, k) for k, (image, category, geometry) in enumerate(shapes)]
    return A.Dataset(images, categories, spark.createDataFrame(rows, f"dataset_id string, annotation_id long, image_id long, category_id long, geometry {GEOMETRY_TYPE}, ord long"))


def point(x, y):
    return ("point", float(np.float32(x)), float(np.float32(y)), None, None, None)


@pytest.mark.parametrize(("jitter", "lost"), [(9e-4, 0), (1.1e-3, 40)])
def test_jittered_copies(spark, jitter, lost):
    rng = random.Random(1)
    places = [(rng.randrange(1, 3), rng.randrange(1, 3), rng.uniform(0, 5), rng.uniform(0, 5)) for _ in range(20)]
    a = [(i, c, point(x, y)) for i, c, x, y in places]
    b = [(i, c, point(x + rng.choice((-jitter, jitter)), y)) for i, c, x, y in places]
    b += [(1, 1, ("bounding_box", 1.0, 2.0, 3.0, 4.0, None))]
    a += [(1, 1, ("bounding_box", 1.0, 2.0, 3.0, 4.0 + jitter / 2, None))]
    rng.shuffle(b)
    assert A.roundtrip_diff(dataset(spark, a), dataset(spark, b)).count() == lost


def test_values_next_to_a_rounding_step_and_copies(spark):
    a = [(1, 1, point(0.0004999, 1)), (1, 1, point(2, 2)), (1, 1, point(2, 2)), (2, 1, point(0, 0))]
    b = [(1, 1, point(0.0005001, 1)), (1, 1, point(2, 2)), (1, 2, point(0, 0))]
    rows = A.roundtrip_diff(dataset(spark, a), dataset(spark, b)).collect()
    assert sorted((r.file_name, r.category, r.shape, r.side) for r in rows) == [("a.png", "x", "point 2.000 2.000", "left"), ("a.png", "y", "point 0.000 0.000", "right"), ("b.png", "x", "point 0.000 0.000", "left")]


def test_as_many_partners_as_possible(spark):
    rng = random.Random(8)
    for _ in range(300):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        near = np.array([[rng.random() < 0.5 for _ in range(m)] for _ in range(n)])
        left, right = np.array([rng.randrange(0, 3) for _ in range(n)]), np.array([rng.randrange(0, 3) for _ in range(m)])
        units = [i for i, k in enumerate(left) for _ in range(k)], [j for j, k in enumerate(right) for _ in range(k)]
        small, large = (units[0], units[1]) if len(units[0]) <= len(units[1]) else (units[1], units[0])
        ok = (lambda i, j: near[i, j]) if small is units[0] else (lambda i, j: near[j, i])
        best = max((sum(ok(i, j) for i, j in zip(small, chosen, strict=False)) for chosen in itertools.permutations(large, len(small))), default=0) if len(large) <= 6 else None
        l, r = A._unmatched(left, right, near)
        assert left.sum() - l.sum() == right.sum() - r.sum()
        if best is not None:
            assert left.sum() - l.sum() == best
    # a chain in which each nearest pair would leave two without partner
    chain = A.roundtrip_diff(dataset(spark, [(1, 1, point(0, 0)), (1, 1, point(0.0009, 0))]), dataset(spark, [(1, 1, point(0.0008, 0)), (1, 1, point(0.0018, 0))]))
    assert chain.count() == 0


def test_clusters_part_at_gaps_of_any_number():
    rows = np.array([[0, 0], [0, 5], [0.5, 0.4], [9, 0], [0.9, 5.5], [1.4, 0.2]])
    assert sorted(sorted(c.tolist()) for c in A._clusters(rows, 0.6)) == [[0, 2], [1], [3], [4], [5]]
