"""Exact top-k against all pairs, on clustered vectors with ties, copies, odd rows and several lengths."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import compare
from paneldrift.llm import knn, queries

SF = "/root/testdata/sf0.001"


def brute(rows, every, k, scale=256):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.setdefault(i, set()).add(tuple(math.floor(scale * x) for x in v))
    out = []
    for q, vectors in whole.items():
        if q % every:
            continue
        best = {}
        for v in vectors:
            for i, ws in whole.items():
                for w in ws:
                    if i != q and len(w) == len(v) and w:
                        best[i] = max(best.get(i, -math.inf), sum(a * b for a, b in zip(v, w)))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted((-s, i) for i, s in best.items())[:k])]
    return sorted(out)


def found(df, every, **options):
    return sorted(tuple(r) for r in knn.top_k(df, F.col("vec_id") % every == 0, **options).collect())


@pytest.mark.parametrize("pivots,block", [(256, 256), (4, 7)])
def test_against_all_pairs(spread, pivots, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 6))
    rows = [(i, (centres[i % 4] + 0.1 * rng.normal(size=6)).round(2).tolist()) for i in range(150)]
    rows += [(200 + i, rows[5][1]) for i in range(40)]  # copies, queries among them
    rows += [(300 + i, [0.0] * 6) for i in range(12)]
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [1.0] * 6), (405, [])]
    rows += [(410 + i, [float(i), -1.0]) for i in range(3)] + [(5, rows[5][1])]
    random.Random(1).shuffle(rows)
    df = spread.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<float>, key string, score int").repartition(3)
    single = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert found(df, 5, k=3, pivots=pivots, least_block=block) == brute(single, 5, 3)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (50, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert found(df, 50, k=5) == [(0, 1, 50, 3 * 65536), (50, 1, 0, 3 * 65536)]
    assert found(df.where("false"), 50) == [] and found(df.where("vec_id = 0"), 50) == []


def test_large_components_are_exact():
    q, x = np.array([[2**40 + 1, 3]]), np.array([[2**20, 7], [2**20, 8]])
    assert knn._scores(q, x).tolist() == [[(2**40 + 1) * 2**20 + 21, (2**40 + 1) * 2**20 + 24]]


def test_query_equals_sql(spark):
    result, _ = compare.compare(spark, compare.open_tables(SF), SF, queries.op6_voronoi_knn, queries.SQL["op6_voronoi_knn"])
    assert result.startswith("ok"), result


def test_ids_with_several_vectors(spread):
    """The query's own id never fills a place, and an id is listed once with its best vector."""
    rows = [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (0, [3.0, 0.0])] + [(i, [float(i), 1.0]) for i in range(1, 9)] + [(8, [-3.0, 0.0]), (8, [7.5, 2.0])]
    df = spread.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(df, 1000, k=5)
    assert got == brute(rows, 1000, 5) and [r[1] for r in got] == [1, 2, 3, 4, 5]
    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(0, 30)), rng.normal(size=4).round(2).tolist()) for _ in range(300)]
    df = spread.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, 5, pivots=9, least_block=7) == brute(rows, 5, 5)


def test_clustered_vectors_are_sent_to_few_rings(spread):
    """Queries on clustered vectors visit less than three tenths of the rings; all pairs would be all of them."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(24, 8)) * 3
    rows = [(i, (centres[i % 24] + 0.1 * rng.normal(size=8)).tolist()) for i in range(2400)]
    df = spread.createDataFrame(rows, "vec_id long, embedding array<double>")
    visits = spread.sparkContext.accumulator(0)
    assert found(df, 100, k=5, pivots=64, visits=visits) == brute(rows, 100, 5)
    assert 24 <= visits.value < 0.3 * 24 * 64  # the rings are one per cell here
