"""Whitened embeddings against plain numpy over all rows, with copies, odd rows and odd tables."""

import math
from decimal import Decimal

import numpy as np
import pytest

from paneldrift.llm import queries, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, size, components=8, distinct=False):
    """vec_id -> (n, deviation, whitened without sign, explained), all rows in one matrix."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in rows
            if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    fit = list({tuple(x): x for _, x in kept}.values()) if distinct else [x for _, x in kept]
    n = len(fit)
    sums = [sum(x[j] for x in fit) for j in range(size)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, x in kept:
        whole = [n * c - s for c, s in zip(x, sums)]
        y = np.array([w / n for w in whole]) @ vectors / np.sqrt(values)
        out.setdefault(i, []).append((n, sum(w * w for w in whole), y, values / np.trace(centred.T @ centred / n)))
    return out


def check(found, wanted):
    signs = {}
    rows = {}
    for r in found:
        rows.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    assert set(rows) == set(wanted)
    for i, told in wanted.items():
        for k in range(len(told[0][2])):
            got = sorted(rows[i][k + 1], key=lambda r: r["deviation"])
            assert len(got) == len(told)
            for r, (n, far, y, explained) in zip(got, sorted(told, key=lambda t: t[1])):
                assert (r["n"], r["deviation"]) == (n, far)
                assert abs(r["explained"] - explained[k]) <= 1e-9 * explained[k]
                if abs(y[k]) > 1e-6:
                    assert signs.setdefault(k, np.sign(y[k] * r["whitened"])) == np.sign(y[k] * r["whitened"])
                assert abs(abs(r["whitened"]) - abs(y[k])) < 1e-7
                assert r["identity_error"] < 1e-9


def vectors(seed, n, size):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, size)) @ np.diag(np.linspace(3, 0.2, size))).astype(np.float32)


@pytest.mark.parametrize("weigh", ["count", "one"])
def test_against_numpy(spread, weigh):
    base = vectors(1, 300, 11)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, base[7].tolist()) for i in range(500)] + [(7, base[7].tolist()), (None, base[3].tolist())]
    rows += [(2000, None), (2001, []), (2002, [None] * 11), (2003, [float("nan")] + [0.0] * 10), (2004, [float("inf")] * 11), (2005, [1.0, 2.0])]
    df = spread.createDataFrame(rows, SCHEMA)
    check(whitening.whiten(df, weigh=weigh).collect(), plain(rows, 11, distinct=weigh == "one"))


def test_fewer_dimensions_than_components_and_a_named_length(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(2, 50, 3))] + [(100 + i, [1.0, 2.0]) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    check(whitening.whiten(df, dimension=3).collect(), plain(rows, 3))


def test_components_without_spread_are_left_out(spark):
    rows = [(i, [float(i), 5.0]) for i in range(10)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component"] for r in found} == {1} and len(found) == 10
    assert all(abs(r["explained"] - 1) < 1e-12 for r in found)


def test_deviation_is_exact_where_doubles_are_not(spark):
    rows = [(i, [1e6 * (i % 7) + 0.25, -3e6 * i]) for i in range(2000)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    for r in found:
        assert r["deviation"] == Decimal(sum((2000 * c - s) ** 2 for c, s in zip(x[r["vec_id"]], sums)))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_tables_without_anything_to_whiten(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_extra_columns(spark):
    rows = [(i, v.tolist(), "a", 1, 2) for i, v in enumerate(vectors(4, 40, 3))]
    df = spark.createDataFrame(rows, SCHEMA + ", x string, copies int, weight int")
    check(whitening.whiten(df).collect(), plain([r[:2] for r in rows], 3))


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(queries.op11_whitening(spark, SF).collect(), plain(rows, 64))
