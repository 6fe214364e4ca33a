"""Mixing: targets against a plain water-filling, the bounds of the sample, odd rows, and the query against SQL."""

import re
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from checks import compare
from paneldrift.llm import mixing, queries

SF = "/root/testdata/sf0.001"


def plain_targets(sizes):
    """Share, cut at three times the size, share the rest again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return {**fixed, **share}
        fixed |= {s: 3.0 * sizes[s] for s in above}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=7))
def test_targets(spark, sizes):
    sizes = {(None if k == 3 else f"s{k}"): n for k, n in enumerate(sizes)}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0))


def check(rows, texts):
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    taken, largest, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        taken[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 3
    assert sorted(r["size"] for r in rows) == sorted(size(t) for t in texts)
    for s in taken:
        assert abs(taken[s] - target[s]) <= 3 * largest[s]
    return taken


def test_sample(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = mixing.shares(docs, keep=("source",)).collect()
    check(one, [r["text"] for r in docs.collect()])
    again = mixing.shares(docs.repartition(7), keep=("source",)).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, again))
    other = mixing.shares(docs, seed=1, keep=("source",)).collect()
    assert sorted(map(repr, one)) != sorted(map(repr, other))


def test_odd_rows(spark):
    rows = [(1, None, "a"), (1, None, "a"), (2, "", None), (None, "w w w", None), (None, "w w w", None), (4, "w " * 100000, "b"), (5, "x", "b"), (6, None, "empty")]
    rows += [(100 + k, "same size here", "hot") for k in range(3000)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, source string, size long")
    got = mixing.shares(docs, keep=("source",)).collect()
    taken = check(got, [r[1] for r in rows])
    assert taken["empty"] == 0 and len(got) == len(rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.shares(docs.where("false")).count() == 0 and mixing.mix(docs.where("false")).count() == 0


def test_query_equals_sql_and_runs_no_python(spark):
    result, _ = compare.compare(spark, compare.open_tables(SF), SF, queries.op5_mix_sources, queries.SQL["op5_mix_sources"])
    assert result.startswith("ok"), result
    plan = queries.op5_mix_sources(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
