import numpy as np
import pandas as pd
import pytest
from conftest import as_dicts
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paneldrift.operators import ordering, profile


@pytest.fixture
def skewed():
    """Half of all rows in one group, a third of all rows with one value, a missing group and missing values."""
    rng = np.random.default_rng(3)
    n = 3000
    group = np.where(rng.random(n) < 0.5, "hot", rng.choice(["b", "c", "d"], n))
    value = np.where(rng.random(n) < 0.34, -100.0, rng.normal(size=n).round(2))
    df = pd.DataFrame({"id": range(n), "g": group, "x": value})
    df.loc[df.id % 50 == 0, "x"] = np.nan
    df.loc[df.id % 41 == 0, "g"] = None
    return df


def _spark(spark, pdf, schema):
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, schema)


def test_mid_ranks_match_brute_force(spread, skewed):
    df = _spark(spread, skewed, "id int, g string, x double")
    got = ordering.with_mid_rank(df, "x", ("g",)).toPandas().set_index("id").sort_index()
    want = skewed.groupby("g", dropna=False)["x"].rank(method="average")
    assert len(got) == len(skewed)
    np.testing.assert_allclose(got["rank"].to_numpy(dtype=float), want.to_numpy(dtype=float))


def test_global_rank_spans_partitions(spread, skewed):
    df = _spark(spread, skewed, "id int, g string, x double")
    placed = ordering.value_positions(df, "x").toPandas()
    want = skewed["x"].dropna()
    assert placed["n"].sum() == len(want) and set(placed["total_n"]) == {len(want)}
    below = [int((want < v).sum()) for v in placed["x"]]
    assert list(placed["below_n"]) == below


def test_rank_sum_identity(spread, skewed):
    df = _spark(spread, skewed, "id int, g string, x double")
    r = ordering.with_mid_rank(df, "x").agg(F.sum("rank").alias("s"), F.count("rank").alias("n")).first()
    assert r.s == r.n * (r.n + 1) / 2


@pytest.mark.parametrize("bucket,buckets,chunk", [(100, 1000, 32), (7, 1000, 4), (1, 40, 5)])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_buckets_give_the_same_positions(spread, skewed, monkeypatch, bucket, buckets, chunk, by):
    monkeypatch.setattr(ordering, "BUCKET", bucket)
    monkeypatch.setattr(ordering, "BUCKETS", buckets)
    monkeypatch.setattr(ordering, "CHUNK", chunk)
    df = _spark(spread, skewed, "id int, g string, x double")
    got = ordering.value_positions(df, "x", by, {"n": F.count("*"), "odd": F.count_if(F.col("id") % 2 == 1)}).toPandas()
    known = skewed.dropna(subset="x")
    assert len(got) == len(known.drop_duplicates([*by, "x"]))
    for g, part in known.groupby("g", dropna=False) if by else [(None, known)]:
        mine = (got[got["g"].isna()] if pd.isna(g) else got[got["g"] == g]) if by else got
        mine, x, odd = mine.set_index("x").sort_index(), part["x"], part["id"] % 2
        want = part.groupby("x")["id"].count()
        assert list(mine["n"]) == list(want) and set(mine["total_n"]) == {len(part)} and set(mine["total_odd"]) == {odd.sum()}
        assert list(mine["below_n"]) == [int((x < v).sum()) for v in mine.index]
        assert list(mine["below_odd"]) == [int(odd[x < v].sum()) for v in mine.index]


def test_rows_move_once_to_be_placed(spread, skewed, monkeypatch):
    """One exchange of rows, dealt by group and bucket; a value that holds a third of all rows does not move."""
    monkeypatch.setattr(ordering, "BUCKET", 50)
    df = _spark(spread, skewed, "id int, g string, x double")
    plan = ordering.value_positions(df, "x", ("g",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan and "REPARTITION_BY_COL" in plan
    known, several = ordering._with_bucket(df.where("x is not null"), "x", ("g",))
    assert several
    sizes = known.groupBy("g", "_bucket").agg(F.count("*").alias("n"), F.count_distinct("x").alias("values")).toPandas()
    assert (sizes.loc[sizes["_bucket"] % 2 == 1, "values"] == 1).all()
    assert sizes.loc[sizes["_bucket"] % 2 == 0, "n"].max() < 150 < sizes.loc[sizes["_bucket"] % 2 == 1, "n"].max()


def test_numbering_is_a_bijection(spread, skewed):
    df = _spark(spread, skewed, "id int, g string, x double")
    got = ordering.numbered(df, ["g"], F.md5(F.col("id").cast("string").cast("binary"))).toPandas()
    for _, part in got.groupby("g", dropna=False):
        assert sorted(part["number"]) == list(range(1, len(part) + 1))
        assert set(part["group_size"]) == {len(part)}


def test_quantiles_match_numpy(spread, skewed):
    df = _spark(spread, skewed, "id int, g string, x double")
    got = as_dicts(ordering.exact_quantiles(df, "x", {"a": 0.025, "b": 0.5, "c": 0.975}, ("g",)), "g")
    for g, part in skewed.groupby("g", dropna=False):
        want = np.quantile(part["x"].dropna(), [0.025, 0.5, 0.975])
        row = got[None if pd.isna(g) else g]
        np.testing.assert_allclose([row["a"], row["b"], row["c"]], want, atol=1e-12)


@pytest.mark.parametrize("bins,bucket", [(4, 10), (4096, 5)])
@pytest.mark.parametrize("odd", [[], [1e300, -1e300, 1.7e308, -1.7976931348623157e308], [float("inf"), float("-inf"), 1e-300, 2e-300]])
def test_quantiles_by_repeated_division(spread, skewed, monkeypatch, bins, bucket, odd):
    monkeypatch.setattr(ordering, "BINS", bins)
    monkeypatch.setattr(ordering, "BUCKET", bucket)
    rows = [(None if pd.isna(g) else g, float(x)) for g, x in zip(skewed["g"], skewed["x"]) if not pd.isna(x)][:200]
    rows += [("odd", x) for x in odd] + [("one", 5.0), ("none", None)]
    df = spread.createDataFrame(rows, "g string, x double")
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.75, "e": 1.0}
    kept = df.where("x is not null")
    got = ordering.quantiles_of(ordering.selected_positions(kept, "x", ("g",), probs), "x", ("g",), probs)
    want = ordering.quantiles_of(ordering.value_positions(kept, "x", ("g",)), "x", ("g",), probs)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))


def test_quantiles_move_few_rows(spread, skewed):
    """Rows are counted in bins where they lie; only those of the wanted bins are folded, and nothing is sorted as a whole."""
    df = _spark(spread, skewed, "id int, g string, x double").where("x is not null")
    found = ordering.selected_positions(df, "x", ("g",), {"m": 0.5})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and found.count() < 30


def test_quantile_golden(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 9, 11)], "x double")
    r = ordering.exact_quantiles(df, "x", {"lo": 0.025, "hi": 0.975}).first()
    assert (round(r.lo, 9), round(r.hi, 9)) == (1.1, 10.8)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-3, 3), min_size=1, max_size=40))
def test_mid_ranks_property(spread, values):
    df = spread.createDataFrame(list(enumerate(map(float, values))), "id int, x double")
    got = [r["rank"] for r in ordering.with_mid_rank(df, "x").orderBy("id").collect()]
    assert got == list(pd.Series(values).rank())


def test_top_keeps_ties_and_puts_missing_last(spark):
    df = spark.createDataFrame([(9.0,), (8.0,), (8.0,), (7.0,), (None,)], "x double")
    assert sorted(r.x for r in ordering.top_with_ties(df, "x", 2).collect()) == [8, 8, 9]
    assert ordering.top_with_ties(df, "x", 5).count() == 5
    assert ordering.top_with_ties(df, "x", 4).count() == 4


def test_sample_is_reproducible(spark):
    df = spark.range(100)
    one = {r.id for r in ordering.sample_rows(df, 10, ["id"], 1).collect()}
    assert one == {r.id for r in ordering.sample_rows(df.repartition(7), 10, ["id"], 1).collect()}
    assert len(one) == 10 and one != {r.id for r in ordering.sample_rows(df, 10, ["id"], 2).collect()}


def test_profile_and_box(spread, skewed):
    df = _spark(spread, skewed, "id int, g string, x double")
    r = profile.numeric_profile(df, "x").first()
    x = skewed["x"].dropna()
    assert r.n_missing == skewed["x"].isna().sum() and r.n == len(x)
    np.testing.assert_allclose([r["min"], r.q1, r["median"], r["mean"], r.q3, r["max"]],
                               [x.min(), x.quantile(.25), x.median(), x.mean(), x.quantile(.75), x.max()])
    stats, outliers = profile.box_stats(df, "x", ("g",))
    got = as_dicts(stats, "g")
    out = outliers.toPandas()
    for g, part in skewed.groupby("g", dropna=False):
        part = part["x"].dropna()
        q1, q3 = part.quantile(.25), part.quantile(.75)
        inside = part[(part >= q1 - 1.5 * (q3 - q1)) & (part <= q3 + 1.5 * (q3 - q1))]
        row = got[None if pd.isna(g) else g]
        np.testing.assert_allclose([row["whisker_low"], row["whisker_high"]], [inside.min(), inside.max()])
        assert row["n_outliers"] == len(part) - len(inside)
        mine = out[out["g"].isna()] if pd.isna(g) else out[out["g"] == g]
        assert mine["n"].sum() == row["n_outliers"]
    clipped = profile.box_stats(df, "x", ("g",), (-3.0, 3.0))[0]
    assert clipped.agg(F.sum("n")).first()[0] == ((x >= -3) & (x <= 3)).sum()


def test_table_profile(spread, skewed):
    df = _spark(spread, skewed, "id int, g string, x double")
    got = as_dicts(profile.table_profile(df), "column")
    assert set(got) == {"id", "x"}
    for name, row in got.items():
        known = skewed[name].dropna()
        assert (row["n"], row["n_missing"]) == (len(known), len(skewed) - len(known))
        np.testing.assert_allclose([row[c] for c in ("min", "q1", "median", "mean", "q3", "max")],
                                   [known.min(), *known.quantile([.25, .5]), known.mean(), known.quantile(.75), known.max()])


def test_profile_of_columns_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    got = as_dicts(profile.table_profile(df), "column")
    assert (got["b"]["n"], got["b"]["n_missing"], got["b"]["median"]) == (0, 2, None) and got["a"]["median"] == 1.5
    assert profile.table_profile(df.limit(0)).collect() == []


def test_contingency_and_shares(spark):
    rows = [(1, "exp"), (1, "exp"), (1, "declin"), (2, "disp"), (None, "exp"), (2, None)]
    df = spark.createDataFrame(rows, "g int, e string")
    got = as_dicts(profile.contingency(df, "g", "e", ["disp", "exp", "declin"]), "g")
    assert got[1] == {"g": 1, "disp": 0, "exp": 2, "declin": 1} and got[2]["disp"] == 1
    assert sum(v for r in got.values() for k, v in r.items() if k != "g") == 4
    shares = as_dicts(profile.contingency_shares(df, "g", "e"), "g", "e")
    assert shares[(1, "exp")]["row_share"] == pytest.approx(2 / 3)


def test_totals_with_missing_value_are_unknown(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", None)], "s string, value double")
    got = as_dicts(profile.group_totals(df, "s"), "s")
    assert got["a"]["total"] == 3 and got["b"]["total"] is None


def test_level_codes_and_levels(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "k string")
    assert profile.levels_of(df, "k") == ["a", "b", "c"]
    assert sorted((r.k, r.k_code) for r in profile.level_codes(df, "k").dropna().collect()) == [
        ("a", 1), ("a", 1), ("b", 2), ("c", 3)]
    assert {r.k: r.n for r in profile.frequency(df, "k").collect()} == {"a": 2, "b": 1, "c": 1, None: 1}
