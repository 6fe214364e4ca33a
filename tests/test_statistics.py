import hashlib
import math
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from conftest import as_dicts
from pyspark.sql import functions as F

from paneldrift.functions import distributions as dist
from paneldrift.functions import labels
from paneldrift.operators import bootstrap, linear, ordering, rank_tests

GRADES = (1, 2, 3)


@pytest.fixture(scope="module")
def data():
    """A third of all rows share one value, one grade holds most rows, one group most of the rest."""
    rng = np.random.default_rng(11)
    n = 1200
    grade = rng.choice(GRADES, n, p=[0.7, 0.2, 0.1])
    y = np.where(rng.random(n) < 0.34, -100.0, (rng.normal(size=n) * 40 - 4 * grade).round(1))
    return pd.DataFrame({"id": range(n), "g": np.where(rng.random(n) < 0.8, "hot", "b"), "grade": grade, "y": y})


@pytest.fixture
def df(spread, data):
    rows = [tuple(v.item() if hasattr(v, "item") else v for v in r) for r in data.itertuples(index=False)]
    return spread.createDataFrame(rows, "id int, g string, grade int, y double")


def test_spearman_matches_brute_force(df, data):
    got = as_dicts(rank_tests.spearman(df, "y", "grade", GRADES, ["g"]), "g")
    for g, part in data.groupby("g"):
        want = np.corrcoef(part["y"].rank(), part["grade"].rank())[0, 1]
        assert got[g]["rho"] == pytest.approx(want, abs=1e-12) and got[g]["n"] == len(part)
        for k in GRADES:
            assert got[g][f"mean_{k}"] == pytest.approx(part.loc[part["grade"] == k, "y"].mean())


def test_spearman_is_rank_invariant(df):
    one = rank_tests.spearman(df, "y", "grade", GRADES).first().rho
    moved = df.withColumn("y", F.exp(F.col("y") / 50))
    assert rank_tests.spearman(moved, "y", "grade", GRADES).first().rho == pytest.approx(one, abs=1e-12)


def test_spearman_with_ties_and_constants(spark):
    rows = [("t", 1.0, 10), ("t", 2.0, 20), ("t", 2.0, 20), ("t", 3.0, 30), ("c", 1.0, 10), ("c", 2.0, 10),
            ("x", 5.0, 10), ("x", 5.0, 20), ("x", 5.0, 30)]
    df = spark.createDataFrame(rows, "g string, x double, y int")
    got = as_dicts(rank_tests.association(df, "x", "y", (10, 20, 30), ["g"]), "g")
    assert got["t"]["rho"] == 1 and got["t"]["p_value"] == 0 and got["t"]["relation"] == labels.RELATION_BAD
    for g in ("c", "x"):
        assert got[g]["rho"] is None and got[g]["p_value"] is None
        assert got[g]["relation"] == labels.RELATION_WEAK and got[g]["interpretation"] == labels.TEXT_UNDEFINED


def _kruskal(samples):
    x = pd.Series(np.concatenate(samples)).rank().to_numpy()
    n, at, s = len(x), 0, 0.0
    for part in samples:
        s += x[at:at + len(part)].sum() ** 2 / len(part)
        at += len(part)
    ties = pd.Series(np.concatenate(samples)).value_counts()
    c = 1 - (ties**3 - ties).sum() / (n**3 - n)
    return (12 / (n * (n + 1)) * s - 3 * (n + 1)) / c


def test_kruskal_and_dunn(df, data):
    samples = [data.loc[data.grade == k, "y"].to_numpy() for k in GRADES]
    r = rank_tests.kruskal(df, "y", "grade", GRADES).first()
    want = _kruskal(samples)
    assert r.h == pytest.approx(want) and r.df == 2 and r.p_value == pytest.approx(math.exp(-want / 2))
    ranks = data["y"].rank()
    t = data["y"].value_counts().astype(float)
    n = len(data)
    base = n * (n + 1) / 12 - (t**3 - t).sum() / (12 * (n - 1))
    got = as_dicts(rank_tests.dunn(df, "y", "grade", GRADES), "level_a", "level_b")
    for a, b in combinations(GRADES, 2):
        ra, rb = ranks[data.grade == a], ranks[data.grade == b]
        z = (ra.mean() - rb.mean()) / math.sqrt(base * (1 / len(ra) + 1 / len(rb)))
        assert got[(a, b)]["z"] == pytest.approx(z)
        assert got[(a, b)]["p_value"] == pytest.approx(2 * NormalDist().cdf(-abs(z)))


def test_wilcoxon(df, data):
    got = as_dicts(rank_tests.wilcoxon(df, "y", "grade", GRADES), "level_a", "level_b")
    for a, b in combinations(GRADES, 2):
        x, y = data.loc[data.grade == a, "y"].to_numpy(), data.loc[data.grade == b, "y"].to_numpy()
        w = (x[:, None] > y).sum() + 0.5 * (x[:, None] == y).sum()
        assert got[(a, b)]["w"] == w and got[(a, b)]["n_a"] == len(x)


def test_kruskal_with_two_levels_is_squared_uncorrected_rank_sum_z(df):
    h = rank_tests.kruskal(df, "y", "grade", (1, 3)).first().h
    r = rank_tests.wilcoxon(df, "y", "grade", (1, 3)).first()
    shift = r.w - r.n_a * r.n_b / 2
    uncorrected = r.z * shift / (shift - math.copysign(0.5, shift))
    assert h == pytest.approx(uncorrected**2)


def test_levels_without_rows(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, 2), (4.0, 2)], "y double, g int")
    assert rank_tests.kruskal(df, "y", "g", GRADES).first().df == 1
    got = as_dicts(rank_tests.wilcoxon(df, "y", "g", GRADES), "level_a", "level_b")
    assert got[(1, 2)]["w"] == 0 and got[(1, 3)]["w"] is None and got[(1, 3)]["p_value"] is None


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "t string, p_value double")
    got = as_dicts(rank_tests.benjamini_hochberg(df), "t")
    assert [round(got[k]["p_adjusted"], 12) for k in "abc"] == [0.03, 0.04, 0.04] and got["d"]["p_adjusted"] is None


def _least_squares(data):
    x = np.column_stack([np.ones(len(data)), data.grade == 2, data.grade == 3]).astype(float)
    y = data["y"].to_numpy()
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    resid = y - x @ beta
    s2 = resid @ resid / (len(y) - 3)
    return beta, np.sqrt(s2 * np.diag(np.linalg.inv(x.T @ x))), s2, 1 - resid @ resid / ((y - y.mean()) ** 2).sum()


def test_factor_model(df, data):
    beta, se, s2, r2 = _least_squares(data)
    got = as_dicts(linear.ols_factor(df, "y", "grade"), "term")
    for i, term in enumerate(("(Intercept)", "2", "3")):
        assert got[term]["estimate"] == pytest.approx(beta[i])
        assert got[term]["std_error"] == pytest.approx(se[i])
        assert got[term]["r_squared"] == pytest.approx(r2) and got[term]["sigma"] == pytest.approx(s2**0.5)
    a = linear.anova(df, "y", "grade").first()
    assert (a.df_between, a.df_within) == (2, len(data) - 3) and a.ms_within == pytest.approx(s2)
    f = a.f_value
    assert a.p_value == pytest.approx((a.df_within / (a.df_within + 2 * f)) ** (a.df_within / 2))


def test_factor_model_matches_mllib(df):
    from pyspark.ml.feature import RFormula
    from pyspark.ml.regression import LinearRegression

    made = RFormula(formula="y ~ k", stringIndexerOrderType="alphabetDesc").fit(
        df.withColumn("k", F.col("grade").cast("string"))
    )
    fitted = LinearRegression(solver="normal").fit(made.transform(df.withColumn("k", F.col("grade").cast("string"))))
    got = as_dicts(linear.ols_factor(df, "y", "grade"), "term")
    assert fitted.intercept == pytest.approx(got["(Intercept)"]["estimate"])
    assert sorted(fitted.coefficients) == pytest.approx(sorted(got[t]["estimate"] for t in ("2", "3")))
    assert fitted.summary.r2 == pytest.approx(got["2"]["r_squared"])


def test_offset_model_matches_generalized_linear_model(spark):
    from pyspark.ml.feature import RFormula
    from pyspark.ml.regression import GeneralizedLinearRegression

    rng = np.random.default_rng(5)
    rows = [(int(g), float(a), float(b)) for g, a, b in zip(rng.choice(GRADES, 200), rng.random(200) + .1, rng.random(200) + .1)]
    df = spark.createDataFrame([*rows, (1, 0.0, 2.0), (2, 1.0, 0.0)], "grade int, ini double, fin double")
    got = as_dicts(linear.ols_factor_offset(df, "fin", "ini", "grade"), "term")
    kept = linear.positive(df, "ini", "fin").withColumns(
        {"k": F.col("grade").cast("string"), "lf": F.ln("fin"), "li": F.ln("ini")}
    )
    made = RFormula(formula="lf ~ k", stringIndexerOrderType="alphabetDesc").fit(kept).transform(kept)
    fitted = GeneralizedLinearRegression(family="gaussian", link="identity", offsetCol="li").fit(made)
    assert fitted.intercept == pytest.approx(got["(Intercept)"]["estimate"])
    assert sorted(fitted.coefficients) == pytest.approx(sorted(got[t]["estimate"] for t in ("2", "3")))


def test_log_model_counts_dropped_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 4.0), (2, 9.0), (2, -1.0), (1, 0.0)], "g int, y double")
    got = as_dicts(linear.ols_factor_log(df, "y", "g"), "term")
    assert got["(Intercept)"]["n_dropped"] == 2
    assert got["(Intercept)"]["estimate"] == pytest.approx(np.log([1, 2]).mean())


def test_line(spark):
    x = np.array([1.0, 2, 3, 4, 7])
    y = np.array([2.0, 1, 4, 3, 9])
    rows = [*zip(range(5), x.tolist(), y.tolist()), (5, None, 1.0)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    r = linear.ols_line(df, "y", "x").first()
    b, a = np.polyfit(x, y, 1)
    assert (r.slope, r.intercept, r.n) == (pytest.approx(b), pytest.approx(a), 5)
    assert r.r_squared == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2)
    flat = linear.ols_line(spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, y double"), "y", "x")
    assert flat.first().slope == 0 and flat.first().r_squared is None
    d = as_dicts(linear.line_diagnostics(df, "y", "x", ["id"]), "id")
    design = np.column_stack([np.ones(5), x])
    hat = np.diag(design @ np.linalg.inv(design.T @ design) @ design.T)
    assert [d[i]["leverage"] for i in range(5)] == pytest.approx(hat.tolist())
    assert [d[i]["resid"] for i in range(5)] == pytest.approx((y - a - b * x).tolist())
    assert sum(v["leverage"] for v in d.values()) == pytest.approx(2)


def test_factor_diagnostics(df, data):
    got = linear.factor_diagnostics(df, "y", "grade", ["id"]).toPandas().sort_values("id")
    means = data.groupby("grade")["y"].transform("mean")
    np.testing.assert_allclose(got["resid"], data["y"] - means, atol=1e-9)
    assert got["leverage"].sum() == pytest.approx(3)
    n = len(data)
    rank = got["std_resid"].round(9).rank()
    want = [NormalDist().inv_cdf(p) for p in (rank - 0.5) / n]
    np.testing.assert_allclose(got["theoretical"], want, atol=1e-8)


def test_tukey_against_published_points(spark):
    # Upper 5% points of the studentized range, as printed in statistical tables.
    for k, df, q in ((3, 10, 3.877), (3, 20, 3.578), (4, 30, 3.845), (2, 60, 2.829), (5, 120, 3.917)):
        assert dist.range_upper(q, k, df) == pytest.approx(0.05, abs=2e-4)
        assert dist.range_point(0.95, k, df) == pytest.approx(q, abs=2e-3)
    rows = [(g, float(v)) for g, vs in {1: (1, 2, 3), 2: (2, 3, 4), 3: (9, 10, 11)}.items() for v in vs]
    got = as_dicts(linear.tukey(spark.createDataFrame(rows, "g int, y double"), "y", "g", GRADES), "level_a", "level_b")
    assert got[(1, 3)]["diff"] == 8 and got[(1, 3)]["df"] == 6
    assert got[(1, 2)]["q"] == pytest.approx(1 / math.sqrt(1 / 3)) and got[(1, 2)]["p_adjusted"] > 0.4
    half = dist.range_point(0.95, 3, 6) * math.sqrt(1 / 3)
    assert got[(1, 3)]["ci_lower"] == pytest.approx(8 - half) and got[(1, 3)]["p_adjusted"] < 0.001


def test_two_level_tukey_is_the_t_test(spark):
    t, df = 2.3, 17.0
    assert dist.range_upper(t * math.sqrt(2), 2, df) == pytest.approx(dist.two_sided_t(np.array([t]), np.array([df]))[0], abs=1e-8)


def test_distribution_points(spark):
    # Points printed in statistical tables.
    df = spark.createDataFrame([(2.228, 10.0, 4.103, 5.991, 1.959964)], "t double, n double, f double, c double, z double")
    r = df.select(
        dist.student_p("t", "n").alias("t"), dist.fisher_p("f", F.lit(2.0), "n").alias("f"),
        dist.chi2_p("c", F.lit(2.0)).alias("c"), dist.normal_p("z").alias("z"),
    ).first()
    assert [r.t, r.f, r.c, r.z] == pytest.approx([0.05, 0.05, 0.05, 0.05], abs=5e-5)
    x = np.array([1e-9, 0.3, 1.0, 3.0, 9.0, 100.0, 700.0])
    np.testing.assert_allclose(dist.gamma_upper(1.0, x), np.exp(-x), rtol=1e-12)
    np.testing.assert_allclose(dist.gamma_upper(0.5, x), [math.erfc(math.sqrt(v)) for v in x], rtol=1e-12)
    np.testing.assert_allclose(dist.gamma_upper(2.0, x), (1 + x) * np.exp(-x), rtol=1e-12)
    assert dist.gamma_upper(1.0, np.array([0.0, np.inf])).tolist() == [1.0, 0.0]


@pytest.mark.parametrize("df", [1.0, 3.0, 40.0, 1e4, 1e9, 1e12])
def test_tails_keep_their_digits_at_any_number_of_degrees_of_freedom(df):
    f = np.array([1e-6, 0.3, 1.0, 3.0, 20.0])
    np.testing.assert_allclose(dist.upper_f(f, np.full(5, 2.0), np.full(5, df)), np.exp(-df / 2 * np.log1p(2 * f / df)), rtol=1e-9)
    if df == 1.0:
        t = np.array([1e-9, 0.5, 1.0, 3.0, 1e6])
        np.testing.assert_allclose(dist.two_sided_t(t, np.full(5, df)), 2 / np.pi * np.arctan(1 / t), rtol=1e-12)
    if df == 1e12:
        t = np.array([0.5, 2.0, 5.0, 10.0])
        np.testing.assert_allclose(dist.two_sided_t(t, np.full(4, df)), [math.erfc(v / math.sqrt(2)) for v in t], rtol=1e-8)
        assert dist.range_upper(3.31, 3, df) == pytest.approx(0.0504033721, abs=1e-9)
    assert dist.range_upper(dist.range_point(0.95, 3, df), 3, df) == pytest.approx(0.05, abs=1e-12)


def test_many_p_values_equal_those_of_single_rows():
    rng = np.random.default_rng(5)
    t, n = rng.normal(size=10_000) * 4, rng.integers(1, 10**6, 10_000).astype(float)
    t[::97] = np.nan
    t[5] = np.inf
    many = dist._known(dist.two_sided_t, t, n)
    assert many.isna().sum() == np.isnan(t).sum() and many[5] == 0.0
    for i in np.flatnonzero(~np.isnan(t))[1::501]:
        assert many[i] == pytest.approx(dist.two_sided_t(t[i : i + 1], n[i : i + 1])[0], rel=1e-12)
    assert dist._once(dist.range_upper, [3.0, np.nan, 3.0], [3.0] * 3, [9.0] * 3).tolist()[::2] == [dist.range_upper(3.0, 3.0, 9.0)] * 2


def test_normal_quantile(spark):
    ps = [1e-12, 0.001, 0.02, 0.3, 0.5, 0.7, 0.99, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0]], "p double")
    got = [r.q for r in df.select(dist.normal_quantile("p").alias("q")).collect()]
    assert got[:-2] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-9, abs=1e-12) and got[-2:] == [None, None]


def test_jarque_bera(df, data):
    y = data["y"].to_numpy()
    d = y - y.mean()
    s, k = (d**3).mean() / (d**2).mean() ** 1.5, (d**4).mean() / (d**2).mean() ** 2 - 3
    r = linear.jarque_bera(df, "y").first()
    assert r.jb == pytest.approx(len(y) / 6 * (s * s + k * k / 4))


def _boot(data, n_iter, seed, least, steps):
    """The same draws, one resample at a time."""
    rows = []
    for species, part in data.groupby("g"):
        sides = {s: part[part.side == s].sort_values(["y", "grade"]).reset_index(drop=True) for s in (labels.MONO, labels.PLURI)}
        if min(map(len, sides.values())) < least:
            continue
        for it in range(1, n_iter + 1):
            rho = []
            for side, p in sides.items():
                key, picks, start = f"{seed}|{species}|{side}", [], 0
                block = (np.searchsorted(p["y"], p["y"], "left") // steps).astype(int)
                sizes = [int((block == b).sum()) for b in np.unique(block)]
                dealt = bootstrap.dealt(key, sizes, range(it, it + 1))[0]
                assert dealt.sum() == len(p)
                for b, size, draws in zip(np.unique(block), sizes, dealt):
                    state = int(hashlib.md5(f"{key}|{it}|{b}".encode()).hexdigest()[:16], 16)
                    for _ in range(draws):  # splitmix64, one number after another
                        state = (state + 0x9E3779B97F4A7C15) % 2**64
                        x = (state ^ (state >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
                        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
                        picks.append(start + (x ^ (x >> 31)) % size)
                    start += size
                got = p.iloc[picks]
                constant = got["y"].nunique() < 2 or got["grade"].nunique() < 2
                rho.append(np.nan if constant else np.corrcoef(got["y"].rank(), got["grade"].rank())[0, 1])
            rows.append((species, it, rho[0] - rho[1]))
    return pd.DataFrame(rows, columns=["g", "iteration", "diff"])


@pytest.mark.parametrize("steps,piece", [(1 << 16, 1 << 21), (16, 50), (1, 7)])
def test_bootstrap_matches_brute_force(spread, monkeypatch, steps, piece):
    monkeypatch.setattr(bootstrap, "STEPS", steps)
    monkeypatch.setattr(bootstrap, "PIECE", piece)
    monkeypatch.setattr(bootstrap, "ITERATIONS", 4)
    rng = np.random.default_rng(2)
    data = pd.DataFrame(
        {
            "id": range(120),
            "g": np.where(rng.random(120) < 0.6, "hot", np.where(rng.random(120) < 0.9, "b", "rare")),
            "side": np.where(rng.random(120) < 0.3, labels.MONO, labels.PLURI),
            "y": np.where(rng.random(120) < 0.4, -100.0, rng.normal(size=120).round(1)),
            "grade": rng.choice(GRADES, 120, p=[0.8, 0.1, 0.1]),
        }
    )
    rows = [tuple(v.item() if hasattr(v, "item") else v for v in r) for r in data.itertuples(index=False)]
    df = spread.createDataFrame(rows, "id int, g string, side string, y double, grade int")
    got = bootstrap.bootstrap_diff(df, "g", "side", "y", "grade", GRADES, n_iter=6, least=10, seed=3)
    mine = got.toPandas().sort_values(["g", "iteration"]).reset_index(drop=True)
    want = _boot(data, 6, 3, 10, steps)
    assert "rare" not in set(mine["g"]) and len(mine) == len(want) == 12
    np.testing.assert_allclose(mine["diff"].to_numpy(dtype=float), want["diff"].to_numpy(dtype=float), atol=1e-12)
    ci = as_dicts(bootstrap.bootstrap_summary(got, "g"), "g")
    for g, part in want.groupby("g"):
        lo, hi = np.nanquantile(part["diff"], [0.025, 0.975])
        assert [ci[g]["ci_lower"], ci[g]["ci_upper"], ci[g]["mean_diff"]] == pytest.approx([lo, hi, part["diff"].mean()])
        assert ci[g]["significant"] == (lo > 0 or hi < 0)


def test_bootstrap_tasks_hold_little(spread, monkeypatch):
    """Tasks follow the counts that are sent to them, lists of counts are not taken apart into objects, and draws come in small pieces."""
    import re
    import tracemalloc

    counts = np.ones((20_000, 3), np.int64)
    draws = np.full((250, 1), counts.sum())
    tracemalloc.start()
    bootstrap.resampled("k", 0, int(counts.sum()), counts, range(1, 251), draws[:, 0], np.zeros(250, np.int64))
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()

    monkeypatch.setattr(bootstrap, "COUNTS", 40, raising=False)
    monkeypatch.setattr(bootstrap, "STEPS", 16)
    rows = [("g", s, float(i), 1 + i % 3) for s in (labels.MONO, labels.PLURI) for i in range(50)]
    df = spread.createDataFrame(rows, "g string, side string, y double, grade int")
    got = bootstrap.bootstrap_diff(df, "g", "side", "y", "grade", GRADES, n_iter=1000)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # 50 values of 3 grades on two sides, four times as 250 iterations are taken at a time
    assert "30" in re.findall(r"RepartitionByExpression \[g#\d+, side#\d+, _block#\w+, _from#\d+\], (\d+)", plan)


def test_ks_normality(spark):
    rng = np.random.default_rng(4)
    values = [*rng.normal(3, 2, 80).round(1).tolist(), 3.0, 3.0, 9.9, None]
    r = linear.ks_normality(spark.createDataFrame([(v,) for v in values], "y double").repartition(4), "y").first()
    x = np.sort([v for v in values if v is not None])
    z = (x - x.mean()) / x.std(ddof=1)
    p = np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z])
    upto = np.searchsorted(x, x, "right") / len(x)
    below = np.searchsorted(x, x, "left") / len(x)
    assert r.n == len(x) and r.distance == pytest.approx(max((upto - p).max(), (p - below).max()), abs=1e-9)
    t = math.sqrt(len(x)) * r.distance
    assert r.p_value == pytest.approx(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 200)), abs=1e-9)
    assert linear.ks_normality(spark.createDataFrame([(1.0,), (1.0,)], "y double"), "y").first().distance is None
