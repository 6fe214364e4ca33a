import pytest
from conftest import as_dicts
from pyspark.sql import functions as F

from paneldrift.functions import labels
from paneldrift.operators import change, reshape


def test_growth_and_shares(panel):
    df = panel([("1", "a", 1, 2), ("1", "a", 100, 3), ("1", "b", 1, 2), ("1", "b", 100, 1)])
    got = as_dicts(change.indicators(df, 1, 100), "species")
    assert (got["a"]["evol"], got["a"]["growth_pct"], got["a"]["share_shift"]) == (1, 50, 25)
    assert (got["b"]["evol"], got["b"]["growth_pct"], got["b"]["share_shift"]) == (-1, -50, -25)
    assert got["a"]["total_ini"] == got["a"]["total_fin"] == 4


def test_arrival(panel):
    df = panel([("1", "a", 1, 0), ("1", "a", 100, 5), ("1", "b", 1, 5), ("1", "b", 100, 5)])
    a = as_dicts(change.indicators(df, 1, 100), "species")["a"]
    assert a["growth_pct"] is None and a["share_shift"] == 50
    m = as_dicts(change.change_metrics(df, 1, 100), "species")["a"]
    assert m["pct_appear"] == 50 and m["pct_loss"] is None and m["diff_abs"] is None and m["pct_growth"] is None
    assert as_dicts(change.share_change(df, 1, 100), "species")["a"]["evolution"] == "exp"


def test_absent_at_both_dates_is_dropped(panel):
    df = panel([("1", "a", 1, 1), ("1", "a", 100, 1), ("1", "c", 1, 0), ("1", "c", 100, 0)])
    assert set(as_dicts(change.indicators(df, 1, 100), "species")) == {"a"}
    assert set(as_dicts(change.change_metrics(df, 1, 100), "species")) == {"a"}
    assert {r.species for r in reshape.drop_all_zero(df).collect()} == {"a"}


def test_zero_filter_with_missing_values(panel):
    df = panel([("1", "a", 1, None), ("1", "a", 2, 0), ("1", "b", 1, None), ("1", "b", 2, 1),
                ("1", "c", 1, None), ("1", "c", 2, None)])
    assert {r.species for r in reshape.drop_all_zero(df).collect()} == {"b"}
    assert set(as_dicts(change.change_metrics(df, 1, 2), "species")) == {"b"}


def test_missing_start_row(panel):
    df = panel([("1", "d", 100, 4), ("1", "e", 1, 1), ("1", "e", 100, 2)])
    two = as_dicts(reshape.two_dates(df, 1, 100), "species")
    assert two["d"]["ini"] is None and two["d"]["fin"] == 4
    assert set(as_dicts(change.smoothed_dates(df, 1, 100), "species")) == {"e"}
    assert as_dicts(reshape.two_dates(df, 1, 100, missing="zero"), "species")["d"]["ini"] == 0
    assert as_dicts(change.smoothed_dates(df, 1, 100, 2, missing="zero"), "species")["d"] == {
        "plot": "1", "scenario": "s", "species": "d", "ini": 0.0, "fin": 2.0}


def test_unknown_value_beside_zero_is_dropped_and_beside_presence_kept(panel):
    df = panel([("1", "a", 1, 0), ("1", "b", 1, 3)])
    assert set(as_dicts(change.indicators(df, 1, 100), "species")) == {"b"}


def test_smoothing_means_known_trailing_dates_and_keeps_repeated_starts(panel):
    rows = [("1", "a", 1, 10), ("1", "a", 1, 10), ("1", "a", 1, 20)]
    rows += [("1", "a", y, v) for y, v in ((98, 1), (99, None), (100, 3), (97, 50))]
    got = change.smoothed_dates(panel(rows), 1, 100, 3).collect()
    assert sorted((r.ini, r.fin) for r in got) == [(10, 2), (10, 2), (20, 2)]


def test_start_date_inside_trailing_window(panel):
    df = panel([("1", "a", 1, 4), ("1", "a", 2, 6), ("1", "a", 3, 8)])
    got = change.smoothed_dates(df, 1, 3, 3).collect()
    assert [(r.ini, r.fin) for r in got] == [(4, 6)]


def test_stored_missing_value_is_no_zero(panel):
    df = panel([("1", "a", 1, 2), ("1", "a", 2, None), ("1", "a", 3, 4), ("1", "b", 1, 1), ("1", "z", 1, 5)])
    for m in ("zero", "null"):
        assert as_dicts(change.smoothed_dates(df, 1, 3, 3, missing=m), "species")["a"]["fin"] == 3
    cells = as_dicts(reshape.densify(df, ["a", "b"]), "species", "year")
    assert cells["a", 2]["value"] is None and cells["b", 2]["value"] == 0 and cells["z", 1]["value"] == 5
    assert len(cells) == 7 and reshape.two_dates(df, 1, 2, missing="zero").where("species = 'a'").first().fin is None


def test_dominant_species(panel):
    df = panel([("1", "b", 1, 3), ("1", "a", 1, 3), ("1", "c", 1, 2), ("2", "a", 1, 0), ("2", "b", 1, None)])
    got = change.dominant_species(reshape.two_dates(df, 1, 2), ("plot",), 0.5).collect()
    assert [(r.plot, r.dominant, r.max_share, r.stand_type) for r in got] == [("1", "a", 0.375, labels.PLURI)]


def test_zero_reading_of_sparse_panel_equals_dense_panel(panel):
    sparse = panel([("1", "a", 1, 5), ("1", "b", 3, 2), ("1", "c", 2, 9), ("2", "a", 1, 1), ("2", "a", 3, 4)])
    dense = reshape.densify(sparse, ["a", "b", "c"], [1, 2, 3])
    assert dense.count() == 18
    for make in (
        lambda p, m: change.indicators(p, 1, 3, missing=m),
        lambda p, m: change.smoothed_indicators(p, 1, 3, 2, missing=m),
    ):
        key = lambda r: (r["plot"], r["species"])
        left = sorted((r.asDict() for r in make(sparse, "zero").collect()), key=key)
        right = sorted((r.asDict() for r in make(dense, "null").collect()), key=key)
        assert left == right and left


def test_plan_of_the_dense_panel_does_not_grow_with_the_levels(panel, spark):
    df = panel([("1", "s3", 1, 5), ("1", "s200", 3, 2), ("2", "s1", 2, 9), ("2", "zz", 9, 1)])
    plans = []
    for n in (4, 400):
        levels = spark.createDataFrame([(f"s{i}",) for i in range(n)], "name string")
        dense = reshape.densify(df, levels, [1, 2, 3])
        plans.append(len(dense._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(plans[0] - plans[1]) < 100
    rows = dense.collect()
    cells = {(r.plot, r.species, r.year): r.value for r in rows}
    assert len(rows) == len(cells) == 2 * 400 * 3 + 1  # zz at 9 is outside the lists and stays
    assert {k: v for k, v in cells.items() if v} == {("1", "s3", 1): 5, ("1", "s200", 3): 2, ("2", "s1", 2): 9, ("2", "zz", 9): 1}
    only_outside = reshape.densify(panel([("1", "zz", 9, 1)]), ["a"], [1, 2])
    assert {(r.species, r.year, r.value) for r in only_outside.collect()} == {("zz", 9, 1.0), ("a", 1, 0.0), ("a", 2, 0.0)}
    assert reshape.densify(df.limit(0)).collect() == []


def test_duplicate_cell_is_an_error(panel):
    df = panel([("1", "a", 1, 1), ("1", "a", 1, 2), ("1", "a", 100, 2)])
    for broken in (
        reshape.two_dates(df, 1, 100),
        reshape.densify(df, ["a"], [1, 100]),
        reshape.to_wide(df, ["a"]),
        change.share_change(df, 1, 100),
    ):
        with pytest.raises(Exception, match="duplicate cell"):
            broken.collect()


def test_empty_start_total(panel):
    df = panel([("2", "a", 1, 0), ("2", "a", 100, 5)])
    row = change.indicators(df, 1, 100).first()
    assert row.stand_type == labels.PLURI and row.max_share is None and row.share_shift is None


@pytest.mark.parametrize("share, expected", [(0.8, labels.MONO), (0.7999, labels.PLURI)])
def test_dominance_edge(panel, share, expected):
    df = panel([("1", "a", 1, share * 10000), ("1", "b", 1, (1 - share) * 10000),
                ("1", "a", 2, 1), ("1", "b", 2, 1)])
    assert {r.stand_type for r in change.indicators(df, 1, 2).collect()} == {expected}


def test_quarter_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 25.0, 25.0001, 50.0, 75.0, 100.0, 100.1, None)], "x double")
    got = [r.c for r in df.select(labels.quartile_class("x").alias("c")).collect()]
    a, b, c, d = labels.QUARTILE_LABELS
    assert got == [a, a, b, b, c, d, None, None]


def test_evolution_from_shares_edges(spark):
    rows = [(0.2, 0.01), (0.2, 0.005), (0.0, 0.2), (0.3, 0.2), (0.05, 0.05), (None, 0.5), (0.1, 0.1)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = [r.c for r in df.select(labels.evolution_from_shares("a", "b").alias("c")).collect()]
    assert got == [None, "disp", "exp", "declin", None, None, None]


def test_evolution_from_growth_precedence(spark):
    rows = [(-100.0, 5.0, 1.0, 2.0), (1.0, -5.0, 2.0, 1.0), (None, 5.0, 1.0, 2.0), (None, 5.0, 2.0, 1.0),
            (-5.0, 1.0, 1.0, 2.0), (-5.0, -1.0, 1.0, 2.0), (0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g double, s double, i double, f double")
    got = [r.c for r in df.select(labels.evolution_from_growth("g", "s", "i", "f").alias("c")).collect()]
    assert got == ["disp", "exp", "exp", None, "exp", "declin", None]


def test_agreement(spark):
    rows = [("declin", 2), ("declin", 1), ("exp", 1), ("exp", 3), ("disp", 3), (None, 1), ("exp", None), ("declin", 3)]
    df = spark.createDataFrame(rows, "e string, g int")
    got = [r.c for r in df.select(labels.agreement("e", "g").alias("c")).collect()]
    assert got == ["OK", "pasOK", "OK", "pasOK", "pasOK", "pasOK", "pasOK", "OK"]


def test_presence_and_likelihood(panel):
    rows = [("1", "low", 1, 10), ("1", "low", 2, 4), ("1", "mid", 1, 10), ("1", "mid", 2, 5),
            ("1", "new", 1, 0), ("1", "new", 2, 5), ("1", "gone", 1, 5), ("1", "gone", 2, 1),
            ("1", "up", 1, 1), ("1", "up", 2, 30)]
    got = as_dicts(change.with_classes(change.change_metrics(panel(rows), 1, 2)), "species")
    assert {s: r["likelihood"] for s, r in got.items()} == {
        "low": "faible", "mid": "moyen", "new": "fort", "gone": None, "up": "fort"}
    assert got["gone"]["presence"] == "absence" and got["mid"]["loss_class"] == "25–50%"
    strict = as_dicts(change.with_classes(change.change_metrics(panel(rows), 1, 2), loss_threshold=40.0), "species")
    assert strict["mid"]["likelihood"] == "faible"


def test_exactly_one_measure_per_row(spark):
    from checks import registry

    rows = registry.metrics(spark, "/root/testdata/sf0.001").collect()
    for r in rows:
        assert sum(v is not None for v in (r.pct_loss, r.pct_appear, r.pct_growth)) == 1


def test_shares_add_up_to_one(panel):
    df = panel([("1", "a", 1, 3), ("1", "b", 1, 7), ("1", "a", 2, 0), ("2", "a", 1, 5), ("2", "b", 1, None)])
    totals = as_dicts(reshape.shares(df).groupBy("plot", "year").agg(F.sum("share").alias("s")), "plot", "year")
    assert totals[("1", 1)]["s"] == pytest.approx(1) and totals[("1", 2)]["s"] is None
    assert totals[("2", 1)]["s"] == pytest.approx(1)


def test_trailing_ratio_matches_dates_not_positions(panel):
    df = panel([("1", "a", 91, 2), ("1", "a", 95, 100), ("1", "a", 100, 4), ("1", "b", 92, 2), ("1", "b", 100, 4)])
    got = reshape.trailing_ratio(df, "value", 9).collect()
    assert [(r.species, r.year, r.now, r.before, r.ratio) for r in got] == [("a", 100, 4, 2, 2)]


def test_wide_and_back(panel):
    df = panel([("1", "a", 1, 3), ("1", "b", 1, 7), ("2", "b", 1, 1)])
    wide = reshape.wide_total(reshape.to_wide(df, ["a", "b"]), ["a", "b"])
    got = as_dicts(wide, "plot")
    assert (got["1"]["a"], got["1"]["b"], got["1"]["total"]) == (3, 7, 10)
    assert (got["2"]["a"], got["2"]["total"]) == (None, 1)
    back = as_dicts(reshape.to_long(wide, ["a", "b"]), "plot", "species")
    assert back[("2", "a")]["value"] is None and back[("1", "b")]["value"] == 7


def test_stack_labels_each_part(panel):
    both = reshape.stack({"M": panel([("1", "a", 1, 1)]), "P": panel([("2", "b", 1, 2)])})
    assert sorted((r.model, r.plot) for r in both.collect()) == [("M", "1"), ("P", "2")]
