import numpy as np
import pytest
from conftest import as_dicts
from pyspark.sql import Observation
from pyspark.sql import functions as F

from paneldrift.functions import columns, labels
from paneldrift.operators import change, charts, enrich, spatial
from paneldrift.plans import analyses
from paneldrift.session import stored
from paneldrift.sources import schema, tables


def _graded(spark, rows):
    return spark.createDataFrame(
        rows, "plot string, scenario string, species string, year int, value double, grade int"
    )


def test_grade_lookup(spark):
    df = _graded(spark, [("1", "s", "a", 1, 1.0, 2), ("1", "s", "a", 2, 0.0, 2), ("1", "s", "b", 1, 0.0, 1),
                         ("1", "s", "b", 2, 0.0, 1), ("1", "s", "c", 2, 4.0, None), ("1", "s", "a", 9, 4.0, 3)])
    got = as_dicts(enrich.grade_lookup(df, 1, 2), "species")
    assert {k: v["grade"] for k, v in got.items()} == {"a": 2, "c": None}


@pytest.mark.parametrize("other", [3, None])
def test_ambiguous_grade_is_an_error(spark, other):
    df = _graded(spark, [("1", "s", "a", 1, 1.0, 2), ("1", "s", "a", 2, 1.0, other)])
    with pytest.raises(Exception, match="more than one grade"):
        enrich.grade_lookup(df, 1, 2).collect()


def test_repeated_grade_row_is_an_error(spark):
    df = _graded(spark, [("1", "s", "a", 1, 1.0, 2), ("1", "s", "a", 1, 1.0, 2)])
    with pytest.raises(Exception, match="duplicate cell"):
        enrich.grade_lookup(df, 1, 2).collect()


def test_grade_join_keeps_rows(panel, spark):
    df = change.indicators(panel([("1", "a", 1, 1), ("1", "a", 2, 2), ("1", "b", 1, 1), ("1", "b", 2, 2)]), 1, 2)
    graded = _graded(spark, [("1", "s", "a", 2, 1.0, 3), ("1", "s", "a", 1, 1.0, 1)])
    got = as_dicts(enrich.attach_grade(df, enrich.grade_at(graded, 2)), "species")
    assert got["a"]["grade"] == 3 and got["b"]["grade"] is None


def test_missing_join_keys_still_get_totals(panel, spark):
    site = spark.createDataFrame([("1", 2.0, 45.0), ("3", None, None)], "plot string, lon double, lat double")
    rows = [("1", "a", 1, 1), ("1", "b", 1, 2), ("3", "a", 1, 5), ("3", "b", 1, 6), ("3", "a", 2, 7)]
    got = as_dicts(enrich.attach_totals(enrich.attach_site(panel(rows), site), 1, 2), "plot", "species")
    assert got[("3", "b")]["total_start"] == 11 and got[("3", "b")]["total_end"] == 7
    assert got[("1", "a")]["total_end"] is None and got[("1", "a")]["end_value"] == 0
    left = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    right = spark.createDataFrame([(None, 10), ("x", 20)], "k string, b int")
    assert sorted(r.b for r in enrich.join_null_safe(left, right, ["k"]).collect()) == [10, 20]


def test_analysis_table_row_count_is_kept_by_joins(spark):
    from checks import registry

    sf = "/root/testdata/sf0.001"
    assert registry.analysis_table(spark, sf).count() == registry.measured(spark, sf).count()


def test_belts(panel, spark):
    table = enrich.belt_table(spark)
    assert table.count() == 11
    rows = spark.createDataFrame([("Picea_abies",), ("Quercus_suber",), ("Quercus_ilex",)], "species string")
    got = {r.species: r.belt for r in enrich.attach_belt(rows, table).collect()}
    assert got == {"Picea_abies": "montagnard", "Quercus_ilex": "mediterraneen"}


def test_models_are_paired_by_key(spark):
    m = spark.createDataFrame([("1", "L_a", 1.0), ("2", "L_a", 2.0)], "plot string, species_latin string, growth_pct double")
    p = spark.createDataFrame([("2", "L_a", 20.0), ("1", "L_b", 5.0)], "plot string, species_latin string, growth_pct double")
    assert [(r.plot, r.value_m, r.value_p) for r in enrich.pair_models(m, p).collect()] == [("2", 2.0, 20.0)]


RINGS = [("sq", 1, 0, 0.0, 0.0), ("sq", 1, 1, 1.0, 0.0), ("sq", 1, 2, 1.0, 1.0), ("sq", 1, 3, 0.0, 1.0)]
HOLE = [("sq", 2, 0, 0.4, 0.4), ("sq", 2, 1, 0.6, 0.4), ("sq", 2, 2, 0.6, 0.6), ("sq", 2, 3, 0.4, 0.6)]
RING_TYPE = "region string, ring_id int, seq int, lon double, lat double"


def test_points_in_square_with_hole(spark):
    rings = spark.createDataFrame([*RINGS, *HOLE], RING_TYPE)
    pts = spark.createDataFrame(
        [("in", 0.2, 0.2), ("hole", 0.5, 0.5), ("out", 1.5, 0.5), ("above", 0.5, 1.5), ("none", None, 0.5)],
        "plot string, lon double, lat double",
    )
    assert [r.plot for r in spatial.within_rings(pts, rings).collect()] == ["in"]
    assert spatial.unlocated_count(pts).first().n_unlocated == 1


def test_points_in_polygon_match_brute_force(spark):
    rng = np.random.default_rng(1)
    angle = np.sort(rng.random(60) * 2 * np.pi)
    radius = 1 + rng.random(60)
    ring = list(zip((radius * np.cos(angle)).tolist(), (radius * np.sin(angle)).tolist()))
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-2.2, 2.2, (400, 2)))]

    def inside(x, y):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
        return odd

    rings = spark.createDataFrame([("r", 1, i, x, y) for i, (x, y) in enumerate(ring)], RING_TYPE)
    pts = spark.createDataFrame(points, "plot int, lon double, lat double")
    for height in (0.1, 5.0):
        got = {r.plot for r in spatial.within_rings(pts, rings, height).collect()}
        assert got == {i for i, x, y in points if inside(x, y)}


def test_layers_and_colours(panel, spark):
    site = spark.createDataFrame([("1", 2.0, 45.0), ("2", None, None)], "plot string, lat double, lon double")
    rows = [("1", "a", 1, 10), ("1", "a", 2, 2), ("1", "b", 1, 0), ("1", "b", 2, 8), ("2", "a", 1, 1), ("2", "a", 2, 1)]
    made = analyses.change_map(panel(rows), site, 1, 2, "s")
    loss = charts.map_layer(made, "loss").collect()
    assert [(r.plot, r.species, r.measure, r["class"], r.colour) for r in loss] == [("1", "a", 80, "75–100%", "red")]
    assert charts.map_layer(made, "appearance", "b").first().colour == "green"
    assert charts.map_layer(made, "change", "a").first().measure == -8
    assert {r["class"] for r in charts.map_layer(made, "presence").collect()} == {"presence"}
    assert {r.species: r["class"] for r in charts.map_layer(made, "likelihood").collect()} == {"a": "faible", "b": "fort"}
    value = charts.value_layer(panel(rows), site, "s", 2, "a").collect()
    assert [(r.plot, r.measure) for r in value] == [("1", 2)]


def test_series_and_bars(panel, spark):
    rows = [("1", "a", 2, 2), ("1", "a", 1, 1), ("1", "b", 1, 9), ("2", "a", 1, 5)]
    got = charts.series(panel(rows), "s", ["1"], ["a"]).collect()
    assert [(r.year, r.value) for r in got] == [(1, 1), (2, 2)]
    bars = spark.createDataFrame([("x", 3.0), ("y", 1.0), ("z", None)], "k string, v double")
    ordered = charts.ordered_bars(bars, "k", "v")
    assert {r.k: r.sort_key for r in ordered.collect()} == {"y": 1, "x": 2, "z": 3}
    assert [r.k for r in charts.pick_bars(bars, ["k"], [1, 3]).orderBy("k").collect()] == ["x", "z"]
    found = spark.createDataFrame(
        [("m", -0.125, 0.01, labels.RELATION_GOOD), ("p", 0.5, 0.2, labels.RELATION_WEAK)],
        "t string, rho double, p_value double, relation string",
    ).withColumn("f", F.lit("all"))
    got = as_dicts(charts.correlation_bars(found, "t", ["f"]), "t")
    assert got["m"]["label"] == "ρ=-0.12" and got["m"]["colour"] == "#2E8B57" and got["p"]["label"] == ""


def test_distribution_by_year(panel):
    rows = [(str(i), "a", 1, i) for i in range(1, 6)] + [("1", "b", 1, 99)]
    stats, _ = charts.distribution_by_year(panel(rows), "a")
    r = stats.first()
    assert (r.year, r.n, r.q1, r.median, r.q3) == (1, 5, 2, 3, 4)


def test_text_helpers(spark):
    df = spark.createDataFrame([("a", None, 1.0, 2.5)], "x string, y string, v double, w double")
    r = df.select(columns.words("x", "y").alias("t"), columns.short_number("v").alias("v"),
                  columns.short_number("w", 0).alias("w")).first()
    assert (r.t, r.v, r.w) == ("a NA", "1", "2")


def test_delimited_source_by_name(spark, tmp_path):
    path = tmp_path / "panel.tsv"
    path.write_text("Year\tIDP\tspeciesName\tbasalAreaSum\tScenario\n2001\t007\tQRob\t1.5\tx\n2100\t007\tQRob\tNA\tx\n")
    df = tables.read_delimited(spark, str(path), schema.PANEL_P, schema.NAMES_P)
    assert df.columns == ["plot", "scenario", "year", "species", "value"]
    assert [tuple(r) for r in df.orderBy("year").collect()] == [("007", "x", 2001, "QRob", 1.5), ("007", "x", 2100, "QRob", None)]


def test_delimited_files_with_other_headers_and_bad_numbers(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.tsv").write_text("Year\tIDP\tspeciesName\tbasalAreaSum\tScenario\n2001\t1\tQRob\t1.5\tx\n")
    (folder / "b.tsv").write_text("speciesName\tIDP\tYear\textra\n" + "FSyl\t2\t2002\tz\n" * 50)
    df = tables.read_delimited(spark, str(folder), schema.PANEL_P, schema.NAMES_P)
    assert {tuple(r) for r in df.collect()} == {("1", "x", 2001, "QRob", 1.5), ("2", None, 2002, "FSyl", None)} and df.count() == 51
    (folder / "c.tsv").write_text("Year\tIDP\tspeciesName\tbasalAreaSum\tScenario\n2001\t1\tQRob\t1,5\tx\n")
    with pytest.raises(Exception, match="row not readable: value: 1,5"):
        tables.read_delimited(spark, str(folder), schema.PANEL_P, schema.NAMES_P).collect()


def test_rejected_rows_come_with_their_reason(spark, tmp_path):
    (tmp_path / "a.tsv").write_text(
        "Year\tIDP\tspeciesName\tbasalAreaSum\tScenario\n2001\t1\tQRob\t1.5\tx\n2001\t2\tQRob\t1,5\tx\n\n2001\t3\n"
        "2001a\t4\tQRob\tabc\tx\n2001\t5\tQRob\tNA\tx\n2001\t6\tQRob\t\tx\n2001\t7\t\"Q\tb\"\tNaN\tx\n"
    )
    (tmp_path / "b.tsv").write_text("basalAreaSum\tIDP\n2\t8\nx\t9\n3\t10\tmore\n")
    good, rejected = tables.read_with_rejects(spark, str(tmp_path), schema.PANEL_P, schema.NAMES_P)
    assert {tuple(r) for r in good.collect()} == {
        ("1", "x", 2001, "QRob", 1.5), ("5", "x", 2001, "QRob", None), ("6", "x", 2001, "QRob", None),
        ("7", "x", 2001, "Q\tb", None), ("8", None, None, None, 2.0),
    }
    told = {(r.file.rsplit("/")[-1], r.line, r.reason) for r in rejected.collect()}
    assert told == {
        ("a.tsv", "2001\t2\tQRob\t1,5\tx", "value: 1,5"), ("a.tsv", "2001\t3", "number of fields"),
        ("a.tsv", "2001a\t4\tQRob\tabc\tx", "year: 2001a"), ("b.tsv", "x\t9", "value: x"), ("b.tsv", "3\t10\tmore", "number of fields"),
    }
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "FileScan parquet" in plan  # the text was read once, before


def test_headers_are_read_as_first_lines_of_each_file(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.tsv").write_text(f"IDP\tbasalAreaSum{i % 2}\n" + f"{i}\t1\n" * 20_000)
    heads = {r.file.rsplit("/")[-1]: r["head"] for r in tables._headers(spark, str(tmp_path)).collect()}
    assert heads == {f"{i}.tsv": f"IDP\tbasalAreaSum{i % 2}" for i in range(5)}
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty.tsv").write_text("")
    assert tables.read_delimited(spark, str(tmp_path / "none"), schema.PANEL_P, schema.NAMES_P).collect() == []


def test_one_scenario_replaces_no_other(spark, tmp_path):
    path = str(tmp_path / "r")
    for rows in ([("1", "x", 1.0), ("2", "x", 2.0)], [("1", "y", 3.0)], [("3", "x", 4.0)]):
        tables.write_table(spark.createDataFrame(rows, "plot string, scenario string, value double"), path, ("scenario",))
    got = spark.read.parquet(path).select("plot", "scenario", "value")
    assert {tuple(r) for r in got.collect()} == {("3", "x", 4.0), ("1", "y", 3.0)}
    tables.write_table(spark.createDataFrame([("9",)], "plot string"), path + "2")
    tables.write_table(spark.createDataFrame([("8",)], "plot string"), path + "2")
    assert [r.plot for r in spark.read.parquet(path + "2").collect()] == ["8"]


@pytest.mark.parametrize("size", [0.05, 0.3, 4.0])
def test_overlapping_regions_match_brute_force(spark, size):
    """Stars with holes and islands that overlap, points on a lattice that meets many edges and corners."""
    rng = np.random.default_rng(8)
    rings = {}
    for k in range(4):
        angle = np.sort(rng.random(25) * 2 * np.pi)
        star = np.c_[np.cos(angle), np.sin(angle)] * (0.4 + rng.random((25, 1))) + rng.uniform(-0.5, 0.5, 2)
        rings[f"r{k}"] = [star.tolist(), (star * 0.3).tolist()]
    rings["box"] = [[[-1.0, -1.0], [0.5, -1.0], [0.5, 0.75], [-1.0, 0.75]], [[-0.5, -0.5], [0.0, -0.5], [0.0, 0.0], [-0.5, 0.0]]]
    points = [(i, x, y) for i, (x, y) in enumerate((a / 4, b / 4) for a in range(-7, 8) for b in range(-7, 8))]
    points += [(1000 + i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-2, 2, (300, 2)))]

    def inside(x, y, ring_list):
        odd = False
        for ring in ring_list:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                    odd = not odd
        return odd

    table = [(name, r, i, *map(float, p)) for name, parts in rings.items() for r, ring in enumerate(parts) for i, p in enumerate(ring)]
    df = spark.createDataFrame(table, RING_TYPE)
    pts = spark.createDataFrame(points, "plot int, lon double, lat double")
    want = {(i, name) for i, x, y in points for name, parts in rings.items() if inside(x, y, parts)}
    got = [(r.plot, r.region) for r in spatial.regions_of(pts, df, size).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    some = [r.plot for r in spatial.within_rings(pts, df, size).collect()]
    assert len(some) == len(set(some)) and set(some) == {i for i, _ in want}


def test_points_without_coordinates_are_counted_on_the_way(spark):
    seen = Observation()
    rows = spark.createDataFrame([("1", 0.5, 0.5), ("2", None, 0.5)], "plot string, lon double, lat double")
    assert spatial.located(rows, seen=seen).count() == 1 and seen.get == {"n_unlocated": 1}


@pytest.fixture
def shuffled_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def _joined_parts(spark, value, **options):
    """Rows per task after the join, rows of the key table that were moved, and the joined rows."""
    left = stored(spark.range(8000).select("id", value.alias("v")))
    right = stored(left.groupBy("v").agg(F.count("*").alias("n")))
    joined = enrich.join_weighted(left, right, ("v",), "n", **options)
    parts = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    last = F.when(F.col("n") > options["block"], F.ceil(F.col("n") / options["block"])).otherwise(1)
    return parts, right.agg(F.sum(last)).first()[0], joined


def test_heavy_key_is_spread_by_its_weight(shuffled_joins):
    """Half of the rows share one value: it goes to as many tasks as it has blocks, all other values stay single."""
    half = F.when(F.col("id") % 2 == 0, -100.0).otherwise(F.col("id").cast("double"))
    parts, moved, joined = _joined_parts(shuffled_joins, half, block=100)
    assert joined.where("v = -100").agg(F.min("n"), F.count("*")).first() == (4000, 4000) and joined.count() == 8000
    assert max(parts) < 3 * 8000 / 8 and moved == 4000 + 40


def test_distinct_keys_are_not_multiplied(shuffled_joins):
    parts, moved, joined = _joined_parts(shuffled_joins, F.col("id"), block=100)
    assert moved == joined.count() == joined.where("n = 1").count() == 8000 and max(parts) < 3 * 8000 / 8


def test_missing_keys_and_keys_without_a_row(shuffled_joins):
    value = F.when(F.col("id") % 4 == 0, None).otherwise(F.col("id") % 3)
    left = stored(shuffled_joins.range(800).select("id", value.alias("v")))
    right = stored(left.where("v IS NULL OR v > 0").groupBy("v").agg(F.count("*").alias("n")))
    joined = enrich.join_weighted(left, right, ("v",), "n", F.xxhash64("id"), block=10)
    assert joined.where("v IS NULL").agg(F.min("n"), F.count("*")).first() == (200, 200)
    assert joined.where("v = 0 AND n IS NULL").count() == left.where("v = 0").count() and joined.count() == 800
    empty = enrich.join_weighted(left, right.limit(0), ("v",), "n", F.xxhash64("id"))
    assert empty.where("n IS NULL").count() == 800


def test_heavy_keys_are_few(shuffled_joins, monkeypatch):
    """With more heavy keys than the list may hold, blocks grow."""
    monkeypatch.setattr(enrich, "HEAVY", 4)
    left = stored(shuffled_joins.range(900).select("id", (F.col("id") % 9).alias("v")))
    right = stored(left.groupBy("v").agg(F.count("*").alias("n")))
    joined = enrich.join_weighted(left, right, ("v",), "n", block=10)
    assert joined.count() == 900 and joined.where("n <> 100").isEmpty()


def test_site_source(spark, tmp_path):
    path = tmp_path / "site.csv"
    path.write_text("IDP,Lat,Lon,GRECO,N_GB,Fertility_score\n1,45.5,2.5,A,3,high\n")
    r = tables.read_site(spark, str(path)).first()
    assert (r.plot, r.lat, r.greco, r.large_stems, r.fertility_score) == ("1", 45.5, "A", 3, "high")


def test_stored_tables(spark, tmp_path, panel):
    raw = spark.createDataFrame([("7", 1.0), ("8", float("nan"))], "plotcode string, BA double")
    tables.write_table(raw, str(tmp_path / "raw"))
    df = tables.read_table(spark, str(tmp_path / "raw"), schema.NAMES_M)
    assert {r.plot: r.value for r in df.collect()} == {"7": 1.0, "8": None}
    both = panel([("1", "a", 1, 1)], "x").unionByName(panel([("1", "a", 1, 2)], "y"))
    tables.write_table(both, str(tmp_path / "out"), ("scenario",))
    pruned = spark.read.parquet(str(tmp_path / "out")).where(F.col("scenario") == "y")
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scenario" in plan and pruned.first().value == 2
    spark.createDataFrame([*RINGS, ("other", 1, 0, 0.0, 0.0)], RING_TYPE).write.parquet(str(tmp_path / "rings"))
    assert tables.read_region(spark, str(tmp_path / "rings"), "sq").count() == 4
    assert tables.inspect(both, 1).count() == 1


def test_bucketed_panel_needs_no_shuffle(spark, panel, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS bucketed LOCATION '{tmp_path}/db'")
    tables.write_bucketed(panel([("1", "a", 1, 1), ("1", "a", 2, 3)]), "bucketed.panel", 4)
    df = change.indicators(spark.table("bucketed.panel"), 1, 2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and df.first().growth_pct == 200


def test_schema_helpers(spark):
    df = schema.with_empty(spark.createDataFrame([(2,)], "grade int"), "total")
    assert dict(df.dtypes)["total"] == "double"
    assert dict(schema.as_category(df, "grade").dtypes)["grade"] == "string"
    assert [f.name for f in schema.GRADE_P.fields][-1] == "grade" and "sim_id" in schema.GRADE_M.fieldNames()
