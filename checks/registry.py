"""The library's operators as queries on the order-processing tables (see FIXTURES.md, part 3)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneldrift.functions import labels
from paneldrift.operators import (
    bootstrap,
    change,
    charts,
    enrich,
    linear,
    ordering,
    profile,
    rank_tests,
    reshape,
    spatial,
)
from paneldrift.plans import analyses
from paneldrift.session import shared_folder
from paneldrift.sources import order_tables as src
from paneldrift.sources import schema, tables

SCENARIO, START, END = "N", 1995, 2001
WINDOW, LAG, DOMINANCE = 3, 3, 0.15
GRADES = (1, 2, 3)
MODEL_M, MODEL_P = "A", "R"
BOOT_ITER, BOOT_SEED = 5000, 7
# Plots and species of the charts, and the species listed in either model of the pairing.
PLOTS, SPECIES = (1, 2, 3, 5, 8), ("Brand#11", "Brand#13", "Brand#25")
LISTED_M, LISTED_P = ("Brand#11", "Brand#12", "Brand#13", "Brand#14"), ("Brand#12", "Brand#13", "Brand#14", "Brand#21")


# Sums of squares have nine digits before the point, which leaves fewer behind it.
DIGITS = {"ss_between": 3, "ss_within": 3, "ms_between": 3, "ms_within": 3}


def rounded(df: DataFrame) -> DataFrame:
    """Rounded by plain arithmetic, which gives the same bits on every engine and no negative zero.

    The step lies a hair off one half, so that a value just between two digits (1.0546875) does not
    hang on the last bit of its sum.
    """

    def shown(name: str, kind: str):
        scale = 10.0 ** DIGITS.get(name, 6)
        c = F.col(f"`{name}`")
        return (F.floor(c * scale + 0.5001) / scale).alias(name) if kind == "double" else c

    return df.select(*[shown(n, t) for n, t in df.dtypes])


def sparse(spark, sf, scenario=SCENARIO, years=(START, END)) -> DataFrame:
    return src.cells(spark, sf, scenario, years)


def dense(spark, sf, years=(START, END), scenario=SCENARIO) -> DataFrame:
    return reshape.densify(src.cells(spark, sf, scenario, years), src.species_table(spark, sf), years)


def measured(spark, sf, scenario=SCENARIO) -> DataFrame:
    return change.indicators(
        sparse(spark, sf, scenario), START, END, missing="zero", dominance=DOMINANCE
    )


def analysed(spark, sf, scenario=SCENARIO, attributes=("grade",)) -> DataFrame:
    panel = sparse(spark, sf, scenario)
    return analyses.analysis_table(
        panel,
        START,
        END,
        scenario,
        graded=src.with_grades(panel),
        attributes=attributes,
        missing="zero",
        dominance=DOMINANCE,
    )


def growths(spark, sf) -> DataFrame:
    """Rows with a known growth and grade, the input of the tests on growth by grade."""
    rows = analysed(spark, sf).where(F.col("growth_pct").isNotNull() & F.col("grade").isNotNull())
    return rows.select("plot", "species", "stand_type", "ini", "fin", "growth_pct", "share_shift", "grade")


def metrics(spark, sf) -> DataFrame:
    return change.change_metrics(sparse(spark, sf), START, END)


def mapped(spark, sf) -> DataFrame:
    return analyses.change_map(sparse(spark, sf), src.sites(spark, sf), START, END)


def judged(spark, sf) -> DataFrame:
    return change.with_agreement(change.with_growth_evolution(analysed(spark, sf)))


# --- indicators and tables -------------------------------------------------------------------------


def two_date_indicators(spark, sf):
    return measured(spark, sf).select(
        "plot", "species", "ini", "fin", "evol", "total_ini", "total_fin", "growth_pct", "share_shift"
    )


def two_date_indicators_sparse(spark, sf):
    return change.indicators(sparse(spark, sf), START, END).select(
        "plot", "species", "ini", "fin", "evol", "total_ini", "total_fin", "growth_pct", "share_shift"
    )


def smoothed_indicators(spark, sf):
    panel = sparse(spark, sf, years=(START, *range(END - WINDOW + 1, END + 1)))
    return change.smoothed_indicators(panel, START, END, WINDOW, missing="zero", dominance=DOMINANCE).select(
        "plot", "species", "ini", "fin", "growth_pct", "share_shift", "stand_type"
    )


def smoothed_indicators_sparse(spark, sf):
    panel = sparse(spark, sf, years=(START, *range(END - WINDOW + 1, END + 1)))
    return change.smoothed_dates(panel, START, END, WINDOW).select("plot", "species", "ini", "fin")


def grade_lookup(spark, sf):
    graded = src.with_grades(sparse(spark, sf))
    return enrich.grade_lookup(graded, START, END, SCENARIO, ("grade", "species_latin"), "zero")


def grade_left_join(spark, sf):
    graded = src.with_grades(sparse(spark, sf, years=(END,)))
    return enrich.attach_grade(measured(spark, sf), enrich.grade_at(graded, END)).select(
        "plot", "species", "growth_pct", "grade"
    )


def stand_type(spark, sf):
    return measured(spark, sf).groupBy("plot", "stand_type").agg(F.max("max_share").alias("max_share"))


def analysis_table(spark, sf):
    panel = sparse(spark, sf)
    return analyses.analysis_table(
        panel,
        START,
        END,
        SCENARIO,
        site=src.sites(spark, sf),
        graded=src.with_grades(panel),
        attributes=("grade", "species_latin"),
        missing="zero",
        dominance=DOMINANCE,
    ).drop("scenario")


def analysis_table_smoothed(spark, sf):
    panel = sparse(spark, sf, years=(START, *range(END - WINDOW + 1, END + 1)))
    return analyses.analysis_table(
        panel,
        START,
        END,
        SCENARIO,
        site=src.sites(spark, sf),
        graded=src.with_grades(panel),
        smooth=WINDOW,
        missing="zero",
        dominance=DOMINANCE,
    ).drop("scenario")


def drop_all_zero_groups(spark, sf):
    return reshape.drop_all_zero(dense(spark, sf))


def densify_panel(spark, sf):
    return dense(spark, sf, None, None)


def share_composition(spark, sf):
    return reshape.shares(sparse(spark, sf, years=None)).select("plot", "species", "year", "value", "total", "share")


def share_ratio_diff(spark, sf):
    return change.share_change(dense(spark, sf), START, END).drop("scenario", "evolution")


def trailing_ratio(spark, sf):
    panel = dense(spark, sf, (START, END - LAG, END))
    return change.share_change(panel, START, END, LAG).select(
        "plot", "species", "share_end", "share_before", "trailing_ratio"
    )


def trailing_ratio_all_dates(spark, sf):
    composed = reshape.shares(sparse(spark, sf, years=None))
    return reshape.trailing_ratio(composed, "share", LAG).select("plot", "species", "year", "now", "before", "ratio")


def evolution_from_shares(spark, sf):
    return change.share_change(dense(spark, sf), START, END).select("plot", "species", "evolution")


def evolution_from_growth(spark, sf):
    return change.with_growth_evolution(measured(spark, sf)).select("plot", "species", "growth_pct", "evolution")


def change_metrics(spark, sf):
    return metrics(spark, sf).drop("scenario")


def loss_appear_classes(spark, sf):
    return change.with_classes(metrics(spark, sf)).select(
        "plot", "species", "pct_loss", "loss_class", "pct_appear", "appear_class"
    )


def presence_absence(spark, sf):
    return change.with_classes(metrics(spark, sf)).select("plot", "species", "end_value", "presence")


def presence_likelihood(spark, sf):
    return change.with_classes(metrics(spark, sf)).select("plot", "species", "presence", "likelihood")


def agreement_flag(spark, sf):
    return judged(spark, sf).select("plot", "species", "evolution", "grade", "agreement")


def contingency(spark, sf):
    return profile.contingency(judged(spark, sf), "grade", "evolution", labels.EVOLUTIONS)


def contingency_shares(spark, sf):
    return profile.contingency_shares(judged(spark, sf), "grade", "evolution")


def species_totals(spark, sf):
    return profile.group_totals(sparse(spark, sf, years=None), "species")


def site_left_join(spark, sf):
    totals = reshape.plot_totals(sparse(spark, sf, years=None))
    return enrich.attach_site(totals, src.sites(spark, sf))


def null_safe_totals_join(spark, sf):
    panel = enrich.attach_site(sparse(spark, sf), src.sites(spark, sf), ["lon", "lat"])
    return enrich.attach_totals(panel, START, END)


def species_wide(spark, sf):
    levels = src.species_levels(spark, sf)
    wide = reshape.to_wide(sparse(spark, sf, years=None), levels)
    return reshape.wide_total(wide, levels).drop("scenario")


def species_long(spark, sf):
    levels = src.species_levels(spark, sf)
    wide = reshape.to_wide(sparse(spark, sf, years=None), levels)
    return reshape.to_long(wide, levels).drop("scenario")


def belt_lookup(spark, sf):
    return enrich.attach_belt(measured(spark, sf), src.belts(spark, sf)).select(
        "plot", "species", "belt", "stand_type", "growth_pct"
    )


def _models(spark, sf):
    m = src.with_grades(measured(spark, sf, MODEL_M)).drop("species", "grade")
    return m, analysed(spark, sf, MODEL_P, ("species_latin",))


def _both_models(spark, sf):
    return enrich.pair_models(*_models(spark, sf))


def cross_model_means(spark, sf):
    return enrich.pair_model_means(*_models(spark, sf))


def cross_model_pairs(spark, sf):
    return _both_models(spark, sf)


def stacked_models(spark, sf):
    columns = ["plot", "species", "ini", "fin", "growth_pct"]
    return reshape.stack(
        {
            "M": measured(spark, sf, MODEL_M).select(*columns),
            "P": measured(spark, sf, MODEL_P).select(*columns),
        }
    )


# --- profiles --------------------------------------------------------------------------------------


def distinct_species(spark, sf):
    return profile.distinct_values(sparse(spark, sf, None, None), "species")


def complete_rows(spark, sf):
    return profile.complete_rows(two_date_indicators_sparse(spark, sf))


def level_codes(spark, sf):
    rows = profile.level_codes(measured(spark, sf), "stand_type")
    return rows.groupBy("stand_type", "stand_type_code").agg(F.count("*").alias("n"))


def numeric_profile(spark, sf):
    return profile.numeric_profile(reshape.plot_totals(sparse(spark, sf, None, None)), "total", ("scenario",))


def numeric_profile_growth(spark, sf):
    return profile.numeric_profile(measured(spark, sf), "growth_pct")


def large_totals(spark, sf):
    totals = reshape.plot_totals(sparse(spark, sf, None, None))
    return totals.where((F.col("total") > 80) & (F.col("year") == START))


def category_frequency(spark, sf):
    return profile.frequency(change.with_growth_evolution(measured(spark, sf)), "evolution")


def agreement_frequency(spark, sf):
    return profile.frequency(judged(spark, sf), "agreement")


def boxplot_stats(spark, sf):
    return profile.box_stats(analysed(spark, sf), "growth_pct", ("grade",))[0]


def boxplot_outliers(spark, sf):
    return profile.box_stats(analysed(spark, sf), "growth_pct", ("grade",))[1]


def boxplot_stats_clipped(spark, sf):
    return profile.box_stats(analysed(spark, sf), "growth_pct", ("grade",), (-100.0, 100.0))[0]


def distribution_by_year(spark, sf):
    return profile.box_stats(sparse(spark, sf, years=None), "value", ("year",))[0]


def top_n_ties(spark, sf):
    return ordering.top_with_ties(measured(spark, sf), "growth_pct", 10).select("plot", "species", "growth_pct")


def sample_n(spark, sf):
    rows = measured(spark, sf).select("plot", "species", "growth_pct")
    return ordering.sample_rows(rows, 500, ("plot", "species"), seed=1)


def quantiles(spark, sf):
    return ordering.exact_quantiles(
        measured(spark, sf), "growth_pct", {"q025": 0.025, "q975": 0.975}, ("stand_type",)
    )


def mid_ranks(spark, sf):
    rows = measured(spark, sf).select("plot", "species", "stand_type", "growth_pct")
    return ordering.with_mid_rank(rows, "growth_pct", ("stand_type",))


# --- statistics ------------------------------------------------------------------------------------


def spearman_by_group(spark, sf):
    return analyses.grade_association(growths(spark, sf), src.belts(spark, sf), ("belt", "stand_type"))


def spearman_by_species(spark, sf):
    return analyses.grade_association(growths(spark, sf), None, ("species", "stand_type"))


def grade_means(spark, sf):
    return profile.grade_means(growths(spark, sf), "growth_pct", "grade", GRADES, ("stand_type",))


def ols_categorical(spark, sf):
    return linear.ols_factor(growths(spark, sf), "share_shift", "grade")


def ols_log(spark, sf):
    return linear.ols_factor_log(growths(spark, sf), "growth_pct", "grade")


def ols_log_subset(spark, sf):
    """Only the first and the last grade."""
    rows = growths(spark, sf)
    return linear.ols_factor_log(rows.where(F.col("grade").isin(GRADES[0], GRADES[-1])), "growth_pct", "grade")


def ols_offset(spark, sf):
    return linear.ols_factor_offset(growths(spark, sf), "fin", "ini", "grade")


def ols_pair(spark, sf):
    return linear.ols_line(_both_models(spark, sf), "value_m", "value_p")


def anova_oneway(spark, sf):
    return linear.anova(growths(spark, sf), "growth_pct", "grade")


def tukey_pairs(spark, sf):
    return linear.tukey(growths(spark, sf), "growth_pct", "grade", GRADES).select(
        "level_a", "level_b", "diff", "q", "df"
    )


def tukey_intervals(spark, sf):
    return linear.tukey(growths(spark, sf), "growth_pct", "grade", GRADES)


def kruskal(spark, sf):
    return rank_tests.kruskal(growths(spark, sf), "growth_pct", "grade", GRADES)


def dunn_bh(spark, sf):
    return rank_tests.dunn(growths(spark, sf), "growth_pct", "grade", GRADES)


def wilcoxon_pairs(spark, sf):
    return rank_tests.wilcoxon(growths(spark, sf), "growth_pct", "grade", GRADES)


def jarque_bera(spark, sf):
    return linear.jarque_bera(measured(spark, sf), "share_shift")


def ks_normality(spark, sf):
    return linear.ks_normality(measured(spark, sf), "share_shift")


def lm_diagnostics(spark, sf):
    return linear.factor_diagnostics(growths(spark, sf), "growth_pct", "grade", ("plot", "species"))


def lm_pair_diagnostics(spark, sf):
    pairs = _both_models(spark, sf)
    return linear.line_diagnostics(pairs, "value_m", "value_p", ("plot", "species_latin"))


def _replicates(spark, sf):
    return bootstrap.bootstrap_diff(
        growths(spark, sf),
        "species",
        "stand_type",
        "growth_pct",
        "grade",
        GRADES,
        n_iter=BOOT_ITER,
        seed=BOOT_SEED,
    )


def bootstrap_rho_diff(spark, sf):
    return _replicates(spark, sf)


def bootstrap_ci(spark, sf):
    return bootstrap.bootstrap_summary(_replicates(spark, sf), "species")


# --- maps and charts -------------------------------------------------------------------------------


def bbox_crop(spark, sf):
    return spatial.in_box(src.sites(spark, sf)).select("plot", "lon", "lat")


def unlocated_sites(spark, sf):
    return spatial.unlocated_count(src.sites(spark, sf))


def point_in_polygon(spark, sf):
    inside = spatial.within_rings(spatial.in_box(src.sites(spark, sf)), src.polygon(spark))
    return inside.select("plot", "lon", "lat")


def _inside(spark, sf, rows: DataFrame) -> DataFrame:
    """The rows of plots inside the outline: one test per plot, not per row."""
    return rows.join(spatial.within_rings(src.sites(spark, sf), src.polygon(spark)).select("plot"), "plot", "left_semi")


def clipped_growth(spark, sf):
    """Indicators of the plots inside the outline."""
    return _inside(spark, sf, measured(spark, sf)).select("plot", "species", "growth_pct")


def ols_pair_subset(spark, sf):
    """One model against the other for listed species inside the outline: clip, keep the species, pair by key, fit."""
    m, p = (
        _inside(spark, sf, reshape.restrict(measured(spark, sf, model), species=listed))
        for model, listed in ((MODEL_M, LISTED_M), (MODEL_P, LISTED_P))
    )
    return linear.ols_line(enrich.pair_models(m, p, on=("plot", "species")), "value_m", "value_p")


def _layer(name):
    def query(spark, sf):
        return charts.map_layer(mapped(spark, sf), name)

    return query


def map_value(spark, sf):
    return charts.value_layer(sparse(spark, sf, years=(END,)), src.sites(spark, sf), SCENARIO, END)


def map_agreement(spark, sf):
    rows = enrich.attach_site(analysed(spark, sf), src.sites(spark, sf), ["lon", "lat"])
    return analyses.agreement_layer(rows)


def series_table(spark, sf):
    panel = sparse(spark, sf, years=None)
    return panel.select("plot", "species", "year", "value").orderBy("plot", "species", "year")


def series_for_species(spark, sf):
    return charts.series(sparse(spark, sf, years=None), SCENARIO, PLOTS, SPECIES)


def distribution_for_species(spark, sf):
    return charts.distribution_by_year(sparse(spark, sf, years=None), SPECIES[1])[0]


def dominant_species(spark, sf):
    pairs = reshape.two_dates(sparse(spark, sf), START, END, missing="zero")
    return change.dominant_species(pairs, ("plot",), DOMINANCE)


def empty_column(spark, sf):
    rows = schema.with_empty(measured(spark, sf), "fertility")
    return rows.select("plot", "species", "growth_pct", "fertility")


def category_cast(spark, sf):
    rows = schema.as_category(analysed(spark, sf), "grade", "plot")
    return rows.groupBy("grade").agg(F.count("*").alias("n"), F.min("plot").alias("first_plot"))


def ordered_bars(spark, sf):
    totals = profile.group_totals(sparse(spark, sf, years=None), "species")
    return charts.ordered_bars(totals, "species", "total")


def correlation_bars(spark, sf):
    found = analyses.grade_association(growths(spark, sf), src.belts(spark, sf), ("belt", "stand_type"))
    return charts.correlation_bars(found, "stand_type", ("belt",)).select(
        "belt", "stand_type", "rho", "label", "colour", "sort_key"
    )


def picked_bars(spark, sf):
    """Bars at stated positions of the table of species and stand types, as one chart of the analyses does."""
    found = analyses.grade_association(growths(spark, sf), None, ("species", "stand_type"))
    return charts.pick_bars(found, ["species", "stand_type"], [9, 10, 19, 20]).select("species", "stand_type", "rho")


def view_window(spark, sf):
    return spatial.in_box(src.sites(spark, sf), spatial.VIEW).select("plot", "lon", "lat")


# --- sources and sinks -----------------------------------------------------------------------------


def _scratch(spark, name):
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def delimited_source(spark, sf):
    """The panel written as tab-separated files in two orders of columns under the names of the source files, read by name."""
    path = _scratch(spark, "delimited")
    names = {new: old for old, new in schema.NAMES_P.items()}
    rows = sparse(spark, sf, years=None)
    for part, columns in ((rows.where("plot % 2 = 0"), rows.columns), (rows.where("plot % 2 <> 0"), rows.columns[::-1])):
        renamed = part.select(*columns).withColumnsRenamed(names)
        renamed.write.mode("append").option("sep", "\t").option("header", True).csv(path)
    return tables.read_delimited(spark, path, schema.PANEL_P, schema.NAMES_P)


def site_source(spark, sf):
    """The site table written as delimited text under the names of its source, and read by name."""
    path = _scratch(spark, "site")
    names = {new: old for old, new in schema.NAMES_SITE.items()}
    src.sites(spark, sf).withColumnsRenamed(names).write.option("header", True).csv(path)
    return tables.read_site(spark, path)


def region_source(spark, sf):
    """Plots inside one region of a stored polygon table."""
    path = _scratch(spark, "regions")
    other = src.polygon(spark).withColumns({"region": F.lit("elsewhere"), "lon": F.col("lon") + 100})
    src.polygon(spark).unionByName(other).write.parquet(path)
    return spatial.within_rings(src.sites(spark, sf), tables.read_region(spark, path, "area")).select("plot", "lon", "lat")


def stored_result(spark, sf):
    """Indicators written by scenario and read back with the scenario as a partition filter."""
    path = _scratch(spark, "result")
    both = measured(spark, sf).unionByName(measured(spark, sf, MODEL_M))
    tables.write_table(both, path, ("scenario",))
    stored = reshape.restrict(tables.read_table(spark, path), SCENARIO)
    return stored.select("plot", "species", "growth_pct", "share_shift", "stand_type")


def scenario_results(spark, sf):
    """Results of two scenarios written one after the other, the first then again with fewer rows; both are read back."""
    path = _scratch(spark, "scenarios")
    for scenario, least in ((SCENARIO, 0), (MODEL_M, 0), (SCENARIO, 1)):
        tables.write_table(measured(spark, sf, scenario).where(F.col("ini") >= least), path, ("scenario",))
    return tables.read_table(spark, path).select("scenario", "plot", "species", "ini", "growth_pct")


def _headed(head):
    """Puts a header line before the lines of every task, hence of every file that they are written to."""

    def lines(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"value": [head]})
        yield from batches

    return lines


def delimited_rejects(spark, sf):
    """Tab-separated files with decimal commas, a missing field and a year that is none: rows read, and rows left by reason."""
    path = _scratch(spark, "rejects")
    rows = sparse(spark, sf, years=None).select("plot", "species", "year", "value").withColumn("value", F.round("value", 2).cast("string"))
    comma = F.when(F.col("plot") % 7 == 0, F.concat(F.floor(F.col("value").cast("double")).cast("string"), F.lit(",5"))).otherwise(F.col("value"))
    year = F.when(F.col("plot") % 11 == 3, F.concat("year", F.lit("a"))).otherwise(F.col("year").cast("string"))
    fields = F.concat_ws("\t", F.col("plot").cast("string"), "species", year, comma)
    lines = rows.select(F.when(F.col("plot") % 13 == 5, F.concat("species", F.lit("\t"), year)).otherwise(fields).alias("value"))
    lines.mapInArrow(_headed("IDP\tspeciesName\tYear\tbasalAreaSum"), "value string").write.text(path)
    good, rejected = tables.read_with_rejects(spark, path, schema.PANEL_P, schema.NAMES_P)
    kinds = rejected.withColumn("outcome", F.regexp_replace("reason", ":.*", ""))
    totals = good.groupBy("year").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return totals.select(F.lit("read").alias("outcome"), "year", "n", "total").unionByName(
        kinds.groupBy("outcome").agg(F.count("*").alias("n")), allowMissingColumns=True
    )


def table_profile(spark, sf):
    """Every numeric column of the indicators at once."""
    return profile.table_profile(measured(spark, sf), ["ini", "fin", "evol", "growth_pct", "share_shift", "max_share"])


def inspected(spark, sf):
    """The first six rows of the indicators by plot and species."""
    return tables.inspect(measured(spark, sf).select("plot", "species", "ini", "fin"), 6, ("plot", "species"))


def regions_of_sites(spark, sf):
    """Every region of a table of overlapping regions, one with a hole, that each site lies in."""
    return spatial.regions_of(src.sites(spark, sf), src.regions(spark)).select("plot", "region")


def minimum_presence(spark, sf):
    """Growth of species that start with more than one unit."""
    return measured(spark, sf).where(F.col("ini") > 1).select("plot", "species", "ini", "growth_pct")


QUERIES = {
    q.__name__: q
    for q in (
        two_date_indicators, two_date_indicators_sparse, smoothed_indicators, smoothed_indicators_sparse,
        grade_lookup, grade_left_join, stand_type, analysis_table, analysis_table_smoothed,
        drop_all_zero_groups, densify_panel, share_composition, share_ratio_diff, trailing_ratio,
        trailing_ratio_all_dates, evolution_from_shares, evolution_from_growth, change_metrics,
        loss_appear_classes, presence_absence, presence_likelihood, agreement_flag, contingency,
        contingency_shares, species_totals, site_left_join, null_safe_totals_join, species_wide,
        species_long, belt_lookup, cross_model_pairs, cross_model_means, stacked_models, distinct_species, level_codes, complete_rows,
        numeric_profile, numeric_profile_growth, large_totals, category_frequency, agreement_frequency,
        boxplot_stats, boxplot_outliers, boxplot_stats_clipped, distribution_by_year, top_n_ties, sample_n,
        quantiles, mid_ranks, spearman_by_group, spearman_by_species, grade_means, ols_categorical, ols_log,
        ols_offset, ols_pair, anova_oneway, tukey_pairs, tukey_intervals, kruskal, dunn_bh, wilcoxon_pairs,
        jarque_bera, lm_diagnostics, lm_pair_diagnostics, bootstrap_rho_diff, bootstrap_ci, bbox_crop,
        unlocated_sites, point_in_polygon, clipped_growth, map_value, map_agreement, series_table,
        ordered_bars, correlation_bars, picked_bars, view_window, delimited_source, stored_result,
        minimum_presence, series_for_species, distribution_for_species, dominant_species, empty_column, category_cast,
        ols_log_subset, ols_pair_subset, ks_normality, site_source, region_source, scenario_results, delimited_rejects,
        table_profile, regions_of_sites, inspected,
    )
}
QUERIES |= {
    f"map_{name}": _layer(name) for name in ("change", "loss", "appearance", "presence", "likelihood")
}


def queries():
    def wrap(fn):
        return lambda spark, sf: rounded(fn(spark, sf))

    return {name: wrap(fn) for name, fn in QUERIES.items()}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Which species grew or shrank on each plot, and is the plot dominated by one of them?"""
    return rounded(
        analyses.analysis_table(
            sparse(spark, sf), START, END, site=src.sites(spark, sf), missing="zero", dominance=DOMINANCE
        )
    )
