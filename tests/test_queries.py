"""Every registered query against its SQL on the smallest test tables, and the plans that matter."""

import re

import pytest

from checks import compare, oracle, registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), oracle.statements()


@pytest.fixture(scope="module")
def con():
    return compare.open_tables(SF)


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert registry.BOOT_ITER == oracle.BOOT_ITER and registry.BOOT_SEED == oracle.BOOT_SEED


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    made = []

    def query(spark, sf):
        made.append(QUERIES[name](spark, sf))
        return made[0]

    result, _ = compare.compare(spark, con, SF, query, SQL[name])
    assert result.startswith("ok"), result
    ran = made[0]._jdf.queryExecution().executedPlan().toString()  # the plan as it ran
    assert "CartesianProduct" not in ran and "NestedLoop" not in ran


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.queries()) >= set(QUERIES) and set(entry.oracle_sql()) >= set(SQL)


@pytest.mark.parametrize("name,order", [("series_table", ("plot", "species", "year")), ("series_for_species", ("plot", "species", "year")), ("ordered_bars", ("sort_key",))])
def test_sorted_results_come_in_order(spark, name, order):
    rows = [tuple(r[c] for c in order) for r in QUERIES[name](spark, SF).collect()]
    assert rows == sorted(rows) and rows


def test_stored_tables_can_be_removed(spark):
    from paneldrift import session

    stored = session.stored(spark.range(3))
    assert stored.count() == 3
    folder = spark.newSession()
    session.clear_stored(folder)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|FileNotFound|FAILED_READ"):
        spark.read.parquet(stored.inputFiles()[0]).collect()


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", ["two_date_indicators", "smoothed_indicators", "change_metrics", "share_composition",
                                  "trailing_ratio_all_dates", "evolution_from_growth"])
def test_plot_operators_share_one_layout(spark, name):
    """One shuffle to add up cells, one to place plots; aggregates and windows add none."""
    text = plan(QUERIES[name](spark, SF))
    assert text.count("Exchange hashpartitioning") == 2, text
    assert "Python" not in text


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(QUERIES["two_date_indicators"](spark, SF))
    scan = next(line for line in text.splitlines() if "FileScan parquet" in line and "l_suppkey" in line)
    assert "EqualTo(l_returnflag,N)" in scan and "l_extendedprice" not in scan and "l_shipdate" in scan
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(l_shipdate", scan)


def test_graded_table_reads_the_rows_once(spark):
    """Panel and grades of one source share its scan and shuffles, and join where they lie."""
    text = plan(QUERIES["agreement_flag"](spark, SF))
    assert "ReusedExchange" in text and text.count("l_shipdate#") and text.count("FileScan parquet [l_partkey") == 1



def test_rejects_are_written_by_many_tasks(spread, tmp_path, monkeypatch):
    """No task holds all lines: every task writes a file of its own, with its header."""
    monkeypatch.setattr(registry, "_scratch", lambda spark, name: f"file://{tmp_path}/{name}")
    got = sorted(registry.delimited_rejects(spread, "/root/testdata/sf0.001").collect(), key=repr)
    texts = [p.read_text().splitlines() for p in (tmp_path / "rejects").glob("part-*")]
    assert len(texts) > 2 and all(t.count("IDP\tspeciesName\tYear\tbasalAreaSum") == 1 and t[0].startswith("IDP\t") for t in texts)
    lines = sum(map(len, texts)) - len(texts)
    assert max(map(len, texts)) < lines / 2 and sum(r["n"] for r in got) == lines
