"""Results of tables in which there is nothing to find."""

import duckdb
import pytest

from barwright.operators import sentiment
from barwright.plans.catalogue import ORACLES, QUERIES

from test_queries import TABLES, canon


def test_weight_search_where_no_set_goes_against_the_next_bars(spark):
    """Scores and the next bars rise together in one symbol, and go against each other in the other."""
    names = ["symbol", "i", "fwd", "mom10", "mom", "mom30", "mom40", "pos", "vol", "volat"]
    rows = [(s, i, float(i * way), *[i / 100] * 7) for s, way in (("up", 1), ("down", -1)) for i in range(40)]
    found = sentiment.searched(spark.createDataFrame(rows, names), sets=40, a_task=16).collect()
    assert {(r.symbol, r.place) for r in found} == {("down", k) for k in range(1, 11)}
    assert all(len(r.weights) == 5 and abs(r.r_train + 1) < 1e-9 for r in found)
    assert sentiment.searched(spark.createDataFrame(rows, names).where("symbol = 'up'"), sets=40, a_task=16).collect() == []


@pytest.fixture(scope="module")
def flat(sf, tmp_path_factory):
    """The test tables with one discount on every line: closes stand still, so that there is no leg, run or target."""
    at = tmp_path_factory.mktemp("flat")
    for t in TABLES:
        columns = "* replace (0.05::double as l_discount, 0.02::double as l_tax)" if t == "lineitem" else "*"
        duckdb.sql(f"copy (select {columns} from '{sf}/{t}.parquet') to '{at}/{t}.parquet' (format parquet)")
    return str(at)


def same_as_sql(spark, at, name, rows):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{at}/{t}.parquet'")
    got, want = QUERIES[name](spark, at).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(want) == rows
    assert canon(got) == canon(want)


def test_lock_where_nothing_is_published(spark, flat):
    same_as_sql(spark, flat, "gate_probability_lock", 5)


def test_spoilt_lock_where_nothing_is_published(spark, flat):
    same_as_sql(spark, flat, "gate_probability_lock_spoilt", 5)


@pytest.mark.parametrize("name", ["subwave_errors", "subwave_ratios", "time_model_error", "production_brier", "brier_grouping_sets"])
def test_total_of_nothing(spark, flat, name):
    """Grouping sets over no rows: only the total has a row."""
    same_as_sql(spark, flat, name, 1)
