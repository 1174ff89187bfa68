import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
NAMES = ["daily_panel", "state_panel", "window_knn_var", "rolling_hs_forecasts", "regime_hs_forecasts", "fhs_ewma_forecasts", "state_knn_forecasts", "mutual_information", "skipped_forecasts", "coverage_tests", "paired_comparison", "paired_holm", "mahalanobis_forecasts", "random_knn_forecasts", "backtest_summary", "backtest_skips"]


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_those_of_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    rel, df = con.sql(entry.oracle_sql()[name]), entry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    tidy = lambda rows: sorted([tuple(round(v, 7) + 0.0 if isinstance(v, float) else v for v in r) for r in rows], key=repr)
    at = [rel.columns.index(c) for c in cols]
    assert tidy([[r[c] for c in cols] for r in df.collect()]) == tidy([[r[i] for i in at] for r in rel.fetchall()])
