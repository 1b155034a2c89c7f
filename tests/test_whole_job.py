"""Registered queries that do their whole job: nothing left out of the records or of the search."""
import duckdb
import pytest

import __spark_entry__ as entry
from pricewise.schema import LISTING_COLUMNS


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Line items and parts of the driver's columns: every shape of reply on every line number."""
    folder = str(tmp_path_factory.mktemp("tables"))
    parts = [(p, f"red sofa {p}", f"Brand#{p % 3}", f"STEEL {p % 4}", p % 13, 90.0 + p) for p in range(8)]
    lines = [(10 * p + n, p, p + n, n, float(1 + n), 800.0 + 137.5 * p + n, 0.01 * n, 0.02, "RAN"[n % 3], "FO"[n % 2]) for p in range(8) for n in range(1, 8)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                 "l_discount double, l_tax double, l_returnflag string, l_linestatus string").write.parquet(f"{folder}/lineitem.parquet")
    return folder


def plain(rows, cols):
    return sorted((tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in cols) for r in rows), key=repr)


def test_routed_records_are_whole(spark, tables):
    """e18_route: each record has all fields of the listing, as the SQL has."""
    df = entry.queries()["e18_route"](spark, tables)
    assert set(LISTING_COLUMNS) <= set(df.columns)
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
    cur = con.execute(entry.oracle_sql()["e18_route"])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = df.collect()
    assert plain(got, df.columns) == plain([dict(zip(names, r)) for r in cur.fetchall()], df.columns)
    won = [r for r in got if r["success"]]
    assert len(got) == 56 and 0 < len(won) < 56
    assert all(any(r[c] is not None for r in won) for c in LISTING_COLUMNS if c != "colour_2")


@pytest.mark.parametrize("key", ["t2_baseline", "t3_search"])
def test_the_search_has_all_draws_and_rounds(spark, tables, monkeypatch, key):
    """t2_baseline, t3_search: 60 draws of 200 to 1,499 rounds on five folds, and a baseline of 100 rounds."""
    from pricewise.operators import booster as BO
    from pricewise.operators import train as TR
    asked, fitted = [], []
    monkeypatch.setattr(BO, "cross_validate", lambda df, bins, draws, n_folds: asked.append((draws, n_folds)) or [9.0 - i % 7 for i in range(len(draws))])
    monkeypatch.setattr(BO, "fit", lambda df, bins, params: fitted.append(params) or BO.Ensemble(bins, params, 0))
    rows = entry.queries()[key](spark, tables).collect()
    (draws, n_folds), = asked
    assert n_folds == 5 and draws[0] == BO.Params() and draws[0].max_iter == 100
    assert draws[1:] == [TR.to_params(d) for d in TR.sample_params(60, TR.SearchSpace())]
    assert all(200 <= d.max_iter < 1500 for d in draws[1:])
    assert fitted == [draws[6]] and len(rows) == {"t2_baseline": 1, "t3_search": 60}[key]
