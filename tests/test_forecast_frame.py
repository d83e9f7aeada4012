"""The registered frame of the tree forecast: no test-year day is lost, and all four targets are fitted."""

import datetime as dt

import duckdb

import __spark_entry__ as E
from tools.oracle_check import rows_of
from wattframe.operators import boosting


def test_days_without_a_week_before_stay(spark, tmp_path, monkeypatch):
    d0 = dt.datetime(1999, 10, 1)
    days = [d0 + dt.timedelta(days=k) for k in range(150) if k % 5 and k % 11]
    rows = [(i, i % 3, t, float(i % 50), 100.0 + i % 17, (i % 11) / 100, (i % 9) / 100, "R" if i % 4 else "N")
            for i, t in enumerate(t for t in days for _ in range(2))]
    path = f"{tmp_path}/lineitem.parquet"
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_shipdate timestamp_ntz, l_quantity double, l_extendedprice double, "
                                "l_discount double, l_tax double, l_returnflag string").write.parquet(path)
    fits, fit = [], boosting.fit
    monkeypatch.setattr(boosting, "fit", lambda df, keys, cols, models, **how: fits.append(models) or fit(df, keys, cols, models, **how))
    rounds = {p["n_estimators"] for p in E._DAILY_BEST.values()}
    assert rounds == {E._ROUNDS}
    monkeypatch.setattr(E, "_DAILY_BEST", {t: dict(p, n_estimators=2) for t, p in E._DAILY_BEST.items()})

    out = E.queries()["forecast_trees_frame"](spark, str(tmp_path))
    got = out.collect()
    assert sorted(r["day"] for r in got) == [t for t in days if t.year == 2000]
    have = set(days)
    assert {r["day"] for r in got if r["price_published"] is None} == {t for t in days if t.year == 2000 and t - dt.timedelta(days=7) not in have}
    assert [[m.target for m in models] for models in fits] == [list(E._DAILY_TARGETS)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{path}/*.parquet')")
    cur = con.execute(E.oracle_sql()["forecast_trees_frame"])
    names = [c[0] for c in cur.description]
    assert rows_of(out.columns, [tuple(r) for r in got]) == rows_of(names, cur.fetchall())
