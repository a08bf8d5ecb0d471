import duckdb

from tests.conftest import SF0001

TYPE_MAP = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
            "boolean": "BOOLEAN"}

# a fast subset compared against DuckDB at sf0.001 (the driver runs all of them at sf0.01)
FAST = ["clean_daily", "rolling_features", "forecast_all", "period_features", "kpis", "paused_types_30",
        "recommendations", "chrono_index", "label_encode_fit", "budget_scenarios", "pinball_loss"]


def test_contract():
    import __spark_entry__ as e
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_entry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert "revenue_p50" in df.columns


def test_oracles_small(spark):
    import __spark_entry__ as e
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    q, o = e.queries(), e.oracle_sql()

    def norm(v):
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    for name in FAST:
        sdf = q[name](spark, SF0001)
        cols = sorted(sdf.columns)
        srows = sorted((tuple(norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
        rel = con.sql(o[name])
        idx = [rel.columns.index(c) for c in cols]
        drows = sorted((tuple(norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
        assert srows == drows, name
        types = dict(zip(rel.columns, [str(t) for t in rel.types]))
        for c, t in sdf.dtypes:
            assert TYPE_MAP.get(t, t) == types[c], (name, c, t, types[c])
