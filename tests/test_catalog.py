"""Every query with an oracle against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from keepsake.plans import catalog
from tests.conftest import tables

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for n in NAMES:
        db.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{tables()}/{n}.parquet')")
    return db


def rows(df):
    cell = lambda v: "~" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(cell, r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_parity(spark, oracle, name):
    assert rows(catalog.queries()[name](spark, tables()).toPandas()) == rows(oracle.execute(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize(
    "vector",
    [
        [0.35247817635536194, 0.24562455713748932],  # 88.50000042 by the whole scale, 88.49999 by the rounded one
        [8519162.0, -1.0],  # the ninth digit of the scale is a tie in doubles
        [1.0, None, -0.5],
        [None, None],
        [0.0, None],
        [0.0, -0.0],
        [],
        None,
    ],
)
def test_quantize_parity(spark, tmp_path, vector):
    """Exact to the last digit of the scale."""
    spark.createDataFrame([(7, vector, 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = catalog.queries()["quantize_vectors"](spark, str(tmp_path))
    assert [tuple(r) for r in got.select("id", "scale", "q").collect()] == db.execute(catalog.oracle_sql()["quantize_vectors"]).fetchall()


def test_null_component_has_no_neighbours(spark, tmp_path):
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.25], 1), (2, [1.0, None], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {(int(r.id), int(r.neighbour)) for r in catalog.queries()["knn_neighbours"](spark, str(tmp_path)).collect()} == {(0, 1), (1, 0)}


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, tables()).count() >= 0


def test_plans(spark):
    """Filters and columns reach the scan; top-k and limited windows are planned as such."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    page = plan(catalog.QUERIES["scope_page"](spark, tables()))
    assert "PushedFilters: [IsNotNull(source)" in page or "EqualTo(source,src0)" in page
    assert "TakeOrderedAndProject" in page and "text" not in page.split("ReadSchema")[1].split("\n")[0]
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["audit_filter_page"](spark, tables()))
