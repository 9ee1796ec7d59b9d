"""Every registered query with SQL against DuckDB on the smallest tables; the others must run."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from borespark.plans import workload, workload_frames, workload_more, workload_sources, workload_traces  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
#: Their SQL joins every sample with its neighbours' gates; one of them is enough here.
SLOW = {"n01_similarity_expression"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(df):
    def value(x):
        if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
            return None
        return float(x) if isinstance(x, int | float | np.number) and not isinstance(x, bool | np.bool_) else str(x)

    return sorted(([value(x) for x in row] for row in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", [n for n in workload.QUERIES if n in workload.ORACLES and n not in SLOW])
def test_query_equals_sql(spark, duck, name):
    got, want = workload.QUERIES[name](spark, DATA).toPandas(), duck.execute(workload.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", [n for n in workload.QUERIES if n not in workload.ORACLES])
def test_query_runs(spark, name):
    assert workload.QUERIES[name](spark, DATA).count() > 0


def test_post_critical_reflectivity_at_every_interface(spark, duck):
    got = workload.QUERIES["v09_zoeppritz_post_critical"](spark, DATA).toPandas()
    want = duck.execute("SELECT a.l_orderkey, a.l_linenumber FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1").fetchall()
    assert sorted(got[got.angle == 70][["l_orderkey", "l_linenumber"]].itertuples(index=False, name=None)) == sorted(want)


def test_nearest_source_covers_the_lines_of_the_whole_table(spark, tmp_path):
    spark.range(180).selectExpr("id AS vec_id", "id div 61 AS label").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = workload.QUERIES["j10_nearest_source"](spark, str(tmp_path)).toPandas()
    assert len(got) == 8 * 25 and got.i.max() == 7  # the last label's first vector, 122, is on line 4


@pytest.fixture(scope="module")
def tied_tops(spark, tmp_path_factory):
    """Orders of which several have one top, one is there twice, and some lack a customer or a price."""
    path = str(tmp_path_factory.mktemp("tied"))
    rows = [(i, i % 5, float(100 + i // 15)) for i in range(600)] + [(7, 2, 100.0), (601, None, 101.0), (602, None, 120.0), (603, 1, None), (604, 1, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").repartition(7).write.parquet(path + "/orders.parquet")
    return path


@pytest.mark.parametrize("name", ["a05_interval_means", "j03_interval_join"])
def test_of_several_orders_at_one_top_the_last_holds_the_layer(spark, tied_tops, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tied_tops}/orders.parquet/*.parquet'")
    got, want = workload.QUERIES[name](spark, tied_tops).toPandas(), con.execute(workload.ORACLES[name]).fetchdf()
    assert len(want) > 100 and plain(got) == plain(want)


def test_refinement_of_an_incomplete_line_equals_sql(spark, tmp_path):
    """The last of 37 lines has six traces, a few others have gaps, and one place has two traces."""
    embeddings = spark.range(906).where("id % 41 <> 3").selectExpr("id AS vec_id", "transform(sequence(0, 63), t -> cast(sin(id * 64 + t) as float)) AS embedding")
    embeddings.union(spark.range(77, 78).selectExpr("id", "array_repeat(cast(0.25 as float), 64)")).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    con.register("got", workload.QUERIES["u01_refine_linear"](spark, str(tmp_path)).toPandas())
    con.execute(f"CREATE TABLE want AS {workload.ORACLES['u01_refine_linear']}")
    columns = "il, xl, t, x"
    for a, b in (("want", "got"), ("got", "want")):
        assert con.execute(f"SELECT COUNT(*) FROM (SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b})").fetchone()[0] == 0
    assert con.execute("SELECT COUNT(*) FROM want").fetchone()[0] > 200000
