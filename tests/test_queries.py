"""Queries on the smallest tables against their SQL, and the driver's functions."""

import duckdb
import pytest

import __spark_entry__
from graphloom import queries

SF = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "embeddings")
#: One or two of each kind; all of them run at a larger size outside of the tests.
NAMES = """sq_05_iter_kmers sq_06_dbg_edges io_04_link_edges io_08_mean_sequence_depth io_12_load_job tp_01_degrees tp_05_component_tables tp_07_unitig_paths tp_12_shortest_distance tp_17_blackbox_vertices
rw_03_batch_split rw_06_batch_merge rw_13_vector_depth fl_03_estimate_flow fl_07_depth_from_flow dc_01_design dc_07_enumerated_pathsets dc_13_problems rs_06_deduplicate rs_08_validate_twins rs_13_segment_positions
st_02_degree_stats cl_05_metadata ap_02_focus_job ap_05_info_job""".split()


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(want.columns)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert sorted([plain(r[c]) for c in columns] for r in got.collect()) == sorted([plain(r[i]) for i in order] for r in want.fetchall())


def test_driver_functions(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = queries.QUERIES["tp_02_sibling_free_edges"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in plan and "props" not in plan
