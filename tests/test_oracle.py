"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import pytest

from factflow.queries import QUERIES, SQL

SF = os.environ.get("FACTFLOW_TEST_TABLES", "/root/testdata/sf0.001")
SOME = ["match_a", "project_bag", "filter_cross_type", "transform_truncate_week", "join_collection_attribute", "join_star_collapsed", "difference_negate",
        "antijoin", "agg_median", "agg_variance", "agg_with_set_mode", "hector_chain", "hector_triangle", "hector_predicate_inverted", "hector_not",
        "recursive_mutual", "pull_nested", "graphql_nested_args", "derive_attribute", "lww_diffs", "epoch_diff_incremental", "tagged_lane", "segment_revenue",
        "agg_global", "filter_eid_number", "filter_eid_eid", "filter_instant_eid", "recursive_hierarchy", "lww_retraction", "lww_compacted", "distinct_compacted",
        "csv_source", "json_source", "subscribe_file_sink", "interest_granularity"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
