"""Registered queries: hygiene of the registry, and a few of them against their SQL twins."""

import duckdb
import pytest

import __spark_entry__ as entry_points
import check

SF = "/root/testdata/sf0.001"
SAMPLE = ["canonical_list", "same_pairs", "upsert_apply", "limit_regular", "stop_policy", "day_union", "for_you_topk", "search_excerpt", "json_contract", "page_links", "board_checks", "board_units", "export_ics_folded", "search_best_text"]


def test_registry():
    queries, oracle = entry_points.queries(), entry_points.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 100


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry_points.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(check.norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    rel = con.execute(entry_points.oracle_sql()[name])
    order = sorted(range(len(rel.description)), key=lambda i: rel.description[i][0])
    assert [rel.description[i][0] for i in order] == cols
    assert got == sorted(tuple(check.norm(r[i]) for i in order) for r in rel.fetchall())


def test_plans_have_no_products(spark):
    for name in ("for_you_topk", "profile_notice_cross", "same_pairs", "source_facets", "search_match"):
        plan = entry_points.queries()[name](spark, SF)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
