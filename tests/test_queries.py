"""Every query with SQL against DuckDB on the smallest data."""

import glob
import os

import pytest

from voltmill.plans import analysis_queries, board_queries, copper_queries, inventory_queries, inventory_sql, mesh_queries, network_queries, source_queries

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")
MODULES = (analysis_queries, board_queries, copper_queries, inventory_queries, mesh_queries, network_queries, source_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = inventory_sql.ORACLES | {name: sql for module in MODULES for name, sql in getattr(module, "ORACLES", {}).items()}


def connect():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view \"{os.path.basename(path)[:-8]}\" as select * from '{path}'")
    return con


def tidy(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    number = lambda v: f"{v:.5g}" if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(number(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    found = QUERIES[name](spark, FOLDER)
    got = tidy([tuple(r) for r in found.collect()], found.columns)
    result = connect().execute(SQL[name])
    assert got == tidy(result.fetchall(), [d[0] for d in result.description])


def test_merged_pours(spark):
    whole = {(r.board_id, r.net, r.layer): r for r in QUERIES["merged_pours"](spark, FOLDER).collect()}
    single = {r.pour_id: r for r in QUERIES["pour_geometry"](spark, FOLDER).collect()}
    assert whole and sum(r.area for r in whole.values()) <= sum(r.area for r in single.values()) * (1 + 1e-6)
    assert all(r.area > 0 and r.polygons >= 1 for r in whole.values())
    assert all(0.05 <= r.width <= 10 for r in QUERIES["pour_widths"](spark, FOLDER).collect())
