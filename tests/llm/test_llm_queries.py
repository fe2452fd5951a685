"""The queries of the llm problems with SQL, and the others for their shape, on the smallest data."""

import glob
import os

import pytest

from voltmill.llm.queries import CAPACITY, ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view \"{os.path.basename(path)[:-8]}\" as select * from '{path}'")
    found = QUERIES[name](spark, FOLDER)
    order = sorted(found.columns)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == order
    at = [names.index(c) for c in order]
    assert sorted(map(str, (tuple(r) for r in found.select(*order).collect()))) == sorted(map(str, (tuple(r[i] for i in at) for r in result.fetchall())))


def test_containers_hold_every_token(spark):
    ids = {r.doc_id: len(r.ids) for r in QUERIES["p6_ids"](spark, FOLDER).collect()}
    fill, have = {}, dict.fromkeys(ids, 0)
    for r in QUERIES["p7_containers"](spark, FOLDER).collect():
        have[r.doc_id] += r.piece_size
        if r.container_id is not None:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.piece_size
    assert have == ids and max(fill.values()) <= CAPACITY
    assert len(fill) <= sum(ids.values()) / CAPACITY * 1.03 + 1
