import json

from voltmill.streaming.ingest import append_once, arrivals, arrivals_per_day, first_deliveries, shred_stream

SCHEMA = "solution_id long, payload string, loaded_at timestamp"


def test_each_delivery_once(spark, tmp_path):
    body = json.dumps({"layer_solutions": [{"layer_name": "L", "meshes": [{"triangles": [[0, 1, 2], None, [2, 1, 3]]}]}]})
    for n, rows in enumerate(([(1, body, "2024-01-01"), (2, None, "2024-01-02")], [(1, body, "2024-01-05"), (3, "{broken", "2024-01-03")])):
        spark.createDataFrame(rows, "solution_id long, payload string, t string").selectExpr("solution_id", "payload", "timestamp(t) as loaded_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = first_deliveries(arrivals(spark, str(tmp_path / "in"), SCHEMA, 1), "solution_id", "loaded_at")
    query = shred_stream(stream, "solution_id", "payload", str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out" / "triangle"))
    assert sorted((r.solution_id, r.triangle_no, r.v2) for r in out.collect()) == [(1, 0, 2), (1, 2, 3)]


def test_days(spark, tmp_path):
    spark.sql("select * from values (1, timestamp'2024-01-01 05:00:00'), (2, timestamp'2024-01-01 07:00:00'), (3, timestamp'2024-01-02 01:00:00') as t(solution_id, loaded_at)").selectExpr("cast(solution_id as long) solution_id", "cast(null as string) payload", "loaded_at").write.parquet(str(tmp_path / "in"))
    query = arrivals_per_day(arrivals(spark, str(tmp_path / "in"), SCHEMA), "loaded_at").writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.rows for r in spark.table("days").collect()) == [1, 2]


def test_late_first_deliveries_are_kept(spark, tmp_path):
    """A backfill in reverse order: rows far behind all seen before, repeats among them, null keys."""
    for rows in ([(1, "a", "2024-06-01"), (2, "b", "2024-06-02"), (None, "n", "2024-06-01")], [(1, "a", "2023-01-01"), (3, "c", "2020-01-01")], [(3, "c", "2024-01-01"), (4, "d", "2019-01-01"), (None, "n", "2018-01-01")]):
        spark.createDataFrame(rows, "solution_id long, payload string, t string").selectExpr("solution_id", "payload", "timestamp(t) as loaded_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    append_once(arrivals(spark, str(tmp_path / "in"), SCHEMA, 1), "solution_id", out, str(tmp_path / "state")).awaitTermination(120)
    assert sorted((r.solution_id or 0, r.payload) for r in spark.read.parquet(out).collect()) == [(0, "n"), (0, "n"), (1, "a"), (2, "b"), (3, "c"), (4, "d")]
