from pyspark.sql import functions as F

from voltmill import tables
from voltmill.operators.graph import components, propagated
from voltmill.staging import Stage, shared_dir
from voltmill.tables import finite, known, layer_key, layer_keys, micros, once_per_key


def test_one_row_per_key(spark, tmp_path, monkeypatch):
    rows = [(i % 7 if i % 5 else None, f"v{i % 7}", [i % 7]) for i in range(40)] + [(k, f"v{k}", None) for k in range(100, 130)]
    spark.createDataFrame(rows, "k long, v string, __n array<int>").repartition(3).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    for bits in (1 << 26, 32_768, 8):  # with few bits, keys that occur once share those of repeated ones
        monkeypatch.setattr(tables, "SKETCH_BITS", bits)
        got = once_per_key(table, "k", "v").collect()
        assert sorted(r.k for r in got if r.k is not None) == [*range(7), *range(100, 130)]
        assert sum(r.k is None for r in got) == 8
        assert all(r.v == f"v{r.k}" for r in got if r.k is not None)


def test_names_and_numbers(spark):
    d = spark.createDataFrame([("", " Top ", [" A", "a", None, "", "B "], float("nan")), (None, "  ", None, float("inf")), ("N", None, [], 1.0)], "n string, l string, ls array<string>, x double")
    got = [tuple(r) for r in d.select(known("n"), layer_key("l"), layer_keys("ls"), finite("x")).collect()]
    assert got == [(None, "top", ["a", "b"], False), (None, None, None, False), ("N", None, [], True)]
    t = spark.sql("select timestamp_ntz'1970-01-01 00:00:01.5' a, timestamp'1970-01-01 00:00:02' b")
    assert tuple(t.select(micros("a"), micros("b")).first()) == (1_500_000, 2_000_000)


def test_stage_can_be_dropped(spark):
    stage = Stage(spark.range(3).withColumn("x", F.lit(None).cast("string")), "x")
    assert stage.df.count() == 3 and stage.path.startswith(shared_dir(spark))
    stage.drop()


def test_components_and_labels(spark):
    nodes = spark.createDataFrame([(i, label) for i, label in enumerate(["a", None, None, "b", "c", None, None, None])] + [(None, "x")], "node long, label string")
    edges = spark.createDataFrame([(1, 0), (1, 2), (3, 4), (4, 5), (None, 7), (7, 7), (1, 0)], "a long, b long")
    assert {r.node: r.component for r in components(nodes, edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7}
    assert {r.node: r.resolved for r in propagated(nodes, edges, "label").collect()} == {0: "a", 1: "a", 2: "a", 3: "b", 4: "c", 5: None, 6: None, 7: None}
    assert components(nodes.filter("false"), edges.filter("false")).count() == 0


def test_one_giant_component_is_split(spark):
    """Where the votes of components join, the rows of one that holds nearly all nodes are spread over several tasks."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20kb", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20kb", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.files.maxPartitionBytes": "20kb", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k, None) for k in settings}
    nodes = spark.range(0, 600_000, numPartitions=4).selectExpr("id as node", "cast(if(id = 7, 'a', null) as string) as label")
    edges = spark.range(1, 590_000).selectExpr("0L as a", "id as b")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        done = propagated(nodes, edges, "label")
        assert done.filter("resolved = 'a'").count() == 590_000
        done.collect()
        assert "skew=true" in done._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
