import random

from pyspark.sql import functions as F

from voltmill.llm.components import _least_parent, component_ids, large_star, small_star, star_edges
from voltmill.staging import staged


def union_find(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def run(spark, pairs):
    rows = component_ids(spark.createDataFrame(pairs, "a long, b long, parent string", verifySchema=False), "a", "b").collect()
    assert len({r.record for r in rows}) == len(rows)
    return {r.record: r.component for r in rows}


def test_chain_star_and_hub(spark):
    pairs = [(i, i + 1, "x") for i in range(100, 160)] + [(5, i, None) for i in range(300, 400)] + [(400, 399, None), (2, 1, "")]
    assert run(spark, pairs) == union_find([p[:2] for p in pairs])


def test_random_with_nulls_ties_and_self_links(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randrange(400), rnd.randrange(400), "e") for _ in range(330)]
    pairs += pairs[:50] + [(7, 7, None), (None, 3, None), (3, None, None), (None, None, None)]
    expected = union_find([p[:2] for p in pairs if None not in p[:2] and p[0] != p[1]])
    assert run(spark, pairs) == expected


def test_no_pairs(spark):
    assert run(spark, []) == {}


def test_star_edges_link_what_all_pairs_would(spark):
    rnd = random.Random(5)
    members, expected = [], []
    for g in range(150):
        net = rnd.choice([None, "A", "B"])
        own = [(rnd.randrange(10), rnd.choice([None, "A", "B", "C"])) for _ in range(rnd.randrange(5))]
        own = list(dict(own).items())
        members += [(g, s + 100 * g, label, net) for s, label in own]
        for a, la in own:
            for b, lb in own:
                if a < b and len({x for x in (la, lb, net) if x}) <= 1:
                    expected.append((a + 100 * g, b + 100 * g))
    frame = spark.createDataFrame(members, "g long, shape long, label string, net string")
    edges = [(r.a, r.b) for r in star_edges(frame, ["g"], "shape", "label", "net").collect()]
    assert union_find(edges) == union_find(expected)
    assert len(edges) <= len(members)


def test_hubs_are_split(spark):
    """The final plans of both steps have skew joins for a hub on either side."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20kb", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20kb", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rest = spark.range(1_000_000, 1_000_400).select((F.col("id") + 1000).alias("child"), F.col("id").alias("parent"))
        hub = spark.range(10, 60_000, numPartitions=4).select(F.col("id").alias("child"), F.lit(5).cast("long").alias("parent"))
        fan = spark.range(10, 60_000, numPartitions=4).select(F.lit(900_000).cast("long").alias("child"), F.col("id").alias("parent"))
        for step, edges in ((large_star, hub.unionByName(spark.sql("select 5L child, 1L parent"))), (small_star, fan)):
            edges = staged(edges.unionByName(rest), "edges")
            done = step(edges, staged(_least_parent(edges), "least"))
            done.write.format("noop").mode("overwrite").save()
            done.collect()
            assert "skew=true" in done._jdf.queryExecution().executedPlan().toString(), step.__name__
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
