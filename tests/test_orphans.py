import random

from voltmill.operators.orphans import contiguous_runs, orphans

REFS = "id long, board long, net string, at long, born string"
NETS = "board long, net string, born long, gone long, id string"


def brute(refs, nets):
    def alive(r):
        return any(r[1] is not None and r[2] is not None and r[3] is not None and n[0] == r[1] and n[1] == r[2] and n[2] is not None and n[2] <= r[3] and (n[3] is None or n[3] > r[3]) for n in nets)

    return sorted((r for r in refs if not alive(r)), key=str)


def check(spark, refs, nets, **more):
    refs_df = spark.createDataFrame(refs, REFS)
    nets_df = spark.createDataFrame(nets, NETS)
    out = orphans(refs_df, nets_df, ["board", "net"], "at", "born", "gone", **more)
    assert out.columns == refs_df.columns
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(refs, nets)


def data(seed, hot=False):
    rnd = random.Random(seed)
    board = lambda: 1 if hot and rnd.random() < 0.6 else rnd.choice([1, 2, 3, None])
    net = lambda: "GND" if hot and rnd.random() < 0.6 else rnd.choice(["A", "B", "", None])
    refs = [(i, board(), net(), rnd.choice([None, rnd.randrange(-50, 1000)]) if i % 9 == 0 else rnd.randrange(-50, 1000), "x") for i in range(600)]
    nets = [(board(), net(), rnd.choice([None, rnd.randrange(-60, 900)]), rnd.choice([None, rnd.randrange(0, 1000), rnd.randrange(0, 1000)]), "y") for _ in range(60)]
    return refs + refs[:20], nets + nets[:5]


def test_against_brute_force(spark):
    for width in (7, 100, 10**15):
        check(spark, *data(1), slice_width=width)


def test_hot_keys_are_salted(spark):
    check(spark, *data(2, hot=True), slice_width=500, hot_rows=20)


def test_empty_sides(spark):
    refs, nets = data(3)
    check(spark, refs, [])
    check(spark, [], nets)


def test_limits_are_half_open(spark):
    check(spark, [(1, 1, "A", 10, ""), (2, 1, "A", 20, ""), (3, 1, "A", 9, "")], [(1, "A", 10, 20, "")])


def test_runs_merge_touching_intervals(spark):
    rows = [("k", 1, 5), ("k", 5, 7), ("k", 6, 6), ("k", 9, None), ("k", 8, 2), ("k", None, 4), ("l", 1, 2)]
    runs = contiguous_runs(spark.createDataFrame(rows, "k string, s long, e long"), ["k"], "s", "e")
    assert sorted(map(tuple, runs.collect())) == [("k", 1, 7), ("k", 9, 2**63 - 1), ("l", 1, 2)]


def test_plain_integer_keys(spark):
    refs = spark.createDataFrame([(i,) for i in (1, 2, 5, 2**21, None)], "k long")
    parents = spark.createDataFrame([(1, 2), (2, 3), (2**21, 2**21 + 1)], "k long, k1 long")
    lost = orphans(refs, parents.toDF("p", "q"), [], "k", "p", "q", slice_width=2**20)
    assert sorted(str(r.k) for r in lost.collect()) == ["5", "None"]
