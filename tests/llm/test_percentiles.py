import math
import random
from collections import defaultdict

from voltmill.llm.percentiles import BITS, combine, percentiles, value_counts

SCHEMA = "net string, day string, value string, xs array<double>, ys array<double>"
P = {"p01": 10, "p50": 500, "p99": 990}
NAN, INF = float("nan"), float("inf")


def exact(values, permille):
    values = sorted(values)
    return values[max(1, -(-len(values) * permille // 1000)) - 1]


def check(rows, got):
    groups = defaultdict(list)
    for net, day, _, xs, ys in rows:
        for m, vs in (("x", xs), ("y", ys)):
            groups[net, day, m] += [v for v in vs or [] if v is not None and v == v]
    groups = {k: v for k, v in groups.items() if v}
    assert {(r.net, r.day, r.m) for r in got} == set(groups)
    for r in got:
        values = groups[r.net, r.day, r.m]
        assert r.n == len(values)
        for name, p in P.items():
            e = exact(values, p)
            assert r[name] == e or abs(r[name] - e) <= abs(e) * 2.0**-BITS, (name, r[name], e)


def rows(rnd):
    def values():
        kind = rnd.random()
        if kind < 0.1:
            return None
        if kind < 0.15:
            return []
        return [rnd.choice([None, NAN, 0.0, -0.0, INF, -INF, 1e300, -1e-310, 5.0, 5.0, rnd.gauss(0, 3), rnd.lognormvariate(0, 9)]) for _ in range(rnd.choice([1, 3, 40, 1500]))]

    return [(rnd.choice([None, "", "GND", "GND", "3V3"]), rnd.choice([None, "2024-01-01", "2024-01-02"]), "x", values(), values()) for _ in range(80)]


def test_error_bound_nulls_and_long_lists(spark):
    data = rows(random.Random(6))
    counts = value_counts(spark.createDataFrame(data, SCHEMA), ["net", "day"], {"x": "xs", "y": "ys"}, "m")
    check(data, percentiles(counts, ["net", "day", "m"], P).collect())


def test_kept_partials_combine(spark):
    data = rows(random.Random(7))
    parts = [value_counts(spark.createDataFrame(part, SCHEMA), ["net", "day"], {"x": "xs", "y": "ys"}, "m").select("net", "day", "m", "value", "n") for part in (data[:30], data[30:])]
    merged = combine(parts, ["net", "day", "m"])
    check(data, percentiles(merged, ["net", "day", "m"], P).collect())
    by_net = percentiles(combine(parts, ["net", "m"]), ["net", "m"], P).collect()
    assert sum(r.n for r in by_net) == sum(1 for d in data for vs in d[3:] for v in vs or [] if v is not None and not math.isnan(v))


def test_roll_up(spark):
    data = rows(random.Random(8))
    counts = value_counts(spark.createDataFrame(data, SCHEMA), ["net", "day"], {"x": "xs", "y": "ys"}, "m")
    got = percentiles(counts, ["net", "m"], P, roll_up=["day"]).collect()
    check(data, [r for r in got if r.level == "each"])
    whole = [r for r in got if r.level == "all"]
    assert all(r.day is None for r in whole)
    check([(net, None, v, xs, ys) for net, _, v, xs, ys in data], whole)


def test_empty(spark):
    counts = value_counts(spark.createDataFrame([], SCHEMA), ["net", "day"], {"x": "xs"})
    assert percentiles(counts, ["net", "day", "measure"], P).collect() == []
