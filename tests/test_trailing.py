import random

from pyspark.sql import functions as F

from tidemark.operators.trailing import running, trailing


def measures():
    return {
        "n": ("sum", F.lit(1).cast("long")),
        "lo": ("min", F.struct("v", "at")),
        "hi": ("max", F.col("v")),
    }


def _rows(seed, keys=3, n=400, span=5000):
    rng = random.Random(seed)
    # One key holds most rows, and instants repeat.
    return [(rng.choice(["hot"] * 4 + [f"k{i}" for i in range(keys)]), rng.randrange(-span, span), rng.randrange(50)) for _ in range(n)]


def _expect(rows, inside):
    values = [(v, t) for t, v in inside]
    return (len(values) or None, min(values) if values else None, max((v for v, _ in values), default=None))


def test_trailing_matches_brute_force(spark):
    for seed, width, shortest in ((1, 960, 1), (2, 97, 1), (3, 1, 1), (4, 64, 20), (7, 500, 3_600_000)):
        rows = _rows(seed)
        df = spark.createDataFrame(rows, "k string, at long, v long")
        got = {
            (r.k, r.at): (r.n, tuple(r.lo) if r.lo else None, r.hi, r.own_n)
            for r in trailing(df, ["k"], "at", width, measures(), shortest_chunk_ms=shortest).collect()
        }
        assert len(got) == len({(k, t) for k, t, _ in rows})
        for k, t in got:
            inside = [(t2, v) for k2, t2, v in rows if k2 == k and t - width < t2 < t]
            own = sum(1 for k2, t2, _ in rows if k2 == k and t2 == t)
            assert got[k, t] == (*_expect(rows, inside), own)


def test_trailing_at_given_instants(spark):
    rows, width = _rows(5), 640
    df = spark.createDataFrame(rows, "k string, at long, v long")
    asked = [("hot", t) for t in range(-5000, 5000, 137)] + [("nobody", 7)]
    probes = spark.createDataFrame(asked, "k string, at long")
    got = {(r.k, r.at): (r.n, tuple(r.lo) if r.lo else None, r.hi) for r in trailing(df, ["k"], "at", width, measures(), probes, 10).collect()}
    assert set(got) == set(asked)
    for k, t in asked:
        inside = [(t2, v) for k2, t2, v in rows if k2 == k and t - width < t2 < t]
        assert got[k, t] == _expect(rows, inside)


def test_running_matches_brute_force(spark):
    rows = _rows(6)
    df = spark.createDataFrame(rows, "k string, at long, v long")
    got = {(r.k, r.at): (r.n, tuple(r.lo) if r.lo else None, r.hi) for r in running(df, ["k"], "at", measures(), 250).collect()}
    assert len(got) == len({(k, t) for k, t, _ in rows})
    for k, t in got:
        inside = [(t2, v) for k2, t2, v in rows if k2 == k and t2 < t]
        assert got[k, t] == _expect(rows, inside)
