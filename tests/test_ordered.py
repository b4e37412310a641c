import random

from pyspark.sql import functions as F

from waraq.operators.asof import asof
from waraq.operators.ordered import bucket_of, running


def test_running_equals_a_loop_whatever_the_buckets(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, None]), k, rng.choice([None, 1, 2, 5]), "clash") for k in rng.sample(range(4000), 700)]
    df = spark.createDataFrame(rows, "g int, k int, v int, total string")
    for size in (1, 7, 100_000):
        got = running(df, ["g"], bucket_of(F.col("k"), size), [F.col("k")], sums={"s": F.col("v")}, lasts={"l": F.col("v")}, least={"m": F.col("v")}, previous={"p": F.col("v")})
        state = {}
        want = {}
        for g, k, v, _ in sorted(rows, key=lambda r: r[1]):
            s, last, least = state.get(g, (0, None, None))
            before = last
            if v is not None:
                s, last, least = s + v, v, v if least is None else min(least, v)
            state[g] = s, last, least
            want[g, k] = (s, last, least, before)
        assert {(r.g, r.k): (r.s, r.l, r.m, r.p) for r in got.collect()} == want


def test_asof_equals_a_loop(spark):
    rng = random.Random(2)
    left = [(rng.choice([1, 2, 3]), k, rng.choice([None, *range(60)])) for k in range(300)]
    right = [(rng.choice([1, 2]), rng.choice([None, *range(0, 60, 3)]), rng.choice([None, *range(9)])) for _ in range(60)]
    a = spark.createDataFrame(left, "g int, id int, at int")
    b = spark.createDataFrame(right, "g int, key int, v int")
    for forward in (False, True):
        got = {r.id: r.out for r in asof(a, b, ["g"], "at", "key", "v", "out", forward, bucket=8).collect()}
        assert len(got) == 300
        for g, k, at in left:
            c = [(key, v) for h, key, v in right if h == g and key is not None and v is not None and at is not None and (key >= at if forward else key <= at)]
            assert got[k] == ((min(c) if forward else max(c))[1] if c else None)


def test_empty(spark):
    empty = spark.createDataFrame([], "g int, k int, v int")
    assert running(empty, ["g"], bucket_of(F.col("k")), [F.col("k")], sums={"s": F.col("v")}).collect() == []
    assert asof(empty, empty.withColumnRenamed("k", "key"), ["g"], "k", "key", "v", "out").collect() == []
