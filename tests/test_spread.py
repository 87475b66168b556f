"""The spread way must give what the plain way gives, on groups with ties and a hot key."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoretide.operators import spread as sp


@pytest.fixture(scope="module")
def hot(spark):
    """One key with a third of all rows, many ties, NULL keys."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else ("k%d" % (i % 40) if i % 7 else None)
        rows.append((key, float(rng.integers(0, 60)), i))
    return spark.createDataFrame(rows, "k string, v double, i long").cache()


def as_set(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_positions(hot):
    plain = hot.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("v", "i")).cast("long"))
    assert as_set(sp.group_positions(hot, ["k"], ["v", "i"], hot=True)) == as_set(plain)
    assert as_set(sp.group_positions(hot, ["k"], ["v", "i"], hot=False)) == as_set(plain)


def test_dense_index(hot):
    got = sp.group_positions(hot.select("i"), [], ["i"], "n")
    assert all(r.n == r.i + 1 for r in got.collect())


def test_running_total_and_ranks(hot):
    w = hot.groupBy("k", "v").agg(F.count("*").alias("w"))
    for fn in (sp.running_total, sp.average_ranks):
        assert as_set(fn(w, ["k"], "v", "w", "o", True)) == as_set(fn(w, ["k"], "v", "w", "o", False))
    one = hot.filter("k = 'hot'")
    mean_rank = sp.average_ranks(one.withColumn("w", F.lit(1)), ["k"], "v", "w", "o", True).agg(F.avg("o")).first()[0]
    assert mean_rank == (one.count() + 1) / 2


def test_quantiles(hot):
    probs = [0.0, 0.05, 0.33, 0.5, 0.9, 1.0]
    a = {r.k: r.q for r in sp.grouped_quantiles(hot, ["k"], "v", probs, hot=True).collect()}
    b = {r.k: r.q for r in sp.grouped_quantiles(hot, ["k"], "v", probs, hot=False).collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_quantile_values(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 4, 8, 16)], "k string, v double")
    for hot in (True, False):
        assert np.allclose(sp.grouped_quantiles(df, ["k"], "v", [0.05, 0.9], hot=hot).first().q, [1.2, 12.8])


def test_blocked_lag(hot):
    want = hot.withColumn("prev", F.lag("v").over(Window.partitionBy("k").orderBy("i")))
    known = want.filter(F.col("k").isNotNull())
    got = sp.blocked_lag(hot.filter(F.col("k").isNotNull()), ["k"], "i", "v", width=37)
    assert as_set(got) == as_set(known)


def test_is_hot(hot):
    assert sp.is_hot(hot, ["k"], 900) and not sp.is_hot(hot, ["k"], 2000)


def test_plans_keep_big_tables_out_of_one_task(hot):
    plan = sp.group_positions(hot, [], ["i"], "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan.lower()


@pytest.mark.parametrize("parts", ["1", "7"])
def test_nested_index(spark, parts):
    rng = np.random.default_rng(4)
    rows = sorted({(None if k == 3 else f"k{k:02d}", int(p)) for k, p in zip(rng.integers(0, 12, 300), rng.integers(0, 40, 300))}, key=lambda r: (r[0] or "", r[1]))
    df = spark.createDataFrame(rows[::-1], "key string, period int").repartition(3)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted((r.row, r.key, r.period, r.no) for r in sp.nested_index(df, "key", ["period"], "row", "no").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    names = list(dict.fromkeys(k for k, _ in rows))
    assert got == [(i, k, p, names.index(k) + 1) for i, (k, p) in enumerate(rows, 1)]
    assert sp.nested_index(df.limit(0), "key", ["period"], "row", "no").count() == 0
