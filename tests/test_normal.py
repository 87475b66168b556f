"""Normal functions against the standard library."""

import math
from statistics import NormalDist

from scoretide.functions import normal as nm

XS = [-36.0, -20.0, -8.0, -7.08, -7.07, -3.0, -1.0, -0.1, 0.0, 0.3, 1.0, 1.5, 4.0, 7.5, 12.0]


def log_cdf(x):
    if x > -30:
        return math.log(math.erfc(-x / math.sqrt(2)) / 2)
    return -x * x / 2 - math.log(-x * math.sqrt(2 * math.pi)) + math.log1p(-1 / x**2 + 3 / x**4 - 15 / x**6)


def test_cdf_log_cdf_and_mills(spark):
    df = spark.createDataFrame([(x,) for x in XS], "x double")
    rows = df.select("x", nm.normal_cdf("x").alias("c"), nm.normal_log_cdf("x").alias("l"), nm.inverse_mills("x").alias("m"))
    for r in rows.collect():
        want = math.erfc(-r.x / math.sqrt(2)) / 2
        assert math.isclose(r.c, want, rel_tol=2e-8)
        assert math.isclose(r.l, log_cdf(r.x), rel_tol=2e-8, abs_tol=1e-15)
        assert math.isclose(r.m, math.exp(-r.x * r.x / 2 - 0.5 * math.log(2 * math.pi) - log_cdf(r.x)), rel_tol=1e-7)


def test_quantile(spark):
    ps = [1e-12, 1e-4, 0.02, 0.1, 0.5, 0.8, 0.99, 1 - 1e-7]
    for r in spark.createDataFrame([(p,) for p in ps], "p double").select("p", nm.normal_quantile("p").alias("q")).collect():
        assert math.isclose(r.q, NormalDist().inv_cdf(r.p), rel_tol=2e-9, abs_tol=1e-9)
