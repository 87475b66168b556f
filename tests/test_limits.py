"""No input is cut, dropped or misread in silence."""

import math

import pytest
from pyspark.sql import functions as F

from scoretide.operators import convergence as conv
from scoretide.operators import model, panel, posterior, spread
from scoretide.sources import chains as cf

DRAWS = "param string, idx long, chain int, iteration long, value double"


def values(rows):
    return sorted(tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows)


def test_hot_and_plain_summaries_agree_on_odd_groups(spark):
    rows = [("theta", 1, 1, k, float(k % 3)) for k in range(1, 9)]
    rows += [("theta", 2, 1, k, None) for k in range(1, 5)] + [("theta", 3, 1, 1, 5.0), ("theta", 3, 1, 2, None)]
    df = spark.createDataFrame(rows, DRAWS)
    plain, hot = (posterior.posterior_summary(df, hot_rows=h).orderBy("idx").collect() for h in (1000, 1))
    assert plain == hot and [r.idx for r in plain] == [1, 2, 3] and plain[1]["mean"] is None and plain[1]["pct50"] is None


def test_rhat_keeps_parameters_without_values(spark):
    rows = [("theta", i, c, k, None if i == 2 else float((k * 7 + c) % 5)) for i in (1, 2) for c in (1, 2) for k in range(1, 9)]
    df = spark.createDataFrame(rows, DRAWS)
    assert {r.idx for r in conv.convergence(df).collect()} == {r.idx for r in conv.convergence(df, hot_rows=1).collect()} == {1, 2}


def test_ragged_and_gapped_chains_are_refused(spark):
    even = [("theta", 1, c, k, float(k)) for c in (1, 2) for k in range(1, 9)]
    ragged = spark.createDataFrame(even + [("theta", 1, 1, 9, 9.0)], DRAWS)
    with pytest.raises(ValueError, match="different lengths"):
        conv.rhat(ragged)
    cut, equal = conv.convergence(ragged, ragged="cut").first(), conv.convergence(spark.createDataFrame(even, DRAWS)).first()
    assert (cut.rhat, cut.ess_bulk, cut.n_used, cut.n_dropped) == (equal.rhat, equal.ess_bulk, 16, 1) and "n_used" not in equal
    assert conv.rhat(ragged, ragged="cut").first().n_dropped == conv.ess(ragged, ragged="cut").first().n_dropped == 1
    with pytest.raises(ValueError, match="without gaps"):
        conv.ess(spark.createDataFrame([r for r in even if r[3] != 4], DRAWS))


def chain(tmp_path, name, text):
    (tmp_path / name).write_text(text)


def test_chain_files_are_read_by_their_own_header(spark, tmp_path):
    chain(tmp_path, "c-1.csv", "# s\nlp__,theta.1,theta.2\n1,2,3\n# x\n4,5,6\n")
    chain(tmp_path, "c-2.csv", "# s\ntheta.2,lp__,theta.1\n30,10,20\nNA,nan,\n")
    got = values(cf.read_chains(spark, str(tmp_path / "*.csv")).select("chain", "iteration", "param", "idx", F.coalesce(F.nanvl("value", F.lit(-2.0)), F.lit(-1.0)).alias("v")).collect())
    assert got == [(1, 1, "lp__", 0, 1.0), (1, 1, "theta", 1, 2.0), (1, 1, "theta", 2, 3.0), (1, 2, "lp__", 0, 4.0), (1, 2, "theta", 1, 5.0), (1, 2, "theta", 2, 6.0),
                   (2, 1, "lp__", 0, 10.0), (2, 1, "theta", 1, 20.0), (2, 1, "theta", 2, 30.0), (2, 2, "lp__", 0, -2.0), (2, 2, "theta", 1, -1.0), (2, 2, "theta", 2, -1.0)]


@pytest.mark.parametrize("text, message", [("a,b\n1\n", "wrong number of fields"), ("a,b\n1,x\n", "no number"), ("1,2\n3,4\n", "no header")])
def test_broken_chain_files_are_errors(spark, tmp_path, text, message):
    chain(tmp_path, "c-1.csv", text)
    with pytest.raises(Exception, match=message):
        cf.read_chains(spark, str(tmp_path / "*.csv")).collect()


def test_waic_of_one_draw_has_no_variance_and_tails_do_not_cancel(spark):
    obs = spark.createDataFrame([("a", 1, "i", 1)], "name string, period int, indicator string, y int")
    items = lambda n: spark.createDataFrame([("i", 1, d, 2.0e4 + 1e-6 * d, 1.0) for d in range(1, n + 1)], "indicator string, period int, draw int, alpha double, beta double")
    theta = lambda n: spark.createDataFrame([("a", 1, d, 0.0) for d in range(1, n + 1)], "name string, period int, draw int, theta double")
    assert model.pointwise_log_lik(obs, theta(1), items(1)).first().p_waic is None
    got = model.pointwise_log_lik(obs, theta(40), items(40), per_chunk=7).first().p_waic
    step = 2.0e4 * 1e-6  # the log-likelihood falls by mu for each unit of mu out there
    assert got == pytest.approx(step**2 * (40**2 - 1) / 12 * 40 / 39, rel=0.02)


def test_tasks_of_pointwise_values_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(spread, "TASK_ROWS", 10)
    obs = spark.createDataFrame([(f"n{k}", 1, i, k % 2) for k in range(30) for i in "ij"], "name string, period int, indicator string, y int")
    theta = spark.createDataFrame([(f"n{k}", 1, d, 0.1 * k) for k in range(30) for d in range(1, 5)], "name string, period int, draw int, theta double")
    items = spark.createDataFrame([(i, 1, d, 0.2, 1.0) for i in "ij" for d in range(1, 5)], "indicator string, period int, draw int, alpha double, beta double")
    found = model.pointwise_log_lik(obs, theta, items, per_chunk=3)
    assert found.rdd.getNumPartitions() == (60 * 2 + 120) // 10 + 1
    assert {r.n_draws for r in found.collect()} == {4} and found.count() == 60


def test_pins_and_anchors_that_are_not_there(spark):
    one = spark.createDataFrame([("a", 1, "i", 1), ("a", 2, "i", 0)], "name string, period int, indicator string, y int")
    assert panel.panel_dims(one).first().n_free_starts == 1
    assert panel.panel_dims(one, ("a", "zz")).first().n_free_starts == 0
    scores = spark.createDataFrame([("L", -1.0), ("L", -0.5)], "ticker string, mean double")
    got = {r.ticker: (r.found, r.n_periods, r.sign_ok) for r in posterior.anchor_check(scores, "L", "H").collect()}
    assert got == {"L": (True, 2, True), "H": (False, 0, False)}
