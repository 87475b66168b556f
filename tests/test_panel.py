"""Cleaning and panel operators: micro-cases, traps and properties."""

import pytest
from pyspark.sql import functions as F

from scoretide.functions.values import clamp_binary, indicator_value, logical_to_int, param_index, param_name
from scoretide.operators import clean, model, panel
from scoretide.plans import views as v


def test_clamp_and_validate(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate((-1, 0, 1, 2, 5, None))], "i int, x int")
    got = [r[0] for r in df.select("i", clamp_binary(F.col("x")).alias("x")).orderBy("i").select("x").collect()]
    assert got == [-1, 0, 1, 1, 1, None]
    obs = df.select(F.lit("a").alias("indicator"), F.lit(1).alias("period"), clamp_binary(F.col("x")).alias("y"))
    bad = clean.validate_binary(obs.filter("y is not null")).collect()
    assert [(r.n_bad, r.min_y) for r in bad] == [(1, -1)]


def test_indicator_text(spark):
    cells = ["T", "false", "1", "0.7", "-1.7", "3", "x", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = [r.v for r in df.select("i", indicator_value(F.col("c")).alias("v")).orderBy("i").collect()]
    assert got == [1, 0, 1, 0, -1, 1, None, None]
    b = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert sorted(str(r[0]) for r in b.select(logical_to_int(F.col("b"))).collect()) == ["0", "1", "None"]


def test_universe_keeps_missing_keys(spark):
    df = spark.createDataFrame([(2010, None), (2015, None), (2015, "A")], "period int, ticker string")
    assert sorted(r.period for r in clean.restrict_universe(df, 2012).collect()) == [2010, 2015]


def test_overrides_run_in_order(spark):
    df = spark.createDataFrame([("X", "n1"), (None, "No Key Inc"), ("Q", "n2")], "ticker string, name string")
    rules = [clean.Override("ticker", ("X",), "XX"), clean.Override("name", ("No Key Inc",), "R"), clean.Override("ticker", ("R",), "R9")]
    assert {r.name: r.ticker for r in clean.apply_overrides(df, rules).collect()} == {"n1": "XX", "No Key Inc": "R9", "n2": "Q"}


def test_count_columns_and_lead(spark):
    df = spark.createDataFrame([(1, 2, 3)], "AAA_str_NUM int, B int, A int")
    assert clean.drop_count_columns(df).columns == ["B", "A"]
    assert clean.lead_columns(df, {"A": "a"}, ["a"]).columns == ["a", "AAA_str_NUM", "B"]


def test_transitions_and_starts(spark):
    ep = spark.createDataFrame([("e", p) for p in (1, 2, 4, 5)], "name string, period int")
    assert sorted((r.prev_period, r.period) for r in panel.transitions(ep).collect()) == [(1, 2), (4, 5)]
    assert sorted(r.period for r in panel.fresh_starts(ep).collect()) == [1, 4]
    with pytest.raises(ValueError):
        panel.classify_starts(ep, "e", "nobody")


def test_starts_and_transitions_cover_the_panel(spark, sf):
    ep = panel.entity_periods(v.obs(spark, sf)).cache()
    assert panel.transitions(ep).count() + panel.fresh_starts(ep).count() == ep.count()


def test_wide_and_back(spark, sf):
    obs = v.obs(spark, sf).select("name", "period", "indicator", "y")
    back = panel.from_wide(panel.to_wide(obs)).select("name", "period", "indicator", "y")
    assert back.exceptAll(obs).isEmpty() and obs.exceptAll(back).isEmpty()


def test_path_rebuild(spark):
    rows = [("e", 1, True, None, 2.0), ("e", 2, False, None, 1.0), ("e", 3, False, None, -2.0)]
    df = spark.createDataFrame(rows, "name string, period int, is_fresh boolean, pin double, z double")
    df = df.withColumns({"sigma_init": F.lit(0.5), "sigma": F.lit(0.2)})
    got = [round(r.theta, 9) for r in model.rebuild_paths(df).orderBy("period").collect()]
    assert got == [1.0, 1.2, 0.8]


def test_labels(spark):
    df = spark.createDataFrame([("theta[42]",), ("sigma_firm.7",), ("sigma_global",), ("lp__",)], "s string")
    got = [(r[0], r[1]) for r in df.select(param_name(F.col("s")), param_index(F.col("s"))).collect()]
    assert got == [("theta", 42), ("sigma_firm", 7), ("sigma_global", None), ("lp__", None)]


def test_plans_push_filters_and_prune_columns(spark, sf, capsys):
    v.draw_values(spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    schema = [line for line in plan.splitlines() if line.startswith("ReadSchema")][0]
    assert schema.count(":") - 1 == 3
    v.table(spark, sf, "lineitem").filter("l_linenumber <= 4").select("l_suppkey").explain("formatted")
    assert "LessThanOrEqual(l_linenumber,4)" in capsys.readouterr().out
    v.panel_raw(spark, sf).explain("formatted")
    assert "Cartesian" not in capsys.readouterr().out


def test_wide_rows_are_dealt_by_the_number_of_observations(spark):
    obs = spark.createDataFrame([(f"n{i}", 2000, "a", i % 2) for i in range(50)], "name string, period int, indicator string, y int")
    wide = panel.to_wide(obs)
    assert wide.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and wide.count() == 50
