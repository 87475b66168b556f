"""Every registered query against its SQL on the smallest tables, and the files it goes through."""

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, queries
from scoretide.operators.model import sample_observations
from scoretide.plans import steps
from scoretide.plans.oracle import oracle
from scoretide.plans.registry import QUERIES
from scoretide.plans.fit import std_normal
from scoretide.plans import views as v
from scoretide.sources import chains as cf

SQL = oracle()
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
# Fits are tested on their own panels.
ELSEWHERE = {"fit_em", "fit_em_items", "fit_em_static", "fit_gibbs", "fit_to_scores", "gibbs_convergence"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canon(x):
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return repr(float(x) + 0.0)
    return str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, duck, name):
    df = queries()[name](spark, sf)
    names = sorted(df.columns)
    got = sorted(tuple(canon(x) for x in r) for r in df.select(*[f"`{n}`" for n in names]).collect())
    cur = duck.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == names
    order = [cols.index(n) for n in names]
    assert got == sorted(tuple(canon(r[i]) for i in order) for r in cur.fetchall())


def test_every_query_is_covered():
    assert set(QUERIES) == set(SQL) | ELSEWHERE and set(QUERIES) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_chain_folder_must_hold_files(spark, tmp_path):
    (tmp_path / "a-profile-1.csv").write_text("x")
    with pytest.raises(FileNotFoundError):
        cf.chain_files(spark, str(tmp_path / "*.csv"))


def test_chain_files_in_splits(spark, tmp_path):
    """Line order survives small splits; comments, header, profile files and internals are left out."""
    n = 400
    for c in (1, 2):
        lines = ["# config", "lp__,divergent__,treedepth__,energy__,z_init.1,theta.1,sigma_global"]
        lines += [f"-{i}.5,0,{i % 11},{i}.0,9,{c * 1000 + i},0.5" for i in range(1, n + 1)]
        lines.insert(200, "# adaptation")
        (tmp_path / f"run-{c}.csv").write_text("\n".join(lines) + "\n# elapsed\n")
    (tmp_path / "run-profile-1.csv").write_text("name\n1\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        draws = cf.read_chains(spark, str(tmp_path / "*.csv")).cache()
        theta = {(r.chain, r.iteration): r.value for r in draws.filter("param = 'theta'").collect()}
        assert theta == {(c, i): float(c * 1000 + i) for c in (1, 2) for i in range(1, n + 1)}
        assert draws.filter("param = 'z_init'").isEmpty()
        assert {r.idx for r in draws.filter("param = 'sigma_global'").collect()} == {0}
        assert cf.sampler_table(draws).count() == 2 * n
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_draw_files_prune_by_param(spark, tmp_path, capsys):
    rows = [(c, i, p, k, 1.0) for c in (1, 2) for i in (1, 2) for p in ("alpha", "theta") for k in (1, 2, 3)]
    df = spark.createDataFrame(rows, "chain int, iteration long, param string, idx long, value double")
    path = str(tmp_path / "draws")
    cf.write_draws(df, path)
    got = cf.read_draws(spark, path, ["theta"], 2, 3)
    assert got.count() == 8
    got.explain("formatted")
    plan = capsys.readouterr().out
    assert "(param" in plan.split("PartitionFilters:")[1].splitlines()[0] and "GreaterThanOrEqual(idx,2)" in plan


def test_steps_from_raw_panel_to_reports(spark, sf):
    raw = v.panel_raw(spark, sf).select("name", "ticker", "issuerid", "period", "row_ord", *v.INDICATORS)
    tables = steps.clean_step(raw, v.INDICATORS, cutoff=1998, mode="first_keeps")
    panel = tables["panel"]
    assert panel.count() == panel.select("ticker", "period").distinct().count()
    assert tables["bad_values"].isEmpty() and tables["unresolved"].isEmpty()
    index = steps.index_step(tables["obs"], 1994)
    ep = index["entity_period"]
    assert index["transitions"].count() + index["starts"].count() == ep.count()
    assert index["indexed"].filter("ep_idx is null or item_idx is null").isEmpty()


def test_steps_from_draws_to_reports(spark):
    """Extract and diagnose on draws with every kind of parameter."""
    sizes = {"theta": 6, "alpha": 4, "beta": 4, "sigma_firm": 3}
    names = [(p, i) for p, n in sizes.items() for i in range(1, n + 1)]
    names += [(p, 0) for p in ("sigma_global", "sigma_init", "energy__")]
    grid = spark.createDataFrame(names, "param string, idx long")
    grid = grid.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("chain"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(1), F.lit(60))).alias("iteration"))
    draws = grid.withColumn("value", std_normal("param", "idx", "chain", "iteration"))
    for field in ("divergent__", "treedepth__"):
        draws = draws.unionByName(draws.filter("param = 'energy__'").withColumns(
            {"param": F.lit(field), "value": F.lit(0.0)}))
    ep = spark.createDataFrame([("A", 1, 1), ("A", 2, 2), ("B", 1, 3), ("B", 2, 4), ("C", 1, 5), ("C", 2, 6)],
                               "ticker string, period_idx int, ep_idx long")
    items = spark.createDataFrame([(f"x_{k}_{i}", 1, i) for i, k in enumerate(("str", "con", "str", "con"), 1)],
                                  "item_col string, period_idx int, item_idx long")
    meta = spark.createDataFrame([("Alpha", "A", 1991), ("Alpha", "A", 1992)], "name string, ticker string, year int")
    got = steps.extract_step(draws, {"entity_period": ep, "item": items}, meta, 1990)
    assert got["scores"].count() == 6 and got["scores"].filter("name = 'Alpha'").count() == 2
    assert got["item_params"].filter("alpha_mean is not null and beta_sd is not null").count() == 4
    assert got["beta_signs"].agg(F.sum("n")).first()[0] == 4
    report = steps.diagnose_step(draws, ep, ("A", "B"))
    assert report["health"].first().n_checked == sum(sizes.values()) + 2
    assert {r.ticker: r.n_periods for r in report["anchor_signs"].collect()} == {"A": 2, "B": 2}
    assert report["scales"].count() == 2 and report["sampler"].first().n_divergent == 0


def test_sample_is_stable(spark, sf):
    obs = v.obs(spark, sf)
    a = sample_observations(obs, 0.3).select("name", "period", "indicator")
    assert a.exceptAll(sample_observations(obs, 0.3).select("name", "period", "indicator")).isEmpty()
    assert 0.2 < a.count() / obs.count() < 0.4
