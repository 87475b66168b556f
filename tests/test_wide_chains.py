"""Chain files are read field by field: a line may span any number of splits."""

from pyspark.sql import functions as F

from scoretide.sources import chains as cf


def test_lines_longer_than_a_split(spark, tmp_path):
    for c in (1, 2):
        lines = ["# a, comment, with, commas", ",".join(["lp__"] + [f"theta.{k}" for k in range(1, 60)]), "# adapted, x", "",
                 *[",".join([str(d)] + [str(1000 * c + 100 * d + k) for k in range(1, 60)]) for d in (1, 2)], "# end"]
        (tmp_path / f"c-{c}.csv").write_text("\n".join(lines) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "50")
        fields = cf._placed_fields(spark, cf.chain_files(spark, str(tmp_path / "*.csv")))
        # a line of 60 fields is never in one task
        assert fields.groupBy("_file", "line").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d")).filter("n <> d").isEmpty()
        got = {(r.chain, r.iteration, r.param, r.idx): r.value for r in cf.read_chains(spark, str(tmp_path / "*.csv")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {(c, d, "theta", k): 1000.0 * c + 100 * d + k for c in (1, 2) for d in (1, 2) for k in range(1, 60)}
    assert got == want | {(c, d, "lp__", 0): float(d) for c in (1, 2) for d in (1, 2)}
