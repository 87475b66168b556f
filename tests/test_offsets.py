"""Ids of entity-periods that are counted from the entities, and array functions in blocks."""

import numpy as np

from scoretide.functions.normal import BLOCK, normal_cdf_array, normal_quantile_array
from scoretide.operators.spread import nested_offsets


def test_nested_offsets_are_the_ids_of_inner_rows(spark):
    rows = [(f"n{i:03d}", i % 4) for i in range(200)]
    got = nested_offsets(spark.createDataFrame(rows[::-1], "name string, n long"), "name", "n", "row", "first").orderBy("name").collect()
    starts = np.concatenate([[0], np.cumsum([n for _, n in rows])[:-1]]) + 1
    assert [(r.name, r.row, r["first"]) for r in got] == [(name, k + 1, starts[k]) for k, (name, _) in enumerate(rows)]


def test_array_functions_do_not_depend_on_blocks():
    p = np.random.default_rng(1).uniform(1e-12, 1 - 1e-12, (3, BLOCK))
    assert np.array_equal(normal_quantile_array(p)[1, :100], normal_quantile_array(p[1, :100].copy()))
    x = normal_quantile_array(p) * 3
    assert np.array_equal(normal_cdf_array(x).ravel()[-50:], normal_cdf_array(x.ravel()[-50:].copy()))
