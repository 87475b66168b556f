"""Key resolution: golden cases, and three ways to run it that must agree on random panels."""

import random

import pytest

from scoretide.operators.components import min_labels
from scoretide.operators.resolve import (
    Memory, finish_panel, lost_rows, resolve_first_keeps, resolve_keys, unresolved_collisions, with_component,
)

SCHEMA = "period int, ticker string, name string, issuerid string, row_ord long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA)


def parse(text):
    rows = []
    for part in text.split("; "):
        words = part.split()
        rows.append((int(words[0]), None if words[1] == "NULL" else words[1], words[2], words[3] if len(words) > 3 else None))
    return rows


GOLDEN = [
    ("1991 T X; 1991 T Y", "1991 T.2 X; 1991 T.3 Y"),
    ("1991 T X; 1992 T X; 1992 T Y; 1993 T X; 1993 T Y; 1994 T Y",
     "1991 T X; 1992 T X; 1992 T.2 Y; 1993 T X; 1993 T.2 Y; 1994 T.2 Y"),
    ("1991 T X; 1992 T Y; 1993 T X; 1993 T Y", "1991 T X; 1992 T Y; 1993 T X"),
    ("2016 T X; 2017 T X I2; 2017 T Y I1; 2018 T Y I1; 2018 T Z I0",
     "2016 T X; 2017 T.2 X; 2017 T Y; 2018 T Y; 2018 T.3 Z"),
    ("2017 T X I5; 2018 T P I8; 2018 T Q I9", "2017 T X; 2018 T.2 P; 2018 T.3 Q"),
    ("1991 T X; 1991 U X; 1991 T Y", "1991 T.2 X; 1991 T.3 Y"),
    ("1995 NULL X; 1995 NULL Y", "1995 NULL X"),
    ("1991 T X; 1992 T X; 1992 T Y; 1995 T X; 1995 T Z",
     "1991 T X; 1992 T X; 1992 T.2 Y; 1995 T X; 1995 T.3 Z"),
]


@pytest.mark.parametrize("given,wanted", GOLDEN)
def test_golden(spark, given, wanted):
    got = finish_panel(resolve_keys(frame(spark, parse(given))).rows).collect()
    assert sorted((r.period, str(r.new_key), r.name) for r in got) == sorted((p, str(k), n) for p, k, n, _ in parse(wanted.replace("NULL", "None")))


def test_unresolved_is_reported(spark):
    res = resolve_keys(frame(spark, parse(GOLDEN[2][0])))
    assert [(r.period, r.n_names) for r in unresolved_collisions(res.rows).collect()] == [(1993, 2)]
    assert [(r.period, r.n_lost) for r in lost_rows(res.rows).collect()] == [(1993, 1)]


def test_first_keeps(spark):
    got = resolve_first_keeps(frame(spark, parse(GOLDEN[0][0]))).collect()
    assert {(r.name, r.new_key) for r in got} == {("X", "T"), ("Y", "T.2")}


def panel(seed, first=1991, last=1995):
    rng = random.Random(seed)
    names = [f"N{i}" for i in range(9)] + ([None] if seed % 2 else [])
    keys = ["A", "B", "A.2", "A.2.2", "C", "B.3", None] + [f"K{i}" for i in range(5)]
    rows = []
    for yr in range(first, last + 1):
        for _ in range(rng.randint(8, 22)):
            iid = rng.choice([f"I{rng.randint(0, 6)}"] * 6 + [""]) if yr >= 1993 and rng.random() < 0.7 else None
            rows.append((yr, rng.choice(keys), rng.choice(names), iid))
        rows += [(yr, f"Q{i}", f"quiet {i}", None) for i in range(4)] + [(yr, None, None, None)]
    return rows


def outcome(res):
    keys = sorted((r.row_ord, str(r.new_key)) for r in res.rows.collect())
    return keys, sorted(tuple(map(str, r)) for r in res.log.collect()), sorted(tuple(map(str, r)) for r in res.memory.history.collect())


@pytest.mark.parametrize("seed", range(3))
def test_fold_loop_and_resumed_runs_agree(spark, seed, tmp_path):
    df = frame(spark, panel(seed))
    whole = outcome(resolve_keys(df))
    assert outcome(resolve_keys(df, component_rows=0)) == whole  # every component by the loop over periods
    assert outcome(resolve_keys(df, component_rows=40)) == whole
    early = resolve_keys(df.where("period < 1994"))
    early.memory.save(str(tmp_path / "memory"))
    late = resolve_keys(df.where("period >= 1994"), Memory.load(spark, str(tmp_path / "memory")))
    keys, log, history = outcome(late)
    assert sorted(outcome(early)[0] + keys) == whole[0] and (log, history) == whole[1:]
    late = resolve_keys(df.where("period >= 1994"), early.memory, component_rows=0)
    assert outcome(late)[1:] == whole[1:]
    with pytest.raises(ValueError, match="already"):
        resolve_keys(df, early.memory)


@pytest.mark.parametrize("seed", range(4))
def test_properties_of_the_log(spark, seed):
    res = resolve_keys(frame(spark, panel(seed + 10)))
    log = res.log.collect()
    given = [(r.old_key, r.new_key) for r in log]
    assert len(given) == len(set(given))  # no suffix is given twice
    for old in {o for o, _ in given}:
        numbers = sorted(int(n.rsplit(".", 1)[1]) for o, n in given if o == old)
        assert numbers == list(range(2, 2 + len(numbers)))
    assert all(r.new_key.rsplit(".", 1)[0] == r.old_key and r.year_last_used >= r.year_created for r in log)
    quiet = [r for r in res.rows.collect() if (r.name or "").startswith("quiet")]
    assert all(r.new_key == r.ticker for r in quiet)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    label = {}
    for a, b in links:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(len(label)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = min_labels(spark.createDataFrame(links, "a long, b long"))
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert {(r.node, r.label) for r in got.collect()} == {(n, label[n]) for n in linked} and got.count() == len(linked)
    assert min_labels(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_keep_suffixed_keys_names_and_ids_together(spark):
    rows = [("A", "x", None), ("A.2.3", "y", None), ("B", "y", "1"), (None, "z", "1"), ("C", "w", ""), ("D", "v", ""), (None, None, None), (None, "w", None)]
    got = {tuple(r)[:3]: r.component for r in with_component(spark.createDataFrame(rows, "key string, name string, issuerid string")).collect()}
    a = got["A", "x", None]
    assert [k for k, c in got.items() if c == a] == rows[:4] and got[None, None, None] is None
    assert got["C", "w", ""] == got[None, "w", None] != got["D", "v", ""]
