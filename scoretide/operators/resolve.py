"""Telling apart entities that share a key, by deterministic suffixes.

Two ways. ``resolve_first_keeps`` is the documented rule: the name first seen
under a key keeps it, later names get key.2, key.3 and so on. ``resolve_keys``
is the rule as coded, period by period, with a log that carries suffixes
forward.

The coded rule never reaches across a component of names, ids and keys that
meet in a row (a key and its suffixed forms are one). Components without a
contested key change nothing and are left out. Small components are folded side
by side, many in a task. A component beyond ``COMPONENT_ROWS`` goes through a loop
over periods, in which every step is a join or an aggregation, so that it has not to
fit in one task. What a run has seen is a ``Memory`` from which the next one goes on.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoretide.operators.clean import dedup_first, duplicate_keys
from scoretide.operators.components import min_labels
from scoretide.operators.spread import HOT_ROWS, group_positions, group_sizes, join_null_safe
from scoretide.session import Parts, materialise, ship_code

SUFFIX = r"\.([0-9]+)$"
SUFFIXES = r"(\.[0-9]+)+$"

# Distinct (period, key, name, id) of a component that one task may hold, and of all components in a task.
COMPONENT_ROWS, TASK_ROWS = 100_000, 50_000
# A component of more rows is a group of its own, so several large ones never meet in a worker's memory; smaller ones share groups.
OWN_ROWS = 5_000


def resolve_first_keeps(df: DataFrame) -> DataFrame:
    """``new_key``: the key for its first name, ``key.k`` for the k-th name by first period and file order.

    Only pairs that change are joined back, so the common case is a small table.
    Missing keys and names are left alone.
    """
    known = df.filter(F.col("ticker").isNotNull() & F.col("name").isNotNull())
    pairs = known.groupBy("ticker", "name").agg(F.min(F.struct("period", "row_ord")).alias("_seen"))
    flat = pairs.select("ticker", "name", "_seen.*")
    ranked = group_positions(flat, ["ticker"], ["period", "row_ord"], "_rank")
    later = ranked.filter(F.col("_rank") > 1).select(
        "ticker", "name", F.concat_ws(".", "ticker", F.col("_rank").cast("string")).alias("_new")
    )
    joined = df.join(later, ["ticker", "name"], "left")
    return joined.withColumn("new_key", F.coalesce("_new", "ticker")).drop("_new").select(*df.columns, "new_key")


@dataclass
class Memory:
    """What later periods need of earlier ones. ``history``: the distinct (key, name, issuerid) after resolution; ``log``: who got
    which suffix."""

    history: DataFrame
    log: DataFrame

    def save(self, folder: str) -> None:
        self.history.write.parquet(f"{folder}/history")
        self.log.write.parquet(f"{folder}/log")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Memory:
        return cls(spark.read.parquet(f"{folder}/history"), spark.read.parquet(f"{folder}/log"))


@dataclass
class Resolution:
    """``rows``: the input with ``new_key``. ``log``: who got which suffix, when, and last used when, earlier runs included."""

    rows: DataFrame
    log: DataFrame
    memory: Memory


LOG_ORDER = ["year_created", "stage", "key_ord", "place"]
LOG_COLUMNS = ["name", "old_key", "new_key", *LOG_ORDER]
LOG_SCHEMA = "name string, old_key string, new_key string, year_created int, stage int, key_ord long, place long"
CLAIM = ["period", "key", "name", "issuerid"]


def _propagate(cur: DataFrame, log: DataFrame | None) -> DataFrame:
    """Rows whose name is logged take the logged key; the latest entry of a name wins."""
    if log is None:
        return cur
    last = log.groupBy("name").agg(F.max_by("new_key", F.struct(*LOG_ORDER)).alias("_logged"))
    return cur.join(last, "name", "left").withColumn("key", F.coalesce("_logged", "key")).drop("_logged")


def _next_suffix(keys: DataFrame, log: DataFrame | None) -> DataFrame:
    """Per key the first free suffix: one more than the highest logged, or 2."""
    if log is None:
        return keys.withColumn("next", F.lit(2))
    used = log.withColumn("_n", F.regexp_extract("new_key", SUFFIX, 1).try_cast("int"))
    top = used.groupBy(F.col("old_key").alias("key")).agg(F.max("_n").alias("_top"))
    return keys.join(top, "key", "left").withColumn("next", F.coalesce(F.col("_top") + 1, F.lit(2))).drop("_top")


def _contested(claims: DataFrame) -> DataFrame:
    """The claims on keys that have more than one, with the key's first place in the file."""
    known = claims.filter(F.col("key").isNotNull())
    keys = known.groupBy("key").agg(F.count("*").alias("_n"), F.min("ord").alias("key_ord")).filter("_n > 1")
    return known.join(keys.drop("_n"), "key")


def _suffixed(picked: DataFrame, order: list[str], log: DataFrame | None, hot: bool | None) -> DataFrame:
    """New keys for the picked claims: consecutive suffixes per key in the given order."""
    placed = group_positions(picked, ["key"], order, "place", hot)
    numbered = _next_suffix(placed, log)
    return numbered.withColumn(
        "new_key", F.concat_ws(".", "key", (F.col("next") + F.col("place") - 1).cast("string"))
    ).withColumnRenamed("key", "old_key")


def _entries(named: DataFrame, period: int, stage: int) -> DataFrame:
    """Log rows. The period is added here, so that the plans before it are the same in every period."""
    return named.withColumns({"year_created": F.lit(period), "stage": F.lit(stage)}).select(LOG_COLUMNS)


def _resolve_ids(cur: DataFrame, prior: DataFrame | None, log: Parts, period: int) -> DataFrame:
    """The id stage: under a contested key one id stays, the others get suffixes in id order."""
    with_id = cur.filter(F.col("issuerid").isNotNull() & (F.col("issuerid") != ""))
    claims = with_id.groupBy("key", "issuerid", "name").agg(F.min("row_ord").alias("ord"))
    contested = materialise(_contested(claims), "id-contested")
    largest, total = group_sizes(contested, ["key"])
    if total == 0:
        return cur
    if prior is None:
        entries = contested.withColumns({"_seen": F.lit(False), "_any": F.lit(False)})
    else:
        keys = contested.select("key").distinct()
        seen = prior.filter(F.col("issuerid").isNotNull()).join(keys, "key", "left_semi")
        seen = seen.groupBy("key", "issuerid").agg(F.lit(True).alias("_seen"))
        past = seen.groupBy("key").agg(F.lit(True).alias("_any"))
        entries = contested.join(seen, ["key", "issuerid"], "left").join(past, "key", "left")
        entries = entries.fillna(False, ["_seen", "_any"])
    # with a past, the lowest id seen before stays; if no id of this period was, the stage does nothing
    keeper = entries.groupBy("key").agg(
        F.min("issuerid").alias("_low"), F.min(F.when(F.col("_seen"), F.col("issuerid"))).alias("_old"),
        F.bool_or("_any").alias("_past"),
    ).select("key", F.when(F.col("_past"), F.col("_old")).otherwise(F.col("_low")).alias("_keeper"))
    moved = contested.join(keeper, "key").filter(F.col("issuerid") != F.col("_keeper"))
    named = materialise(
        _suffixed(moved, ["issuerid", "ord"], log.all(), largest > HOT_ROWS), "id-suffixes"
    )
    log.add(_entries(named, period, 1))
    # every row of the id in this period moves, whatever its key; the last assignment wins
    last = named.groupBy("issuerid").agg(F.max_by("new_key", F.struct("key_ord", "place")).alias("_new"))
    return cur.join(last, "issuerid", "left").withColumn("key", F.coalesce("_new", "key")).drop("_new")


def _resolve_names(cur: DataFrame, prior: DataFrame | None, log: Parts, period: int) -> DataFrame:
    """The name stage: names new under a contested key get suffixes in file order.

    Keys are handled in the order in which they first appear, and a renamed
    name leaves all its other keys. So a name moves at the first contested key
    where it is new, which is one minimum per name. Only a name that moves onto
    a key which is itself contested and comes later is looked at again there;
    such arrivals repeat until they settle, once per level of suffix.
    """
    claims = cur.groupBy("key", "name").agg(F.min("row_ord").alias("ord"))
    contested = materialise(_contested(claims), "name-contested")
    largest, total = group_sizes(contested, ["key"])
    if total == 0:
        return cur
    keys = contested.select("key", "key_ord").distinct()
    known, logged = None, log.all()
    if prior is not None:
        known = prior.select("key", "name")
    if logged is not None:
        entries = logged.select(F.col("old_key").alias("key"), "name")
        known = entries if known is None else known.unionByName(entries)
    if known is not None:
        known = known.join(keys, "key", "left_semi")

    def only_new(rows: DataFrame) -> DataFrame:
        return rows if known is None else join_null_safe(rows, known, ["key", "name"], "left_anti")

    fresh = only_new(contested)
    columns = ["key", "key_ord", "name", "ord"]
    first = fresh.filter(F.col("name").isNotNull()).groupBy("name").agg(
        F.min(F.struct("key_ord", "key", "ord")).alias("_f")
    )
    # a missing name takes its suffix but can never be matched for renaming
    picked = first.select("name", "_f.*").select(*columns).unionByName(
        fresh.filter(F.col("name").isNull()).select(*columns)
    )
    name_ord = cur.groupBy("name").agg(F.min("row_ord").alias("ord"))
    onto = keys.select(F.col("key").alias("_to"), F.col("key_ord").alias("_to_ord"))
    arrivals, hot = None, largest > HOT_ROWS
    while True:
        rows = picked
        if arrivals is not None:
            rows = picked.join(arrivals, ["key", "name"], "left_anti").select(*columns).unionByName(arrivals)
            hot = None
        named = materialise(_suffixed(rows, ["ord"], logged, hot), "name-suffixes")
        landed = named.filter(F.col("name").isNotNull()).join(
            onto, (F.col("new_key") == F.col("_to")) & (F.col("_to_ord") > F.col("key_ord"))
        ).select(F.col("_to").alias("key"), F.col("_to_ord").alias("key_ord"), "name").distinct()
        if arrivals is None and landed.isEmpty():
            break
        found = materialise(only_new(landed.join(name_ord, "name")).select(*columns), "name-arrivals")
        pairs = found.select("key", "name")
        if arrivals is None:
            settled = pairs.isEmpty()
        else:
            before = arrivals.select("key", "name")
            settled = pairs.exceptAll(before).isEmpty() and before.exceptAll(pairs).isEmpty()
        if settled:
            break
        arrivals = found
    log.add(_entries(named, period, 2))
    last = named.filter(F.col("name").isNotNull()).groupBy("name").agg(F.max_by("new_key", "key_ord").alias("_new"))
    return cur.join(last, "name", "left").withColumn("key", F.coalesce("_new", "key")).drop("_new")


def _by_period(rows: DataFrame, periods: list[tuple[int, int]], memory: Memory | None) -> tuple[DataFrame, DataFrame]:
    """(rows with their last key, log) by a loop over periods. ``rows``: row_ord, period, key, name, issuerid; ``periods`` with
    their number of rows that have an id."""
    spark = rows.sparkSession
    log, done = Parts(spark, "resolve-log"), Parts(spark, "resolve-done")
    columns = ["row_ord", "name", "issuerid", "key"]
    if memory is not None:
        done.add(memory.history.select(F.lit(None).cast("long").alias("row_ord"), "name", "issuerid", "key"))
        log.add(memory.log.select(*LOG_COLUMNS))
    for period, n_ids in periods:
        prior = done.all()
        cur = _propagate(rows.filter(F.col("period") == period).select(*columns), log.all())
        if n_ids:
            cur = _resolve_ids(cur, prior, log, period)
        done.add(_resolve_names(cur, prior, log, period).select(*columns))
    entries = log.all()
    return done.all().filter(F.col("row_ord").isNotNull()), spark.createDataFrame([], LOG_SCHEMA) if entries is None else entries


class Fold:
    """The coded rule over the rows of one component, period by period. A row is [ord, key, name, id]."""

    def __init__(self) -> None:
        self.names: set[tuple] = set()  # (key, name) of earlier periods
        self.ids: set[tuple] = set()  # (key, id) of earlier periods
        self.past: set[str] = set()  # keys that had a row with an id
        self.claimed: set[tuple] = set()  # (old key, name) of the log
        self.current: dict[str, str] = {}  # name -> logged key
        self.top: dict[str, int] = {}  # key -> highest suffix given
        self.log: list[tuple] = []

    def remember(self, key: str | None, name: str | None, issuer: str | None) -> None:
        self.names.add((key, name))
        if issuer is not None and key is not None:
            self.ids.add((key, issuer))
            self.past.add(key)

    def enter(self, entries: Iterable[tuple]) -> None:
        """Log entries (name, old key, new key, period, stage, place of the key, place)."""
        for entry in sorted(entries, key=lambda e: e[3:]):
            name, old, new = entry[:3]
            self.claimed.add((old, name))
            if name is not None:
                self.current[name] = new
            suffix = re.search(SUFFIX, new)
            if suffix:
                self.top[old] = max(self.top.get(old, 1), int(suffix[1]))
            self.log.append(entry)

    def suffixed(self, picked: dict[str, list[tuple]]) -> list[tuple]:
        """(key, new key, place, claim) for the sorted claims per key; numbers go on from the highest given before."""
        return [(key, f"{key}.{self.top.get(key, 1) + place}", place, claim)
                for key, claims in picked.items() for place, claim in enumerate(sorted(claims), 1)]

    @staticmethod
    def contested(claims: dict[tuple, int]) -> tuple[dict[str, list[tuple]], dict[str, int]]:
        """Claims (key, ...) -> ord on keys that have several, by key, and the first ord of each such key."""
        by_key: dict[str, list[tuple]] = {}
        for claim in claims:
            if claim[0] is not None:
                by_key.setdefault(claim[0], []).append(claim)
        by_key = {key: own for key, own in by_key.items() if len(own) > 1}
        return by_key, {key: min(claims[c] for c in own) for key, own in by_key.items()}

    @staticmethod
    def least(rows: list[list], *columns: int) -> dict[tuple, int]:
        out: dict[tuple, int] = {}
        for row in rows:
            claim = tuple(row[c] for c in columns)
            out[claim] = min(out.get(claim, row[0]), row[0])
        return out

    def period(self, period: int, rows: list[list]) -> None:
        for row in rows:
            if row[2] is not None:
                row[1] = self.current.get(row[2], row[1])
        if any(row[3] for row in rows):
            self.by_id(period, rows)
        self.by_name(period, rows)
        for _, key, name, issuer in rows:
            self.remember(key, name, issuer)

    def by_id(self, period: int, rows: list[list]) -> None:
        claims = self.least([row for row in rows if row[3]], 1, 3, 2)
        by_key, key_ord = self.contested(claims)
        moved: dict[str, list[tuple]] = {}
        for key, own in by_key.items():
            ids = [issuer for _, issuer, _ in own]
            if key in self.past:
                ids = [issuer for issuer in ids if (key, issuer) in self.ids]
            if ids:
                moved[key] = [(c[1], claims[c], c[2]) for c in own if c[1] != min(ids)]
        named = self.suffixed(moved)
        self.enter([(claim[2], key, new, period, 1, key_ord[key], place) for key, new, place, claim in named])
        last = {claim[0]: new for key, new, place, claim in sorted(named, key=lambda n: (key_ord[n[0]], n[2]))}
        for row in rows:
            row[1] = last.get(row[3], row[1]) if row[3] is not None else row[1]

    def by_name(self, period: int, rows: list[list]) -> None:
        claims = self.least(rows, 1, 2)
        by_key, key_ord = self.contested(claims)
        new = lambda key, name: (key, name) not in self.names and (key, name) not in self.claimed
        fresh = [c for own in by_key.values() for c in own if new(*c)]
        first: dict[str, tuple] = {}
        for key, name in sorted(fresh, key=lambda c: (key_ord[c[0]], c[0])):
            if name is not None:
                first.setdefault(name, (key, name))
        picked = {c: claims[c] for c in fresh if c[1] is None or first[c[1]] == c}
        seen = self.least(rows, 2)
        arrivals: dict[tuple, int] = {}
        while True:
            by: dict[str, list[tuple]] = {}
            for (key, name), place in (picked | arrivals).items():
                by.setdefault(key, []).append((place, name))
            named = self.suffixed(by)
            # a name that moves onto a contested key which comes later is looked at again there
            landed = {(to, claim[1]): seen[(claim[1],)] for key, to, _, claim in named
                      if claim[1] is not None and to in key_ord and key_ord[to] > key_ord[key] and new(to, claim[1])}
            if landed.keys() == arrivals.keys():
                break
            arrivals = landed
        self.enter([(claim[1], key, to, period, 2, key_ord[key], place) for key, to, place, claim in named])
        last = {claim[1]: to for key, to, _, claim in sorted(named, key=lambda n: key_ord[n[0]]) if claim[1] is not None}
        for row in rows:
            if row[2] is not None:
                row[1] = last.get(row[2], row[1])


FOLD_SCHEMA = "period int, key string, name string, issuerid string, new_key string, stage int, year_created int, key_ord long, place long"


def _folded(bucket: pd.DataFrame) -> pd.DataFrame:
    """The claims of a bucket of components with their last key, and new log entries (stage 1 or 2)."""
    out: list[tuple] = []
    text = bucket[["key", "name", "issuerid", "new_key"]].astype(object)
    bucket = bucket.assign(**text.where(text.notna(), None))
    for _, group in bucket.groupby("component", sort=False):
        fold, old = Fold(), group[group["kind"] > 0]
        for r in old[old["kind"] == 1].itertuples():
            fold.remember(r.key, r.name, r.issuerid)
        fold.enter([(r.name, r.key, r.new_key, r.year_created, r.stage, r.key_ord, r.place) for r in old[old["kind"] == 2].itertuples()])
        known = len(fold.log)
        for period, claims in group[group["kind"] == 0].groupby("period", sort=True):
            rows = [[r.ord, r.key, r.name, r.issuerid] for r in claims.itertuples()]
            before = [(period, *row[1:]) for row in rows]
            fold.period(period, rows)
            out += [(*claim, row[1], 0, 0, 0, 0) for claim, row in zip(before, rows)]
        out += [(0, old_key, name, None, new_key, stage, year, key_ord, place) for name, old_key, new_key, year, stage, key_ord, place in fold.log[known:]]
    return pd.DataFrame(out, columns=["period", "key", "name", "issuerid", "new_key", "stage", "year_created", "key_ord", "place"])


def _node(kind: str, text: str) -> Column:
    """A number for a name, an id or a key; should two ever agree, their components are one, which changes nothing."""
    return F.when(F.col(text).isNotNull() & (F.col(text) != ""), F.xxhash64(F.lit(kind), text))


def with_component(claims: DataFrame) -> DataFrame:
    """``component`` of claims (key, name, issuerid): NULL where a row has none of the three.

    Rows meet at their key without its suffixes, or at their name or id where they have no key. Names and ids then join the
    places where they occur; only such links between places go through rounds.
    """
    base = F.regexp_replace("key", SUFFIXES, "")
    placed = claims.withColumn("_base", base).withColumn("place_", F.coalesce(
        F.when(F.col("key").isNotNull(), F.xxhash64(F.lit("key"), "_base")), _node("name", "name"), _node("id", "issuerid"))).drop("_base")
    at = placed.select("place_", F.explode(F.array_compact(F.array(_node("name", "name"), _node("id", "issuerid")))).alias("node"))
    least = at.groupBy("node").agg(F.min("place_").alias("a"), F.collect_set("place_").alias("b")).where(F.size("b") > 1)
    labels = min_labels(least.select("a", F.explode("b").alias("b")))
    joined = placed.join(labels, placed["place_"] == labels["node"], "left")
    return joined.select(*claims.columns, F.coalesce("label", "place_").alias("component"))


def resolve_keys(df: DataFrame, memory: Memory | None = None, component_rows: int = COMPONENT_ROWS) -> Resolution:
    """Resolve contested keys period by period, as coded.

    ``df``: name, ticker, issuerid, period, row_ord (unique, in file order) and
    any other columns, which are joined back once, and only where a key changes.
    With the ``memory`` of an earlier run, ``df`` holds later periods only and the
    result is that of one run over all of them.
    """
    spark = df.sparkSession
    ship_code(spark)
    slim = df.select(F.col("period").cast("int").alias("period"), F.col("ticker").alias("key"), "name", "issuerid", "row_ord")
    claims = slim.where("period is not null").groupBy(*CLAIM).agg(F.min("row_ord").alias("ord"))
    # numbers are never NULL here, as pandas would make them floating
    nothing = {c: F.lit(0).cast(t) for c, t in (("stage", "int"), ("year_created", "int"), ("key_ord", "long"), ("place", "long"))}
    nothing = {"new_key": F.lit(None).cast("string")} | nothing
    columns = [*CLAIM, "ord", "kind", *nothing]
    every = claims.withColumns(nothing).withColumn("kind", F.lit(0)).select(*columns)
    if memory is not None:
        old = memory.history.select("key", "name", "issuerid", F.lit(1).alias("kind"), *[c.alias(n) for n, c in nothing.items()])
        entries = memory.log.select(F.col("old_key").alias("key"), "name", F.lit(None).cast("string").alias("issuerid"), F.lit(2).alias("kind"), *nothing)
        blank = {"period": F.lit(0), "ord": F.lit(0).cast("long")}
        every = every.unionByName(old.unionByName(entries).withColumns(blank).select(*columns))
    every = materialise(every, "claims")
    periods = sorted((r["period"], r["n"]) for r in every.where("kind = 0").groupBy("period").agg(
        F.count_if(F.col("issuerid").isNotNull() & (F.col("issuerid") != "")).alias("n")).collect())
    if not periods:
        raise ValueError("no row has a period")
    if memory is not None and (late := memory.log.agg(F.max("year_created")).first()[0]) is not None and late >= periods[0][0]:
        raise ValueError("the memory already holds these periods")
    placed = materialise(with_component(every), "components")

    # components in which some key is contested, or whose names have been given a key
    crowded = placed.where("kind = 0 and key is not null").groupBy("component", "period", "key").agg(F.count("*").alias("n")).where("n > 1").select("component")
    active = crowded.unionByName(placed.where("kind = 2").select("component")).distinct()
    sizes = placed.join(active, "component").groupBy("component").agg(F.count("*").alias("_size"))
    sizes = materialise(sizes, "component-sizes")
    total = sizes.agg(F.sum(F.when(F.col("_size") <= component_rows, F.col("_size"))), F.max("_size")).first()
    held = placed.join(sizes, "component")

    buckets = max((total[0] or 0) // TASK_ROWS + 1, spark.sparkContext.defaultParallelism)
    alone = F.when(F.col("_size") > OWN_ROWS, F.col("component"))
    small = held.where(F.col("_size") <= component_rows).withColumns({"bucket": F.pmod(F.xxhash64("component"), F.lit(buckets)), "alone": alone}).drop("_size")
    found = small.groupBy("bucket", "alone").applyInPandas(_folded, FOLD_SCHEMA) if total[0] else spark.createDataFrame([], FOLD_SCHEMA)
    found = materialise(found, "folded")
    moved = found.where("stage = 0 and not (new_key <=> key)").select(*CLAIM, "new_key")
    log = found.where("stage > 0").select("name", F.col("key").alias("old_key"), "new_key", *LOG_ORDER)

    if (total[1] or 0) > component_rows:
        giants = held.where(F.col("_size") > component_rows).drop("_size")
        rows = join_null_safe(slim.where("period is not null"), giants.where("kind = 0").select(*CLAIM), CLAIM, "left_semi")
        own = None if memory is None else Memory(giants.where("kind = 1"), giants.where("kind = 2").select("name", F.col("key").alias("old_key"), "new_key", *LOG_ORDER))
        rows = materialise(rows, "resolve", ["period"])
        last, entries = _by_period(rows, periods, own)
        log = log.unionByName(entries.where(F.col("year_created") >= periods[0][0]).select(log.columns))
        changed = rows.join(last.select("row_ord", F.col("key").alias("new_key")), "row_ord").where("not (new_key <=> key)")
        moved = moved.unionByName(changed.groupBy(*CLAIM).agg(F.first("new_key").alias("new_key")))

    if memory is not None:
        log = memory.log.select(log.columns).unionByName(log)
    log = materialise(log, "resolve-log")
    moved = materialise(moved.withColumnsRenamed({"key": "ticker", "new_key": "_moved"}), "resolve-moved")
    renamed = [c if c != "key" else "ticker" for c in CLAIM]
    rows = join_null_safe(df, moved, renamed, "left").withColumn("new_key", F.coalesce("_moved", "ticker"))
    last_used = slim.groupBy("name").agg(F.max("period").alias("_used"))
    used = F.greatest("_used", "_old_used") if memory is not None and "year_last_used" in memory.log.columns else F.col("_used")
    entries = log.join(last_used, "name", "left")
    if memory is not None and "year_last_used" in memory.log.columns:
        before = memory.log.groupBy("name").agg(F.max("year_last_used").alias("_old_used"))
        entries = entries.join(before, "name", "left")
    entries = entries.select(*LOG_COLUMNS, F.coalesce(used, "year_created").alias("year_last_used"))
    final = join_null_safe(every.where("kind = 0").select(*CLAIM).withColumnRenamed("key", "ticker"), moved, renamed, "left").select(
        F.coalesce("_moved", "ticker").alias("key"), "name", "issuerid")
    if memory is not None:
        final = final.unionByName(memory.history.select("key", "name", "issuerid"))
    return Resolution(rows.select(*df.columns, "new_key"), entries, Memory(final.distinct(), entries))


def unresolved_collisions(rows: DataFrame) -> DataFrame:
    """(period, key) pairs that still hold several names; taken before duplicates are dropped."""
    claims = rows.filter(F.col("new_key").isNotNull()).select("period", "new_key", "name").distinct()
    return claims.groupBy("period", "new_key").agg(F.count("*").alias("n_names")).filter("n_names > 1")


def finish_panel(rows: DataFrame) -> DataFrame:
    """One row per (new_key, period), the first in file order; rows without a key collapse per period too."""
    return dedup_first(rows, ["new_key", "period"])


def lost_rows(rows: DataFrame) -> DataFrame:
    """How many rows each period loses to that last step."""
    doubled = duplicate_keys(rows, key="new_key")
    return doubled.groupBy("period").agg(F.sum(F.col("n_rows") - 1).alias("n_lost"))
