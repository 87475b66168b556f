"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first with a calibrated number of leaves."""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoretide.llm.common import over_batches, stored

NEIGHBOURS, EVERY = 5, 50

# The tree is fitted on at most this many vectors and numbers; every vector is indexed.
FIT_ROWS, FIT_NUMBERS = 32_768, 4_000_000
LEAST_LEAF, BRANCHES, ROUNDS = 8, 8, 12

# Queries that the number of visits is calibrated on, against all vectors, and the recall wanted there.
CALIBRATION, RECALL = 256, 0.96

TILE, BLOCK, CHUNK = 2048, 512, 256

# Results that a task holds before it passes them on.
HELD = 400_000

SLACK = 1e-12


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """The cluster of each unit vector: spread first centres, then rounds by cosine. Clusters may be fewer than ``k``."""
    centres = x[[int(rng.integers(len(x)))]]
    far = 1 - x @ centres[0]
    for _ in range(k - 1):
        weight = np.maximum(far, 0) ** 2
        if weight.sum() <= 1e-18:
            break
        new = x[int(np.searchsorted(np.cumsum(weight), rng.random() * weight.sum()).clip(0, len(x) - 1))]
        centres = np.vstack([centres, new])
        far = np.minimum(far, 1 - x @ new)
    label = np.argmax(x @ centres.T, axis=1)
    for _ in range(ROUNDS):
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x)
        size = np.sqrt((sums**2).sum(1))
        moved = size > 1e-9
        centres[moved] = sums[moved] / size[moved][:, None]
        now = np.argmax(x @ centres.T, axis=1)
        if np.array_equal(now, label):
            break
        label = now
    return label


class Tree:
    """Nodes with unit centres; node 0 is the root, ``leaf`` numbers those without children."""

    def __init__(self, width: int) -> None:
        self.centres: np.ndarray | list = [np.zeros(width)]
        self.children: list[list[int]] = [[]]
        self.leaf: list[int] = [-1]

    @classmethod
    def fit(cls, x: np.ndarray, leaf_size: float, seed: int = 11) -> Tree:
        """Split unit vectors by k-means until a node holds at most ``leaf_size`` of them, or cannot be split."""
        tree, rng, todo = cls(x.shape[1]), np.random.default_rng(seed), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            groups = []
            if len(rows) > leaf_size:
                label = k_means(x[rows], min(BRANCHES, int(-(-len(rows) // leaf_size))), rng)
                groups = [rows[label == c] for c in np.unique(label)]
            if len(groups) < 2:
                continue
            for group in groups:
                total = x[group].sum(0)
                size = np.sqrt(total @ total)
                tree.children[node].append(len(tree.children))
                todo.append((len(tree.children), group))
                tree.centres.append(total / size if size > 1e-9 else x[group[0]])
                tree.children.append([])
                tree.leaf.append(-1)
        tree.centres = np.array(tree.centres)
        leaves = [i for i, kids in enumerate(tree.children) if not kids]
        for number, node in enumerate(leaves):
            tree.leaf[node] = number
        tree.n_leaves = len(leaves)
        return tree

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector: down to the nearest child, level by level."""
        out, todo = np.zeros(len(x), dtype=np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
            elif len(rows):
                nearest = np.argmax(x[rows] @ self.centres[kids].T, axis=1)
                todo += [(kid, rows[nearest == i]) for i, kid in enumerate(kids)]
        return out

    def visits(self, x: np.ndarray, most: int) -> Iterator[list[int]]:
        """For each unit vector the first ``most`` leaves, best bin first: down to the nearest child, and the others into a
        priority queue by their closeness, of which the best is next."""
        for at in range(0, len(x), CHUNK):
            for near in (x[at : at + CHUNK] @ self.centres.T).tolist():
                queue, found = [(0.0, 0)], []
                while queue and len(found) < most:
                    node = heapq.heappop(queue)[1]
                    while self.children[node]:
                        kids = self.children[node]
                        node = max(kids, key=near.__getitem__)
                        for kid in kids:
                            if kid != node:
                                heapq.heappush(queue, (-near[kid], kid))
                    found.append(self.leaf[node])
                yield found


def _flat(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _keyed(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.ascontiguousarray(_flat(batch.column("vec")).reshape(-1, width))
            keys = [hashlib.blake2b(row, digest_size=16).digest() for row in x]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.binary()), batch.column("vec")], names=["id", "key", "vec"])

    return work


def _indexed(tree, width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = tree.value.assign(unit(_flat(batch.column("vec")).reshape(-1, width)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    return work


def _routed(tree, width: int, most: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = list(tree.value.visits(unit(_flat(batch.column("vec")).reshape(-1, width)), most))
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("vec"), pa.array(found, pa.list_(pa.int32()))], names=["key", "vec", "leaves"])

    return work


def best_in_tile(q: np.ndarray, x: np.ndarray, first: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of the ``keep`` rows of ``x`` nearest to each row of ``q``; ties to the smaller ``first``. Close calls are decided on
    products of single pairs, which do not depend on the place in a block."""
    uq, ux = unit(q), unit(x)
    near = uq @ ux.T
    if near.shape[1] > keep:
        least = np.partition(near, near.shape[1] - keep, axis=1)[:, near.shape[1] - keep]
        i, j = np.nonzero(near >= least[:, None] - SLACK)
    else:
        i, j = (a.ravel() for a in np.indices(near.shape))
    score = np.concatenate([np.einsum("ij,ij->i", uq[i[k : k + 65536]], ux[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)])
    order = np.lexsort((first[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < keep], j[place < keep], score[place < keep]


class Best:
    """The nearest vectors of each query among those seen so far: ``keep`` per query, ties to the smaller first id."""

    def __init__(self, keep: int) -> None:
        self.keep, self.number, self.keys = keep, {}, []
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, keys: list[bytes], i: np.ndarray, score: np.ndarray, ids: pa.ListArray) -> None:
        for key in keys:
            if key not in self.number:
                self.number[key] = len(self.keys)
                self.keys.append(key)
        self.parts.append((np.array([self.number[key] for key in keys])[i], score, ids))
        self.rows += len(i)

    def settle(self) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
        """Keep the best per query only."""
        query, score = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
        ids = pa.concat_arrays([p[2] for p in self.parts])
        first = ids.values.to_numpy(zero_copy_only=False)[ids.offsets.to_numpy()[:-1]]
        order = np.lexsort((first, -score, query))
        order = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < self.keep]
        kept = query[order], score[order], ids.take(pa.array(order))
        self.parts, self.rows = [kept], len(order)
        return kept

    def batch(self) -> pa.RecordBatch:
        query, score, ids = self.settle()
        return pa.RecordBatch.from_arrays([pa.array([self.keys[k] for k in query], pa.binary()), pa.array(score), ids], names=["key", "score", "ids"])


def _searched(width: int, keep: int):
    """Blocks of queries and the tiles that they visit to (key, score, ids). A task gives its best per query, unless it meets so many queries that
    it lets go of them in between."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(keep)
        for batch in batches:
            for row in range(batch.num_rows):
                q, x = (batch.column(c)[row].values.to_numpy(zero_copy_only=False).reshape(-1, width) for c in ("asked", "vec"))
                first = batch.column("first")[row].values.to_numpy(zero_copy_only=False)
                i, j, score = best_in_tile(q, x, first, keep)
                best.add(batch.column("keys")[row].as_py(), i, score, batch.column("ids")[row].values.take(pa.array(j)))
                if best.rows > HELD:
                    best.settle()
                    if best.rows > HELD // 2:
                        yield best.batch()
                        best = Best(keep)
        if best.rows:
            yield best.batch()

    return work


def _exact(queries, width: int, keep: int):
    """Nearest rows of a partition's tiles to each calibration query: (query, score, ids, leaf)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for row in range(batch.num_rows):
                x = batch.column("vec")[row].values.to_numpy(zero_copy_only=False).reshape(-1, width)
                first = batch.column("first")[row].values.to_numpy(zero_copy_only=False)
                i, j, score = best_in_tile(queries.value, x, first, keep)
                ids, leaf = batch.column("ids")[row].values.take(pa.array(j)).to_pylist(), batch.column("leaf")[row].as_py()
                new = [(int(a), -float(s), k, leaf) for a, s, k in zip(i, score, ids)]
                held = sorted(new if held is None else held + new, key=lambda r: (r[0], r[1], r[2][0]))
                seen: dict[int, int] = {}
                held = [r for r in held if seen.setdefault(r[0], 0) < keep and not seen.update({r[0]: seen[r[0]] + 1})]
        if held:
            a, s, ids, leaf = zip(*held)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array([-v for v in s]), pa.array(ids, pa.list_(pa.int64())), pa.array(leaf, pa.int32())],
                                             names=["query", "score", "ids", "leaf"])

    return work


def _chance(key: str, share: float) -> Column:
    """True for about this share of the keys, the same ones in every run."""
    return F.pmod(F.xxhash64(F.lit(7), key), F.lit(1 << 30)) < int(min(share, 1.0) * (1 << 30))


def _best(found: DataFrame, key: str, keep: int) -> DataFrame:
    """The ``keep`` best vectors per key. Every task drops what cannot be among them before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.col("ids")[0])
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep).drop("place")


def calibrated_visits(tree: Tree, queries: np.ndarray, own: list[int], near: dict[int, list], neighbours: int, recall: float) -> tuple[int, float]:
    """The smallest number of leaves whose recall over the calibration queries is at least ``recall``, and that recall."""
    ranks = []
    for k, order in enumerate(tree.visits(queries, tree.n_leaves)):
        place = {leaf: r for r, leaf in enumerate(order, 1)}
        rows = sorted((-score, i, place[leaf]) for score, ids, leaf in near.get(k, []) for i in ids if i != own[k])
        ranks += [r[2] for r in rows[:neighbours]]
    if not ranks:
        return 1, 1.0
    most, ranks = 1, np.array(ranks)
    while (ranks <= most).mean() < recall:
        most += 1
    return most, float((ranks <= most).mean())


def nearest(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, neighbours: int = NEIGHBOURS,
    recall: float = RECALL, fit_rows: int = FIT_ROWS, leaf_rows: int | None = None, calibration: int = CALIBRATION, tile: int = TILE,
) -> DataFrame:
    """For every row whose id is divisible by ``every`` its nearest other rows by cosine: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``,
    and of the whole search ``visits`` and ``calibrated_recall``.

    Equal vectors are searched once and carry their smallest ids, as many as can be in a result. The tree is fitted on a
    bounded sample of the distinct vectors (``fit_rows`` and FIT_NUMBERS numbers at most) down to leaves of about ``leaf_rows`` vectors (by
    default the root of their number, or what the sample can tell apart); every vector goes to its leaf, and leaves are cut into tiles. Up to ``calibration`` queries are compared with all vectors; the number of leaves that a search visits
    is widened until ``recall`` of their true neighbours lie in them. Then each query is sent to that many leaves, best bin first, and
    meets every vector there. Scores are cosines of the original vectors in double precision; ties go to the smaller id.

    Vectors that are NULL, empty, zero or hold NULL, NaN or infinite components take no part, nor do rows with NULL ids.
    Where vectors have several lengths the most frequent one counts (the larger of equals). Repeated rows count once, and
    rows with the query's id are never its neighbours. Where fewer rows than ``neighbours`` exist all are returned. An empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    x = F.col(f"`{vector_col}`").cast("array<double>")
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.when(fit, x).alias("vec")).where("id is not null and vec is not null")
    out = "query_id long, rank int, vec_id long, score double, visits int, calibrated_recall double"
    common = rows.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if common is None:
        return spark.createDataFrame([], out)
    width, keep = common["width"], neighbours + 1

    # distinct vectors, each with the smallest ids that have it and the smallest that asks
    keyed = over_batches(rows.where(F.size("vec") == width), _keyed(width), "id long, key binary, vec array<double>")
    asks = F.col("id") % every == 0
    members = keyed.select("key", "id").distinct()
    ids = members.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("place") <= keep)
    ids = ids.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    vec = keyed.groupBy("key").agg(F.first("vec").alias("vec"), F.min(F.when(asks, F.col("id"))).alias("asks"))
    distinct = stored(vec.join(ids, "key"), "ann-vectors")
    n, n_asking = distinct.agg(F.count("*"), F.count("asks")).first()
    if not n_asking:
        return spark.createDataFrame([], out)

    bound = max(1, min(fit_rows, FIT_NUMBERS // width))
    sample = distinct.where(_chance("key", bound / n)).select("key", "vec").toArrow().sort_by("key").slice(0, bound)
    if not sample.num_rows:
        sample = distinct.select("key", "vec").limit(1).toArrow()
    points = unit(_flat(sample.column("vec").combine_chunks()).reshape(-1, width))
    leaf_rows = leaf_rows or math.isqrt(n)
    tree = Tree.fit(points, max(min(LEAST_LEAF, leaf_rows), leaf_rows * len(points) / n))
    shared = spark.sparkContext.broadcast(tree)

    leaves = over_batches(distinct.select("key", "ids", "vec"), _indexed(shared, width), "key binary, ids array<long>, vec array<double>, leaf int")
    leaves = stored(leaves, "ann-leaves")
    # one row per leaf; a fit sample bounds the leaves
    parts = stored(leaves.groupBy("leaf").agg(F.ceil(F.count("*") / tile).alias("parts")), "ann-parts")
    cut = leaves.join(F.broadcast(parts), "leaf").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    cut = cut.groupBy("leaf", "part").agg(F.collect_list(F.struct("ids", "vec")).alias("m"))
    tiles = stored(cut.select("leaf", "part", F.col("m.ids").alias("ids"), F.transform("m.ids", lambda i: i[0]).alias("first"), F.flatten("m.vec").alias("vec")), "ann-tiles")

    asking = distinct.where("asks is not null").select("key", "vec", "asks")
    some = asking.where(_chance("key", calibration / n_asking)).toArrow().sort_by("key").slice(0, calibration)
    if not some.num_rows:
        some = asking.limit(1).toArrow()
    queries = _flat(some.column("vec").combine_chunks()).reshape(-1, width)
    exact = over_batches(tiles, _exact(spark.sparkContext.broadcast(queries), width, keep), "query int, score double, ids array<long>, leaf int")
    near: dict[int, list] = {}
    for r in _best(exact, "query", keep).collect():
        near.setdefault(r["query"], []).append((r["score"], r["ids"], r["leaf"]))
    visits, reached = calibrated_visits(tree, unit(queries), some.column("asks").to_pylist(), near, neighbours, recall)

    routed = over_batches(asking.select("key", "vec"), _routed(shared, width, visits), "key binary, vec array<double>, leaves array<int>")
    routed = stored(routed.select("key", "vec", F.explode("leaves").alias("leaf")), "ann-visits")
    load = stored(routed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "ann-load")
    blocks = routed.join(F.broadcast(load), "leaf").groupBy("leaf", F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks")).alias("block")).agg(
        F.collect_list(F.struct("key", "vec")).alias("m")).select("leaf", "block", F.col("m.key").alias("keys"), F.flatten("m.vec").alias("asked"))
    # a full leaf spreads over its tiles, and a tile that many queries visit over groups of their blocks
    groups = F.ceil(F.col("blocks") / 64)
    left = blocks.join(F.broadcast(parts), "leaf").join(F.broadcast(load), "leaf").select(
        "leaf", F.pmod("block", groups).alias("team"), "keys", "asked", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    right = tiles.join(F.broadcast(load), "leaf").select("leaf", "part", "ids", "first", "vec", F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)).alias("team"))
    met = left.join(right, ["leaf", "part", "team"]).select("keys", "asked", "ids", "first", "vec")
    found = _best(over_batches(met, _searched(width, keep), "key binary, score double, ids array<long>"), "key", keep)
    result = found.groupBy("key").agg(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("less"), i.alias("id"))))).alias("near"))
    result = stored(result, "ann-results")

    # an asking vector with more than a thousandth of all queries meets its result in several tasks
    asked = members.where(asks)
    total = asked.count()
    hot = asked.groupBy("key").agg(F.ceil(F.count("*") * 1000 / max(total, 1)).alias("shares")).where("shares > 1")
    hot = F.broadcast(stored(hot, "ann-hot"))  # fewer than a thousand rows
    shares = F.coalesce("shares", F.lit(1).cast("long"))
    many = result.join(hot, "key", "left").select("key", "near", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("salt"))
    mine = asked.join(hot, "key", "left").select("key", "id", F.pmod(F.xxhash64("id"), shares).alias("salt"))
    best = F.slice(F.sort_array(F.filter("near", lambda r: r["id"] != F.col("id"))), 1, neighbours)
    return mine.join(many, ["key", "salt"]).select(F.col("id").alias("query_id"), F.posexplode(best).alias("place", "hit")).select(
        "query_id", (F.col("place") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.less")).alias("score"),
        F.lit(visits).alias("visits"), F.lit(reached).alias("calibrated_recall"))
