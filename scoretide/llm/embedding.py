"""Embedding near-dedup: int8 tile products with error bounds, full precision where they leave a doubt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoretide.llm.common import over_batches, stored
from scoretide.llm.components import components, forest

THRESHOLD = 0.93
TILE = 1024

# Products of 8-bit codes add up exactly in single precision up to this dimension (127 * 127 * 1040 < 2**24).
SINGLE = 1040

# Pairs recomputed at once.
CHUNK = 65_536


class Tile:
    """Unit vectors in double precision, their int8 codes, and for each vector a bound on what the codes leave out."""

    def __init__(self, vectors: np.ndarray) -> None:
        scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        self.unit = scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]
        step = np.abs(self.unit).max(axis=1) / 127
        codes = np.rint(self.unit / step[:, None]).astype(np.int8)
        back = codes * step[:, None]
        self.step, self.size = step, np.sqrt(np.einsum("ij,ij->i", back, back))
        rest = self.unit - back
        self.error = np.sqrt(np.einsum("ij,ij->i", rest, rest)) * (1 + 1e-9) + 1e-12
        self.codes = codes.astype(np.float32 if vectors.shape[1] <= SINGLE else np.float64)


def tile_links(a: Tile, b: Tile, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs with a cosine of at least ``threshold``.

    With u = u' + e and w = w' + f for codes u', w', |u.w - u'.w'| <= |e| |w| + |u'| |f|. Only pairs that this bound leaves
    possible are computed in double precision.
    """
    about = (a.codes @ b.codes.T) * a.step[:, None] * b.step[None, :]
    bound = a.error[:, None] * (1 + 1e-9) + a.size[:, None] * b.error[None, :]
    i, j = np.nonzero(about + bound >= threshold - 1e-9)
    sure = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), CHUNK):
        part = slice(at, at + CHUNK)
        sure[part] = np.einsum("ij,ij->i", a.unit[i[part]], b.unit[j[part]]) >= threshold
    return i[sure], j[sure]


def _work(threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = {name: batch.column(name) for name in ("ids_a", "vec_a", "n_a", "ids", "vec", "n")}
            dim, own = batch.column("dim").to_pylist(), batch.column("own").to_pylist()
            for k in range(batch.num_rows):
                got = {name: column[k].values.to_numpy(zero_copy_only=False) for name, column in held.items()}
                a = Tile(got["vec_a"].reshape(-1, dim[k]))
                b = a if own[k] else Tile(got["vec"].reshape(-1, dim[k]))
                i, j = tile_links(a, b, threshold)
                if own[k]:
                    keep = i != j
                    i, j = i[keep], j[keep]
                    uid, links = got["ids_a"], np.bincount(i, got["n_a"][j], len(got["ids_a"]))
                    x, y = forest(i, j, len(uid))
                else:
                    uid = np.concatenate([got["ids_a"], got["ids"]])
                    links = np.concatenate([np.bincount(i, got["n"][j], len(got["ids_a"])), np.bincount(j, got["n_a"][i], len(got["ids"]))])
                    x, y = forest(i, j + len(got["ids_a"]), len(uid))
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([uid[some], uid[x]])),
                    pa.array(np.concatenate([np.zeros(len(some), dtype=np.int64), uid[y]]), mask=np.arange(len(some) + len(x)) < len(some)),
                    pa.array(np.concatenate([links[some].astype(np.int64), np.zeros(len(x), dtype=np.int64)])),
                ], names=["a", "b", "n"])

    return work


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD,
    tile: int = TILE,
) -> DataFrame:
    """One row per input row: the id, ``n_links`` (other rows linked directly), ``component_id`` (smallest id reached) and ``kept``.

    Rows link when their labels are equal and not NULL and the cosine of their vectors is at least ``threshold`` in double
    precision. Equal vectors of a label are compared once and counted as often as they occur. Each label is cut into
    tiles, every pair of tiles is multiplied as int8 codes, and pairs that the error bounds leave open are computed in full.
    A pair of tiles gives back a count per vector and stars, never all its links.

    Vectors that are NULL, empty, zero, or hold NULL, NaN or infinite components, and vectors of different lengths, link
    with nothing; such a row has 0 links and its own id as component. NULL ids count as rows but name no component
    unless all its ids are NULL. Repeated rows link with each other. An empty table gives an empty result.
    """
    x = F.col(f"`{vector_col}`").cast("array<double>")
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.when(fit & F.col(f"`{label_col}`").isNotNull(), x).alias("vec"))
    first = F.min(F.struct(F.col("id").isNull().alias("lost"), "id")).alias("first")
    distinct = rows.where("vec is not null").groupBy("label", "vec").agg(F.count("*").alias("n"), first)
    distinct = stored(distinct.withColumn("uid", F.monotonically_increasing_id()), "vectors")

    sizes = distinct.groupBy("label", F.size("vec").alias("dim")).agg(F.ceil(F.count("*") / tile).alias("parts"))
    cut = distinct.select("uid", "n", "label", "vec", F.size("vec").alias("dim")).join(sizes, ["label", "dim"])
    cut = cut.withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts"))).groupBy("label", "dim", "part", "parts").agg(
        F.collect_list(F.struct("uid", "n", "vec")).alias("m"))
    tiles = stored(cut.select("label", "dim", "part", "parts", F.col("m.uid").alias("ids"), F.flatten("m.vec").alias("vec"), F.col("m.n").alias("n")), "tiles")
    left = tiles.select("label", "dim", F.col("part").alias("part_a"), *[F.col(c).alias(f"{c}_a") for c in ("ids", "vec", "n")],
                        F.explode(F.sequence("part", F.col("parts") - 1)).alias("part"))
    pairs = left.join(tiles.drop("parts"), ["label", "dim", "part"]).select(
        "dim", "ids_a", "vec_a", "n_a", "ids", "vec", "n", (F.col("part") == F.col("part_a")).alias("own"))
    found = stored(over_batches(pairs, _work(threshold), "a long, b long, n long"), "found")

    counts = found.where("b is null").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("near"))
    roots = components(found.where("b is not null").select("a", "b"))
    known = distinct.join(counts, "uid", "left").join(roots, distinct["uid"] == roots["node"], "left").select(
        "label", "vec", "first", (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "uid").alias("root"))
    best = known.groupBy("root").agg(F.min("first").alias("best"))
    known = known.join(best, "root").select("label", "vec", "n_links", F.col("best.id").alias("component_id"))
    return rows.join(known, ["label", "vec"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
