"""SimHash near-dedup: fingerprints of word shingles, compared tile by tile; for a similarity, links by exact Jaccard."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoretide.llm.common import added, over_batches, row_struct, slices, stored, text_of
from scoretide.llm.components import components, forest

SHINGLE = 3
SEED = 42
RADIUS = 2

# Fingerprints are tiled by the bit counts of their four 16-bit words, so there are at most 17**4 cells.
WORDS = 4
TILE = 1024

# Minimal hashes in a sketch, and how far an estimated similarity may lie below the wanted one: at 0.8 about six deviations,
# as the sketch only finds candidates.
SKETCH = 128
SLACK = 0.21
# Shingles in a tile, about: tasks hold the sets of two tiles.
MASS = 2_000_000
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(text: str, shingle: int, distinct: bool) -> np.ndarray:
    """64-bit hashes of the word shingles of ``text``, letters A-Z in lower case; sorted and each once with ``distinct``. A text
    of fewer words is one shingle."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    grams = zip(*[words[k:] for k in range(shingle)]) if len(words) >= shingle else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(g), SEED) for g in grams), dtype="<u8", count=max(1, len(words) - shingle + 1))
    return np.unique(hashes) if distinct else hashes


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of ``text``, letters A-Z in lower case."""
    return _majority(_hashes(text, shingle, False))


def sketch(hashes: np.ndarray) -> bytes:
    """Low bytes of ``SKETCH`` minimal hashes of distinct shingles."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        mixed = hashes[at : at + 4096, None] * MULTIPLIERS[None, :]
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=0))
    return (least & np.uint64(0xFF)).astype(np.uint8).tobytes()


def _described(text: str, shingle: int) -> tuple[int, bytes, int, bytes]:
    """Fingerprint, sketch, number and digest of the distinct shingles of ``text``."""
    hashes = _hashes(text, shingle, True)
    return _majority(hashes), sketch(hashes), len(hashes), xxhash.xxh3_128_digest(hashes.tobytes())


def fingerprints(
    docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, similar: int | None = None, keep_rows: bool = False,
) -> DataFrame:
    """id, fp and, with ``keep_rows``, the input row as ``row``. With ``similar`` words per shingle fp is that of the distinct
    shingles of so many words, and their ``sketch``, ``size`` and ``digest`` come with it."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                found = list(zip(*(_described(t, similar) for t in texts))) if similar else [[fingerprint(t, shingle) for t in texts]]
                lead = [c for c in part.schema.names if c != "text"]
                columns = [part.column(c) for c in lead] + [pa.array(np.array(found[0], dtype=np.uint64).view(np.int64))]
                columns += [pa.array(x, kind) for x, kind in zip(found[1:], (pa.binary(), pa.int32(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*lead, "fp", *(["sketch", "size", "digest"] if similar else [])])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), *([row_struct(docs)] if keep_rows else []), text_of(f"`{text_col}`").alias("text"))
    return over_batches(rows, work, added(rows, "fp long" + (", sketch binary, size int, digest binary" if similar else "")))


def _word_counts(fp: str) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long"))) for k in range(WORDS)]


def _steps(reach: list[int], total: int | None) -> list[tuple[int, ...]]:
    """Differences of cells that can hold links, one of each pair of opposites."""
    steps = product(*[range(-r, r + 1) for r in reach])
    return [d for d in steps if d >= (0,) * len(reach) and (total is None or sum(map(abs, d)) <= total)]


def links(nodes: DataFrame, counts: list[Column], steps: list[tuple[int, ...]], radius: int, agree: float | None = None, tile: int = TILE) -> DataFrame:
    """(a, b): links between rows of ``nodes`` (node, fp and, with ``agree``, sketch and size) that join the same nodes as all
    pairs within ``radius`` bits do. With ``agree`` instead one row for each pair of tiles that has candidates, pairs within
    ``radius`` bits whose sketches agree in that share at least: (a, b, near), two arrays of nodes and a bit for each pair of them.

    ``counts`` make cells; only cells that differ by one of ``steps`` or its opposite can hold links, so no others meet.
    Cells are cut into tiles of about ``tile`` rows; pairs of tiles are compared in full by exclusive-or and bit counts. A
    pair of tiles gives back stars, so groups of any size give fewer links than they have members in the two tiles.
    """
    names = [f"c{k}" for k in range(len(counts))]
    cells = nodes.select("*", *[c.alias(n) for c, n in zip(counts, names)])
    parts = F.greatest(F.count("*") / tile, F.sum("size") / MASS) if agree else F.count("*") / tile
    sizes = cells.groupBy(*names).agg(F.ceil(parts).alias("parts"))  # at most 17**4 rows, or 65 per size
    cut = cells.join(F.broadcast(sizes), names).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    held = ["node", "fp", *(["sketch"] if agree else [])]  # sizes are only for the cells
    tiles = cut.groupBy(*names, "part").agg(F.collect_list(F.struct(*held)).alias("m")).select(*names, "part", *[F.col(f"m.{h}").alias(h) for h in held])
    tiles = stored(tiles, "tiles")

    step = F.explode(F.array(*[F.array(*[F.lit(x) for x in d]) for d in steps])).alias("step")
    left = tiles.select(*names, F.col("part").alias("part_a"), *[F.col(h).alias(f"{h}_a") for h in held], step)
    left = left.select(*[(F.col(n) + F.col("step")[k]).alias(n) for k, n in enumerate(names)], "part_a", *[f"{h}_a" for h in held],
                       F.forall("step", lambda x: x == 0).alias("same"))
    pairs = left.join(tiles, names).where(~F.col("same") | (F.col("part") >= F.col("part_a")))
    pairs = pairs.select(*[f"{h}_a" for h in held], *held, (F.col("same") & (F.col("part") == F.col("part_a"))).alias("own"))

    def numbers(column: pa.Array, k: int) -> np.ndarray:
        return column[k].values.to_numpy(zero_copy_only=False).view(np.uint64)

    def sketches(column: pa.Array, k: int) -> np.ndarray:
        return np.frombuffer(b"".join(column[k].values.to_pylist()), np.uint8).reshape(-1, SKETCH)

    def alike(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose sketches agree. Bytes differ wherever their lowest bits do, so these leave few pairs to compare."""
        low_x, low_y = (np.packbits(z & 1, axis=1).view(np.uint64) for z in (x, y))
        differ = np.bitwise_count(low_x[i, 0] ^ low_y[j, 0]) + np.bitwise_count(low_x[i, 1] ^ low_y[j, 1])
        near = differ <= SKETCH - agree * SKETCH
        i, j = i[near], j[near]
        near = [(x[i[at : at + 65_536]] == y[j[at : at + 65_536]]).sum(axis=1) for at in range(0, len(i), 65_536)]
        near = np.concatenate([np.zeros(0, int), *near]) >= agree * SKETCH
        return i[near], j[near]

    def candidates(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        (of_a, i), (of_b, j) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
        near = np.zeros((len(of_a), len(of_b)), dtype=bool)
        near[i, j] = True
        columns = [pa.array([x.view(np.int64)], pa.list_(pa.int64())) for x in (a[of_a], b[of_b])]
        return pa.RecordBatch.from_arrays([*columns, pa.array([np.packbits(near).tobytes()], pa.binary())], names=["a", "b", "near"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, out_a, out_b = batch.column("own").to_pylist(), [], []
            for k in range(batch.num_rows):
                a, b = numbers(batch.column("fp_a"), k), numbers(batch.column("fp"), k)
                i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
                if own[k]:
                    keep = i < j
                    i, j = i[keep], j[keep]
                if agree:
                    i, j = alike(sketches(batch.column("sketch_a"), k), sketches(batch.column("sketch"), k), i, j)
                    if len(i):
                        yield candidates(numbers(batch.column("node_a"), k), numbers(batch.column("node"), k), i, j)
                    continue
                if len(i):
                    names_of = numbers(batch.column("node_a"), k)
                    if not own[k]:
                        j, names_of = j + len(a), np.concatenate([names_of, numbers(batch.column("node"), k)])
                    i, j = forest(i, j, len(names_of))
                    out_a.append(names_of[i])
                    out_b.append(names_of[j])
            if agree:
                continue
            none = [np.zeros(0, np.uint64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or none).view(np.int64)) for x in (out_a, out_b)], names=["a", "b"])

    return over_batches(pairs, work, "a array<long>, b array<long>, near binary" if agree else "a long, b long")


def _joined(a: list[int], b: list[int], near: bytes, sets: dict[int, np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join the same nodes as all pairs of ``near`` whose sets have a Jaccard similarity of ``similarity`` do. A pair
    that earlier links join needs no look."""
    nodes = list(dict.fromkeys([*a, *b]))
    at = {node: k for k, node in enumerate(nodes)}
    ends = np.cumsum([0, *(len(sets[node]) for node in nodes)])
    kinds, codes = np.unique(np.concatenate([sets[node] for node in nodes]), return_inverse=True)
    own = [codes[ends[k] : ends[k + 1]] for k in range(len(nodes))]
    size, low, has, out = np.diff(ends), np.arange(len(nodes)), np.zeros(len(kinds), dtype=bool), []
    of_b = np.array([at[node] for node in b])
    table = np.unpackbits(np.frombuffer(near, np.uint8), count=len(a) * len(b)).reshape(len(a), len(b)).astype(bool)
    for node, row in zip(a, table):
        x, others = at[node], of_b[row]
        others = others[(low[others] != low[x]) & (np.minimum(size[others], size[x]) >= similarity * np.maximum(size[others], size[x]) - 1)]
        if not len(others):
            continue
        has[own[x]] = True
        for y in others.tolist():
            if low[y] != low[x]:
                common = np.count_nonzero(has[own[y]])
                if common / (size[x] + size[y] - common) >= similarity:
                    low[low == low[y]] = low[x]
                    out.append((node, nodes[y]))
        has[own[x]] = False
    return out


def exact_links(found: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): links that join the same nodes as all candidate pairs of ``found`` (as ``links`` gives them) do whose distinct
    shingles have a Jaccard similarity of ``similarity`` at least. ``texts`` has node and text.

    Only texts of candidates are read, and each set of 64-bit hashes goes to the pairs of tiles that have its node.
    """
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [_hashes(t, shingle, True).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], names=["node", "hashes"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b, near, members = (batch.column(c)[k] for c in ("a", "b", "near", "m"))
                sets = {node: np.frombuffer(x, "<u8") for node, x in zip(*(members.values.field(n).to_pylist() for n in ("node", "hashes")))}
                out = _joined(a.as_py(), b.as_py(), near.as_py(), sets, similarity)
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], pa.int64()) for n in (0, 1)], names=["a", "b"])

    found = stored(found, "candidates").withColumn("pair", F.monotonically_increasing_id())
    members = found.select("pair", F.explode(F.array_union("a", "b")).alias("node"))
    sets = stored(over_batches(texts.join(members.select("node").distinct(), "node"), hashed, "node long, hashes binary"), "sets")
    whole = members.join(sets, "node").groupBy("pair").agg(F.collect_list(F.struct("node", "hashes")).alias("m"))
    return over_batches(found.join(whole, "pair").select("a", "b", "near", "m"), work, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS,
    similarity: float | None = None, similar: int = 5, keep_rows: bool = False,
) -> DataFrame:
    """One row per input row: the id, ``fingerprint`` (16 hex digits), ``component_id``, ``kept`` and, with ``keep_rows``, the
    input row as ``row``.

    Fingerprints link when they differ in at most ``radius`` bits; ``component_id`` is the smallest id that links reach. One
    row of each component has ``kept``: the one with the smallest id, then fingerprint, then place in the input.

    Without ``similarity`` tiles go by the bit counts of the fingerprints' four words, whose differences add up to no more than
    the radius. With ``similarity`` a link is a Jaccard similarity of that or more between the sets of ``similar``-word shingles,
    counted exactly (on 64-bit hashes of the shingles). Fingerprints of these sets within ``radius`` bits and 128 minimal hashes
    that agree in ``similarity`` less ``SLACK`` only find the candidates; tiles go by the number of shingles, in steps of that
    share, and by ranges of the bit count as wide as the radius. ``fingerprint`` is then that of the set.

    NULL and empty texts have fingerprint zero, which links like any other. NULL ids never become a component id unless
    all ids of a component are NULL. Repeated rows share a fingerprint. An empty table gives an empty result.
    """
    rows = fingerprints(docs, id_col, text_col, shingle, similar if similarity else None, keep_rows or bool(similarity))
    rows = stored(rows.withColumn("place", F.monotonically_increasing_id()), "fp")
    key = "digest" if similarity else "fp"  # equal digests are equal sets
    first = F.min(F.struct(F.col("id").isNull().alias("lost"), "id", "fp", "place"))
    more = [F.min(c).alias(c) for c in ("fp", "sketch", "size")] if similarity else []
    distinct = stored(rows.groupBy(key).agg(first.alias("first"), F.min("place").alias("node"), *more), "fps")
    if similarity:
        size = F.floor(F.log(F.greatest(F.col("size"), F.lit(1))) / -math.log(similarity)).cast("int")
        ones = F.floor(F.bit_count("fp") / (radius + 1)).cast("int")  # further apart than next to each other is beyond the radius
        found = links(distinct.select("node", "fp", "sketch", "size"), [size, ones], _steps([1, 1], None), radius, similarity - SLACK)
        texts = rows.select(F.col("place").alias("node"), text_of(f"row.`{text_col}`").alias("text"))
        found = exact_links(found, texts, similar, similarity)
    else:
        found = links(distinct.select("node", "fp"), _word_counts("fp"), _steps([radius] * WORDS, radius), radius)
    roots = components(found).withColumnRenamed("node", "member")
    rooted = distinct.join(roots, distinct["node"] == roots["member"], "left").select(key, "first", F.coalesce("root", "node").alias("root"))
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    known = stored(rooted.join(best, "root").select(key, "best"), "classes")
    out = rows.join(known, key).withColumn("kept", F.col("place") == F.col("best.place"))
    return out.select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.id").alias("component_id"), "kept",
        *(["row"] if keep_rows else []),
    )
