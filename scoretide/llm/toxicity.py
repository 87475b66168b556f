"""Toxicity scores from class-conditional Kneser-Ney models with shared backoff counts."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoretide.llm.common import added, over_batches, row_struct, slices, stored, text_of

# Terms of a kind up to which models are broadcast; those with more stay tables that the texts' terms are joined to.
TERMS = 400_000

# Terms of documents that a task gathers before it hands on their counts, and rows that it hands on at once.
COUNTED, TOLD = 6_000_000, 65_536

# Documents whose terms are told apart in one pass: with it, numbers of a document and two words fit into 64 bits.
TOGETHER = 512

# Scripts that are written without spaces: each of their characters is a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
ALONE, WITHIN = re.compile(f"[{UNSPACED}]"), re.compile("[^\\W_]|'")

# Kinds of terms, and the discount of each in documents of the smaller class.
DISCOUNT = {"word": 1.0, "pair": 4.0, "letters": 8.0}
LETTERS = 6

KNOWN_WORDS = 500_000
FEATURES = 3


class Cuts(dict):
    """What each character becomes before a text is split into words: a word of its own, a part of one, or a space."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        self[code] = f" {char} " if ALONE.match(char) else char if WITHIN.match(char) else " "
        return self[code]


CUTS = Cuts()


CUT = np.full(0x110000, -1, np.int32)  # the same by code, as far as met: -1 not met, 0 a word of its own


def words_of(text: str) -> list[str]:
    text = text.lower()
    if not text.isascii():
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        found = CUT[codes]
        if found.min() < 0:
            for code in np.unique(codes[found < 0]).tolist():
                CUT[code] = 0 if len(CUTS[code]) > 1 else ord(CUTS[code])
            found = CUT[codes]
        if found.all():
            return found.tobytes().decode("utf-32-le", "surrogatepass").split()
    return text.translate(CUTS).split()


def letter_runs(word: str) -> list[str]:
    """All runs of six letters of a word between its two marks; the whole of a shorter one."""
    marked = f"^{word}$"
    return [marked[i : i + LETTERS] for i in range(max(1, len(marked) - LETTERS + 1))]


def terms(text: str) -> dict[str, set]:
    """The distinct words, pairs of neighbouring words and letter runs of a text."""
    words = words_of(text)
    kinds = set(words)
    return {"word": kinds, "pair": {f"{a} {b}" for a, b in zip(words, words[1:])}, "letters": set().union(*map(letter_runs, kinds))}


def class_probabilities(toxic: float, ordinary: float, total: dict, discount: float) -> tuple[float, float]:
    """(P(term | toxic), P(term | ordinary)) by Kneser-Ney smoothing of document counts.

    Counts of both classes are scaled to classes of one size. From each count the discount is taken, or all of it if it is less; what is
    left, over its sum in the class, has the share 1 - g. The share g that the discounts took from both classes together goes to the
    counts of both classes together, S: P_c = (1 - g) max(c - D, 0) / K_c + g S. So a rare term is as likely in either class.
    """
    shared = (toxic + ordinary) / total["all"]
    g = 1 - (total["toxic"] + total["ordinary"]) / total["all"]
    return tuple((1 - g) * max(c - discount, 0) / total[k] + g * shared if total[k] else shared for k, c in (("toxic", toxic), ("ordinary", ordinary)))


class Numbers(defaultdict):
    """Numbers of the strings met so far, in the order in which they were met."""

    def __init__(self, names: list[str] = ()) -> None:
        super().__init__(count(len(names)).__next__, zip(names, range(len(names))))

    def since(self, n: int) -> list[str]:
        """All strings but the first ``n``."""
        return list(islice(reversed(self), len(self) - n))[::-1]


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.flatnonzero(np.diff(values, prepend=values[0] - 1))] if len(values) else values


def numbered(texts: list[str], number: Numbers) -> tuple[np.ndarray, ...]:
    """The distinct words of some texts as (text, word) and their distinct pairs of neighbours as (text, word, next word), in order."""
    words = [words_of(text) for text in texts]
    size = np.fromiter(map(len, words), np.int64, len(words))
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, size.sum())
    of, scale = np.repeat(np.arange(len(words)), size), max(len(number), 1)
    own = of * scale + ids
    inner = of[1:] == of[:-1]
    single, double = distinct(own), distinct(own[:-1][inner] * scale + ids[1:][inner])
    first = double // scale
    return single // scale, single % scale, first // scale, first % scale, double % scale


def ratios(counts: list[dict], totals: dict[str, dict]) -> Iterator[tuple[str, str, float]]:
    """(kind, term, log P(term | toxic) - log P(term | ordinary))."""
    for r in counts:
        toxic, ordinary = class_probabilities(r["toxic"], r["ordinary"], totals[r["kind"]], DISCOUNT[r["kind"]])
        if toxic and ordinary:
            yield r["kind"], r["term"], math.log(toxic / ordinary)


class Model:
    """log P(toxic) - log P(ordinary) of words and pairs of words. A word that the discount leaves nothing of backs off to its letter runs,
    over whose number its log-likelihoods are normalised; a pair of that kind is as likely in either class."""

    def __init__(self, counts: list[dict], totals: dict[str, dict]) -> None:
        self._take(ratios(counts, totals))

    @classmethod
    def of_ratios(cls, terms: Iterator[tuple[str, str, float]]) -> Model:
        model = cls([], {})
        model._take(terms)
        return model

    def _take(self, terms: Iterator[tuple[str, str, float]]) -> None:
        self.ratio: dict[str, dict[str, float]] = {kind: {} for kind in DISCOUNT}
        for kind, term, ratio in terms:
            self.ratio[kind][term] = ratio
        # Pairs by the numbers of their words, which come first of all words met.
        pairs, number = self.ratio.pop("pair"), Numbers()
        ids = np.fromiter(map(number.__getitem__, " ".join(pairs).split()), np.int64, 2 * len(pairs))
        keys, values = ids[::2] * len(number) + ids[1::2], np.fromiter(pairs.values(), float, len(pairs))
        order = np.argsort(keys)
        self.paired, self.keys, self.values = list(number), keys[order], values[order]
        self.known, self.worth = None, np.zeros(0)  # words met by a worker

    def word(self, word: str) -> float:
        known = self.ratio["word"].get(word)
        if known is None:
            runs, known = self.ratio["letters"], 0.0
            if runs:
                cut = letter_runs(word)
                known = math.fsum([runs.get(run, 0.0) for run in cut]) / len(cut)
        return known

    def pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Ratios of pairs by the numbers of their words, 0 where the model has none."""
        out, n = np.zeros(len(first)), len(self.paired)
        some = np.flatnonzero((first < n) & (second < n))
        if len(some):
            keys = first[some] * n + second[some]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            out[some] = np.where(self.keys[at] == keys, self.values[at], 0.0)
        return out

    def features(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood ratios per text: the sum over its distinct words by the root of their number, the largest of them, and the sum over its
        distinct pairs by the root of their number. Sums take what stands above 1 and is not chance."""
        return np.concatenate([np.zeros((0, FEATURES)), *[self._features(texts[k : k + TOGETHER]) for k in range(0, len(texts), TOGETHER)]])

    def _features(self, texts: list[str]) -> np.ndarray:
        if self.known is None or len(self.known) > len(self.paired) + KNOWN_WORDS:
            self.known, self.worth = Numbers(self.paired), np.zeros(0)
        of, word, of_pair, first, second = numbered(texts, self.known)
        new = self.known.since(len(self.worth))
        self.worth = np.concatenate([self.worth, np.fromiter(map(self.word, new), float, len(new))])
        each, n = self.worth[word], len(texts)
        most, starts = np.zeros(n), np.flatnonzero(np.diff(of, prepend=-1))
        if len(of):
            most[of[starts]] = np.maximum.reduceat(each, starts)
        return np.stack([above(of, each, n), most, above(of_pair, self.pairs(first, second), n)], axis=1)


def above(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Per text, by which ``values`` are ordered: what they have above 1, summed exactly, by the root of their number."""
    high = values > 1
    ends = np.cumsum(np.bincount(of[high], minlength=n)).tolist()
    held = (values[high] - 1).tolist()
    sums = [math.fsum(held[a:b]) for a, b in zip([0, *ends], ends)]
    return np.array(sums) / np.sqrt(np.maximum(np.bincount(of, minlength=n), 1))


TERM_RATIO = "kind string, term string, ratio double"


@dataclass
class WideModel:
    """The same models with more terms than a broadcast may hold: ``table`` has kind, term and ratio."""

    table: DataFrame

    def met(self, texts: DataFrame) -> DataFrame:
        """(chunk, kind, term, ratio) of the words and pairs of the texts of each chunk that have a ratio, words by their letter runs where
        they have none of their own. A chunk tells a term once, so what is joined is far less than the texts' terms."""
        told = lambda *kinds: over_batches(texts.select("chunk", "text"), _chunk_terms(*kinds), "chunk long, kind string, term string")
        own = self.table.where("kind <> 'letters'")
        unknown = told("word").select("term").distinct().join(own.where("kind = 'word'"), "term", "left_anti")
        # by number from here on: a word may be far longer than its runs
        unknown = stored(unknown.withColumn("word", F.monotonically_increasing_id()), "tox-unknown")
        runs = over_batches(unknown.select("word", "term"), _runs_of, "word long, term string")
        found = runs.join(self.table.where("kind = 'letters'"), "term").groupBy("word").agg(F.collect_list("ratio").alias("found"))
        size = F.greatest(F.lit(1), F.length("term") + 3 - LETTERS)
        backed = over_batches(unknown.select("word", "term", size.alias("size")).join(found, "word").drop("word"), _backed_off, TERM_RATIO)
        return told("word", "pair").join(own.unionByName(backed), ["kind", "term"]).select("chunk", "kind", "term", "ratio")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the number of their chunk, which holds texts of about 4 MB together, or one longer text."""
    number = count(TaskContext.get().partitionId() << 40)
    for batch in batches:
        for part in slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, next(number)))], names=[*part.schema.names, "chunk"])


def _chunk_terms(*kinds: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, "text")):
            of, texts = part.column("chunk").to_numpy(), part.column("text").to_pylist()
            for number in np.unique(of).tolist():
                words = [words_of(texts[i]) for i in np.flatnonzero(of == number).tolist()]
                for kind in kinds:
                    every = list(set().union(*words) if kind == "word" else {f"{a} {b}" for w in words for a, b in zip(w, w[1:])})
                    for k in range(0, len(every), TOLD):
                        some = every[k : k + TOLD]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number)), pa.array([kind] * len(some)), pa.array(some)], names=["chunk", "kind", "term"])

    return work


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, word in zip(batch.column("word").to_pylist(), batch.column("term").to_pylist()):
            runs = letter_runs(word)
            for k in range(0, len(runs), TOLD):
                some = runs[k : k + TOLD]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number)), pa.array(some)], names=["word", "term"])


def _backed_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        mean = [math.fsum(found) / size for found, size in zip(batch.column("found").to_pylist(), batch.column("size").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(["word"] * len(mean), pa.string()), batch.column("term"), pa.array(mean, pa.float64())], names=["kind", "term", "ratio"])


def over_texts(rows: DataFrame, model: Model | WideModel, shape: Callable[[np.ndarray], list[np.ndarray]], columns: str) -> DataFrame:
    """``rows`` without their text and with ``columns``, which ``shape`` makes of the texts' features."""
    schema, names = added(rows, columns), [c.split()[0] for c in columns.split(", ")]

    def featured(of: Model, part: pa.RecordBatch | pa.Table) -> list:
        lead = [part.column(c) for c in schema.names if c not in names]
        return [*lead, *[pa.array(x, pa.float64()) for x in shape(of.features(part.column("text").to_pylist()))]]

    if isinstance(model, Model):
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    yield pa.RecordBatch.from_arrays(featured(shared.value, part), names=schema.names)

        return over_batches(rows, work, schema)

    texts = stored(over_batches(rows, _chunks, T.StructType([*rows.schema.fields, T.StructField("chunk", T.LongType())])), "tox-texts")

    def joined(part: pa.Table, terms: pa.Table) -> pa.Table:
        own = Model.of_ratios(zip(*[terms.column(c).to_pylist() for c in ("kind", "term", "ratio")]))
        return pa.Table.from_arrays(featured(own, part), names=schema.names)

    return texts.groupBy("chunk").cogroup(model.met(texts).groupBy("chunk")).applyInArrow(joined, schema)


class Scorer:
    """The models and the weights that turn their features into a probability."""

    def __init__(self, model: Model | WideModel, centre: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> None:
        self.model, self.centre, self.scale, self.weights = model, centre, scale, weights

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        x = (rows - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -500, 500)))


def logistic(rows: DataFrame, names: list[str], weight: dict[int, float], ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights of a ridge logistic regression of ``label`` on the columns ``names``, by Newton steps.

    A step is one pass over the rows. Sums are of whole multiples of 2**-40, so the order of the rows does not show in them.
    """
    unit, n = 2.0**40, rows.count()

    def sums(cells: list[Column]) -> np.ndarray:
        found = rows.agg(*[F.sum(F.rint(c * unit).cast("decimal(38,0)")).alias(f"s{i}") for i, c in enumerate(cells)]).first()
        return np.array([float(v) for v in found]) / unit

    centre = sums([F.col(c) for c in names]) / n
    scale = np.sqrt(sums([(F.col(c) - float(m)) * (F.col(c) - float(m)) for c, m in zip(names, centre)]) / n) + 1e-9
    z = [F.lit(1.0), *[(F.col(c) - float(m)) / float(d) for c, m, d in zip(names, centre, scale)]]
    own = F.when(F.col("label") == 1, F.lit(weight[1])).otherwise(F.lit(weight[0]))
    upper = np.triu_indices(len(z))
    keep, w = np.diag([1e-6] + [ridge] * len(names)), np.zeros(len(z))
    for _ in range(50):
        margin = sum((float(a) * c for a, c in zip(w[1:], z[1:])), F.lit(float(w[0])))
        p = 1 / (1 + F.exp(-F.least(F.greatest(margin, F.lit(-500.0)), F.lit(500.0))))
        found = sums([own * (p - F.col("label")) * c for c in z] + [own * p * (1 - p) * z[i] * z[j] for i, j in zip(*upper)])
        curve = np.zeros((len(z), len(z)))
        curve[upper] = found[len(z) :]
        step = np.linalg.solve(np.triu(curve) + np.triu(curve, 1).T + keep, found[: len(z)] + keep @ w)
        w = w - step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, w


def held_out(id_col: Column) -> Column:
    """Rows whose label no model may see."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> tuple[DataFrame, dict[int, int]]:
    """Texts of all labelled documents that are not held out, and the class sizes."""
    own = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    own = own.where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label")).where(~held_out(F.col("id")))
    sizes = {r.label: r.n for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    return docs.where(F.col("id").isNotNull() & ~held_out(F.col("id"))).join(own.hint("shuffle_merge"), "id"), sizes


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, term, toxic, ordinary): in how many documents of either class, in parts; with no term, the sums of a part.

    Words and letter runs are numbered; a term of a document is gathered as its number and the document's label, and what is gathered is
    sorted and counted."""
    number, runs, cut = Numbers(), Numbers(), []  # per word, the numbers of its letter runs
    gathered: dict[str, list[np.ndarray]] = {kind: [] for kind in DISCOUNT}

    def gather(texts: list[str], label: np.ndarray) -> None:
        of, word, of_pair, first, second = numbered(texts, number)
        cut.extend(np.array(list(map(runs.__getitem__, letter_runs(w))), np.int64) for w in number.since(len(cut)))
        own = [cut[w] for w in word.tolist()]
        size = np.fromiter(map(len, own), np.int64, len(own))
        letters = distinct(np.repeat(of, size) * max(len(runs), 1) + np.concatenate([np.zeros(0, np.int64), *own]))
        gathered["word"].append((word * 2 + label[of]).astype(np.int32))
        gathered["pair"].append((first << 32 | second << 1) + label[of_pair])
        gathered["letters"].append((letters % max(len(runs), 1) * 2 + label[letters // max(len(runs), 1)]).astype(np.int32))

    def told() -> Iterator[pa.RecordBatch]:
        names = pa.array(list(number), pa.string())
        for kind, parts in gathered.items():
            keys, n = np.unique(np.concatenate([np.zeros(0, np.int32), *parts]), return_counts=True)
            parts.clear()
            label, keys = keys & 1, keys >> 1
            new = np.diff(keys, prepend=-1) > 0
            counts = np.zeros((2, new.sum() + 1), np.int64)
            np.add.at(counts, (label, 0), n)
            counts[label, np.cumsum(new)] = n
            keys = keys[new]
            if kind == "pair":
                terms = pc.binary_join_element_wise(names.take(pa.array(keys >> 31)), names.take(pa.array(keys & (2**31 - 1))), " ")
            else:
                terms = (names if kind == "word" else pa.array(list(runs), pa.string())).take(pa.array(keys))
            terms = pa.concat_arrays([pa.nulls(1, pa.string()), terms])
            for k in range(0, len(terms), TOLD):
                some = terms[k : k + TOLD]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind)), some, *[pa.array(counts[c, k : k + TOLD]) for c in (1, 0)]], names=["kind", "term", "toxic", "ordinary"])

    for batch in batches:
        for part in slices(batch, "text"):
            label, texts = part.column("label").to_numpy().astype(np.int64), part.column("text").to_pylist()
            for k in range(0, len(texts), TOGETHER):
                gather(texts[k : k + TOGETHER], label[k : k + TOGETHER])
            if sum(len(x) for parts in gathered.values() for x in parts) > COUNTED:
                yield from told()
                number, runs, cut = Numbers(), Numbers(), []
    yield from told()


def term_table(rows: DataFrame) -> tuple[DataFrame | None, dict[str, dict]]:
    """All terms that a discount leaves something of, with their counts scaled to the smaller class, as a table; and per kind how many
    they are and the sums that probabilities need. No table unless there are both classes.

    ``rows``: text and label. The counts of all other terms are in the sums.
    """
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    least = min(sizes.get(0, 0), sizes.get(1, 0))
    if not least:
        return None, {}
    counts = over_batches(rows.select("label", "text"), _counted, "kind string, term string, toxic long, ordinary long")
    counts = counts.repartition("kind", "term")  # a task's terms are counted already, so no aggregate comes before the shuffle
    counts = counts.groupBy("kind", "term").agg((F.sum("toxic") * F.lit(least / sizes[1])).alias("toxic"), (F.sum("ordinary") * F.lit(least / sizes[0])).alias("ordinary"))
    discount = F.coalesce(*[F.when(F.col("kind") == k, F.lit(d)) for k, d in DISCOUNT.items()])
    counts = counts.withColumn("discount", discount).where(F.col("term").isNull() | (F.greatest("toxic", "ordinary") > F.col("discount")))
    counts = stored(counts, "tox-terms")
    left = lambda c: F.sum(F.when(F.col("term").isNull(), F.lit(0.0)).otherwise(F.greatest(F.col(c) - F.col("discount"), F.lit(0.0))))
    every = F.sum(F.when(F.col("term").isNull(), F.col("toxic") + F.col("ordinary")))
    totals = counts.groupBy("kind").agg(every.alias("all"), left("toxic").alias("toxic"), left("ordinary").alias("ordinary"), F.count("term").alias("terms"))
    return counts.where("term is not null").select("kind", "term", "toxic", "ordinary"), {r["kind"]: r.asDict() for r in totals.collect()}


def term_counts(rows: DataFrame) -> tuple[list[dict], dict[str, dict]]:
    """The terms of ``term_table``, all of them, as rows on the driver, and its sums."""
    table, totals = term_table(rows)
    return table.toArrow().to_pylist() if table else [], totals


def class_models(rows: DataFrame) -> Model | WideModel | None:
    """The models of ``rows``, with every term; None where they have none."""
    table, totals = term_table(rows)
    if not any(t["terms"] for t in totals.values()):
        return None
    if max(t["terms"] for t in totals.values()) <= TERMS:
        return Model(table.toArrow().to_pylist(), totals)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [*zip(*ratios(batch.to_pylist(), totals))] or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.string()), pa.array(found[2], pa.float64())], names=["kind", "term", "ratio"])

    return WideModel(stored(over_batches(table, work, TERM_RATIO), "tox-ratios"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> Scorer | None:
    """Models from three quarters of the labelled documents, weights from the rest; None unless both parts have both classes.

    ``docs`` has the columns id and text.
    """
    rows, sizes = labelled(docs, labels, id_col, label_col)
    rows = stored(rows.select("text", "label", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)) > 0).alias("fitted")), "tox-labelled")
    model = class_models(rows.where("fitted"))
    if model is None:
        return None
    names = [f"x{i}" for i in range(FEATURES)]
    held = over_texts(rows.where("not fitted").select("text", "label"), model, lambda x: [*x.T], ", ".join(f"{n} double" for n in names))
    held = stored(held, "tox-features")
    seen = {r.label: r.n for r in held.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        return None
    weight = {k: sizes[k] / n * sum(seen.values()) / sum(sizes.values()) for k, n in seen.items()}
    return Scorer(model, *logistic(held, names, weight))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    keep_rows: bool = False,
) -> DataFrame:
    """One row per input row: the id, ``held_out``, ``score``, ``predicted`` and, with ``keep_rows``, the input row as ``row``.

    Two Kneser-Ney models, one per class, of words, pairs of words and runs of letters are fitted on all labelled documents
    but those whose id has a CRC-32 divisible by five. Whole words count, however long; a character of a script
    without spaces is a word. A document's log-likelihood ratios, normalised by length, go through a logistic regression fitted
    on labelled documents that those models have not seen. Only the text is an input.
    Models of up to ``TERMS`` terms of a kind are broadcast; the terms of larger ones stay tables, and scores are the same either way.

    A NULL text is an empty one and gets a score like any other. NULL ids count as held out. Repeated rows are scored
    each; labels that disagree count as toxic, NULL labels as none. If labels of either class are lacking, all scores are 0.
    An empty table gives an empty result.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), *([row_struct(docs)] if keep_rows else []),
        text_of(f"`{text_col}`").alias("text"),
    )
    scorer = fit(rows.select("id", "text"), labels, id_col, label_col)
    out = rows.drop("text").withColumn("score", F.lit(0.0))
    if scorer:
        weigh = Scorer(None, scorer.centre, scorer.scale, scorer.weights)
        out = over_texts(rows, scorer.model, lambda x: [weigh(x)], "score double")
    return out.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        *(["row"] if keep_rows else []),
    )
