"""Substring dedup: recurring phrases, Aho-Corasick automata per shard of documents, and the windows around them."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoretide.llm.common import discard, over_batches, shuffles_freed, slices, stored_at, text_of
from scoretide.session import ship_code

WINDOW = 35
PHRASE = 12

# Text per shard of documents: bounds an automaton and the frame that one call works on.
SHARD_BYTES = 2_000_000

# A word is spelled for the automaton in digits of this base, each place with symbols of its own, because a node's children are
# searched one by one.
SYMBOLS = 64

# Odd multipliers of two independent polynomial hashes modulo 2**64, and their inverses.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_U = np.uint64

CHANGED = "the documents gave other rows or partitions when they were read again; store them first"


class Powers:
    """Powers of a base and of its inverse modulo 2**64, as far as asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.n = base, pow(base, -1, 2**64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 4096)
            self.up, self.down = (np.concatenate([np.ones(1, _U), np.multiply.accumulate(np.full(self.n, b, _U))]) for b in (self.base, self.inverse))
        return self.up, self.down


_powers = [Powers(b) for b in BASES]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


# A word's hash is a sum of numbers that stand for its bytes in their places; longer words have XXH64. White space counts nothing.
PLACES = 32
WHITE = re.compile(rb"[\t-\r ]")
BYTES = mix(mix(np.arange(1, PLACES * 256 + 1, dtype=_U) * _U(BASES[0]))).reshape(PLACES, 256)
BYTES[:, [9, 10, 11, 12, 13, 32]] = 0
BYTES = BYTES.ravel()
IN_WORD = BYTES[:256] != 0

# Bytes of a text that are hashed at once.
STRETCH = 1 << 20


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words that white space separates in ``text``, in order."""
    out, done = [np.zeros(0, _U)], 0
    while done < len(text):
        end = WHITE.search(text, done + STRETCH)
        end = end.start() if end else len(text)
        codes = np.frombuffer(text, np.uint8, end - done, done)
        edges = np.flatnonzero(np.diff(IN_WORD[codes], prepend=False, append=False))
        start, stop = edges[::2], edges[1::2]
        if len(start):
            place = np.arange(start[0], len(codes), dtype=np.int32)
            place -= np.repeat(start.astype(np.int32), np.diff(start, append=len(codes)))
            np.minimum(place, PLACES - 1, out=place)
            hashes = mix(np.add.reduceat(BYTES[(place << 8) + codes[start[0] :]], start - start[0]))
            for k in np.flatnonzero(stop - start > PLACES).tolist():
                hashes[k] = xxhash.xxh64_intdigest(codes[start[k] : stop[k]].tobytes())
            out.append(hashes)
        done = end
    return np.concatenate(out)


class Words:
    """Numbers and hashes of the words met so far."""

    def __init__(self) -> None:
        self.ids: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.hashes, self.n = np.zeros(4096, _U), 0

    def __call__(self, words: list[bytes]) -> np.ndarray:
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        new = len(self.ids) - self.n
        if new:
            while self.n + new > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.hashes[self.n : self.n + new][::-1] = word_hashes(b" ".join(islice(reversed(self.ids), new)))
            self.n += new
        return ids

    def hashed(self, words: list[bytes]) -> np.ndarray:
        ids = self(words)  # first, as it may replace the hashes by a longer array
        return self.hashes[ids]


class Sums:
    """Hashes of any spans of one sequence of word hashes, from running sums."""

    def __init__(self, hashes: np.ndarray, which: int = 0) -> None:
        self.up, down = _powers[which].upto(len(hashes) + 1)
        values = hashes if which == 0 else mix(hashes ^ _U(0x5851F42D4C957F2D))
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(values * down[: len(hashes)], dtype=_U)])

    def spans(self, start: np.ndarray, size) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self.up[start])


def leaders(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each ``width`` consecutive values, the first of equals."""
    at, span = np.arange(len(values)), 1

    def meet(at: np.ndarray, step: int) -> np.ndarray:
        left, right = at[: len(at) - step], at[step:]
        return np.where(values[left] <= values[right], left, right)

    while 2 * span <= width:
        at, span = meet(at, span), 2 * span
    return meet(at, width - span)


class Blocks:
    """The windows of a document by their leading phrase.

    A window's phrase is the one with the least hash of all phrases in it, the first of equals. Equal windows have equal
    phrases at equal places, so a window can only recur where its phrase does. A block is a run of windows with one
    phrase occurrence: ``at`` is the phrase's place, ``phrase`` and ``tag`` 96 bits of a hash of its words, ``layout`` the
    phrase's place in the block and the number of windows, and ``body`` a hash of all words of the block.
    """

    def __init__(self, hashes: np.ndarray, window: int, phrase: int) -> None:
        self.at = self.layout = np.zeros(0, np.int32)
        self.phrase = self.body = np.zeros(0, _U)
        self.tag = np.zeros(0, np.int32)
        if len(hashes) < window:
            return
        sums = Sums(hashes)
        values = sums.spans(np.arange(len(hashes) - phrase + 1), phrase)
        at = leaders(values, window - phrase + 1)
        cut = np.flatnonzero(np.diff(at)) + 1
        first = np.concatenate([[0], cut])
        size = np.diff(np.concatenate([first, [len(at)]]))
        at = at[first]
        self.at, self.phrase, self.tag = at.astype(np.int32), values[at], tags(hashes, at, phrase)
        self.layout = ((at - first) * (window + 1) + size).astype(np.int32)
        self.body = sums.spans(first, size - 1 + window)


def tags(hashes: np.ndarray, at: np.ndarray, phrase: int) -> np.ndarray:
    return (Sums(hashes, 1).spans(at, phrase) >> _U(32)).astype(np.uint32).view(np.int32)


def _phrases(window: int, phrase: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [Blocks(word_hashes(text.encode()), window, phrase) for text in part.column("text").to_pylist()]
                phrases, bodies = (np.concatenate([getattr(x, c) for x in found]).view(np.int64) for c in ("phrase", "body"))
                tag, at, layout = (np.concatenate([getattr(x, c) for x in found]) for c in ("tag", "at", "layout"))
                place = np.repeat(part.column("place").to_numpy(), [len(x.at) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (phrases, tag, bodies, layout, place, at)], names=["phrase", "tag", "body", "layout", "place", "at"])

    return work


def _spell(phrase: int):
    """The words of the phrases that a document is to give, each checked against its hash."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, asked in zip(batch.column("text").to_pylist(), batch.column("asked")):
                text, values = text.encode(), asked.values
                words, hashes = text.split(), word_hashes(text)
                at, phrases, tag = (values.field(c).to_numpy() for c in ("at", "phrase", "tag"))
                if len(words) < at.max() + phrase or (Sums(hashes).spans(at, phrase).view(np.int64) != phrases).any() or (tags(hashes, at, phrase) != tag).any():
                    raise ValueError(CHANGED)
                said = [b" ".join(words[k : k + phrase]).decode() for k in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(phrases), pa.array(tag), pa.array(said, pa.string())], names=["phrase", "tag", "words"])

    return work


def kept_words(words: list[bytes], removed: np.ndarray) -> tuple[int, str, bytes]:
    """Number of removed words, digest and bytes of the others."""
    kept = b" ".join([words[k] for k in np.flatnonzero(~removed)]) if removed.any() else b" ".join(words)
    return int(removed.sum()), hashlib.sha256(kept).hexdigest(), kept


def _cover(n: int, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, stop, -1)
    return np.cumsum(edges[:n]) > 0


class Dictionary:
    """The recurring phrases of a shard, whose first words ``number`` numbers, as an automaton over word numbers, and the kinds of blocks known around each.

    ``table`` has a row per kind: the phrase in ``words``, ``layout`` and ``body`` of the block, ``whole`` where it recurs
    as it is, ``speaks`` where its windows must be compared with those of other kinds, once for all blocks of the kind, and
    ``n``, how many such blocks the shard has by the phrases' hashes.
    """

    def __init__(self, table: pa.Table, number: Words, window: int, phrase: int) -> None:
        known: dict[str, int] = {}
        of = np.fromiter((known.setdefault(w, len(known)) for w in table.column("words").to_pylist()), np.int64, table.num_rows)
        self.window, self.phrase = window, phrase
        ids = number(" ".join(known).encode().split())
        self.words, self.digits = len(number.ids), 1  # every other word is one more, the same for all
        while SYMBOLS**self.digits <= self.words:
            self.digits += 1
        places = np.arange(self.digits)
        self.spelling = (np.arange(self.words + 1)[:, None] // SYMBOLS**places % SYMBOLS + places * SYMBOLS + 1).astype("<u4")
        spelled, length = self._spelled(ids), phrase * self.digits
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k in range(len(known)):
            self.automaton.add_word(spelled[k * length : (k + 1) * length], k)
        if known:
            self.automaton.make_automaton()
        layout, body = table.column("layout").to_numpy().astype(np.int64), table.column("body").to_numpy().astype(np.int64).view(_U)
        keys = self._key(of, layout, body)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.hashed, self.met = table.column("n").to_numpy()[order], np.zeros(len(keys), np.int64)
        self.whole, self.speaks = (table.column(c).to_numpy(zero_copy_only=False).astype(bool)[order] for c in ("whole", "speaks"))
        scale = window * (window + 1) + 1
        pairs = np.unique(of * scale + layout)
        self.layouts, self.begin = pairs % scale, np.searchsorted(pairs // scale, np.arange(len(known) + 1))

    def _spelled(self, ids: np.ndarray) -> str:
        return self.spelling[np.minimum(ids, self.words)].tobytes().decode("utf-32-le")

    @staticmethod
    def _key(of: np.ndarray, layout: np.ndarray, body: np.ndarray) -> np.ndarray:
        return mix(body + mix(of.astype(_U) * _U(BASES[0]) + layout.astype(_U)))

    def located(self, ids: np.ndarray) -> np.ndarray:
        """Last digit and number of every phrase that the automaton locates in a document with windows."""
        if not len(self.keys) or len(ids) < self.window:
            return np.zeros((0, 2), np.int64)
        return np.array(list(self.automaton.iter(self._spelled(ids))), np.int64).reshape(-1, 2)

    def blocks(self, ids: np.ndarray, sums: Sums, met: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kind, first window and number of windows of every known block around the phrases that the automaton locates (``met``)."""
        met = self.located(ids) if met is None else met
        if not len(met):
            return met[:, 0], met[:, 0], met[:, 0]
        at, of = met[:, 0] // self.digits - self.phrase + 1, met[:, 1]
        times = self.begin[of + 1] - self.begin[of]
        layout = self.layouts[np.repeat(self.begin[of] - np.cumsum(times) + times, times) + np.arange(times.sum())]
        at, of = np.repeat(at, times), np.repeat(of, times)
        first, size = at - layout // (self.window + 1), layout % (self.window + 1)
        inside = (first >= 0) & (first + size - 1 + self.window <= len(ids))
        first, size, layout, of = first[inside], size[inside], layout[inside], of[inside]
        keys = self._key(of, layout, sums.spans(first, size - 1 + self.window))
        kind = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        same = self.keys[kind] == keys
        np.add.at(self.met, kind[same], 1)
        return kind[same], first[same], size[same]


def _locate(window: int, phrase: int, keep_text: bool):
    """Per shard: compile the automaton of the phrases that recur in it and stream its documents through it."""
    def work(docs: pa.Table, recurring: pa.Table) -> pa.Table:
        number = Words()
        known = Dictionary(recurring, number, window, phrase)
        out: dict[str, list] = {c: [] for c in COLUMNS}
        nothing, none = np.zeros(0, bool), (np.zeros(0, np.int32), np.zeros(0, np.int64))
        for text in docs.column("text").to_pylist():
            text = text.encode()
            words = text.split()
            ids = np.fromiter(map(number.ids.get, words, repeat(known.words)), np.int64, len(words))
            met = known.located(ids)
            if not len(met):  # nothing of it recurs
                for column, value in zip(COLUMNS, (len(words), *kept_words(words, nothing)[:2], b" ".join(words).decode() if keep_text else None, None, None, none[0], none[1], none[0])):
                    out[column].append(value)
                continue
            hashes = word_hashes(text)
            sums = Sums(hashes)
            kind, first, size = known.blocks(ids, sums, met)
            full = known.whole[kind]
            removed = _cover(len(words), first[full], first[full] + size[full] - 1 + window)
            telling = np.flatnonzero(known.speaks[kind])
            common = telling[full[telling]]  # kinds that recur speak once, at their first block here
            speaking, at = np.unique(kind[common], return_index=True)
            known.speaks[speaking] = False
            telling = np.concatenate([telling[~full[telling]], common[at]])
            length = size[telling]
            starts = np.repeat(first[telling] - np.cumsum(length) + length, length) + np.arange(length.sum())
            told = np.unique(2 * starts + np.repeat(full[telling], length))  # a window may lie in two known blocks
            starts, at = np.unique(told >> 1, return_index=True)
            asked = told[at] & 1 == 0
            gone, digest, kept = kept_words(words, removed)
            pending = bool(asked.any())
            values = [s.spans(starts, window) if len(starts) else np.zeros(0, _U) for s in (sums, Sums(hashes, 1) if len(starts) else sums)]
            for column, value in zip(COLUMNS, (
                len(words), gone, digest, kept.decode() if keep_text and not pending else None, b" ".join(words).decode() if pending else None,
                np.flatnonzero(np.diff(removed, prepend=False, append=False)).astype(np.int32) if pending else None,
                np.where(asked, starts, -1).astype(np.int32), values[0].view(np.int64), (values[1] >> _U(32)).astype(np.uint32).view(np.int32),
            )):
                out[column].append(value)
        if (known.met < known.hashed).any():
            raise ValueError(CHANGED)
        arrays = [docs.column("place").combine_chunks(), docs.column("id").combine_chunks()]
        return pa.table(arrays + [pa.array(out[c], k) for c, k in COLUMNS.items()], names=["place", "id", *COLUMNS])

    return work


COLUMNS = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string(), "text": pa.string(), "gone": pa.list_(pa.int32()),
           "starts": pa.list_(pa.int32()), "w1": pa.list_(pa.int64()), "w2": pa.list_(pa.int32())}
SCHEMA = "n_words long, n_removed long, kept_sha256 string, kept string, text string, gone array<int>, starts array<int>, w1 array<long>, w2 array<int>"


def _finish(window: int, keep_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, gone, hits in zip(*(batch.column(c).to_pylist() for c in ("text", "gone", "hits"))):
                words = text.encode().split(b" ")
                first = np.array(hits or [], dtype=np.int64)
                edges = np.array(gone, dtype=np.int64)  # where removed stretches begin and end, in turn
                removed = _cover(len(words), np.concatenate([first, edges[::2]]), np.concatenate([first + window, edges[1::2]]))
                n, digest, kept = kept_words(words, removed)
                found.append((len(words), n, digest, kept.decode() if keep_text else None))
            columns = [pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.int64(), pa.string(), pa.string()))] if found else []
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "n_words", "n_removed", "kept_sha256", "kept"]) if found else batch.slice(0, 0)

    return work


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE, keep_text: bool = False) -> DataFrame:
    """One row per input row: the id, ``n_words``, ``n_removed``, ``kept_sha256`` and, with ``keep_text``, ``kept_text``.

    A word is removed when it lies in a window of ``window`` consecutive words whose sequence also starts anywhere else, in
    any document, judged on the input. Words are what ASCII white space separates.

    Every window is led by its phrase with the least hash, so equal windows have equal leading phrases, and a document is
    a row of blocks of windows with one phrase. Phrases that lead twice or more, by a 96-bit hash, recur; one document of
    each spells it out in words. Documents are hashed into shards. A shard gets the words of the phrases that recur in it,
    compiles them into an Aho-Corasick automaton over word numbers and streams its documents through it: every occurrence
    is located there, word by word, and blocks are only looked for around located phrases. Blocks around one phrase
    count as equal by a 64-bit hash of their words; those that recur as a whole are removed at once. Windows of the others
    count by a 96-bit hash of their words, against one of each kind of block with the same phrase, and only their
    documents travel again.

    NULL texts and texts of fewer than ``window`` words keep all words. NULL ids and repeated rows are documents of their own,
    so a row that occurs twice is removed where it has windows. An empty table gives an empty result. The input must give
    the same rows in the same partitions when it is read again, as stored tables do; it is an error where the
    automata then meet fewer blocks than were hashed.
    """
    text = text_of(f"`{text_col}`")
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_BYTES))
    rows = docs.select(F.monotonically_increasing_id().alias("place"), F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    shard = F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int").alias("shard")

    spark = docs.sparkSession

    def staged(df: DataFrame, label: str) -> tuple[DataFrame, str]:
        with shuffles_freed(spark):
            return stored_at(df, label)

    leads, leads_at = staged(over_batches(rows.select("text", "place"), _phrases(window, phrase), "phrase long, tag int, body long, layout int, place long, at int"), "phrases")
    heads = leads.groupBy("phrase", "tag").agg(F.count("*").alias("n"), F.min_by("at", "place").alias("at"), F.min("place").alias("place"))
    heads, heads_at = staged(heads.where("n > 1"), "heads")
    asked = heads.groupBy("place").agg(F.collect_list(F.struct("at", "phrase", "tag")).alias("asked"))
    spelled = over_batches(rows.select("place", "text").join(asked, "place").select("text", "asked"), _spell(phrase), "phrase long, tag int, words string")

    again = leads.select("phrase", "tag", "body", "layout", shard).join(
        heads.select("phrase", "tag", F.col("n").alias("total")), ["phrase", "tag"])
    again, again_at = staged(again.groupBy("phrase", "tag", "body", "layout", "total", "shard").agg(F.count("*").alias("n")), "recurring")
    discard(spark, leads_at)  # the largest of these tables, and nothing below reads it
    kinds = again.groupBy("phrase", "tag", "body", "layout").agg(F.sum("n").alias("all"), F.min("shard").alias("speaker"))
    known = again.join(kinds, ["phrase", "tag", "body", "layout"]).join(spelled, ["phrase", "tag"]).select(
        "shard", "words", "layout", "body", "n", (F.col("all") > 1).alias("whole"),
        ((F.col("all") < F.col("total")) & ((F.col("all") == 1) | (F.col("shard") == F.col("speaker")))).alias("speaks"))
    # Stored, so that the documents that spell have left the disk before all of them travel to their shards.
    known, known_at = staged(known, "known")
    for path in (heads_at, again_at):
        discard(spark, path)

    rows = rows.withColumn("shard", shard)
    ship_code(spark)
    id_field = rows.schema["id"]
    schema = T.StructType([T.StructField("place", T.LongType()), id_field, *T.StructType.fromDDL(SCHEMA).fields])
    found = rows.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_locate(window, phrase, keep_text), schema)
    found = staged(found, "located")[0]
    discard(spark, known_at)

    done = found.where("text is null").select("id", "n_words", "n_removed", "kept_sha256", "kept")
    pending = found.where("text is not null")
    spans = found.select("place", F.explode(F.arrays_zip("starts", "w1", "w2")).alias("s")).select("place", "s.*")
    twice = spans.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    hits = spans.where("starts >= 0").join(twice, ["w1", "w2"]).groupBy("place").agg(F.collect_list("starts").alias("hits"))
    ended = pending.select("place", "id", "text", "gone").join(hits, "place", "left").select("id", "text", "gone", "hits")
    late = over_batches(ended, _finish(window, keep_text), T.StructType([id_field, *T.StructType.fromDDL("n_words long, n_removed long, kept_sha256 string, kept string").fields]))
    out = done.unionByName(late)
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", *([F.col("kept").alias("kept_text")] if keep_text else []))

