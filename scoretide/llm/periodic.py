"""Runs of repeated phrases, found by an online catcher of squares."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoretide.llm.common import over_batches, slices, text_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST_WORDS, LEAST_REPEATS = 6, 4


class SquareCatcher:
    """Squares of a growing sequence of words, merged into runs.

    A square is a stretch of two equal halves. A half of p words holds, wholly, a block of 2**k words that starts at a
    multiple of 2**k, where 2**(k+1) - 1 <= p < 2**(k+2) - 1. As soon as such a block is complete it gets a catcher, which
    lives while a second half may still begin at these distances: about two at a time for each power of two.

    Each appended word advances the open comparisons, one per distance p: word e against word e - p. A comparison opens where
    a catcher's block seems to begin again. When the whole block has matched, the words before it are compared too, and from then
    on the comparison knows the whole stretch over which words p apart are equal. Once that has p words it is a square, and
    every further match is a new square that merges into the same run; the first word that differs ends the run.

    A distance that is a multiple of the period of a run that covers the block is not opened: its stretch would be that
    run again. So few comparisons are open at once also where words repeat without end. Where the same stretch is
    found with several periods, the smallest is kept.
    """

    def __init__(self) -> None:
        self.words: list[str] = []
        self.open: dict[int, list] = {}  # distance -> [block start, words to match before it is caught, first word of the run or None]
        self.waiting: dict[tuple[str, str], list[tuple[int, int]]] = {}  # first two words of a block of four and more -> (start, length), oldest first
        self.found: dict[tuple[int, int], int] = {}  # (first word, end) -> smallest period

    def append(self, word: str) -> None:
        words, at = self.words, len(self.words)
        words.append(word)
        if self.open:
            self._advance(word, at)
        # blocks of one and of two words: the distances 1 to 6
        if at:
            last = words[at - 1]
            if word == last:
                self._start(1, at - 1, 1, at)
            if word == words[at - 2] and at > 1:
                self._start(2, at - 2, 1, at)
            for p in (4, 6) if at % 2 else (3, 5):  # the block starts at an even place
                if at > p and word == words[at - p] and last == words[at - p - 1]:
                    self._start(p, at - p - 1, 2, at)
            waiting = self.waiting.get((last, word))
            if waiting:
                self._meet(waiting, at)
        # blocks of 4, 8, ... words that end here
        end, size = at + 1, 4
        while not end % size:
            start = end - size
            self.waiting.setdefault((words[start], words[start + 1]), []).append((start, size))
            size *= 2

    def _meet(self, waiting: list[tuple[int, int]], at: int) -> None:
        """Open the comparisons of catchers whose block may begin again with the last two words; let go of those that are over."""
        over = False
        for start, size in waiting:
            p = at - 1 - start
            if p >= 4 * size - 1:
                over = True
            elif p >= 2 * size - 1:
                self._start(p, start, size, at)
        if over:
            waiting[:] = [c for c in waiting if at - 1 - c[0] < 4 * c[1] - 1]

    def _start(self, p: int, start: int, size: int, at: int) -> None:
        if p in self.open:
            return
        for q, (_, _, first) in self.open.items():
            if first is not None and p % q == 0 and first <= start:
                return
        self.open[p] = entry = [start, size, None]
        if at - p - start + 1 >= size:
            self._catch(p, entry)

    def _advance(self, word: str, at: int) -> None:
        words, ended = self.words, []
        for p, entry in self.open.items():
            if words[at - p] != word:
                ended.append(p)
            elif entry[2] is None and at - p - entry[0] + 1 >= entry[1]:
                self._catch(p, entry)
        for p in ended:
            self._end(p, at)

    def _catch(self, p: int, entry: list) -> None:
        words, first = self.words, entry[0]
        while first and words[first - 1] == words[first - 1 + p]:
            first -= 1
        entry[2] = first

    def _end(self, p: int, at: int) -> None:
        first = self.open.pop(p)[2]
        if first is not None and at - first >= 2 * p:
            self.found[first, at] = min(p, self.found.get((first, at), p))

    def finish(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run of two periods and more, by start and then period."""
        for p in list(self.open):
            self._end(p, len(self.words))
        return sorted(((first, end - first, p) for (first, end), p in self.found.items()), key=lambda r: (r[0], r[2]))


def periodic_runs(words: list[str], least_words: int = LEAST_WORDS, least_repeats: int = LEAST_REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``least_words`` words and ``least_repeats`` (2 or more) periods."""
    catcher = SquareCatcher()
    append = catcher.append
    for word in words:
        append(word)
    return [r for r in catcher.finish() if r[1] >= max(least_words, least_repeats * r[2])]


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """``words`` with one period left of each run."""
    if not runs:
        return words
    kept = [True] * len(words)
    for start, length, period in runs:
        kept[start + period : start + length] = [False] * (length - period)
    return [word for word, keep in zip(words, kept) if keep]


def with_planted_period(words: list[str], doc_id: int | None) -> list[str]:
    """The words, and for one id in ten their end replaced by a repetition that the id's CRC-32 fixes."""
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_repeats: int = LEAST_REPEATS,
    planted: bool = False,
) -> DataFrame:
    """One row per input row: the id, ``runs`` (array of start, length, period, by start and then period) and ``collapsed``, the
    words with one period left of each run, joined by one space.

    Words are what stands between ASCII white space, numbered from 0. A run is a stretch of at least ``least_words`` words and
    ``least_repeats`` times its smallest period that no neighbouring word extends with that period. A word is left out if it
    lies behind the first period of any run. With ``planted``, ``with_planted_period`` comes first.

    Each document is read word by word in one task, without a shuffle; its memory is some times the document's. A NULL
    text is an empty one and has no run. Rows with NULL ids and repeated rows stand for themselves; an empty table
    gives an empty result. What is not valid UTF-8 is read as the replacement character. Other columns are not read.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column("id").to_pylist()
                texts = part.column("text").cast(pa.binary()).to_pylist()
                runs, left = [], []
                for key, text in zip(ids, texts):
                    words = WORD.findall(text.decode("utf-8", "replace"))
                    if planted:
                        words = with_planted_period(words, key)
                    found = periodic_runs(words, least_words, least_repeats)
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    left.append(" ".join(collapsed(words, found)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(runs, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), pa.array(left, pa.string())],
                    names=["id", "runs", "collapsed"])

    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), text_of(f"`{text_col}`").alias("text"))
    found = over_batches(rows, work, "id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("id", id_col)


def run_report(found: DataFrame) -> DataFrame:
    """Per row of ``find_runs``: its id, ``n_runs``, the run with the greatest length per period (ties: smallest start, then period) and
    digests of all runs and of the collapsed words."""
    def better(best, run):
        a, b = run["length"] * best["period"], best["length"] * run["period"]
        return F.when(best.isNull() | (a > b), run).otherwise(best)

    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), better).alias("best")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    id_col = found.columns[0]
    with_best = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), best, F.sha2(lines, 256).alias("runs_sha256"),
                             F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return with_best.select(
        id_col, "n_runs", "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
