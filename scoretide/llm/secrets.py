"""Secret scans: patterns for known kinds, and guess costs of values in credential contexts."""

from __future__ import annotations

import hashlib
import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from datetime import date
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoretide.llm.common import added, over_batches, row_struct, slices, text_of

KINDS = ["assign", "access", "hex", "guess"]

# Letters of the names are ASCII in either case; the value of an assignment needs 6 characters or more.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

# What makes the text that follows a credential, and the value up to a closing sign; at the end of a run trailing signs are not
# part of it. The search goes on behind the value, so contexts in one run without spaces are all found.
CONTEXT = re.compile(
    r"""(?ai:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credentials?|bearer|login|pin)"""
    r"""["']?(?:[\x20\t]*[:=]{1,2}[\x20\t]*|[\x20\t]+is[\x20\t]+)["']?(?=[!-~]{6})((?:(?!["'<>,;)\]}])[!-~])*)"""
)
CLOSING, TRAILING = frozenset("\"'<>,;)]}"), ".:!?"

# Values that take at least 10**GUESS_LOG10 guesses are reported.
GUESS_LOG10 = 10.0

# Words beyond the vocabulary file that people choose as passwords, most frequent first.
COMMON = "password 123456 qwerty letmein admin welcome monkey dragon master login abc123 iloveyou sunshine princess football secret".split()

# Rows of a keyboard, and letters that digits or signs stand for.
ROWS = ["`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./"]
LOOKS = str.maketrans("4@8310!5$7", "aabeioisst")

BRUTE = 1.0  # log10 guesses per character that nothing explains
LONGEST_WORD = 24
SEGMENT = 0.3  # log10 guesses for knowing where a segment ends


@lru_cache(maxsize=2)
def ranks(vocabulary: str) -> dict[str, int]:
    """Whole words of a public vocabulary by rank; its order is its merge order, frequent ones first."""
    with open(vocabulary, encoding="utf-8") as file:
        words = json.load(file)["model"]["vocab"]
    found = {}
    for word in COMMON + [w[:-4] for w in sorted(words, key=words.get) if w.endswith("</w>")]:
        if word.isascii() and len(word) >= 3 and word.isalpha() or word in COMMON:
            found.setdefault(word, len(found) + 1)
    return found


def _neighbours() -> dict[str, str]:
    """Keys that touch: next in the row, or one row on at the same place or beside it."""
    places = {key: (r, c) for r, row in enumerate(ROWS) for c, key in enumerate(row)}
    return {a: "".join(b for b, (r, c) in places.items() if b != a and abs(r - places[a][0]) <= 1 and abs(c - places[a][1]) <= 1) for a in places}


NEAR = _neighbours()
DATE = re.compile(r"\d{1,4}[-/._]?\d{1,2}[-/._]?\d{1,4}")
YEAR_SPAN = 130


def _is_date(text: str) -> bool:
    parts = [p for p in re.split(r"[-/._]", text) if p]
    if len(parts) == 1 and len(text) in (6, 8):
        cuts = [(text[:4], text[4:6], text[6:]), (text[:2], text[2:4], text[4:]), (text[4:], text[2:4], text[:2])] if len(text) == 8 else [(text[:2], text[2:4], text[4:])]
    elif len(parts) == 3:
        cuts = [tuple(parts)]
    else:
        return False
    for a, b, c in cuts:
        for y, m, d in ((a, b, c), (c, b, a), (c, a, b)):
            try:
                year = int(y) + (0 if len(y) == 4 else 1900 if len(y) == 2 else 99_999)
                if 1900 <= date(year, int(m), int(d)).year < 1900 + YEAR_SPAN + 20:
                    return True
            except ValueError:
                continue
    return False


def guess_cost(value: str, vocabulary: str) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` takes.

    Segments are dictionary words (rank, doubled for capitals and look-alike signs), dates, repeats of the piece just
    before, keyboard walks and brute force. The recursion runs over end positions and keeps the least cost.
    """
    known, low = ranks(vocabulary), value.lower()
    plain, n = low.translate(LOOKS), len(value)
    least = [0.0] + [math.inf] * n
    walk = 0  # where the walk that ends here began
    for end in range(1, n + 1):
        least[end] = least[end - 1] + BRUTE
        for start in range(max(0, end - LONGEST_WORD), end - 2):
            rank = known.get(low[start:end]) or known.get(plain[start:end])
            if rank:
                odd = (value[start:end] != low[start:end]) + (low[start:end] not in known)
                least[end] = min(least[end], least[start] + math.log10(rank + 1) + odd * math.log10(2) + SEGMENT)
        for start in range(max(0, end - 10), end - 5):
            if DATE.fullmatch(value, start, end) and _is_date(value[start:end]):
                least[end] = min(least[end], least[start] + math.log10(365 * YEAR_SPAN) + SEGMENT)
        for size in range(1, min(LONGEST_WORD, end // 2) + 1):
            if value[end - size : end] == value[end - 2 * size : end - size]:
                least[end] = min(least[end], least[end - size] + SEGMENT)
        if end > 1 and low[end - 1] not in NEAR.get(low[end - 2], ""):
            walk = end - 1
        for start in range(max(walk, end - LONGEST_WORD), end - 3):
            least[end] = min(least[end], least[start] + math.log10(len(NEAR)) + (end - start - 1) * math.log10(3) + SEGMENT)
    return least[n]


def find(text: str, vocabulary: str, threshold: float = GUESS_LOG10) -> tuple[list[tuple[int, int, int]], float | None]:
    """(start, kind number, end) of every secret in order, and the highest cost of a value in a credential context."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans.sort()
    starts, ends = [], []  # what the patterns cover, in pieces that do not touch
    for start, _, end in spans:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    added, highest = [], None
    for m in CONTEXT.finditer(text):
        value = m.group(1) if text[m.end() : m.end() + 1] in CLOSING else m.group(1).rstrip(TRAILING)
        if len(value) < 6:
            continue
        cost, start, end = guess_cost(value, vocabulary), m.start(1), m.start(1) + len(value)
        highest = cost if highest is None else max(highest, cost)
        at = bisect_right(starts, start) - 1
        if cost >= threshold and (at < 0 or ends[at] < end):
            added.append((start, 3, end))
    return sorted(spans + added), highest


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = GUESS_LOG10,
    vocabulary: str = public_tokenizers.path("word_bpe_49k.json"), keep_rows: bool = False,
) -> DataFrame:
    """One row per input row: the id, ``n_assign``, ``n_access``, ``n_hex``, ``n_guess``, ``base_sha256``, ``spans``,
    ``max_log10_guesses`` and ``masked``, the text with every span replaced by ``[kind]`` (only with ``keep_rows``, where
    the input row comes as a struct ``row``).

    ``spans`` joins kind:start:end by start, then kind; ends are exclusive, positions count code points. Kind ``guess`` is
    what the guess-cost recursion adds: values in a credential context that the patterns do not cover wholly and that take at
    least 10**``threshold`` guesses. ``max_log10_guesses`` is the highest cost of any value in such a context, else NULL.

    A NULL or empty text has no spans. NULL ids and repeated rows are scanned like any other. An empty table gives an
    empty result. Nothing is shuffled and texts are read whole.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out: dict[str, list] = {name: [] for name in names}
                for text in part.column("text").to_pylist():
                    spans, highest = find(text, vocabulary, threshold)
                    counts = [sum(s[1] == k for s in spans) for k in range(4)]
                    base = _joined([s for s in spans if s[1] < 3])
                    values = (*counts, hashlib.sha256(base.encode()).hexdigest(), _joined(spans), highest, _mask(text, spans) if keep_rows else None)
                    for name, value in zip(names, values):
                        out[name].append(value)
                lead = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in lead] + [pa.array(out[n], kinds[n]) for n in names], names=lead + names)

    kinds = {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "n_guess": pa.int64(), "base_sha256": pa.string(), "spans": pa.string(),
             "max_log10_guesses": pa.float64(), "masked": pa.string()}
    names = list(kinds)[: 8 if keep_rows else 7]
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), *([row_struct(docs)] if keep_rows else []),
        text_of(f"`{text_col}`").alias("text"),
    )
    spell = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}
    schema = added(rows, ", ".join(f"{n} {spell[kinds[n]]}" for n in names))
    return over_batches(rows, work, schema).withColumnRenamed("id", id_col)


def _mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Spans that overlap are masked as one, named after the first."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
