"""Sum-of-squares packing of token sequences into windows of fixed length."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from scoretide.llm.common import over_batches, slices, text_of

WINDOW = 4096
END_ID = 2
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

# Bytes of ids in partially filled windows that a task holds; beyond it the fullest of them are moved together.
OPEN_BYTES = 256 << 20

# Encoded words a worker remembers; the store starts afresh when it is full.
KNOWN_WORDS = 800_000

# No token spans white space, so what lies between these characters can be encoded on its own.
BREAKS = re.compile("[\t\n\x0b\x0c\r ]+")

# The tokenizer's own split, spelled out for lower-cased text without characters above U+024F, where
# letters and numbers are few and normalisation changes nothing.
LETTERS, NUMBERS, SPACES = "a-zªµºß-öø-ɏ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
NOT_LATIN = re.compile("[^\x00-\u024f]")


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, equal to what the tokenizer gives for the whole text.
    Words seen before are not encoded again; those of Latin text go straight to the tokenizer's merge model."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.latin: dict[str, bytes] = {}
        self.other: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        low = text.lower()
        if "<|" in text or not (low.isascii() or not NOT_LATIN.search(low)):
            return self.join(BREAKS.split(text), self.other, self.whole)
        return self.join(LATIN.findall(low), self.latin, self.merged)

    def join(self, words: list[str], known: dict[str, bytes], encode) -> bytes:
        new = [word for word in set(words) if word not in known]
        if len(known) + len(new) > KNOWN_WORDS:
            known.clear()
            new = list(set(words))
        known.update(zip(new, encode(new)))
        return b"".join([known[word] for word in words])

    def whole(self, words: list[str]) -> Iterator[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return (array("I", x.ids).tobytes() for x in found)

    def merged(self, words: list[str]) -> Iterator[bytes]:
        for word in words:
            spelled = word if word.isascii() and word.isprintable() else self.spell(word)[0][0]
            yield array("I", [token.id for token in self.merge(spelled)]).tobytes()


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file, so tasks that follow find its words."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Packer:
    """Online packing. A piece is (document row, start, ids as bytes); ``done`` gathers finished sequences of pieces.

    A remainder shorter than a window goes to the fill level that keeps the sum of the squared counts of partially
    filled windows smallest; ``counts`` is the level array, ``at`` has the windows of each level.
    """

    def __init__(self, window: int = WINDOW, open_bytes: int = OPEN_BYTES) -> None:
        self.window, self.open_bytes = window, open_bytes
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.at: dict[int, list[list]] = {}
        self.held = 0  # ids in open windows
        self.done: list[list] = []

    def level_for(self, size: int) -> int:
        top = self.window - size
        before, after = self.counts[: top + 1], self.counts[size : self.window + 1]
        change = 2 * (after - before)  # both ends also add one, the same for all but the two below
        change = np.where(before > 0, change, np.iinfo(np.int64).max)
        change[0] = 2 * after[0] - 1  # a new window leaves no level
        if before[top] > 0:
            change[top] = -2 * before[top] - 1  # a full window reaches no level
        least = change.min()
        return int(np.flatnonzero(change == least)[-1])

    def add(self, row: int, ids: bytes) -> None:
        step = 4 * self.window
        whole = len(ids) // step * step
        for start in range(0, whole, step):
            self.done.append([(row, start // 4, ids[start : start + step])])
        size = (len(ids) - whole) // 4
        if size:
            self.place(size, [(row, whole // 4, ids[whole:])])
            if 4 * self.held > self.open_bytes:
                self.spill()

    def place(self, size: int, pieces: list) -> None:
        level = self.level_for(size)
        held = []
        if level:
            held = self.at[level].pop()
            self.counts[level] -= 1
            self.held -= level
        held = held + pieces
        if level + size == self.window:
            self.done.append(held)
            return
        self.at.setdefault(level + size, []).append(held)
        self.counts[level + size] += 1
        self.held += level + size

    def spill(self) -> None:
        """Move the contents of the fullest windows together, cutting pieces, until half the bytes are left; the other levels stay."""
        pieces = []
        while 8 * self.held > self.open_bytes:
            level = max(level for level, held in self.at.items() if held)
            pieces += self.at[level].pop()
            self.counts[level] -= 1
            self.held -= level
        rest, size = self.fill(pieces)
        if size:
            self.place(size, rest)

    def finish(self) -> None:
        """Move the contents of all open windows together, until one at most is partially filled; that one is cut into
        sequences whose lengths are powers of two, which need no padding."""
        pieces = [piece for level in sorted(self.at, reverse=True) for held in self.at[level] for piece in held]
        self.at, self.held = {}, 0
        self.counts[:] = 0
        self.powers(*self.fill(pieces))

    def fill(self, pieces: list) -> tuple[list, int]:
        """Whole windows from the pieces end to end; what is left over, and its length."""
        held, free = [], self.window
        for row, start, ids in pieces:
            while ids:
                part = ids[: 4 * free]
                held.append((row, start, part))
                start, ids, free = start + len(part) // 4, ids[len(part) :], free - len(part) // 4
                if not free:
                    self.done.append(held)
                    held, free = [], self.window
        return held, self.window - free

    def powers(self, pieces: list, size: int) -> None:
        while size:
            room = 1 << (size.bit_length() - 1)
            size -= room
            held = []
            while room:
                row, start, ids = pieces.pop(0)
                part, rest = ids[: 4 * room], ids[4 * room :]
                held.append((row, start, part))
                room -= len(part) // 4
                if rest:
                    pieces.insert(0, (row, start + len(part) // 4, rest))
            self.done.append(held)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID,
    tokenizer: str = TOKENIZER, keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: the document's id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``
    and, with ``keep_ids``, the ids as an array.

    A document is its token ids and ``end_id``. Whole windows are cut off first; the remainder is packed online by the
    sum-of-squares rule. Each partition is packed on its own, without a shuffle; its last windows are moved together
    at the end, so only sequences at a power of two are shorter than a window and nothing is padded. A task that holds more than
    OPEN_BYTES in open windows moves the fullest ones together before, and keeps the levels of the rest.

    A NULL or empty text is ``end_id`` alone. NULL ids and repeated rows are documents of their own. An empty table gives
    an empty result. Other columns are not read.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer), Packer(window)
        end, tokens = np.array([end_id], dtype="<u4").tobytes(), {}
        base, sequence, row = TaskContext.get().partitionId() << 40, 0, 0

        def finished() -> pa.RecordBatch:
            nonlocal sequence
            out: dict[str, list] = {name: [] for name in names}
            for pieces in packer.done:
                offset = 0
                for key, start, ids in pieces:
                    doc, n = tokens[key][:2]
                    values = (doc, start, len(ids) // 4, zlib.crc32(ids), n, base + sequence, offset, ids)
                    for name, value in zip(names, values):
                        out[name].append(value)
                    offset += len(ids) // 4
                    tokens[key][2] -= len(ids) // 4
                    if not tokens[key][2]:
                        del tokens[key]
                sequence += 1
            packer.done.clear()
            return pa.RecordBatch.from_arrays([
                pa.array([np.frombuffer(x, "<u4").astype("int32") for x in out[name]], pa.list_(pa.int32()))
                if name == "ids" else pa.array(out[name], pa.int64()) for name in names
            ], names=names)

        for batch in batches:
            for part in slices(batch, "text"):
                for doc, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                    ids = encode(text) + end
                    tokens[row] = [doc, len(ids) // 4, len(ids) // 4]
                    packer.add(row, ids)
                    row += 1
                if packer.done:
                    yield finished()
        packer.finish()
        if packer.done:
            yield finished()

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
    schema = ", ".join(f"{name} {'array<int>' if name == 'ids' else 'long'}" for name in names)
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), text_of(f"`{text_col}`").alias("text"))
    return over_batches(rows, work, schema).withColumnRenamed("id", id_col)
