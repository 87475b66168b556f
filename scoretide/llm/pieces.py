"""SentencePiece encoding by a unigram Viterbi search over a double-array trie, and decoding."""

from __future__ import annotations

import math
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoretide.llm.common import added, over_batches, slices, text_of

MODEL = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"  # stands for a space
UNKNOWN_PENALTY = 10.0  # fixed by the format: an unknown character costs so much more than the worst piece

KNOWN_WORDS = 500_000
LONG_WORD = 192  # bytes; longer words are searched one by one

# Pieces never hold a mark behind another character, so words are searched apart.
WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class DoubleArray:
    """A trie of byte strings in two arrays: the child of state s by byte c is base[s] + c if check there is s."""

    def __init__(self, keys: dict[bytes, int]) -> None:
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, value in keys.items():
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                node = children[node][c]
            ends[node] = value
        size = 4 * len(children) + 1024
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = bytearray(size)
        taken[0] = 1
        gap, front, queue = 1, 1, [(0, 0)]  # the first free place; where places for several children are looked for
        for node, state in queue:  # grows while it is read: breadth first
            value[state] = ends.get(node, -1)
            codes = sorted(children[node])
            if not codes:
                continue
            if len(codes) == 1:
                gap = taken.index(0, max(gap, 1))
                at = taken.index(0, max(gap, codes[0] + 1)) - codes[0]
            else:
                at, tries = front, 0
                while any(taken[at + c] for c in codes):
                    at, tries = at + 1, tries + 1
                front = at if tries > 32 else front  # the part behind is too full to look through again
            base[state] = at
            for c in codes:
                taken[at + c] = 1
                check[at + c] = state
                queue.append((children[node][c], at + c))
            if at + 512 > len(taken):
                more = len(taken)
                taken.extend(bytes(more))
                base, check, value = (np.concatenate([x, np.full(more, y, np.int32)]) for x, y in ((base, 0), (check, -1), (value, -1)))
        self.base, self.check, self.value = base, check, value


class Pieces:
    """A vocabulary with log scores. A model of merges has ranks for scores; those become Zipf's log probabilities,
    -log(rank + 2) - log(log(size)). Scores of a unigram model are taken as they are."""

    def __init__(self, path: str = MODEL) -> None:
        import sentencepiece

        self.path = path
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = len(model)
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        score = np.array([model.get_score(i) for i in range(n)])
        merges = all(score[i] <= 0 and score[i] == int(score[i]) for i in plain)
        if merges:
            rank = {i: k for k, i in enumerate(sorted(plain, key=lambda i: (-score[i] if score[i] > -1e8 else len(plain), i)))}
            for i in plain:
                score[i] = -math.log(rank[i] + 2) - math.log(math.log(max(3, len(plain))))
        text = {i: model.id_to_piece(i) for i in plain}
        if any(MARK in t.lstrip(MARK) for t in text.values()):
            raise ValueError(f"{path} has pieces that hold a space inside; its words cannot be searched apart")
        self.score, self.unknown = score, min(score[i] for i in plain) - UNKNOWN_PENALTY
        self.trie = DoubleArray({t.encode(): i for i, t in text.items()})
        self.byte = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown_id = model.unk_id()
        self.bytes_of = [text[i].replace(MARK, " ").encode() if i in text else b"" for i in range(n)]
        for value, i in self.byte.items():
            self.bytes_of[i] = bytes([value])
        self.bytes_of[self.unknown_id] = " ⁇ ".encode()  # as the format prints an unknown piece
        self.longest = max(len(t.encode()) for t in text.values())


def _lengths(data: np.ndarray) -> np.ndarray:
    """Bytes of the character that begins at each byte, 0 inside a character."""
    return np.where(data < 0x80, 1, np.where(data < 0xC0, 0, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4))))


def search(pieces: Pieces, words: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """Best segmentation (start, end, piece or -1) of words of one length, all searched at once.

    For equal scores the piece that begins first stays.
    """
    n, size = len(words), len(words[0])
    data = np.frombuffer(b"".join(words), np.uint8).reshape(n, size).astype(np.int32)
    chars = _lengths(data)
    best = np.full((n, size + 1), -np.inf)
    best[:, 0] = 0
    back, piece = np.zeros((n, size + 1), np.int32), np.full((n, size + 1), -1, np.int32)
    trie = pieces.trie
    for start in range(size):
        rows = np.flatnonzero((chars[:, start] > 0) & (best[:, start] > -np.inf))
        state, here, single = np.zeros(len(rows), np.int32), rows, np.zeros(n, bool)
        for end in range(start + 1, min(size, start + pieces.longest) + 1):
            move = trie.base[state] + data[here, end - 1]
            ok = trie.check[move] == state
            here, state = here[ok], move[ok]
            if not len(here):
                break
            value = trie.value[state]
            hit = value >= 0
            at, value = here[hit], value[hit]
            single[at[chars[at, start] == end - start]] = True
            score = best[at, start] + pieces.score[value]
            better = score > best[at, end]
            at, value = at[better], value[better]
            best[at, end], back[at, end], piece[at, end] = score[better], start, value
        lost = rows[~single[rows]]
        end = start + chars[lost, start]
        better = best[lost, start] + pieces.unknown > best[lost, end]
        lost, end = lost[better], end[better]
        best[lost, end], back[lost, end], piece[lost, end] = best[lost, start] + pieces.unknown, start, -1
    out = []
    for row in range(n):
        path, end = [], size
        while end:
            start = int(back[row, end])
            path.append((start, end, int(piece[row, end])))
            end = start
        out.append(path[::-1])
    return out


def search_long(pieces: Pieces, word: bytes) -> list[tuple[int, int, int]]:
    """The same search for one long word."""
    base, check, value = pieces.trie.base, pieces.trie.check, pieces.trie.value
    size, chars = len(word), _lengths(np.frombuffer(word, np.uint8)).tolist()
    best, back, piece = [-math.inf] * (size + 1), [0] * (size + 1), [-1] * (size + 1)
    best[0] = 0.0
    for start in range(size):
        if not chars[start] or best[start] == -math.inf:
            continue
        state, single = 0, False
        for end in range(start + 1, size + 1):
            move = int(base[state]) + word[end - 1]
            if check[move] != state:
                break
            state, found = move, int(value[move])
            if found >= 0:
                single = single or end - start == chars[start]
                score = best[start] + float(pieces.score[found])
                if score > best[end]:
                    best[end], back[end], piece[end] = score, start, found
        end = start + chars[start]
        if not single and best[start] + pieces.unknown > best[end]:
            best[end], back[end], piece[end] = best[start] + pieces.unknown, start, -1
    path, end = [], size
    while end:
        path.append((back[end], end, piece[end]))
        end = back[end]
    return path[::-1]


class Encoder:
    """Ids of texts; words seen before are not searched again."""

    def __init__(self, pieces: Pieces) -> None:
        import sentencepiece

        self.pieces, self.known = pieces, {}
        self.normalize = sentencepiece.SentencePieceProcessor(model_file=pieces.path).normalize

    def ids(self, word: bytes, path: list[tuple[int, int, int]]) -> bytes:
        out, byte = array("i"), self.pieces.byte
        for start, end, piece in path:
            if piece >= 0:
                out.append(piece)
            elif byte:
                out.extend(byte[c] for c in word[start:end])
            elif not out or out[-1] != self.pieces.unknown_id:
                out.append(self.pieces.unknown_id)
        return out.tobytes()

    def learn(self, words: set[str]) -> None:
        sizes = defaultdict(list)
        for word in words:
            sizes[len(word.encode())].append(word)
        for size, same in sizes.items():
            for at in range(0, len(same), 4096):
                part = [w.encode() for w in same[at : at + 4096]]
                paths = search(self.pieces, part) if size <= LONG_WORD else [search_long(self.pieces, w) for w in part]
                self.known.update(zip(same[at : at + 4096], map(self.ids, part, paths)))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        split = [WORDS.findall(self.normalize(t)) if t else [] for t in texts]
        kinds = {w for words in split for w in words}
        new = {w for w in kinds if w not in self.known}
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known.clear()
            new = kinds
        self.learn(new)
        return [np.frombuffer(b"".join([self.known[w] for w in words]), np.int32) for words in split]


def decode(pieces: Pieces, ids: list[int] | np.ndarray) -> str:
    """The text of ``ids``: marks become spaces, byte pieces become bytes, and the space put in front goes."""
    data = b"".join([pieces.bytes_of[i] for i in ids])
    return data[1:].decode(errors="replace") if data[:1] == b" " else data.decode(errors="replace")


_encoders: dict[str, Encoder] = {}


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """One row per input row: the id and ``ids``, the pieces of the text with the highest sum of log scores.

    Characters that no piece has become their UTF-8 bytes' pieces. A NULL or empty text has no ids. NULL ids and repeated
    rows are rows like any other. An empty table gives an empty result. Texts are encoded whole; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(model))  # bounded by the vocabulary

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _encoders:
            _encoders[model] = Encoder(shared.value)
        encode = _encoders[model]
        for batch in batches:
            for part in slices(batch, "text"):
                found = encode(part.column("text").to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column("id"), ids], names=["id", "ids"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text_col}`").alias("text"))
    return over_batches(rows, work, added(rows, "ids array<int>")).withColumnRenamed("id", id_col)


def decode_pieces(encoded: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """The input and ``decoded``, the text of the ids. NULL or no ids give an empty text, NULL ids in an array are left out."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces(model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("own_ids")
            values, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            texts = [decode(shared.value, values[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])]
            lead = [c for c in batch.schema.names if c != "own_ids"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in lead] + [pa.array(texts, pa.string())], names=[*lead, "decoded"])

    rows = encoded.withColumn("own_ids", F.filter(F.coalesce(F.col(f"`{ids_col}`").cast("array<int>"), F.array().cast("array<int>")), lambda x: x.isNotNull()))
    return over_batches(rows, work, added(rows, "decoded string", drop="own_ids"))
