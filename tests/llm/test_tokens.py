"""Packing and SentencePiece against the public tokenizer libraries."""

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from scoretide.llm import packing, pieces
from scoretide.llm.packing import TOKENIZER, Packer, WordEncoder, pack


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def odd_texts():
    rnd = random.Random(1)
    pool = ["a<|endoftext|>b c", "ΑΣ ΑΣ.x Σ", "é ́e x y\x1cz don't 'sample !!'s 12a", "\x85a\xa0b İx Ⱥ ǅ ſs K", "½x² 'RE 'Ve \x00\x01 ×÷ ÿŒœ", "漢字 カナ ab", "it's'd'dd ''''s ª"]
    pool += ["".join(rnd.choice("ab'sdtverlm .,\n\x1c\x85\xa0éİſ½5_-😀ǅ") for _ in range(rnd.randrange(30))) for _ in range(1500)]
    return pool + ["".join(map(chr, range(0x250))), " ".join(map(chr, range(0x250, 0x2000)))]


def test_encoder_equals_the_tokenizer(tokenizer):
    encode = WordEncoder(TOKENIZER)
    for text in odd_texts():
        assert encode(text) == np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_encoder_forgets(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 50)
    encode = WordEncoder(TOKENIZER)
    for text in odd_texts()[:300]:
        assert encode(text) == np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_pack(docs, texts, tokenizer):
    got = pack(docs, keep_ids=True).collect()
    want = defaultdict(int)
    for i, t in texts:
        want[(i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2]))] += 1
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[(r.doc_id, r.doc_tokens)].append((r.start, tuple(r.ids)))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)
    total = sum(len(ids) * n for (_, ids), n in want.items())
    assert sum(r.length for r in got) == total
    for (doc, ids), n in want.items():
        found = documents[(doc, len(ids))]
        for start, part in found:
            assert any(part == other[start : start + len(part)] for (d, other), _ in want.items() if d == doc and len(other) == len(ids))
        assert sum(len(p) for _, p in found) == len(ids) * sum(m for (d, o), m in want.items() if d == doc and len(o) == len(ids))


def test_pack_edges(docs, clashing, empty):
    assert pack(empty).count() == 0
    assert pack(clashing).count() == pack(docs).count()


@pytest.mark.parametrize("open_bytes", [300, 2000, 1 << 40])
@pytest.mark.parametrize("sizes", [(1, 200), (33, 64), (64, 66)])
def test_packer_by_sum_of_squares(open_bytes, sizes):
    rnd = random.Random(3)
    packer, window, sizes = Packer(64, open_bytes), 64, [rnd.randrange(*sizes) for _ in range(400)]
    for row, size in enumerate(sizes):
        if size < window:
            counts = packer.counts.copy()
            options = []
            for level in range(window - size + 1):
                if level and not counts[level]:
                    continue
                after = counts.copy()
                after[level] -= level > 0
                after[level + size] += level + size < window
                options.append(((after[1:window] ** 2).sum(), level))
            best = min(cost for cost, _ in options)
            assert packer.level_for(size) in [level for cost, level in options if cost == best]
        packer.add(row, np.full(size, row, "<u4").tobytes())
    assert 4 * packer.held <= open_bytes // 2 + max(open_bytes // 2, 4 * window) and packer.held == sum(level * len(held) for level, held in packer.at.items())
    packer.finish()
    held = [sum(len(ids) // 4 for *_, ids in d) for d in packer.done]
    assert sum(held) == sum(sizes) and all(h == window or h & (h - 1) == 0 for h in held)
    assert sum(h < window for h in held) <= 6


def _varint(data, i):
    value = shift = 0
    while True:
        c, i = data[i], i + 1
        value |= (c & 127) << shift
        shift += 7
        if c < 128:
            return value, i


def _number(v):
    out = b""
    while v > 127:
        out, v = out + bytes([v & 127 | 128]), v >> 7
    return out + bytes([v])


def _fields(data):
    i = 0
    while i < len(data):
        tag, i = _varint(data, i)
        if tag & 7 == 0:
            value, i = _varint(data, i)
        elif tag & 7 == 2:
            n, i = _varint(data, i)
            value, i = data[i : i + n], i + n
        else:
            n = 4 if tag & 7 == 5 else 8
            value, i = data[i : i + n], i + n
        yield tag >> 3, tag & 7, value


def _put(field, wire, value):
    return _number(field << 3 | wire) + (_number(value) if wire == 0 else _number(len(value)) + value if wire == 2 else value)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces()


@pytest.fixture(scope="module")
def unigram(vocabulary):
    """The same pieces and scores in a model file that says unigram, read by the public library."""
    out, k = b"", 0
    for field, wire, value in _fields(open(pieces.MODEL, "rb").read()):
        if field == 1:
            value = b"".join(_put(f, w, struct.pack("<f", vocabulary.score[k]) if f == 2 else x) for f, w, x in _fields(value))
            k += 1
        if field == 2:
            value = b"".join(_put(f, w, 1 if f == 3 else x) for f, w, x in _fields(value))
        out += _put(field, wire, value)
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def test_search_equals_the_library(vocabulary, unigram, texts):
    encode = pieces.Encoder(vocabulary)
    cost = lambda ids: sum(vocabulary.score[i] for i in ids if i not in vocabulary.byte.values())
    own = [t for _, t in texts if t and len(t) < 5000] + [" ", "  a  b ", "\n\nx", "漢字かな😀", "a" * 500, "é" * 300 + " \t", "▁x"] + odd_texts()[:200]
    for text in own:
        if "\x00" in text:
            continue
        got, want = encode([text])[0].tolist(), unigram.encode(text)
        assert got == want or abs(cost(got) - cost(want)) < 1e-3, text[:80]
        assert pieces.decode(vocabulary, got) == unigram.decode(got)
        assert "▁" in text or pieces.decode(vocabulary, got) == text


def test_long_words_search_alike(vocabulary):
    rnd = random.Random(4)
    for _ in range(60):
        word = "".join(rnd.choice("abeinrst漢é😀") for _ in range(rnd.randrange(1, 40))).encode()
        assert pieces.search(vocabulary, [word])[0] == pieces.search_long(vocabulary, word)


def test_trie():
    keys = {b"a": 1, b"ab": 2, b"abc": 3, b"b": 4, b"\xff\x00": 5, b"bcd": 6}
    trie = pieces.DoubleArray(keys)

    def find(key):
        state = 0
        for c in key:
            move = trie.base[state] + c
            if trie.check[move] != state:
                return -1
            state = move
        return trie.value[state]

    assert all(find(k) == v for k, v in keys.items()) and find(b"bc") == find(b"c") == find(b"\xff") == -1


def test_pieces_round_trip(docs, texts, empty, clashing):
    found = pieces.decode_pieces(pieces.encode_pieces(docs))
    got = sorted(((r.doc_id, r.decoded) for r in found.collect()), key=str)
    assert got == sorted(((i, t or "") for i, t in texts), key=str)
    assert pieces.decode_pieces(pieces.encode_pieces(empty)).count() == 0
    assert pieces.encode_pieces(clashing).count() == len(texts)
    assert pieces.decode_pieces(docs.selectExpr("doc_id", "cast(null as array<int>) ids")).where("decoded <> ''").count() == 0
