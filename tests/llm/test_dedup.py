"""Exact, SimHash and substring dedup against brute force."""

import collections
import glob
import hashlib
import os
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.errors import PythonException
from pyspark.sql import functions as F

import corpus_pipeline
from scoretide import session
from scoretide.llm import exact_dedup, passages, simhash
from scoretide.llm.common import FREE_SHUFFLES
from scoretide.llm.components import components, forest
from scoretide.llm.exact_dedup import content_sort
from scoretide.llm.passages import Blocks, Dictionary, Sums, Words, _spell, drop_repeats, leaders
from scoretide.llm.simhash import near_duplicates


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def roots_of(n, pairs):
    low = list(range(n))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("share", [2, 1024])  # every text of a pair or more is hot, or few are
@pytest.mark.parametrize("keep_rows", [False, True])
def test_exact(spark, docs, texts, monkeypatch, share, keep_rows):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", share)
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    want = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: m[:2] + ((m[2] or 0),))[2]
        want += [(m[2], best, len(members), hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    found = content_sort(docs, keep_rows=keep_rows)
    assert rows_of(found, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=str)
    kept = found.where("kept").groupBy("text_sha256").count().collect()
    assert len(kept) == len(groups) and all(r["count"] == 1 for r in kept)
    assert found.where("kept and not (doc_id <=> keep_id)").count() == 0


def test_exact_edges(docs, clashing, empty):
    assert content_sort(empty).count() == 0
    assert rows_of(content_sort(clashing), "doc_id", "keep_id") == rows_of(content_sort(docs), "doc_id", "keep_id")
    rows = content_sort(clashing, keep_rows=True).where("kept").select("row.*")
    assert rows.columns == clashing.columns


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("tile", [4, 1024])
def test_simhash(docs, texts, monkeypatch, tile):
    monkeypatch.setattr(simhash.links, "__defaults__", (None, tile))
    prints = [brute_fingerprint(t) for _, t in texts]
    own = np.array(prints, dtype=np.uint64)
    pairs = [(i, j) for i in range(len(own)) for j in np.flatnonzero(np.bitwise_count(own[i] ^ own) <= 2)]
    roots = roots_of(len(own), pairs)
    least = {}
    for (i, _), r in zip(texts, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = [(i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(texts, prints, roots)]
    found = near_duplicates(docs)
    assert rows_of(found, "doc_id", "fingerprint", "component_id") == sorted(want, key=str)
    assert found.where("kept").count() == len(set(roots))


def test_simhash_edges(docs, clashing, empty):
    assert near_duplicates(empty).count() == 0
    assert near_duplicates(clashing, keep_rows=True).where("kept").select("row.*").columns == clashing.columns


def jaccard(a, b):
    a, b = (set(zip(*[t.lower().split()[k:] for k in range(5)])) for t in (a, b))
    return len(a & b) / max(1, len(a | b))


def test_near_copies_by_similarity(docs, texts):
    found = near_duplicates(docs, radius=10, similarity=0.8)
    groups = {r.doc_id: r.component_id for r in found.where("doc_id >= 10").collect()}
    assert {groups[k] for k in range(100, 112)} == {100}
    own = dict(t for t in texts if t[0])
    for doc, group in groups.items():
        if group != doc:
            assert any(jaccard(own[doc], own[other]) >= 0.7 for other, g in groups.items() if g == group and other != doc)


def edited(rnd, words, kind, share):
    """``words`` with edits that leave about ``share`` of the five-word shingles in common."""
    n, gone = len(words), 1 - 2 * share / (1 + share)  # shingles of either text that the other lacks
    out = list(words)
    if kind == "scattered":
        for k in rnd.choice(n, max(1, round(gone * n / 5)), replace=False):
            out[k] = f"new{rnd.integers(10**9)}"
    elif kind == "contiguous":
        size = max(1, round(gone * n) - 4)
        at = int(rnd.integers(5, n - size - 5))
        out[at : at + size] = [f"new{rnd.integers(10**9)}" for _ in range(size)]
    else:
        out += [f"new{rnd.integers(10**9)}" for _ in range(round(n / share) - n)]
    return out


@pytest.mark.parametrize("tile", [100, 1024])
def test_links_are_all_pairs_by_exact_similarity(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash.links, "__defaults__", (None, tile))
    rnd, texts = np.random.default_rng(3), []
    for k in range(600):
        base = [f"w{x}" for x in rnd.integers(0, 5000, int(rnd.integers(60, 400)))]
        texts += [base, edited(rnd, base, ("scattered", "contiguous", "appended")[k % 3], rnd.uniform(0.77, 0.86))]
    line = [f"w{x}" for x in rnd.integers(0, 5000, 84)]  # 80 shingles: 20 more make 0.8 exactly, 21 less
    texts += [line, line + [f"x{k}" for k in range(20)], line[:50] * 9, line[:50] * 2 + line[:4]]
    line = [f"w{x}" for x in rnd.integers(0, 5000, 84)]
    texts += [line, line + [f"y{k}" for k in range(21)]]
    texts = [" ".join(t) for t in texts]
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for t in texts]
    pairs = [(k, k + 1) for k in range(0, len(texts), 2) if jaccard(texts[k], texts[k + 1]) >= 0.8]
    assert 250 < len(pairs) < 560 and jaccard(texts[1200], texts[1201]) == 0.8 > jaccard(texts[1204], texts[1205]) and sets[1202] == sets[1203]
    want = roots_of(len(texts), pairs)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = near_duplicates(df, radius=corpus_pipeline.RADIUS, similarity=corpus_pipeline.SIMILARITY)
    assert rows_of(found, "doc_id", "component_id") == sorted(enumerate(want), key=str)


def test_components(spark):
    rnd = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rnd.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(500, 600)] + [(700, k) for k in range(701, 760)]
    want = roots_of(800, pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got.get(k, k) == want[k] for k in range(800))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_keeps_what_is_connected():
    rnd = np.random.default_rng(2)
    for n, m in ((50, 20), (50, 200), (300, 280), (2, 2)):
        a, b = rnd.integers(0, n, m), rnd.integers(0, n, m)
        x, y = forest(a, b, n)
        assert len(x) < n or m < 2
        assert roots_of(n, zip(x, y)) == roots_of(n, zip(a, b))


def brute_repeats(texts, window=35):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in texts]
    seen = collections.Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(texts, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats(spark, texts):
    more = texts + [(900, "a " * 100), (901, "a b " * 40), (901, "a b " * 40), (902, "x\x1cy " + texts[-3][1][:900])]
    df = spark.createDataFrame(more, "doc_id long, text string")
    found = drop_repeats(df, keep_text=True)
    assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(more)
    assert found.where(F.sha2("kept_text", 256) != F.col("kept_sha256")).count() == 0


def test_repeats_edges(docs, clashing, empty):
    assert drop_repeats(empty).count() == 0
    assert rows_of(drop_repeats(clashing), "doc_id", "n_removed") == rows_of(drop_repeats(docs), "doc_id", "n_removed")


def test_repeats_over_shards(spark, monkeypatch, tmp_path):
    """Passages in changing surroundings, over many shards: blocks that recur whole, in part, and inside longer ones."""
    monkeypatch.setattr(passages, "SHARD_BYTES", 3_000)
    rnd = np.random.default_rng(4)
    shared = [[f"p{k}w{j}" for j in range(rnd.integers(30, 90))] for k in range(8)]
    texts = []
    for i in range(160):
        words = []
        for _ in range(rnd.integers(1, 5)):
            words += [f"n{x}" for x in rnd.integers(0, 10**9, rnd.integers(0, 30))]
            p = shared[rnd.integers(0, 8)]
            a = rnd.integers(0, len(p) // 2)
            words += p[a : a + rnd.integers(20, 90)] * int(rnd.integers(1, 3))
        texts.append((i, " ".join(words)))
    texts += [(200 + k, " ".join(rnd.choice(["a", "b"], 120))) for k in range(6)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    df.write.parquet(f"{tmp_path}/docs")
    found = drop_repeats(spark.read.parquet(f"{tmp_path}/docs"))
    assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(texts)
    with pytest.raises(PythonException, match="store them first"):  # round robin deals other columns to other partitions
        drop_repeats(df)


def test_repeats_leave_the_disk(spark, texts, tmp_path, monkeypatch):
    """Steps that are over leave no shuffle files behind, and of the tables only the one that the result reads. The setting for that is as before."""
    monkeypatch.setattr(passages, "SHARD_BYTES", 3_000)
    monkeypatch.setattr(session, "shared_dir", lambda _: f"{tmp_path}/shared")
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    docs.agg(F.sum(F.octet_length("text"))).first()
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {os.path.basename(f).split("_")[1] for d in disk.localDirsString() for f in glob.glob(f"{d}/*/shuffle_*")}

    for was in (None, "false"):
        (spark.conf.unset if was is None else lambda k: spark.conf.set(k, was))(FREE_SHUFFLES)
        before = shuffles()
        found = drop_repeats(docs)
        end = time.time() + 20
        while len(shuffles() - before) > 1 and time.time() < end:  # they go in the background; one is of the sum of lengths
            time.sleep(0.2)
        assert len(shuffles() - before) <= 1
        assert spark.conf.get(FREE_SHUFFLES, None) == was
        assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(texts)
        assert {n.split("-")[0] for n in os.listdir(f"{tmp_path}/shared")} == {"located"}
    spark.conf.unset(FREE_SHUFFLES)


def test_leaders():
    rnd = np.random.default_rng(5)
    for width in (1, 2, 3, 7, 24):
        x = rnd.integers(0, 9, 60).astype(np.uint64)
        assert leaders(x, width).tolist() == [k + int(x[k : k + width].argmin()) for k in range(len(x) - width + 1)]


def test_blocks_come_from_the_automaton():
    """Blocks are found where the dictionary's words occur and nowhere else, also in documents that never were hashed for phrases."""
    number = Words()
    text = [f"w{k % 50}" for k in range(130)]
    ids = number([w.encode() for w in text])
    blocks = Blocks(number.hashes[ids], 35, 12)
    rows = [{"words": " ".join(text[at : at + 12]), "layout": int(layout), "body": int(body.astype(np.int64)), "n": 1, "whole": True, "speaks": False}
            for at, layout, body in zip(blocks.at.tolist(), blocks.layout, blocks.body)]
    table = pa.Table.from_pylist(rows, pa.schema([("words", pa.string()), ("layout", pa.int32()), ("body", pa.int64()), ("n", pa.int64()), ("whole", pa.bool_()), ("speaks", pa.bool_())]))
    sums = Sums(number.hashes[ids])
    assert len(number.ids) == 50  # of 64 symbols; below a dictionary whose words need two
    _, first, size = Dictionary(table, number, 35, 12).blocks(ids, sums)
    told = {int(k) for a, n in zip(first, size) for k in range(a, a + n)}
    assert told == set(range(len(text) - 34))
    number([f"y{k}".encode() for k in range(5000)])
    _, again, _ = Dictionary(table, number, 35, 12).blocks(ids, sums)
    assert again.tolist() == first.tolist()
    other = number([b"w0"] + [f"x{k}".encode() for k in range(60)])
    assert not len(Dictionary(table, number, 35, 12).blocks(other, Sums(number.hashes[other]))[0])
    assert not len(Dictionary(table.slice(0, 0), number, 35, 12).blocks(ids, sums)[0])


def test_word_hashes(monkeypatch):
    """A word has one hash wherever it stands, alone or between others, and other words have others."""
    rnd = np.random.default_rng(2)
    words = [bytes(rnd.choice([*b"abc!", 0, 0x1C, 0x85, 0xC3, 0xA9, 255], n).astype(np.uint8)) for n in (1, 2, 3, 31, 32, 33, 90) for _ in range(20)]
    alone = {w: int(passages.word_hashes(w)[0]) for w in words}
    assert len(set(alone.values())) == len(alone)
    text = b"\t" + b" \n ".join(words) + b"\r\x0b\x0c "
    assert text.split() == words
    for stretch in (1 << 20, 64, 1):
        monkeypatch.setattr(passages, "STRETCH", stretch)
        assert passages.word_hashes(text).tolist() == [alone[w] for w in words]
    number = Words()
    assert number.hashed(words[:50]).tolist() + number.hashed(words).tolist() == [alone[w] for w in words[:50] + words]
    assert not len(passages.word_hashes(b"")) and not len(passages.word_hashes(b" \n "))


def test_spelling_finds_changed_documents(spark):
    number = Words()
    words = [f"w{k}".encode() for k in range(40)]
    blocks = Blocks(number.hashed(words), 35, 12)
    asked = [{"at": int(a), "phrase": int(p.astype(np.int64)), "tag": int(t)} for a, p, t in zip(blocks.at, blocks.phrase, blocks.tag)]
    schema = pa.schema([("text", pa.string()), ("asked", pa.list_(pa.struct([("at", pa.int32()), ("phrase", pa.int64()), ("tag", pa.int32())])))])

    def batch(text):
        return pa.RecordBatch.from_pylist([{"text": text, "asked": asked}], schema)

    said = next(_spell(12)(iter([batch(b" ".join(words).decode())]))).column("words").to_pylist()
    assert said == [b" ".join(words[a : a + 12]).decode() for a in blocks.at]
    for text in ("w0 w1", " ".join(f"w{k + 1}" for k in range(40))):
        with pytest.raises(ValueError):
            next(_spell(12)(iter([batch(text)])))
