import hashlib
import random
import zlib

import pytest

from scoretide.llm.periodic import SquareCatcher, collapsed, find_runs, periodic_runs, run_report, with_planted_period


def all_runs(words, repeats=2, least=2):
    """Every run by comparing words at every distance."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i >= p:
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((s, e - s, p) for (s, e), p in found.items() if e - s >= max(least, repeats * p)), key=lambda r: (r[0], r[2]))


def made(rnd):
    n, kinds = rnd.randrange(0, 120), rnd.choice([1, 2, 2, 3, 6])
    words = [chr(97 + rnd.randrange(kinds)) for _ in range(n)]
    for _ in range(rnd.randrange(3)):
        if n:
            a, p = rnd.randrange(n), rnd.randrange(1, n // 2 + 2)
            b = min(n, a + p * rnd.randrange(1, 9))
            words[a:b] = [words[min(a + (i - a) % p, n - 1)] for i in range(a, b)]
    return words


def test_catcher_finds_every_run():
    rnd = random.Random(7)
    for _ in range(1500):
        words = made(rnd)
        catcher = SquareCatcher()
        for word in words:
            catcher.append(word)
        assert catcher.finish() == all_runs(words), words
        assert periodic_runs(words) == all_runs(words, 4, 6), words


def test_fibonacci_and_long_periods():
    a, b = "a", "ab"
    while len(b) < 600:
        a, b = b, b + a
    assert periodic_runs(list(b), 2, 2) == all_runs(list(b))
    words = [str(i % 997) for i in range(4500)]
    assert periodic_runs(words) == [(0, 4500, 997)]


def test_open_comparisons_stay_few():
    catcher, most = SquareCatcher(), 0
    for k in range(3000):
        catcher.append("ab"[k % 2] if k < 2000 else "c")
        most = max(most, len(catcher.open))
    assert most <= 6 and sum(map(len, catcher.waiting.values())) < 60


def report(rows):
    out = {}
    for doc, text in rows:
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in text or "").split(" ") if w]
        n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
        if n and h % 10 == 0:
            a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = all_runs(words, 4, 6)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.setdefault((doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()), 0)
    return set(out)


def test_report_equals_brute_force(spark, docs, texts):
    rows = [(i, t) for i, t in texts if len(t or "") < 50_000]
    got = run_report(find_runs(docs.where("length(text) < 50000 or text is null"), planted=True))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(rows) and set(got) == report(rows)
    assert sum(r[1] > 0 for r in got) > 40


def test_query_over_the_whole_table(spark, sf):
    from scoretide.llm.queries import QUERIES

    got = QUERIES["op13_periodic_runs"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    small = [(r.doc_id, r.text) for r in docs if len(r.text or "") < 20_000]
    assert len(got) == len(docs)
    assert report(small) <= {tuple(r) for r in got}


def test_odd_inputs(spark, docs, empty, clashing):
    assert find_runs(empty).count() == 0
    assert find_runs(clashing).count() == docs.count()
    long = docs.where("doc_id = 300")
    assert run_report(find_runs(long)).first()["n_runs"] == 0
    rows = [(None, None), (1, ""), (2, "x " * 5), (3, "x " * 6), (3, "x " * 6), (4, "a b a b a b a b"), (5, "\x00 " * 7)]
    got = {(r.doc_id, len(r.runs), r.collapsed) for r in find_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, 0, ""), (1, 0, ""), (2, 0, "x x x x x"), (3, 1, "x"), (4, 1, "a b"), (5, 1, "\x00")}
    raw = spark.sql("select 6L as doc_id, cast(X'FF20FF20FF20FF20FF20FF20FF' as string) as text")
    assert find_runs(raw).first()["collapsed"] == "�"


@pytest.mark.parametrize("doc_id", [None, 0, 7, 19])
def test_planted_period_keeps_length(doc_id):
    words = [str(i) for i in range(50)]
    assert len(with_planted_period(words, doc_id)) == 50 and with_planted_period([], doc_id) == []
    assert collapsed(words, []) == words
