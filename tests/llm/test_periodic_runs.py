"""Periodic runs against plain comparison at every distance."""

import random
import zlib

import numpy as np
import pytest
from brute import sha

from tabulith.llm import llm_queries, periodic_runs


def plain_runs(words, shortest=6, repeats=4):
    found = {}
    for q in range(1, len(words) // repeats + 1):
        k = 0
        while k + q < len(words):
            e = k
            while e + q < len(words) and words[e] == words[e + q]:
                e += 1
            if e > k and e + q - k >= max(shortest, repeats * q):
                found.setdefault((k, e + q), q)
            k = max(e, k + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def made(rnd):
    if rnd.random() < 0.3:
        return [rnd.randrange(rnd.choice([1, 2, 3])) for _ in range(rnd.randrange(90))]
    out = []
    for _ in range(rnd.randrange(1, 5)):
        block = [rnd.randrange(rnd.choice([2, 3, 50])) for _ in range(rnd.randrange(1, 40))]
        if rnd.random() < 0.3:  # a period that nearly holds a smaller one
            block = block[: max(1, len(block) // 2)] * 2 + [rnd.randrange(3)]
        out += (block * 8)[: rnd.randrange(len(block) * 7 + 1)] + [rnd.randrange(4) for _ in range(rnd.randrange(5))]
    return out


@pytest.mark.parametrize("seed", range(5))
def test_equals_plain_runs(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        texts = [made(rnd) for _ in range(rnd.randrange(1, 9))]
        sizes = [len(t) for t in texts]
        first, owner = np.r_[0, np.cumsum(sizes)], np.repeat(np.arange(len(texts)), sizes)
        words = np.array([w * 7919 + 13 for t in texts for w in t], np.uint64)
        want = sorted((s + first[k], s + n + first[k], q) for k, t in enumerate(texts) for s, n, q in plain_runs(t))
        got = periodic_runs.runs_of(words, owner)
        assert sorted(map(tuple, got.tolist())) == want


def test_any_period_of_a_scale():
    for q in (*range(1, 70), 127, 128, 129, 1000):
        words = np.r_[np.arange(50), np.resize(np.arange(q) + 100, 4 * q + 2), [5]].astype(np.uint64)
        got = periodic_runs.runs_of(words, np.zeros(len(words), np.int64))
        assert [50, 50 + max(4 * q + 2, 0), q] in got.tolist()


def planted(doc_id, text):
    words = (text or "").split()
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in llm_queries()["op11_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        words = planted(d.doc_id, d.text)
        if len(words) > 3000:
            continue
        runs, r = plain_runs(words), got[d.doc_id]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r.n_runs == len(runs) and r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda x: (x[0], x[2]))))
        assert r.collapsed_sha256 == sha(" ".join(w for i, w in enumerate(words) if i not in gone))
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        assert (r.start, r.length, r.period) == ((best[1], -best[0], best[2]) if best else (None,) * 3)
        assert r.exponent_milli == (1000 * -best[0] // best[2] if best else None)
        some += bool(runs)
    assert some > 10


def test_edges(spark):
    schema = "doc_id long, text string, n int, runs string, rid long, kept string"
    rows = [
        (1, None, 1, "x", 2, "k"), (2, "", 1, "x", 2, "k"), (3, " \n\t ", 1, "x", 2, "k"), (4, "a b " * 60_000, 1, "x", 2, "k"),
        (5, "ha " * 6, 1, "x", 2, "k"), (5, "ha " * 6, 1, "x", 2, "k"), (None, "haé " * 7, 1, "x", 2, "k"), (6, "ha " * 5, 1, "x", 2, "k"),
    ]
    out = {}
    for r in periodic_runs.find_runs(spark.createDataFrame(rows, schema)).collect():
        out.setdefault(r.id, []).append(([tuple(x) for x in r.runs], bytes(r.kept).decode(), r.n_words))
    assert out[1] == out[2] == out[3] == [([], "", 0)]
    assert out[4] == [([(0, 120_000, 2)], "a b", 120_000)]
    assert out[5] == [([(0, 6, 1)], "ha", 6)] * 2 and out[None] == [([(0, 7, 1)], "haé", 7)] and out[6][0][0] == []
    assert periodic_runs.find_runs(spark.createDataFrame([], schema)).count() == 0
    kept = {r.id: r.text for r in periodic_runs.collapse_runs(spark.createDataFrame(rows[:4], schema)).collect()}
    assert kept == {1: "", 2: "", 3: "", 4: "a b"}
