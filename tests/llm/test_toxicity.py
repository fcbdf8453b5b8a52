"""Toxicity models against a plain version, held-out accuracy, edge cases."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulith.llm import llm_queries, toxicity
from tabulith.llm.rows import Hashes


def plain_model(texts, word_bar, pair_bar):
    """``texts``: (words, toxic); returns P(word | before) of both classes."""
    triples = set()
    for words, toxic in texts:
        padded = ["^", "^", *words]
        triples |= {(toxic, *padded[i - 2:i + 1]) for i in range(2, len(padded))}
    pair, single = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for c, _, h, w in triples:
        pair[h, w][c] += 1
    for (_, w), n in pair.items():
        for c in (0, 1):
            single[w][c] += n[c] > 0

    def discount(counts):
        one, two = sum(n == 1 for n in counts), sum(n == 2 for n in counts)
        return one / (one + 2 * two) if one and two else 0.5

    both = {w: sum(n) for w, n in single.items()}
    d0, t0 = discount(both.values()), sum(both.values())
    kept = [w for w in single if both[w] >= word_bar]
    base = {w: (both[w] - d0) / t0 for w in kept}
    rest = (1 - sum(base.values())) / (len(single) - len(kept) + 1)
    part = []
    for c in (0, 1):
        d, t = discount([n[c] for n in single.values()]), sum(n[c] for n in single.values())
        part.append({w: max(single[w][c] - d, 0) / t for w in kept})
    freed = max(1 - sum(p.values()) for p in part)
    dp = [discount([n[c] for n in pair.values()]) for c in (0, 1)]
    heads = defaultdict(lambda: [0, 0])
    for (h, _), n in pair.items():
        heads[h] = [heads[h][c] + n[c] for c in (0, 1)]
    often = {k: n for k, n in pair.items() if sum(n) >= pair_bar}

    def chance(c, h, w):
        scale = (1 - freed) / sum(part[c].values()) if part[c] else 0
        low = part[c][w] * scale + freed * base[w] if w in base else freed * rest
        extra = lambda k: max(often[k][c] - dp[c], 0) / max(heads[k[0]][c], 1)
        follow = 1 - sum(extra(k) for k in often if k[0] == h)
        return follow * low + (extra((h, w)) if (h, w) in often else 0)

    return chance


def test_equals_plain_model(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{k}" for k in range(30)]
    texts = [
        ([rnd.choice(vocabulary[: 25 if k % 3 else 30]) for _ in range(rnd.randrange(0, 40))], int(k % 3 == 0)) for k in range(120)
    ]
    sample = spark.createDataFrame([(" ".join(w).encode(), t) for w, t in texts], "text binary, toxic int")
    model = toxicity.learn_model(sample, word_bar=20, pair_bar=3)
    chance = plain_model(texts, 20, 3)
    cache = Hashes()
    for words, _ in [*texts[:30], (["new", "w1", "w2", "new", "w29"], 0)]:
        hashes, before, _ = toxicity._tokens([" ".join(words).encode()], cache)
        got = model.ratios(hashes, before)
        want = [math.log(chance(1, h, w) / chance(0, h, w)) for h, w in zip(["^", *words], words)]
        assert got == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_figures():
    offsets = np.array([0, 3, 3, 4])
    got = toxicity.text_figures(np.array([1.0, 3.0, 2.0, -5.0]), offsets, (1, 2, 4))
    assert got.tolist() == [[2, 3, 2.5, 2], [0, 0, 0, 0], [-5, -5, -5, -5]]


def test_held_out(spark):
    """Held-out labels of the larger table; labels 0 stay low."""
    sf = "/root/testdata/sf0.1"
    scored = llm_queries()["op13_toxicity"](spark, sf)
    assert [t for _, t in scored.dtypes] == ["bigint", "boolean", "double", "int"]
    rows = scored.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    toxic, plain = [r.predicted for r in rows if r.toxic == 1], [r.predicted for r in rows if r.toxic == 0]
    assert sum(toxic) >= 0.8 * len(toxic) and sum(plain) <= 0.04 * len(plain)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_edges(spark):
    schema = "doc_id long, text string, toxic int, score string, rid int, figures string"
    rnd = random.Random(5)
    common = "the quick brown fox jumps over the lazy dog and runs home again today "

    def mixed(extra):
        words = [rnd.choice(common.split()) for _ in range(30)] + extra * 2
        return " ".join(rnd.sample(words, len(words)))

    rows = [(k, mixed(["vile", "worm"] if k % 2 else ["nice", "day"]), k % 5, "s", 1, "f") for k in range(200)]
    rows += [(300, None, 0, "s", 1, "f"), (301, "", 0, "s", 1, "f"), (302, " !! ", 0, "s", 1, "f"), (None, "you vile worm", 0, "s", 1, "f")]
    rows += [(303, common * 20_000 + "vile", 0, "s", 1, "f")] + [(304, "vile worm", 0, "s", 1, "f")] * 2
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame(
        [(k, k % 2) for k in range(200)] + [(7, 0), (8, None), (None, 1), (999, 1)], "doc_id long, toxic int"
    )
    fitted = toxicity.fit_toxicity(docs, labels)
    out = {}
    for r in toxicity.score_toxicity(docs, fitted).collect():
        out.setdefault(r.id, []).append(r.score)
    assert sum(map(len, out.values())) == len(rows) and out[300] == out[301] == out[302] and len(out[304]) == 2
    assert min(out[k][0] for k in range(1, 200, 2)) > 0.5 > max(out[k][0] for k in range(0, 200, 2))
    assert out[304][0] == out[304][1] > 0.3 and out[303][0] > out[300][0]
    none = spark.createDataFrame([], schema)
    assert toxicity.score_toxicity(none, fitted).count() == 0
    assert toxicity.fit_toxicity(none, labels).model is None
    alone = toxicity.fit_toxicity(docs, labels.where("toxic = 1"))
    assert alone.model is None and {r.score for r in toxicity.score_toxicity(docs, alone).collect()} == {1.0}
    assert toxicity.fit_toxicity(docs, labels.where("false")).share == 0.0
    once = toxicity.fit_toxicity(docs, labels, F.col("doc_id") % 4 != 3)
    assert once.model is not None
