"""The suffix tree against a plain tree over dictionaries."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tabulith.llm.suffix_tree_lm import SuffixTreeModel


class PlainTree:
    """Longest kept context of a token, found and smoothed one by one."""

    def __init__(self, texts, depth, context_count, next_count, divergence, discount=0.5):
        self.single = Counter(w for t in texts for w in [*t, None])
        self.total, self.depth = sum(self.single.values()), depth
        self.nodes, self.candidates = {}, [0] * (depth + 1)
        seen = [Counter() for _ in range(depth + 1)]
        for t in texts:
            t = [*t, None]
            for i in range(len(t)):
                for d in range(1, min(depth, i) + 1):
                    seen[d][tuple(t[i - d:i]), t[i]] += 1
        wide = {(w,): n for w, n in self.single.items() if w is not None and n >= context_count}
        for d in range(1, depth + 1):
            self.candidates[d] = len(wide)
            after = defaultdict(dict)
            for (c, w), n in seen[d].items():
                if c in wide and n >= next_count:
                    after[c][w] = n
            new = {}
            for c, words in after.items():
                total = wide[c]
                low = {w: self.chance(c[1:], w) for w in words}
                mass, below = sum(words.values()) / total, sum(low.values())
                apart = sum(n / total * math.log(n / total / low[w]) for w, n in words.items())
                if mass < 1:
                    apart += (1 - mass) * math.log((1 - mass) / max(1 - below, 1e-9))
                if apart >= divergence:
                    listed = {w: (n - discount) / total for w, n in words.items()}
                    new[c] = (listed, max(1 - sum(listed.values()), 1e-12) / max(1 - below, 1e-9))
            self.nodes |= new
            wide = {(*c, w): n for (c, w), n in seen[d].items() if c in after and n >= max(context_count, next_count) and w is not None}

    def chance(self, context, word):
        """Probability after a context of at most ``depth`` words."""
        if not context:
            return (self.single[word] + 1) / (self.total + len(self.single) + 1)
        if context not in self.nodes:
            return self.chance(context[1:], word)
        listed, fall = self.nodes[context]
        return listed[word] if word in listed else fall * self.chance(context[1:], word)

    def score(self, text):
        t = [*text, None]
        return sum(math.log10(self.chance(tuple(t[max(0, i - self.depth):i]), w)) for i, w in enumerate(t))


def made(seed, n=150):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(12)]
    out = []
    for k in range(n):
        t = []
        while len(t) < rnd.randrange(0, 30):
            t += rnd.choice([["w1", "w2", "w3", rnd.choice(["w4", "w5"])], ["w9", "w2", "w3", "w6"], [rnd.choice(words)], [f"rare{rnd.randrange(40)}"]])
        out.append(t)
    return out


@pytest.mark.parametrize("depth,share", [(3, 0.0), (3, 1.0), (4, 0.02), (2, 0.02), (1, 0.02), (0, 0.02)])
def test_equals_plain_tree(spark, depth, share):
    texts = made(1)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    model = SuffixTreeModel(docs, F.col("doc_id") < 100, depth=depth, context_count=20, next_count=3, travel_share=share)
    plain = PlainTree(texts[:100], depth, 20, 3, 0.01)
    assert [c for c, _, _ in model.levels] == plain.candidates[1:]
    assert sum(k for _, k, _ in model.levels) == len(plain.nodes) and sum(n for *_, n in model.levels) == sum(len(x) for x, _ in plain.nodes.values())
    if depth == 3:
        # The test drops contexts and keeps long ones.
        assert len(plain.nodes) < sum(plain.candidates) and any(len(c) == 3 for c in plain.nodes)
        assert share < 1 or not len(model.known.keys)
    for r in model.score(docs).collect():
        assert r.score == pytest.approx(plain.score(texts[r.id]), rel=1e-9)
    vocabulary = [*plain.single, "never seen"]
    for context in [(), ("w1",), ("w1", "w2"), ("w1", "w2", "w3"), ("rare1", "w2", "w3"), ("w9", "w2", "w3")]:
        assert sum(plain.chance(context[max(0, len(context) - depth):], w) for w in vocabulary) == pytest.approx(1)


def test_tree_grows(spark):
    """More text of the same kind gives more contexts and more listed pairs."""
    sizes = []
    for n in (150, 600):
        docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(made(2, n))], "doc_id long, text string")
        model = SuffixTreeModel(docs, F.lit(True), context_count=20, next_count=3)
        sizes.append([sum(x) for x in zip(*model.levels)])
    assert all(b > a for a, b in zip(*sizes))
