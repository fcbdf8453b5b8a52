"""Groups of near copies against all pairs, at several widths and thresholds."""

import random
import time

import numpy as np
import pytest

from tabulith.llm.near_dup import near_duplicate_groups, shingle_sets, word_hashes
from tabulith.llm.rows import Hashes, hash_words, plain_words


def texts() -> list[tuple[int, str]]:
    rng = random.Random(3)
    vocabulary, out = [f"w{i}" for i in range(300)], []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 120]))]
        for _ in range(25):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary)]
            out.append((len(out), " ".join(words)))
    return out


def all_pairs(docs, width, numer, denom) -> dict[int, int]:
    sets = []
    for _, text in docs:
        words = text.split()
        k = min(width, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)})
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if denom * len(sets[i] & sets[j]) >= numer * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return dict(enumerate(group))


@pytest.mark.parametrize("width, numer, denom", [(4, 85, 100), (5, 80, 100), (2, 60, 100)])
def test_groups(spark, monkeypatch, width, numer, denom):
    monkeypatch.setattr("tabulith.llm.near_dup.TILE", 7)
    docs = texts()
    rows = near_duplicate_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), width=width, numer=numer, denom=denom)
    assert {r.id: r.component for r in rows.collect()} == all_pairs(docs, width, numer, denom)


def odd_texts() -> list[bytes | None]:
    rng = random.Random(9)
    long = [bytes([65 + n % 5]) * n for n in range(1, 45)]
    words = long + [w[:-1] + b"\0" for w in long] + [w + b"\0" for w in long] + ["Żółw".encode(), "\u00a0\u2003".encode(), b"\x1c\x1f", b"x" * 70_000]
    texts = [None, b"", b" \t\n\x0b\x0c\r ", b"one", b" Two  words\n", b"A b\tc", b"a B c d", b"a b c d a b c d"]
    for _ in range(60):
        texts.append(rng.choice([b" ", b"\r\n", b"\x0b"]).join(rng.choice(words) for _ in range(rng.randrange(12))))
    return texts + [None, b"tail"]


def test_word_hashes_tell_words_apart():
    texts = odd_texts()
    words = [plain_words(t) for t in texts]
    h, n = word_hashes(texts)
    assert n.tolist() == [len(w) for w in words]
    pairs = set(zip((w for own in words for w in own), h.tolist()))
    assert len(pairs) == len({w for w, _ in pairs}) == len({x for _, x in pairs})


@pytest.mark.parametrize("width", [1, 3, 4])
def test_shingle_sets_follow_the_shingles(width):
    texts, named = odd_texts(), {}
    for text, found in zip(texts, shingle_sets(texts, width), strict=True):
        words = plain_words(text)
        k = min(width, len(words))
        expected = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()
        assert len(found) == len(expected) and (np.diff(found.astype(object)) > 0).all()
        named[frozenset(expected)] = found
    for x, own in named.items():
        for y, other in named.items():
            assert len(np.intersect1d(own, other)) == len(x & y)
    assert [s.tolist() for s in shingle_sets([texts[6]], width)] == [shingle_sets(texts, width)[6].tolist()]
    assert [len(s) for s in shingle_sets([None, b""], width)] == [0, 0]


def test_shingling_costs_less_than_looking_up_each_word():
    rng = random.Random(4)
    texts = [b" ".join(b"%x" % rng.randrange(1 << 18) for _ in range(400)) for _ in range(400)]

    def seconds(work):
        start = time.process_time()
        work()
        return time.process_time() - start

    plain = min(seconds(lambda: [hash_words(c, plain_words(t)) for c in [Hashes()] for t in texts]) for _ in range(3))
    assert 3 * min(seconds(lambda: shingle_sets(texts, 4)) for _ in range(3)) < plain
