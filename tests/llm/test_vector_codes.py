"""Vector codes against plain k-means over whole numbers."""

import hashlib

import numpy as np
import pytest

from tabulith.llm import vector_codes


def plain(rows, parts=8, entries=16, rounds=6):
    """``rows``: (vec_id, cells) in order of vec_id."""
    x = np.array([c for _, c in rows], np.int64)
    books = [b.copy() for b in np.array_split(x[:entries], parts, axis=1)]
    pieces = np.array_split(x, parts, axis=1)
    for step in range(rounds + 1):
        gaps = [((p[:, None, :] - b[None, :, :]) ** 2).sum(axis=2) for p, b in zip(pieces, books)]
        own = [g.argmin(axis=1) for g in gaps]
        if step < rounds:
            for p, b, o in zip(pieces, books, own):
                for e in range(len(b)):
                    if (o == e).any():
                        b[e] = p[o == e].sum(axis=0) // (o == e).sum()
    code = ["".join(f"{o[k]:02x}" for o in own) for k in range(len(x))]
    error = [int(sum(g[k, o[k]] for g, o in zip(gaps, own))) for k in range(len(x))]
    text = ",".join(str(v) for b in books for v in b.ravel().tolist())
    return {i: (c, e) for (i, _), c, e in zip(rows, code, error)}, hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("seed", range(4))
def test_move_is_exact_and_skips(seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(-6 if seed < 2 else -4000, 6 if seed < 2 else 4000, (3000, 4))
    entries = points[rng.integers(0, len(points), 16)]  # equal entries occur
    gaps = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    for own in (np.zeros(len(points), np.int64), gaps.argmin(axis=1), rng.integers(0, 16, len(points))):
        best, error, taken = vector_codes.move(points, own, entries)
        assert (best == gaps.argmin(axis=1)).all() and (error == gaps.min(axis=1)).all()
    near = entries[rng.integers(0, 16, 3000)] + rng.integers(-1, 2, (3000, 4))
    wide = np.arange(16)[:, None] * 1000 + np.zeros((16, 4), np.int64)
    own = rng.integers(0, 16, 3000)
    _, _, taken = vector_codes.move(wide[own] + (near % 3), own, wide)
    assert taken == 3000  # all points lie in stable cores


@pytest.mark.parametrize("width,n", [(64, 400), (13, 90), (5, 30), (16, 9)])
def test_equals_plain(spark, width, n):
    rng = np.random.default_rng(width)
    values = np.round(rng.normal(0, 0.2, (n, width)), 2)
    values[n // 3: n // 2] = values[0]  # a group of equal vectors
    rows = [(int(i), [float(v) for v in values[i]], int(i % 3) if i % 4 else None) for i in rng.permutation(n)]
    coded, books = vector_codes.encode(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5))
    want, digest = plain([(i, np.floor(4096 * values[i]).astype(np.int64)) for i in range(n)])
    got = vector_codes.labelled_error(coded).collect()
    assert {r.id: (bytes(r.code).hex(), r.error) for r in got} == want and books.digest() == digest
    for label in (None, 0, 1, 2):
        total = sum(r.error for r in got if r.label == label)
        assert {r.label_error for r in got if r.label == label} <= {total}


def test_edges(spark):
    schema = "vec_id long, embedding array<double>, label int, error string, code int, cells int"
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.1] * 8, 1, "e", 2, 3), (1, [0.1] * 8, 1, "e", 2, 3), (2, None, 1, "e", 2, 3), (3, [0.1] * 7 + [None], 1, "e", 2, 3),
        (4, [nan] * 8, None, "e", 2, 3), (5, [inf] + [0.0] * 7, 1, "e", 2, 3), (None, [0.2] * 8, None, "e", 2, 3),
        (6, [0.1] * 3, 1, "e", 2, 3), (7, [1e30] * 8, 1, "e", 2, 3), (8, [], 1, "e", 2, 3),
    ]
    coded, books = vector_codes.encode(spark.createDataFrame(rows, schema))
    got = sorted((r.id or 0, bytes(r.code).hex(), r.error, r.label_error) for r in vector_codes.labelled_error(coded).collect())
    assert got == [(0, "02" * 8, 0, 0), (1, "00" * 8, 0, 0), (1, "00" * 8, 0, 0)]
    coded, books = vector_codes.encode(spark.createDataFrame([], schema))
    assert coded.count() == 0 and books is None and vector_codes.labelled_error(coded).count() == 0
