"""Periodic runs of words: stretches that repeat one block at least ``repeats`` times.

Windows of dyadic lengths get content hashes.  At scale ``t`` the synchronising set
holds the positions whose next ``t + 1`` windows of length ``t`` have their smallest
hash first or last, so membership depends on the ``2 t`` words that follow alone, and
any ``t`` neighbouring positions contain one.  A run of period ``t <= q < 2 t`` therefore
holds a position of the set together with its copy ``q`` words on, and no equal context
lies between them: neighbouring positions of equal context propose every period from
``t`` to ``2 t - 1``.  Closer pairs belong to highly periodic regions and are left to the
smaller scales; periods below ``SMALL`` are read off by comparing the words at each
distance.  A proposal grows both ways over the hashes, longest windows first, to the
maximal stretch.

All documents of an Arrow batch are worked on at once, each with an alphabet of its own,
so no stretch crosses documents; nothing is shuffled.  Memory follows the batch (about
``PIECE`` bytes of text, or one longer document).  Null, empty and blank texts have no
words and no run.  Repeated rows, null ids and repeated ids are separate rows.  An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .rows import Hashes, keyed, mix, pieces

#: Shortest run in words, and copies of its period that a run holds.
SHORTEST, REPEATS = 6, 4
#: Periods below this are found by direct comparison; a power of two.
SMALL = 4
PIECE = 2_000_000
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _doubled(names: np.ndarray, width: int) -> np.ndarray:
    """Hashes of windows twice as long; beyond the end a window has a hash of its own."""
    out = names * _LEFT
    out[:-width] += names[width:] * _RIGHT
    out[len(out) - min(width, len(out)):] += np.arange(1, min(width, len(out)) + 1, dtype=np.uint64)
    return mix(out)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` (a power of two) values from each position on."""
    out, reach = values.copy(), 1
    while reach < width:
        np.minimum(out[:-reach], out[reach:], out=out[:-reach])
        reach *= 2
    return out


def synchronising_set(names: np.ndarray, width: int) -> np.ndarray:
    """Positions whose ``width + 1`` windows from there on have the smallest hash first or last."""
    n = len(names) - width
    if n <= 0:
        return np.empty(0, np.int64)
    order = mix(names + np.uint64(width))
    lowest = np.minimum(_least(order, width)[:n], order[width:])
    return np.flatnonzero((lowest == order[:n]) | (lowest == order[width:]))


def _common(tower: list[np.ndarray], left: np.ndarray, right: np.ndarray, step: int) -> np.ndarray:
    """Equal words from ``left`` and ``right`` on (``step`` 1) or before them (-1); ``left < right``.

    A stretch is shorter than two windows of the highest level, so each level is taken once.
    """
    n = len(tower[0])
    found = np.zeros(len(left), np.int64)
    for level in range(len(tower) - 1, -1, -1):
        names, width = tower[level], 1 << level
        a, b = (left + found, right + found) if step > 0 else (left - found - width, right - found - width)
        inside = (a >= 0) & (b + width <= n)
        hit = inside & (names[np.maximum(a, 0)] == names[np.minimum(b, n - 1)])
        found[hit] += width
    return found


def runs_of(words: np.ndarray, owner: np.ndarray, shortest: int = SHORTEST, repeats: int = REPEATS) -> np.ndarray:
    """Rows ``start, end, period`` of all maximal runs, by start then period.

    ``words`` are 64-bit hashes; ``owner`` numbers the document of each word, ascending.
    """
    n = len(words)
    if not n:
        return np.empty((0, 3), np.int64)
    names = mix(words + mix(owner.astype(np.uint64) + np.uint64(1)))
    sizes = np.bincount(owner)
    longest = int(sizes.max())
    found = []
    for period in range(1, min(SMALL, longest)):
        same = np.r_[False, names[period:] == names[:-period], False]
        edge = np.flatnonzero(same[1:] != same[:-1])
        start, end = edge[::2], edge[1::2] + period
        keep = end - start >= max(shortest, repeats * period)
        found.append(np.column_stack([start, end, np.full(len(start), period)])[keep])
    tower = [names]
    while 2 << len(tower) - 1 <= longest:
        tower.append(_doubled(tower[-1], 1 << len(tower) - 1))
    for level in range(SMALL.bit_length() - 1, len(tower) - 1):
        width = 1 << level
        if repeats * width > longest:
            break
        near = synchronising_set(tower[level], width)
        # Documents too short for a run of this scale drop out.
        near = near[sizes[owner[near]] >= repeats * width]
        context = tower[level + 1][near]
        order = np.argsort(context, kind="stable")
        at, context = near[order], context[order]
        gap = at[1:] - at[:-1]
        pair = (context[1:] == context[:-1]) & (gap >= width) & (gap < 2 * width)
        left, period = at[:-1][pair], gap[pair]
        if len(left):
            ahead, behind = _common(tower, left, left + period, 1), _common(tower, left, left + period, -1)
            start, end = left - behind, left + period + ahead
            keep = end - start >= np.maximum(shortest, repeats * period)
            found.append(np.column_stack([start, end, period])[keep])
    every = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    # A stretch that is found under several periods has the smallest one.
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    first = np.ones(len(every), bool)
    first[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    every = every[first]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _search(shortest: int, repeats: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Hashes()
        for batch in pieces(batches, "text", PIECE):
            texts = [t.split() if t else [] for t in batch.column("text").to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            first = np.r_[0, np.cumsum(sizes)]
            words = np.fromiter((cache[w] for t in texts for w in t), np.uint64, int(first[-1]))
            owner = np.repeat(np.arange(len(texts)), sizes)
            runs = runs_of(words, owner, shortest, repeats)
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
            np.add.at(depth, runs[:, 1], -1)
            gone = np.cumsum(depth)[:-1] > 0
            of = owner[runs[:, 0]]
            bounds = np.searchsorted(of, np.arange(len(texts) + 1))
            kept = []
            for k, own in enumerate(texts):
                drop = gone[first[k]:first[k + 1]]
                kept.append(b" ".join([w for w, d in zip(own, drop.tolist()) if not d] if drop.any() else own))
            flat = pa.StructArray.from_arrays(
                [pa.array(runs[:, 0] - first[of]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], fields=list(_RUN)
            )
            yield pa.record_batch([
                batch.column("rid"), batch.column("id"), pa.array(sizes),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat), pa.array(kept, pa.binary()),
            ], ["rid", "id", "n_words", "runs", "kept"])

    return search


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, repeats: int = REPEATS,
) -> DataFrame:
    """One row per document: ``rid, id, n_words, runs, kept``.

    Words stand between ASCII white space and are numbered from 0.  ``runs`` lists
    ``start, length, period`` of every maximal stretch of at least ``shortest`` words and
    ``repeats`` periods, by start then period.  ``kept`` is the text, words joined by one
    space, without the words that a run holds after its first period (UTF-8 bytes).
    """
    if repeats < 4 or shortest < 1:
        raise ValueError("A run holds at least four periods and one word.")
    given = keyed(docs, id_col, text=docs[text_col].cast("string").cast("binary"))
    kind = dict(given.dtypes)["id"]
    return given.select("rid", "id", "text").mapInArrow(
        _search(shortest, repeats),
        f"rid long, id {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, kept binary",
    )


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text``: every document with each of its runs cut to one period; null texts become empty."""
    return find_runs(docs, id_col, text_col).selectExpr("id", "decode(kept, 'UTF-8') AS text")
