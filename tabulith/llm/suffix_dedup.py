"""Removal of repeated byte windows by depth-limited radix sorting of suffixes.

Only the order of suffixes through the first ``window`` bytes matters: equal groups
at that depth are exactly the repeated windows.  The sort takes passes of
growing digits, and a suffix leaves as soon as it is alone.

1. Suffixes are sampled at positions chosen by their own bytes (the smallest hash
   of ``grain`` bytes in each window), so equal windows sample the same suffix.
   Its first digit is that hash; each sample stands for the run of window starts
   that chose it.
2. The second digit is a hash of all bytes of the run.  Range partitioning by
   (digit, digit, document, position) sorts the samples; within an equal group all
   but the first are repeated, and a sample alone under its first digit is unique.
   As the document is part of the key, a passage of a third of the corpus is spread
   over many tasks.
3. Samples that share the first digit but not the second, and those at the ends of
   a task, are divided into short stretches of window starts, counted from the chosen
   position.  Their digits are the bytes common to all windows of the stretch and
   then all its bytes; they are sorted and settled in the same way.
4. What is still open is spread into single windows, sorted by their full digest.

What a pass settles depends on where its tasks begin, so the result of every pass is
written once before it is read by flag.

The texts are shuffled once by document; all passes and the final cut read that
exchange.

Nulls are empty texts; texts shorter than a window stay.  Of repeated rows the one
with the smaller key stays (see ``keyed``).  Windows are compared by 128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import keyed, mix, pieces, signed, stored

WINDOW = 100
GRAIN = 34
#: Window starts in a stretch of the third pass.
STRETCH = 16
#: Text bytes hashed at once by a task.
PIECE = 1_000_000
_CHUNK = 1 << 16
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


class Polynomials:
    """Hashes of any stretch of a byte buffer from prefix sums modulo 2**64."""

    _tables = [np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (11, 29)]
    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, which: int):
        n = len(data) + 1
        held = self._powers.get(which)
        if held is None or len(held[0]) < n:
            base = _BASES[which]
            size = max(n, 1 << 20)
            up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            held = self._powers[which] = (np.cumprod(up), np.cumprod(down))
        self.down = held[1]
        terms = self._tables[which][data]
        terms *= held[0][: n - 1]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(terms, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def rolling(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:-width]) * self.down[:n] if n > 0 else np.empty(0, np.uint64)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and the ``len + 1`` offsets of its rows."""
    column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def samples(data: np.ndarray, offsets: np.ndarray, window: int, grain: int) -> tuple[np.ndarray, ...]:
    """``(first digit, second digit, row, start, n, lead)`` of each run of window starts.

    The chosen position is ``lead`` bytes after the first start of the run.
    """
    first = Polynomials(data, 0)
    rolled = mix(first.rolling(grain))
    span = window - grain + 1
    total = len(rolled) - span + 1
    marks = np.zeros(max(1, len(data) + 1), np.int32)
    whole = np.diff(offsets) >= window
    np.add.at(marks, offsets[:-1][whole], 1)
    np.add.at(marks, offsets[1:][whole] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(marks))
    if not len(starts):
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none
    chosen = np.empty(total, np.int64)
    low = np.uint64(_CHUNK - 1)
    step = _CHUNK - span
    for s in range(0, total, step):
        part = rolled[s : s + step + span - 1]
        best = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        if width < span:
            gap = span - width
            best = np.minimum(best[:-gap], best[gap:])
        chosen[s : s + len(best)] = s + (best & low).astype(np.int64)
    at = chosen[starts]
    cut = np.flatnonzero((at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))
    left, right = starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]]
    anchor = at[np.r_[0, cut + 1]]
    row = np.searchsorted(offsets, left, "right") - 1
    n = right - left + 1
    second = Polynomials(data, 1).of(left, right + window) ^ (n.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return rolled[anchor], second, row, left - offsets[row], n, anchor - left


def _sampler(window: int, grain: int):
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            data, offsets = buffer_of(batch.column("text"))
            d1, d2, row, start, n, lead = samples(data, offsets, window, grain)
            rid = batch.column("rid").to_numpy()
            yield pa.record_batch(
                [pa.array(signed(d1)), pa.array(signed(d2)), pa.array(rid[row]), pa.array(start), pa.array(n.astype(np.int16)), pa.array(lead.astype(np.int16))],
                _SAMPLE,
            )

    return sample


_SAMPLE = ["d1", "d2", "rid", "start", "n", "lead"]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads sorted samples; gives repeated ones and those still open.

    The first row of a task and its last group stay open, as their neighbours are
    in another task.
    """
    last = waiting = None

    def out(rows: pa.RecordBatch, open_: bool) -> pa.RecordBatch:
        flag = pa.array(np.full(rows.num_rows, open_))
        return pa.record_batch([*(rows.column(c) for c in _SAMPLE[2:]), flag], [*_SAMPLE[2:], "open"])

    for batch in batches:
        if not batch.num_rows:
            continue
        d1, d2 = batch.column("d1").to_numpy(), batch.column("d2").to_numpy()
        before1, before2 = np.r_[d1[:1], d1[:-1]], np.r_[d2[:1], d2[:-1]]
        known = np.ones(len(d1), bool)
        if last is None:
            known[0] = False
        else:
            before1[0], before2[0] = last
        same = known & (d1 == before1) & (d2 == before2)
        heads = np.flatnonzero(~same)
        if len(heads):
            if waiting is not None and (waiting[1] or waiting[2] == d1[heads[0]]):
                yield out(waiting[0], True)
            left = (d1[heads] == before1[heads]) | ~known[heads]
            right = np.r_[d1[heads[1:]] == d1[heads[:-1]], False]
            yield out(batch.take(pa.array(heads[:-1][(left | right)[:-1]])), True)
            waiting = (batch.slice(int(heads[-1]), 1), bool(left[-1]), d1[heads[-1]])
        yield out(batch.take(pa.array(np.flatnonzero(same))), False)
        last = (d1[-1], d2[-1])
    if waiting is not None:
        yield out(waiting[0], True)


def _flat_ranges(column: pa.Array) -> tuple[np.ndarray, ...]:
    """``(row, start, n, lead)`` of an array-of-structs column."""
    sizes = np.array([0 if v is None else v for v in column.value_lengths().to_pylist()], np.int64)
    flat = column.flatten()
    return np.repeat(np.arange(len(sizes)), sizes), flat.field("start").to_numpy(), flat.field("n").to_numpy().astype(np.int64), flat.field("lead").to_numpy().astype(np.int64)


def _divider(window: int, stretch: int):
    """Stretches of open samples, with their common and their whole bytes as digits."""

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            data, offsets = buffer_of(batch.column("text"))
            row, start, n, lead = _flat_ranges(batch.column("ranges"))
            high = lead // stretch
            low = (lead - n + 1) // stretch
            count = high - low + 1
            each = np.repeat(np.arange(len(row)), count)
            number = low[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            base = offsets[row[each]]
            chosen = base + start[each] + lead[each]
            floor = chosen - number * stretch - stretch + 1
            first = np.maximum(floor, base + start[each])
            final = np.minimum(floor + stretch - 1, base + start[each] + n[each] - 1)
            d1 = Polynomials(data, 0).of(floor + stretch - 1, floor + window) ^ mix(number + 1)
            shape = ((first - floor) * (stretch + 1) + final - first).astype(np.uint64)
            d2 = Polynomials(data, 1).of(first, final + window) ^ mix(shape + np.uint64(1))
            none = np.zeros(len(each), np.int16)
            yield pa.record_batch([
                pa.array(signed(d1)), pa.array(signed(d2)), pa.array(batch.column("rid").to_numpy()[row[each]]),
                pa.array(first - base), pa.array((final - first + 1).astype(np.int16)), pa.array(none),
            ], _SAMPLE)

    return divide


def _spread(window: int):
    """Digests of the single windows of open samples."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            data, offsets = buffer_of(batch.column("text"))
            row, start, n, lead = _flat_ranges(batch.column("ranges"))
            each = np.repeat(np.arange(len(row)), n)
            within = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            position = start[each] + within
            at = offsets[row[each]] + position
            a, b = Polynomials(data, 0).of(at, at + window), Polynomials(data, 1).of(at, at + window)
            rid = batch.column("rid").to_numpy()[row[each]]
            yield pa.record_batch([pa.array(signed(a)), pa.array(signed(b)), pa.array(rid), pa.array(position)], ["a", "b", "rid", "start"])

    return spread


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted windows the repeated ones (edge 0), and the first and last of the task (1, 2)."""
    last, final = None, None
    names = ["a", "b", "rid", "start", "edge"]
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        edge = np.full(len(a), -1, np.int8)
        edge[1:][(a[1:] == a[:-1]) & (b[1:] == b[:-1])] = 0
        if last is None:
            edge[0] = 1
        elif last == (a[0], b[0]):
            edge[0] = 0
        keep = pa.array(edge >= 0)
        yield pa.record_batch([*(batch.column(c) for c in names[:4]), pa.array(edge)], names).filter(keep)
        last = (a[-1], b[-1])
        final = batch.slice(batch.num_rows - 1)
    if final is not None:
        yield pa.record_batch([*(final.column(c) for c in names[:4]), pa.array([2], pa.int8())], names)


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    for batch in pieces(batches, "text", PIECE):
        data, offsets = buffer_of(batch.column("text"))
        row, start, n, lead = _flat_ranges(batch.column("ranges"))
        marks = np.zeros(len(data) + 1, np.int32)
        np.add.at(marks, offsets[row] + start, 1)
        np.add.at(marks, offsets[row] + start + n - 1 + window, -1)
        gone = np.cumsum(marks)[:-1] > 0
        kept, spans = [], []
        for s, e in zip(offsets[:-1], offsets[1:]):
            g = gone[s:e]
            if not g.any():
                kept.append(data[s:e].tobytes())
                spans.append([])
                continue
            kept.append(data[s:e][~g].tobytes())
            edges = np.flatnonzero(np.diff(np.r_[False, g, False]))
            spans.append([{"start": int(x), "end": int(y)} for x, y in edges.reshape(-1, 2)])
        yield pa.record_batch(
            [batch.column("rid"), batch.column("id"), pa.array(np.diff(offsets)), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())],
            ["rid", "id", "n_bytes", "removed", "kept"],
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """One row per document: ``rid, id, n_bytes, removed, kept``.

    ``removed`` lists ``start, end`` of the maximal removed byte runs: every byte
    covered by a window that also starts earlier (smaller key, or same document and
    smaller position).  ``kept`` holds the bytes that remain.
    """
    given = keyed(docs, id_col, text=docs[text_col].cast("string").cast("binary")).select("rid", "id", "text")
    kind = dict(given.dtypes)["id"]
    sample = "d1 long, d2 long, rid long, start long, n short, lead short"
    order = ["d1", "d2", "rid", "start"]

    def settle(rows: DataFrame) -> DataFrame:
        return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_settle, "rid long, start long, n short, lead short, open boolean")

    def with_text(ranges: DataFrame, how: str) -> DataFrame:
        grouped = ranges.groupBy("rid").agg(F.collect_list(F.struct("start", "n", "lead")).alias("ranges"))
        return given.join(grouped, "rid", how)

    runs = stored(settle(given.select("rid", "text").mapInArrow(_sampler(window, grain), sample)), "suffix-samples")
    stretches = stored(settle(with_text(runs.where("open"), "inner").mapInArrow(_divider(window, STRETCH), sample)), "suffix-stretches")
    windows = with_text(stretches.where("open"), "inner").mapInArrow(_spread(window), "a long, b long, rid long, start long")
    order_w = ["a", "b", "rid", "start"]
    sorted_windows = windows.repartitionByRange(*order_w).sortWithinPartitions(*order_w)
    found = stored(sorted_windows.mapInArrow(_repeats, "a long, b long, rid long, start long, edge byte"), "suffix-windows")
    behind = Window.orderBy("a", "b", "rid", "start", "edge")
    crossing = found.where("edge > 0").select("rid", "start", "edge", (
        (F.lag("a").over(behind) == F.col("a")) & (F.lag("b").over(behind) == F.col("b"))
        & ((F.lag("rid").over(behind) != F.col("rid")) | (F.lag("start").over(behind) != F.col("start")))
    ).alias("again")).where("edge = 1 and again")
    single = [F.lit(1).cast("short").alias("n"), F.lit(0).cast("short").alias("lead")]
    ranges = runs.where("not open").drop("open").unionByName(stretches.where("not open").drop("open"))
    for part in (found.where("edge = 0"), crossing):
        ranges = ranges.unionByName(part.select("rid", "start", *single))
    return with_text(ranges, "left").mapInArrow(
        lambda batches: _cut(batches, window),
        f"rid long, id {kind}, n_bytes long, removed array<struct<start:bigint,end:bigint>>, kept binary",
    )
