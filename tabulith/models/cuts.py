"""Exact thresholds from coarse counts: only intervals that can hold a better cut are recounted.

Coarse bins give the cost of every cut at a bin edge, and for each bin a lower bound on
any cut inside it: summed impurities never fall when groups are joined, so what lies
below the bin and what lies above it cost at least what they cost alone.  Bins whose bound
reaches the best cost of the node are out.  The others are counted anew, in finer bins
while they hold many rows and by distinct value once they hold few; the winner ends
halfway between two neighbouring values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.node_edges import DIRECT_ROWS, blocks
from ..functions.quantiles import ordered_codes, value_of
from ..session import fan_out
from .base import batch_matrix

TIE = 1e-12
FINER = 256
#: Value of a column for rows of a node: ``value(rows, node, column)``.
Value = Callable[[np.ndarray, int, int], np.ndarray]


def costs(left: np.ndarray, total: np.ndarray, criterion: str) -> np.ndarray:
    """Weighted impurity of both sides of each cut, per row of the node."""
    from .trees import impurity_of

    right = total - left
    nl, nr = left.sum(axis=1), right.sum(axis=1)
    return (nl * impurity_of(left, criterion) + nr * impurity_of(right, criterion)) / total.sum(axis=-1)


def halfway(low: float, high: float) -> float:
    """A threshold that keeps ``low`` left and ``high`` right."""
    middle = low + (high - low) / 2.0
    return middle if middle < high else low


@dataclass
class Interval:
    """``(low, high]`` of a column in a node, as codes that sort like the values; class counts below and inside."""

    node: int
    column: int
    low: int
    high: int
    below: np.ndarray
    inside: np.ndarray


@dataclass
class Cut:
    """A split of a node: ``edge`` goes left with all smaller values."""

    column: int
    edge: float
    cost: float
    left: np.ndarray
    sharp: bool = False  # the edge lies halfway between neighbouring values


def _code(value: float) -> int:
    return int(ordered_codes(np.array([value]))[0])


def _bound(below: np.ndarray, inside: np.ndarray, total: np.ndarray, criterion: str) -> np.ndarray:
    """Least cost of any cut inside: both outer parts at what they cost alone."""
    from .trees import impurity_of

    above = total - below - inside
    return (below.sum(axis=1) * impurity_of(below, criterion) + above.sum(axis=1) * impurity_of(above, criterion)) / total.sum(axis=-1)


def _survivors(coarse: DataFrame, bars: dict[int, float], k: int, criterion: str, edges) -> list[Interval]:
    """Coarse bins of two or more rows whose bound lies under the bar of their node.

    ``coarse`` is dealt out by node and feature, so a task sees all bins of each.
    """
    names = [f"c{c}" for c in range(k)]

    def check(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        node, feature, at = (t.column(c).to_numpy() for c in ("node", "feature", "bin"))
        table = np.column_stack([t.column(c).to_numpy() for c in names])
        order = np.lexsort((at, feature, node))
        node, feature, at, table = node[order], feature[order], at[order], table[order]
        begin = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (feature[1:] != feature[:-1])])
        sizes = np.diff(np.r_[begin, len(node)])
        run = table.cumsum(axis=0)
        base = run[begin] - table[begin]
        below = run - table - np.repeat(base, sizes, axis=0)
        total = np.repeat(run[begin + sizes - 1] - base, sizes, axis=0)
        bar = np.array([bars.get(int(n), -np.inf) for n in node[begin]])
        keep = (table.sum(axis=1) > 1) & (_bound(below, table, total, criterion) < np.repeat(bar, sizes) - TIE)
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(v[keep]) for v in (node, feature, at)], *[pa.array(table[keep, c]) for c in range(k)], *[pa.array(below[keep, c]) for c in range(k)]],
            ["node", "feature", "bin", *names, *[f"b_{c}" for c in names]],
        )

    rows = coarse.mapInArrow(
        check, "node int, feature int, bin int, " + ", ".join(f"{c} long" for c in [*names, *[f"b_{c}" for c in names]])
    ).toArrow()
    column = lambda c: rows.column(c).to_numpy()
    node, feature, at = column("node"), column("feature"), column("bin")
    inside = np.column_stack([column(c) for c in names])
    below = np.column_stack([column(f"b_{c}") for c in names])
    low, high = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for n, f in {*zip(node.tolist(), feature.tolist())}:
        own = np.flatnonzero((node == n) & (feature == f))
        borders = ordered_codes(np.r_[-np.inf, edges(n, f), np.inf])
        low[own], high[own] = borders[at[own]], borders[at[own] + 1]
    return [Interval(int(n), int(f), int(a), int(b), u, i) for n, f, a, b, u, i in zip(node, feature, low, high, below, inside)]


def _plan(intervals: Sequence[Interval]):
    """Sorted borders and places of the intervals, by node and column; they do not overlap."""
    by: dict[int, dict[int, list[tuple[int, int, int]]]] = {}
    for i, s in enumerate(intervals):
        by.setdefault(s.node, {}).setdefault(s.column, []).append((s.low, s.high, i))
    return {
        n: {c: tuple(np.array(v, np.int64) for v in zip(*sorted(items))) for c, items in columns.items()} for n, columns in by.items()
    }


def _inside(x: np.ndarray, y: np.ndarray, at: np.ndarray, plan, value: Value):
    """``(interval, code, class)`` of a block's rows that lie in one."""
    for node, columns in plan.items():
        own = np.flatnonzero(at == node)
        if not len(own):
            continue
        for column, (lows, highs, places) in columns.items():
            codes = ordered_codes(value(x[own], node, column))
            slot = np.searchsorted(lows, codes, side="left") - 1
            ok = (slot >= 0) & (codes <= highs[np.maximum(slot, 0)])
            if ok.any():
                yield places[slot[ok]], codes[ok], y[own[ok]]


def _rows(batches):
    """Features and classes of several Arrow batches at a time."""
    for both in blocks(batches, lambda b: np.column_stack([batch_matrix(b), b.column("y").to_numpy(zero_copy_only=False)])):
        yield both[:, :-1], both[:, -1].astype(np.int64)


def _tables(keys: np.ndarray, classes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (rows) and their class counts."""
    found, inverse = np.unique(keys, axis=0, return_inverse=True)
    table = np.zeros((len(found), k), np.int64)
    np.add.at(table, (inverse.ravel(), classes), 1)
    return found, table


def _finer(rows, intervals: list[Interval], k: int, place, value: Value, criterion: str, min_leaf: int, totals, best: dict[int, Cut], bars) -> list[Interval]:
    """Cuts every interval into ``FINER`` equal ranges of codes: better cuts go to ``best``, open parts are returned."""
    plan = _plan(intervals)
    lows = np.array([s.low for s in intervals], np.int64)
    steps = np.array([-(-(s.high - s.low) // FINER) for s in intervals], np.uint64)

    def count(batches):
        for x, y in _rows(batches):
            for slot, codes, classes in _inside(x, y, place(x), plan, value):
                far = codes.view(np.uint64) - lows[slot].view(np.uint64) - np.uint64(1)
                keys, table = _tables(np.column_stack([slot, (far // steps[slot]).astype(np.int64)]), classes, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[:, 0].astype(np.int32)), pa.array(keys[:, 1].astype(np.int32)), *[pa.array(table[:, c]) for c in range(k)]],
                    ["slot", "part", *[f"c{c}" for c in range(k)]],
                )

    names = [f"c{c}" for c in range(k)]
    counted = rows.mapInArrow(count, "slot int, part int, " + ", ".join(f"{c} long" for c in names)).groupBy("slot", "part").agg(
        *[F.sum(c).alias(c) for c in names]
    ).toArrow().to_pandas().sort_values(["slot", "part"])
    open_: list[tuple[Interval, float]] = []
    for slot, own in counted.groupby("slot"):
        s, step = intervals[slot], int(steps[slot])
        table, part = own[names].to_numpy(np.int64), own["part"].to_numpy()
        upto = s.below + table.cumsum(axis=0)
        total = totals[s.node]
        n_left = upto.sum(axis=1)
        cost = np.where((n_left >= min_leaf) & (total.sum() - n_left >= min_leaf), costs(upto, total, criterion), np.inf)
        at = int(cost.argmin())
        if cost[at] < bars[s.node] - TIE:
            bars[s.node] = float(cost[at])
            best[s.node] = Cut(s.column, value_of(min(s.high, s.low + step * int(part[at] + 1))), float(cost[at]), upto[at])
        bound = _bound(upto - table, table, total, criterion)
        for j in np.flatnonzero(table.sum(axis=1) > 1):
            low = s.low + step * int(part[j])
            high = min(s.high, low + step)
            if high - low > 1:  # else all rows have one value
                open_.append((Interval(s.node, s.column, low, high, upto[j] - table[j], table[j]), float(bound[j])))
    return [s for s, b in open_ if b < bars[s.node] - TIE]


def _packs(intervals: Sequence[Interval]) -> np.ndarray:
    """Group of every interval: those of one column together, up to ``DIRECT_ROWS`` rows."""
    out, pack, held, last = np.zeros(len(intervals), np.int64), -1, 0, None
    for i in sorted(range(len(intervals)), key=lambda i: (intervals[i].node, intervals[i].column, intervals[i].low)):
        s = intervals[i]
        n = int(s.inside.sum())
        if last != (s.node, s.column) or held + n > DIRECT_ROWS:
            pack, held, last = pack + 1, 0, (s.node, s.column)
        out[i], held = pack, held + n
    return out


def _settle(rows, intervals: list[Interval], k: int, place, value: Value, criterion: str, min_leaf: int, totals, best: dict[int, Cut], bars) -> None:
    """Tries every distinct value of the small intervals, and finds the values beside each node's best cut."""
    plan = _plan(intervals)
    asked = {n: (c.column, _code(c.edge)) for n, c in best.items()}
    packs = _packs(intervals)

    def gather(batches):
        for x, y in _rows(batches):
            at = place(x)
            rows_: list[tuple[int, bytes, bytes, bytes]] = []
            parts = list(_inside(x, y, at, plan, value))
            if parts:
                slot, codes, classes = (np.concatenate(p) for p in zip(*parts))
                order = np.argsort(packs[slot], kind="stable")
                slot, codes, classes = slot[order].astype(np.int32), codes[order], classes[order].astype(np.int32)
                own = packs[slot]
                starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                for i, j in zip(starts, np.r_[starts[1:], len(own)]):
                    rows_.append((int(own[i]), slot[i:j].tobytes(), codes[i:j].tobytes(), classes[i:j].tobytes()))
            # The largest value that goes left and the smallest that goes right, in packs of their own.
            for node, (column, edge) in asked.items():
                codes = ordered_codes(value(x[at == node], node, column))
                for pack, near in ((-1 - 2 * node, np.sort(codes[codes <= edge])[-1:]), (-2 - 2 * node, np.sort(codes[codes > edge])[:1])):
                    if len(near):
                        rows_.append((pack, b"", near.tobytes(), b""))
            if rows_:
                columns = list(zip(*rows_))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], ["pack", "slots", "codes", "classes"]
                )

    below = np.array([s.below for s in intervals], np.int64).reshape(-1, k)
    sums = np.array([totals[s.node] for s in intervals], np.int64).reshape(-1, k)

    def try_all(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pack = int(key[0])
        codes = np.concatenate([np.frombuffer(v, np.int64) for v in pdf["codes"]])
        if pack < 0:
            edge = int(codes.max() if pack % 2 else codes.min())
            return pd.DataFrame({"slot": [pack], "cost": [0.0], "low": [edge], "high": [edge], "left": [[]]})
        slots, classes = (np.concatenate([np.frombuffer(v, np.int32) for v in pdf[c]]) for c in ("slots", "classes"))
        order = np.lexsort((codes, slots))
        slots, codes, classes = slots[order], codes[order], classes[order]
        new = np.r_[True, (slots[1:] != slots[:-1]) | (codes[1:] != codes[:-1])]
        first = np.flatnonzero(new)
        table = np.bincount((np.cumsum(new) - 1) * k + classes, minlength=len(first) * k).reshape(-1, k)
        slots, codes = slots[first], codes[first]
        begin = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
        run = table.cumsum(axis=0)
        before = np.repeat(run[begin] - table[begin], np.diff(np.r_[begin, len(slots)]), axis=0)
        cuts = np.flatnonzero(slots[1:] == slots[:-1])
        left, total = (run - before)[cuts] + below[slots[cuts]], sums[slots[cuts]]
        n_left, n_all = left.sum(axis=1), total.sum(axis=1)
        ok = (n_left >= min_leaf) & (n_all - n_left >= min_leaf)
        cuts, left, total = cuts[ok], left[ok], total[ok]
        if not len(cuts):
            return pd.DataFrame([], columns=["slot", "cost", "low", "high", "left"])
        cost = costs(left, total, criterion)
        i = int(cost.argmin())
        at = cuts[i]
        return pd.DataFrame({"slot": [int(slots[at])], "cost": [float(cost[i])], "low": [int(codes[at])], "high": [int(codes[at + 1])], "left": [left[i].tolist()]})

    found = fan_out(rows.mapInArrow(gather, "pack int, slots binary, codes binary, classes binary"), "pack").groupBy("pack").applyInPandas(
        try_all, "slot int, cost double, low long, high long, left array<long>"
    ).collect()
    beside = {r["slot"]: r["low"] for r in found if r["slot"] < 0}
    for n, cut in best.items():
        if -1 - 2 * n in beside and -2 - 2 * n in beside:
            cut.edge, cut.sharp = halfway(value_of(beside[-1 - 2 * n]), value_of(beside[-2 - 2 * n])), True
    for r in sorted((r for r in found if r["slot"] >= 0), key=lambda r: r["slot"]):
        s = intervals[r["slot"]]
        if r["cost"] < bars[s.node] - TIE:
            bars[s.node] = r["cost"]
            best[s.node] = Cut(s.column, halfway(value_of(r["low"]), value_of(r["high"])), r["cost"], np.array(r["left"]), True)


def exact_cuts(
    rows: DataFrame, coarse: DataFrame, edges, best: dict[int, Cut], totals: dict[int, np.ndarray], k: int, place, value: Value,
    criterion: str, min_leaf: int,
) -> dict[int, Cut]:
    """The cheapest cut of every node over all columns of ``coarse`` and all their values.

    ``coarse`` holds ``node, feature, bin, c0 ..`` over the bins of ``edges(node, column)``
    and ``best`` the cheapest cuts at their edges; ``totals`` are the nodes' class counts.
    """
    from .trees import impurity_of

    best = dict(best)
    bars = {n: best[n].cost if n in best else float(impurity_of(t, criterion)[0]) for n, t in totals.items()}
    open_ = _survivors(coarse, bars, k, criterion, edges)
    large_seen = False
    while large := [s for s in open_ if s.inside.sum() > DIRECT_ROWS]:
        large_seen = True
        small = [s for s in open_ if s.inside.sum() <= DIRECT_ROWS]
        open_ = small + _finer(rows, large, k, place, value, criterion, min_leaf, totals, best, bars)
    # What earlier finds have ruled out since falls away.
    if large_seen and open_:
        bound = _bound(*(np.array(v) for v in zip(*[(s.below, s.inside, totals[s.node]) for s in open_])), criterion)
        open_ = [s for s, b in zip(open_, bound) if b < bars[s.node] - TIE]
    _settle(rows, open_, k, place, value, criterion, min_leaf, totals, best, bars)
    return best
