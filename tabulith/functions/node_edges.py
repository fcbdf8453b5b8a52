"""Bin edges of every feature inside every tree node, over feature arrays.

Small nodes send their values of one feature to one group and are cut there.
Nodes above ``direct`` rows are narrowed first: tasks count equal-width bins per
(node, feature, bracket), only the bins holding a wanted rank stay open, and the
rounds repeat until what is left of a bracket fits one group.  Copies of a value
end as a bracket of width zero, so a heavy value is never gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fan_out

DIRECT_ROWS = 200_000
ROUND_CELLS = 200_000    # counted bins per round over all brackets
Place = Callable[[np.ndarray], np.ndarray]


def cut(values: np.ndarray, n_bins: int) -> np.ndarray:
    """Edges from counted values: one in each gap if they are few, else by rank."""
    value, n = np.unique(values, return_counts=True)
    if len(value) <= n_bins:
        return value[:-1] + np.diff(value) / 2.0
    rank, upto = np.arange(1, n_bins) / n_bins * (n.sum() - 1), np.cumsum(n)
    below, above = (value[np.searchsorted(upto, r, side="right")] for r in (np.floor(rank), np.ceil(rank)))
    return within(below + (above - below) * (rank - np.floor(rank)), value[0], value[-1])


def within(edges, low: float, high: float) -> np.ndarray:
    """Distinct edges that leave values on both sides, ascending; the middle if there are none."""
    kept = sorted({float(e) for e in edges if low <= e < high})
    return np.array(kept or [low + (high - low) / 2.0])


def blocks(batches, matrix, rows: int = 65_536):
    """Feature matrices of several Arrow batches at a time."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(matrix(batch))
        size += batch.num_rows
        if size >= rows:
            yield np.vstack(held)
            held, size = [], 0
    if held:
        yield np.vstack(held)


def node_edges(
    rows: DataFrame, d: int, place: Place, sizes: dict[int, int], n_bins: int,
    direct: int = DIRECT_ROWS,
) -> dict[int, list[np.ndarray]]:
    """``{node: [edges of feature 0, ...]}`` for the nodes in ``sizes``.

    ``place`` gives the node of each row of a block.
    """
    small = sorted(k for k, n in sizes.items() if n <= direct)
    large = sorted(k for k, n in sizes.items() if n > direct)
    found: dict[tuple[int, int], np.ndarray] = {}
    if small:
        everything = _gather(rows, d, place, {(k, f): None for k in small for f in range(d)})
        found.update(_apply(everything, lambda key, values: cut(values, n_bins)))
    if large:
        found.update(_large(rows, d, place, {k: sizes[k] for k in large}, n_bins, direct))
    return {k: [found.get((k, f), np.empty(0)) for f in range(d)] for k in sizes}


def _matrix(batch):
    from ..models.base import batch_matrix

    return batch_matrix(batch)


def _gather(rows, d, place, keys: dict[tuple[int, int], np.ndarray | None]) -> DataFrame:
    """``(node, feature, values)`` per block; with brackets only values inside one."""
    by_node: dict[int, list[tuple[int, np.ndarray | None]]] = {}
    for (k, f), brackets in keys.items():
        by_node.setdefault(k, []).append((f, brackets))

    def task(batches):
        for x in blocks(batches, _matrix):
            at = place(x)
            for k, features in by_node.items():
                own = x[at == k]
                if not len(own):
                    continue
                names, values = [], []
                for f, brackets in features:
                    v = own[:, f]
                    if brackets is not None:
                        at_bracket = np.searchsorted(brackets[:, 0], v, side="right") - 1
                        v = v[(at_bracket >= 0) & (v <= brackets[np.maximum(at_bracket, 0), 1])]
                    if len(v):
                        names.append(f)
                        values.append(v)
                if names:
                    yield pa.RecordBatch.from_pydict(
                        {"node": pa.array([k] * len(names), pa.int32()), "feature": pa.array(names, pa.int32()),
                         "values": pa.array(values, pa.list_(pa.float64()))}
                    )

    return rows.mapInArrow(task, "node int, feature int, values array<double>")


def _apply(gathered: DataFrame, function) -> dict[tuple[int, int], np.ndarray]:
    """Run ``function(key, all values)`` per (node, feature) and collect its short result."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.concatenate([np.asarray(v) for v in pdf["values"]])
        return pd.DataFrame(
            {"node": [key[0]], "feature": [key[1]], "out": [list(function((int(key[0]), int(key[1])), values))]}
        )

    result = fan_out(gathered, "node", "feature").groupBy("node", "feature").applyInPandas(one, "node int, feature int, out array<double>")
    return {(r["node"], r["feature"]): np.asarray(r["out"]) for r in result.collect()}


# --- large nodes ---------------------------------------------------------------

@dataclass
class _Bracket:
    lo: float
    hi: float
    below: int
    inside: int
    ranks: list[int] = field(default_factory=list)


def _ranges(rows, d, place, nodes: Sequence[int], limit: int):
    """Range and, where short, the distinct values of every (node, feature)."""
    wanted = set(nodes)

    def task(batches):
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        seen: dict[tuple[int, int], np.ndarray | None] = {}
        for x in blocks(batches, _matrix):
            at = place(x)
            for k in np.unique(at):
                k = int(k)
                if k not in wanted:
                    continue
                own = x[at == k]
                low[k] = np.minimum(low[k], own.min(axis=0)) if k in low else own.min(axis=0)
                high[k] = np.maximum(high[k], own.max(axis=0)) if k in high else own.max(axis=0)
                for f in range(d):
                    if (k, f) in seen and seen[(k, f)] is None:
                        continue
                    u = np.unique(own[:, f])
                    u = np.union1d(seen[(k, f)], u) if (k, f) in seen else u
                    seen[(k, f)] = u if len(u) <= limit else None
        for k in low:
            lists = [seen[(k, f)] for f in range(d)]
            yield pa.RecordBatch.from_pydict(
                {"node": pa.array([k] * d, pa.int32()), "feature": pa.array(range(d), pa.int32()),
                 "lo": pa.array(low[k]), "hi": pa.array(high[k]),
                 "few": pa.array([v is not None for v in lists]),
                 "values": pa.array([[] if v is None else v for v in lists], pa.list_(pa.float64()))}
            )

    found = rows.mapInArrow(
        task, "node int, feature int, lo double, hi double, few boolean, values array<double>"
    )
    found = found.groupBy("node", "feature").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_and("few").alias("few"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("values")))).alias("values"),
    )
    return {
        (r["node"], r["feature"]): (r["lo"], r["hi"], r["values"] if r["few"] and r["n"] <= limit else None)
        for r in found.select(
            "node", "feature", "lo", "hi", "few", F.size("values").alias("n"), F.slice("values", 1, limit + 1).alias("values")
        ).collect()
    }


def _counts(rows, d, place, open_brackets: dict[tuple[int, int], list[_Bracket]], bins: int):
    """Count, least and largest value of the equal-width bins of every open bracket.

    Returns sorted arrays ``(bin, n, lo, hi)`` of the filled bins per bracket.
    """
    grid: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for (k, f), brackets in open_brackets.items():
        for b, bracket in enumerate(brackets):
            grid.setdefault(k, []).append((f, b, np.linspace(bracket.lo, bracket.hi, bins + 1)))

    def task(batches):
        for x in blocks(batches, _matrix, 262_144):
            at = place(x)
            parts = []
            for k, items in grid.items():
                own = x[at == k]
                if not len(own):
                    continue
                ordered: dict[int, np.ndarray] = {}
                for f, b, edges in items:
                    if f not in ordered:
                        ordered[f] = np.sort(own[:, f])
                    v = ordered[f]
                    cuts = np.concatenate([
                        [np.searchsorted(v, edges[0], side="left")], np.searchsorted(v, edges[1:-1], side="left"),
                        [np.searchsorted(v, edges[-1], side="right")],
                    ])
                    n = np.diff(cuts)
                    live = np.flatnonzero(n)
                    if len(live):
                        head = np.tile([k, f, b], (len(live), 1))
                        parts.append((head, live, n[live], v[cuts[live]], v[cuts[live + 1] - 1]))
            if parts:
                head = np.vstack([p[0] for p in parts]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(head[:, 0]), pa.array(head[:, 1]), pa.array(head[:, 2]),
                     pa.array(np.concatenate([p[1] for p in parts]).astype(np.int32)),
                     pa.array(np.concatenate([p[2] for p in parts]).astype(np.int64)),
                     pa.array(np.concatenate([p[3] for p in parts])), pa.array(np.concatenate([p[4] for p in parts]))],
                    names=["node", "feature", "bracket", "bin", "n", "lo", "hi"],
                )

    counted = rows.mapInArrow(task, "node int, feature int, bracket int, bin int, n bigint, lo double, hi double")
    summed = (
        counted.groupBy("node", "feature", "bracket", "bin")
        .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow().to_pandas()
    )
    summed = summed.sort_values(["node", "feature", "bracket", "bin"])
    return {
        tuple(int(v) for v in key): (g["bin"].to_numpy(), g["n"].to_numpy(), g["lo"].to_numpy(), g["hi"].to_numpy())
        for key, g in summed.groupby(["node", "feature", "bracket"], sort=False)
    }


def _large(rows, d, place, sizes, n_bins, direct):
    limits = _ranges(rows, d, place, list(sizes), n_bins)
    result: dict[tuple[int, int], np.ndarray] = {}
    brackets: dict[tuple[int, int], list[_Bracket]] = {}
    for (k, f), (lo, hi, values) in limits.items():
        if lo == hi:
            result[(k, f)] = np.empty(0)
        elif values is not None:
            v = np.asarray(values)
            result[(k, f)] = (v[:-1] + v[1:]) / 2.0
        else:
            n = sizes[k]
            position = np.arange(1, n_bins) / n_bins * (n - 1)
            wanted = np.concatenate([np.floor(position), np.ceil(position)])
            ranks = sorted({int(r) for r in wanted})
            brackets[(k, f)] = [_Bracket(lo, hi, 0, n, ranks)]
    done: dict[tuple[int, int], list[_Bracket]] = {key: [] for key in brackets}
    while brackets:
        for key in list(brackets):
            bound = direct // max(1, 2 * n_bins)
            still = []
            for b in brackets[key]:
                (done[key] if b.lo == b.hi or b.inside <= bound else still).append(b)
            brackets[key] = still
            if not still:
                del brackets[key]
        if not brackets:
            break
        cells = sum(len(v) for v in brackets.values())
        bins = int(np.clip(ROUND_CELLS // cells, 16, 256))
        counts = _counts(rows, d, place, brackets, bins)
        for (k, f), items in brackets.items():
            narrowed: list[_Bracket] = []
            for b, bracket in enumerate(items):
                _, n, lo, hi = counts[(k, f, b)]
                upto = bracket.below + np.cumsum(n)
                where = np.searchsorted(upto, bracket.ranks, side="right")
                for i in np.unique(where):
                    narrowed.append(
                        _Bracket(float(lo[i]), float(hi[i]), int(upto[i] - n[i]), int(n[i]),
                                 [r for r, w in zip(bracket.ranks, where) if w == i])
                    )
            brackets[(k, f)] = narrowed
    wide = {
        key: np.array(sorted((b.lo, b.hi) for b in items if b.lo < b.hi)) for key, items in done.items()
    }
    stats: dict[tuple[int, int], dict[int, float]] = {
        key: {r: b.lo for b in items if b.lo == b.hi for r in b.ranks} for key, items in done.items()
    }
    open_keys = {key: w for key, w in wide.items() if len(w)}
    if open_keys:
        plan = {key: sorted((b for b in items if b.lo < b.hi), key=lambda b: b.lo) for key, items in done.items()}

        def pick(key, values):
            values = np.sort(values)
            out = []
            for b in plan[key]:
                start = np.searchsorted(values, b.lo, side="left")
                out += [float(values[start + r - b.below]) for r in b.ranks]
            return out

        for key, values in _apply(_gather(rows, d, place, open_keys), pick).items():
            ranks = [r for b in plan[key] for r in b.ranks]
            stats[key].update(zip(ranks, values))
    for key, known in stats.items():
        lo, hi, _ = limits[key]
        position = np.arange(1, n_bins) / n_bins * (sizes[key[0]] - 1)
        low, high = np.floor(position).astype(int), np.ceil(position).astype(int)
        a = np.array([known[r] for r in low])
        b = np.array([known[r] for r in high])
        result[key] = within(a + (b - a) * (position - low), lo, hi)
    return result
