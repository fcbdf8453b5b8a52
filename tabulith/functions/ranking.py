"""Exact ranks, running sums and neighbours that do not funnel a group through one task.

A window without a partition (or with one huge partition) sorts all its rows in a single
task.  Hash ranks count inside ordered buckets of the hash and add the totals before.
Running sums and neighbouring values are prefix scans: the rows are dealt out by range
and sorted once, each partition reports its borders in one row, the driver turns those
into one carry per partition, and a single walk fills in the results.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import cut_lineage

HASH_PREFIX = 4          # hex digits: 65 536 ordered buckets per group
SMALL_HASH_PREFIX = 1
SMALL_ROWS = 200_000


def order_hash(key: str | Column, seed: int = 42) -> Column:
    """Reproducible shuffle position of a row: md5 text of ``seed:key``."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def prefix_length(n_rows: int) -> int:
    return SMALL_HASH_PREFIX if n_rows <= SMALL_ROWS else HASH_PREFIX


def with_hash_rank(
    df: DataFrame, by: Sequence[str], hash_col: str, out: str, digits: int
) -> DataFrame:
    """Exact 1-based rank of ``hash_col`` inside each group of ``by``.

    md5 text is uniform, so its leading digits are balanced ordered buckets even
    when one group holds most of the rows.
    """
    by = list(by)
    bucketed = df.withColumn("__prefix", F.substring(hash_col, 1, digits))
    sizes = bucketed.groupBy(*by, "__prefix").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*by).orderBy("__prefix").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *by, "__prefix", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")
    )
    inside = W.partitionBy(*by, "__prefix").orderBy(hash_col)
    return (
        bucketed.withColumn("__rn", F.row_number().over(inside))
        .join(offsets, [*by, "__prefix"])
        .withColumn(out, F.col("__rn") + F.col("__offset"))
        .drop("__prefix", "__rn", "__offset")
    )


# --- prefix scan ----------------------------------------------------------------

def _ordered(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """``df`` dealt out by range and sorted, written once so that the borders stay.

    ``__part`` numbers the partitions in order; ``__group`` tells neighbouring groups apart.
    """
    keys = [x for c in by for x in (F.col(c), F.col(c).isNull())]
    group = F.xxhash64(*keys) if by else F.lit(0).cast("long")
    dealt = df.repartitionByRange(*[F.col(c) for c in by], F.col(order)).sortWithinPartitions(*by, order)
    return cut_lineage(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__group", group))


def _segments(group: np.ndarray) -> np.ndarray:
    """First row of every stretch of one group."""
    return np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values with nulls as 0, whole numbers exact, and where values stand."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    whole = pa.types.is_integer(column.type)
    if not whole:
        column = column.cast(pa.float64())
    values = pc.fill_null(column, 0 if whole else 0.0).to_numpy(zero_copy_only=False)
    return values.astype(np.int64 if whole else np.float64), there


def _borders(sums: Sequence[str], values: Sequence[str], steps: int):
    """One row per partition: its first and last group, the sums and values a neighbour needs."""

    def report(batches):
        part = first = last = None
        totals: list[Any] = []
        seen: list[int] = []
        head: dict[str, Any] = {}
        tail: dict[str, list[Any]] = {}
        one = True
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("__group").to_numpy()
            starts = _segments(group)
            if part is None:
                part, first = batch.column("__part")[0].as_py(), int(group[0])
                head = {v: batch.column(v)[0].as_py() for v in values}
            fresh = last != int(group[0]) or len(starts) > 1
            if last is None or fresh:
                one = one and last is None and len(starts) == 1
            begin = int(starts[-1])
            if fresh:
                totals, seen, tail = [0] * len(sums), [0] * len(sums), {v: [] for v in values}
            for k, name in enumerate(sums):
                x, there = _numbers(batch.column(name).slice(begin))
                totals[k] += x.sum().item()
                seen[k] += int(there.sum())
            for v in values:
                # Only the last rows can matter to the partition after.
                own = batch.column(v).slice(max(begin, batch.num_rows - steps)).to_pylist() if steps else []
                tail[v] = (tail[v] + own)[-steps:] if steps else []
            last = int(group[-1])
        if part is not None:
            yield pa.RecordBatch.from_pylist([{"state": pickle.dumps((part, first, last, one, totals, seen, head, tail))}])

    return report


def _carries(rows: Sequence[tuple], sums: Sequence[str], values: Sequence[str], steps: int) -> dict[int, dict[str, Any]]:
    """What each partition adds to its first group, and what follows its last row."""
    rows = sorted(rows)
    out: dict[int, dict[str, Any]] = {}
    group, totals, seen, tail = None, [0] * len(sums), [0] * len(sums), {v: [] for v in values}
    for i, (part, first, last, one, own, count, head, ends) in enumerate(rows):
        same = group == first and i > 0
        carry = {
            "group": first if same else None, "sums": totals if same else [0] * len(sums),
            "seen": seen if same else [0] * len(sums), "tail": tail if same else {v: [] for v in values}, "next": None,
        }
        if i + 1 < len(rows) and rows[i + 1][1] == last:
            carry["next"] = rows[i + 1][6]
        out[part] = carry
        if one and same:
            totals, seen = [a + b for a, b in zip(totals, own)], [a + b for a, b in zip(seen, count)]
            tail = {v: (tail[v] + ends[v])[-steps:] if steps else [] for v in values}
        else:
            totals, seen, tail = own, count, ends
        group = last
    return out


def prefix_scan(
    df: DataFrame, by: Sequence[str], order: str, sums: dict[str, str] | None = None,
    before: dict[str, str] | None = None, steps: int = 0, after: dict[str, str] | None = None,
) -> DataFrame:
    """Running sums and neighbouring values of every row within its group, by ``order``.

    ``sums`` maps inputs to running sums (current row included; null before the first
    value), ``before`` to ``out_1 .. out_steps`` of the rows before and ``after`` to the
    value of the next row.  Rows are read once for the sort and twice from its result,
    whatever the size of a group.
    """
    by, sums, before, after = list(by), sums or {}, before or {}, after or {}
    ordered = _ordered(df, by, order)
    values = sorted({*before, *after})
    columns = list(dict.fromkeys(["__part", "__group", *sums, *values]))
    reports = ordered.select(*columns).mapInArrow(_borders(list(sums), values, steps), "state binary").collect()
    carries = _carries([pickle.loads(r["state"]) for r in reports], list(sums), values, steps)
    fields = [f for f in ordered.schema if f.name not in ("__part", "__group")]
    kinds = {f.name: f.dataType for f in fields}
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    made = [T.StructField(o, T.LongType() if isinstance(kinds[c], whole) else T.DoubleType()) for c, o in sums.items()]
    made += [T.StructField(f"{o}_{k}", kinds[c]) for c, o in before.items() for k in range(1, steps + 1)]
    made += [T.StructField(o, kinds[c]) for c, o in after.items()]
    names = [f.name for f in fields]

    def walk(batches):
        """The batches with the results, each finished when the next one is seen."""
        held = None  # one batch back, since the next row's value may stand in the batch after
        state: dict[str, Any] = {}

        def filled(batch, follow):
            group = batch.column("__group").to_numpy()
            starts = _segments(group)
            sizes = np.diff(np.r_[starts, len(group)])
            joins = state["group"] == int(group[0])
            out = [batch.column(n) for n in names]
            for k, (c, o) in enumerate(sums.items()):
                x, there = _numbers(batch.column(c))
                run, count = np.cumsum(x), np.cumsum(there)
                base, empty = np.repeat(run[starts] - x[starts], sizes), np.repeat(count[starts] - there[starts], sizes)
                run, count = run - base, count - empty
                if joins:
                    run[: sizes[0]] += state["sums"][k]
                    count[: sizes[0]] += state["seen"][k]
                state["sums"][k], state["seen"][k] = run[-1].item(), int(count[-1])
                out.append(pa.array(run, mask=count == 0))
            place = np.arange(len(group)) - np.repeat(starts, sizes)
            if joins:
                place[: sizes[0]] += steps  # as if the carried rows stood in front
            tails = {}
            for c in before:
                column = batch.column(c)
                lead = state["tail"].get(c, []) if joins else []
                front = pa.array([None] * (steps - len(lead)) + list(lead), column.type)
                joined = pa.concat_arrays([front, column])
                for k in range(1, steps + 1):
                    at = np.arange(len(group)) + steps - k
                    out.append(joined.take(pa.array(at, mask=place < k)))
                own = column.slice(max(int(starts[-1]), len(column) - steps)).to_pylist()
                tails[c] = ((list(lead) if joins and len(starts) == 1 else []) + own)[-steps:]
            for c in after:
                column = batch.column(c)
                more = follow.get(c) if follow else None
                joined = pa.concat_arrays([column, pa.array([more], column.type)])
                last = np.r_[group[1:] != group[:-1], follow is None]
                out.append(joined.take(pa.array(np.arange(1, len(group) + 1), mask=last)))
            state["tail"], state["group"] = tails, int(group[-1])
            return pa.RecordBatch.from_arrays(out, names=[*names, *[f.name for f in made]])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is None:
                carry = carries[batch.column("__part")[0].as_py()]
                state.update(group=carry["group"], sums=list(carry["sums"]), seen=list(carry["seen"]), tail=carry["tail"], next=carry["next"])
            else:
                same = held.column("__group")[-1].as_py() == batch.column("__group")[0].as_py()
                yield filled(held, {c: batch.column(c)[0].as_py() for c in after} if same else None)
            held = batch
        if held is not None:
            yield filled(held, state["next"])

    return ordered.mapInArrow(walk, T.StructType([*fields, *made]))


def running_sum(df: DataFrame, by: Sequence[str], order: str, values: dict[str, str]) -> DataFrame:
    """Running sums of ``values`` (input -> output name), current row included."""
    return prefix_scan(df, by, order, sums=values)


def previous_value(df: DataFrame, by: Sequence[str], order: str, values: dict[str, str], steps: int = 1) -> DataFrame:
    """``lag(value, 1..steps)``; outputs are ``out_1 .. out_steps``."""
    return prefix_scan(df, by, order, before=values, steps=steps)
