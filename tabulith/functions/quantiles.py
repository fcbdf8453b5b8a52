"""Exact linear-interpolation quantiles of many columns at once, in bounded memory.

Radix selection: a value's 64 bits are read as a whole number that sorts like the value,
16 bits a round.  A round counts the next 16 bits of the values that share the bits found
so far, for every wanted order statistic of every column, and keeps the digit that holds
the wanted rank.  At most four rounds are needed, whatever the rows or how they repeat; a
digit whose smallest and largest value agree ends its search early, so whole numbers of
up to 20 bits take two.  Counts are summed per task and per shuffle; no group holds more
than 65 536 of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DIGIT = 16
BLOCK_ROWS = 65_536
_SIGN = np.int64(0x7FFFFFFFFFFFFFFF)


def ordered_codes(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; both zeros are one, NaN comes last."""
    bits = (values + 0.0).view(np.int64)
    return np.where(np.isnan(values), _SIGN, np.where(bits < 0, bits ^ _SIGN, bits))


def value_of(code: int) -> float:
    if code == int(_SIGN):
        return math.nan
    bits = np.array([code], np.int64)
    return float(np.where(bits < 0, bits ^ _SIGN, bits).view(np.float64)[0])


def _counter(slots: list[list[tuple[int | None, int]]], shift: int):
    """Counts ``slot, digit, n, low, high``; ``slots`` lists the open prefixes of each column."""
    prefixes = [np.array([p for p, _ in own if p is not None], np.int64) for own in slots]
    numbers = [np.array([s for _, s in own], np.int32) for own in slots]
    mask = np.int64((1 << DIGIT) - 1)

    def emit(columns: list[list[np.ndarray]]):
        for c, parts in enumerate(columns):
            if not parts or not len(numbers[c]):
                continue
            codes, n = np.unique(ordered_codes(np.concatenate(parts)), return_counts=True)
            digit = codes >> np.int64(shift)
            if len(prefixes[c]):
                above = digit >> np.int64(DIGIT)
                at = np.minimum(np.searchsorted(prefixes[c], above), len(prefixes[c]) - 1)
                use = prefixes[c][at] == above
                codes, n, digit, slot = codes[use], n[use], digit[use] & mask, numbers[c][at[use]]
            else:
                slot = np.full(len(codes), numbers[c][0], np.int32)
            if not len(codes):
                continue
            # Codes ascend, so slots and digits stand in runs.
            first = np.flatnonzero(np.r_[True, (slot[1:] != slot[:-1]) | (digit[1:] != digit[:-1])])
            last = np.r_[first[1:], len(codes)] - 1
            yield pa.record_batch(
                [pa.array(slot[first]), pa.array(digit[first].astype(np.int32)), pa.array(np.add.reduceat(n, first)),
                 pa.array(codes[first]), pa.array(codes[last])], ["slot", "digit", "n", "low", "high"],
            )

    def count(batches):
        held: list[list[np.ndarray]] = [[] for _ in slots]
        rows = 0
        for batch in batches:
            for c in range(len(slots)):
                if len(numbers[c]):
                    held[c].append(batch.column(c).drop_null().to_numpy(zero_copy_only=False))
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                yield from emit(held)
                held, rows = [[] for _ in slots], 0
        yield from emit(held)

    return count


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float] | None]:
    """Exact quantiles of each column, nulls left out; ``None`` if all null."""
    columns, probs = list(columns), [float(p) for p in probabilities]
    if not columns:
        return {}
    values = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    # Open searches: slot -> (column, bits found, {wanted rank: rank among the values that share them}).
    open_: list[tuple[int, int | None, dict[int, int]]] = [(i, None, {}) for i in range(len(columns))]
    totals: dict[int, int] = {}
    found: dict[tuple[int, int], float] = {}
    for shift in range(64 - DIGIT, -1, -DIGIT):
        slots: list[list[tuple[int | None, int]]] = [[] for _ in columns]
        for s, (c, prefix, _) in enumerate(open_):
            slots[c].append((prefix, s))
        slots = [sorted(own, key=lambda x: (x[0] is not None, x[0])) for own in slots]
        counts = values.mapInArrow(_counter(slots, shift), "slot int, digit int, n long, low long, high long").groupBy("slot", "digit").agg(
            F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
        )
        group = W.partitionBy("slot")
        upto = F.sum("n").over(group.orderBy("digit").rowsBetween(W.unboundedPreceding, 0))
        counts = counts.withColumn("before", upto - F.col("n")).withColumn("total", F.sum("n").over(group))
        if not totals:
            place = lambda p: F.lit(p) * (F.col("total") - 1)
            ranks = F.array_distinct(F.array(*[f(place(p)).cast("long") for p in probs for f in (F.floor, F.ceil)]))
            wanted = counts.withColumn("rank", F.explode(ranks)).withColumn("own", F.col("rank"))
        else:
            listed = [(s, rank, own) for s, (_, _, ranks_) in enumerate(open_) for rank, own in ranks_.items()]
            targets = df.sparkSession.createDataFrame(listed, "slot int, rank long, own long")
            wanted = counts.join(targets, "slot")
        rows = wanted.where("own >= before and own < before + n").collect()
        after: dict[tuple[int, int], dict[int, int]] = {}
        for r in rows:
            c = open_[r["slot"]][0]
            totals.setdefault(c, r["total"])
            if r["low"] == r["high"]:
                found[c, r["rank"]] = value_of(r["low"])
            else:
                after.setdefault((c, r["low"] >> shift), {})[r["rank"]] = r["own"] - r["before"]
        open_ = [(c, prefix, ranks_) for (c, prefix), ranks_ in sorted(after.items())]
        if not open_:
            break
    result: dict[str, list[float] | None] = {}
    for i, c in enumerate(columns):
        if i not in totals:
            result[c] = None
            continue
        result[c] = []
        for p in probs:
            position = p * (totals[i] - 1)
            low, high = found[i, math.floor(position)], found[i, math.ceil(position)]
            result[c].append(low if low == high else low + (position - math.floor(position)) * (high - low))
    return result
