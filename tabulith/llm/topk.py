"""Exact top-k inner products by no-random-access aggregation.

Candidates are dealt to groups of a few thousand vectors by hash; every group sees
all queries (1 % of the rows) and keeps its best k per query, and the group winners
are merged.  Inside a group each dimension is a sorted list.  The lists are read to
growing depth: what has been read gives a lower bound of a score, what has not is
bounded by the value at the reading position, and reading stops for a query once
nothing outside its best k can reach the k-th lower bound.  The scores of the
remaining candidates are then completed.  Bounds are matrix products over a block
of queries; all sums are whole numbers.

Vectors that are null or hold a null or non-finite component take no part, nor do
rows without an id.  Rows with the id of the query are its own and are left out; of
several rows with a query's id the smallest vector asks.  Ties go to the smaller id.
Identical rows are separate candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .rows import parts

#: Vectors in a group and queries in a block, about.
GROUP_ROWS = 4096
QUERY_ROWS = 512


def group_top(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query number, id, score)`` of the k best per query among ``x``.

    The sorted lists are the sorted columns of ``x``, read from the top for
    positive and from the bottom for negative query components.
    """
    n = len(ids)
    exact = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(queries.astype(np.float64)).sum(axis=1).max(initial=0)) < 2**52
    work = np.float64 if exact else object
    x, queries = x.astype(work), queries.astype(work)
    lists = np.sort(x, axis=0)
    up, down = np.maximum(queries, 0).T, np.minimum(queries, 0).T
    live = np.arange(n)
    depth = max(k, n // 16)
    while depth < n and len(live) > 4 * k:
        top, bottom, part = lists[n - depth], lists[depth - 1], x[live]
        read_up, read_down = part >= top, part <= bottom
        high = np.where(read_up, part, top) @ up + np.where(read_down, part, bottom) @ down
        low = np.where(read_up, part, lists[0]) @ up + np.where(read_down, part, lists[-1]) @ down
        low[ids[live][:, None] == query_ids] = -np.inf
        bar = np.sort(low, axis=0)[-k] if work is object else np.partition(low, len(live) - k, axis=0)[len(live) - k]
        inside = high >= bar
        settled = inside.sum() <= 4 * k * len(queries)
        live = live[inside.any(axis=1)]
        if settled:
            break
        depth *= 2
    scores = x[live] @ queries.T
    numbers, found, values = [], [], []
    for q in range(len(queries)):
        own = ids[live] != query_ids[q]
        s, i = scores[own, q], ids[live][own]
        if len(s) > k:
            bar = sorted(s)[-k] if work is object else np.partition(s, len(s) - k)[len(s) - k]
            s, i = s[s >= bar], i[s >= bar]
        best = sorted(range(len(s)), key=lambda j: (-s[j], i[j]))[:k]
        numbers.append(np.full(len(best), q))
        found.append(i[best])
        values.append(np.array([min(max(int(s[j]), -(2**63)), 2**63 - 1) for j in best], np.int64))
    return np.concatenate(numbers), np.concatenate(found), np.concatenate(values)


def _groups(k: int):
    """Walks rows sorted by group, candidates first, and answers the queries in blocks."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, vectors, asked, asking = None, [], [], [], []
        held = None

        def answers():
            nonlocal held, asked, asking
            if held is None:
                held = (np.concatenate(ids), np.concatenate(vectors)) if ids else (np.empty(0, np.int64), None)
            q_ids, q_x = np.concatenate(asked), np.concatenate(asking)
            asked, asking = [], []
            if len(held[0]):
                n, i, s = group_top(held[0], held[1], q_ids, q_x, k)
                yield pa.record_batch([pa.array(q_ids[n]), pa.array(i), pa.array(s)], ["query_id", "vec_id", "score"])

        for batch in batches:
            g, role = batch.column("g").to_numpy(), batch.column("role").to_numpy()
            vec_id = batch.column("vec_id").to_numpy()
            flat = batch.column("v").flatten().to_numpy()
            width = len(flat) // max(1, len(g))
            x = flat.reshape(len(g), width)
            cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(role) != 0)) + 1
            for part in np.split(np.arange(len(g)), cuts):
                if not len(part):
                    continue
                if g[part[0]] != group:
                    if asked:
                        yield from answers()
                    group, ids, vectors, held = g[part[0]], [], [], None
                if role[part[0]] == 0:
                    ids.append(vec_id[part])
                    vectors.append(x[part])
                    continue
                for at in range(0, len(part), QUERY_ROWS):
                    asked.append(vec_id[part[at : at + QUERY_ROWS]])
                    asking.append(x[part[at : at + QUERY_ROWS]])
                    if sum(map(len, asked)) >= QUERY_ROWS:
                        yield from answers()
        if asked:
            yield from answers()

    return walk


def top_k(
    vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: int = 1024, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of every query.

    ``queries`` is a condition on the rows.  Components are scaled and floored;
    vectors must have one length.
    """
    v = vectors[vector_col].cast("array<double>")
    clean = vectors.where(
        vectors[id_col].isNotNull() & v.isNotNull()
        & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    ).select(vectors[id_col].cast("long").alias("vec_id"), F.transform(v, lambda e: F.floor(e * scale)).alias("v"), queries.alias("asks"))
    state = clean.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    if state["n"] and state["low"] != state["high"]:
        raise ValueError("Vectors differ in length.")
    groups = max(1, -(-state["n"] // group_rows))
    same = clean.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce("asks", F.lit(False))).alias("asks"))
    copies = same.select("vec_id", "v", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int"))).alias("copy"))
    g = F.pmod(F.xxhash64("vec_id", "v", "copy"), F.lit(groups)).cast("int")
    candidates = copies.select(g.alias("g"), F.lit(0).alias("role"), "vec_id", "v")
    asking = same.where("asks").groupBy("vec_id").agg(F.min("v").alias("v"))
    every = asking.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("role"), "vec_id", "v")
    dealt = candidates.unionByName(every).repartition(max(parts(vectors.sparkSession), groups // 8), "g").sortWithinPartitions("g", "role")
    found = dealt.mapInArrow(_groups(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
