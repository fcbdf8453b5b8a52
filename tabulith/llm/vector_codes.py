"""Vector codes: product quantisation with ball k-means over whole numbers.

Components become ``floor(scale * x)`` and vectors are cut into equal consecutive parts,
each part position with a codebook of its own.  All steps are exact whole-number
arithmetic, so results do not depend on how the rows are dealt out.

A round moves every row once.  Parts carry the entry they had; its ball is the entry
with the parts that hold it, and its radius the largest of their distances.  Entries
whose half distance from the ball's centre exceeds the radius are no neighbours.  A part
nearer to its entry than half the way to the nearest neighbour lies in the stable core
and skips work; the others fall into annular rings by how many neighbours lie within
twice their distance, and only those are compared exactly.  An entry left out is
strictly farther away, so ties still go to the lower index.  Radii are taken for each
Arrow batch, which is a tighter bound than over all rows.

Rows stay where they are: a round sends the codebook out and brings one partial sum per
task, entry and component back together; nothing else is shuffled.  Each round's rows
are persisted beside the task and are made anew from the table if an executor is lost.
The first entries are the parts of the rows with the smallest ids.

Rows whose vector is null or holds null or non-finite components take no part, nor do
vectors whose length differs from that of the first row, or with a component of
``2 ** 26`` or more after scaling (sums of squares stay exact).  A length that the parts
do not divide gives the first parts one component more.  Null ids come last; repeated
ids are ordered by their components.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import stored

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components from here on (after scaling) are out of range.
LIMIT = 1 << 26


def _apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left - right) ** 2).sum(axis=-1)


def move(points: np.ndarray, own: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of every point, its squared distance, and how many distances were taken.

    ``own`` is the entry each point had before; any entry gives the right result.
    """
    best = own.astype(np.int64)
    error = _apart(points, entries[best])
    taken = len(points)
    if len(entries) < 2 or not len(points):
        return best, error, taken
    between = _apart(entries[:, None, :], entries[None, :, :])
    order = np.argsort(best, kind="stable")
    bounds = np.searchsorted(best[order], np.arange(len(entries) + 1))
    for i in range(len(entries)):
        members = order[bounds[i]:bounds[i + 1]]
        if not len(members):
            continue
        reach = 4 * error[members]
        far = np.argsort(between[i], kind="stable")
        neighbours = far[(far != i) & (between[i][far] <= reach.max())]
        if not len(neighbours):
            continue
        # Ring: neighbours within twice the distance.  Ring 0 is the stable core.
        ring = np.searchsorted(between[i][neighbours], reach, side="right")
        by_ring = np.argsort(-ring, kind="stable")
        members, ring = members[by_ring], ring[by_ring]
        for t, j in enumerate(neighbours):
            inside = members[: np.searchsorted(-ring, -t, side="left")]
            if not len(inside):
                break
            gap = _apart(points[inside], entries[j])
            taken += len(inside)
            nearer = (gap < error[inside]) | ((gap == error[inside]) & (j < best[inside]))
            error[inside[nearer]], best[inside[nearer]] = gap[nearer], j
    return best, error, taken


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(np.int64)


def _binary(codes: np.ndarray) -> pa.Array:
    n, width = codes.shape
    offsets = np.arange(0, (n + 1) * width, max(width, 1), dtype=np.int32)[: n + 1] if width else np.zeros(n + 1, np.int32)
    return pa.Array.from_buffers(
        pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(codes, np.uint8).tobytes())]
    )


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), parts)


class Codebooks:
    """``books[p]`` holds the entries of part ``p``; ``cuts`` are the part borders."""

    def __init__(self, first: np.ndarray, parts: int):
        sizes = np.full(parts, first.shape[1] // parts)
        sizes[: first.shape[1] % parts] += 1
        self.cuts = np.r_[0, np.cumsum(sizes)]
        self.books = [first[:, a:b].copy() for a, b in zip(self.cuts, self.cuts[1:])]

    def assign(self, cells: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """New codes, summed squared distances and the number of distances taken."""
        out, error, taken = np.empty_like(codes), np.zeros(len(cells), np.int64), 0
        for p, book in enumerate(self.books):
            out[:, p], gap, n = move(cells[:, self.cuts[p]:self.cuts[p + 1]], codes[:, p], book)
            error += gap
            taken += n
        return out, error, taken

    def replaced(self, sums: dict[tuple[int, int, int], int]) -> None:
        """Every used entry becomes the floor of its parts' mean; ``sums`` by part, entry and place (0: count)."""
        for p, book in enumerate(self.books):
            for e in range(len(book)):
                n = sums.get((p, e, 0), 0)
                if n:
                    book[e] = [sums[p, e, k + 1] // n for k in range(book.shape[1])]

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()


def _step(held, width: int, parts: int):
    """The rows with the codes of the codebooks sent out."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        for batch in batches:
            cells = _matrix(batch.column("cells"), width)
            codes, error, _ = books.assign(cells, _codes(batch.column("code"), parts))
            yield pa.record_batch(
                [batch.column("id"), batch.column("label"), batch.column("cells"), _binary(codes), pa.array(error)],
                ["id", "label", "cells", "code", "error"],
            )

    return step


def _sums(width: int, parts: int, cuts: np.ndarray, entries: int):
    """Per task: ``part, entry, place, value``; place 0 counts, the others sum components."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((entries, width), np.int64)
        for batch in batches:
            cells, codes = _matrix(batch.column("cells"), width), _codes(batch.column("code"), parts)
            for p in range(parts):
                count[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(total[:, cuts[p]:cuts[p + 1]], codes[:, p], cells[:, cuts[p]:cuts[p + 1]])
        rows = [(p, e, 0, int(count[p, e])) for p in range(parts) for e in range(entries) if count[p, e]]
        rows += [
            (p, e, k + 1, int(total[e, cuts[p] + k])) for p, e, _, _ in list(rows) for k in range(int(cuts[p + 1] - cuts[p]))
        ]
        columns = list(zip(*rows)) if rows else [(), (), (), ()]
        yield pa.record_batch(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64())],
            ["part", "entry", "place", "value"],
        )

    return add


def encode(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE,
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, Codebooks | None]:
    """``(id, label, code, error)`` of every row that takes part, and the codebooks.

    ``code`` holds one byte for each part.  Without such rows the codebooks are None.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("Codes take 1 to 256 entries and at least one part.")
    spark = vectors.sparkSession
    source = vectors.select(
        vectors[id_col].alias("id"), vectors[label_col].alias("label"), vectors[vector_col].cast("array<double>").alias("vector")
    )
    scaled = F.transform("vector", lambda x: F.floor(x * scale))
    sound = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x * scale) < LIMIT))
    whole = source.where(F.col("vector").isNotNull() & F.coalesce(sound, F.lit(False))).select(
        "id", "label", scaled.cast("array<int>").alias("cells")
    )
    kind, tag = dict(whole.dtypes)["id"], dict(whole.dtypes)["label"]
    first = whole.orderBy(F.col("id").asc_nulls_last(), "cells").limit(entries).collect()
    if not first:
        empty = whole.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty.where(F.lit(False)), None
    width = len(first[0]["cells"])
    start = np.array([r["cells"] for r in first if len(r["cells"]) == width], np.int64).reshape(-1, width)
    if len(start) < len(first):  # vectors of other lengths stood among the first rows
        first = whole.where(F.size("cells") == width).orderBy(F.col("id").asc_nulls_last(), "cells").limit(entries).collect()
        start = np.array([r["cells"] for r in first], np.int64).reshape(-1, width)
    books = Codebooks(start, parts)
    rows = whole.where(F.size("cells") == width).withColumn("code", F.lit(bytes(parts))).withColumn("error", F.lit(0).cast("long"))
    schema = f"id {kind}, label {tag}, cells array<int>, code binary, error long"
    held = None
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)
        moved = rows.mapInArrow(_step(sent, width, parts), schema).persist(StorageLevel.MEMORY_AND_DISK)
        sums = moved.select("cells", "code").mapInArrow(
            _sums(width, parts, books.cuts, len(start)), "part int, entry int, place int, value long"
        ).groupBy("part", "entry", "place").agg(F.sum("value").alias("value")).collect()
        if held is not None:
            held.unpersist()
        rows = held = moved
        after = Codebooks(start, parts)
        after.books = [b.copy() for b in books.books]
        after.replaced({(r["part"], r["entry"], r["place"]): r["value"] for r in sums})
        books = after
    last = rows.mapInArrow(_step(spark.sparkContext.broadcast(books), width, parts), schema)
    done = stored(last.select("id", "label", "code", "error"), "vector-codes")
    if held is not None:
        held.unpersist()
    return done, books


def labelled_error(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``, the error summed over equal labels; nulls are one label.

    Errors are summed before the shuffle and joined back, so one label may hold most rows.
    """
    total = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    return coded.join(total, F.col("label").eqNullSafe(F.col("of_label")), "left").drop("of_label")
