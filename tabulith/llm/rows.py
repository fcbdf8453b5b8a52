"""Row keys, word streams and small file helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut_lineage

WHOLE = ("tinyint", "smallint", "int", "bigint")


def keyed(rows: DataFrame, id_col: str, **columns: str | Column) -> DataFrame:
    """``rid``, ``id`` and the named columns; ``rid`` is unique and follows ``id``.

    Whole-number ids that are unique and not null serve as ``rid``.  Otherwise
    (repeated, null or other ids) the rows are sorted by id and columns, nulls
    first, and numbered; the numbered rows are written once so that a retry
    sees the same numbers.  No other column is kept, so extra columns of any
    name cannot clash.
    """
    source = rows[id_col]
    named = {k: (rows[v] if isinstance(v, str) else v) for k, v in columns.items()}
    base = rows.select(source.alias("id"), *[c.alias(k) for k, c in named.items()])
    if dict(base.dtypes)["id"] in WHOLE:
        state = base.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(
            F.max("n").alias("n"), F.max(F.col("id").isNull().cast("int")).alias("gap")
        ).first()
        if (state["n"] or 1) == 1 and not state["gap"]:
            return base.withColumn("rid", F.coalesce(F.col("id").cast("long"), F.lit(0).cast("long")))
    ordered = base.orderBy("id", *[k for k, t in base.dtypes if k != "id" and not t.startswith("map")])
    return cut_lineage(ordered.withColumn("rid", F.monotonically_increasing_id()))


def told_apart(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` with one more column that differs in every row, and its name.

    Unique whole-number ids serve as they are.  Otherwise the rows are sorted by id and
    their sortable columns and numbered, and written once so that a retry sees the same numbers.
    """
    name = free(docs, "row_key")
    if docs.schema[id_col].dataType.simpleString() in WHOLE:
        state = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).agg(
            F.max("n").alias("n"), F.max(F.col(id_col).isNull().cast("int")).alias("gap")
        ).first()
        if (state["n"] or 1) == 1 and not state["gap"]:
            return docs.withColumn(name, F.col(id_col).cast("long")), name
    kinds = [(f.name, f.dataType.simpleString()) for f in docs.schema if f.name != id_col]
    ordered = docs.orderBy(F.col(id_col), *[F.col(k) for k, t in kinds if "map<" not in t and t != "variant"])
    return cut_lineage(ordered.withColumn(name, F.monotonically_increasing_id())), name


def free(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


class Hashes(dict):
    """Word to 64-bit hash; forgets all when it holds ``limit`` words."""

    limit = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def hash_words(cache: Hashes, words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def plain_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; none for null."""
    return text.lower().split() if text else []


_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def letter_words(text: bytes | None) -> list[bytes]:
    """Runs of digits, ASCII letters (lower-cased) and characters beyond ASCII."""
    return text.translate(_ALNUM).split() if text else []


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``most`` bytes in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        sizes = np.cumsum([0 if v is None else v for v in pc.binary_length(values).to_pylist()])
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def text_bytes(column: str = "text") -> Column:
    return F.col(column).cast("string").cast("binary")


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64, copy=False).view(np.int64)


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that their order is random."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
