"""Best-fit packing of documents into bins of several permitted lengths.

Documents are cut into pieces of at most the largest capacity (nothing is
dropped), dealt to shards of bounded size by hash, and every shard is packed on
its own: pieces go, longest first, into the open bin they leave the least room
in.  If none fits, a bin is opened whose capacity promises the least cost per
token for what the shard still holds; at the end each bin shrinks to the smallest
permitted length that holds its contents.

Null and empty texts hold no token and take no place (``bin`` is null).  Ties go
to the smaller row key.  Repeated rows are packed as separate documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import keyed, stored

#: Permitted sequence lengths, in tokens.
CAPACITIES = (512, 1024, 2048, 4096)
#: Tokens that opening any bin costs beside its capacity.
BIN_COST = 64
#: Pieces of a shard, about.
SHARD_PIECES = 20_000


def pack_lengths(lengths: Sequence[int], capacities: Sequence[int], bin_cost: float = BIN_COST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bin of each piece, offset in the bin, capacity of each bin)`` for one shard.

    ``lengths`` are between 1 and the largest capacity.  Open bins are kept by the
    room they have left; a bit per room finds the tightest one that fits.
    """
    caps = sorted(capacities)
    order = np.argsort(-np.asarray(lengths, np.int64), kind="stable")
    left = int(np.sum(lengths))
    rooms: dict[int, list[int]] = {}
    open_bits, where, offset = 0, np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    room: list[int] = []
    for i in order:
        size = int(lengths[i])
        fitting = open_bits >> size
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            b = rooms[r].pop()
            if not rooms[r]:
                open_bits &= ~(1 << r)
        else:
            fill = [min(c, left) for c in caps]
            c = min((c for c in caps if c >= size), key=lambda c: ((c + bin_cost) / max(size, fill[caps.index(c)]), c))
            b, r = len(used), c
            used.append(0)
            room.append(c)
        where[i], offset[i] = b, used[b]
        used[b] += size
        left -= size
        r -= size
        if r:
            rooms.setdefault(r, []).append(b)
            open_bits |= 1 << r
    final = np.array([next(c for c in caps if c >= u) for u in used], np.int64)
    return where, offset, final


def word_count(text: Column) -> Column:
    """White-space words plus one end mark; none for an empty or null text."""
    trimmed = F.regexp_replace(text, "^[ \\t-\\r]+|[ \\t-\\r]+$", "")
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) > 0, F.size(F.split(trimmed, "[ \\t-\\r]+")) + 1).otherwise(0)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_tokens: Column | None = None,
    capacities: Sequence[int] = CAPACITIES, bin_cost: float = BIN_COST, shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """One row per piece: ``id, piece, start, n_tokens, bin, offset, capacity, bin_tokens``.

    ``start`` is the piece's first token in its document, ``offset`` its place in
    the bin, ``bin`` a text unique over all shards.
    """
    counted = keyed(docs, id_col, tokens=(word_count(docs[text_col].cast("string")) if n_tokens is None else n_tokens).cast("long"))
    top = int(max(capacities))
    cut = counted.withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    n = F.greatest(F.lit(1), F.ceil(F.col("tokens") / top)).cast("int")
    split = cut.select(
        "rid", "id", "tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece")
    ).select(
        "rid", "id", "piece", (F.col("piece").cast("long") * top).alias("start"),
        F.least(F.lit(top).cast("long"), F.col("tokens") - F.col("piece").cast("long") * top).alias("n_tokens"),
    )
    split = stored(split, "pack-pieces")
    total = split.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    shards = max(1, -(-total // shard_pieces))
    dealt = split.where("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64("rid", "piece"), F.lit(shards)).cast("int"))
    kind = dict(split.dtypes)["id"]
    schema = f"id {kind}, piece int, start long, n_tokens long, bin string, offset long, capacity long, bin_tokens long"

    def shard_bins(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("rid", "ascending"), ("piece", "ascending")])
        lengths = rows.column("n_tokens").to_numpy()
        where, offset, caps = pack_lengths(lengths, capacities, bin_cost)
        held = np.bincount(where, weights=lengths, minlength=len(caps)).astype(np.int64)
        shard = rows.column("shard")[0].as_py()
        return pa.table({
            "id": rows.column("id"), "piece": rows.column("piece"), "start": rows.column("start"),
            "n_tokens": rows.column("n_tokens"), "bin": pa.array([f"{shard}:{b}" for b in where], pa.string()),
            "offset": offset, "capacity": caps[where], "bin_tokens": held[where],
        })

    packed = dealt.groupBy("shard").applyInArrow(shard_bins, schema)
    none = split.where("n_tokens <= 0").select(
        "id", "piece", "start", "n_tokens", *[F.lit(None).cast(t).alias(c) for c, t in (("bin", "string"), ("offset", "long"), ("capacity", "long"), ("bin_tokens", "long"))]
    )
    return packed.unionByName(none)
