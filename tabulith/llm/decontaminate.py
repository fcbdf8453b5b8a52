"""Benchmark decontamination with suffix arrays of the training texts.

The training side is indexed: each task builds a word-level suffix array per shard
of its documents, ordered by the first ``window`` words (words that no test item
has end a suffix).  Every suffix of every test item is binary-searched in it, all
at once; the range of equal prefixes gives the locations, and neighbouring hits of
an item extend to the longest verbatim match.  Only the test items are sent to the
tasks, in blocks of bounded size; documents are not shuffled.

Null texts and texts without a word match nothing.  Items without a word are
ignored, items shorter than a window count as one window.  Item ids that repeat
are one item.  Repeated documents are judged separately.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import keyed, letter_words, pieces, told_apart

WINDOW = 13
#: Bytes of test text that are sent to the tasks at once.
BLOCK_BYTES = 8_000_000
#: Bytes of training text in one suffix array, about.
SHARD_BYTES = 4_000_000


class TestWindows:
    """The distinct windows of a block of test items as word numbers.

    ``places[w]`` lists the items of window ``w`` and where it stands in each; ``rows``
    are padded with -1.
    """

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        self.names: list[str] = []
        number: dict[str, int] = {}
        length: dict[int, int] = {}
        for name, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in letter_words(text)]
            if not words:
                continue
            i = number.setdefault(name, len(number))
            if i == len(self.names):
                self.names.append(name)
            # Texts under one id follow one another with a gap, so no match runs from one into the next.
            at = length.get(i, 0)
            length[i] = at + len(words) + 1
            for k in range(max(1, len(words) - window + 1)):
                owners.setdefault(tuple(words[k : k + window]), []).append((i, at + k))
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.rows = np.full((len(owners), window), -1, np.int64)
        for r, w in enumerate(owners):
            self.rows[r, : len(w)] = w
        self.places = list(owners.values())
        bits = max(1, len(self.vocabulary).bit_length())
        self.per, self.bits = max(1, 62 // bits), bits

    def digits(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        """Words of each position packed into as few numbers as hold them, in order."""
        out = []
        for k in range(0, len(columns), self.per):
            value = columns[k].copy()
            for c in columns[k + 1 : k + self.per]:
                value = (value << self.bits) | c
            out.append(value)
        return out

    def search(self, words: np.ndarray, limit: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """``(window, start positions)``; ``limit[p]`` is where the text of ``p`` ends.

        ``words`` has 0 for words unknown to the tests.
        """
        if not len(self.rows) or not len(words):
            return
        starts = np.flatnonzero(words > 0)
        columns, alive = [], np.ones(len(starts), bool)
        for k in range(self.window):
            at = starts + k
            alive &= at < limit[starts]
            value = np.where(alive, words[np.minimum(at, len(words) - 1)], 0)
            alive &= value > 0
            columns.append(np.where(alive, value, 0))
        shortest = int(self.lengths.min())
        keep = columns[shortest - 1] > 0
        starts, columns = starts[keep], [c[keep] for c in columns]
        if not len(starts):
            return
        keys = self.digits(columns)
        order = np.lexsort(keys[::-1])
        suffixes, keys = starts[order], [k[order] for k in keys]
        low_rows = np.where(self.rows < 0, 0, self.rows)
        high_rows = np.where(self.rows < 0, (1 << self.bits) - 1, self.rows)
        low = self._bound(keys, self.digits(list(low_rows.T)), "left")
        high = self._bound(keys, self.digits(list(high_rows.T)), "right")
        for w in np.flatnonzero(high > low):
            yield int(w), suffixes[low[w] : high[w]]

    @staticmethod
    def _bound(keys: list[np.ndarray], wanted: list[np.ndarray], side: str) -> np.ndarray:
        """Binary search of every test suffix in the sorted suffixes, digit by digit on ties."""
        n = len(keys[0])
        low, high = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), n, np.int64)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high) >> 1
            at = np.minimum(mid, n - 1)
            less = np.zeros(len(low), bool)
            equal = np.ones(len(low), bool)
            for k, w in zip(keys, wanted):
                v = k[at]
                less |= equal & (v < w)
                equal &= v == w
            right = less | equal if side == "right" else less
            low = np.where(open_ & right, mid + 1, low)
            high = np.where(open_ & ~right, mid, high)


def _longest(hits: list[tuple[int, list[int]]], length: int) -> list[tuple[int, int]]:
    """``(start, end)`` of the maximal verbatim matches with one item.

    ``hits`` lists, by start, where in the item the ``length`` words from there stand.  A
    match goes on while the place in the item goes on with it; one that lies inside
    another is left out.
    """
    out: list[tuple[int, int]] = []
    open_: dict[int, int] = {}  # place in the item -> where the match that reached it began
    last = None
    for start, places in [*hits, (None, [])]:
        before = open_ if last is not None and start == last + 1 else {}
        now = {p: before.get(p - 1, start) for p in places}
        ended = [began for p, began in open_.items() if p + 1 not in now or not before]
        if ended:
            going = min(now.values()) if before and now else None
            if going is None or min(ended) < going:
                out.append((min(ended), last + length))
        open_, last = now, start
    return out


_MATCH = pa.struct([("item", pa.string()), ("start", pa.int64()), ("length", pa.int64())])


def _matcher(windows, shard_bytes: int):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: TestWindows = windows.value
        get = tests.vocabulary.get
        for batch in pieces(batches, "text", shard_bytes):
            docs = [letter_words(t) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(d) for d in docs], np.int64)
            ends = np.cumsum(sizes)
            words = np.fromiter((get(w, 0) for d in docs for w in d), np.int64, int(ends[-1]))
            limit = np.repeat(ends, sizes)
            owner = np.repeat(np.arange(len(docs)), sizes)
            found: list[dict[tuple[int, int], list[tuple[int, list[int]]]]] = [{} for _ in docs]
            for w, starts in tests.search(words, limit):
                places: dict[int, list[int]] = {}
                for i, p in tests.places[w]:
                    places.setdefault(i, []).append(p)
                n = int(tests.lengths[w])
                for at in starts.tolist():
                    hit = found[owner[at]]
                    for i, p in places.items():
                        hit.setdefault((i, n), []).append((at, p))
            matches = [
                [
                    {"item": tests.names[i], "start": s - int(ends[k] - sizes[k]), "length": e - s}
                    for (i, n), hits in hit.items() for s, e in _longest(sorted(hits), n)
                ]
                for k, hit in enumerate(found)
            ]
            yield pa.record_batch(
                [batch.column("rid"), batch.column("id"), pa.array(sizes), pa.array(matches, pa.list_(_MATCH))],
                ["rid", "id", "n_words", "matches"],
            )

    return match


def find_matches(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per document: ``rid, id, n_words, matches``.

    ``matches`` lists ``item, start, length`` (in words) of the maximal verbatim
    matches with each item.  Items without an id are ignored.  Test items beyond
    ``block_bytes`` are searched block by block; the matches are then united.
    """
    given = keyed(docs, id_col, text=text_bytes_of(docs, text_col))
    tests = items.select(items[item_id].cast("string").alias("item"), text_bytes_of(items, item_text).alias("text"))
    size = tests.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 16).alias("b")).first()["b"] or 0
    blocks = max(1, -(-size // block_bytes))
    kind = dict(given.dtypes)["id"]
    schema = f"rid long, id {kind}, n_words long, matches array<struct<item:string,start:bigint,length:bigint>>"
    context = docs.sparkSession.sparkContext
    out = None
    for b in range(blocks):
        part = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        rows = [(r["item"], bytes(r["text"]) if r["text"] is not None else None) for r in part.collect() if r["item"] is not None]
        found = given.select("rid", "id", "text").mapInArrow(_matcher(context.broadcast(TestWindows(rows, window)), shard_bytes), schema)
        out = found if out is None else out.unionByName(found)
    if blocks == 1:
        return out
    return out.groupBy("rid").agg(
        F.first("id").alias("id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches")
    )


def text_bytes_of(df: DataFrame, column: str):
    return df[column].cast("string").cast("binary")


def covered_words(matches: str):
    """Words inside any match."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["start"].alias("s"), (m["start"] + m["length"]).alias("e"))))
    none = F.lit(0).cast("long")
    return F.aggregate(
        spans, F.struct(none.alias("total"), none.alias("at")),
        lambda a, m: F.struct(
            (a["total"] + F.greatest(none, m["e"] - F.greatest(m["s"], a["at"]))).alias("total"), F.greatest(a["at"], m["e"]).alias("at")
        ),
        lambda a: a["total"],
    )


def judge(found: DataFrame, share: int = 20) -> DataFrame:
    """Adds ``n_hit, items, contaminated`` (at least one word in ``share`` is hit)."""
    out = found.withColumn("n_hit", covered_words("matches")).withColumn(
        "items", F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"])))
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated documents; same columns.

    Every row is judged by its own text, also where rows share an id or have none.
    """
    rows, key = told_apart(docs, id_col)
    bad = judge(find_matches(rows, items, key, text_col)).where("contaminated").select(F.col("id").alias(key))
    return rows.join(bad, key, "left_anti").select(*docs.columns)
