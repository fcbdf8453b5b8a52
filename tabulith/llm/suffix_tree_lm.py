"""Language-model scores from a probabilistic suffix tree of variable depth.

A context is the last one to ``depth`` words of a text.  It is a candidate if it occurs
``context_count`` times in the training texts.  Its next-symbol distribution lists the
words that follow it ``next_count`` times, discounted; the rest of the mass follows the
next shorter context, and in the end the add-one unigram distribution over the whole
vocabulary.  A context is kept only if its distribution diverges from the one it would
have without it.  Both counts grow with the square root of the training tokens unless
given, so the tree grows with the corpus while the share of the text that can matter to a
level, and with it the rows that are counted, stays nearly the same.

Levels, followers and vocabulary are tables keyed by hashes of contexts and pairs.  A
kept context adds ``fall`` to the log-probability of any word behind it, a listed pair
``extra`` on top, so the state of the longest kept context is a sum of table entries and
a text's score is a sum over its tokens.  Entries that occur in ``travel_share`` of all
tokens (at most ``1 / travel_share`` of each kind) travel to the tasks; all others are
joined, summed per text.  Bit maps of fixed size tell the tasks which words, contexts and
entries can matter at all; what they let through by chance falls out in the joins.

All counts are taken over every training document.  Null and empty texts are one end
mark.  A row whose ``learn`` is null does not teach.  Words are compared by 64-bit hashes.
Repeated rows and null ids are scored each on its own.  Without training tokens every
score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import Hashes, hash_words, keyed, mix, pieces, plain_words, signed, stored

DEPTH = 3
#: Times the square root of the training tokens: occurrences of a candidate context and of a listed word behind it.
CONTEXT_ROOT, NEXT_ROOT = 0.2, 0.02
TRAVEL_SHARE = 1e-6
#: Smallest divergence, in nats, of a kept context from its suffix.
DIVERGENCE = 0.01
DISCOUNT = 0.5
PIECE = 4_000_000
#: Bits of a map of hashes; a power of two.
MAP_BITS = 1 << 25
END_HASH = np.uint64(xxhash.xxh3_64_intdigest(b" "))
_SALT = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(texts: list[bytes | None], cache: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and the ``len + 1`` offsets of the texts."""
    words = [plain_words(t) for t in texts]
    offsets = np.r_[0, np.cumsum([len(w) + 1 for w in words])].astype(np.int64)
    out = np.full(int(offsets[-1]), END_HASH, np.uint64)
    flat = hash_words(cache, [w for own in words for w in own])
    inner = np.ones(len(out), bool)
    inner[offsets[1:] - 1] = False
    out[inner] = flat
    return out, offsets


def find(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted ``values``, or -1."""
    if not len(values):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(values, keys), len(values) - 1)
    return np.where(values[at] == keys, at, -1)


def pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a word behind a context; it is also the context that both make."""
    return mix(context * _SALT + word)


def entry(context: np.ndarray) -> np.ndarray:
    """Key under which a context's ``fall`` is filed, apart from the pairs."""
    return mix(context ^ np.uint64(0xA5A5A5A5A5A5A5A5))


class Levels:
    """Contexts of each length before every token; ``sound`` where the text is long enough."""

    def __init__(self, tokens: np.ndarray, offsets: np.ndarray, depth: int):
        place = np.arange(len(tokens)) - np.repeat(offsets[:-1], np.diff(offsets))
        self.contexts, self.keys, self.sound = [], [], []
        for d in range(1, depth + 1):
            before = mix(tokens ^ _SALT) if d == 1 else self.keys[-1]
            context = np.r_[np.zeros(1, np.uint64), before[:-1]]
            self.contexts.append(context)
            self.keys.append(pair(context, tokens))
            self.sound.append(place >= d)


class BitMap:
    """Set of hashes by one bit each; tells for certain only what is absent."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, hashes: DataFrame, bits: int = MAP_BITS) -> BitMap:
        """From a table's column ``h``, gathered as one number per 64 bits."""
        spot = F.col("h").bitwiseAND(bits - 1)
        rows = hashes.select(
            F.shiftright(spot, 6).cast("int").alias("slot"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")
        ).groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
        words = np.zeros(bits // 64, np.uint64)
        words[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
        return cls(words)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        spot = hashes & np.uint64(64 * len(self.words) - 1)
        return (self.words[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) > 0


@dataclass
class Known:
    """What travels: totals, frequent words with counts, frequent tree entries, bit maps of the rest."""

    total: int
    vocabulary: int
    words: np.ndarray
    counts: np.ndarray
    depth: int = 0
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    gains: np.ndarray = field(default_factory=lambda: np.empty(0))
    near: BitMap | None = None
    far: BitMap | None = None


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = Hashes()
    for batch in pieces(batches, "text", PIECE):
        tokens, _ = tokens_of(batch.column("text").to_pylist(), cache)
        words, n = np.unique(tokens, return_counts=True)
        yield pa.record_batch([pa.array(signed(words)), pa.array(n)], ["word", "n"])


def _followers(maps, depths: Sequence[int]):
    """Counts of the words behind candidate contexts, as ``level, context, word, n``.

    ``maps`` holds the bit maps of the candidate contexts of the first length and of the words
    that may follow.  A context of the second length is frequent only if its two parts of the
    first length are, so both lengths are counted in one pass.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, (contexts, words) = Hashes(), maps.value
        for batch in pieces(batches, "text", PIECE):
            tokens, offsets = tokens_of(batch.column("text").to_pylist(), cache)
            levels = Levels(tokens, offsets, depths[-1])
            first = depths[0] - 1
            hold = levels.sound[first] & contexts.may_hold(levels.contexts[first])
            for d in depths:
                if d > depths[0]:
                    hold = hold & np.r_[False, hold[:-1]] & levels.sound[d - 1]
                use = np.flatnonzero(hold)
                use = use[words.may_hold(tokens[use])]
                _, start, n = np.unique(levels.keys[d - 1][use], return_index=True, return_counts=True)
                at = use[start]
                yield pa.record_batch(
                    [pa.array(np.full(len(at), d, np.int32)), pa.array(signed(levels.contexts[d - 1][at])), pa.array(signed(tokens[at])), pa.array(n)],
                    ["level", "context", "word", "n"],
                )

    return count


def _texts(known):
    """Per text: tokens, words that travel, their part of both scores, and what is left to join.

    ``open`` lists ``key, n`` of words and tree entries that do not travel.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held = Hashes(), known.value
        ones = np.log10(held.counts + 1.0)
        for batch in pieces(batches, "text", PIECE):
            tokens, offsets = tokens_of(batch.column("text").to_pylist(), cache)
            first, text = offsets[:-1], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            distinct, inverse = np.unique(tokens, return_inverse=True)
            at = find(held.words, distinct)
            own = np.where(at >= 0, ones[np.maximum(at, 0)] if len(ones) else 0.0, 0.0)[inverse]
            rare = (at < 0)[inverse]
            gain = np.zeros(len(tokens))
            keys, owners = [tokens[rare]], [text[rare]]
            levels = Levels(tokens, offsets, held.depth)
            for d in range(held.depth):
                # A pair is listed only behind a kept context, so contexts are looked up first.
                use = np.flatnonzero(levels.sound[d])
                for file in (lambda at: entry(levels.contexts[d][at]), lambda at: levels.keys[d][at]):  # noqa: B023
                    wanted = file(use)
                    near = np.flatnonzero(held.near.may_hold(wanted))
                    at = find(held.keys, wanted[near])
                    hit = at >= 0
                    gain[use[near[hit]]] += held.gains[at[hit]]
                    found = np.zeros(len(use), bool)
                    found[near[hit]] = True
                    if held.far is not None:
                        far = held.far.may_hold(wanted)
                        keys.append(wanted[far])
                        owners.append(text[use[far]])
                        found |= far
                    use = use[found]
            keys, owners = np.concatenate(keys), np.concatenate(owners)
            order = np.lexsort((keys, owners))
            keys, owners = keys[order], owners[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
            start = np.flatnonzero(new)
            entries = pa.StructArray.from_arrays(
                [pa.array(signed(keys[start])), pa.array(np.diff(np.r_[start, len(keys)]))],
                fields=[pa.field("key", pa.int64()), pa.field("n", pa.int64())],
            )
            bounds = np.searchsorted(owners[start], np.arange(len(offsets)))
            yield pa.record_batch([
                batch.column("rid"), batch.column("id"), pa.array(np.diff(offsets)),
                pa.array(np.add.reduceat((~rare).astype(np.int64), first)), pa.array(np.add.reduceat(own, first)),
                pa.array(np.add.reduceat(gain, first)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), entries),
            ], ["rid", "id", "n_tokens", "known", "own", "gain", "open"])

    return score


class SuffixTreeModel:
    """A tree fitted on the rows of ``docs`` where ``learn`` holds; the first two counts follow the root rule if None.

    ``entries`` holds ``key, gain, n`` of every kept context and listed pair; ``levels``
    the numbers of candidate contexts, kept contexts and listed pairs per length.
    """

    def __init__(
        self, docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
        context_count: int | None = None, next_count: int | None = None, travel_share: float = TRAVEL_SHARE,
        divergence: float = DIVERGENCE,
    ):
        self.id_col, self.text_col, self.divergence, self.depth = id_col, text_col, divergence, depth
        self.counted: dict[int, DataFrame] = {}
        self.context = docs.sparkSession.sparkContext
        teach = docs.where(F.coalesce(learn, F.lit(False))).select(docs[text_col].cast("string").cast("binary").alias("text"))
        self.counts = stored(
            teach.mapInArrow(_unigrams, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "suffix-tree-words"
        )
        state = self.counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.total, self.vocabulary = state["n"] or 0, state["v"]
        root = math.sqrt(self.total)
        self.context_count = max(2, math.ceil(CONTEXT_ROOT * root)) if context_count is None else context_count
        self.next_count = max(2, math.ceil(NEXT_ROOT * root)) if next_count is None else next_count
        if depth < 0 or not 1 <= self.next_count <= self.context_count:
            raise ValueError("The depth is not negative, and 1 <= next_count <= context_count.")
        self.bar = max(1.0, travel_share * self.total)
        words, counts = self._sorted(self.counts.where(F.col("n") >= self.bar), "word", "n")
        self.known = Known(self.total, self.vocabulary, words, counts)
        self.levels: list[tuple[int, int, int]] = []
        self.entries: DataFrame | None = None
        self.fitted: list[tuple[DataFrame, DataFrame]] = []
        end = int(np.array([END_HASH]).view(np.int64)[0])
        if self.total and depth:
            self.next_words = BitMap.of(self.counts.where(F.col("n") >= self.next_count).select(F.col("word").alias("h")))
            contexts = self.counts.where((F.col("n") >= self.context_count) & (F.col("word") != end)).select("word", F.col("n").alias("total"))
            contexts = contexts.mapInArrow(_salted, "context long, total long")
            for d in range(1, depth + 1):
                contexts = self._grow(teach, d, contexts, end)
                if contexts is None:
                    break
            self._travel()

    @staticmethod
    def _sorted(rows: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
        held = rows.select(key, value).toArrow()
        keys, values = held.column(key).to_numpy().view(np.uint64), held.column(value).to_numpy()
        order = np.argsort(keys)
        return keys[order], values[order]

    def _grow(self, teach: DataFrame, depth: int, contexts: DataFrame, end: int) -> DataFrame | None:
        """Adds the level of ``depth``; returns the candidate contexts one word longer.

        ``contexts`` holds ``context, total`` and the shorter contexts ``context1 ..`` within each.
        """
        contexts = stored(contexts, "suffix-tree-contexts")
        candidates = contexts.count()
        if not candidates:
            return None
        if depth not in self.counted:
            maps = self.context.broadcast((BitMap.of(contexts.select(F.col("context").alias("h"))), self.next_words))
            # One word is counted by itself; longer contexts two lengths at a time.
            depths = [depth] if depth == 1 or depth == self.depth else [depth, depth + 1]
            counted = teach.mapInArrow(_followers(maps, depths), "level int, context long, word long, n long")
            counted = counted.groupBy("level", "context", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= self.next_count)
            counted = stored(counted, "suffix-tree-counts")
            self.counted |= {d: counted.where(F.col("level") == d).drop("level") for d in depths}
        often = self.counted[depth]
        shorter = [f"context{d}" for d in range(1, depth)]
        often = often.join(contexts, "context").select("context", "word", "n", "total", *shorter)
        names = ["context", "word", "n", "total", *shorter, "key", "last", *[f"key{d}" for d in range(1, depth)]]
        often = stored(often.mapInArrow(_keys(depth), ", ".join(f"{c} long" for c in names)), "suffix-tree-followers")
        root = F.log((F.col("c") + 1.0) / (self.total + self.vocabulary + 1))
        rows = often.join(self.counts.select("word", F.col("n").alias("c")), "word").withColumn("low", root)
        for d, (kept, listed) in enumerate(self.fitted, 1):
            # What the shorter contexts make of the same word.
            rows = rows.join(kept.select(F.col("context").alias(f"context{d}"), F.col("fall").alias(f"fall{d}")), f"context{d}", "left")
            rows = rows.join(listed.select(F.col("key").alias(f"key{d}"), F.col("extra").alias(f"extra{d}")), f"key{d}", "left")
            rows = rows.withColumn("low", F.col("low") + F.coalesce(f"fall{d}", F.lit(0.0)) + F.coalesce(f"extra{d}", F.lit(0.0)))
        rows = rows.select("key", "context", "n", "total", "low")
        share, spared = F.col("n") / F.col("total"), (F.col("n") - DISCOUNT) / F.col("total")
        sums = rows.groupBy("context").agg(
            F.first("total").alias("total"), F.sum(share).alias("mass"), F.sum(F.exp("low")).alias("below"),
            F.sum(share * (F.log(share) - F.col("low"))).alias("apart"), F.sum(spared).alias("listed"),
        )
        rest, free = F.greatest(1 - F.col("mass"), F.lit(0.0)), F.greatest(1 - F.col("below"), F.lit(1e-9))
        tail = F.when(rest > 0, rest * F.log(rest / free)).otherwise(0.0)
        fall = F.log(F.greatest(1 - F.col("listed"), F.lit(1e-12)) / free)
        kept = stored(
            sums.where(F.col("apart") + tail >= self.divergence).select("context", F.col("total").alias("n"), fall.alias("fall")),
            "suffix-tree-kept",
        )
        listed = stored(
            rows.join(kept.select("context", "fall"), "context").select(
                "key", "n", (F.log(spared) - F.col("low") - F.col("fall")).alias("extra")
            ), "suffix-tree-listed",
        )
        self.fitted.append((kept, listed))
        self.levels.append((candidates, kept.count(), listed.count()))
        # What the words before make with the new one, from the shortest on.
        within = [F.col("last").alias("context1"), *[F.col(f"key{d}").alias(f"context{d + 1}") for d in range(1, depth)]]
        return often.where((F.col("n") >= self.context_count) & (F.col("word") != end)).select(
            F.col("key").alias("context"), F.col("n").alias("total"), *within
        )

    def _travel(self) -> None:
        """Entries by key; the frequent ones go along with the tasks, the others get a bit map."""
        entries = None
        for kept, listed in self.fitted:
            both = kept.select("context", "n", F.col("fall").alias("gain")).mapInArrow(
                _filed, "key long, n long, gain double"
            ).unionByName(listed.select("key", "n", F.col("extra").alias("gain")))
            entries = both if entries is None else entries.unionByName(both)
        if entries is None:
            return
        entries = stored(entries, "suffix-tree-entries")
        keys, gains = self._sorted(entries.where(F.col("n") >= self.bar), "key", "gain")
        self.entries = entries.where(F.col("n") < self.bar)
        near = entries.where(F.col("n") >= self.bar).select(F.col("key").alias("h"))
        far = None if self.entries.isEmpty() else BitMap.of(self.entries.select(F.col("key").alias("h")))
        self.known = Known(
            self.total, self.vocabulary, self.known.words, self.known.counts, len(self.fitted), keys, gains, BitMap.of(near), far
        )

    def score(self, docs: DataFrame) -> DataFrame:
        """``rid, id, n_tokens, n_known, base_score, score`` (log10) of every document."""
        given = keyed(docs, self.id_col, text=docs[self.text_col].cast("string").cast("binary"))
        kind = dict(given.dtypes)["id"]
        sent = self.context.broadcast(self.known)
        whole = stored(given.select("rid", "id", "text").mapInArrow(
            _texts(sent), f"rid long, id {kind}, n_tokens long, known long, own double, gain double, open array<struct<key:bigint,n:bigint>>"
        ), "suffix-tree-texts")
        left = whole.select("rid", F.explode("open").alias("o")).select("rid", "o.key", "o.n")
        values = self.counts.where(F.col("n") < self.bar).select(
            F.col("word").alias("key"), F.log10(F.col("n") + 1.0).alias("base"), F.lit(1).alias("seen"), F.lit(0.0).alias("more")
        )
        if self.entries is not None:
            values = values.unionByName(
                self.entries.select("key", F.lit(0.0).alias("base"), F.lit(0).alias("seen"), F.col("gain").alias("more"))
            )
        summed = left.join(values, "key").groupBy("rid").agg(
            F.sum(F.col("n") * F.col("base")).alias("base"), F.sum(F.col("n") * F.col("seen")).alias("seen"),
            F.sum(F.col("n") * F.col("more")).alias("more"),
        )
        below = math.log10(self.total + self.vocabulary + 1)
        base = F.col("own") + F.coalesce("base", F.lit(0.0)) - F.col("n_tokens") * F.lit(below)
        gain = (F.col("gain") + F.coalesce("more", F.lit(0.0))) / math.log(10)
        return whole.join(summed, "rid", "left").select(
            "rid", "id", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"),
            base.alias("base_score"), (base + gain).alias("score"),
        )


def _salted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The context that one word makes is filed under its salted hash."""
    for batch in batches:
        words = batch.column("word").to_numpy().view(np.uint64)
        yield pa.record_batch([pa.array(signed(mix(words ^ _SALT))), batch.column("total")], ["context", "total"])


def _keys(depth: int):
    """Adds the keys of the word behind its context (``key``) and behind the shorter ones, and the context it makes alone."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(name).to_numpy().view(np.uint64)  # noqa: B023, E731
            word = column("word")
            made = [pair(column("context"), word), mix(word ^ _SALT), *[pair(column(f"context{d}"), word) for d in range(1, depth)]]
            names = ["key", "last", *[f"key{d}" for d in range(1, depth)]]
            yield pa.record_batch([*batch.columns, *[pa.array(signed(m)) for m in made]], [*batch.schema.names, *names])

    return add


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        contexts = batch.column("context").to_numpy().view(np.uint64)
        yield pa.record_batch([pa.array(signed(entry(contexts))), batch.column("n"), batch.column("gain")], ["key", "n", "gain"])
