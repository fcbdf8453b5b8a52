"""Toxicity by two class-conditional Kneser-Ney models.

A toxic and an ordinary model learn from labelled documents.  Both predict a word from
the word before it, and as in Kneser-Ney smoothing both orders count contexts, not
occurrences: a word by the distinct words before it, a pair by the distinct words before
the pair.  Copied and repeated text therefore teaches once.  Counts are discounted; what a
class frees at the pair level follows its word level, and what it frees there follows
continuation counts shared by both classes.  Expressions with fewer contexts than
``WORD_BAR`` or ``PAIR_BAR`` in both classes together are left to the shared counts alone,
and both classes free the same mass to them, so a rare expression speaks for neither.

The log-likelihoods are compared per token: over the whole text, and over every window
of ``WINDOWS`` words, of which the largest counts, so that one insult in a long text is
not diluted.  A logistic function of these figures, fitted on labelled documents that
the models have not seen, gives the score.

The models learn from a bounded sample of the labelled documents, drawn alike for both
classes: ``max_docs`` documents and ``max_bytes`` of text, both expected.  One part in
``CALIBRATE`` of it fits the logistic function.  Every document is scored on its whole
text in one pass without a shuffle; the models travel, bounded by the sample.

Words are runs of digits, ASCII letters (lower-cased) and characters beyond ASCII.  A
document's label is the largest non-null one of its id; documents sharing an id teach
once, by their first text in order.  Null and empty texts have no words: their figures
are 0 and they get what the logistic function gives for that.  Without labels of both
classes every score is the toxic share of the labels, 0 if there are none.  Repeated rows
and null ids are scored each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import Hashes, hash_words, keyed, letter_words, mix, pieces, signed, stored

MAX_DOCS, MAX_BYTES, CALIBRATE = 20_000, 16_000_000, 4
#: Contexts of a word and of a pair, in both classes together, from which classes differ.
WORD_BAR, PAIR_BAR = 5, 10
WINDOWS = (1, 2, 4, 8)
PIECE = 4_000_000
START = np.uint64(xxhash.xxh3_64_intdigest(b"\0start"))
ORDINARY, TOXIC = 0, 1


def _tokens(texts: list[bytes | None], cache: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, the hash before each, and the ``len + 1`` offsets."""
    split = [letter_words(t) for t in texts]
    offsets = np.r_[0, np.cumsum([len(w) for w in split])].astype(np.int64)
    words = hash_words(cache, [w for own in split for w in own])
    return words, _shifted(words, offsets), offsets


def _shifted(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What stands before each word; a text begins with ``START``."""
    before = np.r_[START, words[:-1]] if len(words) else words
    before[offsets[:-1][np.diff(offsets) > 0]] = START
    return before


def _pair(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + words)


def _place(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted value in the sorted keys (0 if absent) and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Tally:
    """Of one count over all expressions: its sum, how many have it, have 1 and have 2."""

    total: float
    kinds: int
    once: int
    twice: int

    @property
    def discount(self) -> float:
        return self.once / (self.once + 2 * self.twice) if self.once and self.twice else 0.5


@dataclass
class KneserNey:
    """Both classes' models; column 0 is ordinary, 1 toxic.

    ``single`` are word probabilities (``absent`` those of any other word); ``extra`` is what
    a pair adds to ``follow`` (by the word before) times the probability of the word.
    """

    words: np.ndarray
    single: np.ndarray
    absent: float
    heads: np.ndarray
    follow: np.ndarray
    pairs: np.ndarray
    extra: np.ndarray

    @classmethod
    def learn(
        cls, words: np.ndarray, contexts: np.ndarray, own: list[Tally], shared: Tally,
        before: np.ndarray, word: np.ndarray, paired: np.ndarray, headed: np.ndarray, pair_own: list[Tally],
    ) -> KneserNey:
        """From words and pairs above their bars with their contexts per class (two columns).

        ``own`` and ``shared`` tally the word counts of each class and of both together,
        ``pair_own`` the pair counts of each class; ``headed`` holds the pair contexts of the
        word before, per class.
        """
        order = np.argsort(words)
        words, contexts = words[order], contexts[order]
        pooled = contexts.sum(axis=1)
        base = (pooled - shared.discount) / max(shared.total, 1.0)
        rest = max(1.0 - base.sum(), 1e-12) / (shared.kinds - len(words) + 1)
        part = np.column_stack([np.maximum(contexts[:, c] - own[c].discount, 0) / max(own[c].total, 1.0) for c in (0, 1)])
        spared = 1.0 - part.sum(axis=0)
        freed = float(spared.max())
        part *= (1.0 - freed) / np.maximum(1.0 - spared, 1e-12)
        heads, h = np.unique(before, return_inverse=True)
        extra = np.column_stack([
            np.maximum(paired[:, c] - pair_own[c].discount, 0) / np.maximum(headed[:, c], 1.0) for c in (0, 1)
        ])
        follow = np.column_stack([1.0 - np.bincount(h, extra[:, c], len(heads)) for c in (0, 1)])
        pairs = _pair(before, word)
        order = np.argsort(pairs)
        return cls(words, part + freed * base[:, None], freed * rest, heads, follow, pairs[order], extra[order])

    def ratios(self, words: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Natural log of the toxic over the ordinary probability of each token."""
        distinct, inverse = np.unique(words, return_inverse=True)
        chance = np.full((len(distinct), 2), self.absent)
        at, known = _place(self.words, distinct)
        chance[known] = self.single[at[known]]
        chance = chance[inverse]
        distinct, inverse = np.unique(before, return_inverse=True)
        follow = np.ones((len(distinct), 2))
        at, known = _place(self.heads, distinct)
        follow[known] = self.follow[at[known]]
        chance *= follow[inverse]
        at, known = _place(self.pairs, _pair(before, words))
        chance[known] += self.extra[at[known]]
        return np.log(chance[:, TOXIC]) - np.log(chance[:, ORDINARY])


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct ``triple, before, word`` of the batch and the classes that have it."""
    cache = Hashes()
    for batch in pieces(batches, "text", PIECE):
        words, before, offsets = _tokens(batch.column("text").to_pylist(), cache)
        triple = _pair(_shifted(before, offsets), _pair(before, words))
        toxic = np.repeat(batch.column("toxic").to_numpy().astype(bool), np.diff(offsets))
        keys, first, inverse = np.unique(triple, return_index=True, return_inverse=True)
        n, m = np.bincount(inverse, ~toxic, len(keys)) > 0, np.bincount(inverse, toxic, len(keys)) > 0
        yield pa.record_batch([
            pa.array(signed(keys)), pa.array(signed(before[first])), pa.array(signed(words[first])),
            pa.array(n.astype(np.int32)), pa.array(m.astype(np.int32)),
        ], ["triple", "before", "word", "n0", "n1"])


def _tallies(counts: DataFrame, *columns: Column) -> list[Tally]:
    wanted = [f(c) for c in columns for f in (
        F.sum, lambda c: F.count_if(c > 0), lambda c: F.count_if(c == 1), lambda c: F.count_if(c == 2)
    )]
    row = counts.agg(*[w.alias(f"v{k}") for k, w in enumerate(wanted)]).first()
    return [Tally(*[x or 0 for x in row[4 * k:4 * k + 4]]) for k in range(len(columns))]


def learn_model(sample: DataFrame, word_bar: int = WORD_BAR, pair_bar: int = PAIR_BAR) -> KneserNey:
    """Models of ``sample`` (``text`` binary, ``toxic`` 0 or 1)."""
    n0, n1, both = F.col("n0"), F.col("n1"), F.col("n0") + F.col("n1")
    triples = sample.select("text", "toxic").mapInArrow(_triples, "triple long, before long, word long, n0 int, n1 int")
    pairs = stored(
        triples.groupBy("triple", "before", "word").agg(F.max("n0").alias("n0"), F.max("n1").alias("n1")).groupBy("before", "word").agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1")
        ), "toxicity-pairs",
    )
    words = stored(pairs.groupBy("word").agg(F.count_if(n0 > 0).alias("n0"), F.count_if(n1 > 0).alias("n1")), "toxicity-words")
    heads = pairs.groupBy("before").agg(F.sum("n0").alias("h0"), F.sum("n1").alias("h1"))
    *own, shared = _tallies(words, n0, n1, both)
    held = words.where(both >= word_bar).toArrow()
    frequent = pairs.where(both >= pair_bar).join(heads, "before").toArrow()
    column = lambda t, *names: np.column_stack([t.column(c).to_numpy() for c in names]).astype(np.float64)
    hashes = lambda t, name: t.column(name).to_numpy().view(np.uint64)
    return KneserNey.learn(
        hashes(held, "word"), column(held, "n0", "n1"), own, shared, hashes(frequent, "before"), hashes(frequent, "word"),
        column(frequent, "n0", "n1"), column(frequent, "h0", "h1"), _tallies(pairs, n0, n1),
    )


def text_figures(ratios: np.ndarray, offsets: np.ndarray, windows: tuple[int, ...] = WINDOWS) -> np.ndarray:
    """Per text: the mean ratio, then for each width the largest mean of a window; 0 without tokens.

    Texts shorter than a window are one window.
    """
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), 1 + len(windows)))
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    sums = np.r_[0.0, np.cumsum(ratios)]
    first, last, n = offsets[:-1][full], offsets[1:][full], sizes[full]
    out[full, 0] = (sums[last] - sums[first]) / n
    end = np.repeat(last, n)
    place = np.arange(len(ratios))
    for k, width in enumerate(windows, 1):
        stop = np.minimum(place + width, len(ratios))
        mean = np.where(place + width <= end, (sums[stop] - sums[place]) / width, -np.inf)
        out[full, k] = np.where(n < width, out[full, 0], np.maximum.reduceat(mean, first))
    return out


def _figures(model):
    def figure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held = Hashes(), model.value
        for batch in pieces(batches, "text", PIECE):
            words, before, offsets = _tokens(batch.column("text").to_pylist(), cache)
            found = text_figures(held.ratios(words, before), offsets)
            flat = pa.ListArray.from_arrays(
                pa.array(np.arange(0, found.size + 1, found.shape[1]), pa.int32()), pa.array(found.ravel())
            )
            yield pa.record_batch([*[batch.column(c) for c in batch.schema.names if c != "text"], flat], [*[c for c in batch.schema.names if c != "text"], "figures"])

    return figure


@dataclass
class ToxicityModel:
    """``model`` is None if the labels lack a class; then ``share`` is every score."""

    share: float
    model: KneserNey | None = None
    weights: tuple[float, ...] = ()
    offset: float = 0.0


def _below(salt: int, share: float, *columns: str) -> Column:
    """True for ``share`` of all ids, alike on every run."""
    return F.pmod(F.xxhash64(F.lit(salt), *columns), F.lit(1 << 40)) < int(share * (1 << 40))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES,
) -> ToxicityModel:
    """Models fitted on the labelled documents where ``learn`` (over ``labels``) holds."""
    spark = docs.sparkSession
    taught = labels if learn is None else labels.where(F.coalesce(learn, F.lit(False)))
    given = taught.select(taught[id_col].alias("id"), taught[label_col].cast("int").alias("toxic")).where("id is not null and toxic is not null")
    given = given.groupBy("id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    state = given.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    n, toxic = state["n"], state["toxic"] or 0
    share = toxic / n if n else 0.0
    if not 0 < toxic < n:
        return ToxicityModel(share)
    drawn = given.where(_below(1, max_docs / n, "id")) if n > max_docs else given
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").cast("binary").alias("text")).where("text is not null")
    sample = stored(
        texts.join(F.broadcast(drawn), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), "toxicity-sample"
    )
    size = sample.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > max_bytes:
        sample = sample.where(_below(2, max_bytes / size, "id"))
    apart = _below(3, 1 / CALIBRATE, "id")
    if not sample.where(~apart).agg(F.min("toxic") < F.max("toxic")).first()[0]:
        return ToxicityModel(share)
    model = learn_model(sample.where(~apart))
    seen = figures(sample.where(apart), model, "toxic").select("toxic", array_to_vector("figures").alias("features")).persist()
    try:
        if seen.select("toxic").distinct().count() < 2:
            return ToxicityModel(share)
        fitted = LogisticRegression(labelCol="toxic", regParam=1e-3, maxIter=100).fit(seen)
    finally:
        seen.unpersist()
    return ToxicityModel(share, model, tuple(float(x) for x in fitted.coefficients), float(fitted.intercept))


def figures(rows: DataFrame, model: KneserNey, *kept: str) -> DataFrame:
    """The kept columns and the ``figures`` of every row's ``text`` (binary)."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    slim = rows.select(*kept, "text")
    schema = ", ".join(f"`{c}` {t}" for c, t in slim.dtypes if c != "text")
    return slim.mapInArrow(_figures(sent), f"{schema}, figures array<double>")


def score_toxicity(docs: DataFrame, fitted: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rid, id, score`` of every document; the score lies between 0 and 1."""
    given = keyed(docs, id_col, text=docs[text_col].cast("string").cast("binary"))
    if fitted.model is None:
        return given.select("rid", "id", F.lit(fitted.share).alias("score"))
    found = figures(given, fitted.model, "rid", "id")
    logit = F.lit(fitted.offset)
    for k, w in enumerate(fitted.weights):
        logit = logit + F.col("figures")[k] * w
    return found.select("rid", "id", (1 / (1 + F.exp(-logit))).alias("score"))
