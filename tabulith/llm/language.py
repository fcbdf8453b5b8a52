"""Language identification by a linear-chain conditional random field over words.

Every word (a run of letters, lower-cased) has features: character n-grams with
word borders, so that the outer ones are affixes, and the word itself as a lexicon
entry, hashed into a table of weights per language.  Learned transitions join the
labels of neighbouring words, so a text may switch languages.  Forward-backward
gives each word's label probabilities; the text's language has the largest sum, and
its score is that sum over the number of words.

The field is fitted on a bounded sample of labelled documents (``sample_docs`` per
language, expected), on their own words and on spliced, code-switched sequences.

Null texts and texts without a letter are ``und`` with score 0, and all texts are if
no label was learned.  Ties go to the first language in order.  Documents of any
length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import keyed, mix, pieces

SAMPLE_DOCS = 250
SLOTS = 1 << 16
GRAMS = (1, 2, 3, 4)
EPOCHS = 4
SEQUENCE = 48
PIECE = 1_000_000        # bytes of text a task looks at together
UNKNOWN = "und"
_RUN = re.compile(r"[^\W\d_]+")


def letter_runs(text: str | None) -> list[str]:
    if not text:
        return []
    return [w for w in _RUN.findall(text.lower()) if w.isalpha() or any(c.isalpha() for c in w)]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(slot, word number)`` of every feature of every word."""
    marked = [f"^{w}$" for w in words]
    sizes = np.array([len(m) for m in marked], np.int64)
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    place = np.arange(len(code))
    slots, owners = [], []
    for n in GRAMS:
        h = np.full(max(0, len(code) - n + 1), n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) ^ code[j : len(code) - n + 1 + j]
        inside = place[: len(h)] + n <= ends[: len(h)]
        slots.append(mix(h[inside]) % np.uint64(SLOTS))
        owners.append(owner[: len(h)][inside])
    weight = np.uint64(0x9E3779B97F4A7C15) ** (place - (ends - sizes[owner])).astype(np.uint64)
    whole = np.add.reduceat(mix(code + np.uint64(7)) * weight, np.cumsum(sizes) - sizes) if len(words) else np.empty(0, np.uint64)
    slots.append(mix(whole) % np.uint64(SLOTS))
    owners.append(np.arange(len(words)))
    return np.concatenate(slots).astype(np.int64), np.concatenate(owners)


@dataclass
class Field:
    """Weights of the field: ``table[slot, language]`` and ``moves[from, to]``."""

    languages: list[str]
    table: np.ndarray
    moves: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Score of each language for each word: the mean weight of its features."""
        if not words:
            return np.empty((0, len(self.languages)))
        slot, owner = features(words)
        count = np.bincount(owner, minlength=len(words))
        return np.stack(
            [np.bincount(owner, self.table[slot, k], len(words)) / count for k in range(len(self.languages))], axis=1
        )


def posteriors(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Label probabilities of every word; texts lie one after another in ``scores``.

    Texts go in step, longest first, so that those still running are a prefix.
    """
    order = np.argsort(-lengths, kind="stable")
    start = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    running = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right") if len(size) else np.empty(0, np.int64)
    weight = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    step = np.exp(moves - moves.max())
    out = np.empty_like(weight)
    state = None
    for t, k in enumerate(running):
        at = start[:k] + t
        state = weight[at] if t == 0 else (state[:k] @ step) * weight[at]
        state /= state.sum(axis=1, keepdims=True)
        out[at] = state
    back = step.T
    later = np.ones((len(size), weight.shape[1]))
    for t in range(len(running) - 2, -1, -1):
        k = running[t + 1]
        later[:k] = (later[:k] * weight[start[:k] + t + 1]) @ back
        later[:k] /= later[:k].sum(axis=1, keepdims=True)
        at = start[:k] + t
        out[at] *= later[:k]
    return out / out.sum(axis=1, keepdims=True) if len(out) else out


def train(samples: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = 3) -> Field:
    """A field from ``(language, text)`` by stochastic gradients of its log-likelihood."""
    languages = sorted({k for k, _ in samples})
    wide = len(languages)
    field = Field(languages, np.zeros((SLOTS, wide)), np.zeros((wide, wide)))
    number: dict[str, int] = {}
    runs: list[tuple[np.ndarray, int]] = []
    for k, text in samples:
        ids = np.array([number.setdefault(w, len(number)) for w in letter_runs(text)], np.int64)
        runs += [(ids[s : s + SEQUENCE], languages.index(k)) for s in range(0, len(ids), SEQUENCE)]
    if not runs:
        return field
    words = list(number)
    slot, owner = features(words)
    count = np.bincount(owner, minlength=len(words)).astype(np.float64)
    bounds = np.searchsorted(np.sort(owner), np.arange(len(words) + 1))
    by_word = slot[np.argsort(owner, kind="stable")]
    rng = np.random.default_rng(seed)
    past, past_moves = np.full_like(field.table, 1e-6), np.full((wide, wide), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(runs))
        sequences = []
        i = 0
        while i < len(order):
            take = int(rng.integers(1, 4))
            parts = [runs[o] for o in order[i : i + take]]
            if take > 1:
                parts = [(ids[: max(1, len(ids) // take)], k) for ids, k in parts] + [(ids[max(1, len(ids) // take) :], k) for ids, k in parts]
            sequences.append((np.concatenate([p for p, _ in parts]), np.concatenate([np.full(len(p), k) for p, k in parts])))
            i += take
        for s in range(0, len(sequences), 128):
            batch = sequences[s : s + 128]
            ids, gold = np.concatenate([b[0] for b in batch]), np.concatenate([b[1] for b in batch])
            lengths = np.array([len(b[0]) for b in batch], np.int64)
            used, at = np.unique(ids, return_inverse=True)
            span = bounds[used + 1] - bounds[used]
            rows = np.repeat(np.arange(len(used)), span)
            cells = by_word[np.repeat(bounds[used], span) + np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span)]
            score = np.stack([np.bincount(rows, field.table[cells, k], len(used)) / count[used] for k in range(wide)], axis=1)[at]
            p = posteriors(score, lengths, field.moves)
            error = -p
            error[np.arange(len(gold)), gold] += 1
            per_word = np.stack([np.bincount(at, error[:, k], len(used)) / count[used] for k in range(wide)], axis=1)
            touched, cell = np.unique(cells, return_inverse=True)
            grad = np.stack([np.bincount(cell, per_word[rows, k], len(touched)) for k in range(wide)], axis=1)
            past[touched] += grad**2
            field.table[touched] += 0.5 * grad / np.sqrt(past[touched])
            joined = np.ones(len(ids), bool)
            joined[np.cumsum(lengths) - 1] = False
            left = np.flatnonzero(joined)
            step = np.exp(field.moves)
            pair = p[left][:, :, None] * step[None] * p[left + 1][:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            seen = np.zeros((wide, wide))
            np.add.at(seen, (gold[left], gold[left + 1]), 1)
            grad = (seen - pair.sum(axis=0)) / max(1, len(left))
            past_moves += grad**2
            field.moves += 0.1 * grad / np.sqrt(past_moves)
    return field


def _predictor(field):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Field = field.value
        for batch in pieces(batches, "text", PIECE):
            docs = [letter_runs(t) for t in batch.column("text").to_pylist()]
            lengths = np.array([len(d) for d in docs], np.int64)
            number: dict[str, int] = {}
            ids = np.fromiter((number.setdefault(w, len(number)) for d in docs for w in d), np.int64, int(lengths.sum()))
            names = [UNKNOWN] * len(docs)
            share = np.zeros(len(docs))
            some = np.flatnonzero(lengths > 0)
            if held.languages and len(some):
                p = posteriors(held.emissions(list(number))[ids], lengths[some], held.moves)
                total = np.add.reduceat(p, np.cumsum(lengths[some]) - lengths[some], axis=0)
                best = total.argmax(axis=1)
                share[some] = np.clip(total[np.arange(len(some)), best] / lengths[some], 0, 1)
                for d, b in zip(some, best):
                    names[d] = held.languages[b]
            yield pa.record_batch([batch.column("rid"), batch.column("id"), pa.array(names), pa.array(share)], ["rid", "id", "lang", "score"])

    return predict


def fit_field(docs: DataFrame, learn: Column | None = None, text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Field:
    """A field from about ``sample_docs`` documents of every language where ``learn`` holds."""
    teach = docs if learn is None else docs.where(F.coalesce(learn, F.lit(False)))
    teach = teach.select(docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).where(
        "text is not null and lang is not null"
    )
    counts = {r["lang"]: r["count"] for r in teach.groupBy("lang").count().collect()}
    draw = F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1_000_000)) / 1_000_000
    chance = F.lit(0.0)
    for k, n in counts.items():
        chance = F.when(F.col("lang") == k, min(1.0, sample_docs / n)).otherwise(chance)
    rows = teach.where(draw < chance).select("lang", "text").toArrow() if counts else None
    samples = sorted(zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist())) if rows is not None else []
    return train(samples)


def predict_language(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rid, id, lang, score`` of every document."""
    given = keyed(docs, id_col, text=docs[text_col].cast("string"))
    kind = dict(given.dtypes)["id"]
    sent = docs.sparkSession.sparkContext.broadcast(field)
    return given.select("rid", "id", "text").mapInArrow(_predictor(sent), f"rid long, id {kind}, lang string, score double")


def keep_known(docs: DataFrame, field: Field, least: float = 0.35, text_col: str = "text") -> DataFrame:
    """``docs`` whose language is known with a score of ``least`` or more; same columns.

    The decision depends on the text alone, so it is made where the row is.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            asked = pa.record_batch([pa.array(range(n), pa.int64()), pa.array(range(n), pa.int64()), batch.column(names.index(text_col))], ["rid", "id", "text"])
            good = [
                k != UNKNOWN and s >= least
                for out in _predictor(sent)(iter([asked])) for k, s in zip(out.column("lang").to_pylist(), out.column("score").to_pylist())
            ]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
