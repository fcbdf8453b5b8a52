"""Scalar expressions: impurity, softmax, formatting, chi-square tail."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _balanced(terms: Sequence[Column]) -> Column:
    """Sum of columns as a balanced tree, so long sums do not nest deeply."""
    terms = list(terms)
    while len(terms) > 1:
        terms = [
            terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i]
            for i in range(0, len(terms), 2)
        ]
    return terms[0]


def sum_text(terms: Sequence[str]) -> str:
    """Balanced SQL text of a sum; parsed once instead of built call by call."""
    terms = list(terms)
    while len(terms) > 1:
        terms = [
            f"({terms[i]} + {terms[i + 1]})" if i + 1 < len(terms) else terms[i]
            for i in range(0, len(terms), 2)
        ]
    return terms[0]


def number(value: float) -> str:
    """A double as SQL text that reads back to the same bits."""
    value = float(value)
    if math.isinf(value):
        return "double('-Infinity')" if value < 0 else "double('Infinity')"
    if math.isnan(value):
        return "double('NaN')"
    return f"{value!r}D" if "e" not in repr(value) else f"double('{value!r}')"


def entropy(counts: Sequence[Column]) -> Column:
    """Shannon entropy in bits of class counts; empty classes add nothing."""
    total = _balanced(counts)
    return _balanced(
        [
            F.when((total > 0) & (c > 0), -(c / total) * F.log2(c / total)).otherwise(F.lit(0.0))
            for c in counts
        ]
    )


def gini(counts: Sequence[Column]) -> Column:
    """Gini impurity of class counts."""
    total = _balanced(counts)
    squares = _balanced([(c / total) * (c / total) for c in counts])
    return F.when(total > 0, F.lit(1.0) - squares).otherwise(F.lit(0.0))


def impurity(counts: Sequence[Column], criterion: str) -> Column:
    if criterion == "gini":
        return gini(counts)
    if criterion == "entropy":
        return entropy(counts)
    raise ValueError(f"criterion must be 'gini' or 'entropy', got {criterion!r}.")


def softmax(scores: str | Column) -> Column:
    """Shifted softmax of an array of log scores."""
    scores = F.col(scores) if isinstance(scores, str) else scores
    shifted = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(shifted, lambda x: x / total)


def argmax_index(scores: str | Column) -> Column:
    """0-based position of the first maximum."""
    scores = F.col(scores) if isinstance(scores, str) else scores
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def format_metric(value: str | Column) -> Column:
    """Integer values without decimals, others with four, null as a dash."""
    value = F.col(value) if isinstance(value, str) else value
    return (
        F.when(value.isNull(), F.lit("—"))
        .when(value == F.floor(value), F.format_string("%.0f", value))
        .otherwise(F.format_string("%.4f", value))
    )


# --- chi-square tail -------------------------------------------------------

def log_chi2_tail(statistic: float, dof: int) -> float:
    """log P(X > statistic) for a chi-square variable, good in the deep tail."""
    if dof <= 0 or statistic <= 0:
        return 0.0
    a, x = dof / 2.0, statistic / 2.0
    front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        for _ in range(2000):
            n += 1.0
            term *= x / n
            total += term
            if term < total * 1e-17:
                break
        lower = math.exp(front + math.log(total))
        return math.log1p(-lower) if lower < 1.0 else -math.inf
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 5000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-16:
            break
    return front + math.log(h)


def chi2_tail(statistic: float, dof: int) -> float:
    """P-value of a chi-square statistic."""
    return math.exp(log_chi2_tail(statistic, dof))


def chi_square(table: np.ndarray) -> tuple[float, int, float]:
    """Statistic, degrees of freedom and log p-value of a contingency table."""
    seen = np.asarray(table, dtype=float)
    seen = seen[seen.any(axis=1)][:, seen.any(axis=0)]
    if not seen.size:
        return 0.0, 0, 0.0
    n = seen.sum()
    share_of_row = seen / seen.sum(axis=1, keepdims=True)
    share_of_column = seen / seen.sum(axis=0)
    statistic = max(0.0, float(n * ((share_of_row * share_of_column).sum() - 1)))
    dof = (seen.shape[0] - 1) * (seen.shape[1] - 1)
    return statistic, dof, log_chi2_tail(statistic, dof) if dof else 0.0
