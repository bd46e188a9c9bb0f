"""Bandit math as Column expressions (higher-order array functions, codegen'd JVM-side).

Matrices are row-major ``array<double>`` of d*d values, vectors ``array<double>``.
The same formulas run in numpy inside the folds (``banditflow.operators.folds``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def identity(d: int) -> Column:
    """Row-major d x d identity."""
    if d > 16:
        return F.transform(F.sequence(F.lit(0), F.lit(d * d - 1)), lambda i: F.when(i % (d + 1) == 0, 1.0).otherwise(0.0))
    return F.array(*[F.lit(1.0 if i % (d + 1) == 0 else 0.0) for i in range(d * d)])


def zeros(d: int) -> Column:
    """Zero vector."""
    if d > 256:
        return F.array_repeat(F.lit(0.0), d)
    return F.array(*[F.lit(0.0) for _ in range(d)])


def add(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Elementwise sum."""
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def sub(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def average(a: ColumnOrName, b: ColumnOrName) -> Column:
    """(a + b) / 2 elementwise."""
    return F.zip_with(_c(a), _c(b), lambda x, y: (x + y) / 2.0)


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    """M4: sum_i a_i * b_i."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def outer(x: ColumnOrName) -> Column:
    """M6: x x^T, row-major."""
    x = _c(x)
    return F.flatten(F.transform(x, lambda a: F.transform(x, lambda b: a * b)))


def matvec(m: ColumnOrName, x: ColumnOrName, d: int) -> Column:
    """M x for a row-major d x d matrix."""
    m, x = _c(m), _c(x)
    return F.array(*[dot(F.slice(m, i * d + 1, d), x) for i in range(d)])


def quad_form(x: ColumnOrName, m: ColumnOrName, d: int) -> Column:
    """x^T M x."""
    return dot(x, matvec(m, x, d))


def l2_distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    """M8: Euclidean distance."""
    sq = F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v))


def confidence_radius(t: ColumnOrName) -> Column:
    """f(t) = sqrt((1 + ln(1 + t)) / (1 + t)); decreasing in t."""
    t = _c(t).cast("double")
    return F.sqrt((F.lit(1.0) + F.log1p(t)) / (F.lit(1.0) + t))


def cluster_bound(t1: ColumnOrName, t2: ColumnOrName, alpha2: float) -> Column:
    """M1: cb(t1, t2) = alpha2 * (f(t1) + f(t2))."""
    return F.lit(alpha2) * (confidence_radius(t1) + confidence_radius(t2))


def exploration_beta(t: ColumnOrName, d: int) -> Column:
    """M2: beta = sqrt(d * ln(1 + t) * sqrt(t) + 1)."""
    t = _c(t).cast("double")
    return F.sqrt(F.lit(float(d)) * F.log1p(t) * F.sqrt(t) + F.lit(1.0))


def confidence_width(x: ColumnOrName, a_inv: ColumnOrName, t: ColumnOrName, alpha: float, d: int) -> Column:
    """M3: sqrt(t) * alpha * sqrt(beta * x^T A^-1 x); 0 at t = 0."""
    t = _c(t).cast("double")
    return F.sqrt(t) * F.lit(alpha) * F.sqrt(exploration_beta(t, d) * quad_form(x, a_inv, d))


def ucb_scores(arms: ColumnOrName, theta: ColumnOrName, a_inv: ColumnOrName, t: ColumnOrName, alpha: float, d: int) -> Column:
    """M5: x^T theta + width for every arm."""
    return F.transform(_c(arms), lambda x: dot(x, theta) + confidence_width(x, a_inv, t, alpha, d))


def argmax(scores: ColumnOrName) -> Column:
    """0-based index of the first maximum (ties -> lowest index)."""
    s = _c(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def pick(arms: ColumnOrName, choice: ColumnOrName) -> Column:
    """The chosen arm's vector (0-based choice)."""
    return F.element_at(_c(arms), _c(choice) + 1)


def pick_reward(rewards: ColumnOrName, choice: ColumnOrName) -> Column:
    """The chosen arm's reward."""
    return F.element_at(_c(rewards), _c(choice) + 1)


def match_reward(arm: ColumnOrName, label: ColumnOrName) -> Column:
    """P5: 1 when the (one-element) arm vector equals the logged label, else 0."""
    return F.when(F.element_at(_c(arm), 1) == _c(label), F.lit(1.0)).otherwise(F.lit(0.0))


def buffer_threshold(t: ColumnOrName) -> Column:
    """M9: 4 * ln(max(t, 1))."""
    return F.lit(4.0) * F.log(F.greatest(_c(t).cast("double"), F.lit(1.0)))


def fifo_push(buf: ColumnOrName, element: ColumnOrName) -> Column:
    """Append a block at the back."""
    return F.concat(_c(buf), F.array(_c(element)))


def fifo_peek(buf: ColumnOrName) -> Column:
    """The oldest block (NULL when empty)."""
    return F.try_element_at(_c(buf), F.lit(1))


def fifo_pop(buf: ColumnOrName) -> Column:
    """Drop the oldest block (no-op when empty)."""
    return F.filter(_c(buf), lambda e, i: i > 0)


def round_array(a: ColumnOrName, digits: int = 6) -> Column:
    return F.transform(_c(a), lambda x: F.round(x, digits))
