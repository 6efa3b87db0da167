"""Losses of linear machines: derivative, conjugate and dual step, as column expressions.

inner is the score of a row, label its target; for hinge, hinge2 and logistic it is 1 or -1. The
dual step of a row with dual value alpha and norm2 = |x|^2 / (lambda n) is the change of alpha that
maximises the dual objective. A conjugate is infinite outside of its domain.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOSSES = ("hinge", "hinge2", "l1", "l2", "logistic")
INFINITE = float("inf")
#: Halvings of the interval in which the logistic dual step is looked for.
HALVINGS = 40


def _x_log_x(x: Column) -> Column:
    return F.when(x <= 1e-10, 0.0).otherwise(x * F.log(x))


def loss(name: str, inner: Column, label: Column) -> Column:
    short, off = F.greatest(F.lit(0.0), 1 - label * inner), label - inner
    m = label * inner
    return {"hinge": short, "hinge2": short * short, "l1": F.abs(off), "l2": off * off, "logistic": F.log1p(F.exp(-F.abs(m))) + F.greatest(-m, F.lit(0.0))}[name]


def derivative(name: str, inner: Column, label: Column) -> Column:
    """Of the loss by inner."""
    inside = label * inner < 1
    return {
        "hinge": F.when(inside, -label).otherwise(0.0),
        "hinge2": F.when(inside, 2 * (inner - label)).otherwise(0.0),
        "l1": F.when(label > inner, -1.0).otherwise(1.0),
        "l2": 2 * (inner - label),
        "logistic": -label / (1 + F.exp(label * inner)),
    }[name].cast("double")


def conjugate(name: str, u: Column, label: Column) -> Column:
    z = label * u
    full = (label + u / 4) * u
    inf = F.lit(INFINITE)
    return {
        "hinge": F.when((z >= -1) & (z <= 0), z).otherwise(inf),
        "hinge2": F.when(z <= 0, full).otherwise(inf),
        "l1": F.when(F.abs(u) <= 1, z).otherwise(inf),
        "l2": full,
        "logistic": F.when((z >= -1) & (z <= 0), _x_log_x(1 + z) + _x_log_x(-z)).otherwise(inf),
    }[name].cast("double")


def dual_step(name: str, alpha: Column, inner: Column, norm2: Column, label: Column) -> Column:
    full = (label - inner) / norm2 + alpha
    soft = (label - inner - alpha / 2) / (norm2 + 0.5)
    between = lambda x, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), x))
    if name == "logistic":
        # the optimum a = label * (alpha + step) in (0, 1) is where this falling function is 0
        slope = lambda a: -F.log(a / (1 - a)) - label * inner - norm2 * (a - label * alpha)

        def halve(s, _):
            mid = (s["lo"] + s["hi"]) / 2
            up = slope(mid) > 0
            return F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi"))

        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
        best = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
        return label * best - alpha
    return {
        "hinge": label * between(label * full, 0.0, 1.0) - alpha,
        "hinge2": label * F.greatest(F.lit(0.0), label * (soft + alpha)) - alpha,
        "l1": F.when(F.abs(alpha) <= 1, between(full, -1.0, 1.0) - alpha).otherwise(F.lit(INFINITE)),
        "l2": soft,
    }[name].cast("double")
