"""Normal and Student-t distribution as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


# Hart's rational approximation of the normal distribution (double precision), leading
# coefficient first, and the border beyond which a continued fraction is used.
HART_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
HART_BORDER, ROOT_TWO_PI = 7.07106781186547, 2.506628274631
# Acklam's rational approximation of the normal quantile, leading coefficient first.
QUANTILE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
QUANTILE_TAIL = 0.02425


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_cdf(z: Column) -> Column:
    def upper(x: Column) -> Column:
        density = F.exp(x * x / -2.0)
        near = density * _polynomial(x, HART_TOP) / _polynomial(x, HART_BOTTOM)
        far = density / (x + 1.0 / (x + 2.0 / (x + 3.0 / (x + 4.0 / (x + 0.65))))) / ROOT_TWO_PI
        return F.when(x < HART_BORDER, near).otherwise(far)

    def both(v: Column) -> Column:
        tail = _once(F.abs(v), upper)
        return F.when(F.isnan(v), F.lit(None).cast("double")).when(v > 0, 1.0 - tail).otherwise(tail)

    return _once(z.cast("double"), both)


def normal_ppf(p: Column) -> Column:
    def rough(q: Column) -> Column:
        def tail(t: Column) -> Column:
            return _once(F.sqrt(-2.0 * F.log(t)), lambda r: _polynomial(r, TAIL_TOP) / _polynomial(r, TAIL_BOTTOM))

        def middle(c: Column) -> Column:
            return _once(c * c, lambda r: _polynomial(r, QUANTILE_TOP) * c / _polynomial(r, QUANTILE_BOTTOM))

        return F.when(q < QUANTILE_TAIL, tail(q)).when(q > 1 - QUANTILE_TAIL, -tail(1.0 - q)).otherwise(_once(q - 0.5, middle))

    def refined(q: Column, x: Column) -> Column:
        # one step of Halley's method
        step = (normal_cdf(x) - q) * math.sqrt(2 * math.pi) * F.exp(x * x / 2)
        return _once(step, lambda u: x - u / (1.0 + x * u / 2.0))

    def inside(q: Column) -> Column:
        return F.when((q > 0) & (q < 1), _once(rough(q), lambda x: refined(q, x)))

    return _once(p.cast("double"), inside)


def student_cdf(t: Column, df: Column) -> Column:
    """Distribution function of Student's t with a whole number ``df`` of degrees of freedom; else null.

    With cos² = df / (df + t²) it is a finite sum of powers of cos, folded here term by term.
    """
    n = F.when((df >= 1) & (df == F.floor(df)), F.floor(df)).cast("int")
    x = t.cast("double")
    square = n / (n + x * x)
    sine = x / F.sqrt(n + x * x)
    odd = n % 2 == 1
    terms = F.floor((n - F.when(odd, 3).otherwise(2)) / 2).cast("int")
    steps = F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))

    def summed(c: Column) -> Column:
        def more(acc: Column, k: Column) -> Column:
            ratio = F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
            term = acc["term"] * ratio * c
            return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

        return F.aggregate(steps, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), more, lambda acc: acc["sum"])

    total = _once(square, summed)
    inside = F.when(n == 1, F.lit(0.0)).otherwise(F.sqrt(square) * sine * total)
    both = F.when(odd, 2 / math.pi * (F.atan(x / F.sqrt(n)) + inside)).otherwise(sine * total)
    return F.when(n.isNotNull() & x.isNotNull() & ~F.isnan(x), 0.5 + both / 2)
