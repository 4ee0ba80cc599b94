"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def logistic(x: Column) -> Column:
    """1 / (1 + exp(-x)), saturating beyond 35 on either side."""
    return F.when(x > 35, F.lit(1.0)).when(x < -35, F.lit(0.0)).otherwise(1.0 / (1.0 + F.exp(-x)))


def log1p_exp(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def logit(p: Column) -> Column:
    return F.log(p) - F.log1p(-p)


def normal_cdf(x: Column) -> Column:
    """Standard normal CDF, clipped to [1e-12, 1 - 1e-12].

    Within 8 of zero the series sum x^(2k+1)/(2k+1)!! times the density, which
    has no cancellation; beyond it the clip rules.
    """
    a = F.least(F.abs(x), F.lit(8.0))
    state = F.struct(a.alias("term"), a.alias("total"))
    step = lambda s, k: F.struct(
        (s["term"] * a * a / (2 * k + 1)).alias("term"), (s["total"] + s["term"] * a * a / (2 * k + 1)).alias("total")
    )
    series = F.aggregate(F.sequence(F.lit(1), F.lit(120)), state, step, lambda s: s["total"])
    upper = 0.5 + series * F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    p = F.when(x >= 0, upper).otherwise(1 - upper)
    return F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))


#: Numerators and denominators of the normal quantile's rational approximation (Wichura's, 16 digits), constant term first.
CENTRAL = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
NEAR = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _ratio(table: tuple, x: Column) -> Column:
    out = []
    for terms in table:
        total = F.lit(terms[-1])
        for t in reversed(terms[:-1]):
            total = total * x + F.lit(t)
        out.append(total)
    return out[0] / out[1]


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile of p, clipped to [1e-12, 1 - 1e-12] first."""
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    q = p - 0.5
    tail = F.sqrt(-F.log(F.least(p, 1 - p)))
    outer = F.when(tail <= 5.0, _ratio(NEAR, tail - 1.6)).otherwise(_ratio(FAR, tail - 5.0))
    return F.when(F.abs(q) <= 0.425, q * _ratio(CENTRAL, 0.180625 - q * q)).otherwise(F.signum(q) * outer)


def stick_probabilities(etas: list[Column]) -> list[Column]:
    """Probit sticks: P(k) = prod of earlier Phi(eta), times 1 - Phi(eta_k); the last is the rest."""
    out, left = [], F.lit(1.0)
    for eta in etas:
        p = normal_cdf(eta)
        out.append(left * (1 - p))
        left = left * p
    return [*out, left]


def log_bayes_factor(score: Column, info: Column, variance: Column, residual: Column) -> Column:
    """Spike against N(0, variance) slab at score s and information l."""
    total = residual + info * variance
    return 0.5 * F.log(residual / total) + 0.5 * score * score * variance / (residual * total)


def quantile_type8(sorted_values: Column, p: float) -> Column:
    """Quantile of a sorted array at h = (n + 1/3) p + 1/3, clamped to its ends."""
    n = F.size(sorted_values)
    h = (n + 1.0 / 3.0) * p + 1.0 / 3.0
    j = F.least(F.greatest(F.floor(h), F.lit(1)), n).cast("int")
    k = F.least(j + 1, n)
    low, high = F.element_at(sorted_values, j), F.element_at(sorted_values, k)
    share = F.least(F.greatest(h - j, F.lit(0.0)), F.lit(1.0))
    return F.when(n > 0, low + share * (high - low))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series after a shift by ten."""
    y = x + 10
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0))) + 1 / (1188 * F.pow(y, F.lit(9.0)))
    shift = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda s, k: s + F.log(x + k))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function by its continued fraction, from the end where that converges fast.

    The number of terms grows with the square root of the larger parameter.
    """
    a, b, x = (c.cast("double") for c in (a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b), F.when(swap, 1 - x).otherwise(x)
    terms = (F.lit(100) + 10 * F.sqrt(F.greatest(a, b))).cast("int")
    tiny = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)

    def step(s: Column, m: Column) -> Column:
        p, q, z = s["p"], s["q"], s["z"]
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        up = F.struct((1 / tiny(1 + even * s["d"])).alias("d"), tiny(1 + even / s["c"]).alias("c"))
        # A lambda's own values are bound once through one-element arrays, so terms do not double.
        both = F.transform(F.array(up), lambda u: F.struct((1 / tiny(1 + odd * u["d"])).alias("d"), tiny(1 + odd / u["c"]).alias("c"), (u["d"] * u["c"]).alias("f")))[0]
        return F.transform(F.array(both), lambda v: F.struct(p.alias("p"), q.alias("q"), z.alias("z"), v["c"].alias("c"), v["d"].alias("d"), (s["h"] * v["f"] * v["c"] * v["d"]).alias("h")))[0]

    first = 1 / tiny(1 - (p + q) * z / (p + 1))
    start = F.struct(p.alias("p"), q.alias("q"), z.alias("z"), F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    fraction = F.aggregate(F.sequence(F.lit(1), terms), start, step, lambda s: s["h"])
    front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(z) + q * F.log1p(-z))
    inside = F.when(z <= 0, 0.0).otherwise(front * fraction / p)
    return F.when(swap, 1 - inside).otherwise(inside)


def student_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t with ``df`` degrees of freedom."""
    return incomplete_beta(df / 2.0, F.lit(0.5), df / (df + t * t))
