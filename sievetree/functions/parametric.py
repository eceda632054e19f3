"""Densities, modes and draws of the parametric leaves, as expressions over the parameters that leaves.fit gives."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TRIES = 8
FAMILIES = ("gaussian", "exponential", "uniform", "lognormal", "poisson", "geometric", "bernoulli", "gamma")


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: moved up by 8 with the recurrence, then Stirling's series."""
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0)))
    below = F.log(x)
    for k in range(1, 8):
        below = below + F.log(x + k)
    return series - below


def density(family: str, x: Column) -> Column:
    """The density, or the probability for a family of whole numbers, at x; 0 outside the support, 1 for NULL (summed out). The row must have the columns of leaves.fit."""
    x = x.cast("double")
    p = lambda name: F.col(f"{family}_{name}")
    whole = x == F.floor(x)
    if family == "gaussian":
        z = (x - p("mean")) / p("stdev")
        out = F.exp(-z * z / 2) / (p("stdev") * math.sqrt(2 * math.pi))
    elif family == "exponential":
        out = F.when(x >= 0, F.exp(-x / p("mean")) / p("mean")).otherwise(0.0)
    elif family == "uniform":
        out = F.when((x >= p("start")) & (x <= p("end")), p("density")).otherwise(0.0)
    elif family == "lognormal":
        z = (F.log(x) - p("mean")) / p("stdev")
        out = F.when(x > 0, F.exp(-z * z / 2) / (x * p("stdev") * math.sqrt(2 * math.pi))).otherwise(0.0)
    elif family == "poisson":
        out = F.when(whole & (x >= 0), F.exp(x * F.log(p("mean")) - p("mean") - log_gamma(x + 1))).otherwise(0.0)
    elif family == "geometric":
        out = F.when(whole & (x >= 1), F.pow(1 - p("p"), x - 1) * p("p")).otherwise(0.0)
    elif family == "bernoulli":
        out = F.when(x == 1, p("p")).when(x == 0, 1 - p("p")).otherwise(0.0)
    elif family == "gamma":
        a, b = p("alpha"), p("beta")
        out = F.when(x > 0, F.exp(a * F.log(b) + (a - 1) * F.log(x) - b * x - log_gamma(a))).otherwise(0.0)
    else:
        raise ValueError(f"no family {family}")
    return F.when(x.isNull(), 1.0).otherwise(out)


def mode(family: str) -> Column:
    """Where the density is highest; the smallest place of equals."""
    p = lambda name: F.col(f"{family}_{name}")
    if family == "gaussian":
        return p("mean")
    if family == "exponential":
        return F.lit(0.0)
    if family == "uniform":
        return p("start")
    if family == "lognormal":
        return F.exp(p("mean") - p("stdev") * p("stdev"))
    if family == "poisson":
        return F.greatest(F.ceil(p("mean")) - 1, F.lit(0)).cast("double")
    if family == "geometric":
        return F.lit(1.0)
    if family == "bernoulli":
        return F.when(p("p") > 0.5, 1.0).otherwise(0.0)
    if family == "gamma":
        return F.greatest((p("alpha") - 1) / p("beta"), F.lit(0.0))
    raise ValueError(f"no family {family}")


def draw(family: str, seed: int = 0) -> Column:
    """A draw for each row: by inverting the distribution where the inverse is an expression; a Poisson draw counts up to the random share, over at most mean + 12 deviations + 30; a gamma draw is the first of `_TRIES` cubed normal proposals that is accepted, each with a chance over 0.95."""
    p = lambda name: F.col(f"{family}_{name}")
    u = 1 - F.rand(seed)
    if family == "gaussian":
        return p("mean") + p("stdev") * F.randn(seed)
    if family == "lognormal":
        return F.exp(p("mean") + p("stdev") * F.randn(seed))
    if family == "exponential":
        return -p("mean") * F.log(u)
    if family == "uniform":
        return p("start") + (p("end") - p("start")) * F.rand(seed)
    if family == "geometric":
        return F.greatest(F.ceil(F.log(u) / F.log(1 - p("p"))), F.lit(1)).cast("double")
    if family == "bernoulli":
        return F.when(F.rand(seed) < p("p"), 1.0).otherwise(0.0)
    if family == "poisson":
        mean = p("mean")
        top = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
        # The random share is part of the start, as one inside the steps would be drawn anew at each.
        start = F.struct(u.alias("u"), F.exp(-mean).alias("term"), F.exp(-mean).alias("cdf"), F.lit(0).alias("k"))

        def step(acc: Column, i: Column) -> Column:
            term = acc["term"] * mean / i
            return F.struct(acc["u"].alias("u"), term.alias("term"), (acc["cdf"] + term).alias("cdf"), F.when(acc["cdf"] < acc["u"], i).otherwise(acc["k"]).alias("k"))

        return F.aggregate(F.sequence(F.lit(1), top), start, step)["k"].cast("double")
    if family == "gamma":
        # The squeeze needs a shape of at least 1; a smaller one is drawn one higher and scaled by a power of a uniform number.
        shape = F.when(p("alpha") < 1, p("alpha") + 1).otherwise(p("alpha"))
        d = shape - 1.0 / 3
        c = 1 / F.sqrt(9 * d)
        cubed = lambda x: F.pow(1 + c * x, F.lit(3.0))
        tries = F.array(*[F.struct(F.randn(seed + 1000 + i).alias("x"), F.rand(seed + 2000 + i).alias("w")) for i in range(_TRIES)])

        def accepted(t: Column) -> Column:
            v = cubed(t["x"])
            return (v > 0) & (F.log(1 - t["w"]) < t["x"] * t["x"] / 2 + d - d * v + d * F.log(F.greatest(v, F.lit(5e-324))))

        drawn = d * cubed(F.coalesce(F.get(F.filter(tries, accepted), 0)["x"], F.lit(0.0)))
        return F.when(p("alpha") < 1, drawn * F.pow(u, 1 / p("alpha"))).otherwise(drawn) / p("beta")
    raise ValueError(f"no draw for {family}")
