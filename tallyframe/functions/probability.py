"""Functions of probability arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.text import let


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def softmax(z: Column, temperature: Column | float = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    # Maximum and sum are worked out once an array, not once an element.
    raised = let(z, lambda y: let(F.array_max(y), lambda most: F.transform(y, lambda x: F.exp((x - most) / t))))
    return let(raised, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def normalized(p: Column) -> Column:
    """Negatives clipped; without mass uniform."""
    clipped = F.transform(p, lambda x: F.greatest(x, F.lit(0.0)))
    return F.transform(clipped, lambda x: F.when(total(clipped) > 0, x / total(clipped)).otherwise(F.lit(1.0) / F.size(p)))


def argmax(p: Column) -> Column:
    """Index from 0 of the first largest."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def margin(p: Column) -> Column:
    top = F.sort_array(p, asc=False)
    return F.element_at(top, 1) - F.coalesce(F.try_element_at(top, F.lit(2)), F.lit(0.0))


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)))


def one_hot(index: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def brier(p: Column, target: Column) -> Column:
    return total(F.zip_with(p, target, lambda a, b: (a - b) * (a - b)))


def tvd(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda a, b: F.abs(a - b))) / 2


def nll(p: Column, epsilon: float = 1e-12) -> Column:
    return -F.log(p + epsilon)


def sharpened(p: Column, tau: Column) -> Column:
    """p to the power 1/tau, normalised."""
    powers = F.transform(p, lambda x: F.exp(F.log(F.greatest(x, F.lit(1e-12))) / tau))
    return let(powers, lambda e: F.transform(e, lambda x: x / total(e)))


def expected_value(p: Column, levels: Column) -> Column:
    return total(F.zip_with(p, levels, lambda a, b: a * b))


def band_levels(low: float, high: float, steps: int) -> Column:
    return F.array(*[F.lit(low + (high - low) * k / (steps - 1)) for k in range(steps)])


def bin_floor(conf: Column, bins: int = 10) -> Column:
    """Bin by floor(conf * bins), the last closed above."""
    return F.least(F.lit(bins - 1), F.floor(conf * bins).cast("int"))


def _edges(bins: int) -> list[float]:
    return [k * (1.0 / bins) if k < bins else 1.0 for k in range(bins + 1)]


def bin_right_closed(conf: Column, bins: int = 10) -> Column:
    """Bins (lo, hi], the first closed below, by comparison with the edges themselves."""
    return F.least(F.lit(bins - 1), reduce(lambda a, b: a + b, [(conf > F.lit(e)).cast("int") for e in _edges(bins)[1:bins]]))


def bin_left_closed(conf: Column, bins: int = 10) -> Column:
    """Bins [lo, hi), the last closed above, by comparison with the edges themselves."""
    return reduce(lambda a, b: a + b, [(conf >= F.lit(e)).cast("int") for e in _edges(bins)[1:bins]])


def wilson_lower(successes: Column, runs: Column, z: float) -> Column:
    p, n = successes / runs, runs
    middle = p + z * z / (2 * n)
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, F.greatest(F.lit(0.0), (middle - spread) / (1 + z * z / n))).otherwise(0.0)
