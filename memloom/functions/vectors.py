"""Vector functions: Column to Column, in double precision, without Python on the executors unless a generator's draws are asked for."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """A zero vector counts as norm 1 and so scores 0."""
    unit = lambda v: F.when(norm(v) == 0, F.lit(1.0)).otherwise(norm(v))
    return dot(a, b) / (unit(a) * unit(b))


def unit(a: Column) -> Column:
    """Of length 1; a zero vector stays."""
    # an array of one, so that the norm is taken once and not again for each number
    both = F.array(F.struct(a.alias("a"), norm(a).alias("n")))
    return F.flatten(F.transform(both, lambda b: F.transform(b["a"], lambda x: x.cast("double") / F.when(b["n"] == 0, F.lit(1.0)).otherwise(b["n"]))))


def is_finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def average(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x.cast("double") + y.cast("double")) / 2)


def average_n(vs: Column) -> Column:
    n = F.size(vs)
    return F.transform(vs[0], lambda _, i: F.aggregate(vs, F.lit(0.0), lambda s, v: s + F.get(v, i).cast("double")) / n)


def weighted(a: Column, b: Column, alpha: float = 0.5) -> Column:
    return F.zip_with(a, b, lambda x, y: F.lit(alpha) * x.cast("double") + F.lit(1 - alpha) * y.cast("double"))


def single_point(a: Column, b: Column, point: int) -> Column:
    return F.concat(F.slice(_doubles(a), 1, point), F.slice(_doubles(b), point + 1, F.greatest(F.size(b) - point, F.lit(0))))


def multi_point(a: Column, b: Column, points: list[int]) -> Column:
    """Takes turns at each cut: before the first from ``a``; no cuts give ``a``."""
    cuts = sorted(points)
    turn = lambda i: sum((F.when(i >= p, 1).otherwise(0) for p in cuts), F.lit(0)) % 2
    return F.transform(a, lambda x, i: F.when(turn(i) == 0, x).otherwise(F.get(b, i)).cast("double"))


def uniform(a: Column, b: Column, mask: list[bool]) -> Column:
    """True takes from ``a``. ``uniform_mask`` makes the mask of a seed."""
    keep = F.array(*[F.lit(bool(m)) for m in mask])
    return F.transform(a, lambda x, i: F.when(F.get(keep, i), x).otherwise(F.get(b, i)).cast("double"))


def uniform_mask(dim: int, seed: int = 42) -> list[bool]:
    return (np.random.default_rng(seed).random(dim) < 0.5).tolist()


def uniform_n(vs: Column, choice: list[int]) -> Column:
    pick = F.array(*[F.lit(int(c)) for c in choice])
    return F.transform(vs[0], lambda _, i: F.get(F.get(vs, F.get(pick, i)), i).cast("double"))


def uniform_choice(parents: int, dim: int, seed: int = 42) -> list[int]:
    return np.random.default_rng(seed).integers(0, parents, dim).tolist()


def single_point_owner(parents: int, dim: int, seed: int = 42) -> list[int]:
    """Of each place the parent that a fold of single-point crossovers takes it from: each step draws a seed, and with it its own cut."""
    rng, owner = np.random.default_rng(seed), np.zeros(dim, dtype=np.int64)
    for parent in range(1, parents):
        cut = int(np.random.default_rng(int(rng.integers(0, 2**31 - 1))).integers(0, dim + 1))
        owner[cut:] = parent
    return owner.tolist()


def frequency(a: Column, b: Column) -> Column:
    """The larger magnitude; on ties the earlier parent."""
    return F.zip_with(a, b, lambda x, y: F.when(F.abs(x) >= F.abs(y), x).otherwise(y).cast("double"))


def frequency_n(vs: Column) -> Column:
    best = lambda i: F.aggregate(vs, F.get(vs[0], i).cast("double"), lambda m, v: F.when(F.abs(F.get(v, i)) > F.abs(m), F.get(v, i).cast("double")).otherwise(m))
    return F.transform(vs[0], lambda _, i: best(i))


def attention(a: Column, b: Column, temperature: float = 1.0) -> Column:
    """Softmax over the magnitudes, each divided by the temperature (1e-12 at least)."""
    t = max(temperature, 1e-12)

    def mix(x: Column, y: Column) -> Column:
        x, y = x.cast("double"), y.cast("double")
        p, q = F.abs(x) / t, F.abs(y) / t
        top = F.greatest(p, q)
        u, v = F.exp(p - top), F.exp(q - top)
        return (u * x + v * y) / (u + v)

    return F.zip_with(a, b, mix)


def attention_n(vs: Column, temperature: float = 1.0) -> Column:
    t = max(temperature, 1e-12)

    def at(i: Column) -> Column:
        xs = F.transform(vs, lambda v: F.get(v, i).cast("double"))
        top = F.array_max(F.transform(xs, lambda x: F.abs(x) / t))
        weights = F.transform(xs, lambda x: F.exp(F.abs(x) / t - top))
        return dot(weights, xs) / total(weights)

    return F.transform(vs[0], lambda _, i: at(i))


def projection(dim: int, seed: int = 42) -> np.ndarray:
    """A Gaussian 2*dim x dim matrix with unit columns."""
    m = np.random.default_rng(seed).standard_normal((2 * dim, dim))
    return m / np.linalg.norm(m, axis=0)


def concat_project(a: Column, b: Column, dim: int, seed: int = 42) -> Column:
    """Both parents in a row, through the fixed projection of the seed."""
    columns = F.array(*[F.array(*[F.lit(float(x)) for x in col]) for col in projection(dim, seed).T])
    both = F.concat(_doubles(a), _doubles(b))
    return F.transform(columns, lambda c: dot(both, c))


def noise(dim: int, sigma: float = 0.01, seed: int = 42) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, sigma, dim)


def mutated(v: Column, dim: int, sigma: float = 0.01, seed: int = 42) -> Column:
    drawn = F.array(*[F.lit(float(x)) for x in noise(dim, sigma, seed)])
    return F.zip_with(v, drawn, lambda x, n: x.cast("double") + n)


def rounded(v: Column, places: int = 6) -> Column:
    """As one string of fixed-point numbers, so that arrays can be compared by value."""
    return F.array_join(F.transform(v, lambda x: F.format_string("%." + str(places) + "f", F.round(x, places) + F.lit(0.0))), ",")


#: Two-parent operators by name; each takes (a, b, dim).
PAIRS: dict[str, Callable[[Column, Column, int], Column]] = {
    "simple_average": lambda a, b, dim: average(a, b),
    "weighted_sum": lambda a, b, dim: weighted(a, b, 0.5),
    "concat_project": lambda a, b, dim: concat_project(a, b, dim, 42),
    "single_point_crossover": lambda a, b, dim: single_point(a, b, int(np.random.default_rng(42).integers(1, max(2, dim)))),
    "uniform_crossover": lambda a, b, dim: uniform(a, b, uniform_mask(dim, 42)),
    "frequency_crossover": lambda a, b, dim: frequency(a, b),
    "attention_weighted_crossover": lambda a, b, dim: attention(a, b),
    "uniform_crossover_with_mutation": lambda a, b, dim: mutated(uniform(a, b, uniform_mask(dim, 42)), dim, 0.01, 43),
    "multi_point_crossover": lambda a, b, dim: multi_point(a, b, sorted(np.random.default_rng(42).choice(np.arange(1, dim), size=min(2, dim - 1), replace=False).tolist())),
}
#: N-parent operators by name; each takes (array of vectors, parents, dim).
MANY: dict[str, Callable[[Column, int, int], Column]] = {
    "average": lambda vs, n, dim: average_n(vs),
    "uniform": lambda vs, n, dim: uniform_n(vs, uniform_choice(n, dim)),
    "single_point": lambda vs, n, dim: uniform_n(vs, single_point_owner(n, dim)),
    "frequency": lambda vs, n, dim: frequency_n(vs),
    "attention": lambda vs, n, dim: attention_n(vs),
    "gaussian_mutation": lambda vs, n, dim: mutated(average_n(vs), dim),
    "uniform_with_mutation": lambda vs, n, dim: mutated(uniform_n(vs, uniform_choice(n, dim)), dim, 0.01, 43),
}


def recombine(name: str, a: Column, b: Column, dim: int) -> Column:
    if name not in PAIRS:
        raise ValueError(f"unknown operator {name!r}; known: {', '.join(sorted(PAIRS))}")
    return F.when(F.size(a) == F.size(b), PAIRS[name](a, b, dim)).otherwise(F.raise_error(F.lit("parents differ in length")))


def synthesize(name: str, vs: Column, parents: int, dim: int) -> Column:
    if name not in MANY:
        raise ValueError(f"unknown operator {name!r}; known: {', '.join(sorted(MANY))}")
    return MANY[name](vs, parents, dim)
