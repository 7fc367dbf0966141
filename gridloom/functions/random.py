"""Reproducible draws: the counter-based generator Philox 4x32 with ten rounds, and six distributions.

A draw is addressed by seed, input index, scenario, draw and attempt, so a scenario alone gives the same values as in a
sweep. There are two forms: Spark columns, and numpy arrays for kernels; they agree bit for bit on the uniform draws.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The generator's multipliers and key increments, and the last counter word of this engine's draws.
MULTIPLIERS = (0xD2511F53, 0xCD9E8D57)
INCREMENTS = (0x9E3779B9, 0xBB67AE85)
TAG, ROUNDS, WORD = 0x5EED5EED, 10, 0xFFFFFFFF

#: Wichura's algorithm AS 241 for the inverse normal distribution, ascending powers: near the middle, in the
#: tails, far out; numerator and denominator of each.
AS241 = (
    ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
     (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)),
    ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
     (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)),
    ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
     (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)),
)
MIDDLE, SQUARE, NEAR, STEP = 0.425, 0.180625, 5.0, 1.6


def horner(coefficients, x):
    out = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


# --- numpy


def philox(counter: list[np.ndarray], seed: int) -> list[np.ndarray]:
    """Four words of 32 bits for counters of four words (arrays of uint64)."""
    a, b, c, d = (np.asarray(x, np.uint64) & np.uint64(WORD) for x in counter)
    low, high = seed & WORD, seed >> 32 & WORD
    for _ in range(ROUNDS):
        p, q = a * np.uint64(MULTIPLIERS[0]), c * np.uint64(MULTIPLIERS[1])
        a, b, c, d = (q >> np.uint64(32)) ^ b ^ np.uint64(low), q & np.uint64(WORD), (p >> np.uint64(32)) ^ d ^ np.uint64(high), p & np.uint64(WORD)
        low, high = (low + INCREMENTS[0]) & WORD, (high + INCREMENTS[1]) & WORD
    return [a, b, c, d]


def uniforms(seed: int, index: int, scenario: np.ndarray, draw: int = 0, attempt=0) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers between 0 and 1, neither included, for each scenario."""
    k = np.asarray(scenario, np.uint64)
    third = np.uint64(draw << 16) | np.asarray(attempt, np.uint64)
    w = philox([np.full_like(k, index), k, np.broadcast_to(third, k.shape), np.full_like(k, TAG)], seed)
    mask = np.uint64((1 << 53) - 1)
    return tuple((((x << np.uint64(21)) ^ y) & mask).astype(np.float64) * 2.0**-53 + 2.0**-54 for x, y in ((w[0], w[1]), (w[2], w[3])))


def inverse_normal(p: np.ndarray) -> np.ndarray:
    q = np.asarray(p, float) - 0.5
    r = SQUARE - q * q
    middle = q * horner(AS241[0][0], r) / horner(AS241[0][1], r)
    tail = np.sqrt(-np.log(np.where(q < 0, p, 1 - np.asarray(p, float))))
    near, far = tail - STEP, tail - NEAR
    x = np.where(tail <= NEAR, horner(AS241[1][0], near) / horner(AS241[1][1], near), horner(AS241[2][0], far) / horner(AS241[2][1], far))
    return np.where(np.abs(q) <= MIDDLE, middle, np.where(q < 0, -x, x))


def gamma(shape: float, seed: int, index: int, scenario: np.ndarray, draw: int) -> np.ndarray:
    """Marsaglia and Tsang's method; rejected scenarios try again on the attempt axis."""
    d = (shape + 1 if shape < 1 else shape) - 1 / 3
    c = 1 / math.sqrt(9 * d)
    scenario = np.asarray(scenario)
    out, left, tries = np.zeros(len(scenario)), np.arange(len(scenario)), np.zeros(len(scenario), np.int64)
    for attempt in range(0x7FFF):
        if not len(left):
            break
        u, w = uniforms(seed, index, scenario[left], draw, attempt)
        x = inverse_normal(u)
        v = 1 + c * x
        cube = np.where(v > 0, v, 1.0) ** 3
        ok = (v > 0) & (np.log(w) < 0.5 * x * x + d - d * cube + d * np.log(cube))
        out[left[ok]], tries[left[ok]] = d * cube[ok], attempt
        left = left[~ok]
    if shape < 1:
        boost, _ = uniforms(seed, index, scenario, draw, tries | 0x8000)
        out *= boost ** (1 / shape)
    return out


@dataclass(frozen=True)
class Distribution:
    """kind: point, normal, lognormal, uniform, triangular or pert, and its parameters."""

    kind: str
    p: tuple[float, ...]

    def mean(self) -> float:
        p = self.p
        return {
            "point": lambda: p[0], "normal": lambda: p[0], "lognormal": lambda: math.exp(p[0] + p[1] ** 2 / 2), "uniform": lambda: (p[0] + p[1]) / 2,
            "triangular": lambda: sum(p) / 3, "pert": lambda: (p[0] + 4 * p[1] + p[2]) / 6,
        }[self.kind]()

    def variance(self) -> float:
        p = self.p
        if self.kind == "triangular":
            a, m, b = p
            return (a * a + m * m + b * b - a * m - a * b - m * b) / 18
        if self.kind == "pert":
            mean = self.mean()
            return (mean - p[0]) * (p[2] - mean) / 7
        return {"point": lambda: 0.0, "normal": lambda: p[1] ** 2, "lognormal": lambda: (math.exp(p[1] ** 2) - 1) * math.exp(2 * p[0] + p[1] ** 2), "uniform": lambda: (p[1] - p[0]) ** 2 / 12}[self.kind]()

    def sample(self, seed: int, index: int, scenario: np.ndarray) -> np.ndarray:
        p = self.p
        if self.kind == "point":
            return np.full(len(scenario), p[0])
        if self.kind == "pert":
            a, m, b = p
            x = gamma(1 + 4 * (m - a) / (b - a), seed, index, scenario, 0)
            y = gamma(1 + 4 * (b - m) / (b - a), seed, index, scenario, 1)
            return a + (b - a) * (x / (x + y))
        u, _ = uniforms(seed, index, scenario)
        if self.kind == "uniform":
            return p[0] + (p[1] - p[0]) * u
        if self.kind == "triangular":
            a, m, b = p
            return np.where(u < (m - a) / (b - a), a + np.sqrt((b - a) * (m - a) * u), b - np.sqrt((b - a) * (b - m) * (1 - u)))
        x = p[0] + p[1] * inverse_normal(u)
        return np.exp(x) if self.kind == "lognormal" else x

    def column(self, u: Column) -> Column:
        """The same from a column of uniform draws; not for pert, which draws until it accepts."""
        p = self.p
        if self.kind == "point":
            return F.lit(float(p[0]))
        if self.kind == "uniform":
            return F.lit(p[0]) + F.lit(p[1] - p[0]) * u
        if self.kind == "triangular":
            a, m, b = p
            return let(u, lambda u: F.when(u < (m - a) / (b - a), a + F.sqrt(F.lit((b - a) * (m - a)) * u)).otherwise(b - F.sqrt(F.lit((b - a) * (b - m)) * (1 - u))))
        if self.kind == "pert":
            raise ValueError("pert has no closed form; use sample")
        x = F.lit(p[0]) + F.lit(p[1]) * inverse_normal_column(u)
        return F.exp(x) if self.kind == "lognormal" else x


PARAMETERS = {"point": 1, "normal": 2, "lognormal": 2, "uniform": 2, "triangular": 3, "pert": 3}


def parse_distribution(text: str) -> Distribution:
    """Such as normal(50,5); a bare number is a point."""
    text = text.strip()
    m = re.fullmatch(r"([a-z]+)\s*\(([^()]*)\)", text.lower())
    if not m:
        return Distribution("point", (float(text),))
    kind, p = m[1], tuple(float(x) for x in m[2].split(","))
    if PARAMETERS.get(kind) != len(p):
        raise ValueError(f"no distribution {text!r}")
    if kind == "uniform" and p[0] > p[1]:
        p = p[::-1]
    if kind in ("triangular", "pert") and not p[0] <= p[1] <= p[2]:
        raise ValueError(f"{text!r} isn't in order")
    return Distribution(kind, p)


# --- columns


def let(x: Column, f) -> Column:
    """f(x) with x computed once: what a lambda is given is a value, however often it is used, and however the optimiser
    moves the expression."""
    return F.element_at(F.transform(F.array(x), f), 1)


def inverse_normal_column(p: Column) -> Column:
    def body(p: Column) -> Column:
        q = p - 0.5
        middle = let(F.lit(SQUARE) - q * q, lambda r: q * horner(AS241[0][0], r) / horner(AS241[0][1], r))
        near = lambda t: let(t - STEP, lambda r: horner(AS241[1][0], r) / horner(AS241[1][1], r))
        far = lambda t: let(t - NEAR, lambda r: horner(AS241[2][0], r) / horner(AS241[2][1], r))
        tail = let(F.sqrt(-F.ln(F.least(p, 1 - p))), lambda t: F.when(t <= NEAR, near(t)).otherwise(far(t)))
        return F.when(F.abs(q) <= MIDDLE, middle).when(q < 0, -tail).otherwise(tail)

    return let(p, body)


def _product(m: int, x: Column) -> tuple[Column, Column]:
    """High and low words of a product of two words, by halves, as 64-bit integers here are signed."""
    low, high = x.bitwiseAND(0xFFFF) * m, F.shiftright(x, 16) * m
    upper = high + F.shiftright(low, 16)
    return F.shiftright(upper, 16), F.shiftleft(upper.bitwiseAND(0xFFFF), 16).bitwiseOR(low.bitwiseAND(0xFFFF))


def with_uniform(df: DataFrame, scenario: str, seed: int, index: int, name: str, draw: int = 0) -> DataFrame:
    """``df`` with a uniform draw for each scenario. The rounds are a fold over the keys, so that a round's words are values
    and not expressions that the optimiser could copy into each other."""
    low, high, keys = seed & WORD, seed >> 32 & WORD, []
    for _ in range(ROUNDS):
        keys.append((low, high))
        low, high = (low + INCREMENTS[0]) & WORD, (high + INCREMENTS[1]) & WORD
    words = lambda *ws: F.struct(*(w.cast("long").alias(n) for n, w in zip("abcd", ws, strict=True)))

    def turn(s: Column, key: Column) -> Column:
        (h0, l0), (h1, l1) = _product(MULTIPLIERS[0], s["a"]), _product(MULTIPLIERS[1], s["c"])
        return words(h1.bitwiseXOR(s["b"]).bitwiseXOR(key["low"]), l1, h0.bitwiseXOR(s["d"]).bitwiseXOR(key["high"]), l0)

    schedule = F.array(*(F.struct(F.lit(a).cast("long").alias("low"), F.lit(b).cast("long").alias("high")) for a, b in keys))
    begin = words(F.lit(index), F.col(scenario).cast("long").bitwiseAND(WORD), F.lit(draw << 16), F.lit(TAG))
    unit = lambda s: (F.shiftleft(s["a"], 21).bitwiseXOR(s["b"]).bitwiseAND((1 << 53) - 1).cast("double") + 0.5) * 2.0**-53
    return df.select("*", F.aggregate(schedule, begin, turn, unit).alias(name))
