"""Numeric column functions: Wilson bound, holdout hash, vectors, strength of use."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlens import fixed_values as V


def wilson_lower(successes: Column, trials: Column, z: float = V.WILSON_Z) -> Column:
    """Lower end of the Wilson interval in [0, 1]; 0 without trials."""
    n = trials.cast("double")
    p = F.try_divide(successes.cast("double"), n)
    margin = z * F.sqrt(F.greatest(F.lit(0.0), F.try_divide(p * (1 - p) + F.try_divide(F.lit(z * z), 4 * n), n)))
    bound = F.try_divide(p + F.try_divide(F.lit(z * z), 2 * n) - margin, 1 + F.try_divide(F.lit(z * z), n))
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), bound))).otherwise(F.lit(0.0))


def holdout(fingerprint: Column, rate: float, salt: str) -> Column:
    """True for a stable ``rate`` share of fingerprints: first four hash bytes below the rate."""
    head = F.substring(F.sha2(F.concat(F.lit(salt), F.lit("\0"), fingerprint), 256), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") < F.lit(int(rate * 2**32))


def strength_rank(signal: Column, score: Column, recorded: Column) -> Column:
    """0 weak .. 3 explicit; a recorded strength wins over the match signal."""
    known = F.array_position(F.array(*[F.lit(s) for s in V.STRENGTHS]), recorded) - 1
    derived = (F.when(signal == "explicit", 3).when(score >= V.STRONG_JACCARD, 2)
               .when(score >= V.MODERATE_JACCARD, 1).otherwise(0))
    return F.when(recorded.isNotNull() & (known >= 0), known.cast("int")).otherwise(derived)


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length, empty vectors or zero vectors."""
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), F.lit(0.0)).otherwise(F.coalesce(value, F.lit(0.0)))


def unit(v: Column) -> Column:
    """The vector scaled to length one; a zero vector stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.element_at(F.transform(F.array(norm), lambda n: F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))), 1)


def freshness(age_ms: Column, half_life_days: float = V.FRESHNESS_HALF_LIFE_DAYS) -> Column:
    return F.exp(F.lit(-math.log(2.0)) * (age_ms.cast("double") / V.DAY_MS) / half_life_days)
