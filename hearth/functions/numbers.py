"""Arithmetic, hashing and noise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def z_score(x: Column, mean: Column, sd: Column) -> Column:
    """Null where the deviation is zero or unknown."""
    return (x - mean) / F.nullif(sd, F.lit(0.0))


def clipped(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Null stays null (least and greatest alone would skip it)."""
    out = x
    if high is not None:
        out = F.least(out, F.lit(high))
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return F.when(x.isNotNull(), out)


def safe_ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def bit_weight(similarity: Column, m: float, u: float) -> Column:
    """Log-odds of agreement and disagreement, mixed by the similarity."""
    return similarity * F.log2(F.lit(m / u)) + (1 - similarity) * F.log2(F.lit((1 - m) / (1 - u)))


def logistic(x: Column, scale: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-x / scale))


def banded(x: Column, bounds: list[float], labels: list[str]) -> Column:
    """The label of the first bound not exceeded; the last label beyond all. Null stays null."""
    out = F.when(x.isNull(), F.lit(None))
    for bound, label in zip(bounds, labels):
        out = out.when(x <= bound, label)
    return out.otherwise(labels[-1])


def weighted_lookup(c: Column, weights: dict[str, float], default: float = 0.0) -> Column:
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(table[c], F.lit(default))


def digest_bucket(c: Column, n: int) -> Column:
    """The SHA-256 of a string as a number, modulo n (n up to 2**27): eight words of 32 bits are folded from the left."""
    digest, folded = F.sha2(c.cast("string"), 256), F.lit(0).cast("long")
    for at in range(1, 65, 8):
        folded = (folded * (1 << 32) + F.conv(F.substring(digest, at, 8), 16, 10).cast("long")) % n
    return folded.cast("int")


def code_sum_bucket(c: Column, n: int) -> Column:
    """The sum of the characters' codes modulo n."""
    return (F.aggregate(F.transform(F.split(c, ""), lambda d: F.ascii(d).cast("long")), F.lit(0).cast("long"), lambda a, d: a + d) % n).cast("int")


def keyed_uniform(*key: Column, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the key alone, so not on partitions; 52 bits of MD5."""
    digest = F.md5(F.concat_ws("|", *[k.cast("string") for k in key], F.lit(str(seed))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def laplace_count(count: Column, uniform: Column, epsilon: float = 1.0) -> Column:
    """A count with Laplace noise of scale 1 / epsilon, rounded half to even, not below zero."""
    u = uniform - 0.5
    noise = -F.signum(u) * F.log(1 - 2 * F.abs(u)) / epsilon
    return F.greatest(F.lit(0), F.bround(count + noise, 0).cast("long"))
