"""Rates, intervals, coercion, severity and weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of a two-sided 95 % interval.
Z95 = 1.959963984540054


def nz(c: Column) -> Column:
    """Null for empty text, untrimmed."""
    return F.nullif(c, F.lit(""))


def unit(c: Column) -> Column:
    """Clamped to 0..1; null and non-finite become 0."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def rate(x: Column, n: Column) -> Column:
    """x / max(1, n)."""
    return x / F.greatest(F.lit(1), n)


def rate_or_null(x: Column, n: Column) -> Column:
    return x / F.nullif(n, F.lit(0))


def wilson(hits: Column, n: Column, z: float = Z95) -> Column:
    """struct(lower, upper); the whole interval where the counts make no sense."""
    p, z2 = hits / n, z * z
    centre, spread = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    bad = n.isNull() | hits.isNull() | (n <= 0) | (hits < 0) | (hits > n)
    low = F.when(bad, 0.0).otherwise(F.greatest(F.lit(0.0), (centre - spread) / (1 + z2 / n)))
    high = F.when(bad, 1.0).otherwise(F.least(F.lit(1.0), (centre + spread) / (1 + z2 / n)))
    return F.struct(low.alias("lower"), high.alias("upper"))


def non_negative(c: Column) -> Column:
    """Lenient number: text is parsed, anything unusable or negative is 0."""
    v = c.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v < 0), 0.0).otherwise(v)


def bounded(c: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def severity(v: Column, elevated: float, high: float, critical: float) -> Column:
    """Piecewise linear: 1 at elevated, 1.75 at high, 2.7 at critical, on from there."""
    tiny = 1e-6
    return (
        F.when(v >= critical, 2.7 + (v - critical) / max(critical, tiny))
        .when(v >= high, 1.75 + 0.95 * (v - high) / max(critical - high, tiny))
        .when(v >= elevated, 1.0 + 0.75 * (v - elevated) / max(high - elevated, tiny))
        .otherwise(F.greatest(F.lit(0.0), v / max(elevated, tiny)))
    )


def combined_confidence(detector: Column, ocr: Column, quality: Column, valid: Column) -> Column:
    base = 0.34 * detector + 0.56 * ocr + 0.10 * quality
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(valid, base + 0.08).otherwise(base * 0.62))), 4)


def capture_score(quality: Column, detector: Column, area_share: Column) -> Column:
    """area_share: of the frame; 1.8 % counts in full."""
    return 0.60 * quality + 0.25 * detector + 0.15 * F.least(F.lit(1.0), area_share / 0.018)


def hash_share(c: Column) -> Column:
    """The first eight bytes of the SHA-256 as a fraction of 2^64."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(2**64)


def is_validation(c: Column, ratio: float) -> Column:
    return hash_share(c) < min(0.50, max(0.05, ratio))


def backoff_seconds(attempts: Column, base: float = 1.0, most: float = 60.0) -> Column:
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))))


def framed_digest(*parts: Column) -> Column:
    """SHA-256 over the parts, each after its length in eight bytes."""
    framed = [F.concat(F.unhex(F.lpad(F.hex(F.octet_length(p).cast("long")), 16, "0")), p.cast("binary")) for p in parts]
    return F.sha2(F.concat(*framed), 256)
