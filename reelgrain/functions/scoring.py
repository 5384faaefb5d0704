"""Indicator norms, suspicion scores, grades, layers and reuse patterns as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Added before rounding to two places, so that halves go up whatever the last bits of a sum are.
TIE = 1e-9


@dataclass(frozen=True)
class Policy:
    """Thresholds and weights; the weights of the eight indicators sum to 1."""

    layer_a_min_seconds: float = 60.0
    evolution_band: tuple[float, float] = (0.60, 0.75)
    cosine_cull: float = 0.55
    whole_ratio: float = 0.50
    weights: dict[str, float] = field(default_factory=lambda: {"i1": 0.20, "i2": 0.20, "i3": 0.10, "i4": 0.05, "i5": 0.05, "i6": 0.20, "i7": 0.10, "i8": 0.10})

    def __post_init__(self) -> None:
        if abs(sum(self.weights.values()) - 1) > 0.01:
            raise ValueError("the weights must sum to 1")
        low, high = self.evolution_band
        if not 0 <= low < high <= 1:
            raise ValueError("the evolution band must be a range within [0, 1]")
        if self.layer_a_min_seconds <= 0 or not 0 <= self.cosine_cull <= 1 or not 0 < self.whole_ratio < 1:
            raise ValueError("a threshold is out of its range")


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in [0, 1]; 0 where a norm is 0."""
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), zero, lambda s, x: s + x))
    return clamp(F.coalesce(F.try_divide(dot, norm(a) * norm(b)), zero))


def suspicion5(i1: Column, i2: Column, i3: Column, i4: Column, i5: Column) -> Column:
    """Score of 0 to 100 from hash equality, cosine, change rate, new terms and difference of durations (30/25/20/15/10)."""
    parts = 30.0 * i1.cast("int") + 25.0 * clamp(i2) + 20.0 * clamp(1.0 - i3) + 15.0 * (1.0 / (1.0 + i4)) + 10.0 * F.greatest(F.lit(0.0), 1.0 - F.abs(i5) / 60.0)
    return F.round(clamp(parts, 0.0, 100.0) + TIE, 2)


def composite8(policy: Policy, i1: Column, i2: Column, i3: Column, i4: Column, i5: Column, i6: Column | None = None, i7: Column | None = None, i8: Column | None = None) -> Column:
    """Score by the policy's weights; without the time axis the first five weights are scaled to sum to 1."""
    w = policy.weights
    norms = {"i1": i1.cast("double"), "i2": clamp(i2), "i3": F.greatest(F.lit(0.0), 1.0 - i3), "i4": F.greatest(F.lit(0.0), 1.0 - i4 / 100.0), "i5": F.greatest(F.lit(0.0), 1.0 - F.abs(i5) / 600.0)}
    total = 1.0
    if i6 is None:
        total = sum(w[k] for k in norms)
    else:
        norms |= {"i6": F.least(F.lit(1.0), i6 / 1200.0), "i7": F.greatest(F.lit(0.0), 1.0 - i7 / 300.0), "i8": i8}
    score = sum((norms[k] * (w[k] / total) for k in norms), F.lit(0.0))
    return F.round(clamp(100.0 * score, 0.0, 100.0) + TIE, 2)


def grade(score: Column) -> Column:
    return F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 40, "moderate").otherwise("normal")


def pattern4(i6: Column, shorter: Column, same_week: Column, whole_ratio: float = 0.50) -> Column:
    """Whole or scattered by the longest span's share of the shorter video; null where that has no positive duration."""
    kind = F.when(i6 / shorter >= whole_ratio, "whole").otherwise("scattered")
    return F.when(shorter > 0, F.concat(kind, F.when(same_week, "-same-week").otherwise("-different-week")))


def pattern6(i6: Column, shorter: Column, same_week: Column, hamming: Column, i2: Column, first_half: Column, second_half: Column, far: float = 50) -> Column:
    re_recorded = (hamming > far) & (i2 >= 0.85) & (i6 / shorter >= 0.50)
    tail = (first_half >= 0.85) & (second_half <= 0.15)
    return F.when(shorter > 0, F.when(re_recorded, "re-recorded-same-content").when(tail, "tail-update").otherwise(pattern4(i6, shorter, same_week, 0.80)))


def layers(policy: Policy, i6: Column, i2: Column, baseline_seconds: Column, whitelisted: Column) -> Column:
    """Trail of the layers A (length), B (baseline), D (whitelist) and C (evolution band): array of layer and action."""
    low, high = policy.evolution_band
    out = F.coalesce(i6 < policy.layer_a_min_seconds, F.lit(False))
    act = lambda layer, yes, done: F.struct(F.lit(layer).alias("layer"), F.when(yes, done).otherwise("no-op").alias("action"))
    band = F.coalesce((i2 >= low) & (i2 <= high), F.lit(False))
    return F.array(act("A", out, "excluded"), act("B", ~out & (baseline_seconds > 0), "subtracted"), act("D", ~out & (whitelisted > 0), "subtracted"), act("C", ~out & band, "demoted"))


def evidence(exact: Column, normalised: Column, duration: Column, size: Column, mtime: Column) -> Column:
    title = F.when(exact, 40).when(normalised, 30).otherwise(0)
    return title + F.when(duration, 25).otherwise(0) + F.when(size, 5).otherwise(0) + F.when(mtime, 5).otherwise(0)


def raced(*axes: Column) -> Column:
    """Mean of the axes if any is above 0, else 0."""
    return F.when(F.greatest(*axes) > 0, sum(axes, F.lit(0.0)) / float(len(axes))).otherwise(0.0)


def backoff(base: float, multiplier: float, attempt: Column) -> Column:
    return base * F.pow(F.lit(float(multiplier)), attempt)


def bit_distance(a: Column, b: Column) -> Column:
    """Mean number of differing bits of two arrays of unsigned 32-bit numbers kept as longs."""
    n = F.least(F.size(a), F.size(b))
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return F.try_divide(total.cast("double"), n.cast("double"))


def preset(vram: Column, gpus: Column) -> Column:
    """Preset by video memory in GiB (null: none) and number of devices: below 4 none, below 16 quantised, several as a pool."""
    return F.when(vram.isNull() | (vram < 4), "cpu").when(vram < 16, "gpu-quantized").when(gpus > 1, "gpu-pool").otherwise("gpu-native")


def plausible(size: Column, seconds: Column) -> Column:
    """Whether a file's bytes per second lie between 0.5e6 and 10e6; false without a positive duration."""
    return F.coalesce((seconds > 0) & (size / F.when(seconds > 0, seconds)).between(0.5e6, 10e6), F.lit(False))
