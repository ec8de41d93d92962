"""Scalar expressions: buckets, scaling, one-hot coding, musical keys, ranges, schedules."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies and the tempo range of the feature table.
MOODS = ["aggressive", "calm", "euphoric", "intense", "melancholic", "neutral"]
TEMPO_LOW, TEMPO_HIGH = 39.0, 235.0
# Names of the twelve pitch classes, and the published key profiles (major, minor).
PITCHES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]


def buckets(value: Column, edges: list[tuple[float, str]], last: str) -> Column:
    """The label of the first edge that the value is below, else ``last``; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, label in edges:
        out = out.when(value < edge, label)
    return out.otherwise(last)


def tempo_word(bpm: Column) -> Column:
    return buckets(bpm, [(70, "very slow, ballad-paced"), (100, "slow to moderate, relaxed"), (120, "moderate, mid-tempo"), (140, "upbeat, lively")], "fast-paced, energetic")


def mood_of_sound(tempo: Column, energy: Column, centroid: Column) -> Column:
    """A mood from tempo, loudness and brightness; a null among them gives null."""
    fast, loud, bright = tempo > 120, energy > 0.15, centroid > 2500
    known = tempo.isNotNull() & energy.isNotNull() & centroid.isNotNull()
    return F.when(known & fast & loud, F.when(bright, "euphoric").otherwise("aggressive")).when(known & ~fast, F.when(loud, "intense").when(bright, "calm").otherwise("melancholic")).when(known, "neutral")


def mood_of_valence(valence: Column, energy: Column) -> Column:
    """A mood from valence and energy; a null gives null."""
    high = energy > 0.6
    return F.when(valence.isNull() | energy.isNull(), F.lit(None).cast("string")).when(valence > 0.6, F.when(high, "euphoric").otherwise("calm")).when(valence <= 0.4, F.when(high, "aggressive").otherwise("melancholic")).otherwise("neutral")


def dispersion_tier(sigma2: Column, low: Column, high: Column) -> Column:
    return F.when(sigma2.isNull(), F.lit(None).cast("string")).when(sigma2 < low, "compact").when(sigma2 < high, "medium").otherwise("diverse")


def minmax(value: Column, low: float, high: float, missing: float = 0.5) -> Column:
    """To [0, 1], clipped; null and NaN give ``missing``."""
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low)))
    return F.when(value.isNull() | F.isnan(value), F.lit(missing)).otherwise(scaled)


def one_hot(value: Column, vocabulary: list[str], fold_case: bool = True) -> Column:
    """Zeros and a one; all zeros for null or an unknown value. Case is folded on both sides."""
    v = F.lower(F.trim(value)) if fold_case else value
    entries = [x.lower() if fold_case else x for x in vocabulary]
    return F.array(*[F.when(F.coalesce(v == x, F.lit(False)), 1.0).otherwise(0.0) for x in entries])


def features(*parts: tuple[Column, int]) -> Column:
    """The parts one after the other; a null part is zeros of its width."""
    return F.concat(*[F.coalesce(c.cast("array<double>"), F.array_repeat(F.lit(0.0), n)) for c, n in parts])


def key_name(key: Column, mode: Column) -> Column:
    """``A minor`` from a pitch class and 0 or 1; an unknown pitch class gives an empty string."""
    names = F.array(*[F.lit(p) for p in PITCHES])
    return F.when(~F.coalesce(key.between(0, 11), F.lit(False)), "").otherwise(F.concat(F.get(names, key.cast("int")), F.when(mode == 1, " major").otherwise(" minor")))


def estimated_key(chroma: Column) -> Column:
    """The key whose rotated profile has the highest product with the twelve chroma values; the first on a tie."""
    profiles = [(np.roll(base, r), f"{PITCHES[r]} {mode}") for r in range(12) for base, mode in ((MAJOR, "major"), (MINOR, "minor"))]
    scores = F.array(*[sum((F.get(chroma, i) * float(p[i]) for i in range(1, 12)), F.get(chroma, 0) * float(p[0])) for p, _ in profiles])
    names = F.array(*[F.lit(name) for _, name in profiles])
    return F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))


def byte_ranges(total: Column, workers: int) -> Column:
    """Contiguous (first, last) ranges of ``total`` bytes, one per worker; empty ones are left out."""
    bounds = F.transform(F.sequence(F.lit(0), F.lit(workers - 1)), lambda i: F.struct(F.floor(total * i / workers).alias("first"), (F.floor(total * (i + 1) / workers) - 1).alias("last")))
    return F.filter(bounds, lambda b: b["last"] >= b["first"])


def centre_crop(length: Column, target: int) -> Column:
    """(first, end) of the middle ``target`` of ``length``; a short one whole."""
    first = F.when(length <= target, 0).otherwise(F.floor((length - target) / 2))
    return F.struct(first.cast("long").alias("first"), F.when(length <= target, length).otherwise(first + target).cast("long").alias("end"))


def masked_mean(values: Column, mask: Column) -> Column:
    """Mean of the values where the mask is true; 0 where it never is."""
    pairs = F.zip_with(values, mask, lambda v, m: F.when(m, v.cast("double")).otherwise(0.0))
    total = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
    return total / F.greatest(F.size(F.filter(mask, lambda m: m)), F.lit(1))


def inverse_root_rate(step: Column, peak: float, constant: int) -> Column:
    return F.when(step <= constant, F.lit(peak)).otherwise(peak * F.sqrt(F.lit(float(constant)) / step))
