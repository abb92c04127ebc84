"""Arithmetic on image features that come as input columns: quality, faces, bits and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _scaled_log(x: Column, most: float) -> Column:
    return F.when(x > 0, F.least(F.lit(1.0), F.log2(x.cast("double")) / most)).otherwise(0.3)


def quality(sharpness: Column, face: Column, size: Column, width: Column, height: Column) -> Column:
    """Half sharpness, then faces (or sharpness again where none is found), resolution and bytes."""
    area = F.coalesce(width, F.lit(0)).cast("long") * F.coalesce(height, F.lit(0))
    return 0.5 * sharpness + 0.15 * _scaled_log(area, 24.0) + 0.10 * _scaled_log(size, 26.0) + 0.25 * F.coalesce(face, sharpness)


def expression_quality(sharpness: Column, face: Column, eyes: Column, smile: Column, blur: Column, size: Column, width: Column, height: Column) -> Column:
    """quality() unless it is known how open the eyes are; a blurred subject lowers the whole."""
    area = F.coalesce(width, F.lit(0)).cast("long") * F.coalesce(height, F.lit(0))
    whole = 0.35 * sharpness + 0.30 * eyes + 0.10 * F.coalesce(smile, F.lit(0.0)) + 0.10 * _scaled_log(area, 24.0) + 0.10 * _scaled_log(size, 26.0) + 0.05 * F.coalesce(face, sharpness)
    return F.when(eyes.isNull(), quality(sharpness, face, size, width, height)).when(blur > 0.1, whole * (1 - 0.3 * blur)).otherwise(whole)


def face_score(faces: Column) -> Column:
    """Mean over array<struct<confidence, both_eyes>> of the confidence, raised where both eyes show; null without faces."""
    total = F.aggregate(faces, F.lit(0.0), lambda s, f: s + F.least(F.lit(1.0), f.confidence + F.when(f.both_eyes, 0.2).otherwise(0.0)))
    return F.when(F.size(faces) > 0, total / F.size(faces))


def _extent(points: Column, axis: str) -> Column:
    values = F.transform(points, lambda p: p[axis])
    return F.array_max(values) - F.array_min(values)


def eye_openness(points: Column) -> Column:
    """Height over width of an eye's outline (array<struct<x, y>>), 1 at a half or more; 0.5 of fewer than six points."""
    width = _extent(points, "x")
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), _extent(points, "y") / width / 0.5))
    return F.when((F.size(points) >= 6) & (width > 0.001), ratio).otherwise(0.5)


def eyes_open(left: Column, right: Column) -> Column:
    return (eye_openness(left) + eye_openness(right)) / 2


def smile(points: Column) -> Column:
    """How much wider than high the lips' outline is, from 1.5 (0) to 4.5 (1); 0 of fewer than six points."""
    height = _extent(points, "y")
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (_extent(points, "x") / height - 1.5) / 3.0))
    return F.when((F.size(points) >= 6) & (height > 0.001), ratio).otherwise(0.0)


def motion_blur(subject: Column, whole: Column) -> Column:
    """Half of what the subject lacks of the whole image's sharpness."""
    return F.when(whole > 0.01, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - subject / whole) * 0.5)).otherwise(0.0)


def gray_sharpness(variance: Column) -> Column:
    """A Laplacian's variance on a logarithmic scale, 1 at a variance of 1."""
    return F.log10(1 + 20 * variance) / F.log10(F.lit(21.0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_bits(vector: Column) -> Column:
    """Bit k of a long is set where component k of 64 is above 0."""
    bits = F.transform(vector, lambda x, k: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
