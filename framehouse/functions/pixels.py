"""Features of gray images as array expressions: pixels row by row from the top, 0 to 255, with a width and a height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framehouse.functions import scores

HASH_WIDTH, HASH_HEIGHT = 9, 8
MARGIN, LEAST_SIDE, FALLBACK = 10, 8, 0.05


def _int(x: Column) -> Column:
    return x.cast("int")


def bound(value: Column, use) -> Column:
    """use(value), with value worked out once for each row: named inside a lambda, it would be worked out for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def count_to(n: Column) -> Column:
    """0, 1, .. n - 1; empty for 0 and less."""
    return F.when(n > 0, F.sequence(F.lit(0), _int(n) - 1)).otherwise(F.array().cast("array<int>"))


def crop(pixels: Column, width: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The pixels of columns x0 to x1 and rows y0 to y1, the ends not included."""
    rows = F.transform(count_to(y1 - y0), lambda k: F.slice(pixels, _int((y0 + k) * width + x0 + 1), _int(x1 - x0)))
    return F.flatten(rows)


def shrunk(pixels: Column, width: Column, height: Column, to_width: int = HASH_WIDTH, to_height: int = HASH_HEIGHT) -> Column:
    """The image in to_width x to_height cells, each the mean of the pixels it covers, rounded half up; null of a smaller image."""

    def cell(i: Column) -> Column:
        x, y = i % to_width, F.floor(i / to_width)
        edge = lambda k, of, n: _int(F.floor(k * of / n))
        inside = crop(pixels, width, edge(x, width, to_width), edge(y, height, to_height), edge(x + 1, width, to_width), edge(y + 1, height, to_height))
        mean = lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda s, v: s + v) / F.size(p)
        return _int(F.floor(bound(inside, mean) + 0.5))

    whole = F.transform(F.sequence(F.lit(0), F.lit(to_width * to_height - 1)), cell)
    return F.when((width >= to_width) & (height >= to_height) & (F.size(pixels) == width * height), whole)


def dhash(gray: Column) -> Column:
    """64 bits of a 9 x 8 image, the first the lowest: set where a pixel is darker than its right neighbour; else null."""

    def bit(i: Column) -> Column:
        left = i + _int(F.floor(i / (HASH_WIDTH - 1)))
        return F.when(F.get(gray, left) < F.get(gray, left + 1), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))

    bits = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(bit(i)))
    return F.when(F.size(gray) == HASH_WIDTH * HASH_HEIGHT, bits)


def laplacians(pixels: Column, width: Column, height: Column) -> Column:
    """What the four neighbours of each inner pixel have above four times itself."""
    inner = width - 2

    def at(i: Column) -> Column:
        k = _int((F.floor(i / inner) + 1) * width + i % inner + 1)
        near = [F.get(pixels, k + step) for step in (-1, 1)] + [F.get(pixels, k + step) for step in (-_int(width), _int(width))]
        return sum(near[1:], near[0]).cast("double") - 4.0 * F.get(pixels, k)

    return F.transform(count_to(F.greatest(inner, F.lit(0)) * F.greatest(height - 2, F.lit(0))), at)


def _moments(values: Column) -> Column:
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    return F.aggregate(values, zero, lambda m, v: F.struct((m.s + v).alias("s"), (m.q + v * v).alias("q")))


def laplacian_variance(pixels: Column, width: Column, height: Column) -> Column:
    """The variance of the laplacians; 0 of an image without inner pixels."""
    return bound(laplacians(pixels, width, height), lambda v: F.when(F.size(v) > 0, bound(_moments(v), lambda m: F.greatest(F.lit(0.0), m.q / F.size(v) - (m.s / F.size(v)) * (m.s / F.size(v))))).otherwise(0.0))


def gray_sharpness(pixels: Column, width: Column, height: Column) -> Column:
    """The laplacians' variance on a logarithmic scale, unbounded above."""
    return scores.gray_sharpness(laplacian_variance(pixels, width, height))


def sharpness(pixels: Column, width: Column, height: Column) -> Column:
    """The mean square of the laplacians of pixels from 0 to 1, 1 at most, on the same scale; a fallback where there are no pixels."""
    square = bound(laplacians(pixels, width, height), lambda v: F.least(F.lit(1.0), _moments(v).q / F.size(v) / (255.0 * 255.0)))
    return F.coalesce(F.when((width > 2) & (height > 2) & (F.size(pixels) == width * height), scores.gray_sharpness(square)), F.lit(FALLBACK))


def region_sharpness(pixels: Column, width: Column, height: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """gray_sharpness of a region with a margin; x, y, w, h are shares of the sides, y from the bottom. 0 of a region of 8 pixels or less a side."""
    left, right = F.greatest(F.lit(0.0), x * width - MARGIN), F.least(width.cast("double"), (x + w) * width + MARGIN)
    top, bottom = F.greatest(F.lit(0.0), (1.0 - y - h) * height - MARGIN), F.least(height.cast("double"), (1.0 - y) * height + MARGIN)
    x0, x1, y0, y1 = _int(F.floor(left)), _int(F.ceil(right)), _int(F.floor(top)), _int(F.ceil(bottom))
    part = bound(crop(pixels, width, x0, y0, x1, y1), lambda p: gray_sharpness(p, x1 - x0, y1 - y0))
    return F.when((right - left > LEAST_SIDE) & (bottom - top > LEAST_SIDE), part).otherwise(0.0)
