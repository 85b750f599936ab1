"""Expressions on flat arrays that hold images, row by row within channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(pixels: Column) -> Column:
    """Null, without a finite value, or of one finite value only."""
    finite = F.filter(pixels, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return pixels.isNull() | (F.size(finite) == 0) | (F.array_max(finite) == F.array_min(finite))


def channels(pixels: Column, size: int, known: list[int], wanted: list[int]) -> Column:
    """The wanted channels in their order; unknown ones are passed over. size: values in a channel."""
    places = [known.index(w) for w in wanted if w in known]
    return F.flatten(F.array(*(F.slice(pixels, i * size + 1, size) for i in places)))


def channel_last(pixels: Column, c: int, size: int) -> Column:
    """(c, size) turned to (size, c)."""
    return F.transform(F.sequence(F.lit(0), F.lit(c * size - 1)), lambda i: F.element_at(pixels, ((i % c) * size + F.floor(i / c) + 1).cast("int")))


def patches(pixels: Column, c: int, side: int, patch: int) -> Column:
    """An image (c, side, side) as patches in row order, each a flat array (c, patch, patch)."""
    per = side // patch
    inner = c * patch * patch

    def value(p: Column, f: Column) -> Column:
        ch, y, x = F.floor(f / (patch * patch)), F.floor(f / patch) % patch, f % patch
        row, col = F.floor(p / per) * patch + y, (p % per) * patch + x
        return F.element_at(pixels, (ch * side * side + row * side + col + 1).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(per * per - 1)), lambda p: F.transform(F.sequence(F.lit(0), F.lit(inner - 1)), lambda f: value(p, f)))


def only_value(values: Column) -> Column:
    """The one value of an array; an array of another size is an error."""
    return F.when(F.assert_true(F.size(values) == 1).isNull(), F.element_at(values, 1))


def flattened(stack: Column) -> Column:
    """A stack of images (nested three deep) as one flat array."""
    return F.flatten(F.flatten(stack))


def total_flux(logits: Column, mean: float, std: float) -> Column:
    """The sum of the patches' fluxes, each clamped to [1e-15, 1], and 1e-15 at least."""
    flux = F.transform(logits, lambda z: F.least(F.greatest(F.pow(F.lit(10.0), z.cast("double") * std + mean) - 1e-8, F.lit(1e-15)), F.lit(1.0)))
    return F.greatest(F.aggregate(flux, F.lit(0.0), lambda a, x: a + x), F.lit(1e-15))


def brightest_patch(pixels: Column, width: int, height: int, patch: int) -> Column:
    """The patch x patch part of one image around its first brightest pixel, moved inward at the borders; null for null
    and for images without a value."""
    known = F.filter(pixels, lambda x: x.isNotNull() & ~F.isnan(x))
    at = F.array_position(pixels, F.array_max(known)) - 1
    start = lambda place, most: F.greatest(F.lit(0), F.least(place - patch // 2, F.lit(most - patch))).cast("int")
    top, left = start(F.floor(at / width), height), start(at % width, width)
    rows = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(patch - 1)), lambda i: F.slice(pixels, (top + i) * width + left + 1, F.lit(patch))))
    return F.when(at >= 0, rows)
