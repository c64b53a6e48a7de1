"""Blending, colour, schedules, time and text as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..checks import checked, one_of, require

#: The default colour map, blue over green to red.
COLOR_MAP = [[0, 0, 1], [0, 1, 1], [0, 1, 0], [1, 1, 0], [1, 0, 0]]


def clamp(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def blend(a: Column, b: Column, ratio: float = 0.5) -> Column:
    return a * ratio + b * (1 - ratio)


def blend_arrays(a: Column, b: Column, ratio: float = 0.5) -> Column:
    """Element by element; arrays of different length are an error."""
    return F.zip_with(checked(a, F.size(a) == F.size(b), "arrays differ in length"), b, lambda x, y: blend(x, y, ratio))


def overlay(value: Column, layer: Column, ratio: float = 0.5, mask: Column | None = None) -> Column:
    """Blended where the mask holds, and clamped to [0, 1] everywhere."""
    mixed = blend(value, layer, ratio)
    return clamp(mixed if mask is None else F.when(mask, mixed).otherwise(value))


def hsv_to_rgb(h: Column, s: Column, v: Column) -> list[Column]:
    """By sector of the hue; channels are periodic ramps between v (1 - s) and v, shifted by two sectors each."""
    sector = (h * 6).cast("bigint")
    f = h * 6 - sector
    low, down, up = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    which = F.pmod(sector, F.lit(6))
    cycle = [v, down, low, low, up, v]
    channel = lambda shift: F.element_at(F.array(*[cycle[(i + shift) % 6] for i in range(6)]), (which + 1).cast("int"))
    return [channel(0), channel(4), channel(2)]


def color_of(value: Column, low: float, high: float, color_map: Sequence[Sequence[float]] | None = None) -> list[Column]:
    """Piecewise linear between the map's colours over [low, high], clamped; equal bounds give the first colour."""
    stops = [[float(c) for c in row] for row in (color_map or COLOR_MAP)]
    if low == high:
        return [F.lit(c) for c in stops[0]]
    n = len(stops) - 1
    at = (F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high))) - low) / (high - low) * n
    cell = F.least(F.floor(at), F.lit(n - 1)).cast("int")
    pick = lambda c, off: F.element_at(F.array(*[F.lit(row[c]) for row in stops]), cell + 1 + off)
    return [pick(c, 0) + (pick(c, 1) - pick(c, 0)) * (at - cell) for c in range(3)]


def in_unit(value: Column, what: str) -> Column:
    return checked(value, (value >= 0) & (value <= 1), f"{what} must be in the range [0, 1]")


def rgba_of(attributes: Sequence[Column], scale: tuple[float, float] = (0, 100), color_map=None) -> list[Column]:
    """One column is a value to be coloured, two a value and alpha, three RGB, four RGBA."""
    n = len(attributes)
    require(1 <= n <= 4, "attributes need one to four columns")
    rgb = color_of(attributes[0], *scale, color_map) if n < 3 else list(attributes[:3])
    alpha = F.lit(1.0) if n in (1, 3) else in_unit(attributes[-1], "alpha values")
    return [*[in_unit(c, "RGB values") for c in rgb], alpha]


def packed_rgb(r: Column, g: Column, b: Column) -> Column:
    """255, r, g, b as the bytes of an integer, first byte highest."""
    whole = lambda c: F.floor(c * 255).cast("bigint")
    return F.lit(255 << 24) + whole(r) * (1 << 16) + whole(g) * (1 << 8) + whole(b)


def decay(epoch: Column, *, mode: str | None, final_scale: float, total_epoch: int) -> Column:
    """The schedule's factor at an epoch: 1 before the start or without a mode."""
    if mode is None:
        return F.lit(1.0)
    one_of("mode", mode, ("exp", "linear", "cosine"))
    share = epoch / F.lit(float(total_epoch))
    if mode == "exp":
        value = F.exp(share * math.log(final_scale + 1e-7))
    elif mode == "linear":
        value = 1 - (1 - final_scale) * share
    else:
        value = final_scale + (1 - final_scale) * (F.cos(share * math.pi) + 1) / 2
    return F.when(epoch < 0, F.lit(1.0)).otherwise(value)


def learning_rate(base: Column, epoch: Column, *, start_scale: float = 0.0, warmup_epoch: int = -1, final_scale: float = 0.0, total_epoch: int = -1, mode: str | None = None) -> Column:
    """Linear from start_scale to the schedule at warmup_epoch, then the schedule; times the base rate."""
    require(start_scale <= 1, "start_scale must not be over 1")
    kind = {"mode": mode, "final_scale": final_scale, "total_epoch": total_epoch}
    after = decay(epoch, **kind)
    if warmup_epoch <= 0:
        return base * after
    at_end = decay(F.lit(float(warmup_epoch)), **kind)
    return base * F.when(epoch < warmup_epoch, start_scale + (at_end - start_scale) * epoch / warmup_epoch).otherwise(after)


def positional_value(position: Column, slot: Column, d: int, n: float = 10000) -> Column:
    """sin in even slots, cos in odd ones, of position by n to the power 2 * (slot div 2) / d."""
    angle = position / F.pow(F.lit(float(n)), 2 * F.floor(slot / 2) / F.lit(float(d)))
    return F.when(slot % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))


def micros_of_nanos(ts_ns: Column) -> Column:
    """Timestamp of epoch nanoseconds, floored to microseconds."""
    return F.timestamp_micros(F.floor(ts_ns.cast("decimal(20,0)") / 1000).cast("bigint"))


def utc_now(fmt: str = "yyyy-MM-dd.HH-mm-ss") -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), fmt)


def pixels_to_inches(pixels: Column, ppi: float = 91.79) -> Column:
    return checked(pixels, pixels >= 0, "pixels must not be negative") / ppi


def markdown_header(columns: int) -> str:
    line = lambda cell: "|" + f"{cell}|" * columns
    return f"{line('   ')}\n{line(' --- ')}"


def markdown_row(cells: Sequence[Column]) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.array(*[c.cast("string") for c in cells]), " | ", "null"), F.lit(" |"))


def stable_merge(lists: Column) -> Column:
    """Array of arrays to one array: the first as it is, then unseen items of the others in order."""
    rest = F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(0)))
    return F.aggregate(rest, F.element_at(lists, 1), lambda acc, x: F.concat(acc, F.array_except(x, acc)))


def triangle_fan(polygon: Column) -> Column:
    """A polygon's triangles, all with its first corner; under three corners is an error."""
    n = F.size(polygon)
    inner = F.sequence(F.lit(1), checked(n, n >= 3, "a polygon needs three corners") - 2)
    return F.transform(inner, lambda i: F.array(polygon[0], polygon[i], polygon[i + 1]))


def extension_for(path: str, is_array: bool, suggestion: str | None = None) -> str:
    """The path with its suggestion appended as it is, else with the usual suffix unless it has it."""
    if suggestion is not None:
        return path + suggestion
    suffix = ".npy" if is_array else ".parquet"
    return path if path.endswith(suffix) else path + suffix
