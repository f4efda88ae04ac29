"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotlens.params import PRICE_COLOR_MISSING, PRICE_COLOR_STOPS


def insee_code(dept: Column, commune_code: Column) -> Column:
    """Department code followed by the commune number left-padded to 3."""
    return F.concat(dept, F.lpad(commune_code.cast("string"), 3, "0"))


def ratio(num: Column, den: Column) -> Column:
    """num / den with a zero denominator giving NULL (ANSI-safe)."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def dept_of_commune(code: Column) -> Column:
    """Department prefix of a commune code: 3 characters for 97x/98x, else 2."""
    return F.when(code.startswith("97") | code.startswith("98"), F.substring(code, 1, 3)) \
            .otherwise(F.substring(code, 1, 2))


def price_color(price: Column) -> Column:
    """Piecewise-linear RGB colour (hex) over the fixed stops.

    A missing price uses the fixed fallback; values are clamped to the first
    and last stop.
    """
    p = F.coalesce(price.cast("double"), F.lit(PRICE_COLOR_MISSING))
    lo_stop, hi_stop = PRICE_COLOR_STOPS[0][0], PRICE_COLOR_STOPS[-1][0]
    p = F.least(F.greatest(p, F.lit(lo_stop)), F.lit(hi_stop))

    def rgb(hex_colour: str) -> tuple[int, int, int]:
        h = hex_colour.lstrip("#")
        return int(h[0:2], 16), int(h[2:4], 16), int(h[4:6], 16)

    channels = []
    for ch in range(3):
        expr = None
        for (x0, c0), (x1, c1) in zip(PRICE_COLOR_STOPS[:-1], PRICE_COLOR_STOPS[1:]):
            v0, v1 = rgb(c0)[ch], rgb(c1)[ch]
            seg = F.lit(float(v0)) + (p - F.lit(x0)) * F.lit((v1 - v0) / (x1 - x0))
            cond = p <= F.lit(x1)
            expr = F.when(cond, seg) if expr is None else expr.when(cond, seg)
        value = F.bround(expr.otherwise(F.lit(float(rgb(PRICE_COLOR_STOPS[-1][1])[ch]))), 0).cast("int")
        channels.append(F.lpad(F.lower(F.hex(value)), 2, "0"))
    return F.concat(F.lit("#"), *channels)
