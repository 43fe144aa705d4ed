"""Elevation colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colours as red, green, blue.
OCEAN = (30, 80, 160)
DEEP = (0, 30, 80)
SEA = (20, 160, 60)
HIGH = (200, 30, 30)


def _ramp(low: int, high: int, t: Column) -> Column:
    mixed = F.lit(float(low)) * (1 - t) + F.lit(float(high)) * t
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), mixed)).cast("int")


def _share(value: Column, low: Column, span: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / span))


def elevation_rgb(h: Column, ocean: Column, lo: Column, hi: Column, sea_level: Column) -> Column:
    """struct(r, g, b): DEEP to SEA below sea level, SEA to HIGH above, OCEAN over ocean."""
    sea = F.least(F.greatest(sea_level, lo), hi).cast("double")
    down = _share(h, lo, F.greatest(sea - lo, F.lit(1e-6)))
    up = _share(h, sea, F.greatest(hi - sea, F.lit(1e-6)))
    bands = [
        F.when(ocean, F.lit(OCEAN[i]))
        .when(h < sea, _ramp(DEEP[i], SEA[i], down))
        .otherwise(_ramp(SEA[i], HIGH[i], up))
        .alias(name)
        for i, name in enumerate("rgb")
    ]
    return F.struct(*bands)


def gray(h: Column, ocean: Column, lo: Column, hi: Column) -> Column:
    """0 at the least height and over ocean, 255 at the largest."""
    return F.when(ocean, F.lit(0)).otherwise((_share(h, lo, hi - lo) * 255).cast("int"))


def alpha(inside: Column) -> Column:
    return F.when(inside, F.lit(255)).otherwise(F.lit(0))
