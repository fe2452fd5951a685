"""Electrical rules and name rules of boards as column expressions, and the mesh size policy."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Copper conductivity in S/mm, default copper thickness and via plating in mm, millimetres per mil.
SIGMA = 5.95e4
COPPER = 0.035
PLATING = 0.025
MIL = 0.0254
# Ground names, and the constants of the trace capacity rule for outer and inner layers.
GROUND_NAMES = ("gnd", "ground", "0", "earth", "vss", "vee", "agnd", "dgnd", "sgnd", "pgnd")
CAPACITY_OUTER, CAPACITY_INNER = 0.048, 0.024


def normal_name(name: Column) -> Column:
    """Lower case with nothing but letters a to z and digits."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def is_ground(name: Column) -> Column:
    """A known ground name, or one that contains gnd, ground or vss."""
    low = F.lower(F.trim(name))
    return low.isin(*GROUND_NAMES) | low.rlike("gnd|ground|vss")


def net_matches(wanted: Column, net: Column) -> Column:
    """An empty wanted name suits all."""
    return (wanted == "") | (wanted == net)


def sanitized(value: Column) -> Column:
    """NaN and infinities become 0."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(0.0)).otherwise(value)


def sheet_conductance(thickness: Column) -> Column:
    return F.coalesce(thickness, F.lit(COPPER)) * SIGMA


def default_conductance(conductance: Column) -> Column:
    """Zero and null mean 1."""
    return F.coalesce(F.nullif(conductance, F.lit(0.0)), F.lit(1.0))


def via_resistance(length: Column, hole_diameter: Column) -> Column:
    """Of a plated barrel; 1 mOhm where there is no hole."""
    inner = hole_diameter / 2
    outer = inner + PLATING
    return F.when(inner <= 0, F.lit(1e-3)).otherwise(length / (SIGMA * math.pi * (outer * outer - inner * inner)))


def track_resistance(length: Column, width: Column, conductance: Column) -> Column:
    return length / (conductance * width)


def is_outer_layer(name: Column) -> Column:
    return F.lower(name).rlike("top|bottom")


def copper_ounces(thickness: Column) -> Column:
    """From millimetres; null means the default thickness."""
    return F.coalesce(thickness, F.lit(COPPER)) / (1.378 * MIL)


def trace_capacity(width_mm: Column, ounces: Column, rise: Column, outer: Column) -> Column:
    """Amperes that a trace carries at a temperature rise."""
    area = width_mm / MIL * ounces * 1.378
    k = F.when(outer, F.lit(CAPACITY_OUTER)).otherwise(F.lit(CAPACITY_INNER))
    return F.when((area > 0) & (rise > 0), k * F.pow(rise, F.lit(0.44)) * F.pow(area, F.lit(0.725))).otherwise(0.0)


def utilization(current: Column, limit: Column) -> Column:
    return F.when(limit > 0, current / limit).otherwise(0.0)


def mesh_size(area: float, coarsen: float = 1.0) -> tuple[float, float]:
    """Edge length and minimum angle of a mesh from the copper area."""
    if area < 30_000:
        size, angle = min(1.2 * min(math.sqrt(30_000 / max(area, 100.0)), 4.0), 2.0), 20.0
    else:
        size, angle = min(max(1.2 * math.sqrt(area / 30_000), 1.5), 5.0), 25.0
    return min(size * coarsen, 80.0), angle


def mesh_length(area: Column) -> Column:
    """The edge length of ``mesh_size`` for a column of copper areas."""
    small = F.least(F.lit(1.2) * F.least(F.sqrt(F.lit(30_000.0) / F.greatest(area, F.lit(100.0))), F.lit(4.0)), F.lit(2.0))
    return F.when(area < 30_000, small).otherwise(F.least(F.greatest(F.lit(1.2) * F.sqrt(area / 30_000), F.lit(1.5)), F.lit(5.0)))


def coarsened(size: float, angle: float, vertices: int, most: int = 60_000) -> tuple[float, float]:
    """A coarser setting for a mesh that has too many vertices."""
    return min(size * min(1.5 * math.sqrt(vertices / most), 6.0), 80.0), angle - 3.0


def symbol_fields(symbol: Column) -> Column:
    """``struct<kind, w, h, r>`` of a pad symbol name; kind null where it is unknown. Numbers are in thousandths."""
    number = "([0-9.]+)"
    rect = f"^rect{number}x{number}(?:xr?{number})?$"
    oval, circle, square = f"^oval{number}x{number}$", f"^r{number}$", f"^s{number}$"
    pick = lambda pattern, group: F.nullif(F.regexp_extract(symbol, pattern, group), F.lit("")).try_cast("double") / 1000
    is_rect, is_oval, is_round, is_square = (symbol.rlike(p) for p in (rect, oval, circle, square))
    kind = F.when(is_rect | is_square, "rect").when(is_oval, "oval").when(is_round, "round")
    w = F.coalesce(pick(rect, 1), pick(oval, 1), pick(circle, 1), pick(square, 1))
    h = F.coalesce(pick(rect, 2), pick(oval, 2), pick(circle, 1), pick(square, 1))
    return F.struct(kind.alias("kind"), w.alias("w"), h.alias("h"), F.coalesce(pick(rect, 3), F.lit(0.0)).alias("r"))
