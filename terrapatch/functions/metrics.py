"""Metrics as column expressions over the base relations.

Patches have n (cells), ns and ew (sides that face another class), core (core cells), cores
(disjunct core areas), squared (of the distance to the next patch of the class), and w, h
(cell width and height).  Undefined values are NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrapatch import settings


def square() -> Column:
    """Whether cells are square within the tolerance."""
    return F.abs(F.col("w") - F.col("h")) <= F.lit(1e-8) + F.lit(settings.SQUARE_RTOL) * F.abs("h")


def ratio(a: Column, b: Column) -> Column:
    """a / b; NULL for 0 / 0, an infinity for other divisions by zero."""
    return F.when(b != 0, a / b).when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf))


def shape(area: Column, perimeter: Column) -> Column:
    """Perimeter over that of the most compact arrangement of as many square cells, or over the square of equal area."""
    n = F.round(area / (F.col("w") * F.col("h")))
    k = F.floor(F.sqrt(n))
    least = F.when(n == k * k, 4 * k).when(n <= k * (k + 1), 4 * k + 2).otherwise(4 * k + 4)
    return F.when(square(), ratio(perimeter / F.col("w"), least.cast("double"))).otherwise(ratio(0.25 * perimeter, F.sqrt(area)))


def cell_area() -> Column:
    return F.col("w") * F.col("h")


def area() -> Column:
    return F.col("n") * cell_area()


def perimeter() -> Column:
    return F.col("ns") * F.col("w") + F.col("ew") * F.col("h")


def _ha(x: Column, hectares: bool) -> Column:
    return x / 10000 if hectares else x


def patch(name: str, hectares: bool = True, percent: bool = True, **_) -> Column:
    """A metric of each patch."""
    core = F.col("core") * cell_area()
    if name == "area":
        return _ha(area(), hectares)
    if name == "perimeter":
        return perimeter()
    if name == "perimeter_area_ratio":
        return perimeter() / _ha(area(), hectares)
    if name == "shape_index":
        return shape(area(), perimeter())
    if name == "fractal_dimension":
        return ratio(2 * F.ln(0.25 * perimeter()), F.ln(area()))
    if name == "core_area":
        return _ha(core, hectares)
    if name == "number_of_core_areas":
        return F.col("cores")
    if name == "core_area_index":
        return core / area() * (100 if percent else 1)
    if name == "euclidean_nearest_neighbor":
        return F.sqrt(F.col("squared").cast("double")) * F.when(square(), F.col("w")).otherwise(F.sqrt(cell_area()))
    raise ValueError(f"{name} is not among the patch metrics")


def reduced(m: Column, weight: Column, suffix: str, percent: bool = True) -> Column:
    """A distribution statistic: mean, spread and range skip NULLs; weighted mean, median and coefficient of variation are undefined if there is one."""
    whole = F.count("*") == F.count(m)
    if suffix == "mn":
        return F.avg(m)
    if suffix == "am":
        return F.when(whole, ratio(F.sum(m * weight), F.sum(weight)))
    if suffix == "md":
        return F.when(whole, F.percentile(m, F.lit(0.5)))
    if suffix == "ra":
        return F.max(m) - F.min(m)
    if suffix == "sd":
        return F.stddev_pop(m)
    if suffix == "cv":
        return F.when(whole, ratio(F.stddev_pop(m), F.avg(m)) * (100 if percent else 1))
    raise ValueError(f"{suffix} is not among the statistics")


def patch_aggregate(name: str, hectares: bool = True, percent: bool = True, **_) -> Column | None:
    """A metric that is an aggregate over patches, of a class or of all; None if it is of another kind."""
    a = area()
    if name == "total_area":
        return _ha(F.sum(a), hectares)
    if name == "number_of_patches":
        return F.count("*")
    if name == "total_core_area":
        return _ha(F.sum(F.col("core") * cell_area()), hectares)
    if name == "number_of_disjunct_core_areas":
        return F.sum("cores")
    base, _, suffix = name.rpartition("_")
    if suffix in settings.SUFFIXES and base in settings.DISTRIBUTED and base != "disjunct_core_area":
        m = patch(base, hectares=hectares) if base != "core_area_index" else patch(base, percent=True)
        return reduced(m, a, suffix, percent)
    whole = F.max("landscape_area")
    if name == "proportion_of_landscape":
        return F.sum(a) / whole * (100 if percent else 1)
    if name == "patch_density":
        return F.count("*") / whole * (100 if percent else 1) * (10000 if hectares else 1)
    if name == "largest_patch_index":
        return F.max(a) / whole * (100 if percent else 1)
    if name == "core_area_proportion_of_landscape":
        return F.sum(F.col("core") * cell_area()) / whole * (100 if percent else 1)
    if name == "disjunct_core_area_density":
        return F.sum("cores") / whole * (100 if percent else 1) * (10000 if hectares else 1)
    if name == "effective_mesh_size":
        return _ha(F.sum(a * a) / whole, hectares)
    return None


def core_aggregate(name: str, hectares: bool = True, percent: bool = True, **_) -> Column:
    """Statistics of disjunct core areas, weighted by themselves; over core parts with n cells."""
    m = _ha(area(), hectares)
    return reduced(m, m, name.rpartition("_")[2], percent)


def entropy(n: Column, total: Column) -> Column:
    """-p ln p of one count."""
    p = n / total
    return F.when(n > 0, -p * F.ln(p)).otherwise(0.0)
