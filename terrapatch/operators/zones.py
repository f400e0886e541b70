"""Zones: which cells of a raster belong to which part of the plane."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapatch.sources.raster import rings


@dataclass(frozen=True)
class Frame:
    """Where a raster lies: upper left corner, cell size, and cells down and across."""

    width: int
    height: int
    res: tuple[float, float] = (1.0, 1.0)
    x0: float = 0.0
    y0: float = 0.0

    def x(self):
        return F.lit(self.x0) + (F.col("col") + 0.5) * F.lit(float(self.res[0]))

    def y(self):
        return F.lit(self.y0) - (F.col("row") + 0.5) * F.lit(float(self.res[1]))


def by_labels(cells: DataFrame, labels: DataFrame, zone_nodata: int | None = 0, key: str = "zone") -> DataFrame:
    """Cells joined with (row, col, zone); cells of the background zone have none."""
    labels = labels if zone_nodata is None else labels.where(F.col("zone") != zone_nodata)
    return cells.join(labels.select("row", "col", F.col("zone").alias(key)), ["row", "col"])


def by_distance(cells: DataFrame, frame: Frame, centre: tuple[float, float], distances, rings_: bool = False, key: str = "buffer_dist") -> DataFrame:
    """Cells whose centre is within each distance of a point, or within its ring between that and the next smaller distance."""
    distances = sorted(float(d) for d in distances)
    if not distances or distances[0] <= 0:
        raise ValueError("buffer distances must be positive")
    squared = (frame.x() - F.lit(float(centre[0]))) ** 2 + (frame.y() - F.lit(float(centre[1]))) ** 2
    near = cells.withColumn("tp_d", squared).where(F.col("tp_d") <= distances[-1] ** 2)
    label = lambda d: f"{d:g}"
    found = []
    for low, high in zip([0.0, *distances], distances, strict=False):
        name = f"{label(low)}-{label(high)}" if rings_ else label(high)
        inside = (F.col("tp_d") <= high * high) & ((F.col("tp_d") > low * low) | F.lit(not rings_ or low == 0))
        found.append(F.when(inside, F.lit(name)))
    return near.withColumn(key, F.explode(F.array_compact(F.array(*found)))).drop("tp_d")


def grid_size(frame: Frame, num_zone_cols=None, num_zone_rows=None, zone_width=None, zone_height=None) -> tuple[float, float, int, int]:
    """Width and height of a grid's zones, and how many there are across and down; sizes are whole units."""
    w, h = frame.width * frame.res[0], frame.height * frame.res[1]

    def one(total, n, size, name):
        if size is not None:
            return float(size), math.ceil(total / size)
        if n is not None:
            size = float(math.ceil(total / n))
            return size, math.ceil(total / size)
        raise ValueError(f"either num_zone_{name}s or zone_{'width' if name == 'col' else 'height'} must be provided")

    zw, nc = one(w, num_zone_cols, zone_width, "col")
    zh, nr = one(h, num_zone_rows, zone_height, "row")
    return zw, zh, nc, nr


def by_grid(cells: DataFrame, frame: Frame, num_zone_cols=None, num_zone_rows=None, zone_width=None, zone_height=None, offset=None, key: str = "grid_cell") -> DataFrame:
    """Cells with the row-major number of their grid zone; zones without cells are gaps in the numbers. offset "center" shifts the grid by half its overhang."""
    zw, zh, nc, nr = grid_size(frame, num_zone_cols, num_zone_rows, zone_width, zone_height)
    dx = dy = 0.0
    if offset == "center":
        dx, dy = (nc * zw - frame.width * frame.res[0]) / 2, (nr * zh - frame.height * frame.res[1]) / 2
    elif offset is not None:
        raise ValueError("offset must be None or 'center'")
    c = F.floor((frame.x() - F.lit(frame.x0 - dx)) / F.lit(zw))
    r = F.floor((F.lit(frame.y0 + dy) - frame.y()) / F.lit(zh))
    return cells.withColumn(key, (r * nc + c).cast("int"))


#: Columns of one row of a raster that meet the zones' spans together.
CHUNK = 256


def by_polygons(cells: DataFrame, frame: Frame, zones, key: str = "zone") -> DataFrame:
    """Cells whose centre lies in each polygon (GeoJSON or WKT; even-odd rule). Zones are {name: polygon}, or a list, whose names count from 0.

    Edges are a table: where they cross a row of cells they bound the spans of that row that are inside, which meet
    the cells by row and chunk of columns. The plan is the same for any number of zones and corners.
    """
    zones = zones if isinstance(zones, dict) else dict(enumerate(zones))
    edges = [(str(name), *map(float, (*a, *b))) for name, geometry in zones.items() for ring in rings(geometry) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True) if a[1] != b[1]]
    w, h = map(float, frame.res)
    found = cells.sparkSession.createDataFrame(edges, "tp_zone string, x1 double, y1 double, x2 double, y2 double")
    first = F.greatest(F.lit(0), F.floor((F.lit(float(frame.y0)) - F.greatest("y1", "y2")) / h) - 1).cast("int")
    last = F.least(F.lit(frame.height - 1), F.floor((F.lit(float(frame.y0)) - F.least("y1", "y2")) / h) + 1).cast("int")
    found = found.where(first <= last).withColumn("row", F.explode(F.sequence(first, last)))
    y = frame.y()
    found = found.where((F.col("y1") > y) != (F.col("y2") > y)).select("tp_zone", "row", ((F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")).alias("c"))
    crossed = found.groupBy("tp_zone", "row").agg(F.sort_array(F.collect_list("c")).alias("c"))  # as many as the zone has edges
    spans = F.transform(F.sequence(F.lit(0), F.floor(F.size("c") / 2).cast("int") - 1), lambda k: F.struct(F.get("c", 2 * k).alias("low"), F.get("c", 2 * k + 1).alias("high")))
    spans = crossed.select("tp_zone", "row", F.explode(spans).alias("tp_span"))
    at = lambda x: F.floor((x - F.lit(float(frame.x0))) / w / CHUNK).cast("int")
    begin, end = F.greatest(F.lit(0), at(F.col("tp_span.low"))), F.least(F.lit(frame.width // CHUNK), at(F.col("tp_span.high")))
    spans = spans.where(begin <= end).withColumn("tp_chunk", F.explode(F.sequence(begin, end)))
    x = frame.x()
    met = cells.withColumn("tp_chunk", F.floor(F.col("col") / CHUNK).cast("int")).join(spans, ["row", "tp_chunk"])
    inside = met.where((x >= F.col("tp_span.low")) & (x < F.col("tp_span.high")))
    return inside.withColumn(key, F.col("tp_zone")).select(*cells.columns, key)
