"""Analyses of many landscapes: snapshots in time, zones, buffers, grids, and their products."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapatch.operators import zones as Z
from terrapatch.plans.landscape import Landscape


#: The key column of snapshots before it has its name.
INNER = "tp_date"


def snapshots(landscapes: list[DataFrame], dates=None, key: str = INNER) -> DataFrame:
    """Cells of several rasters under their dates (t0, t1, ... if none are given)."""
    dates = [f"t{i}" for i in range(len(landscapes))] if dates is None else [str(d) for d in dates]
    if len(dates) != len(landscapes):
        raise ValueError("the lists of landscapes and of dates differ in length")
    return reduce(DataFrame.unionByName, (c.select("row", "col", "class_val", F.lit(d).alias(key)) for c, d in zip(landscapes, dates, strict=True)))


class MultiLandscape(Landscape):
    """Landscapes under an attribute of any name."""

    def __init__(self, landscapes: list[DataFrame], attribute: str, values, res, **options):
        values = [str(v) for v in values]
        super().__init__(snapshots(landscapes, values), res, [INNER], names=[attribute], **options)


class SpatioTemporalAnalysis(Landscape):
    """Snapshots of one region; key: dates."""

    def __init__(self, landscapes: list[DataFrame], res, dates=None, **options):
        super().__init__(snapshots(landscapes, dates), res, [INNER], names=["dates"], **options)


class _Zonal(Landscape):
    key = "zone"

    def zonal_statistics(self, metric: str, class_val: int | None = None, metrics_kwargs=None) -> DataFrame:
        """A row for each zone; snapshots, if there are any, become columns."""
        kwargs = metrics_kwargs or {}
        frame = self.landscape_metrics_df([metric], kwargs) if class_val is None else self.class_metrics_df([metric], [class_val], kwargs)
        others = [k for k in self.keys if k != self.key]
        if not others:
            return frame.groupBy(self.key).agg(F.avg(metric).alias(metric))
        return frame.groupBy(self.key).pivot(others[0]).agg(F.avg(metric))


class ZonalAnalysis(_Zonal):
    """Zones by label table (row, col, zone) or polygons (GeoJSON or WKT, as {name: polygon} or a list); patches end at their zone."""

    def __init__(self, cells: DataFrame, zones, frame: Z.Frame, zone_nodata: int | None = 0, **options):
        cells = Z.by_labels(cells, zones, zone_nodata) if isinstance(zones, DataFrame) else Z.by_polygons(cells, frame, zones)
        super().__init__(cells, frame.res, ["zone"], **options)


class BufferAnalysis(_Zonal):
    """Discs, or rings, around a point."""

    key = "buffer_dist"

    def __init__(self, cells: DataFrame, base, buffer_dists, frame: Z.Frame, buffer_rings: bool = False, **options):
        super().__init__(Z.by_distance(cells, frame, base, buffer_dists, buffer_rings), frame.res, ["buffer_dist"], **options)


class ZonalGridAnalysis(_Zonal):
    """Zones of a regular grid."""

    key = "grid_cell"

    def __init__(self, cells: DataFrame, frame: Z.Frame, num_zone_cols=None, num_zone_rows=None, zone_width=None, zone_height=None, offset=None, **options):
        super().__init__(Z.by_grid(cells, frame, num_zone_cols, num_zone_rows, zone_width, zone_height, offset), frame.res, ["grid_cell"], **options)


class SpatioTemporalZonalAnalysis(_Zonal):
    """Zones of each snapshot; keys: zone, date. Without zone_nodata every label is a zone."""

    def __init__(self, landscapes: list[DataFrame], zones, frame: Z.Frame, dates=None, zone_nodata: int | None = None, **options):
        cells = snapshots(landscapes, dates, "date")
        cells = Z.by_labels(cells, zones, zone_nodata) if isinstance(zones, DataFrame) else Z.by_polygons(cells, frame, zones)
        super().__init__(cells, frame.res, ["zone", "date"], **options)


class SpatioTemporalBufferAnalysis(_Zonal):
    key = "buffer_dist"

    def __init__(self, landscapes: list[DataFrame], base, buffer_dists, frame: Z.Frame, buffer_rings: bool = False, dates=None, **options):
        super().__init__(Z.by_distance(snapshots(landscapes, dates, "date"), frame, base, buffer_dists, buffer_rings), frame.res, ["buffer_dist", "date"], **options)


class SpatioTemporalZonalGridAnalysis(_Zonal):
    key = "grid_cell"

    def __init__(self, landscapes: list[DataFrame], frame: Z.Frame, dates=None, num_zone_cols=None, num_zone_rows=None, zone_width=None, zone_height=None, offset=None, **options):
        cells = Z.by_grid(snapshots(landscapes, dates, "date"), frame, num_zone_cols, num_zone_rows, zone_width, zone_height, offset)
        super().__init__(cells, frame.res, ["grid_cell", "date"], **options)
