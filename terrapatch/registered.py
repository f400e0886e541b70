"""Registered queries of the raster engine and their SQL.

The rasters derive from the orders table (see sources.raster.orders_raster), with cells of
10 x 10 units.  Patch queries take the blocky raster in grid zones of 25 x 25 cells, each a
landscape of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapatch import settings
from terrapatch.functions import oracle as O
from terrapatch.operators import zones as Z
from terrapatch.plans import analyses as A
from terrapatch.plans.landscape import Landscape
from terrapatch.plans.signature import SpatialSignatureAnalysis
from terrapatch.sources import raster as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
RES = (10.0, 10.0)
SIDE = 250


def plain(df: DataFrame) -> DataFrame:
    """Doubles rounded, and NaN as NULL, for comparison."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        out.append(F.round(F.nanvl(c, F.lit(None).cast("double")), 6).alias(f.name) if f.dataType.typeName() == "double" else c)
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def frame(spark, sf_dir) -> Z.Frame:
    w = R.width(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    return Z.Frame(w, -(-n // w), RES)


def grid(spark, sf_dir, kind="blocky", **options) -> A.ZonalGridAnalysis:
    return A.ZonalGridAnalysis(R.orders_raster(spark, sf_dir, kind), frame(spark, sf_dir), zone_width=SIDE, zone_height=SIDE, **options)


def whole(spark, sf_dir, kind, **options) -> Landscape:
    return Landscape(R.orders_raster(spark, sf_dir, kind), RES, **options)


def dates(spark, sf_dir) -> list[DataFrame]:
    return [R.orders_raster(spark, sf_dir, k) for k in ("blocky", "t1")]


def labels(spark, sf_dir) -> DataFrame:
    """Zone labels that are no rectangles: diagonal stripes, 0 for none."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    w = R.width(spark, sf_dir)
    row, col = F.floor(F.col("o_orderkey") / w).cast("int"), (F.col("o_orderkey") % w).cast("int")
    return orders.select(row.alias("row"), col.alias("col"), (F.floor((row + col) / 20) % 4).cast("int").alias("zone"))


# --- scans and base relations ---------------------------------------------------------------

for kind in ("iid", "blocky", "t1"):
    query(f"cells_{kind}", O.with_cells(kind, "SELECT row, col, cv AS class_val FROM cells"))(lambda s, d, kind=kind: R.orders_raster(s, d, kind).select("row", "col", "class_val"))

query("classes", O.with_cells("iid", "SELECT DISTINCT cv AS class_val FROM cells"))(lambda s, d: whole(s, d, "iid").classes())
query("adjacency", O.with_cells("iid", O.ADJACENCY))(lambda s, d: whole(s, d, "iid").adjacency().drop("landscape_id"))
query("total_adjacency", O.with_cells("iid", f"SELECT class_i, class_k, CAST(sum(n) AS BIGINT) AS n FROM ({O.ADJACENCY}) GROUP BY ALL"))(lambda s, d: whole(s, d, "iid").adjacency().groupBy("class_i", "class_k").agg(F.sum("n").alias("n")))
query("patch_labels", O.patches("SELECT k AS grid_cell, cv AS class_val, row_number() OVER (PARTITION BY k ORDER BY cv, root) - 1 AS patch_id, n FROM patches"))(lambda s, d: grid(s, d).labels().drop("patch"))
query("patch_labels_rook", O.patches("SELECT k AS grid_cell, cv AS class_val, row_number() OVER (PARTITION BY k ORDER BY cv, root) - 1 AS patch_id, n FROM patches", eight=False))(lambda s, d: grid(s, d, neighborhood_rule="4").labels().drop("patch"))
query("patch_labels_whole")(lambda s, d: whole(s, d, "blocky", tile=64).labels().select("class_val", "n"))
query("core_parts", O.patches("SELECT k AS grid_cell, cv AS class_val, CAST(n AS BIGINT) AS n FROM core_parts", cores=True))(lambda s, d: grid(s, d).core_parts().select("grid_cell", "class_val", "n"))

# --- metrics one by one ---------------------------------------------------------------------

for m in settings.PATCH:
    query(f"patch_{m}", O.patch_frame([m]))(lambda s, d, m=m: grid(s, d).patch_metrics_df([m]))
SIMPLE_CLASS = [m for m in settings.CLASS if m not in settings.DISTRIBUTIONS] + list(settings.EXTRA)
SIMPLE_LANDSCAPE = [m for m in settings.LANDSCAPE if m not in settings.DISTRIBUTIONS] + list(settings.EXTRA)
for m in SIMPLE_CLASS:
    query(f"class_{m}", O.class_frame([m]))(lambda s, d, m=m: grid(s, d).class_metrics_df([m]))
for m in SIMPLE_LANDSCAPE:
    query(f"landscape_{m}", O.landscape_frame([m]))(lambda s, d, m=m: grid(s, d).landscape_metrics_df([m]))
for base in settings.DISTRIBUTED:
    names = [f"{base}_{x}" for x in settings.SUFFIXES]
    query(f"class_{base}_distribution", O.class_frame(names))(lambda s, d, names=names: grid(s, d).class_metrics_df(names))
    query(f"landscape_{base}_distribution", O.landscape_frame(names))(lambda s, d, names=names: grid(s, d).landscape_metrics_df(names))
for m in ("total_edge", "edge_density"):
    k = {m: {"count_boundary": True}}
    query(f"class_{m}_boundary", O.class_frame([m], boundary=True))(lambda s, d, m=m, k=k: grid(s, d).class_metrics_df([m], metrics_kwargs=k))
    query(f"landscape_{m}_boundary", O.landscape_frame([m], boundary=True))(lambda s, d, m=m, k=k: grid(s, d).landscape_metrics_df([m], k))

# --- frames and analyses --------------------------------------------------------------------

SOME = ["total_area", "proportion_of_landscape", "number_of_patches", "largest_patch_index", "total_edge", "edge_density", "area_mn", "area_cv"]
WHOLE = ["number_of_patches", "total_edge", "edge_density", "shannon_diversity_index", "contagion", "area_mn"]
#: Of large zones: SQL that closes over patches is too slow there, so these have none and are tested against brute force.
LARGE, LARGE_WHOLE = [*SOME, "landscape_shape_index"], [*WHOLE, "landscape_shape_index"]
#: What of them adds up over cells has SQL, under names of its own.
ADDED = ["total_area", "proportion_of_landscape", "total_edge", "edge_density", "landscape_shape_index"]
ADDED_WHOLE = ["total_edge", "edge_density", "landscape_shape_index", "shannon_diversity_index", "contagion"]
query("patch_metrics_df", O.patch_frame(settings.PATCH))(lambda s, d: grid(s, d).patch_metrics_df())
query("class_metrics_df", O.class_frame(settings.CLASS))(lambda s, d: grid(s, d).class_metrics_df())
query("landscape_metrics_df", O.landscape_frame(settings.LANDSCAPE))(lambda s, d: grid(s, d).landscape_metrics_df())
query("spatiotemporal_class_metrics")(lambda s, d: A.SpatioTemporalAnalysis(dates(s, d), RES).class_metrics_df(LARGE))
query("spatiotemporal_class_metrics_added", O.class_frame(ADDED, source=O.DATED, keys=("dates",)))(lambda s, d: A.SpatioTemporalAnalysis(dates(s, d), RES).class_metrics_df(ADDED))
query("spatiotemporal_landscape_metrics")(lambda s, d: A.SpatioTemporalAnalysis(dates(s, d), RES).landscape_metrics_df(LARGE_WHOLE))
query("spatiotemporal_landscape_metrics_added", O.landscape_frame(ADDED_WHOLE, source=O.DATED, keys=("dates",)))(lambda s, d: A.SpatioTemporalAnalysis(dates(s, d), RES).landscape_metrics_df(ADDED_WHOLE))
query("zonal_label_metrics")(lambda s, d: A.ZonalAnalysis(R.orders_raster(s, d, "blocky"), labels(s, d), frame(s, d)).class_metrics_df(LARGE))
query("zonal_label_metrics_added", O.class_frame(ADDED, source=O.LABELLED, keys=("zone",)))(lambda s, d: A.ZonalAnalysis(R.orders_raster(s, d, "blocky"), labels(s, d), frame(s, d)).class_metrics_df(ADDED))
query("zonal_grid_metrics", O.landscape_frame(WHOLE))(lambda s, d: grid(s, d).landscape_metrics_df(WHOLE))
POLYGON = {"a": "POLYGON ((55 -55, 405 -105, 305 -385, 55 -55))"}
query("zonal_polygon_metrics", O.class_frame(SOME, source=O.POLYGON, keys=("zone",)))(lambda s, d: A.ZonalAnalysis(R.orders_raster(s, d, "blocky"), POLYGON, frame(s, d)).class_metrics_df(SOME))
CENTRE, DISTANCES = (251.0, -149.0), (60, 100, 140)
query("buffer_metrics", O.class_frame(SOME, source=O.DISCS, keys=("buffer_dist",)))(lambda s, d: A.BufferAnalysis(R.orders_raster(s, d, "blocky"), CENTRE, DISTANCES, frame(s, d)).class_metrics_df(SOME))
query("buffer_ring_metrics", O.class_frame(SOME, source=O.RINGS, keys=("buffer_dist",)))(lambda s, d: A.BufferAnalysis(R.orders_raster(s, d, "blocky"), CENTRE, DISTANCES, frame(s, d), buffer_rings=True).class_metrics_df(SOME))
query("spatiotemporal_zonal_metrics")(lambda s, d: A.SpatioTemporalZonalAnalysis(dates(s, d), labels(s, d), frame(s, d)).class_metrics_df(LARGE))
query("spatiotemporal_zonal_metrics_added", O.class_frame(ADDED, source=O.DATED_LABELLED, keys=("zone", "date")))(lambda s, d: A.SpatioTemporalZonalAnalysis(dates(s, d), labels(s, d), frame(s, d)).class_metrics_df(ADDED))
query("spatiotemporal_buffer_metrics", O.class_frame(SOME, source=O.DATED_DISCS, keys=("buffer_dist", "date")))(lambda s, d: A.SpatioTemporalBufferAnalysis(dates(s, d), CENTRE, DISTANCES, frame(s, d)).class_metrics_df(SOME))
query("spatiotemporal_grid_metrics", O.class_frame(SOME, source=O.DATED_GRID, keys=("grid_cell", "date")))(lambda s, d: A.SpatioTemporalZonalGridAnalysis(dates(s, d), frame(s, d), zone_width=SIDE, zone_height=SIDE).class_metrics_df(SOME))
query("zonal_statistics", f"SELECT grid_cell, max(edge_density) FILTER (date = 't0') AS t0, max(edge_density) FILTER (date = 't1') AS t1 FROM ({O.landscape_frame(['edge_density'], source=O.DATED_GRID, keys=('grid_cell', 'date'))}) GROUP BY grid_cell")(
    lambda s, d: A.SpatioTemporalZonalGridAnalysis(dates(s, d), frame(s, d), zone_width=SIDE, zone_height=SIDE).zonal_statistics("edge_density")
)
_SIGNED = ["proportion_of_landscape", "area_mn"]
query("signature_matrix", "SELECT c.*, l.edge_density FROM (SELECT grid_cell, " + ", ".join(f"max({m}) FILTER (class_val = {c}) AS {m}_{c}" for m in _SIGNED for c in (1, 2)) + f" FROM ({O.class_frame(_SIGNED)}) GROUP BY grid_cell) c JOIN ({O.landscape_frame(['edge_density'])}) l USING (grid_cell)")(
    lambda s, d: signature(s, d).metrics_df
)


def signature(spark, sf_dir) -> SpatialSignatureAnalysis:
    return SpatialSignatureAnalysis(grid(spark, sf_dir), class_metrics=_SIGNED, landscape_metrics=["edge_density"], classes=[1, 2])


def _loadings(spark, sf_dir):
    a = signature(spark, sf_dir)
    a.decompose(2)
    return a.loadings()


def _sample(spark, sf_dir):
    a = signature(spark, sf_dir)
    return a.sample(a.clusters((3,)), 3, 2)


query("pca_components")(lambda s, d: signature(s, d).decompose(2))
query("pca_loadings")(_loadings)
query("cluster_kmeans")(lambda s, d: signature(s, d).clusters())
query("cluster_gmm")(lambda s, d: signature(s, d).clusters((2, 3), method="gmm"))
query("cluster_sample")(_sample)
query("metric_labels", "SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{label}')" for m, label in sorted(settings.LABELS.items())) + ") AS t(metric, label)")(lambda s, d: s.createDataFrame(sorted(settings.LABELS.items()), "metric string, label string"))
