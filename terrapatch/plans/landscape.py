"""Landscapes: metrics of patches, classes and whole rasters, for any number of rasters at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapatch import settings
from terrapatch.functions import metrics as M
from terrapatch.operators import components as C
from terrapatch.operators.shared import written


def check(names, allowed, level: str) -> list[str]:
    names = list(names)
    for name in names:
        if name in settings.UNDEFINED:
            raise NotImplementedError(f"{name} has no definition yet")
        known = {*settings.PATCH, *settings.CLASS, *settings.LANDSCAPE, *settings.EXTRA}
        if name not in known:
            raise ValueError(f"{name} is not among the metrics: {sorted(known)}")
        if name not in allowed:
            raise ValueError(f"{name} cannot be computed at the {level} level")
    return names


class Landscape:
    """Rasters as cells (keys, row, col, class_val); each value of the keys is a raster of its own.

    Cells without data have no row: rows whose class is NULL, NaN or `nodata` are dropped. A cell may be given
    once only for each raster: of repeated cells any one counts for patches and adjacencies. An empty table gives
    empty frames. `res` is (width, height) of a cell, or a table (keys, w, h). The neighbourhood rule is "8" (queen)
    or "4" (rook). `names` are the keys' names in results, if others than in `cells`; within, keys have names of
    their own, so that any name may be chosen but class_val, patch_id and those of metrics.
    """

    def __init__(self, cells: DataFrame, res, keys=("landscape_id",), nodata: int | None = settings.NODATA, neighborhood_rule=None, tile: int = settings.TILE, names=None):
        if res is None:
            raise ValueError("the resolution `res` must be provided")
        rule = str(neighborhood_rule if neighborhood_rule is not None else settings.NEIGHBOURHOOD)
        if rule not in ("4", "8"):
            raise ValueError(f"the neighbourhood rule must be '8' or '4', not {rule!r}")
        self.keys, self.rule, self.tile = list(names or keys), rule, tile
        taken = {"class_val", "patch_id", *settings.PATCH, *settings.CLASS, *settings.LANDSCAPE, *settings.EXTRA} & set(self.keys)
        if taken:
            raise ValueError(f"{sorted(taken)} cannot be names of keys")
        self._k = [f"tp_k{i}" for i in range(len(self.keys))]
        inner = [F.col(f"`{k}`").alias(own) for k, own in zip(keys, self._k, strict=True)]
        self.res = res.select(*inner, F.col("w").cast("double"), F.col("h").cast("double")) if isinstance(res, DataFrame) else res
        value = F.col("class_val")
        keep = value.isNotNull()
        if cells.schema["class_val"].dataType.typeName() in ("double", "float"):
            keep &= ~F.isnan(value)
        if nodata is not None:
            keep &= value != nodata
        self._cells = cells.where(keep).select(*inner, F.col("row").cast("int"), F.col("col").cast("int"), value.cast("int").alias("class_val"))
        self._base: dict = {}
        self._once: DataFrame | None = None  # the cells as written: what they come from may be a join

    @property
    def cells(self) -> DataFrame:
        """The cells that have data."""
        return self._out(self._cells)

    def _out(self, df: DataFrame) -> DataFrame:
        """With the keys under their names."""
        name = dict(zip(self._k, self.keys, strict=True))
        return df.select(*(F.col(f"`{c}`").alias(name.get(c, c)) for c in df.columns))

    # --- base relations -----------------------------------------------------------------------

    def sized(self, df: DataFrame) -> DataFrame:
        """With the cells' width w and height h."""
        if isinstance(self.res, DataFrame):
            return df.join(self.res, self._k)
        w, h = self.res
        return df.withColumn("w", F.lit(float(w))).withColumn("h", F.lit(float(h)))

    def rows(self, depth: int = 1, rim: bool = False) -> DataFrame:
        """Rows of the tile kernel; each depth is run once."""
        if depth < 0:
            raise ValueError("edge_depth cannot be negative")
        for (kept, with_rim), df in self._base.items():
            if kept == depth and (with_rim or not rim):
                return df
        if self._once is None:
            self._once = written(self._cells, "cells")
        found = C.tiles(self._once, self._k, self.tile, self.rule == "8", depth, rim)
        self._base[depth, rim] = found = written(found, "tiles")
        return found

    def _merges(self, depth: int, rim: bool, layer: int):
        name = ("merge", depth if layer else 0, layer)
        if name not in self._base_merges:
            rows = self.rows(depth, rim)
            seams = ("seams", depth)
            if seams not in self._base_merges:  # which layers have any
                found = rows.where(F.col("kind") == C.SEAM).select("c").distinct().collect()
                self._base_merges[seams] = {int(r["c"]) for r in found}
            self._base_merges[name] = C.merged(rows, self._k, layer) if layer in self._base_merges[seams] else None
        return self._base_merges[name]

    @property
    def _base_merges(self) -> dict:
        return self.__dict__.setdefault("_merged", {})

    def _core_parts(self, depth: int = 1, rim: bool = False) -> DataFrame:
        rows = self.rows(depth, rim)
        parts = rows.where(F.col("kind") == C.CORE).select(*self._k, "class_val", F.col("a").alias("core_patch"), F.col("b").alias("root"), F.col("c").alias("n"))
        parts = C.named(parts, self._k, "core_patch", self._merges(depth, rim, 1))
        parts = C.named(parts, self._k, "root", self._merges(depth, rim, 0))
        return parts.groupBy(*self._k, "class_val", "core_patch").agg(F.min("root").alias("patch"), F.sum("n").alias("n"))

    def _patches(self, depth: int = 1, enn: bool = False) -> DataFrame:
        name = ("patches", depth, enn)
        if name in self._base_merges:
            return self._base_merges[name]
        rows = self.rows(depth, enn)
        merges = self._merges(depth, enn, 0)
        parts = rows.where(F.col("kind") == C.PART).select(*self._k, "class_val", F.col("a").alias("root"), F.col("b").alias("n"), F.col("c").alias("ns"), F.col("d").alias("ew"), F.col("e").alias("core"))
        parts = C.named(parts, self._k, "root", merges)
        out = parts.groupBy(*self._k, "class_val", F.col("root").alias("patch")).agg(*(F.sum(c).alias(c) for c in ("n", "ns", "ew", "core")))
        cores = self._core_parts(depth, enn).groupBy(*self._k, "patch").agg(F.count("*").alias("cores"))
        out = out.join(cores, [*self._k, "patch"], "left").withColumn("cores", F.coalesce("cores", F.lit(0)))
        if enn:
            rim = rows.where(F.col("kind") == C.RIM).select(*self._k, "class_val", F.shiftright("a", 32).cast("int").alias("row"), F.col("a").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("col"), F.col("b").alias("root"))
            rim = C.named(rim, self._k, "root", merges).withColumnRenamed("root", "patch")
            out = out.join(C.nearest(rim, self._k), [*self._k, "patch"], "left")
        else:
            out = out.withColumn("squared", F.lit(None).cast("long"))
        out = written(out, "patches")
        whole = out.groupBy(*self._k).agg(F.sum("n").alias("cells"))
        out = self.sized(out.join(whole, self._k)).withColumn("landscape_area", F.col("cells") * M.cell_area()).drop("cells")
        self._base_merges[name] = out
        return out

    def _sums(self, depth: int = 1) -> DataFrame:
        """(keys, class_val, n, ns, ew, core, landscape_area, w, h): what adds up over cells, by class; no patch is put together."""
        parts = self.rows(depth).where(F.col("kind") == C.PART)
        out = parts.groupBy(*self._k, "class_val").agg(*(F.sum(a).alias(b) for a, b in (("b", "n"), ("c", "ns"), ("d", "ew"), ("e", "core"))))
        whole = F.sum("n").over(W.partitionBy(*self._k))  # rows: classes of a raster
        return self.sized(out).withColumn("landscape_area", whole * M.cell_area()).withColumn("cores", F.lit(0).cast("long"))

    def core_parts(self, depth: int = 1) -> DataFrame:
        """(keys, class_val, patch, core_patch, n) of the disjunct core areas."""
        return self._out(self._core_parts(depth))

    def patches(self, depth: int = 1, enn: bool = False) -> DataFrame:
        """(keys, class_val, patch, n, ns, ew, core, cores, squared, landscape_area, w, h); patch is the first cell's row * 2**32 + column."""
        return self._out(self._patches(depth, enn))

    def adjacency(self) -> DataFrame:
        """(keys, direction, class_i, class_k, n): neighbouring cells, horizontal and vertical, each pair from both sides."""
        return self._out(self._adjacency())

    def _adjacency(self) -> DataFrame:
        rows = self.rows().where(F.col("kind") == C.ADJACENT)
        out = rows.groupBy(*self._k, F.when(F.col("b") == 0, "horizontal").otherwise("vertical").alias("direction"), F.col("class_val").alias("class_i"), F.col("a").cast("int").alias("class_k"))
        return out.agg(F.sum("c").alias("n"))

    def labels(self) -> DataFrame:
        """(keys, class_val, patch_id, patch, n): the patches numbered by class and first cell, from 0."""
        order = W.partitionBy(*self._k).orderBy("class_val", "patch")
        return self._out(self._patches().select(*self._k, "class_val", (F.row_number().over(order) - 1).alias("patch_id"), "patch", "n"))

    # --- metrics ------------------------------------------------------------------------------

    def patch_metrics_df(self, metrics=None, metrics_kwargs=None) -> DataFrame:
        """A row for each patch: keys, patch_id, class_val and the metrics."""
        names = check(metrics or settings.PATCH, settings.PATCH, "patch")
        kwargs = metrics_kwargs or {}
        order = W.partitionBy(*self._k).orderBy("class_val", "patch")
        depths = {m: self._depth(kwargs.get(m, {})) for m in names}
        enn = "euclidean_nearest_neighbor" in names
        out = None
        for depth in sorted(set(depths.values())):
            own = [m for m in names if depths[m] == depth]
            part = self._zero_core(self._patches(max(depth, 1), enn), depth).select(*self._k, "class_val", "patch", *(M.patch(m, **kwargs.get(m, {})).alias(m) for m in own))
            out = part if out is None else out.join(part.drop("class_val"), [*self._k, "patch"])
        return self._out(out.withColumn("patch_id", F.row_number().over(order) - 1).select(*self._k, "patch_id", "class_val", *names))

    def _depth(self, kwargs: dict) -> int:
        return int(kwargs.get("edge_depth", 1))

    @staticmethod
    def _zero_core(patches: DataFrame, depth: int) -> DataFrame:
        """A depth of zero erodes until nothing is left."""
        return patches if depth else patches.withColumn("core", F.lit(0).cast("long")).withColumn("cores", F.lit(0).cast("long"))

    def class_metrics_df(self, metrics=None, classes=None, metrics_kwargs=None, fillna: bool = False) -> DataFrame:
        """A row for each class that a raster has: keys, class_val and the metrics. Classes restrict the rows, not what is computed."""
        names = check(metrics or settings.CLASS, {*settings.CLASS, *settings.EXTRA}, "class")
        out = self._out(self._frame(names, [*self._k, "class_val"], metrics_kwargs or {}))
        if classes is not None:
            out = out.where(F.col("class_val").isin(list(classes)))
        return out.na.fill({m: v for m, v in settings.FILL.items() if m in names}) if fillna else out

    def landscape_metrics_df(self, metrics=None, metrics_kwargs=None) -> DataFrame:
        """A row for each raster: keys and the metrics."""
        names = check(metrics or settings.LANDSCAPE, {*settings.LANDSCAPE, *settings.EXTRA}, "landscape")
        return self._out(self._frame(names, self._k, metrics_kwargs or {}))

    def _frame(self, names: list[str], by: list[str], kwargs: dict) -> DataFrame:
        """One aggregation over each base relation that the names need, joined by the keys."""
        enn = any(m.startswith("euclidean") for m in names)
        depths = {m: self._depth(kwargs.get(m, {})) for m in names}
        frames, parted = [], []
        for depth in sorted({max(d, 1) for d in depths.values()}):
            self.rows(depth, enn)  # with the rim cells, where any of the names needs them
        for depth in sorted(set(depths.values())):
            own = {m: M.patch_aggregate(m, **kwargs.get(m, {})) for m in names if depths[m] == depth}
            own = {m: c for m, c in own.items() if c is not None}
            # what adds up over cells needs no patches
            added = [m for m in own if m in settings.ADDITIVE]
            for group, base in ((added, self._sums), ([m for m in own if m not in added], lambda d: self._patches(d, enn))):
                if group:
                    frames.append(self._zero_core(base(max(depth, 1)), depth).groupBy(*by).agg(*(own[m].alias(m) for m in group)))
            cores = [m for m in names if m.startswith("disjunct_core_area_") and m not in settings.EXTRA and depths[m] == depth]
            if cores and depth:
                parts = self.sized(self._core_parts(depth, enn))
                parted.append(parts.groupBy(*by).agg(*(M.core_aggregate(m, **kwargs.get(m, {})).alias(m) for m in cores)))
        edges = [m for m in names if m in ("total_edge", "edge_density", "landscape_shape_index")]
        if edges:
            frames.append(self._edges(by, edges, kwargs))
        entropies = [m for m in names if m in settings.ENTROPIES]
        if entropies:
            frames.append(self._entropies(entropies, kwargs))
        frames = frames or [self._sums().select(*by).distinct()]  # not all have core parts
        out = reduce(lambda a, b: a.join(b, by, "left"), [*frames, *parted])
        none = [m for m in names if m not in out.columns]
        return out.select(*by, *(F.lit(None).cast("double").alias(m) if m in none else F.col(m) for m in names))

    def _edges(self, by: list[str], names: list[str], kwargs: dict) -> DataFrame:
        """Edge lengths. Without the boundary, a length is that of the neighbouring pairs of unlike classes; with it, sides that face no data count too."""
        unlike = self._adjacency().where("class_i <> class_k").withColumnRenamed("class_k", "class_val")
        count = lambda d: F.sum(F.when(F.col("direction") == d, F.col("n")).otherwise(0))
        pairs = unlike.groupBy(*by).agg(count("horizontal").alias("across"), count("vertical").alias("down"))
        base = self._sums().groupBy(*by).agg(F.max("w").alias("w"), F.max("h").alias("h"), F.max("landscape_area").alias("landscape_area"), F.sum(M.area()).alias("a"), F.sum(M.perimeter()).alias("p"))
        base = base.join(pairs, by, "left").na.fill(0, ["across", "down"])
        once = 1 if "class_val" in by else 2  # a class has its side of each pair, a raster both
        across, down = F.col("across") / once, F.col("down") / once
        # for cells that are not square, horizontal pairs count by the width, as in the definition that is followed
        inner = F.when(M.square(), (across + down) * F.col("w")).otherwise(across * F.col("w") + down * F.col("h"))
        outer = F.col("p") if once == 1 else F.col("p") - across * F.col("h") - down * F.col("w")

        def one(name: str) -> Column:
            k = kwargs.get(name, {})
            if name == "landscape_shape_index":
                return M.shape(F.col("a"), outer)
            length = outer if k.get("count_boundary", False) else inner
            return length if name == "total_edge" else length / F.col("landscape_area") * (10000 if k.get("hectares", True) else 1)

        return base.select(*by, *(one(m).alias(m) for m in names))

    def _entropies(self, names: list[str], kwargs: dict) -> DataFrame:
        """Entropies of the adjacency counts, natural; undefined for rasters of one class."""
        joint = self._adjacency().groupBy(*self._k, "class_i", "class_k").agg(F.sum("n").alias("n"))
        joint = joint.withColumn("total", F.sum("n").over(W.partitionBy(*self._k)))  # rows: pairs of a raster's classes
        each = joint.groupBy(*self._k, "class_k").agg(F.sum("n").alias("n"), F.max("total").alias("total"), F.sum(M.entropy(F.col("n"), F.col("total"))).alias("hxy"))
        both = each.groupBy(*self._k).agg(F.sum(M.entropy(F.col("n"), F.col("total"))).alias("hx"), F.sum("hxy").alias("hxy"))
        base = self._sums().groupBy(*self._k).agg(F.count("*").alias("m")).join(both, self._k, "left")

        def one(name: str) -> Column:
            k = kwargs.get(name, {})
            base_ = k.get("base", 2)
            unit = F.ln(F.lit(float(base_))) if base_ else F.lit(1.0)
            hx, hxy = F.col("hx"), F.col("hxy")
            value = {
                "entropy": hx / unit,
                "shannon_diversity_index": hx,
                "joint_entropy": hxy / unit,
                "conditional_entropy": (hxy - hx) / unit,
                "mutual_information": (2 * hx - hxy) / unit,
                "relative_mutual_information": M.ratio(2 * hx - hxy, hx),
                "contagion": (1 - hxy / (2 * F.ln(F.col("m").cast("double")))) * (100 if k.get("percent", True) else 1),
            }[name]
            return F.when(F.col("m") > 1, value)

        return base.select(*self._k, *(one(name).alias(name) for name in names))

    # --- many rasters -------------------------------------------------------------------------

    def classes(self) -> DataFrame:
        """All classes of any raster."""
        return self._cells.select("class_val").distinct()

    def __len__(self) -> int:
        return self._cells.select(*self._k).distinct().count()


def _single(name: str):
    def metric(self, class_val=None, **kwargs) -> DataFrame:
        """The metric alone: of patches for patch metrics, else of the class if one is given, else of the raster."""
        if name in settings.UNDEFINED:
            raise NotImplementedError(f"{name} has no definition yet")
        options = {name: kwargs}
        if name in settings.PATCH:
            out = self.patch_metrics_df([name], options)
            return out if class_val is None else out.where(F.col("class_val") == class_val)
        if class_val is None and name in (*settings.LANDSCAPE, *settings.EXTRA):
            return self.landscape_metrics_df([name], options)
        if class_val is None:
            raise ValueError(f"{name} needs a class")
        return self.class_metrics_df([name], [class_val], options)

    metric.__name__ = name
    return metric


for _name in dict.fromkeys((*settings.PATCH, *settings.CLASS, *settings.LANDSCAPE, *settings.EXTRA, *settings.UNDEFINED)):
    setattr(Landscape, _name, _single(_name))
