"""The raster engine against hand-computed rasters and a brute-force checker."""

import io
import itertools
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapatch import settings
from terrapatch.functions import metrics as M
from terrapatch.operators import zones as Z
from terrapatch.plans import analyses as A
from terrapatch.plans.landscape import Landscape
from terrapatch.plans.signature import SpatialSignatureAnalysis
from terrapatch.sources import raster as R


def landscape(spark, values, res=(1, 1), **options):
    return Landscape(R.from_array(spark, np.array(values)), res, **options)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


RING = [[1, 1, 1, 1], [1, 2, 2, 1], [1, 2, 2, 1], [1, 1, 1, 1]]


def brute(values, eight=True, depth=1):
    """Patches by flood fill: class, first cell, cells, sides, core cells, core areas, squared distance to the next."""
    v = np.array(values)
    h, w = v.shape
    steps = [(a, b) for a, b in itertools.product((-1, 0, 1), repeat=2) if (a or b) and (eight or abs(a) + abs(b) == 1)]
    at = lambda r, c: int(v[r, c]) if 0 <= r < h and 0 <= c < w else 0

    def fill(member):
        label, seen = [], set()
        for r, c in itertools.product(range(h), range(w)):
            if (r, c) in seen or not member(r, c):
                continue
            todo, cells = [(r, c)], []
            seen.add((r, c))
            while todo:
                x, y = todo.pop()
                cells.append((x, y))
                for a, b in steps:
                    n = (x + a, y + b)
                    if n not in seen and 0 <= n[0] < h and 0 <= n[1] < w and member(*n) and v[n] == v[x, y]:
                        seen.add(n)
                        todo.append(n)
            label.append(cells)
        return label

    core = v > 0
    for _ in range(depth):
        inside = lambda r, c, k: 0 <= r < h and 0 <= c < w and core[r, c] and v[r, c] == k  # noqa: E731,B023
        core = np.array([[core[r, c] and all(inside(r + a, c + b, v[r, c]) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))) for c in range(w)] for r in range(h)])
    patches = fill(lambda r, c: v[r, c] > 0)
    cores = fill(lambda r, c: bool(core[r, c]))
    out = []
    for cells in patches:
        k, first, inside = int(v[cells[0]]), min(cells), set(cells)
        others = [c for p in patches if p is not cells and v[p[0]] == k for c in p]
        out.append(
            (
                int(k), (first[0] << 32) + first[1], len(cells),
                sum((at(r - 1, c) != k) + (at(r + 1, c) != k) for r, c in cells), sum((at(r, c - 1) != k) + (at(r, c + 1) != k) for r, c in cells),
                sum(bool(core[c]) for c in cells), sum(p[0] in inside for p in cores),
                min(((r - x) ** 2 + (c - y) ** 2 for r, c in cells for x, y in others), default=None),
            )
        )
    return sorted(out, key=lambda p: p[1])


@pytest.mark.parametrize(("seed", "eight", "depth", "tile"), [(1, True, 1, 7), (2, False, 2, 5), (3, True, 3, 64), (4, True, 1, 4)])
def test_patches_against_brute_force(spark, seed, eight, depth, tile):
    rng = np.random.default_rng(seed)
    v = np.kron(rng.integers(0, 3, (7, 8)), np.ones((3, 3), int))
    v = np.where(rng.random(v.shape) < 0.05, 1, v)
    got = landscape(spark, v, neighborhood_rule="8" if eight else "4", tile=tile).patches(depth, enn=True)
    rows = sorted((tuple(r) for r in got.select("class_val", "patch", "n", "ns", "ew", "core", "cores", "squared").collect()), key=lambda r: r[1])
    assert rows == brute(v, eight, depth)


def test_ring(spark):
    a = landscape(spark, RING)
    patches = {r.class_val: r for r in a.patch_metrics_df().collect()}
    assert patches[1].perimeter == 24 and patches[2].perimeter == 8 and patches[1].area == pytest.approx(12e-4)
    assert patches[2].shape_index == 1 and patches[1].euclidean_nearest_neighbor is None
    assert one(a.landscape_metrics_df(["total_edge"])).total_edge == 8
    assert one(a.landscape_metrics_df(["total_edge"], {"total_edge": {"count_boundary": True}})).total_edge == 24
    assert one(a.landscape_shape_index()).landscape_shape_index == pytest.approx(24 / 16)


def test_one_class_has_no_entropy(spark):
    row = one(landscape(spark, np.ones((4, 4), int)).landscape_metrics_df(settings.ENTROPIES))
    assert all(row[m] is None for m in settings.ENTROPIES)


def test_single_cell(spark):
    row = one(landscape(spark, [[1]]).patch_metrics_df())
    assert row.shape_index == 1 and row.fractal_dimension is None


def test_core(spark):
    solid = landscape(spark, np.ones((5, 5), int))
    for depth, cells in ((1, 9), (2, 1), (3, 0), (0, 0)):
        k = {"core_area": {"edge_depth": depth, "hectares": False}}
        assert one(solid.patch_metrics_df(["core_area"], k)).core_area == cells
    bell = np.zeros((3, 7), int)
    bell[:, :3] = bell[:, 4:] = bell[1, 3] = 1
    row = one(landscape(spark, bell).patch_metrics_df(["number_of_core_areas", "core_area"]))
    assert row.number_of_core_areas == 2


def test_diagonal_pair(spark):
    v = [[1, 0], [0, 1]]
    assert landscape(spark, v).patch_metrics_df(["area"]).count() == 1
    rook = landscape(spark, v, res=(2, 2), neighborhood_rule=4).patch_metrics_df(["euclidean_nearest_neighbor"]).collect()
    assert [r.euclidean_nearest_neighbor for r in rook] == [pytest.approx(2 * math.sqrt(2))] * 2


def test_cells_that_are_not_square(spark):
    a = landscape(spark, [[1, 2]], res=(1, 2))
    assert one(a.landscape_metrics_df(["total_edge"])).total_edge == 1  # by the width, as the definition has it
    assert [r.perimeter for r in a.patch_metrics_df(["perimeter"]).collect()] == [6, 6]


def test_errors(spark):
    a = landscape(spark, RING)
    with pytest.raises(ValueError, match="must be provided"):
        Landscape(R.from_array(spark, np.array(RING)), None)
    with pytest.raises(ValueError):
        landscape(spark, RING, neighborhood_rule="2")
    with pytest.raises(ValueError, match="is not among"):
        a.patch_metrics_df(["foo"])
    for f, m in ((a.patch_metrics_df, "patch_density"), (a.class_metrics_df, "area"), (a.landscape_metrics_df, "proportion_of_landscape")):
        with pytest.raises(ValueError, match="cannot be computed"):
            f([m])
    with pytest.raises(NotImplementedError):
        a.proximity()
    with pytest.raises(ValueError):
        A.snapshots([a.cells], ["a", "b"])
    with pytest.raises(ValueError):
        Z.grid_size(Z.Frame(4, 4))
    with pytest.raises(ValueError):
        R.rings("POINT (1 2)")


def test_ranges_and_relations(spark):
    v = np.random.default_rng(0).integers(0, 4, (12, 12))
    a = landscape(spark, v, res=(100, 100))
    for r in a.patch_metrics_df().collect():
        assert r.shape_index >= 1 and r.area > 0 and r.core_area >= 0 and 0 <= r.core_area_index <= 100
    w = one(a.landscape_metrics_df())
    assert 0 < w.contagion <= 100 and w.entropy > 0 and w.mutual_information >= -1e-9 and w.largest_patch_index <= 100
    assert one(a.entropy(base=10)).entropy < one(a.entropy(base=2)).entropy
    plain, edged = one(a.total_edge()).total_edge, one(a.total_edge(count_boundary=True)).total_edge
    assert plain <= edged
    assert one(a.area_mn(hectares=False)).area_mn == pytest.approx(1e4 * one(a.area_mn()).area_mn)
    assert landscape(spark, v, neighborhood_rule="8").patches().count() <= landscape(spark, v, neighborhood_rule="4").patches().count()
    share = sum(r.proportion_of_landscape for r in a.class_metrics_df(["proportion_of_landscape"]).collect())
    assert share == pytest.approx(100)
    c = a.class_metrics_df(["euclidean_nearest_neighbor_mn", "area_mn"], classes=[1, 999])
    assert [r.class_val for r in c.collect()] == [1]


def test_undefined_values_spread_as_documented(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0), (None, 2.0)], "m double, a double")
    row = one(df.agg(*(M.reduced(F.col("m"), F.col("a"), s).alias(s) for s in settings.SUFFIXES)))
    assert row.mn == 2 and row.ra == 2 and row.sd == 1 and row.am is None and row.md is None and row.cv is None


def test_absent_class_and_fill(spark):
    a = A.SpatioTemporalAnalysis([R.from_array(spark, np.array([[1, 2]])), R.from_array(spark, np.array([[1, 1]]))], (1, 1))
    assert sorted((r.dates, r.class_val) for r in a.class_metrics_df(["total_area"]).collect()) == [("t0", 1), ("t0", 2), ("t1", 1)]
    m = SpatialSignatureAnalysis(a, class_metrics=["proportion_of_landscape"], landscape_metrics=["edge_density"]).metrics_df
    assert {r.dates: r.proportion_of_landscape_2 for r in m.collect()} == {"t0": 50, "t1": None}
    assert len(a) == 2


def test_zones(spark):
    v = np.random.default_rng(5).integers(1, 3, (20, 20))
    cells, frame = R.from_array(spark, v), Z.Frame(20, 20)
    grid = A.ZonalGridAnalysis(cells, frame, num_zone_cols=2, num_zone_rows=2)
    assert sorted(r.grid_cell for r in grid.landscape_metrics_df(["number_of_patches"]).collect()) == [0, 1, 2, 3]
    discs = A.BufferAnalysis(cells, (10, -10), (4, 8), frame).landscape_metrics_df(["effective_mesh_size"])
    rings = A.BufferAnalysis(cells, (10, -10), (4, 8), frame, buffer_rings=True)
    assert {r.buffer_dist for r in discs.collect()} == {"4", "8"}
    n = {r.buffer_dist: r["count"] for r in rings.cells.groupBy("buffer_dist").count().collect()}
    x = np.add.outer((np.arange(20) + 0.5 - 10) ** 2, (np.arange(20) + 0.5 - 10) ** 2)
    assert n == {"0-4": (x <= 16).sum(), "4-8": ((x <= 64) & (x > 16)).sum()}
    box = A.ZonalAnalysis(cells, {"z": "POLYGON ((0 0, 10 0, 10 -5, 0 -5, 0 0))"}, frame)
    assert box.cells.count() == 50
    labels = spark.createDataFrame([(r, c, int(c > 9)) for r in range(20) for c in range(20)], "row int, col int, zone int")
    assert A.ZonalAnalysis(cells, labels, frame).cells.count() == 200
    assert A.SpatioTemporalZonalAnalysis([cells, cells], labels, frame).cells.count() == 800
    assert A.ZonalGridAnalysis(cells, frame, zone_width=8, zone_height=8, offset="center").cells.select("grid_cell").distinct().count() == 9


def test_sources(spark, tmp_path):
    v = np.array([[1, 0, 2], [3, 3, 0]], np.uint8)
    np.save(tmp_path / "a.npy", v)
    packed = zlib.compress(v.tobytes())
    tags = [(256, 4, 1, 3), (257, 4, 1, 2), (258, 3, 1, 8), (259, 3, 1, 8), (273, 4, 1, 8), (278, 4, 1, 2), (279, 4, 1, len(packed)), (339, 3, 1, 1)]
    at = 8 + len(packed)
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHI", t, k, n) + (struct.pack("<I", x) if k == 4 else struct.pack("<HH", x, 0)) for t, k, n, x in tags) + b"\0" * 4
    (tmp_path / "b.tif").write_bytes(b"II*\0" + struct.pack("<I", at) + packed + ifd)
    want = {(0, 0, 1), (0, 2, 2), (1, 0, 3), (1, 1, 3)}
    for name in ("a.npy", "b.tif"):
        got = R.read(spark, f"{tmp_path}/{name}", nodata=0).collect()
        assert {(r.row, r.col, r.class_val) for r in got} == want and got[0].landscape_id == name[0]
    buf = io.BytesIO()
    np.save(buf, np.array([[1.0, np.nan]]))
    assert R.from_array(spark, np.array([[1.0, np.nan]])).count() == 1


def test_signature(spark):
    v = np.random.default_rng(6).integers(1, 4, (24, 24))
    grid = A.ZonalGridAnalysis(R.from_array(spark, v), Z.Frame(24, 24), num_zone_cols=4, num_zone_rows=4)
    s = SpatialSignatureAnalysis(grid, class_metrics=["proportion_of_landscape"], landscape_metrics=["edge_density"], classes=[1])
    scores = np.array([[r.component_0, r.component_1] for r in s.decompose(2).collect()])
    x = np.array([[r[c] for c in s.names] for r in s.metrics_df.collect()], float)
    x = (x - x.mean(0)) / x.std(0)
    assert np.allclose(np.sort(scores.var(0)), np.sort(np.linalg.eigvalsh(np.cov(x.T, ddof=0))), atol=1e-8)
    assert s.loadings().count() == 2
    assert s.clusters((2, 3)).columns == ["grid_cell", "k_2", "k_3"]


def test_zone_files_and_lists(spark, tmp_path):
    """A collection with names, the same polygons as a list, and a name that occurs twice."""
    import json

    square = lambda x: {"type": "Polygon", "coordinates": [[[x, 0], [x + 2, 0], [x + 2, -4], [x, -4], [x, 0]]]}
    features = [{"type": "Feature", "properties": {"id": n, "kind": "k"}, "geometry": square(x)} for n, x in (("a", 0), ("b", 2))]
    path = tmp_path / "zones.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    named = R.read_zones(spark, str(path), "id")
    assert list(named) == ["a", "b"] and list(R.read_zones(spark, str(path))) == ["0", "1"]
    with pytest.raises(ValueError, match="not distinct"):
        R.read_zones(spark, str(path), "kind")
    cells, frame = R.from_array(spark, np.array(RING)), Z.Frame(4, 4)
    got = {(r["zone"], r["class_val"]): r["total_area"] for r in A.ZonalAnalysis(cells, named, frame).class_metrics_df(["total_area"], metrics_kwargs={"total_area": {"hectares": False}}).collect()}
    assert got == {("a", 1): 6, ("a", 2): 2, ("b", 1): 6, ("b", 2): 2}
    zones = Z.by_polygons(cells, frame, [square(0), square(2)]).groupBy("zone").count().collect()
    assert {r["zone"]: r["count"] for r in zones} == {"0": 8, "1": 8}


def test_other_decomposers(spark):
    """Any estimator of vectors may take the place of the principal components."""
    from pyspark.ml.feature import MinMaxScaler

    cells = Z.by_grid(R.from_array(spark, np.random.default_rng(0).integers(1, 3, (8, 8))), Z.Frame(8, 8), num_zone_cols=2, num_zone_rows=2)
    a = SpatialSignatureAnalysis(Landscape(cells, (1, 1), ["grid_cell"]), landscape_metrics=["number_of_patches", "total_edge"])
    rows = a.decompose(decomposer=MinMaxScaler()).collect()
    assert len(rows) == 4 and all(0 <= v <= 1 for r in rows for v in (r["component_0"], r["component_1"]))


def test_more_clusters_than_landscapes(spark):
    cells = Z.by_grid(R.from_array(spark, np.random.default_rng(1).integers(1, 3, (8, 8))), Z.Frame(8, 8), num_zone_cols=2, num_zone_rows=1)
    a = SpatialSignatureAnalysis(Landscape(cells, (1, 1), ["grid_cell"]), landscape_metrics=["number_of_patches", "total_edge"])
    rows = a.clusters((2, 3, 7)).collect()
    assert len(rows) == 2 and all(len({r[c] for r in rows}) == 2 for c in ("k_2", "k_3", "k_7"))


def test_registered_queries_of_large_zones_have_their_patches(spark):
    """Patches of whole dates and of zones that are no rectangles, against brute force on the smallest table."""
    from terrapatch import registered

    sf = "/root/testdata/sf0.001"
    frame = registered.frame(spark, sf)

    def array(cells):
        v = np.zeros((frame.height, frame.width), int)
        for r in cells.collect():
            v[r["row"], r["col"]] = r["class_val"]
        return v

    dated = dict(zip(("t0", "t1"), map(array, registered.dates(spark, sf)), strict=True))
    zone = np.zeros_like(dated["t0"])
    for r in registered.labels(spark, sf).collect():
        zone[r["row"], r["col"]] = r["zone"]
    zones = [z for z in np.unique(zone) if z]
    want = {
        "spatiotemporal_class_metrics": (("dates",), {(d,): v for d, v in dated.items()}),
        "spatiotemporal_landscape_metrics": (("dates",), {(d,): v for d, v in dated.items()}),
        "zonal_label_metrics": (("zone",), {(str(z),): np.where(zone == z, dated["t0"], 0) for z in zones}),
        "spatiotemporal_zonal_metrics": (("zone", "date"), {(str(z), d): np.where(zone == z, v, 0) for z in np.unique(zone) for d, v in dated.items()}),
    }
    for name, (keys, rasters) in want.items():
        rows, seen = registered.QUERIES[name](spark, sf).collect(), set()
        for r in rows:
            at = tuple(str(r[k]) for k in keys)
            patches = brute(rasters[at])
            total = sum(p[2] for p in patches)
            n = [p[2] for p in patches if "class_val" not in r or p[0] == r["class_val"]]
            seen.add((*at, r["class_val"] if "class_val" in r else None))
            assert r["number_of_patches"] == len(n) and r["area_mn"] == pytest.approx(np.mean(n) / 100, abs=1e-6), (name, r)
            if "class_val" in r:
                assert r["largest_patch_index"] == pytest.approx(100 * max(n) / total, abs=1e-5)
        assert {s[:-1] for s in seen} == set(rasters) and len(seen) == len(rows)


@pytest.mark.parametrize("name", ["w", "h", "a", "kind", "row", "col", "n", "patch", "resolution"])
def test_attributes_of_any_name(spark, name):
    """The keys' names do not meet those of inner columns."""
    one, two = np.array([[1, 1, 2], [1, 2, 2]]), np.array([[1, 2, 2], [2, 2, 2]])
    multi = A.MultiLandscape([R.from_array(spark, v) for v in (one, two)], name, ["x", "y"], (2, 2))
    got = {(r[name], r.class_val): (r.total_area, r.number_of_patches) for r in multi.class_metrics_df(["total_area", "number_of_patches"]).collect()}
    assert got == {(k, c): (pytest.approx((v == c).sum() * 4 / 1e4), 1) for k, v in (("x", one), ("y", two)) for c in (1, 2)}


def test_names_that_results_use_are_refused(spark):
    cells = R.from_array(spark, np.ones((2, 2)))
    for name in ("class_val", "patch_id", "total_area"):
        with pytest.raises(ValueError, match="cannot be names"):
            A.MultiLandscape([cells], name, ["x"], (1, 1))


def test_sums_and_entropies_build_no_patches(spark, monkeypatch):
    def never(*args, **kwargs):
        raise AssertionError("patches were built")

    ls = landscape(spark, np.random.default_rng(3).integers(1, 4, (9, 9)))
    monkeypatch.setattr(ls, "_patches", never)
    monkeypatch.setattr(ls, "_merges", never)
    row = ls.landscape_metrics_df(["entropy", "contagion", "total_edge", "landscape_shape_index", "total_area"]).first()
    assert row.total_area == pytest.approx(81 / 1e4) and 0 < row.entropy <= math.log2(3)
    assert ls.class_metrics_df(["total_area", "proportion_of_landscape", "edge_density"]).count() == 3


def test_empty_raster(spark):
    cells = R.from_array(spark, np.ones((2, 2))).limit(0)
    ls = Landscape(cells, (1, 1))
    assert ls.patch_metrics_df().collect() == [] and ls.class_metrics_df().collect() == [] and ls.landscape_metrics_df(["entropy"]).collect() == []


def test_many_polygons_equal_the_even_odd_rule(spark):
    """Zones that overlap, reach out of the raster, have holes, and cross chunks of columns."""
    rng = np.random.default_rng(8)
    frame = Z.Frame(600, 9, (2.0, 3.0), x0=-50.0, y0=7.0)
    cells = R.from_array(spark, np.ones((9, 600)))
    zones = {}
    for i in range(12):
        c, n = rng.uniform([-100, -25], [1200, 10]), rng.integers(3, 9)
        outer = [(float(c[0] + rng.uniform(-400, 400)), float(c[1] + rng.uniform(-12, 12))) for _ in range(n)]
        hole = [(float(c[0] + dx), float(c[1] + dy)) for dx, dy in ((-20, -3), (20, -3), (0, 5))]
        zones[f"z{i}"] = {"type": "Polygon", "coordinates": [[*outer, outer[0]], [*hole, hole[0]]]}
    got = {(r.zone, r.row, r.col) for r in Z.by_polygons(cells, frame, zones).collect()}
    want = set()
    for name, geometry in zones.items():
        for r in range(9):
            for c in range(600):
                x, y, inside = -50 + (c + 0.5) * 2, 7 - (r + 0.5) * 3, False
                for ring in geometry["coordinates"]:
                    for (x1, y1), (x2, y2) in itertools.pairwise(ring):
                        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                            inside = not inside
                if inside:
                    want.add((name, r, c))
    assert got == want and len(want) > 1000
    assert Z.by_polygons(cells, frame, []).collect() == []


def test_many_small_rasters_go_through_the_kernel_at_a_time(spark):
    """Rasters of all sizes in one call of the kernel, under keys that include NaN and names; none touches another."""
    import pyarrow as pa

    from terrapatch.operators import components as C

    rng = np.random.default_rng(9)
    keys = [*(float(i) for i in range(40)), math.nan]
    rasters = [rng.integers(0, 3, (rng.integers(1, 12), rng.integers(1, 12))) for _ in keys]
    rasters[3], rasters[4] = np.ones((1, 70), int), np.ones((70, 1), int)
    cells = [(k, r, c, int(v[r, c])) for k, v in zip(keys, rasters, strict=True) for r in range(v.shape[0]) for c in range(v.shape[1]) if v[r, c]]
    table = pa.table(dict(zip(("k", "row", "col", "v"), map(list, zip(*cells, strict=True)), strict=True)))
    for size in (10, 1 << 16):  # groups that go on in the next batch, and all in one
        found = list(C.whole_groups(table.to_batches(max_chunksize=7), ["k"], size))
        assert sum(t.num_rows for t, _ in found) == len(cells)
        for t, starts in found:
            k = t["k"].to_pylist()
            assert len({str(k[i]) for i in starts}) == len(starts) == len({str(x) for x in k})
    [(t, starts)] = found
    assert len(starts) > 35
    got = Landscape(spark.createDataFrame([(str(k), *x) for k, *x in cells], "k string, row int, col int, class_val int"), (1, 1), ["k"], tile=16).patches(1, enn=True)
    rows = sorted(tuple(r) for r in got.select("k", "class_val", "patch", "n", "ns", "ew", "core", "cores", "squared").collect())
    assert rows == sorted((str(k), *p) for k, v in zip(keys, rasters, strict=True) for p in brute(v))


def test_nearest_patches_of_small_rasters_at_a_time_and_of_large_ones_by_buckets(spark, monkeypatch):
    """Both ways equal brute force; the tasks of each grow in number with the cells, so that none grows in memory."""
    from terrapatch.operators import components as C
    from terrapatch.operators import shared

    rng = np.random.default_rng(11)
    rasters = {f"r{i}": np.where(rng.random((rng.integers(1, 9), w)) < p, rng.integers(1, 3, (1, w)), 0) for i, (w, p) in enumerate([(8, 0.5), (6, 0.2), (30, 0.1), (30, 0.02), (40, 0.5), (7, 0.9)])}
    rasters["far"] = np.zeros((3, 60), int)
    rasters["far"][1, [0, 3, 59]] = 1
    cells = spark.createDataFrame([(k, r, c, int(v[r, c])) for k, v in rasters.items() for r, c in np.argwhere(v).tolist()], "k string, row int, col int, class_val int")
    want = sorted((k, p[1], p[-1]) for k, v in rasters.items() for p in brute(v) if p[-1] is not None)
    rim = Landscape(cells, (1, 1), ["k"]).rows(1, True).where(F.col("kind") == C.RIM).select(F.col("tp_k0").alias("k"), "class_val", F.shiftright("a", 32).cast("int").alias("row"), F.col("a").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("col"), F.col("b").alias("patch"))
    rows = lambda df: sorted(tuple(r) for r in df.select("k", "patch", "squared").collect())
    monkeypatch.setattr(shared, "ROWS", 20)
    n = rim.count()
    whole = C.nearest_at_once(rim, ["k"])
    assert n > 80 and whole.rdd.getNumPartitions() == -(-n // 20) > 4
    assert rows(whole) == want and rows(C.nearest_by_buckets(rim, ["k"])) == want
    seen = []
    by_buckets = C.nearest_by_buckets
    monkeypatch.setattr(C, "nearest_by_buckets", lambda rim, keys: seen.extend(r.k for r in rim.select("k").distinct().collect()) or by_buckets(rim, keys))
    monkeypatch.setattr(settings, "TILE", 20)
    assert rows(C.nearest(rim, ["k"])) == want and set(seen) == {k for k, v in rasters.items() if np.ptp(np.nonzero(v)[1]) >= 20}
    seen.clear()
    monkeypatch.setattr(settings, "TILE", 256)
    assert rows(C.nearest(rim, ["k"])) == want and not seen


@pytest.mark.parametrize("name", ["class_euclidean_nearest_neighbor_distribution", "class_metrics_df", "landscape_euclidean_nearest_neighbor_distribution", "landscape_metrics_df", "patch_metrics_df"])
def test_registered_zones_need_no_buckets(spark, monkeypatch, name):
    """Zones smaller than a tile are solved in arrays, though tiles cut some of them."""
    from terrapatch import registered
    from terrapatch.operators import components as C

    def never(*args, **kwargs):
        raise AssertionError("cells met by buckets")

    monkeypatch.setattr(C, "nearest_by_buckets", never)
    assert registered.QUERIES[name](spark, "/root/testdata/sf0.001").columns[0] == "grid_cell"
