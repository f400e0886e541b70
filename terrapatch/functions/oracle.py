"""SQL for DuckDB that computes the registered raster queries another way: patches by a keyed recursive closure."""

from __future__ import annotations

from terrapatch import settings

W = "w AS (SELECT CASE WHEN count(*) <= 3000 THEN 50 WHEN count(*) <= 30000 THEN 100 ELSE 300 END AS w FROM orders)"
_PLACE = "CAST(o_orderkey // w AS INTEGER) AS row, CAST(o_orderkey % w AS INTEGER) AS col"
RASTERS = {
    "iid": f"iid AS (SELECT {_PLACE}, CAST(ascii(o_orderpriority) - 48 AS INTEGER) AS cv FROM orders, w WHERE ascii(o_orderpriority) - 48 <> 5)",
    "t1": f"t1 AS (SELECT {_PLACE}, CAST(o_custkey % 5 AS INTEGER) AS cv FROM orders, w WHERE o_custkey % 5 <> 0)",
    "blocky": f"blocky AS (SELECT p.row, p.col, CASE b.o_orderstatus WHEN 'F' THEN 1 ELSE 2 END AS cv FROM (SELECT {_PLACE}, w FROM orders, w) p JOIN orders b ON b.o_orderkey = (p.row // 3) * w + p.col // 3 WHERE b.o_orderstatus IN ('F', 'O'))",
}
GRID = "(row // 25) * ((w + 24) // 25) + col // 25"
_XY = "(col + 0.5) * 10 AS x, -(row + 0.5) * 10 AS y"
_D = "((col + 0.5) * 10 - 251) ** 2 + (-(row + 0.5) * 10 + 149) ** 2"
_ZONE = "((row + col) // 20) % 4"
_BOTH = "(SELECT 't0' AS date, * FROM blocky UNION ALL SELECT 't1', * FROM t1)"
_TRIANGLE = [(55, -55, 405, -105), (405, -105, 305, -385), (305, -385, 55, -55)]
_CROSSED = " + ".join(f"CAST((({b} > y) <> ({d} > y)) AND x < ({c} - ({a})) * (y - ({b})) / ({d} - ({b})) + ({a}) AS INTEGER)" for a, b, c, d in _TRIANGLE)
#: Sources of cells: the key columns' values, and the rows.
PLAIN = (("0",), "blocky")
TILED = ((GRID,), "blocky, w")
DATED = (("date",), _BOTH)
LABELLED = ((_ZONE,), f"(SELECT * FROM blocky WHERE {_ZONE} <> 0)")
POLYGON = (("'a'",), f"(SELECT row, col, cv FROM (SELECT *, {_XY} FROM blocky) WHERE ({_CROSSED}) % 2 = 1)")
_DIST = "(VALUES (60, 0), (100, 60), (140, 100)) b(far, near)"
DISCS = (("CAST(far AS VARCHAR)",), f"(SELECT * FROM blocky, {_DIST} WHERE {_D} <= far * far)")
RINGS = (("near || '-' || far",), f"(SELECT * FROM blocky, {_DIST} WHERE {_D} <= far * far AND ({_D} > near * near OR near = 0))")
DATED_LABELLED = ((_ZONE, "date"), _BOTH)
DATED_DISCS = (("CAST(far AS VARCHAR)", "date"), f"(SELECT * FROM {_BOTH}, {_DIST} WHERE {_D} <= far * far)")
DATED_GRID = ((GRID, "date"), f"{_BOTH}, w")


def with_cells(kind: str, select: str) -> str:
    return f"WITH {W}, {RASTERS[kind]}, cells AS (SELECT 0 AS k, * FROM {kind}) {select}"


_SIDES = "(VALUES (0, 1, 'horizontal'), (0, -1, 'horizontal'), (1, 0, 'vertical'), (-1, 0, 'vertical')) d(dr, dc, direction)"
ADJACENCY = f"SELECT direction, a.cv AS class_i, b.cv AS class_k, count(*) AS n FROM cells a, {_SIDES} JOIN cells b ON b.k = a.k AND b.row = a.row + dr AND b.col = a.col + dc GROUP BY ALL"


def _closure(name: str, table: str, eight: bool) -> str:
    """Least cell of each cell's component: labels spread until none gets smaller."""
    off = "abs(dr) + abs(dc) > 0" if eight else "abs(dr) + abs(dc) = 1"
    return f"""{name}(k, row, col, cv, root) USING KEY (k, row, col) AS (
        SELECT k, row, col, cv, CAST(row AS BIGINT) * 4294967296 + col FROM {table}
        UNION
        SELECT c.k, c.row, c.col, c.cv, min(l.root)
        FROM {name} l, (SELECT a - 1 AS dr, b - 1 AS dc FROM range(3) x(a), range(3) z(b)) d
        JOIN recurring.{name} c ON c.k = l.k AND c.cv = l.cv AND c.row = l.row + dr AND c.col = l.col + dc
        WHERE {off} AND l.root < c.root
        GROUP BY c.k, c.row, c.col, c.cv)"""


def patches(select: str, eight: bool = True, by_grid: bool = True, source=None, cores: bool = False, enn: bool = False, merge: bool = True) -> str:
    """`select` over patches (k, cv, root, n, ns, ew, core, cores, enn), with key columns k1, k2, ... of each k. Without merge a class is taken as one patch, for metrics that only add up."""
    values, rows = source or (TILED if by_grid else PLAIN)
    keys = ", ".join(f"{v} AS k{i}" for i, v in enumerate(values, 1))
    names = [f"k{i}" for i in range(1, len(values) + 1)]
    whole = f"CAST({' || chr(124) || '.join(f'CAST({n} AS VARCHAR)' for n in names)} AS VARCHAR)" if source else "k1"
    parts = [W, RASTERS["blocky"], RASTERS["t1"], f"keyed AS (SELECT {keys}, row, col, cv FROM {rows})", f"cells AS (SELECT {whole} AS k, {', '.join(names)}, row, col, cv FROM keyed)"]
    beside = lambda dr, dc, i: f"LEFT JOIN cells n{i} ON n{i}.k = a.k AND n{i}.row = a.row + {dr} AND n{i}.col = a.col + {dc}"
    other = lambda i: f"CAST(n{i}.cv IS DISTINCT FROM a.cv AS INTEGER)"
    parts.append("sides AS (SELECT a.k, a.row, a.col, a.cv, " + f"{other(1)} + {other(2)} AS ns, {other(3)} + {other(4)} AS ew FROM cells a " + " ".join(beside(dr, dc, i) for i, (dr, dc) in enumerate(((-1, 0), (1, 0), (0, -1), (0, 1)), 1)) + ")")
    parts.append(_closure("lab", "cells", eight) if merge else "lab AS (SELECT k, row, col, cv, 0 AS root FROM cells)")
    parts.append("base AS (SELECT s.k, s.cv, l.root, count(*) AS n, CAST(sum(ns) AS BIGINT) AS ns, CAST(sum(ew) AS BIGINT) AS ew, count(*) FILTER (ns + ew = 0) AS core FROM sides s JOIN lab l USING (k, row, col) GROUP BY ALL)")
    if cores:
        parts.append("corecells AS (SELECT k, row, col, cv FROM sides WHERE ns + ew = 0)")
        parts.append(_closure("corelab", "corecells", eight))
        parts.append("core_parts AS (SELECT c.k, c.cv, c.root AS croot, min(l.root) AS root, count(*) AS n FROM corelab c JOIN lab l USING (k, row, col) GROUP BY c.k, c.cv, c.root)")
    if enn:
        parts.append("near AS (SELECT a.k, a.root, min((a.row - b.row) ** 2 + (a.col - b.col) ** 2) AS d FROM lab a JOIN lab b ON a.k = b.k AND a.cv = b.cv AND a.root <> b.root GROUP BY a.k, a.root)")
    c = "coalesce((SELECT count(*) FROM core_parts q WHERE q.k = b.k AND q.root = b.root), 0)" if cores else "0"
    e = "10 * sqrt((SELECT d FROM near q WHERE q.k = b.k AND q.root = b.root))" if enn else "NULL"
    parts.append(f"patches AS (SELECT b.*, {c} AS cores, {e} AS enn, 100.0 * sum(n) OVER (PARTITION BY k) AS whole FROM base b)")
    parts.append(f"adj AS (SELECT a.k, a.cv AS ci, b.cv AS ck, count(*) AS n FROM cells a, {_SIDES} JOIN cells b ON b.k = a.k AND b.row = a.row + dr AND b.col = a.col + dc GROUP BY ALL)")
    parts.append(f"names AS (SELECT DISTINCT k, {', '.join(names)} FROM cells)")
    return f"WITH RECURSIVE {', '.join(parts)} {select}"


_A, _P = "(n * 100.0)", "((ns + ew) * 10.0)"


def _shape(cells: str, perimeter: str) -> str:
    k = f"floor(sqrt({cells}))"
    return f"(({perimeter}) / 10.0 / CASE WHEN {cells} = {k} * {k} THEN 4 * {k} WHEN {cells} <= {k} * ({k} + 1) THEN 4 * {k} + 2 ELSE 4 * {k} + 4 END)"


PATCH = {
    "area": f"{_A} / 10000",
    "perimeter": _P,
    "perimeter_area_ratio": f"{_P} / ({_A} / 10000)",
    "shape_index": _shape("n", _P),
    "fractal_dimension": f"2 * ln(0.25 * {_P}) / ln({_A})",
    "core_area": "core * 100.0 / 10000",
    "number_of_core_areas": "cores",
    "core_area_index": "100.0 * core / n",
    "euclidean_nearest_neighbor": "enn",
}


def _reduced(m: str, weight: str, suffix: str) -> str:
    full = lambda x: f"CASE WHEN count(*) = count({m}) THEN {x} END"
    return {
        "mn": f"avg({m})",
        "am": full(f"sum(({m}) * {weight}) / nullif(sum({weight}), 0)"),
        "md": full(f"quantile_cont({m}, 0.5)"),
        "ra": f"max({m}) - min({m})",
        "sd": f"stddev_pop({m})",
        "cv": full(f"100 * stddev_pop({m}) / nullif(avg({m}), 0)"),
    }[suffix]


def _aggregate(name: str) -> str | None:
    simple = {
        "total_area": f"sum({_A}) / 10000",
        "proportion_of_landscape": f"100 * sum({_A}) / max(whole)",
        "number_of_patches": "count(*)",
        "patch_density": "count(*) * 1000000.0 / max(whole)",
        "largest_patch_index": f"100 * max({_A}) / max(whole)",
        "total_core_area": "sum(core) * 100.0 / 10000",
        "core_area_proportion_of_landscape": "100 * sum(core) * 100.0 / max(whole)",
        "number_of_disjunct_core_areas": "CAST(sum(cores) AS BIGINT)",
        "disjunct_core_area_density": "sum(cores) * 1000000.0 / max(whole)",
        "effective_mesh_size": f"sum({_A} * {_A}) / max(whole) / 10000",
    }
    if name in simple:
        return simple[name]
    base, _, suffix = name.rpartition("_")
    if suffix in settings.SUFFIXES and base in PATCH:
        return _reduced(f"({PATCH[base]})", _A, suffix)
    return None


def _round(name: str, sql: str) -> str:
    return f"{sql} AS {name}" if name in ("number_of_patches", "number_of_disjunct_core_areas", "number_of_core_areas") else f"round(CAST({sql} AS DOUBLE), 6) AS {name}"


def patch_frame(names) -> str:
    cols = ", ".join(_round(m, PATCH[m]) for m in names)
    return patches(f"SELECT k AS grid_cell, row_number() OVER (PARTITION BY k ORDER BY cv, root) - 1 AS patch_id, cv AS class_val, {cols} FROM patches", cores="number_of_core_areas" in names, enn="euclidean_nearest_neighbor" in names)


#: Metrics that do not depend on how a class is cut into patches.
ADDITIVE = {"total_area", "proportion_of_landscape", "total_edge", "edge_density", "landscape_shape_index", *settings.ENTROPIES}


def _frame(names, source, keys, by_class: bool, boundary: bool) -> str:
    group = "k, cv" if by_class else "k"
    on = "USING (k, cv)" if by_class else "USING (k)"
    own = [m for m in names if _aggregate(m)]
    dcore = [m for m in names if m.startswith("disjunct_core_area_") and m not in settings.EXTRA]
    edge = [m for m in names if m in ("total_edge", "edge_density", "landscape_shape_index")]
    ent = [m for m in names if m in settings.ENTROPIES]
    joins = [f"(SELECT {group}, {', '.join([*(_round(m, _aggregate(m)) for m in own), 'max(whole) AS tp_whole'])} FROM patches GROUP BY {group}) a"]
    if dcore:
        joins.append(f"LEFT JOIN (SELECT {group}, {', '.join(_round(m, _reduced('(n * 100.0 / 10000)', '(n * 100.0 / 10000)', m.rpartition('_')[2])) for m in dcore)} FROM core_parts GROUP BY {group}) b {on}")
    if edge:
        once = 1 if by_class else 2
        pairs = f"(SELECT k, {'ck AS cv, ' if by_class else ''}sum(n) * 10.0 / {once} AS inside FROM adj WHERE ci <> ck GROUP BY ALL)"
        outer = "p" if by_class else "p - coalesce(inside, 0)"
        length = outer if boundary else "coalesce(inside, 0)"
        sql = {"total_edge": length, "edge_density": f"({length}) * 10000.0 / whole", "landscape_shape_index": _shape("cells", outer)}
        base = f"(SELECT {group}, sum(n) AS cells, sum({_P}) AS p, max(whole) AS whole FROM patches GROUP BY {group})"
        joins.append(f"LEFT JOIN (SELECT {group}, {', '.join(_round(m, sql[m]) for m in edge)} FROM {base} LEFT JOIN {pairs} {on}) c {on}")
    if ent:
        h = "-sum(CASE WHEN n > 0 THEN (n / t) * ln(n / t) END)"
        joint = f"(SELECT k, {h} AS hxy FROM (SELECT k, n, sum(n) OVER (PARTITION BY k) AS t FROM adj) GROUP BY k)"
        own_ = f"(SELECT k, {h} AS hx FROM (SELECT k, n, sum(n) OVER (PARTITION BY k) AS t FROM (SELECT k, ck, sum(n) AS n FROM adj GROUP BY k, ck)) GROUP BY k)"
        sql = {"entropy": "hx / ln(2)", "shannon_diversity_index": "hx", "joint_entropy": "hxy / ln(2)", "conditional_entropy": "(hxy - hx) / ln(2)", "mutual_information": "(2 * hx - hxy) / ln(2)", "relative_mutual_information": "(2 * hx - hxy) / nullif(hx, 0)", "contagion": "100 * (1 - hxy / (2 * ln(m)))"}
        joins.append(f"LEFT JOIN (SELECT k, {', '.join(_round(m, f'CASE WHEN m > 1 THEN {sql[m]} END') for m in ent)} FROM {joint} JOIN {own_} USING (k) JOIN (SELECT k, count(DISTINCT cv) AS m FROM cells GROUP BY k) USING (k)) d USING (k)")
    out = ", ".join([*(f"names.k{i} AS {k}" for i, k in enumerate(keys, 1)), *(["cv AS class_val"] if by_class else []), *names])
    select = f"SELECT {out} FROM {' '.join(joins)} JOIN names USING (k)"
    return patches(select, source=source, cores=bool(dcore) or any("disjunct" in m for m in names), enn=any(m.startswith("euclidean") for m in names), merge=not ADDITIVE.issuperset(names))


def class_frame(names, source=None, keys=("grid_cell",), boundary: bool = False) -> str:
    return _frame(names, source, keys, True, boundary)


def landscape_frame(names, source=None, keys=("grid_cell",), boundary: bool = False) -> str:
    return _frame(names, source, keys, False, boundary)
