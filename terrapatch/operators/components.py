"""Patches of a raster: labelling in tiles, and the merge of labels across the tiles' seams."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapatch import settings
from terrapatch.operators.shared import shares, written

#: Kinds of rows that the tile kernel returns.
PART, CORE, ADJACENT, SEAM, MAP, RIM = range(6)
#: Seams of one raster up to which its graph is solved in one task, in bounded memory; larger ones go by rounds.
AT_ONCE = 1 << 20
ROW = "kind int, class_val int, a long, b long, c long, d long, e long"
#: Rows that a task takes up at a time at least, and cells of an array in which it lays out small rasters.
AT_A_TIME, STACK = 1 << 16, 1 << 18


def hooked(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least node of each node's component in a graph of n nodes with edges i-j: roots hook to smaller roots until nothing moves."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root = up
    return root


def labelled(code: np.ndarray, eight: bool) -> np.ndarray:
    """Index of the first cell of each cell's component (cells of code 0: their own). Nodes of the graph are the runs of one code along a row."""
    h, w = code.shape
    begins = np.ones((h, w), bool)
    begins[:, 1:] = (code[:, 1:] != code[:, :-1]) | (code[:, 1:] == 0)
    run = (np.cumsum(begins.ravel()) - 1).reshape(h, w)
    first = np.flatnonzero(begins.ravel())
    pairs = [(np.s_[:-1, :], np.s_[1:, :])]
    if eight:
        pairs += [(np.s_[:-1, :-1], np.s_[1:, 1:]), (np.s_[:-1, 1:], np.s_[1:, :-1])]
    ends = []
    for x, y in pairs:
        same = (code[x] == code[y]) & (code[x] > 0)
        i, j = run[x][same], run[y][same]
        if len(i):  # two runs that touch do so along many cells in a row
            fresh = np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            ends.append((i[fresh], j[fresh]))
    i, j = (np.concatenate(x) for x in zip(*ends, strict=True)) if ends else (np.empty(0, np.int64),) * 2
    return first[hooked(len(first), i, j)][run]


def whole_groups(frames, by: list[str], rows: int = AT_A_TIME):
    """(table, starts of its groups) from Arrow batches sorted by the columns `by`: many whole groups at a time, so that the work on each is not paid for alone. Holds `rows` rows, or twice the largest group."""
    import pyarrow as pa

    def starts(table):
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for c in by:  # codes, in which NULL and NaN equal themselves
            at = table[c].combine_chunks().dictionary_encode("encode")
            at = (at.combine_chunks() if isinstance(at, pa.ChunkedArray) else at).indices.to_numpy(zero_copy_only=False)
            new[1:] |= at[1:] != at[:-1]
        return np.flatnonzero(new)

    held, n, need = [], 0, rows
    for batch in frames:
        held.append(batch)
        n += batch.num_rows
        if n < need or not n:
            continue
        table = pa.Table.from_batches(held)
        at = starts(table)
        if at[-1]:
            yield table.slice(0, at[-1]), at[:-1]
        held, n = table.slice(at[-1]).to_batches(), table.num_rows - int(at[-1])
        need = max(rows, 2 * n)
    if n:
        table = pa.Table.from_batches(held)
        yield table, starts(table)


def stacks(high: np.ndarray, wide: np.ndarray, gap: int):
    """Groups of rectangles of like widths; a group's rectangles, one below the other with `gap` around, fill no more than STACK cells unless one does."""
    order = np.argsort(wide, kind="stable")
    begin, tall = 0, 0
    for k, g in enumerate(order):
        more = int(high[g]) + 2 * gap
        if k > begin and (tall + more) * (int(wide[g]) + 2 * gap) > STACK:
            yield order[begin:k]
            begin, tall = k, 0
        tall += more
    if begin < len(order):
        yield order[begin:]


def tile_rows(starts, rows, cols, values, tr, tc, tile: int, eight: bool, depth: int, rim: bool):
    """All rows of many tiles, as (tile, kind, class_val, a, b, c, d, e), from their cells and those around them, `depth` deep (one at least). Tiles begin at `starts`; tr and tc are their places."""
    halo = max(depth, 1)
    size = np.diff(np.append(starts, len(rows)))
    of = np.repeat(np.arange(len(starts)), size)
    # the part of each tile that holds its cells
    r0, r1 = np.maximum(np.minimum.reduceat(rows, starts), tr * tile), np.minimum(np.maximum.reduceat(rows, starts), tr * tile + tile - 1) + 1
    c0, c1 = np.maximum(np.minimum.reduceat(cols, starts), tc * tile), np.minimum(np.maximum.reduceat(cols, starts), tc * tile + tile - 1) + 1
    some = np.flatnonzero((r1 > r0) & (c1 > c0))
    classes, number = np.unique(values, return_inverse=True)
    out: list[tuple] = []
    for group in stacks((r1 - r0)[some], (c1 - c0)[some], halo):
        group = some[group]
        place = np.full(len(starts), -1)
        place[group] = np.arange(len(group))
        at = place[of]
        near = (at >= 0) & (rows >= r0[of] - halo) & (rows < r1[of] + halo) & (cols >= c0[of] - halo) & (cols < c1[of] + halo)
        _stack_rows(out, group, at[near], rows[near], cols[near], number[near] + 1, classes, r0[group], r1[group], c0[group], c1[group], tr[group], tc[group], tile, eight, depth, rim)
    if not out:
        return [np.empty(0, np.int64)] * 8
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _stack_rows(out, group, at, rows, cols, codes, classes, r0, r1, c0, c1, tr, tc, tile, eight, depth, rim):
    """Of tiles that lie one below the other in one array, each with its halo, so that none touches the next."""
    halo = max(depth, 1)
    high = r1 - r0 + 2 * halo
    base = np.cumsum(high) - high
    tall, width = int(high.sum()), int((c1 - c0).max()) + 2 * halo
    code = np.zeros((tall, width), np.int64)
    code[base[at] + rows - r0[at] + halo, cols - c0[at] + halo] = codes
    tile_of = np.repeat(np.arange(len(group)), high)
    row = np.arange(tall) - base[tile_of] + r0[tile_of] - halo
    col = np.arange(width)[None, :] + (c0[tile_of] - halo)[:, None]
    inside = ((row >= r0[tile_of]) & (row < r1[tile_of]))[:, None] & (col >= c0[tile_of][:, None]) & (col < c1[tile_of][:, None])
    # the outermost rows and columns are halo and may go
    mid = np.s_[1:-1, 1:-1]
    shift = lambda dr, dc, x=code: x[1 + dr : tall - 1 + dr, 1 + dc : width - 1 + dc]
    own = np.where(inside, code, 0)[mid]
    here = own > 0
    tile_of, row, col = tile_of[1:-1], row[1:-1], col[mid]
    cell = (row[:, None] << 32) + col
    cells = cell.ravel()
    owner = np.broadcast_to(tile_of[:, None], own.shape)
    around = {(dr, dc): shift(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc}
    name = classes[np.maximum(own, 1) - 1]

    def add(kind, tiles, class_val, a, b=0, c=0, d=0, e=0):
        n = len(a)
        if n:
            out.append(tuple(np.broadcast_to(np.asarray(x, np.int64), n) for x in (group[tiles], kind, class_val, a, b, c, d, e)))

    def firsts(root, mine):
        """Indices of the components' first cells, and for each cell of `mine` the number of its component."""
        flat = root.ravel()
        is_first = (flat == np.arange(flat.size)) & mine.ravel()
        return np.flatnonzero(is_first), (np.cumsum(is_first) - 1)[root[mine]]

    # sides: a neighbour across is of another class or there is none
    ns = (around[-1, 0] != own).astype(np.int64) + (around[1, 0] != own)
    ew = (around[0, -1] != own).astype(np.int64) + (around[0, 1] != own)
    # cells that stay after `depth` erosions by the 4-cross; what tiles above and below do to the halo does not reach the tile
    core = code.copy()
    for _ in range(depth):
        grown = np.zeros_like(core)
        inner = core[1:-1, 1:-1]
        keep = (inner > 0) & (core[:-2, 1:-1] == inner) & (core[2:, 1:-1] == inner) & (core[1:-1, :-2] == inner) & (core[1:-1, 2:] == inner)
        grown[1:-1, 1:-1] = np.where(keep, inner, 0)
        core = grown
    core = np.where(inside, core, 0)[mid]
    root = labelled(own, eight)
    local, number = firsts(root, here)
    sums = lambda x: np.bincount(number, x[here], len(local)).astype(np.int64)
    add(PART, owner.ravel()[local], name.ravel()[local], cells[local], np.bincount(number, minlength=len(local)), sums(ns), sums(ew), sums(core > 0))
    kinds = len(classes) + 1
    for direction, steps in ((0, ((0, -1), (0, 1))), (1, ((-1, 0), (1, 0)))):
        pair = np.concatenate([(owner[ok] * kinds + own[ok]) * kinds + around[s][ok] for s in steps for ok in [here & (around[s] > 0)]])
        pair, n = np.unique(pair, return_counts=True)
        add(ADJACENT, pair // kinds**2, classes[pair // kinds % kinds - 1], classes[pair % kinds - 1], direction, n)
    layers = [(0, own, root)]
    if (core > 0).any():
        core_root = labelled(core, eight)
        locals_, number = firsts(core_root, core > 0)
        add(CORE, owner.ravel()[locals_], name.ravel()[locals_], cells[locals_], cells[root.ravel()[locals_]], np.bincount(number, minlength=len(locals_)))
        layers.append((1, core, core_root))
    # the rows and columns that touch the next tiles
    top, left = (tr * tile)[tile_of], (tc * tile)[tile_of][:, None]
    first_row, last_row = row == top, row == top + tile - 1
    first_col, last_col = col == left, col == left + tile - 1
    edge = first_row[:, None] | first_col | last_col
    for layer, mine, root_ in layers:
        on = edge & (mine > 0)
        add(MAP, owner[on], name[on], cell[on], cells[root_[on]], layer)
        for dr, dc in ((0, 1), (1, 0), *(((1, 1), (1, -1)) if eight else ())):
            out_of = np.zeros(own.shape, bool)
            if dr:
                out_of[last_row, :] = True
            if dc > 0:
                out_of |= last_col
            if dc < 0:
                out_of |= first_col
            # whether the cell beyond is core is known in its own tile, whose MAP rows hold core cells only
            met = out_of & (mine > 0) & (around[dr, dc] == mine)
            add(SEAM, owner[met], name[met], cells[root_[met]], cell[met] + (dr << 32) + dc, layer)
    if rim:
        inner = here.copy()
        for s in around if eight else ((-1, 0), (1, 0), (0, -1), (0, 1)):
            inner &= around[s] == own
        on = here & ~inner
        add(RIM, owner[on], name[on], cell[on], cells[root[on]])


def in_groups(df: DataFrame, keys: list[str], more: list[str], run, columns: str, rows: int) -> DataFrame:
    """As groupBy(keys, more).applyInPandas over `rows` rows, but for many groups at a time: run(table, starts) returns for each row of the result where its group starts, and its columns, all integers."""
    n = shares(df.sparkSession, rows)
    kind = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), columns])
    names = [c.split()[0] for c in columns.split(", ")]
    types = {"int": np.int32, "long": np.int64}
    of = [types[c.split()[1]] for c in columns.split(", ")]

    def each(frames):
        import pyarrow as pa

        for table, starts in whole_groups(frames, [*keys, *more]):
            first, *found = run(table, starts)
            if len(first):
                out = {k: table[k].combine_chunks().take(pa.array(first)) for k in keys}
                yield from pa.table({**out, **{c: pa.array(x.astype(t)) for c, x, t in zip(names, found, of, strict=True)}}).to_batches(max_chunksize=AT_A_TIME)

    # as many tasks as the session has for shuffles at least: little input is much work here, which must not meet in one task
    return df.repartition(n, *keys, *more).sortWithinPartitions(*keys, *more).mapInArrow(each, kind)


def numbers(table, *names: str) -> list[np.ndarray]:
    if any(table[c].null_count for c in names):
        raise ValueError(f"{names} cannot be NULL")
    return [table[c].to_numpy().astype(np.int64) for c in names]


def tiles(cells: DataFrame, keys: list[str], tile: int, eight: bool, depth: int, rim: bool) -> DataFrame:
    """Rows of the tile kernel for all rasters; a cell near a tile's border is sent to the tiles beyond as well, so a group never exceeds a tile and its halo."""
    halo = max(depth, 1)
    if halo >= tile:
        raise ValueError("edge_depth must be less than the tile")
    over = lambda c: F.array_distinct(F.array(*(F.floor((F.col(c) + F.lit(d)) / F.lit(tile)).cast("int") for d in (-halo, 0, halo))))
    dealt = cells.select(*keys, "row", "col", "class_val", F.explode(over("row")).alias("tile_r")).withColumn("tile_c", F.explode(over("col")))

    def run(table, starts):
        rows, cols, values, tr, tc = numbers(table, "row", "col", "class_val", "tile_r", "tile_c")
        of, *found = tile_rows(starts, rows, cols, values, tr[starts], tc[starts], tile, eight, depth, rim)
        return starts[of], *found

    return in_groups(dealt, keys, ["tile_r", "tile_c"], run, ROW, cells.count())


def merged(rows: DataFrame, keys: list[str], layer: int) -> DataFrame | None:
    """(keys, root, patch) of the local roots that a seam joins with others; None if there are no seams."""
    seams = rows.where((F.col("kind") == SEAM) & (F.col("c") == layer)).select(*keys, F.col("a").alias("u"), F.col("b").alias("cell"))
    known = rows.where((F.col("kind") == MAP) & (F.col("c") == layer)).select(*keys, F.col("a").alias("cell"), F.col("b").alias("v"))
    edges = seams.join(known, [*keys, "cell"]).where("u <> v").select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "seams")
    most = edges.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if not most:
        return None
    found = components_at_once(edges, keys) if most <= AT_ONCE else components(edges, keys)
    return found.select(*keys, F.col("u").alias("root"), F.col("v").alias("patch"))


def components_at_once(edges: DataFrame, keys: list[str]) -> DataFrame:
    """As components(), for graphs of at most AT_ONCE edges in each raster: many rasters at a time."""

    def run(table, starts):
        u, v = numbers(table, "u", "v")
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(u))))
        of, node = np.concatenate([of, of]), np.concatenate([u, v])
        order = np.lexsort((node, of))
        of, node = of[order], node[order]
        fresh = np.concatenate([[True], (of[1:] != of[:-1]) | (node[1:] != node[:-1])])
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(fresh) - 1
        of, node = of[fresh], node[fresh]
        root = hooked(len(node), at[: len(u)], at[len(u) :])
        up = np.flatnonzero(root < np.arange(len(node)))
        return starts[of[up]], node[up], node[root[up]]

    return written(in_groups(edges, keys, [], run, "u long, v long", edges.count()), "stars")


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, u, v): each node above the least of its component with that one. Edges have u > v. Stars alternate: larger neighbours go to the least of a neighbourhood, then smaller ones do. That nothing changed is seen by the number of edges and a sum of their hashes."""
    seen, now = None, edges
    while True:
        both = now.unionByName(now.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, [*keys, "u"]).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "stars")
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(least, [*keys, "u"]).select(*keys, F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = written(small.select(*keys, "e.u", "e.v").where("u <> v").distinct(), "stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now
        seen = state


def named(rows: DataFrame, keys: list[str], column: str, merges: DataFrame | None) -> DataFrame:
    """Local roots in a column replaced by their patch."""
    if merges is None:
        return rows
    return rows.join(merges.withColumnRenamed("root", column), [*keys, column], "left").withColumn(column, F.coalesce("patch", column)).drop("patch")


def nearest(rim: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, patch, squared): least squared distance in cells from each patch to another of its class, over rim cells (keys, class_val, row, col, patch). Classes of one patch have no row.

    Rasters no larger than a tile are laid out in arrays, many at a time; of larger ones, cells meet by buckets.
    """
    rim = written(rim, "rim")
    span = lambda c: F.max(c).cast("long") - F.min(c) >= settings.TILE
    large = written(rim.groupBy(*keys).agg((span("row") | span("col")).alias("large")).where("large").select(*keys), "large")
    if large.isEmpty():
        return nearest_at_once(rim, keys)
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys))
    large = large.select(*(F.col(k).alias(f"{k}_") for k in keys))
    return nearest_at_once(rim.join(large, on, "left_anti"), keys).unionByName(nearest_by_buckets(rim.join(large, on, "left_semi"), keys))


#: Offsets of cells that are tried one by one, by their squared length: those of length 1 join cells of one patch.
OFFSETS = sorted((r * r + c * c, r, c) for r in range(-8, 9) for c in range(-8, 9) if 2 <= r * r + c * c <= 64)


def least_squared(starts: np.ndarray, rows: np.ndarray, cols: np.ndarray, classes: np.ndarray, patches: np.ndarray):
    """(raster, patch, squared) of the patches whose class has another in their raster, from the rim cells of many rasters that begin at `starts`."""
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
    order = np.lexsort((patches, classes, of))  # a class's patches are next to each other
    of, rows, cols, classes, patches = (x[order] for x in (of, rows, cols, classes, patches))
    new_class = np.concatenate([[True], (of[1:] != of[:-1]) | (classes[1:] != classes[:-1])])
    new = new_class | np.concatenate([[True], patches[1:] != patches[:-1]])
    patch, group = np.cumsum(new) - 1, np.cumsum(new_class) - 1
    of_patch, class_of, name = of[new], group[new], patches[new]
    begin = np.append(np.flatnonzero(new), len(rows))
    open_ = np.bincount(class_of)[class_of] > 1
    squared = np.full(len(name), -1)
    top, left = (np.full(len(starts), np.iinfo(np.int64).max) for _ in range(2))
    low, right = -top, -left
    for least, most, x in ((top, low, rows), (left, right, cols)):
        np.minimum.at(least, of, x)
        np.maximum.at(most, of, x)
    gap = 8
    for stack in stacks(low - top + 1, right - left + 1, gap):
        place = np.full(len(starts), -1)
        place[stack] = np.arange(len(stack))
        high = (low - top)[stack] + 1 + 2 * gap
        width = int((right - left)[stack].max()) + 1 + 2 * gap
        cell = np.flatnonzero(place[of] >= 0)
        where = ((np.cumsum(high) - high)[place[of[cell]]] + rows[cell] - top[of[cell]] + gap) * width + cols[cell] - left[of[cell]] + gap
        there = np.full(int(high.sum()) * width, -1)
        there[where] = patch[cell]
        class_at = np.append(class_of, -1)  # of no patch
        last = 0
        for d, r, c in OFFSETS:
            if d > last:
                left_over = open_[patch[cell]]
                cell, where, last = cell[left_over], where[left_over], d
                if not len(cell):
                    break
                mine, kind = patch[cell], class_of[patch[cell]]
            other = there[where + r * width + c]
            hit = mine[(class_at[other] == kind) & (other != mine)]
            squared[hit] = d
            open_[hit] = False
    # patches that lie alone meet all cells of their class
    class_begin = np.append(np.flatnonzero(new_class), len(rows))
    for p in np.flatnonzero(open_):
        b, e = class_begin[class_of[p]], class_begin[class_of[p] + 1]
        other = np.concatenate([np.arange(b, begin[p]), np.arange(begin[p + 1], e)])
        step = max(1, STACK // len(other))
        for i in range(begin[p], begin[p + 1], step):
            own = np.s_[i : min(i + step, begin[p + 1]), None]
            d = ((rows[own] - rows[other]) ** 2 + (cols[own] - cols[other]) ** 2).min()
            squared[p] = d if squared[p] < 0 else min(squared[p], d)
    found = squared >= 0
    return of_patch[found], name[found], squared[found]


def nearest_at_once(rim: DataFrame, keys: list[str]) -> DataFrame:
    """As nearest(), for rasters no larger than a tile."""

    def run(table, starts):
        of, *found = least_squared(starts, *numbers(table, "row", "col", "class_val", "patch"))
        return starts[of], *found

    return in_groups(rim, keys, [], run, "patch long, squared long", rim.count())


def nearest_by_buckets(rim: DataFrame, keys: list[str]) -> DataFrame:
    """As nearest(), for rasters of any size.

    Cells meet others of their own and the eight adjacent buckets, unless those hold no other patch, so that a patch
    that lies alone does not meet itself; a distance within the buckets' side is final, and patches without one go on
    with buckets four times as large.
    """
    group = [*keys, "class_val"]
    several = rim.groupBy(*group).agg(F.min("patch").alias("x"), F.max("patch").alias("y")).where("x <> y").select(*group)
    rim = written(rim.join(several, group), "rim")
    left, out, side, cells = rim, [], 4, rim.count()
    reach = rim.agg(F.max("row") - F.min("row"), F.max("col") - F.min("col")).first()
    reach = max(reach[0] or 0, reach[1] or 0) + 1
    while True:
        bucket = lambda c: F.floor(F.col(c) / F.lit(side)).cast("long")  # noqa: E731,B023
        other = rim.select(*group, F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("patch").alias("p2"), bucket("row").alias("br"), bucket("col").alias("bc"))
        near = F.array(F.lit(-1), F.lit(0), F.lit(1))
        around = lambda df: df.withColumn("br", F.explode(F.transform(near, lambda d: F.col("br0") + d))).withColumn("bc", F.explode(F.transform(near, lambda d: F.col("bc0") + d)))  # noqa: E731,B023
        # buckets with whom else they may meet: the least and the greatest patch around
        held = rim.groupBy(*group, bucket("row").alias("br0"), bucket("col").alias("bc0")).agg(F.min("patch").alias("x"), F.max("patch").alias("y"))
        mixed = around(held).groupBy(*group, F.col("br").alias("br0"), F.col("bc").alias("bc0")).agg(F.min("x").alias("x"), F.max("y").alias("y")).where("x <> y").drop("x", "y")
        ask = left.select(*group, "row", "col", "patch", (bucket("row")).alias("br0"), (bucket("col")).alias("bc0"))
        ask = written(ask.join(mixed, [*group, "br0", "bc0"], "left_semi"), "ask")
        # dealt by their number, as more cells must not make a task larger
        by = [*group, "br", "bc"]
        n = shares(rim.sparkSession, 9 * ask.count() + cells)
        ask, other = around(ask).repartition(n, *by), other.repartition(n, *by)
        d = (F.col("row") - F.col("r2")).cast("long") * (F.col("row") - F.col("r2")) + (F.col("col") - F.col("c2")).cast("long") * (F.col("col") - F.col("c2"))
        found = ask.join(other, by).where("patch <> p2").groupBy(*group, "patch").agg(F.min(d).alias("squared"))
        if side < reach:
            found = found.where(F.col("squared") <= side * side)
        found = written(found, "nearest")
        out.append(found)
        if side >= reach:
            break
        left = written(left.join(found, [*group, "patch"], "left_anti"), "rim-left")
        if left.isEmpty():
            break
        side *= 4
    return reduce(DataFrame.unionByName, out).select(*keys, "patch", "squared")
