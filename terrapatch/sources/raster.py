"""Rasters as tables of cells: from arrays, .npy and GeoTIFF files; zones from GeoJSON and WKT."""

from __future__ import annotations

import io
import json
import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "landscape_id string, row int, col int, class_val int"


def _cells(name: str, values: np.ndarray, nodata) -> pd.DataFrame:
    keep = ~np.isnan(values) if values.dtype.kind == "f" else np.ones(values.shape, bool)
    if nodata is not None:
        keep &= values != nodata
    row, col = np.nonzero(keep)
    return pd.DataFrame({"landscape_id": name, "row": row.astype("int32"), "col": col.astype("int32"), "class_val": values[keep].astype("int32")})


def from_array(spark: SparkSession, values: np.ndarray, landscape_id: str = "0", nodata=0) -> DataFrame:
    """Cells of a two-dimensional array of classes; nodata and NaN have none."""
    values = np.asarray(values)
    if values.ndim != 2:
        raise ValueError("a raster has two dimensions")
    return spark.createDataFrame(_cells(landscape_id, values, nodata), CELLS)


def tiff(data: bytes) -> tuple[np.ndarray, dict]:
    """First band of a strip- or tile-organised TIFF, raw, deflate or PackBits, and what its tags say: res, x0, y0, nodata."""
    end = {b"II": "<", b"MM": ">"}[data[:2]]
    if struct.unpack(end + "H", data[2:4])[0] != 42:
        raise ValueError("no classic TIFF")
    at = struct.unpack(end + "I", data[4:8])[0]
    size = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 11: ("f", 4), 12: ("d", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4)}
    tags = {}
    for i in range(struct.unpack(end + "H", data[at : at + 2])[0]):
        tag, kind, n, _ = struct.unpack(end + "HHII", data[at + 2 + 12 * i : at + 14 + 12 * i])
        if kind not in size:
            continue
        fmt, width = size[kind]
        where = at + 10 + 12 * i if n * width <= 4 else struct.unpack(end + "I", data[at + 10 + 12 * i : at + 14 + 12 * i])[0]
        raw = data[where : where + n * width]
        tags[tag] = raw.rstrip(b"\0").decode() if kind == 2 else struct.unpack(f"{end}{n}{fmt}", raw)
    one = lambda t, default=None: tags.get(t, (default,))[0]
    w, h, bits, packed, bands = one(256), one(257), one(258, 1), one(259, 1), one(277, 1)
    dtype = np.dtype(f"{end}{ {1: 'u', 2: 'i', 3: 'f'}[one(339, 1)]}{bits // 8}")
    tiled = 322 in tags
    tw, th = (one(322), one(323)) if tiled else (w, one(278, h))
    offsets, counts = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    out = np.zeros((h, w), dtype.newbyteorder("="))
    across = -(-w // tw)
    planes = across * -(-h // th)
    for k, (o, c) in enumerate(zip(offsets[:planes], counts[:planes], strict=True)):
        raw = data[o : o + c]
        if packed in (8, 32946):
            raw = zlib.decompress(raw)
        elif packed == 32773:
            raw = _unpack_bits(raw)
        elif packed != 1:
            raise ValueError(f"compression {packed} is not supported")
        r, q = k // across * th, k % across * tw
        rows = th if tiled else min(th, h - r)
        step = bands if one(284, 1) == 1 else 1
        block = np.frombuffer(raw, dtype, rows * tw * step).reshape(rows, tw, step).copy()
        if one(317, 1) == 2:  # horizontal differences
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        part = block[: h - r, : w - q, 0]
        out[r : r + part.shape[0], q : q + part.shape[1]] = part
    scale, tie = tags.get(33550), tags.get(33922)
    info = {"res": (scale[0], scale[1]) if scale else None, "x0": None, "y0": None, "nodata": float(tags[42113]) if tags.get(42113) else None}
    if scale and tie:
        info |= {"x0": tie[3] - tie[0] * scale[0], "y0": tie[4] + tie[1] * scale[1]}
    return out, info


def _unpack_bits(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += raw[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def read(spark: SparkSession, path: str, nodata=None) -> DataFrame:
    """Cells (landscape_id: the file's name) of .npy and .tif files, a task for each file. Nodata defaults to the file's own, for .npy to 0."""

    def decode(frames):
        for pdf in frames:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                if name.endswith(".npy"):
                    values, own = np.load(io.BytesIO(data), allow_pickle=False), 0
                else:
                    values, info = tiff(data)
                    own = info["nodata"]
                yield _cells(name.rpartition("/")[2].rpartition(".")[0], values, own if nodata is None else nodata)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, CELLS)


def rings(geometry) -> list[list[tuple[float, float]]]:
    """Rings of a polygon or multipolygon in GeoJSON (text or dict) or WKT."""
    if isinstance(geometry, str) and not geometry.lstrip().startswith("{"):
        if not re.match(r"\s*(MULTI)?POLYGON", geometry, re.I):
            raise ValueError("only polygons are zones")
        return [[tuple(map(float, p.split()[:2])) for p in ring.split(",")] for ring in re.findall(r"\(([^()]+)\)", geometry)]
    g = json.loads(geometry) if isinstance(geometry, str) else geometry
    g = g.get("geometry", g)
    if g["type"] == "Polygon":
        return [[tuple(p[:2]) for p in ring] for ring in g["coordinates"]]
    if g["type"] == "MultiPolygon":
        return [[tuple(p[:2]) for p in ring] for polygon in g["coordinates"] for ring in polygon]
    raise ValueError("only polygons are zones")


def read_zones(spark: SparkSession, path: str, index: str | None = None) -> dict:
    """Polygons {name: geometry} of a GeoJSON file (a collection, a feature or a geometry); names come from a property, or count from 0. They become part of the plan, so they are few."""
    found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    features = found["features"] if found["type"] == "FeatureCollection" else [found]
    names = [str(i if index is None else f["properties"][index]) for i, f in enumerate(features)]
    if len(set(names)) != len(names):
        raise ValueError(f"the values of {index} are not distinct")
    return {n: f.get("geometry", f) for n, f in zip(names, features, strict=True)}


def orders_raster(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Rasters derived from the orders table: iid, blocky or t1; landscape_id is the kind."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    w = width(spark, sf_dir)
    place = [F.floor(F.col("o_orderkey") / w).cast("int").alias("row"), (F.col("o_orderkey") % w).cast("int").alias("col")]
    if kind == "iid":
        value = F.ascii("o_orderpriority") - 48
        cells = orders.select(*place, F.when(value == 5, 0).otherwise(value).alias("class_val"))
    elif kind == "t1":
        cells = orders.select(*place, (F.col("o_custkey") % 5).alias("class_val"))
    elif kind == "blocky":
        at = F.floor(F.col("row") / 3) * w + F.floor(F.col("col") / 3)
        status = orders.select(F.col("o_orderkey").alias("at"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(0).alias("class_val"))
        cells = orders.select(*place).withColumn("at", at).join(status, "at")
    else:
        raise ValueError(kind)
    return cells.select(F.lit(kind).alias("landscape_id"), "row", "col", F.col("class_val").cast("int")).where("class_val <> 0")


def width(spark: SparkSession, sf_dir: str) -> int:
    """Columns of the rasters derived from the orders table, by its rows (a count that the files' footers hold)."""
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    return 50 if n <= 3000 else 100 if n <= 30000 else 300
