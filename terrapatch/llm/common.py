"""Session settings, shared folders and text chunks used by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the array kernels work on at once; it bounds a Python worker's memory.
CHUNK_BYTES = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors reach: the session's. Only where all run on one machine may it be unset, and is a new one then."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="terrapatch-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one run in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts may be long, and a batch is held whole by a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tp_path = path
    return out


def forgotten(*tables: DataFrame) -> None:
    """Delete what written() wrote. Only for tables that no later plan reads: those made of them have been written themselves."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.tp_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def texts(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string column; nulls are empty."""
    col = batch.column(column) if isinstance(column, str | int) else column
    if col.null_count:
        import pyarrow.compute as pc

        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        wide = np.dtype(np.int64)
    else:
        wide = np.dtype(np.int32)
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, wide, n + 1, col.offset * wide.itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def pieces(data: np.ndarray, offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of segments of about `limit` bytes: (row of each segment, bounds). Longer texts are cut before a space between two other ASCII characters, where every word splitter here cuts too."""
    rows: list[int] = []
    bounds: list[int] = [int(offs[0])]
    for row in range(len(offs) - 1):
        a, b = int(offs[row]), int(offs[row + 1])
        while b - a > limit:
            cut = _safe_cut(data, a + limit, b)
            if cut < 0:
                break
            rows.append(row)
            bounds.append(cut)
            yield np.array(rows, np.int64), np.array(bounds, np.int64)
            rows, bounds, a = [], [cut], cut
        rows.append(row)
        bounds.append(b)
        if b - bounds[0] >= limit:
            yield np.array(rows, np.int64), np.array(bounds, np.int64)
            rows, bounds = [], [b]
    if rows:
        yield np.array(rows, np.int64), np.array(bounds, np.int64)


def _safe_cut(data: np.ndarray, at: int, end: int) -> int:
    step = 1 << 16
    while at < end - 1:
        part = data[at - 1 : min(at + step, end)]
        ok = (part[1:-1] == 32) & (part[:-2] > 32) & (part[:-2] < 127) & (part[2:] > 32) & (part[2:] < 127)
        if ok.any():
            return at + int(ok.argmax())
        at += step - 2
    return -1


def crc_mod(column: str, mod: int):
    """crc32 of the id as text, modulo `mod` (null ids: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(mod))
