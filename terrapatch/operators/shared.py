"""Tables written once to a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of one task.
ROWS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors reach: the session's. Only where all run on one machine may it be unset, and is a new one then."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="terrapatch-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written and read back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shares(spark: SparkSession, rows: int) -> int:
    """Tasks over which so many rows are dealt: the session's for shuffles, and more where a task had over ROWS rows, so that its memory does not grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))
