"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, only where that is unset (a local test session), one
    temporary folder per process."""
    global _own_dir
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="buildlens-shared-")
    return _own_dir


def reach_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, unless the
    session says otherwise; on a cluster that is a folder all nodes have, or --py-files."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))


def written(df: DataFrame, with_row_id: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back. A lost executor then costs a
    reread, not a recomputation. with_row_id adds a unique row number, which stays fixed
    because it is stored."""
    spark = df.sparkSession
    if with_row_id:
        df = df.withColumn(with_row_id, F.monotonically_increasing_id())
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
