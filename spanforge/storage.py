"""Tables in the shared folder, and broadcasts behind a check."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table up to which it is broadcast.
SMALL = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: what ``spark.checkpoint.dir`` names.

    Only where that is unset and Spark runs in this one process, a temporary
    folder is made and recorded in the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder")
        base = tempfile.mkdtemp(prefix="spanforge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, as ``--py-files`` would."""
    sc = spark.sparkContext
    if getattr(sc, "spanforge_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="spanforge-")) / "spanforge.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc.spanforge_shipped = True


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks that ran on it, and
    never what has been written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df`` for broadcast if it has few rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
