"""Parquet tables of a dataset folder, and intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the dataset folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per context, wherever it was imported from."""
    context = spark.sparkContext
    if getattr(context, "_claimloom_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    if package.parent.suffix != ".zip":
        folder = tempfile.mkdtemp(prefix="claimloom-ship-")
        atexit.register(shutil.rmtree, folder, True)
        with zipfile.ZipFile(f"{folder}/claimloom_package.zip", "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(f"{folder}/claimloom_package.zip")
    context._claimloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local folder only where it is unset and Spark runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder:
        local = f"{tempfile.gettempdir()}/claimloom-{spark.sparkContext.applicationId}"
        if local not in _local:
            _local.add(local)
            atexit.register(shutil.rmtree, local, True)
        folder = f"file://{local}"
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    Cuts the lineage for tables with several readers. The files survive the loss
    of executors, and keep columns prunable, which a checkpoint would not.
    Zstandard packs tighter, and needs no direct buffers that wait for a collection.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/claimloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_written(spark: SparkSession) -> None:
    """Removes all tables that this application has ``written``; no result that still reads them may be pending."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/claimloom-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = 200_000, size: int = 64 << 20) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows and ``size`` bytes, else as it is.

    Reads no more than ``rows`` + 1 rows; meant for narrow tables that are
    written or cheap to read. Beyond the bounds the join is left to the planner.
    """
    wide = [c for c, kind in df.dtypes if kind in ("string", "binary")]
    n_bytes = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in wide), F.lit(8 * len(df.columns)))
    n, total = df.limit(rows + 1).agg(F.count("*"), F.sum(n_bytes.cast("bigint"))).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df
