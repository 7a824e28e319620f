"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def pin_utc(spark: SparkSession) -> SparkSession:
    """Timestamps without a zone mean UTC everywhere in this library."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by all executors (``spark.checkpoint.dir``).

    Where none is named, a session in one process (tests) gets a temporary
    folder; on a cluster that would be another folder on each machine, so it is
    an error there.
    """
    jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm.isDefined():
        return jvm.get()
    own = spark.conf.get("spark.checkpoint.dir", None) or _temporary(spark.sparkContext.master)
    spark.sparkContext.setCheckpointDir(own)
    return own


def _temporary(master: str) -> str:
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines share; there is none, and the master is {master}")
    return "file://" + tempfile.mkdtemp(prefix="tideline-")


def bounded_batches(spark: SparkSession, rows: int = 1_000, size: int = 16 << 20) -> SparkSession:
    """Batches of at most ``rows`` rows and ``size`` bytes to the Python workers, for jobs on long texts.

    A setting of the session, which no operator changes by itself.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key, None)
        if now is None or not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= most:
            spark.conf.set(key, str(most))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers of all executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="tideline-")) / "tideline_package.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        sc.addPyFile(str(target))
        _SHIPPED.add(sc.applicationId)
    return spark


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back; removed when the driver ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tideline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)
