"""Session helpers: reading tables, shipping the package to executors, cutting lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give every executor this package, so that Python workers can import it wherever they start. Once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="filingloom-")) / "filingloom_pkg.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def keep_parallel(spark: SparkSession) -> None:
    """Small stages keep all cores busy: where the least size of a partition is unset, it becomes 64 KB. For queries that cost much CPU a byte in few stages."""
    small = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    if spark.conf.get(small, "1MB") in ("1MB", "1048576b"):
        spark.conf.set(small, "64KB")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. In local mode, where that is unset, a folder of this machine; elsewhere that raises."""
    where = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='filingloom-shared-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, label: str = "stage", by: str | None = None, compression: str | None = None) -> str:
    """Write ``df`` once to the shared folder and give its path; ``by``: a folder for each value of that column, which the files don't hold.

    The files are removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/filingloom-{label}-{os.getpid()}-{uuid.uuid4().hex[:12]}"
    writer = df.write.options(**({"compression": compression} if compression else {}))
    (writer.partitionBy(by) if by else writer).parquet(path)
    _remove_at_exit(spark, path)
    return path


def materialize(df: DataFrame, label: str = "stage", compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives the loss of executors."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, label, compression=compression))


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    def remove() -> None:
        try:
            jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the JVM may be gone before us; a folder of this machine can be removed without it
            local = path.removeprefix("file://").removeprefix("file:")
            if local.startswith("/"):
                shutil.rmtree(local, ignore_errors=True)

    atexit.register(remove)


def widen(df: DataFrame, ddl: str, drop: tuple[str, ...] = ()) -> StructType:
    """The schema of ``df`` without ``drop``, followed by the columns of ``ddl``."""
    return StructType([*(f for f in df.schema.fields if f.name not in drop), *StructType.fromDDL(ddl).fields])
