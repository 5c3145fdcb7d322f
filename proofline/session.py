"""Session and table helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import py_compile
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the benchmark. Clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("proofline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application, compiled so that workers start fast."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    tmp = tempfile.mkdtemp(prefix="proofline-")  # Spark serves the file from here while the application runs
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    at = Path(tmp, f"{root.name}.zip")
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(root.rglob("*.py")):
            name = f.relative_to(root.parent)
            code = py_compile.compile(
                str(f), cfile=f"{tmp}/code.pyc", dfile=str(name),
                invalidation_mode=py_compile.PycInvalidationMode.UNCHECKED_HASH,
            )
            z.write(f, name)
            z.write(code, name.with_suffix(".pyc"))
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named test table."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; only where none is set (tests, local mode) a temporary one is made."""
    sc = spark.sparkContext
    have = spark.conf.get("spark.checkpoint.dir", None)
    if have:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(have)
        return have
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "proofline-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage through the shared folder (never a local checkpoint: an executor may be lost)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def scratch(spark: SparkSession) -> str:
    """The name of a new folder in the shared folder; it is removed when the driver ends."""
    at = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    atexit.register(_try_remove, spark, at)
    return at


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, each computed once (``checkpoint`` computes them twice); it is removed
    when the driver ends."""
    spark = df.sparkSession
    at = scratch(spark)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def _try_remove(spark: SparkSession, folder: str) -> None:
    try:
        remove(spark, folder)
    except Exception:  # the session has ended before
        pass


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of this library's own, wherever it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
