"""Session helpers: a tuned local session and the shared working folder.

Intermediate tables that cut lineage are written below the folder the cluster
names in ``spark.checkpoint.dir``; every executor sees it, so a lost executor
costs a re-read and nothing else.  Only where that setting is absent and the
master is a local one (tests, a laptop) a folder of our own below the system's
temporary folder is used.  What is written there is named by application and
deleted when the application ends.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  #: else they stay until the driver happens to collect its garbage

_own_root: str | None = None
_shipped: set[str] = set()
_swept: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).parent
    out = Path(tempfile.mkdtemp(prefix="quillstone-ship-")) / "quillstone.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(out))


def local_session(app: str = "quillstone", cpus: int | None = None, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    b = (
        SparkSession.builder.master(f"local[{cpus or '*'}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables; on a cluster the session has to name one that all executors see."""
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_root is None:
        _own_root = "file://" + tempfile.mkdtemp(prefix="quillstone-")
    return _own_root


def work_dir(spark: SparkSession, name: str) -> str:
    """A new, unique folder name below the shared root (not yet created); the application's folder goes when its JVM ends."""
    home = f"{shared_root(spark)}/quillstone/{spark.sparkContext.applicationId}"
    if home not in _swept:
        _swept.add(home)
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and the shuffles it took are deleted at once."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable ``checkpoint()`` in the shared folder; never a local one."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


def drop_own_root() -> None:
    """Remove the fall-back folder of this process."""
    global _own_root
    if _own_root and os.path.isdir(_own_root[7:]):
        shutil.rmtree(_own_root[7:], ignore_errors=True)
    _own_root = None
