"""Session helpers. Jobs run on whatever session the cluster hands over; these only fill gaps."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()
_OWN_DIR: dict[str, str] = {}


def local_session(cpus: int = 8, partitions: int | None = None) -> SparkSession:
    """Session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("corpuslens")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as spark.checkpoint.dir names it.

    Only a local master, where all executors share the driver's disk, may fall back to a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _OWN_DIR:
        _OWN_DIR[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        context.setCheckpointDir(_OWN_DIR[context.applicationId])
    return _OWN_DIR[context.applicationId]


def fresh_path(spark: SparkSession, label: str) -> str:
    """New path below the shared folder, so reruns never overwrite each other."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "corpuslens_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def use_utc(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
