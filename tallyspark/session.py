"""Sessions, and sending the package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()
_cleared: set[str] = set()


def session(app: str = "tallyspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; what is given, or set by spark-submit, goes first."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see, below spark.checkpoint.dir; where that is unset and Spark runs in this process, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-tallyspark-")
    return f"{of_application(spark, folder)}/{uuid.uuid4().hex}"


def of_application(spark: SparkSession, folder: str) -> str:
    """The application's own part of a shared folder. What stands there is of use while the application runs, and goes when its driver ends in order."""
    path = f"{folder}/tallyspark-{spark.sparkContext.applicationId}"
    if path not in _cleared:
        _cleared.add(path)
        atexit.register(_clear, spark, path)
    return path


def _clear(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  Spark has ended before: only what this machine sees can be cleared
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="tallyspark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "tallyspark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(ROOT.rglob("*.py")):
            z.write(file, f"{ROOT.name}/{file.relative_to(ROOT)}")
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
