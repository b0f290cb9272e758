"""Session defaults and the shared working folder."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: What every plan here relies on; a session that already runs keeps its own values for anything else.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "sightline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; on a cluster, leave master to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only where that is unset (tests, a laptop) a temporary folder stands in."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="sightline-")
        spark.conf.set("spark.checkpoint.dir", place)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def workspace(spark: SparkSession) -> str:
    """This application's own folder in the shared one. It is deleted when the driver ends."""
    sc = spark.sparkContext
    place = f"{shared_dir(spark)}/sightline/{sc.applicationId}"
    if getattr(sc, "_sightline_workspace", None) != place:
        sc._sightline_workspace = place
        atexit.register(_cleared, sc, place)
    return place


def _cleared(sc, place: str) -> None:
    if place.startswith("file:"):
        shutil.rmtree("/" + place.removeprefix("file:").lstrip("/"), ignore_errors=True)
        return
    with contextlib.suppress(Exception):  # the application may be gone already
        path = sc._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that it need not be installed on the executors."""
    sc = spark.sparkContext
    if getattr(sc, "_sightline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    place = Path(tempfile.mkdtemp(prefix="sightline-code-")) / "sightline_code.zip"
    with zipfile.ZipFile(place, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(place))
    sc._sightline_shipped = True
