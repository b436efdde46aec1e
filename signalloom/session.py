"""Session settings and the shared scratch folder."""

from __future__ import annotations

import pathlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators are tuned for. A cluster keeps its own master,
#: memory and shuffle-partition settings; these only steer the optimizer.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Sessions of a hot recording are merged before they are shuffled.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # A window of 23 x 512 floats is 47 KB, so 500 rows are about 24 MB.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
}


def build_session(master: str | None = None, **extra: str) -> SparkSession:
    """A session with :data:`SETTINGS`; ``master`` only for local runs."""
    builder = SparkSession.builder.appName("signalloom")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, where it is not installed."""
    package = pathlib.Path(__file__).parent
    with tempfile.TemporaryDirectory(prefix="signalloom-") as folder:  # Spark copies the file at once
        archive = shutil.make_archive(f"{folder}/signalloom", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)


#: Folders named by :func:`set_scratch`, and each application's own below the root.
_NAMED: dict[str, str] = {}
_ROOTS: dict[tuple[str, str], str] = {}


def set_scratch(spark: SparkSession) -> None:
    """Name a scratch folder for a one-machine trial session that has none."""
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and context.applicationId not in _NAMED:
        if not context._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        _NAMED[context.applicationId] = tempfile.mkdtemp(prefix="signalloom-")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's folder below ``spark.checkpoint.dir``.

    The setting must name a folder that every executor reaches; without it the
    call is refused unless :func:`set_scratch` named one. The application's folder is deleted
    when its driver ends.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or _NAMED.get(context.applicationId)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    key = (context.applicationId, root)
    if key not in _ROOTS:
        own = f"{root.rstrip('/')}/signalloom-{context.applicationId}"
        path = context._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _ROOTS[key] = own
    return f"{_ROOTS[key]}/{name}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared scratch folder and go on from the written table.

    Used where a reduced result feeds several branches: the branches then read
    a small table instead of repeating the work, a lost executor costs a re-read
    only, and the optimizer sees real sizes when it picks joins.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place)


def publish(write: Callable[[str], None], spark: SparkSession, path: str) -> None:
    """Let ``write`` fill a hidden folder beside ``path``, then rename it: readers see all of a result or nothing.

    A path that exists is refused, before the work and by the rename.
    """
    context = spark.sparkContext
    Path = context._jvm.org.apache.hadoop.fs.Path
    target = Path(path)
    files = target.getFileSystem(context._jsc.hadoopConfiguration())
    if files.exists(target):
        raise FileExistsError(f"{path} exists already")
    parent = target.getParent()
    if parent is not None:
        files.mkdirs(parent)
    staged = Path(parent, f".{target.getName()}-{uuid.uuid4().hex[:12]}")
    try:
        write(staged.toString())
        if files.exists(target) or not files.rename(staged, target):
            raise FileExistsError(f"{path} could not be published")
    finally:
        files.delete(staged, True)
