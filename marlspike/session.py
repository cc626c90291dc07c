"""Session, table and staging helpers shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "marlspike", master: str = "local[8]", partitions: int = 8) -> SparkSession:
    """A session with the settings the plans are written for (AQE, UTC, Arrow)."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the executors' Python workers import this package wherever the driver found it: Spark serves the
    zipped sources from the driver to every executor, also to one that joins later. Once an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    from pathlib import Path

    package = Path(__file__).resolve().parent
    if package.is_dir():
        folder = Path(tempfile.mkdtemp(prefix="marlspike-sources-"))
        shutil.copytree(package, folder / "tree" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(str(folder / package.name), "zip", folder / "tree"))
        shutil.rmtree(folder / "tree")
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that setting is absent (tests, a local session) a temporary folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        hadoop = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = hadoop.get() if hadoop.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="marlspike-")
        atexit.register(shutil.rmtree, named.removeprefix("file://"), True)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: the lineage ends there,
    so a lost executor costs no recomputation of what lies before it."""
    ship(df.sparkSession)
    path = scratch(df.sparkSession, label)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name near `wanted` that `df` does not use (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name = "_" + name
    return name
