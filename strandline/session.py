"""Session helpers: configuration for tests and benches, and the shared checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller's session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strandline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors' Python workers, once per context; workers may start in any folder."""
    context = spark.sparkContext
    if getattr(context, "_strandline_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="strandline-ship-")
    context.addPyFile(shutil.make_archive(f"{folder}/strandline_package", "zip", os.path.dirname(package), os.path.basename(package)))
    context._strandline_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests, one machine) a local temporary
    folder takes its place, and is kept in the session so that later calls get the same one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = spark.conf.get("strandline.local.dir", None)
        if not named:
            named = "file://" + tempfile.mkdtemp(prefix="strandline-")
            spark.conf.set("strandline.local.dir", named)
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written to the shared folder, partition by partition, and lineage ends there."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As :func:`cut`, but as a written table: later reads take only the columns they need, and its size is known, so that
    a join broadcasts it where it is below the session's threshold and shuffles it beyond."""
    path = fresh_dir(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
