"""Session settings the library relies on."""

from __future__ import annotations

import atexit
import io
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(app_name: str = "surveyloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC time and adaptive execution; sizes are left to the cluster."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    ship_package(spark)
    atexit.register(remove_intermediate, spark)
    return spark


#: Paths of the tables that this process has written on the way to its results.
_WRITTEN: list[str] = []

#: Attribute of a Spark context that workers have been given the package of.
_SHIPPED = "_surveyloom_shipped"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove_intermediate(spark: SparkSession) -> None:
    """Deletes what this process wrote to the shared folder on the way to its results, which then can't be read again.

    Runs when a process that called :func:`build_session` ends, if its session is still there.
    """
    if spark.sparkContext._jsc is None:
        return
    while _WRITTEN:
        fs, at = _file_system(spark, _WRITTEN.pop())
        fs.delete(at, True)


def ship_package(spark: SparkSession) -> None:
    """Gives the package to Python workers on other machines, once per Spark context.

    Workers of an in-process master find it where the driver does.
    """
    context = spark.sparkContext
    if re.match(r"local($|\[)", context.master) or getattr(context, _SHIPPED, False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    path = f"{checkpoint_dir(spark)}/surveyloom-{uuid.uuid4().hex}.zip"
    fs, at = _file_system(spark, path)
    stream = fs.create(at)
    stream.write(packed.getvalue())
    stream.close()
    context.addPyFile(path)
    setattr(context, _SHIPPED, True)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    ``spark.checkpoint.dir`` is used as it is. Only a session whose executors are this
    process (a test) gets a temporary folder where it is unset; any other is refused,
    since executors could not share a folder of one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="surveyloom-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The frame as a table written to the shared folder.

    Later steps read it instead of computing it again, lost executors cost
    nothing, and the planner knows its size, so it broadcasts it only if it is
    small.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/surveyloom-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def literal_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A hand-written table as inline values, so that the optimizer knows its size.

    ``schema``: ``name type, ...`` with plain types.
    """
    fields = [part.strip().rsplit(" ", 1) for part in schema.split(",")]
    if not rows:
        return spark.createDataFrame([], schema)
    entries = [F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields)]) for row in rows]
    return spark.sql("SELECT 1 AS _").select(F.inline(F.array(*entries)))
