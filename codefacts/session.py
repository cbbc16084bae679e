"""A session with the settings the engine relies on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings; partition numbers and memory are the deployment's.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "codefacts", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | more).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_OWN: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names.

    Where none is named (single machines, tests) a folder of our own is used until the process ends.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
            app = spark.sparkContext.applicationId
            if app not in _OWN:
                _OWN[app] = tempfile.mkdtemp(prefix="codefacts-")
                atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
            at = _OWN[app]
        spark.sparkContext.setCheckpointDir(at)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and cut from its plan, in the checkpoint folder."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, by: str) -> DataFrame:
    """df computed once and kept as Parquet files in the checkpoint folder, for many scans that want few columns or few values of ``by``.

    The rows of a task lie in the order of ``by``, in small row groups, so a filter on it skips the others.
    """
    at = f"{_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.sortWithinPartitions(by).write.option("parquet.block.size", 8 << 20).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df in some partitions for each core, however few files it lies in: what is done with a row takes longer than moving it."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)
