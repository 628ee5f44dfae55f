"""What operators need of the cluster: the package in every worker, and a folder that all machines share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_HERE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's source to the Python workers, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_plumbline_shipped", False):
        return spark
    path = os.path.join(tempfile.mkdtemp(prefix="plumbline-source-"), "plumbline_source.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(_HERE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(_HERE)))
    context.addPyFile(path)  # the driver's file server hands it to the executors
    context._plumbline_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, set as Spark's checkpoint folder.

    Only on one machine (a ``local`` master) a temporary folder is taken where none is named; on a cluster that
    is an error, as other machines could not read it.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="plumbline-")
        context.setCheckpointDir(named)
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once in compressed columns under the shared folder, and read from there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
