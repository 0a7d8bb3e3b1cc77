"""Frames that are worked out once, where two readings of them must agree."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame


def settled(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the folder that driver and executors share and reads it back; it is deleted when this Python process ends.

    The folder is ``spark.checkpoint.dir``; only in local mode, where that is
    unset, a temporary one.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="panelyard-")
    path = f"{root.rstrip('/')}/panelyard-{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def clear() -> None:
        try:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # noqa: BLE001  the JVM may be gone by now
            pass

    atexit.register(clear)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
