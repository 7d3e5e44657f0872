"""Intermediate tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, the context's checkpoint folder, or, in local mode alone, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "arbiterlake-scratch")


#: Spark deletes the shuffle files of an execution at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_roots: set[str] = set()


def _scratch(spark: SparkSession) -> str:
    """This application's folder for intermediate tables; it goes when the driver's Python ends."""
    root = f"{shared_dir(spark).rstrip('/')}/scratch-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

        def clear() -> None:
            try:
                path = jvm.org.apache.hadoop.fs.Path(root)
                path.getFileSystem(conf).delete(path, True)
            except Exception:  # the JVM has gone before; nothing can be deleted any more
                pass

        atexit.register(clear)
    return root


def forget(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and that nothing reads any more."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        if f"{_scratch(df.sparkSession).split('://')[-1]}/" in f"{folder}/":
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def fresh_folder(spark: SparkSession) -> str:
    """A new folder name below this application's intermediate tables, for files that no Spark writer makes."""
    return f"{_scratch(spark)}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    The columns come back in the same order; every column becomes nullable. The shuffle files behind the table are
    deleted once it is written; otherwise they stay until the driver's JVM happens to collect its garbage.
    """
    path, conf = fresh_folder(df.sparkSession), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)
    return df.sparkSession.read.schema(df.schema).parquet(path)
