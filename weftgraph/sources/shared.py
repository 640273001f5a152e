"""Tables in the folder that all executors share; they cut the lineage of iterative operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where the session has none and runs on one machine, a temporary folder, removed at exit."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(shared_dir, "own", None)
        if not found:
            found = shared_dir.own = tempfile.mkdtemp(prefix="weftgraph-")
            atexit.register(shutil.rmtree, found, True)
    return found


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a written table: read again, it has no lineage, and survives lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def removed(*frames: DataFrame) -> None:
    """Deletes tables that written() made, once nothing reads them any more."""
    for df in frames:
        if path := getattr(df, "_written_path", None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
