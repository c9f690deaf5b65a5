"""Tables kept between the jobs of one operator, in the folder that driver and executors share."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own where that is unset and Spark runs in one process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            folder = made.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            folder = "file://" + os.path.join(tempfile.gettempdir(), "arcloom-shared")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files of a stored() table that nothing reads any more; files of other tables are left alone."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    own = re.compile(rf".*{re.escape(re.sub('^[a-z]+:/*', '/', shared_dir(df.sparkSession)))}/[^/]+-[0-9a-f]{{32}}")
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if not own.fullmatch(folder):
            continue
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def free(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished jobs that no table refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
