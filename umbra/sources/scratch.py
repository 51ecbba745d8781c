"""Tables written between jobs, in the folder that the driver and executors share.

A lost executor then costs a re-read, never a recomputation of everything before.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a temporary folder, but only for a local master (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(spark.sparkContext, "_umbra_scratch", None)
        if not folder:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = spark.sparkContext._umbra_scratch = "file://" + tempfile.mkdtemp(prefix="umbra-")
    return folder


def written(df: DataFrame, name: str, **observed: Column) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, read from there afterwards.

    ``observed``: aggregates of the rows, taken while they are written; ``.observed`` of the result has their values."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/umbra-{name}-{uuid.uuid4().hex}"
    seen = Observation(uuid.uuid4().hex) if observed else None
    rows = df.observe(seen, *(c.alias(k) for k, c in observed.items())) if seen else df
    rows.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.path, out.observed = path, seen.get if seen else {}
    return out


def forget(df: DataFrame) -> None:
    """Delete the table of a frame that :func:`written` returned and nothing reads any more."""
    _delete(_written.pop(df.path), df.path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the cluster's own cleaning remains
            return
