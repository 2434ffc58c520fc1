"""Scratch tables in the folder that driver and executors share, and this package for Python workers."""

from __future__ import annotations

import atexit
import os
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Used in local mode only, where spark.checkpoint.dir is unset.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/signalloom"


def shared_dir(spark: SparkSession) -> str:
    """The folder from spark.checkpoint.dir. Where it is unset a folder is chosen in local mode
    only: on a cluster a machine's own folder would hide what one executor wrote from the others."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_CHECKPOINTS


def _delete(spark: SparkSession, path: str) -> None:
    """At exit the session may be gone already; a scratch table that is left is harmless."""
    if spark.sparkContext._jsc is None:
        return
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except (Py4JError, OSError):
        return


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: it cuts the lineage, so a lost executor
    costs a re-read, and what is read twice is the same both times. Dropped when the process ends."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def ship(spark: SparkSession) -> None:
    """Let Python workers that the local JVM starts find this package, wherever the driver's
    working folder is. On a cluster install the package or pass it by --py-files."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def quoted(name: str) -> Column:
    """A column by its exact name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def holds_map(kind: T.DataType) -> bool:
    """Whether a type is a map or has one inside, which can be neither hashed nor ordered."""
    if isinstance(kind, T.ArrayType):
        return holds_map(kind.elementType)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.StructType) and any(holds_map(f.dataType) for f in kind.fields))


def row_hash(rows: DataFrame, *columns: str) -> Column:
    """A hash of the whole row, or of the columns; those that hold a map count by their JSON, in
    the order of the map's keys."""

    def hashable(c: str) -> Column:
        kind = rows.schema[c].dataType
        if not holds_map(kind):
            return quoted(c)
        return F.to_json(F.struct((F.sort_array(F.map_entries(quoted(c))) if isinstance(kind, T.MapType) and not holds_map(kind.valueType) else quoted(c)).alias("x")))

    return F.xxhash64(*map(hashable, columns or rows.columns))


def packed(rows: DataFrame, **also: Column) -> DataFrame:
    """``row``, a struct of all columns, beside the named ones: no name of rows can clash with them."""
    return rows.select(F.struct(*map(quoted, rows.columns)).alias("row"), *(c.alias(k) for k, c in also.items()))
