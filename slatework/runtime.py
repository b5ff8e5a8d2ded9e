"""Session helpers shared by all operators: tables, checkpoints, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only if its rows were measured to take no more bytes than this.
BROADCAST_BYTES = 16_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def use_checkpoints(spark: SparkSession) -> None:
    """Take the shared folder named in spark.checkpoint.dir; set an own one only on a local master, where none is named.

    RuntimeError on a cluster without one: a folder of one machine would be lost with it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "slatework-checkpoints"))


def settled(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder: lineage ends there and a lost executor costs nothing."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Delete the files of a settled df that nothing reads any more.

    What is not released stays until the folder is emptied, or until Spark drops it if the cluster sets
    spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    plan = df._jdf.queryExecution().logical()
    file = plan.rdd().getCheckpointFile()
    if file.isDefined():
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _width(kind: T.DataType, c: Column) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + _width(kind.elementType, x).cast("bigint"))
        return F.coalesce(inner, F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_width(f.dataType, c[f.name]) for f in kind), F.lit(8))
    if isinstance(kind, T.MapType):
        return _width(T.ArrayType(kind.keyType), F.map_keys(c)) + _width(T.ArrayType(kind.valueType), F.map_values(c))
    return F.lit(8)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, settled, with a broadcast hint if it was measured to be small; else it joins by shuffle (AQE splits skew)."""
    done = settled(df)
    size = done.agg(F.sum(sum((_width(f.dataType, F.col(f"`{f.name}`")) for f in done.schema), F.lit(8)).cast("bigint"))).first()[0] or 0
    return F.broadcast(done) if size <= limit else done


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application (Spark's own file server brings it to executors)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()  # of the driver only, which serves it
    atexit.register(shutil.rmtree, folder, True)
    name = f"{folder}/slatework_package.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(name)
    _SHIPPED.add(sc.applicationId)


def mapped(df: DataFrame, work, schema) -> DataFrame:
    """df.mapInPandas with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInPandas(work, schema)


def mapped_arrow(df: DataFrame, work, schema) -> DataFrame:
    """df.mapInArrow with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(work, schema)
