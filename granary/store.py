"""Tables written to the folder that the driver and all executors share, in place of cached plans."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_made: dict[str, str] = {}
_paths: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where that is unset, a folder of our own: below the
    warehouse, or for a local master in the machine's temporary folder."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if sc.applicationId not in _made:
        local = sc.master == "local" or sc.master.startswith("local[")
        warnings.warn("spark.checkpoint.dir is unset: tables go to a folder of this machine or the warehouse", stacklevel=2)
        _made[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="granary-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_granary"
    return _made[sc.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that nothing else uses; removed when the driver ends."""
    path = f"{shared_folder(spark)}/granary/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _paths.append((spark, path))
    return path


def stored(df: DataFrame, name: str, share: int = 1) -> DataFrame:
    """``df`` written to the shared folder and read back: it outlives any executor and is computed once.

    A table that holds a small part of what the session's partitions are made for goes to one in ``share`` of
    them, so that its files don't cost more than its rows.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if share > 1:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // share))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, stored; the tables that were stored on the way to it are deleted."""
    before = len(_paths)
    out = stored(make(), name)
    while len(_paths) > before + 1:
        delete(*_paths.pop(before))
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """Delete what :func:`stored` has written in this process, through whatever file system holds it."""
    while _paths:
        spark, path = _paths.pop()
        try:
            delete(spark, path)
        except Exception:  # the session may be gone; the folder is then the cluster's to clean
            return


atexit.register(release)


def in_order(df: DataFrame, *order: Column | str, name: str = "sorted") -> DataFrame:
    """``df`` range-sorted and stored, with its partition ``_p`` and place ``_i`` in it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    mark = F.monotonically_increasing_id()
    return stored(ranged.select("*", F.shiftright(mark, 33).alias("_p"), mark.bitwiseAND((1 << 33) - 1).alias("_i")), name)


def before_partitions(df: DataFrame, what: Column) -> DataFrame:
    """Of each partition ``_p`` the sum of ``what`` over those before it; a row per partition."""
    each = df.groupBy("_p").agg(what.alias("_s"))
    return each.select("_p", F.coalesce(F.sum("_s").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))


def numbered(df: DataFrame, *order: Column | str, column: str = "id") -> DataFrame:
    """``df`` with its row number from 0 in a total order, without a single task that sees all rows."""
    table = in_order(df, *order, name=f"numbered-{column}")
    starts = before_partitions(table, F.count("*"))
    return table.join(F.broadcast(starts), "_p").withColumn(column, F.col("_before") + F.col("_i")).drop("_p", "_i", "_before")


def running(df: DataFrame, value: str, *order: Column | str, column: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each in a total order, likewise."""
    table = in_order(df, *order, name=f"running-{column}")
    starts = before_partitions(table, F.sum(value))
    inner = W.partitionBy("_p").orderBy("_i").rowsBetween(W.unboundedPreceding, -1)
    summed = F.col("_before") + F.coalesce(F.sum(value).over(inner), F.lit(0))
    return table.join(F.broadcast(starts), "_p").withColumn(column, summed).drop("_p", "_i", "_before")
