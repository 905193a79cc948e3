"""Group-wise operators that stay safe when one group holds a large share of all rows."""

from __future__ import annotations

import functools
import operator
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 32
HOT = 256


def work_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``, shared by driver and executors; only a local session may lack one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="webstrata-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write a narrow intermediate result to the checkpoint folder, so that two uses read it once."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly row-wise work on an input that comes in too few pieces.

    Only an input known to make file splits for less than a quarter of the cores is redistributed;
    anything larger keeps its partitions, so this never shuffles big data.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    try:
        split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
        known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:  # a remote session shows no statistics
        return df
    return df.repartition(cores) if 4 * known < cores * split else df


def salted_join(rows: DataFrame, small: DataFrame, on: list[str], row_key: list[str],
                how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join many rows per key with at most one row per key.

    Rows of one key go to ``salts`` tasks by their own identity, and the one-row side
    is repeated that often, so a key shared by a third of all rows is no bottleneck.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*row_key), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def with_group_size(df: DataFrame, keys: list[str], row_key: list[str], name: str) -> DataFrame:
    """Add the number of rows that share ``keys`` (rows with a NULL key count as alone and are not joined at all).

    Groups of more than a ``HOT``-th of all rows, of which there are fewer than ``HOT``, are broadcast; rows of all others
    meet their count in a plain join, in which no key is frequent.
    """
    narrow = cut(df)
    known = functools.reduce(operator.and_, (F.col(k).isNotNull() for k in keys))
    sizes = cut(narrow.where(known).groupBy(*keys).agg(F.count("*").alias(name)).where(F.col(name) > 1))
    frequent = F.col(name) * HOT > narrow.count()
    hot = F.broadcast(sizes.where(frequent))
    rows = narrow.where(known)
    others = rows.join(hot, keys, "left_anti").join(sizes.where(~frequent), keys, "left").withColumn(name, F.coalesce(F.col(name), F.lit(1).cast("long")))
    alone = narrow.where(~known).withColumn(name, F.lit(1).cast("long"))
    return rows.join(hot, keys).unionByName(others).unionByName(alone).select(*df.columns, name)


def latest_by(df: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """One row per key: the one whose ``newest`` values are greatest.

    An aggregation, not a window: copies of one key are reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*newest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row, with their row count."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
