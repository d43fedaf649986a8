"""Reading tables, and the table operations of a keyed store: insert, delete, replace and upsert as DataFrames."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where none is set, which only a local
    session may do, a fresh temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", named := "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return named.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def insert_ignore(store: DataFrame, new: DataFrame, key: str, order: Column) -> DataFrame:
    """The store with those rows of new whose key it lacks; of new rows with one key the first by order."""
    first = new.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("__n = 1").drop("__n")
    return store.unionByName(first.join(store.select(key), key, "left_anti").select(store.columns))


def insert_or_fail(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The store with new; a key that comes twice fails the query."""
    both = store.unionByName(new)
    once = F.count("*").over(Window.partitionBy(key)) == 1
    return both.withColumn("__ok", F.assert_true(once, F.concat(F.lit("duplicate key "), F.col(key).cast("string")))).filter("__ok is null").drop("__ok")


def insert_report(new: DataFrame, valid: Column) -> DataFrame:
    """(inserted, failed) of a batch: invalid rows fail, and keys that are there already count as inserted."""
    return new.select(F.count_if(F.coalesce(valid, F.lit(False))).alias("inserted"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("failed"))


def failed_rows(new: DataFrame, valid: Column) -> DataFrame:
    """The rows of a batch that are not valid, and so are not inserted."""
    return new.filter(~F.coalesce(valid, F.lit(False)))


def delete_keys(store: DataFrame, keys: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return store.join(keys, key, "left_anti")


def replace_groups(store: DataFrame, new: DataFrame, group: str, unique: Sequence[str] = ()) -> DataFrame:
    """The store with all rows of the groups in new replaced by new's. A key of the unique columns that comes twice in
    new fails the query."""
    if unique:
        once = F.count("*").over(Window.partitionBy(*unique)) == 1
        message = F.concat(F.lit("duplicate key "), F.concat_ws(" ", *unique))
        new = new.withColumn("__ok", F.assert_true(once, message)).filter("__ok is null").drop("__ok")
    return store.join(new.select(group).distinct(), group, "left_anti").unionByName(new)


def routes_of(routes: DataFrame, service: str) -> DataFrame:
    """The routes of a service; the filter reaches the scan, and where routes are partitioned by service, no other is read."""
    return routes.filter(F.col("service") == service)


def cleared(store: DataFrame, service: str | None = None) -> DataFrame:
    """The store without a service's rows, or without any."""
    return store.limit(0) if service is None else store.filter(~F.col("service").eqNullSafe(service))


def upsert(store: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """For each key the last row by order."""
    last = F.row_number().over(Window.partitionBy(*key).orderBy(order.desc()))
    return store.withColumn("__n", last).filter("__n = 1").drop("__n")


def write_by_service(routes: DataFrame, path: str) -> None:
    """Replaces the partitions of the services in routes, and no others."""
    routes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("service").parquet(path)
