"""File sources and sinks: typed CSV, Parquet stages, load-or-compute."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CUSTOMER_SCHEMA = T.StructType([
    T.StructField("CustomerId", T.LongType()),
    T.StructField("Surname", T.StringType()),
    T.StructField("CreditScore", T.IntegerType()),
    T.StructField("Geography", T.StringType()),
    T.StructField("Gender", T.StringType()),
    T.StructField("Age", T.IntegerType()),
    T.StructField("Tenure", T.IntegerType()),
    T.StructField("Balance", T.DoubleType()),
    T.StructField("NumOfProducts", T.IntegerType()),
    T.StructField("HasCrCard", T.IntegerType()),
    T.StructField("IsActiveMember", T.IntegerType()),
    T.StructField("EstimatedSalary", T.DoubleType()),
    T.StructField("Exited", T.IntegerType()),
])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem of the path (local, HDFS, object stores)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def read_customers_csv(spark: SparkSession, path: str, schema: T.StructType = CUSTOMER_SCHEMA) -> DataFrame:
    """Header CSV with an explicit schema; a malformed or mistyped value fails the read."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"raw data not found at: {path}")
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Digest of the listing (name, length, modification time) of all files under the paths."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    parts = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        if not fs.exists(p):
            parts.append(f"{path}:missing")
        elif fs.getFileStatus(p).isFile():
            st = fs.getFileStatus(p)
            parts.append(f"{path}:{st.getLen()}:{st.getModificationTime()}")
        else:
            files, found = fs.listFiles(p, True), []
            while files.hasNext():
                st = files.next()
                found.append(f"{st.getPath().toString()}:{st.getLen()}:{st.getModificationTime()}")
            parts += sorted(found)
    return hashlib.sha1("|".join(parts).encode()).hexdigest()


def load_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame],
                    ensure: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Reuse a stage written earlier, else compute it, write it, and read it back.
    Reading the written table also cuts the lineage of the computed plan."""
    if not path_exists(spark, f"{path.rstrip('/')}/_SUCCESS"):  # a half-written stage is rewritten
        write_parquet(compute(), path)
    df = read_parquet(spark, path)
    return ensure(df) if ensure else df
