"""A bundle as a Parquet checkpoint: each version is complete or absent."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import SparkSession

from arborspark.plans.analog import Bundle


def save(b: Bundle, path: str) -> None:
    """SC-16, SK-13: the tables of a bundle below ``path``; the mark is written last, so a version without it is not read."""
    spark = b.node.sparkSession
    for f in fields(Bundle):
        getattr(b, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")
    spark.range(1).write.mode("overwrite").parquet(f"{path}/complete")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def load(spark: SparkSession, path: str) -> Bundle:
    """SC-16: a saved bundle; an incomplete one is an error."""
    if not _exists(spark, f"{path}/complete/_SUCCESS"):
        raise FileNotFoundError(f"no complete bundle at {path}")
    return Bundle(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(Bundle)})


def latest(spark: SparkSession, path: str) -> int:
    """The largest complete version below ``path``, -1 if there is none."""
    n = -1
    while _exists(spark, f"{path}/version={n + 1}/complete/_SUCCESS"):
        n += 1
    return n
