"""Comparisons of two genotype tables and of two tables of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborspark.functions import nucleotides as nuc


def genotype_conflicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """JO-5: tables (sample, pos, allele) -> (sample, pos, left_allele, right_allele) that share no allele."""
    both = a.select("sample", "pos", F.col("allele").alias("left_allele")).join(b.select("sample", "pos", F.col("allele").alias("right_allele")), ["sample", "pos"])
    return both.where(~nuc.compatible(F.col("left_allele"), F.col("right_allele")))


def missing_samples(a: DataFrame, b: DataFrame) -> DataFrame:
    """JO-5: (sample, absent_from) of samples that only one table has."""
    left, right = (t.select("sample").distinct().withColumn(c, F.lit(1)) for t, c in ((a, "_a"), (b, "_b")))
    one = left.join(right, "sample", "full").where("_a is null or _b is null")
    return one.select("sample", F.when(F.col("_a").isNull(), "left").otherwise("right").alias("absent_from"))


def changed_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """JO-8: tables (name, n) -> (name, before, after, delta) of the names whose counts differ."""
    both = before.select("name", F.col("n").alias("before")).join(after.select("name", F.col("n").alias("after")), "name")
    return both.where("before <> after").withColumn("delta", F.col("after") - F.col("before"))
