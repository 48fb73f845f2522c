"""Glossaries: CSV files with a header source,target,mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as X

SCHEMA = "seq long, source string, target string, mode string"


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Entries in the file's order (seq); a missing file gives none. Blank sources are passed over, fields are
    stripped, and modes but translate and keep count as translate."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, quote='"', escape='"')
    names = {c.lstrip("﻿"): c for c in rows.columns}
    of = lambda n: F.col(f"`{names[n]}`") if n in names else F.lit(None).cast("string")
    return entries(rows.select(F.monotonically_increasing_id().alias("seq"), *[of(n).alias(n) for n in ("source", "target", "mode")]))


def entries(rows: DataFrame) -> DataFrame:
    value = lambda c: X.strip(F.coalesce(F.col(c), F.lit("")))
    mode = F.lower(value("mode"))
    return rows.select("seq", value("source").alias("source"), value("target").alias("target"), F.when(mode.isin("translate", "keep"), mode).otherwise("translate").alias("mode")).filter(F.col("source") != "")
