"""Sessions and table access."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_KEPT: list[str] = []


def session(name: str = "pagemill", **conf: str) -> SparkSession:
    """A session with the settings that results depend on: UTC, ANSI and adaptive execution."""
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    builder = SparkSession.builder.appName(name)
    for k, v in (fixed | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the folder that driver and executors share (spark.checkpoint.dir): what several steps use is
    computed once, and a lost executor costs no more than reading it again. A local session without that setting
    gets a temporary folder, removed at exit; a cluster must name one. forget() removes what was kept."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = _OWN.setdefault(app, "") or tempfile.mkdtemp(prefix="pagemill-kept-")
        _OWN[app] = shared
    path = f"{shared.rstrip('/')}/pagemill-kept-{app}/{name}-{uuid.uuid4().hex}"
    _KEPT.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Removes what kept() wrote in this session: results that read it can't be read after that. Called at exit too, for a
    session that still runs then."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _KEPT:
        where = jvm.org.apache.hadoop.fs.Path(_KEPT.pop())
        where.getFileSystem(conf).delete(where, True)


def _remove() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        forget(spark)
    for folder in _OWN.values():
        shutil.rmtree(folder, ignore_errors=True)


atexit.register(_remove)
