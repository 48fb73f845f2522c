"""Updates of the segment cache and the job store. Stores are DataFrames; an update gives the new store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import text as X

PROGRESS = "phase string, segments_total int, segments_translated int, pages_total int, pages_done int"


def cache_upsert(cache: DataFrame, rows: DataFrame, now: float) -> DataFrame:
    """rows: user_id, source_text, translated_text, target_lang, provider_used and seq. A known hash takes
    the new translation, provider and user and keeps its source, language and creation time; the last of
    several rows of one hash wins, as it does when they are written one by one, but the first one's source stays."""
    new = rows.withColumn("hash", X.segment_hash(F.col("source_text"), F.col("target_lang"), F.col("user_id")))
    new = new.groupBy("hash").agg(F.min_by("source_text", "seq").alias("_source"), F.min_by("target_lang", "seq").alias("_lang"), F.max_by("user_id", "seq").alias("_user"), F.max_by("translated_text", "seq").alias("_text"), F.max_by("provider_used", "seq").alias("_provider"))
    both = cache.join(new.withColumnRenamed("hash", "_hash"), F.col("hash") == F.col("_hash"), "full_outer")
    hit = F.col("_hash").isNotNull()
    pick = lambda a, b: F.when(hit, F.col(a)).otherwise(F.col(b))
    return both.select(F.coalesce("hash", "_hash").alias("hash"), pick("_user", "user_id").alias("user_id"), F.when(F.col("hash").isNull(), F.col("_source")).otherwise(F.col("source_text")).alias("source_text"), pick("_text", "translated_text").alias("translated_text"), F.when(F.col("hash").isNull(), F.col("_lang")).otherwise(F.col("target_lang")).alias("target_lang"), pick("_provider", "provider_used").alias("provider_used"), F.when(F.col("hash").isNull(), F.lit(now)).otherwise(F.col("created_at")).alias("created_at"), F.when(hit, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"))


def cache_clear(cache: DataFrame, user: str) -> tuple[DataFrame, DataFrame]:
    """The store without a user's rows, and how many went."""
    return cache.filter(F.col("user_id") != user), cache.agg(F.count_if(F.col("user_id") == user).alias("removed"))


def cache_count(cache: DataFrame) -> DataFrame:
    return cache.groupBy("user_id").agg(F.count("*").alias("segments"))


def create_jobs(jobs: DataFrame, rows: DataFrame, now: float) -> DataFrame:
    """rows: job_id, user_id, input_path, output_path, original_name, provider, target_lang."""
    empty = F.to_json(F.struct(F.lit("").alias("phase"), *[F.lit(0).alias(c) for c in ("segments_total", "segments_translated", "pages_total", "pages_done")]))
    return jobs.unionByName(rows.select("job_id", "user_id", F.lit("queued").alias("status"), "input_path", "output_path", "original_name", "provider", "target_lang", empty.alias("progress"), F.lit(None).cast("string").alias("error"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at")))


def update_jobs(jobs: DataFrame, changes: DataFrame, now: float) -> DataFrame:
    """changes: job_id, status, progress, provider, error and set_error. Null leaves a value; error, which may
    be cleared, changes where set_error holds."""
    c = changes.select(F.col("job_id").alias("_job"), *[F.col(x).alias(f"_{x}") for x in ("status", "progress", "provider", "error", "set_error")])
    both = jobs.join(c, F.col("job_id") == F.col("_job"), "left")
    sets = {x: F.coalesce(f"_{x}", x) for x in ("status", "progress", "provider")}
    sets["error"] = F.when(F.coalesce("_set_error", F.lit(False)), F.col("_error")).otherwise(F.col("error"))
    sets["updated_at"] = F.when(F.col("_job").isNotNull(), F.lit(now)).otherwise(F.col("updated_at"))
    return both.withColumns(sets).select(*jobs.columns)


def set_paths(jobs: DataFrame, job_id: str, user_id: str, source: str, output: str, now: float) -> DataFrame:
    hit = (F.col("job_id") == job_id) & (F.col("user_id") == user_id)
    sets = {"input_path": F.lit(source), "output_path": F.lit(output), "updated_at": F.lit(now)}
    return jobs.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in sets.items()})


def delete_jobs(jobs: DataFrame, user: str) -> tuple[DataFrame, DataFrame]:
    """The store without a user's jobs, and those with their paths."""
    return jobs.filter(F.col("user_id") != user), jobs.filter(F.col("user_id") == user).select("job_id", "input_path", "output_path")


def purge_counts(gone: DataFrame, objects: DataFrame) -> DataFrame:
    """Jobs removed and files that existed among their paths; objects: key."""
    paths = gone.select("job_id", F.explode(F.array("input_path", "output_path")).alias("key")).filter(F.length("key") > 0)
    files = paths.join(objects.select("key").distinct(), "key", "left_semi").agg(F.count("*").alias("files"))
    return gone.agg(F.count("*").alias("jobs")).join(files, F.lit(True))  # a row each


def with_progress(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("progress", F.from_json(F.coalesce("progress", F.lit("{}")), PROGRESS))


def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("user_id").agg(F.count("*").alias("jobs"))


def account_stats(cache: DataFrame, jobs: DataFrame, objects: DataFrame, user: str) -> DataFrame:
    """A user's segments, jobs, uploads and outputs in one row."""
    mine = lambda df: df.agg(F.count_if(F.col("user_id") == user).alias("n"))
    files = objects.agg(*[F.count_if(F.startswith("key", F.lit(f"{p}/{user}/"))).alias(p) for p in ("uploads", "outputs")])
    return mine(cache).withColumnRenamed("n", "segments").join(mine(jobs).withColumnRenamed("n", "jobs"), F.lit(True)).join(files, F.lit(True))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: what a sequence of writes leaves."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
