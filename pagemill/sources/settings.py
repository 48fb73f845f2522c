"""Environment files of settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as X

# Settings that may be changed, by provider and limit.
FIELDS = {f"{p}_{k}": f"{p}_{k}".upper() for p in ("gemini", "gemma", "qwen") for k in ("rpm_limit", "tpm_limit", "rpd_limit", "max_tokens_per_request")}


def updates(changes: DataFrame, admin: bool = True) -> DataFrame:
    """name and value of the known settings among changes (field, value) that have a value; users other than
    admins change none of them."""
    known = F.create_map(*[F.lit(x) for kv in FIELDS.items() for x in kv])
    out = changes.withColumn("name", F.try_element_at(known, F.col("field"))).filter(F.col("name").isNotNull() & F.col("value").isNotNull())
    return out.filter(F.lit(admin)).select("name", F.col("value").cast("string").alias("value"))


def merge_env(lines: DataFrame, changed: DataFrame) -> DataFrame:
    """An environment file (line_no, line) with new values: names that it sets are set in place, at their first
    line, others follow after a blank line, by name."""
    name = F.when(F.rlike("line", F.lit(r"^\s*[^#\s][^=]*=")), X.strip(F.substring_index("line", "=", 1)))
    named = lines.withColumn("_name", name)
    first = named.filter("_name IS NOT NULL").groupBy("_name").agg(F.min("line_no").alias("_first"))
    both = named.join(first, "_name", "left").join(changed.select(F.col("name").alias("_n"), "value"), (F.col("_name") == F.col("_n")) & (F.col("line_no") == F.col("_first")), "left")
    kept = both.select(F.col("line_no").cast("double").alias("line_no"), F.when(F.col("_n").isNotNull(), F.concat_ws("=", "_n", "value")).otherwise(F.col("line")).alias("line"))
    new = changed.join(first, changed["name"] == first["_name"], "left_anti")
    last = lines.agg(F.coalesce(F.max("line_no"), F.lit(-1)).alias("_last"), F.max_by("line", "line_no").alias("_text"))
    tail = new.agg(F.array_sort(F.collect_list(F.concat_ws("=", "name", "value"))).alias("more")).join(last, F.lit(True)).filter(F.size("more") > 0)
    gap = F.when(X.strip(F.coalesce("_text", F.lit(""))) != "", F.concat(F.array(F.lit("")), F.col("more"))).otherwise(F.col("more"))
    return kept.unionByName(tail.select(F.col("_last"), F.posexplode(gap).alias("i", "line")).select((F.col("_last") + 1 + F.col("i")).cast("double").alias("line_no"), "line"))
