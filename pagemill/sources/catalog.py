"""Stores as catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STORES = {
    "users": "id string, username string, username_norm string, password_hash string, is_admin int, created_at double",
    "sessions": "token_hash string, user_id string, created_at double, expires_at double",
    "user_api_keys": "user_id string, gemini_key string, qwen_key string, qwen_base_url string, qwen_model string, updated_at double",
    "segment_cache": "hash string, user_id string, source_text string, translated_text string, target_lang string, provider_used string, created_at double, updated_at double",
    "jobs": "job_id string, user_id string, status string, input_path string, output_path string, original_name string, provider string, target_lang string, progress string, error string, created_at double, updated_at double",
    "quota_events": "scope string, provider string, ts double, tokens long",
}


def create_stores(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """The stores of a database, made where they are missing; those that exist keep their rows."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in STORES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
    return {name: spark.table(f"{database}.{name}") for name in STORES}
