"""A training-corpus pipeline over `documents`: each stage takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next stage's docs.

Defined cases: each stage states its own. Of the whole: null and empty texts pass the classifier and the line dedup,
one of them passes the Jaccard join, the mix takes none; rows equal in all columns lose all lines but in one; texts of
any length are read whole; an empty table gives an empty result; columns beside the documents' own, whatever their
names, are kept up to the packing, which returns pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm.chosenpath import one_of_each
from pagemill.llm.lines import deduplicated_lines
from pagemill.llm.mixing import mixed_documents
from pagemill.llm.packing import packed_stage
from pagemill.llm.quality import good_documents
from pagemill.llm.shared import new_path

STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", deduplicated_lines),
    ("ngram_jaccard_join", one_of_each),
    ("source_mixing", mixed_documents),
    ("best_fit_packing", packed_stage),
]

#: The language model, the tokenizer and the packing plan are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_path(spark, "pipeline")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
