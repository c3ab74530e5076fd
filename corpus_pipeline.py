"""The corpus pipeline: each stage reads the documents that the one before it left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from buildlens.llm.common import shared_dir
from buildlens.llm.mixing import mix_documents
from buildlens.llm.near_dedup import drop_near_duplicates
from buildlens.llm.packing import pack_documents
from buildlens.llm.quality_rules import keep_good
from buildlens.llm.secret_scan import mask_secrets

STAGES = [
    ("quality rules", keep_good),
    ("near-duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_documents),
    ("packing", pack_documents),
]

#: The stages tokenise, hash and fit, which SQL cannot express; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
