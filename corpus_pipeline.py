"""A training corpus in five stages over ``documents``.

Each stage takes what its predecessor kept, written as Parquet and read back.
``ORACLE_SQL`` is None: SQL can express neither the language classifier nor the
alignment, so tests compare the stages with brute-force versions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from photolake.llm.decontaminate import stage_decontaminate
from photolake.llm.langid import stage_language
from photolake.llm.mixing import stage_mixing
from photolake.llm.simhash import stage_near_dedup
from photolake.llm.sstable import stage_token_output
from photolake.session import shared_dir

STAGES = [
    ("language_id", stage_language),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("mix_sources", stage_mixing),
    ("token_output", stage_token_output),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
