"""A corpus pipeline: quality rules, toxicity, near duplicates, benchmark decontamination, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. Its result is written as Parquet
to the shared folder and read again as the next one's ``docs``, so a lost executor costs at
most one stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, jaccard_join, packing, quality_rules, toxicity
from quillon.llm.common import table


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of what is left.

    Null and repeated ids and equal rows are packed one by one, a null text as its end id alone; other columns are not read.
    """
    import public_tokenizers

    return packing.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")), carry="ids_crc32")


STAGES = [
    ("quality_rules", quality_rules.stage),
    ("toxicity", toxicity.stage),
    ("jaccard_join", jaccard_join.stage),
    ("decontaminate", decontaminate.stage),
    ("packing", pack),
]

#: The learned stages can't be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillon-pipeline-")
    return f"{folder.rstrip('/')}/pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
