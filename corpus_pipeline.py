"""The document pipeline: toxicity, exact dedup, near dedup, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept; the
first four return the columns of ``documents``, the last one the pieces of the packed sequences.
``ORACLE_SQL`` is None: the toxicity model, MinHash bands and CGK walks are not expressible in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm.common import staged, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from glyphmill.llm.toxicity import keep_clean

    return keep_clean(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from glyphmill.llm.exact_dedup import keep_one

    return keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from glyphmill.llm.jaccard_join import keep_representatives

    return keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from glyphmill.llm.decontaminate import keep_uncontaminated

    return keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from glyphmill.llm.packing import pack

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
