"""The corpus pipeline: from raw documents to packed training sequences.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written and read again as the next one's
docs. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from findloom.llm import queries

STAGES = queries.STAGES

#: No SQL: the classifier, the fingerprints and the tokenizer are beyond it;
#: tests/llm hold the stages against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries.run_stages(spark, sf_dir, STAGES)
