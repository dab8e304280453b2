"""A corpus pipeline over `documents`: classify, remove near-duplicates, mask secrets, mix and pack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import stages
from tessera.llm.common import materialize, table
from tessera.session import ship

#: Each takes (spark, docs, sf_dir); its result, written and read again, is the next one's docs.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", lambda spark, docs, sf_dir: stages.good_documents(ship(spark), docs, sf_dir)),
    ("n-gram Jaccard join", lambda spark, docs, sf_dir: stages.one_of_each_group(ship(spark), docs, sf_dir)),
    ("secret scans", lambda spark, docs, sf_dir: stages.without_secrets(ship(spark), docs, sf_dir)),
    ("mixing sources to target weights", lambda spark, docs, sf_dir: stages.mixed(ship(spark), docs, sf_dir)),
    ("best-fit packing", lambda spark, docs, sf_dir: stages.packed(ship(spark), docs, sf_dir)),
]

#: SQL can express neither the models nor the tokenizer; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
