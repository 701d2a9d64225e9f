"""A training-data pipeline over ``documents``: STAGES in order, each reading what the one before it wrote.

Rows that a stage drops are gone for the later ones; redacted texts are what the later ones see. A stage's docs always
have the columns of documents; the last stage adds what the mix takes of each row (``size``, ``source_size``,
``target``, ``taken``) and keeps the rows it takes from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.common import read_table, stage
from codeloom.llm.decontaminate import drop_leaks
from codeloom.llm.mixing import mix
from codeloom.llm.ngram_join import keep_first
from codeloom.llm.quality_rules import keep_good
from codeloom.llm.secrets import redact


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs).where("taken > 0")


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("source_mix", source_mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Expectation-maximisation and the template join are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
