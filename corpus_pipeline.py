"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark contamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`documents`, and keep any other columns docs has, whatever their names.  run() writes each stage's result to
the shared folder and reads it back, so that a lost executor costs one stage at most.

Defined results are those of the operators: null and empty texts fail the quality rules; where they are given
to a later stage they lose nothing, are not contaminated, count as copies of each other and take no room;
rows are judged by their own texts, so rows that share an id, or have none, take no other row with them; of
equal rows one stays; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm import decontaminate, packing, quality_rules, simhash, substring_dedup
from waymark.llm.common import forget, materialize, table
from waymark.runtime import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject."""
    ship(spark)
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard similarity 0.8 or more)."""
    ship(spark)
    return simhash.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages that occur earlier."""
    ship(spark)
    return substring_dedup.without_repeats(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents."""
    ship(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes; documents whose texts are now within three bits of each other are a cluster."""
    ship(spark)
    prints, linked = simhash.clustered(docs, "cluster")
    return packing.pack(prints, cluster="cluster", linked=linked)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("contamination", contamination), ("packing", packed)]

#: Hashes, minimizers and first-come bins have no SQL form; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if before is not None:  # a lost executor now costs this stage at most
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
