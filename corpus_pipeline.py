"""A corpus pipeline: the stages in order, each over all that its predecessor kept.

Each stage takes the documents of the one before and returns the columns of ``documents``; the last returns token ids. Between
stages the documents are written as Parquet to the shared folder and read again, so a lost executor never replays a stage.

Stages 1 and 4 drop documents, stage 3 keeps one document of each group of near duplicates, stage 2 rewrites texts and drops
only documents of which no line is left. Null, empty and repeated rows, ties and extra columns are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelframe.llm import bpe, decontaminate, divergence, jaccard, winnow
from voxelframe.session import scratch_path

NEAR_WIDTH = 5
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the distribution rules keep."""
    return divergence.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier run of lines; documents left without a line go."""
    return winnow.dedup_lines(docs, drop_emptied=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles with similarity 0.8 make: that with the smallest id."""
    return jaccard.one_of_each(docs, percent=NEAR_PERCENT, width=NEAR_WIDTH)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and byte-level BPE ids of every document."""
    return bpe.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("token_ids", token_ids),
]

#: No SQL twin: the link groups and the merges are iterative, so the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
