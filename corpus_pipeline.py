"""Corpus pipeline: quality rules, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the
last return the columns of documents; the last returns the digests of the encoded documents, one
row for each copy that the mix takes.

Edge cases: a null text is no text, so the quality stage rejects it, as it does any of under 50
words; a text that line dedup empties keeps its row until near-dedup, where all such texts are one
group; null ids come last everywhere and are never the one that stays while another id is there;
rows that repeat go on together and are dropped together; an empty table gives an empty result.
Extra columns pass through, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, line_dedup, mixing, near_dedup, quality
from quern.llm.common import Workspace, table

#: The quality stage applies learned rules and the near-dedup stage hashes shingles with a function
#: that DuckDB lacks; tests/llm/test_pipeline.py holds the stages against brute force instead.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_documents(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(docs, Workspace(spark, "pipeline-lines"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, Workspace(spark, "pipeline-near-dedup"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs, Workspace(spark, "pipeline-mix"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(docs)


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_copies),
    ("source mixing", mix),
    ("byte-level bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what a stage keeps is written before the next reads it, as each reads its input more than once."""
    docs, workspace = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = workspace.materialise(docs, f"stage-{number}")
    return docs
