"""The corpus pipeline: quality rules, near-duplicates, repeated passages, packing.

Each stage takes the rows that its predecessor kept, as read again from
Parquet, and its decisions take effect: rejected documents are gone, one
document of each near-duplicate group stays, later occurrences of a repeated
passage are cut from the texts, and what is left is packed into sequences.
Near-duplicates and passages take five words and a similarity of 0.8.

Null and empty texts have no words, so the first stage rejects them; rows
without doc_id that it keeps go through the others unchanged and are packed.  Rows
of one doc_id with equal texts are one, those with different texts stay side by
side.  Of documents that are near each other the smallest doc_id stays.  Texts are
read whole, whatever their length.  Columns besides those of documents stay in all
stages but the last, and one named like a result of packing isn't read.  An empty
table gives an empty result.  A stage's table is dropped when the next one is
written; what the last stage reads stays with the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm import compact_windows, near_dedup, packing, quality_rules
from loomgrid.llm.queries import BYTE_BPE, END_ID, tokenizer_file
from loomgrid.llm.shared import Workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table doesn't reject."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each near-duplicate group; repeated rows go, rows of one doc_id with different texts are one document."""
    linked = near_dedup.link(spark, docs, words=5, percent=80)
    stays = linked.filter("kept").select("doc_id").distinct()
    return docs.filter("doc_id is null").unionByName(docs.filter("doc_id is not null").join(stays, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of a smaller doc_id has; n_chars follows the text."""
    cut = compact_windows.cut(spark, docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cut.columns else cut


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack(spark, docs, tokenizer_file(BYTE_BPE), END_ID, 1024)


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("best-fit packing", packed),
]

#: Packing needs a tokenizer, which SQL has not; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = space.table(docs, f"stage-{k}")
            if k:
                space.drop(f"stage-{k - 1}")
    return docs
