"""A corpus pipeline of the training-data operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is stored and read again as
the next stage's docs. All stages but the last return the columns of documents, whatever others docs has.

In every stage a null text counts as empty, null doc_ids and sources are values like any other, repeated rows count
as often as they occur unless a stage is there to remove them, very long texts are read whole by one task, and
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barograph.llm import mixing, packing, quality, similar, substring
from barograph.llm.common import new_path, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the rule ensemble accepts; labels are joined by doc_id to train it. Null labels are
    ignored, of several labels of a document the largest counts; without rules (no labels, or one kind only) all
    documents stay. Empty and null texts are scored like others."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity 0.8 or more. The smallest doc_id
    stays (null ids last), then the smallest text hash, one row of it; texts without words, null ones among them,
    are one group."""
    return similar.deduplicate(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of all texts but the first that holds them, by doc_id (null ids last). A document
    of which no word is left goes; null and empty texts stay as they are; rows equal in doc_id and text count as one."""
    return substring.deduplicate(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that every source nears its target. Documents without words may go; the null
    source is the last; equal rows are drawn one by one; ties in rank go by a hash, then by number."""
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens. A null or empty text is its end token alone; only texts of more
    than 4096 tokens are cut; equal lengths take places in any order."""
    return packing.pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: No stage but the last has an SQL form that DuckDB could run at this size.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored in the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = new_path(spark, name)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
