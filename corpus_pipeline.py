"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept.
All but the last return the columns of documents (doc_id, text, lang, source, n_chars) and
any others that docs have, under whatever names.  All take empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import decontaminate, mixing, ngram_join, quality_rules, token_files
from llm.common import bounded_batches, cut, discard, shared_dir, table
from llm.queries import tokenizer_file


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go from each text; documents that the rules reject go.

    Null and empty texts, and all of fewer than 20 words, are rejected; null ids stay;
    repeated rows are judged each; n_chars follows the new text; texts are read whole.
    """
    bounded_batches(spark)
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity of 0.8 or more) one row stays.

    It is that with the smallest doc_id, null ids last; of rows that repeat id and set, that
    with the least text.  Null and empty texts are near no other and all stay.
    """
    return ngram_join.deduplicate(docs, 5, 4, 5)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths of a benchmark item's five-word shingles go.

    Null and empty texts hold nothing and stay; items without a word are in no document;
    repeated rows are judged each.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, put in the order of the mix: that of the files' names and of the rows in them.

    Null and unlisted sources share one stream; null ids are hashed as empty texts;
    repeated rows take a place each.
    """
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order that docs have on disk: file name, place of the split, row in it.

    Docs from no file are taken in the order of their partitions.  Returns (doc_id, start,
    n_tokens, ids_crc32) from the files read back; a null text has the end id alone, null
    ids stay null, repeated rows are kept.
    """
    placed = docs.select("doc_id", "text", F.input_file_name().alias("_file"), F.input_file_block_start().alias("_split"), F.monotonically_increasing_id().alias("_row"))
    path = shared_dir(spark, "pipeline-tokens")
    ids = cut(token_files.tokenize(placed, tokenizer_file(), "_file", "_split", "_row"), "pipeline-ids")
    token_files.write_tokens(ids, path, "_file", "_split", "_row")
    discard(ids)
    return token_files.digest(token_files.read(spark, path))


STAGES = [("quality rules", clean), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", without_benchmark), ("mixing", mix), ("token ids", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "pipeline")
        if before is not None:
            discard(before)
        before = docs
    return docs
