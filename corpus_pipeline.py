"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all but the last
return the columns of `documents`. A stage's result is written as Parquet and read again as the next
one's input, so a stage that is repeated after a loss starts from a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import common as C
from lexiloom.llm import exact_dedup, jaccard_join, packing, pii, quality
from lexiloom.llm.queries import tokenizer


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality classifier doesn't reject, as they are.

    A null or empty text has the score of the bias alone; a null id or a repeated one changes nothing; an
    empty table gives no rows; other columns come along, whatever their names.
    """
    return quality.accepted(docs, C.table(spark, sf_dir, "labels"), threshold=0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest original, then the smallest id (null last), then the smallest hash of the row.

    Null, empty and blank texts are one group; rows are told apart by themselves, so a repeated or null id
    loses and keeps nothing; of rows that are equal in all columns one stays; an empty table gives no rows.
    """
    return exact_dedup.kept_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest id (null last), then the smallest hash of the row.

    Rows without words are near to nothing and stay; rows are told apart by themselves, so a repeated or
    null id loses and keeps nothing; an empty table gives no rows.
    """
    return jaccard_join.one_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with its personal data replaced by the kind in brackets, and `n_chars` (if there) counted again.

    A null text stays null, an empty one empty; repeated rows stay repeated; an empty table gives no rows;
    other columns stay as they are, whatever their names.
    """
    return pii.masked_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens.

    A null or empty text is its end id alone; repeated rows and null ids are documents of their own; an empty
    table gives no rows; other columns are left behind.
    """
    return packing.packed(docs, tokenizer("byte_bpe_50k.json"), window=2048, end_id=1)


STAGES = [("quality", keep_good), ("exact", drop_copies), ("near", drop_near_copies), ("pii", mask_personal_data), ("packing", pack)]

#: No SQL: training, set similarity and packing have no form there; a test holds the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, docs, before = C.Tables(spark, "pipeline"), C.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = tables.written(stage(spark, docs, sf_dir), name)
        if before:
            tables.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
