"""The queries of this package: each applies its operator with production parameters to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file; operators take such a path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import piece_digests

    return piece_digests(C.table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .word_repeats import word_repeats

    return word_repeats(C.table(spark, sf_dir, "documents"), window=50, digest=True).withColumnRenamed("kept", "kept_sha256")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import held_out, quality_scores

    scores = quality_scores(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"), threshold=0.3)
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .top_k import top_products

    return top_products(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(C.table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=512)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(C.table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), window=2048, end_id=1)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import span_digests

    return span_digests(C.table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_repeats import suffix_repeats

    return suffix_repeats(C.table(spark, sf_dir, "documents"), window=50, digest=True).withColumnRenamed("kept", "kept_sha256")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(C.table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import linked

    return linked(C.table(spark, sf_dir, "documents"), percent=75, n=5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_substring_dedup, op3_quality, op4_top_k, op5_token_counts, op6_packing, op7_pii, op8_suffix_dedup, op9_exact_dedup, op10_jaccard_join)}


OP9_SQL = r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents
), best AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size, row_number() OVER w = 1 AS kept
  FROM plain WINDOW w AS (PARTITION BY plain ORDER BY chars DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, kept, sha256(plain) AS text_sha256 FROM best
"""


OP4_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS key, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), w AS (SELECT max(len(v)) AS width FROM v
), f AS (SELECT key, vec_id, CAST(list_resize(v, width, 0) AS DOUBLE[]) AS v FROM v, w
), p AS (
  SELECT q.key, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_inner_product(q.v, c.v), 0) AS BIGINT) AS score
  FROM f q JOIN f c ON q.vec_id % 20 = 0 AND c.key <> q.key
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_top_k": OP4_SQL, "op9_exact_dedup": OP9_SQL}
