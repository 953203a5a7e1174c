"""Which evaluation texts occur in training texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .metrics import verdict

GRAM = 12


def exploded_lines(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.explode(T.lines(F.col("text"))).alias("line"))


def exact_hits(evaluation: DataFrame, training: DataFrame, key: str) -> DataFrame:
    """Per item: its lines, and how many are whole lines of training texts. Training lines are made distinct first."""
    wanted = exploded_lines(evaluation, key)
    known = training.select(F.explode(T.lines(F.col("text"))).alias("line")).distinct().withColumn("hit", F.lit(1))
    return wanted.join(known, "line", "left").groupBy(key).agg(F.count("*").alias("n"), F.count("hit").alias("hits"))


def contained(evaluation: DataFrame, training: DataFrame, key: str, doc: str) -> DataFrame:
    """Per item: the number of training texts that hold it whole.

    No nested loop: an item's first run of GRAM words meets equal runs of documents in an equi-join, and only such
    pairs are searched. Items of fewer words look up their words.
    """
    grams = lambda ws, n: F.transform(F.sequence(F.lit(0), F.size(ws) - n), lambda i: F.xxhash64(F.array_join(F.slice(ws, i + 1, n), " ")))
    # inner words only: the first and last may be parts of longer words of a document
    item_words = T.words(F.col("text"))
    inner = F.slice(item_words, 2, F.greatest(F.lit(0), F.size(item_words) - 2))
    items = evaluation.where(F.col("text") != "").select(key, F.col("text").alias("item"), inner.alias("w"))
    long_ = items.where(F.size("w") >= GRAM).select(key, "item", grams(F.col("w"), GRAM)[0].alias("g"))
    docs = training.select(doc, "text", T.words(F.col("text")).alias("w"))
    runs = docs.where(F.size("w") >= GRAM).select(doc, F.explode(F.array_distinct(grams(F.col("w"), GRAM))).alias("g"))
    pairs = runs.join(long_.select(key, "g"), "g").select(key, doc).distinct()
    short = items.where(F.size("w") < GRAM).select(key, F.when(F.size("w") > 0, F.element_at(F.array_sort(F.transform("w", lambda x: F.struct((-F.length(x)).alias("l"), x.alias("x")))), 1)["x"]).alias("x"))
    by_word = docs.select(doc, F.explode(F.array_distinct("w")).alias("x")).join(short.where("x is not null"), "x").select(key, doc)
    # an item of one or two words may lie inside words: it is searched in all texts
    anywhere = short.where("x is null").select(key).join(training.select(doc), F.lit(True))
    found = pairs.union(by_word).union(anywhere).join(evaluation.select(key, F.col("text").alias("item")), key).join(training.select(doc, "text"), doc).where(F.contains("text", "item"))
    hits = found.groupBy(key).agg(F.count_distinct(doc).alias("docs"))
    return evaluation.select(key).join(hits, key, "left").select(key, F.coalesce("docs", F.lit(0)).alias("docs"))


def file_verdicts(evaluation: DataFrame, training: DataFrame, by: str, value: str = "text") -> DataFrame:
    """Per evaluation set: rows, rows whose text is a training text, and the verdict."""
    known = training.select(T.strip(F.col(value)).alias("_t")).distinct().withColumn("_hit", F.lit(1))
    own = evaluation.withColumn("_t", T.strip(F.col(value))).join(known, "_t", "left")
    return own.groupBy(by).agg(F.count("*").alias("n"), F.count("_hit").alias("text_hits")).withColumn("verdict", verdict(F.col("n"), F.col("text_hits")))


def image_hits(evaluation: DataFrame, training: DataFrame, by: str, path: str = "rel_path") -> DataFrame:
    base = F.element_at(F.split(path, "/"), -1)
    known = training.select(base.alias("_b")).distinct().withColumn("_hit", F.lit(1))
    return evaluation.withColumn("_b", base).join(known, "_b", "left").groupBy(by).agg(F.count("*").alias("n"), F.count("_hit").alias("image_hits"))
