"""Preparation of label corpora: first occurrences, samples, splits, copies, upserts. Choices are by md5 of seed and key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T


def draw(seed: int, *key: str) -> Column:
    """A place in a seeded shuffle: the same in any engine that has md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)))


def uniform(seed: int, *key: str) -> Column:
    return F.conv(F.substring(draw(seed, *key), 1, 8), 16, 10).cast("double") / 2**32


def first_occurrences(df: DataFrame, value: str, *order: str) -> DataFrame:
    """One row for each value, at its first place."""
    return df.groupBy(value).agg(F.min(F.struct(*order)).alias("_p")).select(value, "_p.*")


def capped(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows of a seeded shuffle (top-n of a sort, no window over all rows)."""
    return df.withColumn("_d", draw(seed, *key)).orderBy("_d", *key).limit(n).drop("_d")


def ranked(df: DataFrame, seed: int, *key: str) -> DataFrame:
    """Place of each row in the seeded shuffle, from 0, without one task for all rows: counts of ranges first."""
    own = df.withColumn("_d", draw(seed, *key)).withColumn("_b", F.substring("_d", 1, 3))
    sizes = own.groupBy("_b").agg(F.count("*").alias("_n"))  # 4096 ranges at most
    before = sizes.select("_b", (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(W.partitionBy("_b").orderBy("_d", *key))
    return own.join(F.broadcast(before), "_b").withColumn("place", F.col("_before") + within - 1).drop("_d", "_b", "_before")


def split(df: DataFrame, shares: dict[str, float], seed: int, *key: str) -> DataFrame:
    """Consecutive parts of the seeded shuffle, int(n * share) rows each; the last takes the rest."""
    n = df.count()
    out, at, cases = ranked(df, seed, *key), 0, None
    for name in list(shares)[:-1]:
        at += int(n * shares[name])
        cases = F.when(F.col("place") < at, name) if cases is None else cases.when(F.col("place") < at, name)
    last = F.lit(list(shares)[-1])
    return out.withColumn("split", cases.otherwise(last) if cases is not None else last).drop("place")


def repeated(df: DataFrame, copies: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))) if copies > 0 else df.withColumn("copy", F.lit(0)).where("false")


def merged(parts: list[tuple[DataFrame, str, int]]) -> DataFrame:
    """Union of label sets, each with its base folder and number of copies."""
    return reduce(DataFrame.unionByName, [repeated(df.withColumn("base_dir", F.lit(base)), n) for df, base, n in parts])


def upsert(base: DataFrame, update: DataFrame, key: str) -> DataFrame:
    """Rows of update replace those of base with the same key."""
    return base.join(update.select(key), key, "left_anti").unionByName(update)


def coverage(texts: DataFrame, chars: list[str]) -> DataFrame:
    """Characters that occur but are not in the set."""
    known = texts.sparkSession.createDataFrame([(c,) for c in chars], "ch string")
    found = texts.select(F.explode(F.array_distinct(T.characters(F.col("text")))).alias("ch")).distinct()
    return found.where("ch not in ('\n', '\r')").join(known, "ch", "left_anti")


def spans(df: DataFrame, longest: int, seed: int, *key: str) -> DataFrame:
    """A random run of at most `longest` words; shorter texts stay as they are."""
    ws = T.words(F.col("text"))
    n = F.size(ws)
    start = F.floor(uniform(seed, *key) * (n - longest + 1)).cast("int")
    return df.withColumn("text", F.when(n <= longest, F.col("text")).otherwise(F.array_join(F.slice(ws, start + 1, longest), " ")))


def confusion_pool(df: DataFrame, predicate: Column, least: int = 2) -> DataFrame:
    """Distinct words (column word) of a given length that the predicate takes."""
    own = df.select(F.explode(T.words(F.col("text"))).alias("word")).where(F.length("word") >= least).where(predicate)
    return own.groupBy("word").agg(F.count("*").alias("n"))


def occurrences(df: DataFrame, ch: str, value: str = "text") -> DataFrame:
    """n: how often a character occurs in a column."""
    return df.agg(F.sum(F.length(value) - F.length(F.replace(F.col(value), F.lit(ch), F.lit("")))).alias("n"))


def base_folder(path: Column, shared: str) -> Column:
    """Files under the shared folder go by it, others by their own folder."""
    return F.when((path == shared) | path.startswith(shared.rstrip("/") + "/"), shared).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


#: What the recogniser confuses, anywhere in a word and at its end, and marks that don't count as its end.
CONFUSED = ("ණේ", "නේ", "ම්", "මි", "ූ", "ඬ", "ඳ", "ඟ", "ැයි")
CONFUSED_ENDS = ("ේ", "්", "ූ", "ී")
END_MARKS = ".,:;!?()[]\"'"


def is_confusable(word: Column, anywhere: tuple[str, ...] = CONFUSED, ends: tuple[str, ...] = CONFUSED_ENDS) -> Column:
    """Whether a word holds one of the parts, or ends with one of the ends when marks around it are left out."""
    bare = F.btrim(word, F.lit(END_MARKS))
    return reduce(Column.__or__, [*(F.contains(word, F.lit(s)) for s in anywhere), *(bare.endswith(s) for s in ends)])


def first_of(df: DataFrame, files: DataFrame, candidates: list[Column]) -> DataFrame:
    """df with `found`: the first of the candidate paths, in their order, that is in files (column path); null if none is."""
    own = df.withColumn("_id", F.monotonically_increasing_id())
    asked = own.select("_id", F.posexplode(F.array(*candidates)).alias("_at", "path")).join(files.select("path").distinct(), "path")
    found = asked.groupBy("_id").agg(F.min_by("path", "_at").alias("found"))
    return own.join(found, "_id", "left").drop("_id")
