"""Interpolated character n-gram model as tables: counts, totals, scores of texts, choices between candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types
from pyspark.sql import Window as W

from ..functions import rewrite, text as T
from . import lookup

#: Fixed value: what stands before the first character.
BEGIN = "\u0002"
#: Characters in a piece of a line, coarse to fine; no result depends on them.
PIECES = (2048, 64)
#: Characters of a line that one row has at most; no result depends on it.
PIECE = 1 << 20


def positions(lines: DataFrame, order: int, *keys: str) -> DataFrame:
    """One row a character: keys, ctx (order - 1 characters before it) and ch. Long lines are cut in overlapping pieces first, as a substring walks its text from the start."""
    own = lines.where(F.length("line") > 0).select(*keys, F.concat(F.lit(BEGIN * (order - 1)), F.col("line")).alias("p"))
    for size in PIECES:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("p") - (order - 1)), F.lit(size))
        own = own.select(*keys, "p", F.explode(starts).alias("i")).select(*keys, F.substring("p", F.col("i"), F.lit(size + order - 1)).alias("p"))
    own = own.select(*keys, "p", F.explode(F.sequence(F.lit(1), F.length("p") - (order - 1))).alias("i"))
    return own.select(*keys, F.substring("p", F.col("i"), F.lit(order - 1)).alias("ctx"), F.substring("p", F.col("i") + order - 1, F.lit(1)).alias("ch"))


def pieces(lines: DataFrame, order: int, *keys: str) -> DataFrame:
    """keys, p: each line that is not empty, after order - 1 marks of its begin. Lines longer than PIECE go in several rows, each after the characters before it."""
    own = lines.where(F.length("line") > 0).select(*keys, F.concat(F.lit(BEGIN * (order - 1)), F.col("line")).alias("p"))
    starts = F.sequence(F.lit(1), F.length("p") - (order - 1), F.lit(PIECE))
    cut = F.transform(starts, lambda i: F.substring(F.col("p"), i, F.lit(PIECE + order - 1)))
    return own.select(*keys, F.explode(F.when(F.length("p") < PIECE + order, F.array("p")).otherwise(cut)).alias("p"))


def _windows(own: list[str], order: int) -> tuple[np.ndarray, np.ndarray, str]:
    """Of pieces: the number of each window in turn, the windows that each piece has, and the distinct windows by number as one text."""
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    codes = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32)
    place = np.zeros(int(codes.max()) + 1, np.int64)
    place[codes] = 1
    base = int(place.sum())
    place[place > 0] = np.arange(base)
    ids = place[codes]
    begins, ends = np.ones(len(codes), bool), np.cumsum(sizes)
    for k in range(1, order):
        begins[ends - k] = False
    at = np.flatnonzero(begins)
    key, size = ids[at], base
    for k in range(1, order):
        if size * base >= 1 << 62:  # windows so far are numbered anew
            key, seen = pd.factorize(key)
            size = len(seen)
        key, size = key * base + ids[at + k], size * base
    number, seen = pd.factorize(key)
    first = np.empty(len(seen), np.int64)
    first[number[::-1]] = at[::-1]
    text = codes[first[:, None] + np.arange(order)]
    return number, sizes - order + 1, np.ascontiguousarray(text).astype("<u4").tobytes().decode("utf-32-le")


def longest(lines: DataFrame, order: int) -> DataFrame:
    """ctx, ch, n for contexts of order - 1 characters. Each task counts some MB of lines at a time, so only distinct windows travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lookup.parts(batches):
            number, _, whole = _windows(batch.column("p").to_pylist(), order)
            text = [pa.array([whole[i : i + order - 1] for i in range(0, len(whole), order)], pa.string()), pa.array(list(whole[order - 1 :: order]), pa.string())]
            yield pa.RecordBatch.from_arrays([*text, pa.array(np.bincount(number), pa.int64())], ["ctx", "ch", "n"])

    return pieces(lines, order).mapInArrow(run, "ctx string, ch string, n long").groupBy("ctx", "ch").agg(F.sum("n").alias("n"))


def counts(lines: DataFrame, order: int) -> DataFrame:
    """k, ctx, ch, n for k = 0 .. order - 1. The longest contexts are counted once; shorter ones are sums of these."""
    each = longest(lines, order).select(F.explode(F.sequence(F.lit(0), F.lit(order - 1))).alias("k"), "ctx", "ch", "n")
    return each.select("k", F.expr("right(ctx, k)").alias("ctx"), "ch", "n").groupBy("k", "ctx", "ch").agg(F.sum("n").alias("n"))


def totals(counted: DataFrame) -> DataFrame:
    return counted.groupBy("k", "ctx").agg(F.sum("n").alias("total"))


def sizes(counted: DataFrame) -> DataFrame:
    """Characters seen, and contexts of all lengths; each context is one group, so no distinct set is expanded."""
    return counted.groupBy("k", "ctx").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("k") == 0, F.col("n"))), F.lit(0)).alias("vocabulary"), F.count("*").alias("contexts"))


def log_probabilities(pairs: DataFrame | None, counted: DataFrame, order: int, discount: float) -> DataFrame:
    """ctx, ch, lp of distinct pairs (None: those of the model): from 1 / (V + 1), each known context interpolates with weight N / (N + discount).

    A pair takes the probability of the one that is a character shorter, from the shortest on. Rows of a level
    are distinct, so a key has no more rows than there are characters.
    """
    own = counted.where(F.col("k") == order - 1).select("ctx", "ch", "n", F.lit(pairs is None).alias("asked"))
    if pairs is not None:
        own = own.unionByName(pairs.select("ctx", "ch", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked")))
    each = own.select(F.explode(F.sequence(F.lit(0), F.lit(order - 1))).alias("k"), "ctx", "ch", "n", "asked").withColumn("ctx", F.expr("right(ctx, k)"))
    cells = each.groupBy("k", "ctx", "ch").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    known = W.partitionBy("k", "ctx")
    cells = cells.select("*", F.sum("n").over(known).alias("total"), F.count(F.when(F.col("n") > 0, 1)).over(known).alias("kinds")).where("asked")
    weight = F.col("total") / (F.col("total") + discount)
    step = lambda p: F.when(F.col("total") > 0, F.col("n") / (F.col("total") + discount) + (1 - weight) * p).otherwise(p)
    out = cells.where("k = 0").select("ctx", "ch", step(1.0 / (F.greatest(F.lit(1), F.col("kinds")) + 1)).alias("p"))
    for k in range(1, order):
        shorter = out.select(F.col("ctx").alias("up"), "ch", F.col("p").alias("q"))
        level = cells.where(F.col("k") == k).select(F.expr(f"right(ctx, {k - 1})").alias("up"), "ctx", "ch", "n", "total")
        out = level.join(shorter, ["up", "ch"]).select("ctx", "ch", step(F.col("q")).alias("p"))
    return out.select("ctx", "ch", F.when(F.col("p") > 0, F.log("p")).otherwise(-30.0).alias("lp"))


def score(lines: DataFrame, counted: DataFrame, order: int, discount: float, *keys: str, of_model: bool = False) -> DataFrame:
    """keys, lp: summed log probability of each line. Each distinct (context, character) is scored once, and asked for once by each few MB of lines.

    of_model: the lines are those that were counted.
    """
    scores = log_probabilities(None if of_model else longest(lines, order), counted, order, discount)
    own = pieces(lines, order, *keys)

    def ask(batch: pa.RecordBatch) -> pa.Array:
        whole = _windows(batch.column("p").to_pylist(), order)[2]
        return pa.array([whole[i : i + order] for i in range(0, len(whole), order)], pa.string())

    def answer(batch: pa.RecordBatch, values: pa.Array) -> pa.RecordBatch:
        number, sizes, _ = _windows(batch.column("p").to_pylist(), order)
        lp = np.add.reduceat(values.to_numpy(zero_copy_only=False)[number], np.cumsum(sizes) - sizes)
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(lp)], [*keys, "lp"])

    schema = types.StructType([*own.select(*keys).schema.fields, types.StructField("lp", types.DoubleType())])
    each = lookup.looked_up(own, scores.select(F.concat("ctx", "ch").alias("w"), F.col("lp").alias("value")), ask, answer, schema)
    return each.groupBy(*keys).agg(F.sum("lp").alias("lp"))


def gated(candidates: DataFrame, counted: DataFrame, order: int, discount: float, *keys: str) -> DataFrame:
    """keys, chosen of every row: the second of (first, second) where its score is strictly higher. Each distinct pair is scored once."""
    both = F.array(*(F.struct(F.lit(c == "second").alias("later"), F.col(c).alias("line")) for c in ("first", "second")))
    lines = candidates.select("first", "second").distinct().select("first", "second", F.inline(both))
    lp = lambda later: F.max(F.when(F.col("later") == later, F.col("lp"))).alias(f"lp_{later}".lower())
    scored = score(lines, counted, order, discount, "first", "second", "later").groupBy("first", "second").agg(lp(False), lp(True))
    each = candidates.join(scored, ["first", "second"], "left")
    return each.select(*keys, F.when(F.col("lp_true") > F.col("lp_false"), F.col("second")).otherwise(F.col("first")).alias("chosen"))


def model_lines(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.explode(T.lines(F.col("text"))).alias("line"))


def word_endings(lines: DataFrame, counted: DataFrame, order: int, discount: float, *keys: str, ending: str = rewrite.ENDING, instead: str = rewrite.INSTEAD) -> DataFrame:
    """keys, line: a word's ending, marks after it aside, gives way to the other one where the model scores that word strictly higher.

    Lines are never cut in rows of words: a distinct word is scored once, and asked for once by each few MB of lines.
    Blanks stay as they are, a null line stays null.
    """
    asked = F.coalesce(F.contains("line", F.lit(ending)), F.lit(False))
    own = lines.where(asked).select(*keys, "line")
    core = rewrite.word_with(ending)

    def words(batch: pa.RecordBatch) -> list[str]:
        return list(dict.fromkeys(w for x in batch.column("line").to_pylist() for w in core.findall(x)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lookup.parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(words(batch), pa.string())], ["first"])

    first = lines.where(asked).select("line").mapInArrow(run, "first string").distinct()
    pairs = first.select("first", rewrite.other_ending(F.col("first"), ending, instead).alias("second"))
    changed = gated(pairs, counted, order, discount, "first").where("chosen <> first").select(F.col("first").alias("w"), F.col("chosen").alias("value"))

    def answer(batch: pa.RecordBatch, values: pa.Array) -> pa.RecordBatch:
        new = {w: v or w for w, v in zip(words(batch), values.to_pylist(), strict=True)}
        line = [core.sub(lambda m: new[m[0]], x) for x in batch.column("line").to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(line, pa.string())], [*keys, "line"])

    done = lookup.looked_up(own, changed, lambda batch: pa.array(words(batch), pa.string()), answer, own.schema)
    return lines.where(~asked).select(*keys, "line").unionByName(done)


def fixed_lines(lines: DataFrame, counted: DataFrame, order: int, discount: float, *keys: str) -> DataFrame:
    """keys, line: all rewrite rules, the one that asks the model last."""
    return word_endings(lines.select(*keys, rewrite.fix_line(F.col("line")).alias("line")), counted, order, discount, *keys)
