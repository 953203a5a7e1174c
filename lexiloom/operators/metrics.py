"""Evaluation of text pairs: alignment, micro averages, reports, confusions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distance, text as T


def align(ref: DataFrame, hyp: DataFrame, page: str = "page", line: str = "line_no") -> DataFrame:
    """Reference and hypothesis lines at the same place of a page; lines without a partner don't count."""
    return ref.select(page, line, F.col("text").alias("ref")).join(hyp.select(page, line, F.col("text").alias("hyp")), [page, line])


def alignment_counts(ref: DataFrame, hyp: DataFrame, page: str = "page") -> DataFrame:
    a = ref.groupBy(page).agg(F.count("*").alias("num_gt"))
    b = hyp.groupBy(page).agg(F.count("*").alias("num_pred"))
    both = a.join(b, page, "full_outer").select(page, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("num_gt", "num_pred")))
    return both.withColumn("num_aligned", F.least("num_gt", "num_pred"))


def with_word_edits(pairs: DataFrame) -> DataFrame:
    """pairs with word_edits, ref_words and hyp_words (sizes); each step is a projection, so words are cut once."""
    cut = pairs.withColumns({"_a": T.words(F.col("ref")), "_b": T.words(F.col("hyp"))})
    return cut.withColumns({"ref_words": F.size("_a"), "hyp_words": F.size("_b"), "word_edits": T.word_edits(F.col("_a"), F.col("_b"))}).drop("_a", "_b")


def wer_of_pairs(pairs: DataFrame) -> DataFrame:
    own = with_word_edits(pairs)
    return own.withColumn("wer", T.rate(F.col("word_edits"), F.col("ref_words"), F.col("hyp_words"))).drop("word_edits", "ref_words", "hyp_words")


def corpus_rates(pairs: DataFrame, *by: str) -> DataFrame:
    """Summed edits over summed sizes (1 at least for each reference), of characters and of words."""
    own = with_word_edits(pairs).select(*by, T.edits(F.col("ref"), F.col("hyp")).alias("e"), F.greatest(F.lit(1), F.length("ref")).alias("n"), F.col("word_edits").alias("we"), F.greatest(F.lit(1), F.col("ref_words")).alias("wn"))
    return own.groupBy(*by).agg(F.count("*").alias("n_pairs"), (F.sum("e") / F.sum("n")).alias("cer"), (F.sum("we") / F.sum("wn")).alias("wer"))


def corpus_cer(pairs: DataFrame, *by: str) -> DataFrame:
    own = pairs.select(*by, T.edits(F.col("ref"), F.col("hyp")).alias("e"), F.greatest(F.lit(1), F.length("ref")).alias("n"))
    return own.groupBy(*by).agg(F.count("*").alias("n_pairs"), (F.sum("e") / F.sum("n")).alias("cer"))


def suite_cer(pairs: DataFrame, page: str, *by: str) -> DataFrame:
    """A page's lines are concatenated in order before they are compared; nothing is added for empty pages."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "ref", "hyp")))
    joined = lambda c: F.array_join(F.transform(F.col("l"), lambda x: x[c]), "")
    pages = pairs.groupBy(*by, page).agg(ordered.alias("l")).select(*by, joined("ref").alias("ref"), joined("hyp").alias("hyp"))
    own = pages.select(*by, T.edits(F.col("ref"), F.col("hyp")).alias("e"), F.length("ref").alias("n"))
    total = own.groupBy(*by).agg(F.count("*").alias("n_pages"), F.sum("e").alias("edits"), F.sum("n").alias("chars"))
    return total.withColumn("cer", F.when(F.col("chars") > 0, F.col("edits") / F.col("chars")))


def field_accuracy(predicted: DataFrame, truth: DataFrame, key: str, normalize=T.strip) -> DataFrame:
    """Share of the truth's fields that are predicted equal; missing ones count as empty; 0 without fields."""
    p = predicted.select(key, F.col("value").alias("p"))
    right = (normalize(F.coalesce("p", F.lit(""))) == normalize(F.col("value"))).cast("int")
    return truth.join(p, key, "left").agg(F.coalesce(F.avg(right), F.lit(0.0)).alias("field_accuracy"))


def confusions(pairs: DataFrame, *by: str) -> DataFrame:
    """Counts of edit-script steps, by the standard library's matcher with its defaults (no built-in has its blocks)."""
    @F.pandas_udf("array<struct<op:string,ref:string,hyp:string>>")
    def steps(ref: pd.Series, hyp: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([[(op, a[i:j], b[k:l]) for op, i, j, k, l in SequenceMatcher(None, a, b).get_opcodes() if op != "equal"] for a, b in zip(ref, hyp, strict=True)])

    own = pairs.select(*by, F.explode(steps("ref", "hyp")).alias("s"))
    return own.groupBy(*by, "s.op", "s.ref", "s.hyp").agg(F.count("*").alias("n"))


def nearest_word(words: DataFrame, vocabulary: DataFrame, distance: int = 2) -> DataFrame:
    """word, corrected: itself if known, else the word within the distance that is nearest, first of the vocabulary in ties.

    Pairs come from an equi-join on what is left of words after up to `distance` deletions: two words within
    the distance have such a rest in common. The distance is then verified.
    """

    def rests(w: Column) -> Column:
        without = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(x))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
        level = out = F.array(w)
        for _ in range(distance):
            level = F.array_distinct(F.flatten(F.transform(level, without)))
            out = F.array_union(out, level)
        return out

    vocab = vocabulary.select("pos", F.col("value").alias("v"), F.explode(rests(F.col("value"))).alias("rest"))
    known = words.join(vocabulary.select(F.col("value").alias("word")).distinct(), "word", "left_semi").select("word", F.col("word").alias("corrected"))
    rest = words.join(vocabulary.select(F.col("value").alias("word")), "word", "left_anti")
    asks = rest.select("word", F.explode(rests(F.col("word"))).alias("rest"))
    near = asks.join(vocab, "rest").select("word", "v", "pos").distinct().select("word", "v", "pos", F.levenshtein("word", "v", distance).alias("d")).where("d >= 0")
    best = near.groupBy("word").agg(F.min_by("v", F.struct("d", "pos")).alias("corrected"))
    return known.unionByName(rest.join(best, "word", "left").select("word", F.coalesce("corrected", "word").alias("corrected")))


def verdict(n: Column, hits: Column) -> Column:
    return F.when(hits == 0, "clean").when(hits == n, "IN TRAIN").otherwise("PARTIAL")


def corrected_text(df: DataFrame, vocabulary: DataFrame, *keys: str, distance: int = 2) -> DataFrame:
    """keys, text: each word by its nearest word of the vocabulary, joined by one blank; keys tell rows apart, no words give an empty text.

    Each distinct word is looked up once.
    """
    cut = df.select(*keys, F.posexplode_outer(T.words(F.col("text"))).alias("_at", "word"))
    near = nearest_word(cut.where("word is not null").select("word").distinct(), vocabulary, distance)
    whole = cut.join(near, "word", "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "corrected"))).alias("_l"))
    return whole.select(*keys, F.array_join(F.transform("_l", lambda x: x["corrected"]), " ").alias("text"))


def first_hypothesis(hypotheses: Column) -> Column:
    """What a rescorer without a model gives: the first, or an empty text."""
    return F.coalesce(F.get(hypotheses, F.lit(0)), F.lit(""))


def match_rate(df: DataFrame, matched: Column, *by: str) -> DataFrame:
    """Share of a group's rows that match, and their number."""
    return df.groupBy(*by).agg(F.avg(matched.cast("double")).alias("matched"), F.count("*").alias("n"))


def with_status(df: DataFrame, status: DataFrame, key: str) -> DataFrame:
    """df with the status of its key; empty where none is known."""
    return df.join(status.select(key, F.col("status").alias("_s")), key, "left").withColumn("status", F.coalesce("_s", F.lit(""))).drop("_s")


def equal_counts(counts: DataFrame) -> DataFrame:
    """Pages that have as many predicted lines as reference ones: only these may be paired by place."""
    return counts.where("num_gt = num_pred")


def page_reports(ref: DataFrame, hyp: DataFrame, page: str = "page", line: str = "line_no") -> DataFrame:
    """One row a page: line counts of both sides, cer and wer over its aligned lines (1 without any) and per_line, an array of line, ref, hyp, cer."""
    pairs = with_word_edits(align(ref, hyp, page, line))
    own = pairs.select(page, line, "ref", "hyp", T.edits(F.col("ref"), F.col("hyp")).alias("e"), "word_edits", "ref_words")
    rate = T.rate(F.col("e"), F.length("ref"), F.length("hyp"))
    lines = own.groupBy(page).agg(
        (F.sum("e") / F.sum(F.greatest(F.lit(1), F.length("ref")))).alias("cer"),
        (F.sum("word_edits") / F.sum(F.greatest(F.lit(1), F.col("ref_words")))).alias("wer"),
        F.array_sort(F.collect_list(F.struct(F.col(line).alias("line"), "ref", "hyp", rate.alias("cer")))).alias("per_line"),
    )
    none = F.expr("cast(array() as array<struct<line:bigint,ref:string,hyp:string,cer:double>>)")
    return alignment_counts(ref, hyp, page).join(lines, page, "left").select(page, "num_gt", "num_pred", "num_aligned", *(F.coalesce(c, F.lit(1.0)).alias(c) for c in ("cer", "wer")), F.coalesce(F.col("per_line").cast("array<struct<line:bigint,ref:string,hyp:string,cer:double>>"), none).alias("per_line"))


def suite_report(pages: DataFrame, by: str, status: DataFrame) -> DataFrame:
    """One row a set of pages: their number, cer over each page's concatenated lines (null without characters) and status.

    A set's pages stay rows of their own, so no set is gathered in one task.
    """
    joined = lambda c: F.array_join(F.transform("per_line", lambda x: x[c]), "")
    own = pages.select(by, joined("ref").alias("ref"), joined("hyp").alias("hyp")).select(by, T.edits(F.col("ref"), F.col("hyp")).alias("e"), F.length("ref").alias("n"))
    total = own.groupBy(by).agg(F.count("*").alias("n"), F.sum("e").alias("_e"), F.sum("n").alias("_c"))
    return with_status(total.select(by, "n", F.when(F.col("_c") > 0, F.col("_e") / F.col("_c")).alias("cer")), status, by)


def report_lines(pages: DataFrame, page: str = "page") -> DataFrame:
    """name (page#line, two digits at least), ref, hyp, cer of each scored line."""
    own = pages.select(page, F.explode("per_line").alias("l"))
    return own.select(F.concat(F.col(page).cast("string"), F.lit("#"), F.format_string("%02d", "l.line")).alias("name"), "l.ref", "l.hyp", "l.cer")


RULE, THIN = "=" * 72, "-" * 72


def run_report(predicted: Column, truth: Column, settings: dict[str, Column], extra: dict[str, Column] | None = None) -> Column:
    """The text of a run's report from an array of predicted lines and one of reference lines (null or empty: none).

    settings stand at its head by name, extra ones after the number of lines. Decimals round half up in their shortest
    form. The wording and the order of lines are fixed values.
    """
    named = lambda d: [F.concat(F.lit(f"{k:15}: "), v.cast("string")) for k, v in (d or {}).items()]
    two = lambda i: F.format_string("%02d", i)
    one = F.format_string
    arr = lambda *c: F.array(*(F.lit(x) if isinstance(x, str) else x for x in c))
    head = arr(RULE, "EVALUATION METRICS", RULE, *named(settings), one("lines detected : %d", F.size(predicted)), *named(extra), THIN, "Full transcription", THIN)
    lines = F.transform(predicted, lambda t, i: F.concat(two(i + 1), F.lit(": "), t))
    n = F.least(F.size(truth), F.size(predicted))
    # each pair is compared once; Python's results come in beside the lambdas, which can't call it
    made = distance.all_edits(truth, predicted)
    counts = F.arrays_zip(*(made[c].alias(c) for c in distance.COUNTS))
    pairs = F.zip_with(truth, predicted, lambda a, b: F.struct(a.alias("ref"), b.alias("hyp")))
    pairs = F.zip_with(F.slice(pairs, F.lit(1), n), counts, lambda p, e: F.struct(p["ref"].alias("ref"), p["hyp"].alias("hyp"), *(e[c].alias(c) for c in distance.COUNTS)))
    total = lambda f: F.aggregate(pairs, F.lit(0).cast("long"), lambda a, p: a + f(p))
    c = total(lambda p: p["edits"]) / total(lambda p: F.greatest(F.lit(1), F.length(p["ref"])))
    w = total(lambda p: p["word_edits"]) / total(lambda p: F.greatest(F.lit(1), p["ref_words"]))
    c, w = (F.when(n > 0, x).otherwise(0.0) for x in (c, w))

    def scored(p: Column, i: Column) -> Column:
        lc, lw = T.rate(p["edits"], F.length(p["ref"]), F.length(p["hyp"])), T.rate(p["word_edits"], p["ref_words"], p["hyp_words"])
        first = one("%02d  CER=%.3f (%.1f%%)  WER=%.3f (%.1f%%)", i + 1, lc, T.accuracy_pct(lc), lw, T.accuracy_pct(lw))
        return F.when(p["ref"] == p["hyp"], first).otherwise(F.concat(first, F.lit("\n    GT: "), p["ref"], F.lit("\n    PR: "), p["hyp"]))

    note = F.when(F.size(truth) != F.size(predicted), F.array(one("NOTE: GT lines (%d) != detected (%d); detection under/over-segmentation affects the score.", F.size(truth), F.size(predicted)))).otherwise(F.expr("cast(array() as array<string>)"))
    rates = arr(
        one("Character Error Rate (CER) : %.4f  →  Character Accuracy: %.2f%%", c, T.accuracy_pct(c)),
        one("Word Error Rate (WER)      : %.4f  →  Word Accuracy: %.2f%%", w, T.accuracy_pct(w)),
        "  (Character Accuracy = (1 − CER) × 100%; Word Accuracy = (1 − WER) × 100%)", THIN, "Per-line CER / WER / accuracy",
    )
    known = F.concat(arr(THIN, one("Ground truth   : yes (%d GT lines, scoring %d aligned)", F.size(truth), n)), note, rates, F.transform(pairs, scored))
    unknown = arr(THIN, "Ground truth   : not available", "No CER/WER computed. Provide a sidecar `<image>.gt.txt` (one GT line per detected line).", one("non-empty lines: %d/%d", F.size(F.filter(predicted, lambda t: T.strip(t) != "")), F.size(predicted)))
    return F.array_join(F.concat(head, lines, F.when(F.size(F.coalesce(truth, F.expr("cast(array() as array<string>)"))) > 0, known).otherwise(unknown), F.array(F.lit(RULE))), "\n")
