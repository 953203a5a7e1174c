"""Vectors of single operators, readers, and every query against its SQL."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lexiloom.functions import rewrite, text as T
from lexiloom.operators import corpus, history, language_model as lm, metrics, sequence
from lexiloom.sources import readers
from lexiloom.streaming import live

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("a", "b", "want"), [("hello", "hallo", 0.2), ("", "", 0.0), ("", "x", 1.0), ("ක්‍ෂ", "ක්ෂ", 0.25)])
def test_cer(spark, a, b, want):
    assert one(spark, T.cer(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


@pytest.mark.parametrize(("a", "b", "want"), [("the quick fox", "the quick dog", 1 / 3), ("", " ", 0.0), (" a  b ", "a b", 0.0), ("", "x", 1.0)])
def test_wer(spark, a, b, want):
    assert one(spark, T.wer(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


def test_corpus_rates(spark):
    pairs = spark.createDataFrame([("abc", "abd"), ("de", "de")], ["ref", "hyp"])
    assert metrics.corpus_cer(pairs).first()["cer"] == pytest.approx(0.2)
    assert metrics.corpus_rates(pairs).first()["wer"] == pytest.approx(0.5)


def test_accuracy(spark):
    assert one(spark, T.accuracy_pct(F.lit(0.0455))) == pytest.approx(95.45)
    assert one(spark, T.accuracy_pct(F.lit(1.2))) == 0
    assert one(spark, T.accuracy_pct(F.lit("bad"))) == 0


@pytest.mark.parametrize(("frames", "want"), [([1, 1, 0, 1, 2, 2], [1, 1, 2]), ([0, 1, 1, 0, 2], [1, 2]), ([1, 0, 1], [1, 1]), ([0], [])])
def test_collapse(spark, frames, want):
    assert one(spark, sequence.collapse(F.col("f")), f=frames) == want


#: Lines and what the rules make of them.
LINES = [
    ("රැකවරෙණී", "රැකවරණේ"), ("දෙරෙණ් සරණ", "දෙරණේ සරණ"), ("පිපුණේී", "පිපුණේ"), ("සරණී..//", "සරණේ...//"), ("දිෙනක", "දිනෙක"), ("කොඩි වෙලා", "කොඩි වෙලා"), ("දෑෙස්", "දෑස්"),
    ("සිසිලෙන් තෙමුණේ", "සිසිලෙන් තෙමුණේ"), ("ලෙලෙදෙන", "ලෙලදෙන"), ("වැවි බැඳුණේ..", "වැව් බැඳුණේ.."), ("නැගුණි...//", "නැගුණේ...//"), ("ලොව මැවුණ", "ලොව මැවුණේ"), ("තිගැස්සු", "තිගැස්සූ"),
    ("ගමේ මිනිස්සු සහ", "ගමේ මිනිස්සු සහ"), ("හමුවලා හදවෙතේ", "හමුවෙලා හදවතේ"), ("යළි උපදිමි මේ", "යළි උපදිම් මේ"), ("ගොනු හිත්", "ගොනු හිතේ"), ("මගහැරී ගිලිහුනෙම", "මඟහැරී ගිලිහුනෙම"),
]


def test_rewrite(spark):
    rows = spark.createDataFrame(LINES, ["line", "want"]).select("want", rewrite.fix_line(F.col("line")).alias("fixed")).collect()
    assert [r["fixed"] for r in rows] == [r["want"] for r in rows]


def test_reorder_sees_swapped_state(spark):
    assert one(spark, rewrite.reorder(F.col("t")), t="ෙනෙක") == "නෙකෙ"


def test_charset(spark):
    chars = T.default_characters(".,")
    assert one(spark, T.decode(T.encode(F.col("t"), chars), chars), t="a1‍ ක?") == "a1‍ක"


def test_log_and_history(spark, tmp_path):
    text = "12:00:00 | INFO | t | epoch 001 | train_loss = 0.5 | lr = 0.001\n12:00:01 | INFO | t | epoch 001 | val CER = 0.09 | val WER = 0.2\nnoise\n12:00:02 | INFO | t | epoch 002 | train_loss = 0.4\n12:00:03 | INFO | t | epoch 002 | train_loss = 0.39\n"
    (tmp_path / "a.log").write_bytes(text.encode("utf-16"))
    got = {r["epoch"]: r for r in history.parse_log(readers.log_text(spark, str(tmp_path / "a.log"))).collect()}
    assert got[1]["val_cer"] == 0.09 and got[1]["lr"] == 0.001 and got[2]["train_loss"] == 0.39 and got[2]["val_cer"] is None
    h = spark.createDataFrame([(1, 0.1), (2, 0.2)], ["epoch", "val_cer"])
    up = history.upsert_epoch(h, spark.createDataFrame([(2, 0.05)], ["epoch", "val_cer"]))
    assert sorted(map(tuple, up.collect())) == [(1, 0.1), (2, 0.05)]


def test_readers(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a.png\tone\ttwo\nnotab\n\nb.png\tthree\n# c\n")
    got = readers.labels(spark, [str(tmp_path / "l.txt"), str(tmp_path / "missing.txt")]).orderBy("pos").collect()
    assert [(r["pos"], r["rel_path"], r["text"]) for r in got] == [(0, "a.png", "one\ttwo"), (3, "b.png", "three")]
    assert readers.word_list(spark, str(tmp_path / "l.txt")).count() == 3
    assert readers.word_list(spark, str(tmp_path / "missing.txt")).count() == 0


def test_bands_and_boxes(spark):
    assert [tuple(b) for b in one(spark, sequence.bands(F.col("p"), 1.0), p=[0.0, 1.0, 2.0, 0.0, 3.0])] == [(1, 3), (4, 5)]
    boxes = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip("xywh", b, strict=True))) for b in [(0, 0, 10, 10), (20, 2, 10, 10), (0, 30, 5, 5)]))
    assert [(b["x"], b["y"], b["w"], b["h"]) for b in one(spark, sequence.merge_overlapping(boxes))] == [(0, 0, 30, 12), (0, 30, 5, 5)]


def test_beam_prefers_model():
    import numpy as np

    frames = np.log(np.array([[0.01, 0.97, 0.01, 0.01], [0.02, 0.02, 0.5, 0.46]]))
    assert sequence.best_prefix(frames, ["a", "x", "y"]) == "ax"
    assert sequence.best_prefix(frames, ["a", "x", "y"], model=lambda text, ch: -5.0 if ch == "x" else -0.1, weight=1.0) == "ay"


def test_model_is_a_distribution(spark):
    lines = spark.createDataFrame([("abab",), ("abba",)], ["line"])
    counted = lm.counts(lines, 3)
    pairs = spark.createDataFrame([("ab", c) for c in "ab"], ["ctx", "ch"])
    total = lm.log_probabilities(pairs, counted, 3, 1.0).agg(F.sum(F.exp("lp"))).first()[0]
    assert 0.8 < total <= 1.0


def test_split_is_whole(spark):
    n = {r["split"]: r["count"] for r in corpus.split(spark.range(101).withColumnRenamed("id", "k"), {"a": 0.7, "b": 0.15, "c": 0.15}, 1, "k").groupBy("split").count().collect()}
    assert n == {"a": 70, "b": 15, "c": 16}


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, 0.1)], "epoch int, val_cer double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("epoch int, val_cer double").parquet(str(tmp_path / "in"))
    live.maintain_history(stream, str(tmp_path / "h"), str(tmp_path / "c")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "h" / "v0")).count() == 1


def _norm(v):
    return round(v, 6) if isinstance(v, float) else v


OWN = [n for n in __spark_entry__.oracle_sql() if not n.startswith(("op", "pipeline"))]


@pytest.mark.parametrize("name", OWN)
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted((tuple(map(_norm, r)) for r in df.collect()), key=key) == sorted((tuple(_norm(r[i]) for i in at) for r in want.fetchall()), key=key)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_digits_and_blanks_take_time_in_line_with_the_text(spark):
    """Runs of blanks inside a text, and long texts without a digit, were walked again and again."""
    import time

    texts = ["x" + " " * 300_000 + "7", "é" * 300_000 + "①", "  4a\x1c", " \t", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    began = time.time()
    own = df.select("i", T.strip(F.col("t")), T.digits(F.col("t")), T.looks_like_garbage(F.col("t"), 0.4))
    got = {r[0]: tuple(r)[1:] for r in own.collect()}
    assert got == {0: (texts[0], 1, False), 1: (texts[1], 1, False), 2: ("4a", 1, True), 3: ("", 0, False), 4: ("", 0, False)}
    assert time.time() - began < 30
