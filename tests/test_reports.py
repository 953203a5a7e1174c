"""Reports, histories, the model's word rule, bands, boxes and the corpus build, against plain code and fixed vectors."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import rewrite
from lexiloom.operators import boxes, corpus, generate, history, language_model as lm, metrics, sequence
from lexiloom.sources import readers


def test_word_endings_follow_the_model(spark):
    train = spark.createDataFrame([("මම යමි",)] * 1 + [("ඔහු කම් කම් කම්",)] * 9, "line string")
    counted = lm.counts(train, 3).cache()
    texts = ["කමි  යමි..//", "මි", "කමි", "", None, "කමි/ abc\tකමි"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, line string")
    got = dict(map(tuple, lm.word_endings(rows, counted, 3, 2.0, "id").collect()))
    assert got[1] == "මි" and got[3] == "" and got[4] is None
    scores = {w: s for w, s in lm.score(spark.createDataFrame([("කමි",), ("කම්",), ("යමි",), ("යම්",)], "line string"), counted, 3, 2.0, "line").collect()}
    assert scores["කම්"] > scores["කමි"]  # else nothing is tested
    word = lambda core: core[:-2] + "ම්" if scores[core[:-2] + "ම්"] > scores[core] else core
    assert got[0] == word("කමි") + "  " + word("යමි") + "..//" and got[2] == word("කමි") and got[5] == word("කමි") + "/ abc\t" + word("කමි")
    fixed = lm.fixed_lines(spark.createDataFrame([(0, "පිපුණේී කමි")], "id int, line string"), counted, 3, 2.0, "id").first()["line"]
    assert fixed == "පිපුණේ " + word("කමි")
    parts = spark.createDataFrame([("a  b\n",)], "t string").select(rewrite.parts(F.col("t"))).first()[0]
    assert parts == ["a", "  ", "b", "\n"]


def test_histories_of_three_shapes(spark, tmp_path):
    rows = [{"epoch": 1, "train_loss": 0.5, "val_cer": 0.25, "lr": ""}, {"epoch": 2, "train_loss": "x", "val_cer": 0.125}]
    files = {"a": {"epochs": [1, 2, 3], "train_loss": [0.5], "val_cer": [None, 0.5, 0.25, 9]}, "b": {"history": rows, "best_val_cer": 0.0625}, "c": rows, "d": []}
    for name, value in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value, indent=1))
    got = {}
    for r in readers.train_history(spark, str(tmp_path / "*.json")).orderBy("source", "pos").collect():
        got.setdefault(os.path.basename(r["source"])[0], []).append((r["epoch"], r["train_loss"], r["val_cer"], r["lr"], r["best_val_cer"]))
    records = [(1, 0.5, 0.25, None), (2, None, 0.125, None)]
    assert got == {"a": [(1, 0.5, None, None, 0.25), (2, None, 0.5, None, 0.25), (3, None, 0.25, None, 0.25)], "b": [(*r, 0.0625) for r in records], "c": [(*r, 0.125) for r in records]}
    whole = history.as_columns(readers.train_history(spark, str(tmp_path / "a.json")), "source").first()
    assert whole["epochs"] == [1, 2, 3] and whole["val_cer"] == [None, 0.5, 0.25] and whole["best_val_cer"] == 0.25
    assert history.points(readers.train_history(spark, str(tmp_path / "a.json")), "train_loss").count() == 1


def test_which_log_is_used(spark, tmp_path):
    epoch = "epoch 001 | train_loss = 0.5\n"
    for k, (name, text) in enumerate({"old.log": epoch, "train_b.log": epoch * 2, "train_x.log": "nothing here\n", "empty.log": ""}.items()):
        (tmp_path / name).write_text(text)
        os.utime(tmp_path / name, (1_700_000_000 + k, 1_700_000_000 + k))
    find = lambda preferred: os.path.basename(readers.find_train_log(spark, str(tmp_path), preferred))
    assert find([]) == "train_b.log" and find(["train_x.log", "old.log"]) == "old.log" and find(["none.log"]) == "train_b.log"
    assert readers.find_train_log(spark, str(tmp_path / "none"), []) is None
    assert readers.resolve_history(spark, str(tmp_path), []).first()["train_loss"] == 0.5
    with pytest.raises(FileNotFoundError):
        readers.resolve_history(spark, str(tmp_path / "none"), [])


def test_page_and_suite_reports(spark):
    ref = spark.createDataFrame([("a", 1, "abc d"), ("a", 2, ""), ("b", 1, "x"), ("c", 1, "y")], "page string, line_no long, text string")
    hyp = spark.createDataFrame([("a", 1, "abd d"), ("a", 2, "q"), ("a", 3, "z"), ("b", 1, "x")], "page string, line_no long, text string")
    pages = metrics.page_reports(ref, hyp).cache()
    got = {r["page"]: r for r in pages.collect()}
    assert [(p, got[p]["num_gt"], got[p]["num_pred"], got[p]["num_aligned"], got[p]["cer"], got[p]["wer"]) for p in "abc"] == [("a", 2, 3, 2, 2 / 6, 2 / 3), ("b", 1, 1, 1, 0.0, 0.0), ("c", 1, 0, 0, 1.0, 1.0)]
    assert [tuple(x) for x in got["a"]["per_line"]] == [(1, "abc d", "abd d", 0.2), (2, "", "q", 1.0)] and got["c"]["per_line"] == []
    sets = pages.withColumn("set", F.when(F.col("page") == "c", "two").otherwise("one"))
    report = metrics.suite_report(sets, "set", spark.createDataFrame([("one", "held out")], "set string, status string"))
    assert sorted(map(tuple, report.collect())) == [("one", 2, 2 / 6, "held out"), ("two", 1, None, "")]
    assert sorted(metrics.report_lines(pages).select("name").collect()) == [("a#01",), ("a#02",), ("b#01",)]


def test_run_report(spark):
    df = spark.createDataFrame([(1, ["ab c", "x"], ["ab d", "x", "y"]), (2, ["", "z"], None)], "id int, pred array<string>, ref array<string>")
    own = df.select("id", metrics.run_report(F.col("pred"), F.col("ref"), {"decode": F.lit("beam")}, {"note": F.lit(3)}).alias("r"))
    one, two = (r["r"].split("\n") for r in own.orderBy("id").collect())
    assert one[:6] == ["=" * 72, "EVALUATION METRICS", "=" * 72, "decode         : beam", "lines detected : 2", "note           : 3"]
    assert "01: ab c" in one and "Ground truth   : yes (3 GT lines, scoring 2 aligned)" in one and any(x.startswith("NOTE: GT lines (3) != detected (2)") for x in one)
    assert "Character Error Rate (CER) : 0.2000  →  Character Accuracy: 80.00%" in one and "Word Error Rate (WER)      : 0.3333  →  Word Accuracy: 66.67%" in one
    assert one[-5:] == ["01  CER=0.250 (75.0%)  WER=0.500 (50.0%)", "    GT: ab d", "    PR: ab c", "02  CER=0.000 (100.0%)  WER=0.000 (100.0%)", "=" * 72]
    assert "Ground truth   : not available" in two and two[-2] == "non-empty lines: 1/2"


def test_text_is_corrected_word_by_word(spark):
    vocab = spark.createDataFrame(list(enumerate(["house", "mouse", "tree"])), "pos int, value string")
    df = spark.createDataFrame([(1, " hoose  tre\nhouse elephants "), (2, ""), (3, None), (4, "tre tre")], "id int, text string")
    assert sorted(map(tuple, metrics.corrected_text(df, vocab, "id").collect())) == [(1, "house tree house elephants"), (2, ""), (3, ""), (4, "tree tree")]
    assert spark.range(1).select(metrics.first_hypothesis(F.array(F.lit("a"), F.lit("b"))), metrics.first_hypothesis(F.expr("cast(array() as array<string>)"))).first() == ("a", "")


def test_bands_of_a_page(spark):
    profile = [0.0] * 200
    for a, b in ((10, 30), (50, 70), (72, 75), (100, 120), (150, 151)):
        profile[a:b] = [50.0] * (b - a)
    df = spark.createDataFrame([(1, profile, 500), (2, [0.0] * 40, 500)], "id int, profile array<double>, width int")
    got = {r["id"]: [tuple(b) for b in r["bands"]] for r in sequence.page_bands(df, "id").collect()}
    # the mark of three rows goes to the band above it, the one-row band is dropped
    assert got == {1: [(10, 30), (50, 75), (100, 120)], 2: []}
    mean = spark.createDataFrame([([float(i % 7) for i in range(500)],)], "p array<double>").select(sequence.smoothed(F.col("p"), 0.006)).first()[0]
    p = [0.0, *[float(i % 7) for i in range(500)], 0.0]
    assert mean == pytest.approx([sum(p[i : i + 3]) / 3 for i in range(500)])
    flat = spark.createDataFrame([([0.0, 9.0, 0.0, 9.0, 0.0],), ([0.0, 0.0],)], "p array<double>").select(sequence.equal_bands(F.col("p"), F.lit(100), F.lit(3))).collect()
    assert [tuple(b) for b in flat[0][0]] == [(1, 2), (2, 3), (3, 4)] and [tuple(b) for b in flat[1][0]] == [(0, 2)]
    page = [[0] * 20 for _ in range(6)]
    page[2][7], page[3][9] = 1, 1
    box = spark.createDataFrame([(page,)], "r array<array<int>>").select(sequence.ink_box(F.col("r"), F.lit(1), F.lit(5)), sequence.ink_box(F.col("r"), F.lit(4), F.lit(6))).first()
    assert tuple(box[0]) == (3, 1, 11, 4) and box[1] is None


def test_refined_boxes(spark):
    found = [(0, 0, 30, 10), (35, 1, 30, 10), (5, 5, 3, 3), (0, 40, 50, 20), (10, 45, 60, 12), (0, 100, 40, 40)]
    df = spark.createDataFrame([([dict(zip("xywh", b)) for b in found],)], "b array<struct<x:int,y:int,w:int,h:int>>")
    assert [tuple(b) for b in df.select(boxes.refined(F.col("b"))).first()[0]] == [(0, 0, 65, 11), (0, 40, 70, 20), (0, 100, 40, 40)]


def test_decoders_by_name(spark):
    frames = [[-1.0, -0.1, -3.0], [-1.0, -0.1, -3.0], [-0.1, -2.0, -3.0], [-2.0, -0.1, -3.0], [-2.0, -3.0, -0.1]]
    df = spark.createDataFrame([(1, frames)], "id int, f array<array<double>>")
    for mode in ("greedy", "Beam", "lm", None):
        assert sequence.decode(df, "id", "f", ["a", "b"], mode).first()["text"] == "aab"
    with pytest.raises(ValueError, match="unknown decode mode"):
        sequence.decode(df, "id", "f", ["a", "b"], "best")


def test_built_corpus(spark):
    seeds = spark.createDataFrame([(0, "one two three four five six seven"), (1, "one two"), (2, "one two")], "pos long, line string")
    make = lambda least: generate.built(seeds, ["{a} and {b}"], {"a": list("abcdefgh"), "b": list("abcdefgh")}, ["w1", "w2"], ["no"], ("EUR", "net"), (5, 6, 3, 4), least, turns=4, each=10)
    small, full = ([r["line"] for r in make(n).orderBy("place").collect()] for n in (0, 1000))
    assert len(set(small)) == len(small) <= 20 and {"one two", "one two three four five six seven"} <= set(small)
    assert set(small) < set(full) and len(full) - len(small) <= 40
    enough = len(make(len(small) + 1).collect())
    assert len(small) < enough <= len(small) + 10
    assert [r["place"] for r in make(0).orderBy("place").collect()] == list(range(len(small)))


def test_confusable_words_and_candidates(spark):
    words = ["ගණේෂ", "\"සරත්\"", "abc", "", "මිනිසා", "සූ?"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(words)), "i int, w string").orderBy("i").select(corpus.is_confusable(F.col("w"))).collect()]
    assert got == [True, True, False, False, True, True]
    images = spark.createDataFrame([("a.png",), ("b.png",), ("c.png",), ("a.png",)], "image string")
    files = spark.createDataFrame([("a.png.gt.txt",), ("a.gt.txt",), ("b.gt.txt",)], "path string")
    found = corpus.first_of(images, files, [F.concat("image", F.lit(".gt.txt")), F.regexp_replace("image", "[.]png$", ".gt.txt")])
    assert sorted(map(tuple, found.collect()), key=str) == [("a.png", "a.png.gt.txt"), ("a.png", "a.png.gt.txt"), ("b.png", "b.gt.txt"), ("c.png", None)]


def test_charset_and_reference_lines(spark, tmp_path):
    readers.write_charset(spark.createDataFrame([(2, "b"), (1, "a"), (3, "ක")], "idx int, ch string"), str(tmp_path / "c"))
    assert sorted(map(tuple, readers.charset(spark, str(tmp_path / "c")).collect())) == [(1, "a"), (2, "b"), (3, "ක")]
    (tmp_path / "p.gt.txt").write_text("one \n\n  \ntwo\n")
    assert [tuple(r)[1:] for r in readers.gt_lines(spark, str(tmp_path / "p.gt.txt")).orderBy("line_no").collect()] == [(1, "one "), (2, "two")]


def test_long_pairs_are_compared_by_bits(spark):
    """30,000 characters a side, and more distinct words than a code point could stand for, in seconds; cells one by one would take minutes."""
    import time

    a = "".join(chr(97 + i * i % 23) for i in range(30_000))
    b = "xy" + a[:14_000] + "q" + a[14_003:] + "zz"
    words = " ".join(map(str, range(45_000)))
    df = spark.createDataFrame([(a, b), (words, "x " + words), ("ab c", "ab  d"), ("", "q"), (None, "q")], "ref string, hyp string")
    began = time.time()
    one = df.where("length(ref) = 30000").select("ref", "hyp").withColumn("page", F.lit(1)).withColumn("line_no", F.lit(1)).withColumn("set", F.lit(0))
    assert metrics.suite_cer(one, "page", "set").first()["edits"] == 7
    assert [r["word_edits"] for r in metrics.with_word_edits(df.where("length(ref) <> 30000")).collect()] == [1, 1, 1]
    report = df.where("ref is not null and length(ref) < 100").select(metrics.run_report(F.array("hyp", "hyp", "hyp"), F.array("ref", "hyp"), {}).alias("r")).collect()
    assert "01  CER=0.500 (50.0%)  WER=0.500 (50.0%)" in report[0]["r"] and "02  CER=0.000 (100.0%)  WER=0.000 (100.0%)" in report[0]["r"]
    assert time.time() - began < 60
