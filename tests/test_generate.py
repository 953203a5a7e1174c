"""Generators, box arithmetic and settings."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from lexiloom import config
from lexiloom.operators import boxes, corpus, generate

WORDS = ["aa", "bb", "cc"]
NUMBER = r"\d{1,6}|[\d,]{1,6}\.\d\d|\d{1,3}%|\d{1,3}\.\d\d|[\d,]{1,7}"
DATE = r"\d{4}\.\d\d\.\d\d|\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}|\d{1,2}/\d{1,2}/\d{4}"
MIXED = r"(?:19|20)\d{10}|07\d{8}|[A-Z]{1,3}\d{3,4}|No\. \d{1,3}|(?:A/L|O/L|Grade|Ref) \d{1,4}"


def rows(spark, n):
    return spark.range(n).select(F.xxhash64("id").alias("seed"))


def test_tokens_have_their_forms(spark):
    s = F.col("seed")
    got = rows(spark, 2000).select(generate.number_token(s).alias("n"), generate.date_token(s).alias("d"), generate.mixed_token(s).alias("m")).collect()
    for column, form in (("n", NUMBER), ("d", DATE), ("m", MIXED)):
        assert all(re.fullmatch(form, r[column]) for r in got)
        assert len({r[column] for r in got}) > 1000
    assert 0.1 < sum("%" in r["n"] for r in got) / 2000 < 0.2


def test_composed_lines(spark):
    sentences = spark.createDataFrame([("one two three four five six seven eight",), ("nine",)], ["text"])
    lines = [r["line"] for r in generate.composed(spark, 800, WORDS, 2, 4, sentences).collect()]
    real = [x for x in lines if re.search("one|two|three|four|five|six|seven|eight|nine", x)]
    assert len(lines) == 800 and 0.58 < len(real) / 800 < 0.72
    assert all(x in "one two three four five six seven eight" or x == "nine" for x in real) and max(len(x.split()) for x in real) == 4
    assert lines == [r["line"] for r in generate.composed(spark, 800, WORDS, 2, 4, sentences).collect()]


def test_templates_numbers_refrains(spark):
    s, r = F.col("seed"), rows(spark, 300)
    assert {x["line"] for x in generate.from_templates(r, ["{a}  {b}"], {"a": ["x", "y"], "b": ["z", ""]}).collect()} == {"x z", "y z", "x", "y"}
    assert all(re.search(r"\d", x[0]) for x in r.select(generate.labelled_numbers(s, ["no"], ("Rs", "only"))).collect())
    marked = [x[0] for x in r.select(generate.refrain(F.lit("line.."), ["//"], s)).collect()]
    assert set(marked) == {"line..", "line//"} and 15 < marked.count("line//") < 80


def test_boxes(spark):
    df = spark.createDataFrame([([(5, 2, 100, 4), (0, 50, 30, 20), (0, 20, 5, 20)],)], "b array<struct<x:int,y:int,w:int,h:int>>")
    one = lambda c: df.select(c.alias("v")).first()["v"]
    assert [tuple(b) for b in one(boxes.keep_large(boxes.keep_relative(F.col("b"))))] == [(0, 50, 30, 20)]
    assert [b["y"] for b in one(boxes.reading_order(F.col("b")))] == [2, 20, 50]
    assert tuple(one(boxes.crop_bounds(F.col("b")[0], F.lit(90), F.lit(60)))) == (0, 19, 0, 90)
    assert one(boxes.resized_width(F.lit(5), F.lit(2), 1, 100)) == 2
    assert one(boxes.padded(F.expr("array(array(0.5D), array(0.1D, 0.2D))"))) == [[0.5, 1.0], [0.1, 0.2]]
    assert one(boxes.inverted(F.expr("array(0.0D, 200.0D)"))) is True
    band = F.expr("named_struct('y0', -5, 'y1', 500, 'x0', cast(null as int), 'x1', cast(null as int))")
    assert tuple(one(boxes.manual_box(band, F.lit(90), F.lit(60)))) == (0, 0, 90, 60)


def test_corpus_helpers(spark):
    df = spark.createDataFrame([("abca", "/r/labels/x.txt"), ("a", "/s/y.txt"), ("b", "/r2/z.txt")], ["text", "p"])
    assert corpus.occurrences(df, "a").first()["n"] == 3
    assert [r[0] for r in df.select(corpus.base_folder(F.col("p"), "/r")).collect()] == ["/r", "/s", "/r2"]


def test_settings(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"x": {"p": 1, "q": 2}, "y": 1}))
    (tmp_path / "b.json").write_text(json.dumps({"_inherits": "a.json", "x": {"q": 3}}))
    assert config.load(tmp_path / "b.json") == {"x": {"p": 1, "q": 3}, "y": 1}
    assert config.overridden({"x": {"p": 1}}, ["x.q=2.5", "z=TRUE", "w=t", "bad"]) == {"x": {"p": 1, "q": 2.5}, "z": True, "w": "t"}
