"""Values and edge cases that must be as in the reference."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import history, metrics, sequence
from lexiloom.sources import readers
from lexiloom.streaming import live


def test_default_characters():
    chars = T.default_characters()
    assert len(chars) == len(set(chars)) == 224
    # indices count from 1
    assert [chars.index(c) + 1 for c in ("0", "a", "Z", " ", ".", "`", "$", "‍", "‌", "඀", "෿")] == [1, 11, 62, 63, 64, 93, 94, 95, 96, 97, 224]
    assert "^" not in chars


def test_digits(spark):
    texts = ["12", "²³", "①②", "a1", "½", "٣", ""]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(T.digit_ratio(F.col("t"))).collect()]
    assert got == [sum(c.isdigit() for c in t) / max(1, len(t)) for t in texts]


def test_no_band_is_high_enough(spark):
    low = F.expr("array(named_struct('y0', 0, 'y1', 2), named_struct('y0', 5, 'y1', 7))")
    some = F.expr("array(named_struct('y0', 0, 'y1', 2), named_struct('y0', 5, 'y1', 17))")
    r = spark.range(1).select(sequence.drop_low(low).alias("a"), sequence.drop_low(some).alias("b")).first()
    assert [tuple(x) for x in r["a"]] == [(0, 2), (5, 7)] and [tuple(x) for x in r["b"]] == [(5, 17)]


def test_log_lines_in_any_case(spark):
    lines = ["Epoch 001 | Train_Loss = .5 | LR = 4.00e-05", "12:00 | EPOCH 1|VAL  cer =0.0348 | val WER = 0.0912", "epoch 2 | val CER = 0.1 | WER = 0.3", "epoch 3 | val CER = e-"]
    rows = history.parse_log(spark.createDataFrame(list(enumerate(lines)), "pos int, value string"))
    got = {r["epoch"]: (r["train_loss"], r["lr"], r["val_cer"], r["val_wer"]) for r in rows.collect()}
    assert got == {1: (0.5, 4e-5, 0.0348, 0.0912), 2: (None, None, 0.1, None)}
    assert tuple(history.best_value(rows).first()) == (2, 0.0348)


def test_an_update_that_repeats_an_epoch(spark, tmp_path):
    h = spark.createDataFrame([(1, 0.1), (2, 0.2)], "epoch int, val_cer double")
    up = history.upsert_epoch(h, spark.createDataFrame([(2, 0.3), (2, 0.05), (3, None)], "epoch int, val_cer double").coalesce(1))
    assert sorted(map(tuple, up.collect())) == [(1, 0.1), (2, 0.05), (3, None)]
    for k in range(3):
        spark.createDataFrame([(k, 0.5), (k, 0.4)], "epoch int, val_cer double").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema("epoch int, val_cer double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    live.maintain_history(stream, str(tmp_path / "h"), str(tmp_path / "c")).awaitTermination(120)
    left = sorted(p.name for p in (tmp_path / "h").iterdir() if not p.name.startswith("."))
    assert len(left) == 2
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "h" / left[-1])).collect())) == [(0, 0.4), (1, 0.4), (2, 0.4)]


def test_windows_are_counted_and_late_rows_left_out(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:01", "a", 1.0), (2, "2024-01-01 00:04:00", "a", 2.0), (3, "2024-01-01 00:06:00", "b", 3.0)]
    spark.createDataFrame(rows, "id int, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "e"))
    stream = live.event_windows(spark.readStream.schema("id int, ts timestamp, event_type string, value double").parquet(str(tmp_path / "e")))
    stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r["event_type"], r["n"], r["total"]) for r in spark.table("windows").collect()) == [("a", 2, 3.0), ("b", 1, 3.0)]


def test_globs_and_line_numbers(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"l{k}.txt").write_text("".join(f"p{i}\ttext {i}\r\n" for i in range(3000)))
    got = readers.labels(spark, [str(tmp_path / "l*.txt"), str(tmp_path / "none*.txt")])
    assert got.count() == 6000 and got.where("rel_path <> concat('p', pos)").count() == 0
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # many splits of a file
    try:
        assert readers.labels(spark, str(tmp_path / "l1.txt")).where("rel_path = concat('p', pos)").count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_log_encodings(spark, tmp_path):
    line = "epoch 001 | train_loss = 0.5 “é€”"
    for name, raw in (("u8", line.encode()), ("u16", line.encode("utf-16")), ("le", line.encode("utf-16-le")), ("win", line.encode("cp1252"))):
        (tmp_path / name).write_bytes(raw)
        assert [r["value"] for r in readers.log_text(spark, str(tmp_path / name)).collect()] == [line], name
    (tmp_path / "bad").write_bytes(b"epoch 001 \x81 \xff")
    assert readers.log_text(spark, str(tmp_path / "bad")).first()["value"].startswith("epoch 001 �")


def joined(boxes, gap=6, height=28):
    """Pairs of a round by their first index, chosen greedily from the left."""
    boxes = sorted(boxes, key=lambda b: b[1::-1])
    near = [abs(a[1] + a[3] // 2 - b[1] - b[3] // 2) <= gap and a[3] <= height and b[3] <= height and 0 <= b[0] - a[0] - a[2] <= max(12, a[2] // 2) for a, b in zip(boxes, boxes[1:], strict=False)]
    chosen = set()
    for i, ok in enumerate(near):
        if ok and i - 1 not in chosen:
            chosen.add(i)
    if not chosen:
        return boxes
    out = []
    for i, b in enumerate(boxes):
        if i in chosen:
            c = boxes[i + 1]
            left, top = min(b[0], c[0]), min(b[1], c[1])
            out.append((left, top, max(b[0] + b[2], c[0] + c[2]) - left, max(b[1] + b[3], c[1] + c[3]) - top))
        elif i - 1 not in chosen:
            out.append(b)
    return joined(out, gap, height)


def test_neighbours_are_joined_until_nothing_changes(spark):
    rnd = random.Random(3)
    sets = [[(rnd.randrange(200), 10 * rnd.randrange(3) + rnd.randrange(3), rnd.randrange(5, 60), rnd.randrange(5, 32)) for _ in range(rnd.randrange(9))] for _ in range(150)]
    sets += [[(40 * i, 5, 30, 10) for i in range(9)], [(0, 0, 5, 5), (0, 0, 9, 5), (10, 0, 5, 5)]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, b array<struct<x:int,y:int,w:int,h:int>>")
    got = {r["i"]: [tuple(b) for b in r["m"]] for r in df.select("i", sequence.merge_neighbours(F.col("b")).alias("m")).collect()}
    assert got == {i: joined(s) for i, s in enumerate(sets)} and any(len(got[i]) < len(s) for i, s in enumerate(sets))


def test_nearest_word(spark):
    words = ["hause", "house", "hoouse", "xyz", "a", "", "mouse", "houses2", "ab"]
    vocab = [(0, "mouse"), (1, "house"), (2, "b"), (3, "houses")]
    df = metrics.nearest_word(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(vocab, "pos int, value string"))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    known = {v for _, v in vocab}
    best = lambda w: min(((distance(w, v), p, v) for p, v in vocab if distance(w, v) <= 2), default=(0, 0, w))[2]
    assert {r["word"]: r["corrected"] for r in df.collect()} == {w: w if w in known else best(w) for w in words}
