"""The five stages against plain code, on a small part of their own making."""

from __future__ import annotations

import random

import brute

import corpus_pipeline
from pyspark.sql import functions as F

from lexiloom.llm import common, quality
from lexiloom.llm.queries import tokenizer


def test_stages(spark, tmp_path):
    rnd = random.Random(9)
    good = lambda: " ".join(rnd.choice(["the", "of", "river", "stone", "was", "over", "light", "a", "green", "hill"]) for _ in range(80)) + "."
    texts = [good() if i % 4 else " ".join(["CLICK!!"] * 40) for i in range(120)]
    texts[11], texts[13] = texts[9], texts[9].replace(" ", "  ")
    texts[21] = texts[22] + " more words here"
    texts[25] = "write to bob@mail.com " + texts[26]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, expected = spark.read.parquet(f"{tmp_path}/documents.parquet"), {i: t for i, t, *_ in docs}
    scores = {r["doc_id"]: r["predicted"] for r in quality.quality_scores(at, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    assert all(scores[i] == int(i % 4 > 0) for i in expected)
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "quality":
            expected = {i: t for i, t in expected.items() if scores[i]}
        elif name == "exact":
            expected = {i: expected[i] for i, _, _, kept, _ in brute.exact(sorted(expected.items())) if kept}
        elif name == "near":
            expected = {i: expected[i] for i, _, c in brute.components(sorted(expected.items())) if c == i}
        elif name == "pii":
            expected = {i: t.replace("bob@mail.com", "[EMAIL]") for i, t in expected.items()}
        if name != "packing":
            assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert {r["doc_id"]: r["text"] for r in at.collect()} == expected
            assert all(r["n_chars"] == len(r["text"]) for r in at.collect())
    brute.check_packing(sorted(expected.items()), [tuple(r) for r in at.collect()], tokenizer("byte_bpe_50k.json"))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(expected)


def odd(spark, rows):
    """Rows with columns whose names are those of inner ones."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(c) for c in ("row", "key", "tie", "found", "spans", "masked", "label", "best", "size", "c_text", "_text", "chars", "plain")})


ROWS = [
    (1, "same text", "en", "a", 9), (2, "same text", "en", "b", 9), (2, "other text", "en", "c", 10), (None, "same  text", "de", "d", 10), (None, None, "fr", "e", None),
    (3, "", "en", "f", 0), (4, " ", "en", "g", 1), (5, "mail a@b.com", "en", "h", 12), (5, "mail a@b.com", "en", "h", 12), (5, "mail a@b.com", None, None, None), (6, "one two three four five six seven", "es", "i", 32), (None, "One two three four five  six seven", "es", "j", 32), (7, "x" * 100_000, "en", "k", 100_000),
]


def test_stages_on_odd_rows(spark):
    df = odd(spark, ROWS)
    plain = lambda out: sorted(((r["doc_id"] is None, r["doc_id"], r["text"] or "", str(r["source"])) for r in out.collect()), key=str)
    kept = corpus_pipeline.drop_copies(spark, df, "")
    assert kept.columns == df.columns and all(r["_text"] == "_text" and r["row"] == "row" for r in kept.collect())
    got = kept.collect()
    # the longest of equal texts stays though its id is null; blank, empty and null texts are one group; the second row of id 2 is its own
    assert sorted(r["source"] or "" for r in got if "@" not in (r["text"] or "")) == ["c", "d", "g", "i", "j", "k"]
    assert sum("@" in (r["text"] or "") for r in got) == 1 and len(got) == len({brute.BLANK.sub("", r[1] or "") for r in ROWS})
    near = corpus_pipeline.drop_near_copies(spark, df, "")
    rows = near.collect()
    assert near.columns == df.columns
    # equal words are near: ids come before null, and of equal ids one row stays; rows without words all stay
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in rows) == sorted([(False, 1, "same text"), (False, 2, "other text"), (True, 0, ""), (False, 3, ""), (False, 4, " "), (False, 5, "mail a@b.com"), (False, 6, ROWS[10][1]), (False, 7, "x" * 100_000)])
    masked = corpus_pipeline.mask_personal_data(spark, df, "")
    assert masked.columns == df.columns and masked.count() == len(ROWS)
    assert plain(masked) == sorted(((r[0] is None, r[0], (r[1] or "").replace("a@b.com", "[EMAIL]"), str(r[3])) for r in ROWS), key=str)
    assert corpus_pipeline.pack(spark, df, "").agg(F.countDistinct("doc_id")).first()[0] == 7


def test_stages_on_an_empty_table(spark, tmp_path):
    none = odd(spark, ROWS[:1]).where("false")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_quality_stage_keeps_rows_as_they_are(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = odd(spark, ROWS)  # without labels every score is 1/2
    assert sorted(map(str, corpus_pipeline.keep_good(spark, df, str(tmp_path)).collect())) == sorted(map(str, df.collect()))


def test_dedup_stages_neither_copy_nor_exchange_texts(spark, monkeypatch):
    twins = [(30, "a b c d e f g", None, "x", 13), (30, "a b c d e f g", "x", None, 13), (30, "a b c d e f g", "x", None, 13), (31, None, "q", None, None), (31, "q", None, None, None), (31, "q", None, None, None)]
    df, written = odd(spark, ROWS + twins), []
    plain = common.Tables.written
    monkeypatch.setattr(common.Tables, "written", lambda self, df, name: written.extend((name, c) for c, kind in df.dtypes if "string" in kind) or plain(self, df, name))
    monkeypatch.setattr(common, "SENT_ROWS", 1000)
    shown = lambda out: sorted(map(str, out.collect()))
    one = {}
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        out = stage(spark, df, "")
        assert out.columns == df.columns and "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        one[stage] = shown(out)
    assert not written
    texts = sorted((r["text"] or "").replace(" ", "") for r in corpus_pipeline.drop_copies(spark, df, "").collect())
    assert texts == sorted({(r[1] or "").replace(" ", "") for r in ROWS + twins})
    # the same rows where there are too many marks to broadcast
    monkeypatch.setattr(common, "SENT_ROWS", 0)
    for stage, rows in one.items():
        assert shown(stage(spark, df, "")) == rows
    # a table that would be another when it is read again is written first
    drawn = df.withColumn("draw", F.rand())
    assert corpus_pipeline.drop_copies(spark, drawn, "").count() == len(texts) and any(name == "whole" for name, _ in written)
