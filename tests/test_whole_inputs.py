"""Queries that must use every page and every class."""

from __future__ import annotations

from lexiloom.plans import catalogue


def test_pages_of_one_parity_are_compared(spark, tmp_path):
    pages = [(0, "http://a/x?q"), (2, "http://b/x"), (1, "http://a/y"), (3, "http://c/y?r"), (4, "http://a/z"), (5, None)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {tuple(r) for r in catalogue.leak_basenames_all(spark, str(tmp_path)).collect()}
    assert got == {(0, 2, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 0)}


def test_no_class_is_pruned(spark, tmp_path, monkeypatch):
    asked = []
    search = catalogue.sequence.beam_search
    monkeypatch.setattr(catalogue.sequence, "beam_search", lambda *a, **k: asked.append(k.get("top", 8)) or search(*a, **k))
    assert catalogue.prefix_beam(spark, "/root/testdata/sf0.001").count() > 0
    assert min(asked) >= 4 or asked == [0]
