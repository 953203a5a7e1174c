"""The language-model queries against a plain model, over small tables."""

from __future__ import annotations

import math
from collections import Counter

from lexiloom.operators import language_model as lm
from lexiloom.plans import catalogue

TEXTS = ["the cat sat\non the mat\n\nthe tan hat", "a hen sat  \r\nthe mat", None, "  \n", "naïve සිං men", "the " * 40]


class Plain:
    def __init__(self, lines, order, discount):
        self.order, self.discount, self.n, self.total = order, discount, Counter(), Counter()
        for line in lines:
            for k, ctx, ch in self.grams(line):
                self.n[k, ctx, ch] += 1
                self.total[k, ctx] += 1
        self.size = max(1, sum(k == 0 for k, _, _ in self.n))

    def grams(self, line):
        s = lm.BEGIN * (self.order - 1) + line
        return [(k, s[i - k : i], s[i]) for i in range(self.order - 1, len(s)) for k in range(self.order)]

    def score(self, line):
        lp = 0.0
        for at in range(len(line)):
            p = 1 / (self.size + 1)
            for k, ctx, ch in self.grams(line)[at * self.order : (at + 1) * self.order]:
                if total := self.total[k, ctx]:
                    weight = total / (total + self.discount)
                    p = weight * self.n[k, ctx, ch] / total + (1 - weight) * p
            lp += math.log(p)
        return lp


def lines_of(text):
    return [x.strip() for x in (text or "").replace("\r\n", "\n").split("\n") if x.strip()]


def tables(spark, folder):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(TEXTS)], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    items = [(1, "the hen\nzzz\na mat"), (2, "men sat\nthe hat\nmen sat"), (3, None), (None, "the tan\nsee")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def test_every_line_of_an_item_gets_a_choice(spark, tmp_path):
    items = tables(spark, tmp_path)
    model = Plain([x for t in TEXTS for x in lines_of(t)], 6, 2.0)
    want = {(i, k): max((x, x.replace("e", "a")), key=model.score) for i, t in items for k, x in enumerate(lines_of(t))}
    got = catalogue.lm_gated_choice(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r["item_id"], r["pos"]): r["chosen"] for r in got} == want
    assert any("e" in x for x in want.values()) and {"zzz", "a mat"} < set(want.values())


def test_document_queries_have_the_reference_setting_and_every_line(spark, tmp_path):
    tables(spark, tmp_path)
    lines = {(i, k): x for i, t in enumerate(TEXTS) for k, x in enumerate(lines_of(t))}
    model = Plain(lines.values(), 6, 2.0)
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    assert {(r["k"], r["ctx"], r["ch"]): r["n"] for r in run("ngram_counts_documents")} == model.n
    assert {(r["k"], r["ctx"]): r["total"] for r in run("ngram_totals_documents")} == model.total
    assert [tuple(r) for r in run("lm_vocab_documents")] == [(model.size, len(model.total))]
    got = {(r["doc_id"], r["pos"]): r["lp"] for r in run("lm_logp_lines_documents")}
    assert got.keys() == lines.keys() and all(abs(got[k] - model.score(x)) < 1e-3 for k, x in lines.items())


def test_long_lines_and_large_alphabets_are_counted_whole(spark):
    lines = ["ab" * 5000, "".join(map(chr, range(0x4E00, 0x4E00 + 3000))), "x", "\U0001f600\u0002"]
    own = spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1)
    model = Plain(lines, 6, 2.0)
    assert {(r["k"], r["ctx"], r["ch"]): r["n"] for r in lm.counts(own, 6).collect()} == model.n
    want = Plain(lines, 3, 2.0)
    got = lm.positions(own, 3).groupBy("ctx", "ch").count().collect()
    assert {(2, r["ctx"], r["ch"]): r["count"] for r in got} == {k: n for k, n in want.n.items() if k[0] == 2}


def test_scores_take_no_job_while_planned_and_no_row_a_character(spark):
    """A line longer than a piece, a character that the model has not seen, a repeated key, a null line."""
    base = "the cat sat on a mat. "
    long = base * (lm.PIECE // len(base) + 2)
    train = [base, "a hen", "x"]
    model = Plain(train, 3, 2.0)
    counted = lm.counts(spark.createDataFrame([(x,) for x in train], "line string"), 3)
    rows = spark.createDataFrame([(1, long), (2, "the ජ"), (2, "hen"), (3, None), (None, "x")], "id int, line string")
    group = "plan of scores"
    spark.sparkContext.setJobGroup(group, group)
    scored = lm.score(rows, counted, 3, 2.0, "id")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == 0
    assert "explode(sequence(1" not in scored._jdf.queryExecution().optimizedPlan().toString()
    got = dict(map(tuple, scored.collect()))
    want = {2: model.score("the ජ") + model.score("hen"), None: model.score("x")}
    assert got.keys() == {1, 2, None} and all(abs(got[k] - x) < 1e-9 for k, x in want.items())
    whole = model.score(base * 3) - model.score(base * 2)  # each further copy adds the same
    assert abs(got[1] - (model.score(base) + whole * (len(long) // len(base) - 1))) < 1e-3
