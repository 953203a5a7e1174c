"""Each operator against its plain definition: odd rows, repeated rows, empty tables, clashing column names."""

from __future__ import annotations

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import common as C
from lexiloom.llm import exact_dedup, jaccard_join, packing, pii, quality, sentencepiece_codec, suffix_repeats, token_counts, top_k, word_repeats
from lexiloom.llm.queries import tokenizer

PIECES, BYTES = tokenizer("piece_bpe_32k.model"), tokenizer("byte_bpe_50k.json")


def odd_texts() -> list[str | None]:
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdeéñ") for _ in range(rnd.randint(1, 6)))
    passage = " ".join(word() for _ in range(70))
    base = [word() for _ in range(120)]
    near = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in range(0, 120, 9)]
    return [
        None, "", " ", "\n\t ", "a", "A b", "a  b", "aB", "it's we're <|endoftext|> I'll", "▁ mark", "世界 𝒳 \x00", "x" * 5000, "a " * 3000, " " * 300,
        passage, "Before. " + passage + " after", passage + " " + passage, passage.upper(), *near, " ".join(base), " ".join(base), "  ".join(base),
        "mail bob.42@mail8.example.com or a@b.c%x@d.e, x@y, +1 (234) 567-8901 call 4041894974608795, card 4111 1111 1111 1111 at 42.144.35.254 or 1.2.3.4.5 or 256.1.1.1 or 000000010.1.1.1",
        "phone (555) 123-4567, tel 555-123-4567, version 555-123-4567", "é@é 4111111111111111é 12.34.56.78", "9" * 3000, "a@" * 2000, "+1" + "(" * 2000, "1." * 2000,
    ]


def frame(spark, rows, repeat=False):
    """Rows with columns whose names clash with inner ones."""
    docs = spark.createDataFrame([(i, t) for i, t in rows] * (2 if repeat else 1), "doc_id long, text string").repartition(3)
    return docs.withColumns({c: F.lit(1) for c in ("chunk", "hash", "kind", "n", "label", "size", "bucket", "spans", "base", "part", "score", "words")})


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(odd_texts()))


def got(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_sentencepiece(spark, rows):
    assert got(sentencepiece_codec.piece_digests(frame(spark, rows), PIECES)) == sorted(brute.pieces(rows, PIECES))


def test_sentencepiece_random():
    import pyarrow as pa
    import sentencepiece

    sp, rnd = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(3)
    texts = ["".join(rnd.choice("abetion sx\né世▁ ") for _ in range(rnd.randrange(80))) for _ in range(1500)]
    ids, starts = sentencepiece_codec.encode_batch(PIECES, pa.array(texts))
    decoded = sentencepiece_codec.decode_batch(PIECES, ids, starts)
    for i, t in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == sp.encode(t)
        assert decoded[i].decode() == sp.decode(sp.encode(t))


def test_token_counts(spark, rows):
    assert got(token_counts.token_counts(frame(spark, rows), BYTES)) == sorted(brute.counts(rows, BYTES))


def test_frequent_words_cover_all_rows(spark, monkeypatch):
    """Rows in order of their language, most words once: what is frequent in the last rows only is found, over several rounds of merging."""
    monkeypatch.setattr(token_counts, "FIRST_BYTES", 64)
    monkeypatch.setattr(token_counts, "FAN_IN", 3)
    rare = lambda i: " ".join(f"r{chr(97 + i % 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [(i, rare(i) + (" late" * 20 if i >= 60 else " early" * 30)) for i in range(80)]
    docs = C.texts(frame(spark, rows).repartitionByRange(12, "doc_id"))
    exact = token_counts.frequent_words(docs, BYTES, entries=2)
    assert exact == [b" early", b" late"]
    assert set(token_counts.frequent_words(docs, BYTES, kept=16)) >= {b" early", b" late"}  # 5 % of all words, and more
    assert token_counts.frequent_words(docs.where("false"), BYTES) == []


def test_summary_is_never_short_by_more_than_its_share():
    rnd, summary, plain = random.Random(3), token_counts.Summary(20), {}
    for _ in range(200):
        words = [b"%d" % min(int(rnd.paretovariate(0.7)), 5000) for _ in range(30)]
        summary.add(words, [1] * len(words))
        for w in words:
            plain[w] = plain.get(w, 0) + 1
    summary.cut()
    assert len(summary.counts) <= 20
    assert all(n - sum(plain.values()) / 20 <= summary.counts.get(w, 0) <= n for w, n in plain.items())


def test_packing(spark, rows):
    brute.check_packing(rows, got(packing.packed(frame(spark, rows), BYTES)), BYTES)


def test_pii(spark, rows):
    out = pii.span_digests(frame(spark, rows))
    assert got(out, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(brute.pii(rows))
    for r in out.collect():
        base = {f"{k}:{a}:{b}" for k, a, b in brute.base_spans(rows[r["doc_id"]][1])}
        assert base <= set(r["spans"].split(",")) | {""} and len(base) <= len(r["spans"].split(",")) or not base


def test_pii_adds_national_numbers(spark):
    docs = [(1, "phone (555) 123-4567"), (2, "version 555-123-4567"), (3, "clean"), (4, "+1 (826) 555-4081 190.137.223.204"), (5, "+1 (826) 555-4081")]
    want = [(1, "national:6:20"), (2, ""), (3, ""), (4, "ip:18:33,national:3:17"), (5, "phone:0:17")]
    assert got(pii.span_digests(frame(spark, docs)), "doc_id", "spans") == want


def test_pii_finds_cards_in_longer_runs(spark):
    valid, invalid = "4111 1111 1111 1111", "4111 1111 1111 1112"
    docs = [(i, f"pay {valid} soon") for i in range(8)] + [(8, f"x {valid} {invalid} y"), (9, f"x {invalid} y")]
    found = dict(got(pii.span_digests(frame(spark, docs)), "doc_id", "spans"))
    assert found[8] == "card:2:21" and found[9] == "" and found[0] == "card:4:23"


def test_span_model_equals_plain_one():
    rnd = random.Random(6)
    counts = sorted({(k, tuple(rnd.choice((-1, 0, 1)) for _ in range(4)), rnd.choice((0, 11, 16))): rnd.randint(1, 300) for k in (0, 1, 2, 3, 4) for _ in range(6)}.items())
    counts = [(*key, n) for key, n in counts]
    model = pii.Model(counts)
    posterior, score = brute.span_model(counts)
    assert [model.posterior[c[:3]] for c in counts] == pytest.approx(posterior.tolist(), abs=1e-9)
    assert [model.score(*c[:3]) for c in counts] == pytest.approx(score.tolist(), abs=1e-9)
    assert any(s > 0.5 and c[1][0] < 1 for s, c in zip(score, counts, strict=True)) and any(s < 0.5 for s in score)


def test_pii_takes_linear_time(spark):
    """The third text has 16 times the matches of the second; the first warms up."""
    import time

    took = []
    for n in (10, 5000, 80_000):
        df = spark.createDataFrame([(1, "é bob@mail.com, " * n)], "doc_id long, text string")
        start = time.time()
        found = pii.personal_spans(df, keep=True)
        r = found.select(F.size("spans").alias("n"), pii.masked(F.col("row.text"), F.col("spans")).alias("m")).first()
        took.append(time.time() - start)
        assert r["n"] == n and r["m"] == "é [EMAIL], " * n
    assert took[2] < 45


def test_mask(spark):
    text = "see a@b.com, a@b.com"
    df = frame(spark, [(1, text), (2, None), (3, "clean")])
    out = pii.personal_spans(df, keep=True)
    assert {r[0]: r[1] for r in out.select("doc_id", pii.masked(F.col("row.text"), F.col("spans"))).collect()} == {1: "see [EMAIL], [EMAIL]", 2: None, 3: "clean"}


def test_exact(spark, rows):
    assert got(exact_dedup.exact_groups(frame(spark, rows))) == sorted(brute.exact(rows))


def test_word_repeats(spark, rows):
    assert got(word_repeats.word_repeats(frame(spark, rows), digest=True)) == sorted(brute.word_repeats(rows))


def test_byte_repeats(spark, rows):
    assert got(suffix_repeats.suffix_repeats(frame(spark, rows), digest=True)) == sorted(brute.byte_repeats(rows))


def test_hot_minimisers_are_split(spark, rows, monkeypatch):
    """With every repeated minimiser hot: the split runs in the workers' functions, so the constant goes with them."""
    import pyarrow as pa

    from lexiloom.llm import common, repeats

    monkeypatch.setattr(repeats, "HOT", 0)
    for u, resolve, want in ((repeats.Units(True, 50, 6), word_repeats.resolve, brute.word_repeats), (repeats.Units(False, 50, 20), suffix_repeats.resolve, brute.byte_repeats)):
        docs = [(i, t or "") for i, t in rows]
        half = [[(i, t) for i, t in docs if i % 2 == k] for k in (0, 1)]
        tables = []
        for k, part in enumerate(half):
            texts = [t.encode() for _, t in part]
            tables.append(pa.table({"chunk": [k], "ids": [np.array([i for i, _ in part]).tobytes()], "hashes": [np.zeros(len(part), np.int64).tobytes()], "sizes": [np.array([len(t) for t in texts], np.int32).tobytes()], "data": [common.squeeze(b"".join(texts))]}))
        asked = [repeats._ask(u, 1)((pa.scalar(k),), t) for k, t in enumerate(tables)]
        replies = repeats._reply(pa.concat_tables(asked)).to_pylist()
        assert all(len(r["bits"]) % 2 == 0 for r in replies)
        requests = [repeats._requests(u, 1)((pa.scalar(k),), t, pa.Table.from_pylist([r for r in replies if r["chunk"] == k])) for k, t in enumerate(tables)]
        answers = repeats._answers(u, resolve)(pa.concat_tables(requests)).to_pylist()
        removed = {}
        for k, t in enumerate(tables):
            chunk = common.Chunk(t)
            bounds = chunk.bounds if not u.words else np.r_[0, np.cumsum([len(brute.words(dict(docs)[i])) for i in chunk.ids.tolist()])]
            own = pa.Table.from_pylist([a for a in answers if a["chunk"] == k]) if any(a["chunk"] == k for a in answers) else repeats.messages([], [], [], [])
            gone = repeats._covered(u, own, bounds)
            removed |= {i: int(gone[a:b].sum()) for i, a, b in zip(chunk.ids.tolist(), bounds[:-1], bounds[1:], strict=True)}
        assert removed == {r[0]: r[2] for r in want(rows)}


def test_collision_falls_back_to_bytes(monkeypatch):
    data = np.frombuffer(b"abcabdabc", np.uint8)
    h = suffix_repeats.Hashes(data)
    monkeypatch.setattr(suffix_repeats.Hashes, "agree", lambda self, p, q, limit: limit)  # every comparison collides
    code = suffix_repeats.classes(h, np.array([0, 3, 6]), np.array([3, 3, 3]), np.zeros(3, np.int64))
    assert code[0] == code[2] != code[1]


def test_merge_sort_is_sorted():
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 99, 400).astype(np.uint8)
    starts, sizes, group = rnd.integers(0, 350, 200), rnd.integers(1, 50, 200), rnd.integers(0, 4, 200)
    order = suffix_repeats.merge_sort(suffix_repeats.Hashes(data), starts, sizes, group)
    keys = [(group[i], data[starts[i] : starts[i] + sizes[i]].tobytes()) for i in order]
    assert keys == sorted(keys)


def test_merges_start_from_suffixes_that_agree(monkeypatch):
    """Suffixes of one group that differ at once need no comparison of hashes, and equal ones a few each."""
    rnd = np.random.default_rng(2)
    data, done = rnd.integers(97, 123, 1 << 15).astype(np.uint8), []
    plain = suffix_repeats.Hashes.less
    monkeypatch.setattr(suffix_repeats.Hashes, "less", lambda self, p, *rest: done.append(len(p)) or plain(self, p, *rest))
    starts = np.r_[rnd.permutation(len(data) - 60)[:4000], [7, 7, 7]]
    sizes = np.full(len(starts), 50)
    order = suffix_repeats.merge_sort(suffix_repeats.Hashes(data), starts, sizes, np.zeros(len(starts), np.int64))
    keys = [data[starts[i] : starts[i] + 50].tobytes() for i in order]
    assert keys == sorted(keys) and sum(done) < len(starts)


def test_minimisers_are_sorted_in_parts(monkeypatch):
    """A bucket's strings are hashed some minimisers at a time, and windows get what all at once would give them."""
    from lexiloom.llm import repeats

    rnd = np.random.default_rng(3)
    texts = [rnd.integers(97, 99, 20).astype(np.uint8) for _ in range(40)]
    data = [np.r_[rnd.integers(97, 99, 5), texts[i % 40], rnd.integers(97, 99, 30)].astype(np.uint8) for i in range(400)]
    sizes = np.full(400, 55)
    s = repeats.Strings(rnd.permutation(400), np.full(400, 6, np.uint8).astype(np.int64), np.arange(400).astype(np.uint64) % 40, np.full(400, 5), np.cumsum(sizes) - sizes, sizes, np.concatenate(data))
    u, built = repeats.Units(False, 50, 20), []
    plain = suffix_repeats.Hashes.__init__
    monkeypatch.setattr(suffix_repeats.Hashes, "__init__", lambda self, data: built.append(len(data)) or plain(self, data))
    whole = suffix_repeats.resolve(u, s)
    monkeypatch.setattr(suffix_repeats, "PART_BYTES", 2000)
    built.clear()
    assert np.array_equal(suffix_repeats.resolve(u, s), whole) and sum(built) == len(s.data) and max(built) <= 2000
    least = {}
    for i in sorted(range(400), key=lambda i: s.ids[i]):
        for k in range(6):
            least.setdefault((i % 40, data[i][k : k + 50].tobytes()), s.ids[i])
    assert whole.tolist() == [least[i % 40, data[i][k : k + 50].tobytes()] for i in range(400) for k in range(6)]


def test_jaccard(spark, rows):
    assert got(jaccard_join.linked(frame(spark, rows))) == sorted(brute.components(rows))


def test_fragments_follow_the_sets_and_not_the_input(spark, rows, monkeypatch):
    """Each fragment gives a row a pair, so more chunks of the input must not give more of them."""
    seen, plain = [], jaccard_join._segments
    monkeypatch.setattr(jaccard_join, "grid", lambda docs: (70, 64))
    monkeypatch.setattr(jaccard_join, "_segments", lambda fragments: seen.append(fragments) or plain(fragments))
    assert got(jaccard_join.linked(frame(spark, rows))) == sorted(brute.components(rows))
    assert seen == [jaccard_join.FRAGMENTS] and seen[0] < 70


def test_jaccard_large_group(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10_000)}" for _ in range(150)]
    docs = []
    for i in range(60):  # near copies of every degree, more than a small group holds
        own = list(base)
        for k in rnd.sample(range(150), rnd.randrange(0, 9)):
            own[k] = f"x{rnd.randrange(10_000)}"
        docs.append((i, " ".join(own)))
    assert got(jaccard_join.linked(frame(spark, docs))) == sorted(brute.components(docs))


def test_jaccard_meetings(spark, monkeypatch):
    """All pairs of large groups come from the last meetings, in small blocks, or from many further members."""
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(10_000)}" for _ in range(80)]
    docs = []
    for i in range(90):
        own = base[: rnd.choice((60, 70, 80))]
        for k in rnd.sample(range(len(own)), rnd.randrange(0, 5)):
            own[k] = f"x{rnd.randrange(40)}"
        docs.append((i, " ".join(own)))
    want = sorted(brute.components(docs))
    monkeypatch.setattr(jaccard_join, "FEW", 1)
    monkeypatch.setattr(jaccard_join, "MEETING", 8)
    assert got(jaccard_join.linked(frame(spark, docs))) == want
    monkeypatch.setattr(jaccard_join, "EASY", -1)
    assert got(jaccard_join.linked(frame(spark, docs))) == want


def test_counts_in_a_byte_are_in_order():
    n = np.unique(np.r_[np.arange(5000), 2 ** np.arange(12, 28)])
    code = jaccard_join.coded(n).astype(int)
    back = jaccard_join.decoded(jaccard_join.coded(n))
    assert (np.diff(code) >= 0).all() and (back[:128] == n[:128]).all() and (abs(back - n) <= 0.07 * n).all()


def test_rows_of_repeated_and_null_ids(spark):
    """Rows are documents of their own: equal to brute force whatever the ids."""
    words_ = " ".join(f"w{i}" for i in range(60))
    texts = ["same text", words_, words_ + " more", "other text", "same  text", "", None, "a b c d e f g h"]
    ids = [2, 2, 7, 2, None, 5, None, None]
    rows = [(i, t) for i, t in zip(ids, texts, strict=True)] + [(1, "same text"), (2, "same text"), (9, words_ + " x"), (None, words_ + " y")]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    ours = lambda df: sorted((tuple(r) for r in df.collect()), key=key)
    assert ours(exact_dedup.exact_groups(frame(spark, rows))) == sorted(brute.exact(rows), key=key)
    assert ours(jaccard_join.linked(frame(spark, rows))) == sorted(brute.components(rows), key=key)


def test_top_k_rounds(spark, monkeypatch):
    """Many rounds, blocks of queries and both prunings; repeated ids, empty and very large vectors."""
    rnd = np.random.default_rng(3)
    v = [(i, (rnd.normal(size=6) * rnd.choice([0.3, 1, 5])).astype(np.float32).tolist()) for i in range(300)]
    v += [(20, v[3][1]), (20, v[5][1]), (1, v[9][1]), (500, []), (501, []), (None, v[3][1]), (60, [1e7] * 6), (7, [-1e7] * 6), (80, [1e6] * 4), (0, [1.0, 0.5])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    for name, value in (("BLOCK", 16), ("FIRST", 32), ("GROWTH", 3), ("QUERIES", (4, 8))):
        monkeypatch.setattr(top_k, name, value)
    assert got(top_k.top_products(df, F.col("vec_id") % 20 == 0)) == sorted(brute.top_products(v))
    tiny = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0, 0.5]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [r["score"] for r in top_k.top_products(tiny, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [12288, 6144]
    with pytest.raises(Exception, match="beyond 64 bits"):
        top_k.top_products(spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()


def test_coordinate_pruning_keeps_all_that_reach():
    rnd = np.random.default_rng(4)
    v = rnd.integers(-50, 50, (500, 5))
    bucket = top_k.Bucket(np.arange(500), np.arange(500), v)
    for q in rnd.integers(-50, 50, (20, 5)):
        norm = np.sqrt((q * q).sum())
        for cosine in (0.5, 0.9):
            near = set(bucket.near(q / norm, cosine).tolist())
            reach = np.flatnonzero(bucket.v @ q >= cosine * norm * bucket.norm)
            assert set(reach.tolist()) <= near


def test_top_k(spark):
    rnd = np.random.default_rng(2)
    v = [(i, (rnd.normal(size=8) * rnd.choice([0.3, 1, 5])).astype(np.float32).tolist()) for i in range(400)]
    v += [(400, None), (401, [float("nan")] * 8), (402, [None] * 8), (403, [0.0] * 8), (420, [0.0] * 8), (440, v[3][1]), (441, v[3][1])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumns({"norm": F.lit(1), "v": F.lit(1), "level": F.lit(1), "block": F.lit(0)})
    assert got(top_k.top_products(df, F.col("vec_id") % 20 == 0)) == sorted(brute.top_products(v))
    few = spark.createDataFrame(v[:5], "vec_id long, embedding array<float>")
    assert got(top_k.top_products(few, F.col("vec_id") % 20 == 0)) == sorted(brute.top_products(v[:5]))


def test_quality(spark):
    rnd = random.Random(4)
    good = lambda: " ".join(rnd.choice(["the", "of", "river", "stone", "was", "over", "Light,"]) for _ in range(60)) + "."
    bad = lambda: " ".join([rnd.choice(["BUY!!", "CLICK!!"])] * 30)
    docs = [(i, good() if i % 3 else bad()) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality.quality_scores(frame(spark, [*docs, (900, None), (901, "")]), labels).collect()}
    assert all(out[i]["predicted"] == int(i % 3 > 0) for i in range(240))
    assert out[900]["score"] == out[901]["score"] and 0 <= out[900]["score"] <= 1
    none = quality.quality_scores(frame(spark, docs[:3]), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_quality_equals_plain_training(spark):
    texts = [t for t in odd_texts() if t is None or len(t) < 2000][:30] * 2
    docs = list(enumerate(texts))
    labels = [(i, int(i % 3 > 0)) for i in range(0, 50)] + [(3, 1), (4, 0), (None, 1), (7, None)]
    df, table = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int")
    least = {}
    for i, q in labels:
        if i is not None and q is not None and zlib.crc32(str(i).encode()) % 5:
            least[i] = min(q, least.get(i, q))
    train = [(brute.quality_features(texts[i]), least[i]) for i in sorted(least)]
    want = dict(zip(range(len(docs)), brute.quality_scores(train, texts), strict=True))
    out = {r["doc_id"]: r["score"] for r in quality.quality_scores(df, table).collect()}
    assert out == pytest.approx(want, abs=1e-5)
    assert {r["doc_id"] for r in quality.accepted(df, table).collect()} == {i for i, s in out.items() if s >= 0.3}


def test_very_long_texts(spark):
    """A text of some megabytes, once and with a copy of its half."""
    rnd = random.Random(2)
    long = " ".join(f"w{rnd.randrange(1 << 30)}" for _ in range(120_000))
    docs = [(1, long), (2, long[: len(long) // 2]), (3, "short"), (4, long)]
    assert got(token_counts.token_counts(frame(spark, docs), BYTES)) == sorted(brute.counts(docs, BYTES))
    assert got(exact_dedup.exact_groups(frame(spark, docs))) == sorted(brute.exact(docs))
    removed = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in word_repeats.word_repeats(frame(spark, docs), digest=True).collect()}
    n = len(docs[1][1].split())
    assert removed[1] == (120_000, 0) and removed[4] == (120_000, 120_000) and removed[2][0] == n and removed[2][1] >= n - 1
    left = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_repeats.suffix_repeats(frame(spark, docs), digest=True).collect()}
    assert left[2] == (len(docs[1][1]),) * 2 and left[4] == (len(long),) * 2 and left[1][1] == left[3][1] == 0
    named = {r["doc_id"]: r["component_id"] for r in jaccard_join.linked(frame(spark, docs)).collect()}
    assert named == {1: 1, 2: 2, 3: 3, 4: 1}


QUALITY = "doc_id long, quality int"

ALL = [
    lambda d: sentencepiece_codec.piece_digests(d, PIECES), lambda d: token_counts.token_counts(d, BYTES), lambda d: packing.packed(d, BYTES), pii.span_digests,
    exact_dedup.exact_groups, lambda d: word_repeats.word_repeats(d), lambda d: suffix_repeats.suffix_repeats(d), jaccard_join.linked,
    lambda d: quality.quality_scores(d, d.sparkSession.createDataFrame([(1, 1), (1, 0), (2, None)], QUALITY)),
    lambda d: top_k.top_products(d.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.length("text").cast("double")).alias("embedding")), F.lit(True), k=1).unionByName(d.where("doc_id is null or text is null").select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("score"))),
]


@pytest.mark.parametrize("operator", range(len(ALL)))
def test_empty_repeated_and_null_ids(spark, operator):
    assert ALL[operator](frame(spark, [(1, "a")]).where("false")).count() == 0
    out = ALL[operator](frame(spark, [(1, "a b c d e f g"), (2, None), (None, "a b c d e f g"), (None, None)], repeat=True))
    assert out.count() == 8
