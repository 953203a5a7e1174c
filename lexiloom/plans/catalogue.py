"""Queries of the engine by name, over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import rewrite, text as T
from ..operators import boxes, corpus, generate, history, language_model as lm, leakage, metrics, sequence

CHARS = T.default_characters()
ORDER, DISCOUNT = 3, 4.0
#: The reference's setting, for the queries over the whole of documents.
FULL_ORDER, FULL_DISCOUNT = 6, 2.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chars_sql() -> str:
    return ", ".join("chr(%d)" % ord(c) for c in CHARS)


LINES_SQL = r"list_filter(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
WORDS_SQL = r"list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> '')"
#: The other engine's edit distance is over bytes: each letter outside ASCII becomes an unused control character.
LATIN = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
ONE_BYTE = "translate({}, '" + LATIN + "', " + " || ".join("chr(%d)" % c for c in [1, 2, 3, 4, 5, 6, 7, 8, *range(14, 27)]) + ")"
PAIRS_SQL = "p AS (SELECT a.conv_id, a.turn, a.role, a.text AS ref, b.text AS hyp FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
#: Words as one byte each: a word of one side only is an own byte of that side, as it equals none of the other.
WORD_EDITS_SQL = f"""w AS (SELECT conv_id, turn, role, {WORDS_SQL.format('ref')} AS rw, {WORDS_SQL.format('hyp')} AS hw FROM p), k AS (SELECT *, list_distinct(list_intersect(rw, hw)) AS c FROM w),
 x AS (SELECT conv_id, turn, role, len(rw) AS n, len(hw) AS m, levenshtein(array_to_string(list_transform(rw, lambda v: chr(CAST(coalesce(list_position(c, v) + 2, 1) AS INTEGER))), ''), array_to_string(list_transform(hw, lambda v: chr(CAST(coalesce(list_position(c, v) + 2, 2) AS INTEGER))), '')) AS e FROM k)"""
EDITS_SQL = f"levenshtein({ONE_BYTE.format('ref')}, {ONE_BYTE.format('hyp')})"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation with the next one: a pair to compare."""
    c = read(spark, sf_dir, "conversations")
    later = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return c.select("conv_id", "turn", "role", F.col("text").alias("ref")).join(later, ["conv_id", "turn"])


# -- contamination audit -----------------------------------------------------------------------------


@query(f"WITH b AS (SELECT item_id, unnest({LINES_SQL}) AS line FROM benchmark), d AS (SELECT DISTINCT unnest({LINES_SQL}) AS line FROM documents) SELECT item_id, count(*) AS n, count(d.line) AS hits FROM b LEFT JOIN d USING (line) GROUP BY item_id")
def leak_exact_lines(spark, sf_dir):
    return leakage.exact_hits(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"), "item_id")


@query("SELECT item_id, count(doc_id) AS docs FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id")
def leak_containment(spark, sf_dir):
    return leakage.contained(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"), "item_id", "doc_id")


@query(f"WITH b AS (SELECT item_id % 7 AS set_id, unnest({LINES_SQL}) AS line FROM benchmark), d AS (SELECT DISTINCT unnest({LINES_SQL}) AS line FROM documents), g AS (SELECT set_id, count(*) AS n, count(d.line) AS text_hits FROM b LEFT JOIN d USING (line) GROUP BY set_id) SELECT *, CASE WHEN text_hits = 0 THEN 'clean' WHEN text_hits = n THEN 'IN TRAIN' ELSE 'PARTIAL' END AS verdict FROM g")
def leak_verdict(spark, sf_dir):
    lines = leakage.exploded_lines(read(spark, sf_dir, "benchmark"), "item_id").select((F.col("item_id") % 7).alias("set_id"), F.col("line").alias("text"))
    return leakage.file_verdicts(lines, leakage.exploded_lines(read(spark, sf_dir, "documents"), "doc_id").select(F.col("line").alias("text")), "set_id")


@query("WITH p AS (SELECT page_id % 5 AS set_id, string_split(string_split(url, '?')[1], '/')[-1] AS b FROM pages), r AS (SELECT b FROM p GROUP BY b HAVING count(*) > 1) SELECT set_id, count(*) AS n, count(r.b) AS image_hits FROM p LEFT JOIN r USING (b) GROUP BY set_id")
def leak_basenames_all(spark, sf_dir):
    """Every page against all others: a hit is a name that another page has."""
    p = read(spark, sf_dir, "pages").select((F.col("page_id") % 5).alias("set_id"), F.element_at(F.split("url", r"\?"), 1).alias("rel_path"))
    names = p.groupBy(F.element_at(F.split("rel_path", "/"), -1).alias("rel_path")).count().where("count > 1")
    return leakage.image_hits(p, names, "set_id")


# -- corpus preparation ------------------------------------------------------------------------------


@query(f"WITH l AS (SELECT doc_id, unnest({LINES_SQL}) AS line, generate_subscripts({LINES_SQL}, 1) - 1 AS pos FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS k FROM l) SELECT line, doc_id, pos FROM r WHERE k = 1")
def ordered_dedup_lines(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    return corpus.first_occurrences(lines.withColumn("pos", F.col("pos").cast("long")), "line", "doc_id", "pos")


@query(f"SELECT line, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({LINES_SQL}) AS line FROM documents) GROUP BY line HAVING count(*) > 1")
def dup_line_counts(spark, sf_dir):
    return leakage.exploded_lines(read(spark, sf_dir, "documents"), "doc_id").groupBy("line").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs")).where("n > 1")


@query(f"SELECT DISTINCT ch FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents UNION ALL SELECT unnest(string_split(html, '')) FROM pages) WHERE ch <> '' AND ch NOT IN (chr(10), chr(13)) AND ch NOT IN ({_chars_sql()})")
def charset_coverage(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("text").union(read(spark, sf_dir, "pages").select(F.col("html").alias("text")))
    return corpus.coverage(d, CHARS)


@query(f"WITH c AS (SELECT [{_chars_sql()}] AS chars), e AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, ''), lambda x: coalesce(list_position(chars, x), 0)), lambda i: i > 0) AS idx FROM conversations, c) SELECT conv_id, turn, len(idx) AS n_encoded, array_to_string(idx, ' ') AS encoded FROM e")
def charset_encode(spark, sf_dir):
    own = read(spark, sf_dir, "conversations").select("conv_id", "turn", T.encode(F.col("text"), CHARS).alias("idx"))
    return own.select("conv_id", "turn", F.size("idx").alias("n_encoded"), F.array_join(F.transform("idx", lambda i: i.cast("string")), " ").alias("encoded"))


@query(f"SELECT conv_id, turn, array_to_string(list_filter(string_split(text, ''), lambda x: x IN ({_chars_sql()})), '') AS decoded FROM conversations")
def charset_round_trip(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.decode(T.encode(F.col("text"), CHARS), CHARS).alias("decoded"))


@query(r"WITH l AS (SELECT doc_id, source, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, text FROM documents) SELECT doc_id, round(length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(1, length(text)), 9) AS digit_share, t <> '' AND length(regexp_replace(t, '[^0-9]', '', 'g')) / greatest(1, length(t)) >= 0.02 AS garbage FROM l")
def digit_ratio_garbage(spark, sf_dir):
    own = read(spark, sf_dir, "documents").select("doc_id", "text", T.digits(F.col("text")).alias("n"))
    share = F.col("n") / F.greatest(F.lit(1), F.length("text"))
    return own.select("doc_id", F.round(share, 9).alias("digit_share"), T.looks_like_garbage(F.col("text"), 0.02, F.col("n")).alias("garbage"))


@query("SELECT doc_id, lang FROM documents ORDER BY md5('13|' || doc_id), doc_id LIMIT 100")
def sample_cap_keep_order(spark, sf_dir):
    return corpus.capped(read(spark, sf_dir, "documents").select("doc_id", "lang"), 100, 13, "doc_id").orderBy("doc_id")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1 AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN k < CAST(floor(n * 0.7) AS BIGINT) THEN 'train' WHEN k < CAST(floor(n * 0.7) AS BIGINT) + CAST(floor(n * 0.15) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM r")
def split_70_15_15(spark, sf_dir):
    return corpus.split(read(spark, sf_dir, "documents").select("doc_id"), {"train": 0.7, "val": 0.15, "test": 0.15}, 42, "doc_id")


@query("SELECT doc_id, 'a' AS base_dir, 0 AS copy FROM documents UNION ALL SELECT doc_id, 'b', CAST(unnest(range(3)) AS INTEGER) FROM labels")
def oversample(spark, sf_dir):
    return corpus.merged([(read(spark, sf_dir, "documents").select("doc_id"), "a", 1), (read(spark, sf_dir, "labels").select("doc_id"), "b", 3)]).select("doc_id", "base_dir", "copy")


@query("SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, coalesce('quality ' || l.quality, d.lang) AS value FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id")
def holdout_upsert(spark, sf_dir):
    update = read(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("quality "), F.col("quality")).alias("value"))
    return corpus.upsert(read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("value")), update, "doc_id")


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({WORDS_SQL.format('text')}) AS word FROM documents) WHERE length(word) >= 2 AND (contains(word, 'th') OR suffix(rtrim(word, '.,;:!?'), 'tion')) GROUP BY word")
def confusion_pool(spark, sf_dir):
    w = F.col("word")
    return corpus.confusion_pool(read(spark, sf_dir, "documents"), F.contains(w, F.lit("th")) | F.regexp_replace(w, "[.,;:!?]+$", "").endswith("tion"))


@query(rf"WITH w AS (SELECT conv_id, turn, text, {WORDS_SQL.format('text')} AS w, CAST(('0x' || substr(md5('5|' || conv_id || '|' || turn), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM conversations) SELECT conv_id, turn, CASE WHEN len(w) <= 6 THEN text ELSE array_to_string(w[CAST(floor(u * (len(w) - 5)) AS INTEGER) + 1 : CAST(floor(u * (len(w) - 5)) AS INTEGER) + 6], ' ') END AS text FROM w")
def word_spans(spark, sf_dir):
    return corpus.spans(read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), 6, 5, "conv_id", "turn")


@query(r"""WITH t AS (SELECT page_id, string_split(regexp_replace(regexp_replace(html, '<[^>]*>', chr(10), 'g'), '\r\n?', chr(10), 'g'), chr(10)) AS l FROM pages),
 s AS (SELECT page_id, list_filter(list_transform(l, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM t)
 SELECT page_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM s""")
def page_line_explode(spark, sf_dir):
    plain = F.regexp_replace("html", "<[^>]*>", "\n")
    return read(spark, sf_dir, "pages").select("page_id", F.posexplode(T.lines(plain)).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


@query("SELECT CAST(doc_id % 7 AS INTEGER) AS layout, doc_id FROM documents")
def round_robin(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.pmod("doc_id", F.lit(7)).cast("int").alias("layout"), "doc_id")


# -- evaluation ---------------------------------------------------------------------------------------


@query(f"WITH {PAIRS_SQL} SELECT conv_id, turn, round(CASE WHEN ref = hyp THEN 0 WHEN length(ref) > 0 THEN {EDITS_SQL} / length(ref) ELSE 1 END, 9) AS cer FROM p")
def cer_per_turn(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", F.round(T.cer(F.col("ref"), F.col("hyp")), 9).alias("cer"))


@query(f"WITH {PAIRS_SQL} SELECT role, count(*) AS n_pairs, round(sum({EDITS_SQL}) / sum(greatest(1, length(ref))), 9) AS cer FROM p GROUP BY role")
def corpus_cer_by_group(spark, sf_dir):
    return metrics.corpus_cer(turns(spark, sf_dir), "role").withColumn("cer", F.round("cer", 9))


@query(f"WITH {PAIRS_SQL}, {WORD_EDITS_SQL} SELECT conv_id, turn, round(CASE WHEN n > 0 THEN e / n WHEN m > 0 THEN 1 ELSE 0 END, 9) AS wer FROM x")
def wer_per_turn(spark, sf_dir):
    return metrics.wer_of_pairs(turns(spark, sf_dir)).select("conv_id", "turn", F.round("wer", 9).alias("wer"))


@query(f"WITH {PAIRS_SQL}, {WORD_EDITS_SQL} SELECT role, count(*) AS n_pairs, round(sum(e) / sum(greatest(1, n)), 9) AS wer FROM x GROUP BY role")
def corpus_wer_by_group(spark, sf_dir):
    return metrics.corpus_rates(turns(spark, sf_dir), "role").select("role", "n_pairs", F.round("wer", 9).alias("wer"))


@query(f"WITH {PAIRS_SQL}, g AS (SELECT conv_id, string_agg(ref, '' ORDER BY turn) AS ref, string_agg(hyp, '' ORDER BY turn) AS hyp FROM p GROUP BY conv_id), e AS (SELECT conv_id % 5 AS set_id, {EDITS_SQL} AS e, length(ref) AS n FROM g) SELECT set_id, count(*) AS n_pages, CAST(sum(e) AS BIGINT) AS edits, CAST(sum(n) AS BIGINT) AS chars, round(sum(e) / sum(n), 9) AS cer FROM e GROUP BY set_id")
def cer_concat_suite(spark, sf_dir):
    p = turns(spark, sf_dir).select((F.col("conv_id") % 5).alias("set_id"), "conv_id", F.col("turn").alias("line_no"), "ref", "hyp")
    return metrics.suite_cer(p, "conv_id", "set_id").withColumn("cer", F.round("cer", 9))


@query("WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, role, text FROM conversations WHERE role <> 'system'), a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS line_no, text FROM r WHERE role = 'user'), b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS line_no, text FROM r WHERE role = 'assistant') SELECT conv_id, line_no, a.text AS ref, b.text AS hyp FROM a JOIN b USING (conv_id, line_no)")
def positional_align(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    side = lambda role: c.where(F.col("role") == role).withColumn("line_no", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long")).select("conv_id", "line_no", "text")
    return metrics.align(side("user"), side("assistant"), "conv_id")


@query("WITH g AS (SELECT conv_id, count(*) FILTER (role = 'user') AS num_gt, count(*) FILTER (role = 'assistant') AS num_pred FROM conversations WHERE role <> 'system' GROUP BY conv_id) SELECT conv_id, num_gt, num_pred, least(num_gt, num_pred) AS num_aligned FROM g")
def alignment_counts(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return metrics.alignment_counts(c.where("role = 'user'"), c.where("role = 'assistant'"), "conv_id")


@query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') = count(*) FILTER (role = 'assistant')")
def count_equal_pages(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    n = metrics.alignment_counts(c.where("role = 'user'"), c.where("role = 'assistant'"), "conv_id")
    system = c.select("conv_id").distinct().join(n, "conv_id", "left").na.fill(0)
    return metrics.equal_counts(system).select("conv_id")


@query("SELECT lang, round(avg(quality), 9) AS matched, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def match_rate_by_group(spark, sf_dir):
    own = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return metrics.match_rate(own, F.col("quality"), "lang").withColumn("matched", F.round("matched", 9))


@query("SELECT round(avg(CASE WHEN coalesce(CAST(toxic AS VARCHAR), '') = CAST(quality AS VARCHAR) THEN 1 ELSE 0 END), 9) AS field_accuracy FROM labels")
def field_accuracy(spark, sf_dir):
    v = read(spark, sf_dir, "labels")
    side = lambda c: v.select("doc_id", F.col(c).cast("string").alias("value"))
    return metrics.field_accuracy(side("toxic"), side("quality"), "doc_id").withColumn("field_accuracy", F.round("field_accuracy", 9))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN '' WHEN l.quality = 1 THEN 'held out' ELSE 'in training' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def set_status_join(spark, sf_dir):
    status = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "held out").otherwise("in training").alias("status"))
    return metrics.with_status(read(spark, sf_dir, "documents").select("doc_id"), status, "doc_id")


VOCAB_SQL = f"w AS (SELECT unnest({WORDS_SQL.format('text')}) AS word FROM benchmark), c AS (SELECT word, count(*) AS n FROM w GROUP BY word), v AS (SELECT word AS v, row_number() OVER (ORDER BY word) AS pos FROM c WHERE n >= 3), r AS (SELECT word FROM c)"


@query(f"WITH {VOCAB_SQL}, m AS (SELECT word, v, row_number() OVER (PARTITION BY word ORDER BY levenshtein({ONE_BYTE.format('word')}, {ONE_BYTE.format('v')}), pos) AS k FROM r JOIN v ON abs(length(word) - length(v)) <= 2 AND levenshtein({ONE_BYTE.format('word')}, {ONE_BYTE.format('v')}) <= 2) SELECT r.word, coalesce(m.v, r.word) AS corrected FROM r LEFT JOIN m ON m.word = r.word AND m.k = 1")
def dictionary_correct(spark, sf_dir):
    counted = read(spark, sf_dir, "benchmark").select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    # a vocabulary's order is its words' order here, so the word itself is the place
    vocabulary = counted.where("n >= 3").select(F.col("word").alias("pos"), F.col("word").alias("value"))
    return metrics.nearest_word(counted.select("word"), vocabulary, 2)


@query(f"""WITH {VOCAB_SQL}, m AS (SELECT word, v, row_number() OVER (PARTITION BY word ORDER BY levenshtein({ONE_BYTE.format('word')}, {ONE_BYTE.format('v')}), pos) AS k FROM r JOIN v ON abs(length(word) - length(v)) <= 2 AND levenshtein({ONE_BYTE.format('word')}, {ONE_BYTE.format('v')}) <= 2),
 k AS (SELECT r.word, coalesce(x.v, m.v, r.word) AS corrected FROM r LEFT JOIN v x ON x.v = r.word LEFT JOIN m ON m.word = r.word AND m.k = 1), b AS (SELECT item_id, {WORDS_SQL.format('text')} AS ws FROM benchmark), t AS (SELECT item_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM b)
 SELECT item_id, coalesce(string_agg(corrected, ' ' ORDER BY i), '') AS text FROM b LEFT JOIN t USING (item_id) LEFT JOIN k USING (word) GROUP BY item_id""")
def corrected_lines(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").select("item_id", "text")
    counted = b.select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return metrics.corrected_text(b, counted.where("n >= 3").select(F.col("word").alias("pos"), F.col("word").alias("value")), "item_id")


def _reports(spark, sf_dir):
    """Each conversation as a page: the user's turns in order against the assistant's."""
    c = read(spark, sf_dir, "conversations")
    side = lambda role: c.where(F.col("role") == role).withColumn("line_no", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long")).select("conv_id", "line_no", "text")
    return metrics.page_reports(side("user"), side("assistant"), "conv_id")


REPORT_SQL = f"""r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS line, role, text FROM conversations),
 p AS (SELECT a.conv_id, a.line AS turn, 'user' AS role, a.text AS ref, b.text AS hyp FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.line = b.line AND a.role = 'user' AND b.role = 'assistant'),
 g AS (SELECT conv_id, count(*) FILTER (role = 'user') AS num_gt, count(*) FILTER (role = 'assistant') AS num_pred FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id)"""


@query(f"""WITH {REPORT_SQL}, {WORD_EDITS_SQL}, z AS (SELECT conv_id, sum({EDITS_SQL}) / sum(greatest(1, length(ref))) AS cer FROM p GROUP BY conv_id), y AS (SELECT conv_id, sum(e) / sum(greatest(1, n)) AS wer FROM x GROUP BY conv_id)
 SELECT conv_id, num_gt, num_pred, least(num_gt, num_pred) AS num_aligned, round(coalesce(cer, 1), 9) AS cer, round(coalesce(wer, 1), 9) AS wer FROM g LEFT JOIN z USING (conv_id) LEFT JOIN y USING (conv_id)""")
def page_reports(spark, sf_dir):
    return _reports(spark, sf_dir).select("conv_id", "num_gt", "num_pred", "num_aligned", F.round("cer", 9).alias("cer"), F.round("wer", 9).alias("wer"))


@query(f"""WITH {REPORT_SQL}, j AS (SELECT conv_id, string_agg(ref, '' ORDER BY turn) AS ref, string_agg(hyp, '' ORDER BY turn) AS hyp FROM p GROUP BY conv_id), e AS (SELECT g.conv_id % 5 AS set_id, coalesce({EDITS_SQL}, 0) AS e, coalesce(length(ref), 0) AS c FROM g LEFT JOIN j USING (conv_id))
 SELECT set_id, count(*) AS n, round(CASE WHEN sum(c) > 0 THEN sum(e) / sum(c) END, 9) AS cer, CASE set_id WHEN 0 THEN 'held out' WHEN 1 THEN 'in training' ELSE '' END AS status FROM e GROUP BY set_id""")
def suite_report(spark, sf_dir):
    status = spark.createDataFrame([(0, "held out"), (1, "in training")], "set_id long, status string")
    return metrics.suite_report(_reports(spark, sf_dir).withColumn("set_id", F.col("conv_id") % 5), "set_id", status).withColumn("cer", F.round("cer", 9))


@query(f"WITH {REPORT_SQL} SELECT conv_id || '#' || lpad(CAST(turn AS VARCHAR), CAST(greatest(2, length(CAST(turn AS VARCHAR))) AS INTEGER), '0') AS name, ref, hyp, round(CASE WHEN ref = hyp THEN 0 WHEN length(ref) > 0 THEN {EDITS_SQL} / length(ref) ELSE 1 END, 9) AS cer FROM p")
def report_lines(spark, sf_dir):
    return metrics.report_lines(_reports(spark, sf_dir), "conv_id").withColumn("cer", F.round("cer", 9))


@query()
def run_reports(spark, sf_dir):
    """The report of each conversation; where the user says nothing it has no reference."""
    c = read(spark, sf_dir, "conversations")
    said = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    own = c.groupBy("conv_id").agg(said("assistant").alias("pred"), said("user").alias("ref"))
    return own.select("conv_id", metrics.run_report(F.col("pred"), F.col("ref"), {"checkpoint": F.lit("none"), "decode": F.lit("greedy")}, {"image": F.col("conv_id")}).alias("report"))


@query()
def confusion_opcodes(spark, sf_dir):
    return metrics.confusions(turns(spark, sf_dir), "role").orderBy(F.desc("n"), "role", "op", "ref", "hyp").limit(50)


@query(f"WITH {PAIRS_SQL} SELECT conv_id, turn, round(CASE WHEN ref = hyp THEN 0 WHEN length(ref) > 0 THEN {EDITS_SQL} / length(ref) ELSE 1 END, 9) AS cer FROM p ORDER BY cer DESC, conv_id, turn LIMIT 20")
def worst_first(spark, sf_dir):
    return cer_per_turn(spark, sf_dir).orderBy(F.desc("cer"), "conv_id", "turn").limit(20)


@query("WITH s AS (SELECT page_id, string_split(url, '/')[4] AS stem FROM pages) SELECT page_id, coalesce(CASE WHEN length(d.text) > 2000 THEN 'explicit' END, CASE WHEN l.doc_id IS NOT NULL THEN 'sidecar' END, CASE WHEN d.doc_id IS NOT NULL THEN 'folder' END, 'none') AS found FROM s LEFT JOIN documents d ON d.doc_id = page_id LEFT JOIN labels l ON l.doc_id = page_id")
def gt_sidecar_precedence(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), (F.length("text") > 2000).alias("long"))
    side = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.lit(True).alias("side"))
    both = read(spark, sf_dir, "pages").select("page_id").join(d, "page_id", "left").join(side, "page_id", "left")
    return both.select("page_id", F.coalesce(F.when(F.col("long"), "explicit"), F.when(F.col("side"), "sidecar"), F.when(F.col("long").isNotNull(), "folder"), F.lit("none")).alias("found"))


# -- training histories -------------------------------------------------------------------------------

LOG_SQL = """e AS (SELECT user_id AS run, event_id AS pos, CAST(event_id % 50 AS INTEGER) AS epoch, event_type, round(value, 2) AS v FROM events),
 f AS (SELECT run, epoch, pos, CASE WHEN event_type IN ('click', 'view') THEN v END AS train_loss, CASE WHEN event_type = 'view' THEN 0.001::DOUBLE END AS lr, CASE WHEN event_type NOT IN ('click', 'view') THEN v END AS val_cer, CASE WHEN event_type = 'error' THEN 0.5::DOUBLE END AS val_wer FROM e),
 h AS (SELECT run, epoch, arg_max(train_loss, pos) FILTER (train_loss IS NOT NULL) AS train_loss, arg_max(val_cer, pos) FILTER (val_cer IS NOT NULL) AS val_cer, arg_max(val_wer, pos) FILTER (val_wer IS NOT NULL) AS val_wer, arg_max(lr, pos) FILTER (lr IS NOT NULL) AS lr FROM f GROUP BY run, epoch)"""


def _log(spark, sf_dir):
    """The events as lines of training logs, one log a user."""
    e = read(spark, sf_dir, "events")
    number = F.format_string("%.2f", F.round("value", 2))
    epoch = F.concat(F.lit("epoch "), F.format_string("%03d", F.col("event_id") % 50))
    train = F.concat(epoch, F.lit(" | train_loss = "), number, F.when(F.col("event_type") == "view", " | lr = 0.001").otherwise(""))
    valid = F.concat(epoch, F.lit(" | val CER = "), number, F.when(F.col("event_type") == "error", " | val WER = 0.5").otherwise(""))
    line = F.concat(F.lit("12:00:00 | INFO | train | "), F.when(F.col("event_type").isin("click", "view"), train).otherwise(valid))
    return history.parse_log(e.select(F.col("user_id").alias("run"), F.col("event_id").alias("pos"), line.alias("value")), "run")


@query(f"WITH {LOG_SQL} SELECT * FROM h")
def log_parse_last_value(spark, sf_dir):
    return _log(spark, sf_dir)


@query(f"WITH {LOG_SQL} SELECT run, epoch, CASE WHEN epoch % 3 = 0 THEN NULL ELSE train_loss END AS train_loss, CASE WHEN epoch % 3 = 0 THEN 0.25::DOUBLE ELSE val_cer END AS val_cer, CASE WHEN epoch % 3 = 0 THEN NULL ELSE val_wer END AS val_wer, CASE WHEN epoch % 3 = 0 THEN NULL ELSE lr END AS lr FROM h")
def history_upsert(spark, sf_dir):
    h = _log(spark, sf_dir)
    none = F.lit(None).cast("double")
    fresh = h.where("epoch % 3 = 0").select("run", "epoch", none.alias("train_loss"), F.lit(0.25).alias("val_cer"), none.alias("val_wer"), none.alias("lr"))
    return history.upsert_epoch(h, fresh, "run")


@query(f"WITH {LOG_SQL}, b AS (SELECT run, min(val_cer) AS best_val_cer FROM h GROUP BY run) SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY epoch) - 1 AS INTEGER) AS pos, epoch, train_loss, val_cer, val_wer, lr, CASE WHEN run % 3 = 0 THEN 0.125::DOUBLE ELSE best_val_cer END AS best_val_cer FROM h JOIN b USING (run)")
def history_shapes(spark, sf_dir):
    """Histories stored as JSON and read again: as columns with a given best value, as `history`, as a bare list."""
    h = _log(spark, sf_dir)
    columns = F.to_json(F.struct("epochs", *history.METRICS, F.lit(0.125).alias("best_val_cer")), {"ignoreNullFields": "false"})
    records = F.to_json(F.transform(F.arrays_zip("epochs", *history.METRICS), lambda r: F.struct(r["epochs"].alias("epoch"), *(r[m].alias(m) for m in history.METRICS))))
    text = F.when(F.col("run") % 3 == 0, columns).when(F.col("run") % 3 == 1, F.concat(F.lit('{"history": '), records, F.lit("}"))).otherwise(records)
    return history.from_json(history.as_columns(h, "run").select("run", text.alias("value")), "value", "run")


BEST_SQL = f"""{LOG_SQL}, b AS (SELECT run, epoch, val_cer, min(val_cer) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, min(val_cer) OVER (PARTITION BY run ORDER BY epoch) AS best FROM h WHERE val_cer IS NOT NULL),
 i AS (SELECT *, coalesce(val_cer < before, true) AS improved FROM b), j AS (SELECT *, sum(CAST(improved AS INTEGER)) OVER (PARTITION BY run ORDER BY epoch) AS r FROM i),
 s AS (SELECT *, row_number() OVER (PARTITION BY run, r ORDER BY epoch) - 1 AS stale FROM j)"""


@query(f"WITH {BEST_SQL} SELECT run, epoch, best, improved, CAST(stale AS INTEGER) AS stale FROM s")
def running_best(spark, sf_dir):
    return history.running_best(_log(spark, sf_dir), "run").select("run", "epoch", "best", "improved", "stale")


@query(f"WITH {BEST_SQL} SELECT run, min(epoch) FILTER (stale >= 3) AS stop_epoch, min(val_cer) AS best FROM s GROUP BY run")
def early_stop(spark, sf_dir):
    b = history.running_best(_log(spark, sf_dir), "run", patience=3)
    return b.groupBy("run").agg(F.min(F.when(F.col("stale") >= 3, F.col("epoch"))).alias("stop_epoch"), F.min("val_cer").alias("best"))


@query("SELECT g.r AS run, CAST(e AS INTEGER) AS epoch, CASE WHEN e <= 2 THEN e * 0.5::DOUBLE + g.r END AS train_loss, CASE WHEN e <= 3 THEN e * 0.1::DOUBLE END AS val_cer, CAST(NULL AS DOUBLE) AS val_wer, CAST(NULL AS DOUBLE) AS lr FROM (SELECT r_regionkey AS r FROM region) g, range(1, 5) t(e)")
def history_pad(spark, sf_dir):
    empty = F.expr("cast(array() as array<double>)")
    arrays = read(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("run"), F.expr("array(1, 2, 3, 4)").alias("epochs"), F.transform(F.expr("array(1, 2)"), lambda e: e * F.lit(0.5) + F.col("r_regionkey")).alias("train_loss"), F.transform(F.expr("array(1, 2, 3)"), lambda e: e * F.lit(0.1)).alias("val_cer"), empty.alias("val_wer"), empty.alias("lr")
    )
    return history.pad(arrays, "run")


@query("WITH s AS (SELECT lang AS id, 'set ' || lang AS label, avg(1 - quality) AS cer, CASE WHEN lang <> 'de' THEN avg(toxic) END AS wer FROM labels JOIN documents USING (doc_id) GROUP BY lang) SELECT id, label, round(cer, 9) AS cer, format('{:.2f}', 100 * (1 - cer)) AS char_accuracy, coalesce(format('{:.2f}', 100 * (1 - wer)), '—') AS word_accuracy FROM s")
def eval_summary_rows(spark, sf_dir):
    own = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").groupBy(F.col("lang").alias("id")).agg(F.avg(1 - F.col("quality")).alias("cer"), F.when(F.col("id") != "de", F.avg("toxic")).alias("wer"))
    return history.eval_rows(own.withColumn("label", F.concat(F.lit("set "), F.col("id")))).withColumn("cer", F.round("cer", 9))


def _rows(df: DataFrame, key: str, array: Column, first: str) -> DataFrame:
    """key and the fields of each struct. An outer generator: the other kind has the array's size asked in a filter below it, so that all is computed twice."""
    return df.select(key, F.inline_outer(array)).where(F.col(first).isNotNull())


# -- sequences ----------------------------------------------------------------------------------------

FRAMES_SQL = "f AS (SELECT vec_id, generate_subscripts(embedding, 1) AS t, CAST(floor((CAST(unnest(embedding) AS DOUBLE) + 1) * 4) AS INTEGER) % 4 AS c FROM embeddings)"


def _frames(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.pmod(F.floor((x.cast("double") + 1) * 4), F.lit(4)).cast("int")).alias("idx"))


@query(f"WITH {FRAMES_SQL}, l AS (SELECT *, lag(c) OVER (PARTITION BY vec_id ORDER BY t) AS p FROM f) SELECT vec_id, coalesce(string_agg(c::VARCHAR, '' ORDER BY t) FILTER (c <> 0 AND (p IS NULL OR c <> p)), '') AS text FROM l GROUP BY vec_id")
def ctc_collapse(spark, sf_dir):
    return _frames(spark, sf_dir).select("vec_id", F.array_join(F.transform(sequence.collapse(F.col("idx")), lambda i: i.cast("string")), "").alias("text"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best FROM embeddings")
def argmax_frames(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", sequence.argmax(F.col("embedding")).alias("best"))


@query("WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS c, unnest(embedding) AS lp FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY lp DESC, c) AS k FROM e) SELECT vec_id, string_agg(c::VARCHAR, ' ' ORDER BY k) AS classes FROM r WHERE k <= 8 GROUP BY vec_id")
def frame_top_classes(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(sequence.top_classes(F.col("embedding"), 8), lambda p: p["c"].cast("string")), " ").alias("classes"))


@query("WITH e AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS c, CAST(unnest(embedding) AS DOUBLE) AS lp FROM embeddings) SELECT label, CAST(c AS INTEGER) AS c, round(ln(greatest(1e-12, avg(exp(lp)))), 6) AS lp FROM e GROUP BY label, c")
def tta_average(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("c", "lp"))
    return sequence.average_variants(e, "label", "c").withColumn("lp", F.round("lp", 6))


BANDS_SQL = """e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS y, unnest(embedding) AS v FROM embeddings),
 o AS (SELECT *, y - row_number() OVER (PARTITION BY vec_id ORDER BY y) AS g FROM e WHERE v >= 0.0),
 b AS (SELECT vec_id, min(y) AS y0, max(y) + 1 AS y1 FROM o GROUP BY vec_id, g)"""


def _bands(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("profile"), sequence.bands(F.col("embedding"), 0.0).alias("bands"))


@query(f"WITH {BANDS_SQL} SELECT vec_id, CAST(y0 AS INTEGER) AS y0, CAST(y1 AS INTEGER) AS y1 FROM b")
def band_islands(spark, sf_dir):
    return _bands(spark, sf_dir).select("vec_id", F.inline("bands"))


@query(f"WITH {BANDS_SQL}, m AS (SELECT vec_id, list_sort(list(y1 - y0))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS median, max(y1 - y0) AS most FROM b GROUP BY vec_id) SELECT vec_id, CAST(y0 AS INTEGER) AS y0, CAST(y1 AS INTEGER) AS y1 FROM b JOIN m USING (vec_id) WHERE y1 - y0 >= greatest(3, floor(median * 0.35)) OR most < greatest(3, floor(median * 0.35))")
def band_filter_median(spark, sf_dir):
    return _rows(_bands(spark, sf_dir), "vec_id", sequence.drop_low(F.col("bands")), "y0")


@query()
def band_fragments(spark, sf_dir):
    return _rows(_bands(spark, sf_dir), "vec_id", sequence.merge_fragments(F.col("bands")), "y0")


@query()
def tall_band_split(spark, sf_dir):
    return _rows(sequence.split_tall(_bands(spark, sf_dir), "vec_id"), "vec_id", F.col("bands"), "y0")


def _boxes(spark, sf_dir):
    box = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct(*(F.floor(F.abs(F.get(F.col("embedding"), 4 * i + k).cast("double")) * m + d).cast("int").alias(n) for k, (n, m, d) in enumerate((("x", 300, 0), ("y", 1000, 0), ("w", 200, 8), ("h", 60, 6))))))
    return read(spark, sf_dir, "embeddings").select("vec_id", box.alias("boxes"))


@query()
def box_interval_merge(spark, sf_dir):
    return _rows(_boxes(spark, sf_dir), "vec_id", sequence.merge_overlapping(F.col("boxes")), "x")


@query()
def box_fixpoint_merge(spark, sf_dir):
    return _rows(_boxes(spark, sf_dir), "vec_id", sequence.merge_neighbours(F.col("boxes")), "x")


@query()
def prefix_beam(spark, sf_dir):
    rows = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.transform(F.slice(F.col("embedding"), 4 * t + 1, F.lit(4)), lambda x: F.least(F.lit(-1e-3), x.cast("double") * 4 - 2)))
    return sequence.beam_search(read(spark, sf_dir, "embeddings").select("vec_id", rows.alias("frames")), "vec_id", "frames", ["a", "b", "c"], width=12)


@query()
def page_bands(spark, sf_dir):
    ink = F.transform("embedding", lambda v: F.greatest(F.lit(0.0), F.floor(v.cast("double") * 40)))
    pages = read(spark, sf_dir, "embeddings").select("vec_id", ink.alias("profile"), F.lit(600).alias("width"))
    return _rows(sequence.page_bands(pages, "vec_id"), "vec_id", F.col("bands"), "y0")


@query()
def refined_boxes(spark, sf_dir):
    return _rows(_boxes(spark, sf_dir), "vec_id", boxes.refined(F.col("boxes")), "x")


@query()
def built_corpus(spark, sf_dir):
    """Every distinct line of the conversations as seeds, with generated lines; topped up beyond the lines there are."""
    lines = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(T.lines(F.col("text"))).alias("line"))
    seeds = lines.select(F.xxhash64("conv_id", "turn", "line").alias("pos"), "line")
    names = sorted(r[0] for r in read(spark, sf_dir, "nation").select("n_name").collect())  # 25 rows by its schema
    return generate.built(seeds, ["{who} of {place}", "{place} is  near {who}"], {"who": names, "place": names[::-1]}, names, ["no", "sum"], ("EUR", "net"), least=3000, turns=3)


BOXES_SQL = """b AS (SELECT vec_id, CAST(floor(abs(CAST(embedding[4 * i + 1] AS DOUBLE)) * 300) AS INTEGER) AS x, CAST(floor(abs(CAST(embedding[4 * i + 2] AS DOUBLE)) * 1000) AS INTEGER) AS y, CAST(floor(abs(CAST(embedding[4 * i + 3] AS DOUBLE)) * 200 + 8) AS INTEGER) AS w, CAST(floor(abs(CAST(embedding[4 * i + 4] AS DOUBLE)) * 60 + 6) AS INTEGER) AS h FROM embeddings, range(16) r(i))"""


@query(f"WITH {BOXES_SQL}, m AS (SELECT vec_id, list_sort(list(h))[9] AS median FROM b GROUP BY vec_id) SELECT vec_id, x, y, w, h FROM b JOIN m USING (vec_id) WHERE h >= greatest(3, floor(median * 0.35::DOUBLE)) AND w / greatest(1, h) <= 80 AND h >= 8 AND w >= 20")
def box_filters(spark, sf_dir):
    return _boxes(spark, sf_dir).select("vec_id", F.inline(boxes.keep_large(boxes.keep_relative(F.col("boxes")))))


@query(f"WITH {BOXES_SQL}, t AS (SELECT *, greatest(h, 14) AS tall FROM b), u AS (SELECT *, least(900, greatest(0, y + h // 2 - tall // 2) + tall) AS bottom FROM t) SELECT vec_id, x, y, w, h, greatest(0, greatest(0, bottom - tall) - 5) AS y0, least(900, bottom + 5) AS y1, greatest(0, x - 10) AS x0, least(600, x + w + 10) AS x1 FROM u")
def crop_bounds(spark, sf_dir):
    b = _boxes(spark, sf_dir).select("vec_id", F.explode("boxes").alias("b"))
    return b.select("vec_id", "b.*", boxes.crop_bounds(F.col("b"), F.lit(600), F.lit(900)).alias("c")).select("vec_id", "x", "y", "w", "h", "c.*")


@query(f"WITH {BOXES_SQL} SELECT vec_id, x, y, w, h, CAST(greatest(least(greatest(1, round_even(w * 48 / h, 0)), 512), 32) AS INTEGER) AS new_w FROM b")
def resized_widths(spark, sf_dir):
    b = _boxes(spark, sf_dir).select("vec_id", F.inline("boxes"))
    return b.withColumn("new_w", boxes.resized_width(F.col("w"), F.col("h"), 48, 512, 32))


@query("SELECT CAST(sum(length(text) - length(replace(text, 'é', ''))) AS BIGINT) AS n FROM documents")
def character_occurrences(spark, sf_dir):
    return corpus.occurrences(read(spark, sf_dir, "documents"), "é")


@query(f"WITH l AS (SELECT conv_id, turn, array_to_string({WORDS_SQL.format('text')}, ' ') AS text FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS k FROM l WHERE text <> '') SELECT text, conv_id, turn FROM r WHERE k = 1")
def distinct_sentences(spark, sf_dir):
    return generate.distinct_lines(read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", "conv_id", "turn")


@query()
def composed_lines(spark, sf_dir):
    words = sorted(r[0] for r in read(spark, sf_dir, "nation").select("n_name").collect())  # 25 rows by its schema
    lines = generate.composed(spark, 1000, words, 2, 7, read(spark, sf_dir, "conversations").select("text").distinct())
    return lines.select("seed", generate.refrain(F.col("line"), ["..", "...", "..//"], F.col("seed")).alias("line"))


# -- language model -----------------------------------------------------------------------------------

GRAMS_SQL = f"""l AS (SELECT unnest({LINES_SQL}) AS line FROM conversations), p AS (SELECT repeat(chr(2), {ORDER - 1}) || line AS s, unnest(range({ORDER}, length(line) + {ORDER})) AS i FROM l),
 g AS (SELECT CAST(k AS INTEGER) AS k, substr(s, i - k, k) AS ctx, substr(s, i, 1) AS ch FROM p, range({ORDER}) t(k)), c AS (SELECT k, ctx, ch, count(*) AS n FROM g GROUP BY k, ctx, ch)"""
SCORE_SQL = f"""{GRAMS_SQL}, t AS (SELECT k, ctx, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY k, ctx), v AS (SELECT count(*) AS size FROM c WHERE k = 0)"""


def _counts(spark, sf_dir):
    return lm.counts(lm.model_lines(read(spark, sf_dir, "conversations")), ORDER)


@query(f"WITH {GRAMS_SQL} SELECT * FROM c")
def ngram_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


@query(f"WITH {SCORE_SQL} SELECT * FROM t")
def ngram_totals(spark, sf_dir):
    return lm.totals(_counts(spark, sf_dir))


@query(f"WITH {GRAMS_SQL} SELECT count(*) FILTER (k = 0) AS vocabulary, count(DISTINCT (k, ctx)) AS contexts FROM c")
def lm_vocab(spark, sf_dir):
    return lm.sizes(_counts(spark, sf_dir))


LP_SQL = "ln({2})"


def _lp(level: int) -> str:
    """The interpolation up to a level, for characters that the model has seen in their context."""
    if level < 0:
        return "1.0::DOUBLE / (v.size + 1)"
    return f"(c{level}.n / (t{level}.total + {DISCOUNT}) + (1 - t{level}.total / (t{level}.total + {DISCOUNT})) * ({_lp(level - 1)}))"


_JOINS = " ".join(f"JOIN c c{k} ON c{k}.k = {k} AND c{k}.ctx = substr(x.ctx, {ORDER} - {k}, {k}) AND c{k}.ch = x.ch JOIN t t{k} ON t{k}.k = {k} AND t{k}.ctx = c{k}.ctx" for k in range(ORDER))


@query(f"""WITH {SCORE_SQL}, q AS (SELECT conv_id, turn, unnest({LINES_SQL}) AS line FROM conversations), z AS (SELECT conv_id, turn, repeat(chr(2), {ORDER - 1}) || line AS s, unnest(range({ORDER}, length(line) + {ORDER})) AS i FROM q),
 x AS (SELECT conv_id, turn, substr(s, i - {ORDER - 1}, {ORDER - 1}) AS ctx, substr(s, i, 1) AS ch, count(*) AS times FROM z GROUP BY ALL)
 SELECT conv_id, turn, round(sum(times * ln({_lp(ORDER - 1)})), 4) AS lp FROM x JOIN v ON true {_JOINS} GROUP BY conv_id, turn""")
def lm_logp_lines(spark, sf_dir):
    rows = lm.model_lines(read(spark, sf_dir, "conversations"), "conv_id", "turn")
    return lm.score(rows, _counts(spark, sf_dir), ORDER, DISCOUNT, "conv_id", "turn", of_model=True).withColumn("lp", F.round("lp", 4))


def _known(level: int) -> str:
    """The interpolation up to a level, for any character; a context that is unknown changes nothing."""
    if level < 0:
        return "1.0::DOUBLE / (v.size + 1)"
    return f"CASE WHEN t{level}.total IS NULL THEN {_known(level - 1)} ELSE coalesce(c{level}.n, 0) / (t{level}.total + {DISCOUNT}) + (1 - t{level}.total / (t{level}.total + {DISCOUNT})) * ({_known(level - 1)}) END"


_LEFT = " ".join(f"LEFT JOIN t t{k} ON t{k}.k = {k} AND t{k}.ctx = substr(x.ctx, {ORDER} - {k}, {k}) LEFT JOIN c c{k} ON c{k}.k = {k} AND c{k}.ctx = substr(x.ctx, {ORDER} - {k}, {k}) AND c{k}.ch = x.ch" for k in range(ORDER))


@query(f"""WITH {SCORE_SQL}, q AS (SELECT conv_id, turn, {LINES_SQL} AS ls FROM conversations), o AS (SELECT conv_id, turn, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line FROM q),
 a AS (SELECT conv_id, turn, pos, regexp_extract_all(line, '\\s+|\\S+') AS ps FROM o), d AS (SELECT conv_id, turn, pos, generate_subscripts(ps, 1) AS i, unnest(ps) AS part FROM a), e AS (SELECT *, regexp_replace(part, '[.…/]+$', '') AS core FROM d),
 f AS (SELECT *, CASE WHEN core LIKE '_%in' THEN left(core, length(core) - 2) || 'on' END AS cand FROM e), u AS (SELECT DISTINCT unnest([core, cand]) AS word FROM f WHERE cand IS NOT NULL),
 z AS (SELECT word, repeat(chr(2), {ORDER - 1}) || word AS s, unnest(range({ORDER}, length(word) + {ORDER})) AS i FROM u), x AS (SELECT word, substr(s, i - {ORDER - 1}, {ORDER - 1}) AS ctx, substr(s, i, 1) AS ch, count(*) AS times FROM z GROUP BY ALL),
 y AS (SELECT word, sum(times * ln({_known(ORDER - 1)})) AS lp FROM x JOIN v ON true {_LEFT} GROUP BY word)
 SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, string_agg(CASE WHEN b.lp > g.lp THEN cand ELSE core END || substr(part, length(core) + 1), '' ORDER BY i) AS line FROM f LEFT JOIN y g ON g.word = core LEFT JOIN y b ON b.word = cand GROUP BY conv_id, turn, pos""")
def lm_word_endings(spark, sf_dir):
    """Every line; a Latin ending stands in for the script's."""
    lines = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    return lm.word_endings(lines, _counts(spark, sf_dir), ORDER, DISCOUNT, "conv_id", "turn", "pos", ending="in", instead="on")


# The same over the whole of documents in the reference's setting; without SQL, which would be too slow at that volume.


def _full_counts(spark, sf_dir):
    return lm.counts(lm.model_lines(read(spark, sf_dir, "documents")), FULL_ORDER)


@query()
def ngram_counts_documents(spark, sf_dir):
    return _full_counts(spark, sf_dir)


@query()
def ngram_totals_documents(spark, sf_dir):
    return lm.totals(_full_counts(spark, sf_dir))


@query()
def lm_vocab_documents(spark, sf_dir):
    return lm.sizes(_full_counts(spark, sf_dir))


@query()
def lm_logp_lines_documents(spark, sf_dir):
    """Every line of every document, by document and line number."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    return lm.score(rows, _full_counts(spark, sf_dir), FULL_ORDER, FULL_DISCOUNT, "doc_id", "pos", of_model=True).withColumn("lp", F.round("lp", 4))


@query()
def lm_gated_choice(spark, sf_dir):
    """A choice for every line of every item, by item and line number."""
    c = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "first"))
    return lm.gated(c.withColumn("second", F.regexp_replace("first", "e", "a")), _full_counts(spark, sf_dir), FULL_ORDER, FULL_DISCOUNT, "item_id", "pos")


@query()
def regex_rule_chain(spark, sf_dir):
    """Each line rewritten; letters of the tables stand in for the script's by their place in its block."""
    latin, script = "bcdfghjklmnpqrstvwxyzaeiouAEIOU", "කඛගඝඞඟචඡජඣඤටඨඩඪණතථදධනෙේැුිීොෝ්්"
    own = leakage.exploded_lines(read(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn")), "id")
    return own.select("id", rewrite.fix_line(F.translate("line", latin, script)).alias("fixed"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
