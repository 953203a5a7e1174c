"""Generators of synthetic lines. Draws are hashes of seed and key, so a row is the same on any cluster, with no state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from .corpus import first_occurrences, ranked

#: Longest list of choices that goes into an expression.
CHOICES = 10_000
#: What precedes the number of a labelled reference.
REFERENCES = ("A/L", "O/L", "Grade", "Ref")


def uniform(seed: Column, *salt: Column | str | int) -> Column:
    """A number in [0, 1) from a row's seed column and what the draw is for."""
    parts = [F.lit(s) if isinstance(s, (str, int)) else s for s in salt]
    return F.pmod(F.xxhash64(seed, *parts), F.lit(1 << 52)).cast("double") / float(1 << 52)


def between(u: Column, low: int, high: int) -> Column:
    """An integer from low to high, both included."""
    return (F.lit(low) + F.floor(u * (high - low + 1))).cast("long")


def pick(u: Column, choices: list[str] | tuple[str, ...]) -> Column:
    if not 0 < len(choices) <= CHOICES:
        raise ValueError(f"1 to {CHOICES} choices; longer lists are picked from by joined()")
    return F.element_at(F.array(*map(F.lit, choices)), (F.floor(u * len(choices)) + 1).cast("int"))


def cases(u: Column, parts: list[tuple[float, Column]]) -> Column:
    """The column whose share of [0, 1) holds u; the last one takes the rest."""
    at, out = 0.0, None
    for share, column in parts[:-1]:
        at += share
        out = F.when(u < at, column) if out is None else out.when(u < at, column)
    return parts[-1][1] if out is None else out.otherwise(parts[-1][1])


def number_token(seed: Column, *salt: Column | str | int) -> Column:
    """Whole number, amount with cents, percentage, decimal, number with separators: .35, .20, .15, .15, .15."""
    u = lambda k: uniform(seed, *salt, k)
    cents = F.format_string("%02d", between(u("cents"), 0, 99))
    amount = F.concat(F.format_number(between(u("whole"), 0, 99_999), 0), F.lit("."), cents)
    decimal = F.concat(between(u("small"), 0, 999).cast("string"), F.lit("."), cents)
    large = between(u("large"), 0, 999_999)
    return cases(u("number"), [(0.35, large.cast("string")), (0.20, amount), (0.15, F.format_string("%d%%", between(u("percent"), 1, 100))), (0.15, decimal), (0.15, F.format_number(large, 0))])


def date_token(seed: Column, *salt: Column | str | int) -> Column:
    """A day of 1990 to 2026, up to the 28th, in one of four forms."""
    u = lambda k: uniform(seed, *salt, k)
    day = F.make_date(between(u("year"), 1990, 2026).cast("int"), between(u("month"), 1, 12).cast("int"), between(u("day"), 1, 28).cast("int"))
    return cases(u("date"), [(0.25, F.date_format(day, form)) for form in ("yyyy.MM.dd", "yyyy-MM-dd", "dd/MM/yyyy", "d/M/yyyy")])


def mixed_token(seed: Column, *salt: Column | str | int) -> Column:
    """Identity number, telephone number, reference code, number sign or labelled reference, a fifth each."""
    u = lambda k: uniform(seed, *salt, k)
    letters = F.array_join(F.transform(F.sequence(F.lit(1), between(u("letters"), 1, 3).cast("int")), lambda i: F.char(between(uniform(seed, *salt, "letter", i), 65, 90))), "")
    return cases(u("mixed"), [
        (0.2, between(u("identity"), 190_000_000_000, 200_099_999_999).cast("string")),
        (0.2, F.concat(F.lit("0"), between(u("phone"), 700_000_000, 779_999_999).cast("string"))),
        (0.2, F.concat(letters, between(u("code"), 100, 9999).cast("string"))),
        (0.2, F.concat(F.lit("No. "), between(u("no"), 1, 999).cast("string"))),
        (0.2, F.concat_ws(" ", pick(u("reference"), REFERENCES), between(u("of"), 1, 2026).cast("string"))),
    ])


def random_words(seed: Column, words: list[str], low: int, high: int, *salt: Column | str | int) -> Column:
    """low to high words, joined by a blank."""
    places = F.sequence(F.lit(1), between(uniform(seed, *salt, "words"), low, high).cast("int"))
    return F.array_join(F.transform(places, lambda i: pick(uniform(seed, *salt, "word", i), words)), " ")


def token_line(seed: Column, words: list[str], low: int, high: int, numeric: float = 0.12, mixed: float = 0.10) -> Column:
    """A line token by token: numbers and dates (.6 and .4 of the numeric share), mixed tokens, words."""
    def token(i: Column) -> Column:
        number = F.when(uniform(seed, "form", i) < 0.6, number_token(seed, i)).otherwise(date_token(seed, i))
        return cases(uniform(seed, "token", i), [(numeric, number), (mixed, mixed_token(seed, i)), (1.0, pick(uniform(seed, "word", i), words))])

    return F.array_join(F.transform(F.sequence(F.lit(1), between(uniform(seed, "tokens"), low, high).cast("int")), token), " ")


def span(text: Column, longest: int, seed: Column, share: float = 1.0) -> Column:
    """With probability share a run of 1 to `longest` words; else the text, cut to `longest` words at a random place."""
    ws = T.words(text)
    n = F.size(ws)
    size = between(uniform(seed, "size"), 1, 1 << 30) % F.greatest(F.lit(1), F.least(F.lit(longest), n)) + 1
    cut = lambda k: F.array_join(F.slice(ws, (F.floor(uniform(seed, "start") * (n - k + 1)) + 1).cast("int"), k.cast("int")), " ")
    clamped = F.when(n <= longest, text).otherwise(cut(F.lit(longest)))
    return F.when((n > 1) & (uniform(seed, "span") < share), cut(size)).otherwise(clamped)


def joined(rows: DataFrame, corpus: DataFrame, value: str, *key: str) -> DataFrame:
    """Each row (column seed) with a random row's value of a corpus of any size: by a join on its place, not a list."""
    n = corpus.count()
    placed = ranked(corpus.select(value, *[k for k in key if k != value]), 0, *(key or (value,))).select("place", value)
    return rows.withColumn("place", F.floor(uniform(F.col("seed"), "row") * n)).join(placed, "place").drop("place")


def composed(spark: SparkSession, count: int, words: list[str], low: int, high: int, corpus: DataFrame | None = None, value: str = "text", corpus_share: float = 0.65, seed: int = 0) -> DataFrame:
    """seed, line: `count` training lines, of which corpus_share come from the corpus, whole or as a run of words."""
    rows = spark.range(count).select(F.xxhash64(F.lit(seed), "id").alias("seed"))
    tokens = token_line(F.col("seed"), words, low, high)
    if corpus is None:
        return rows.select("seed", tokens.alias("line"))
    real = uniform(F.col("seed"), "source") < corpus_share
    own = joined(rows.where(real), corpus, value).select("seed", span(F.col(value), high, F.col("seed"), 0.35).alias("line"))
    return own.union(rows.where(~real).select("seed", tokens.alias("line")))


def from_templates(rows: DataFrame, templates: list[str], slots: dict[str, list[str]]) -> DataFrame:
    """seed, line: a template each, its {slots} filled, white space collapsed."""
    seed = F.col("seed")
    line = reduce(lambda c, s: F.replace(c, F.lit("{" + s + "}"), pick(uniform(seed, s), slots[s])), slots, pick(uniform(seed, "template"), templates))
    return rows.select("seed", collapsed(line).alias("line"))


def labelled_numbers(seed: Column, labels: list[str], amount: tuple[str, str]) -> Column:
    """Dates, labelled numbers, amounts between two words, telephone numbers and classes: .3, .25, .2, .15, .1."""
    u = lambda k: uniform(seed, k)
    day = F.make_date(between(u("year"), 1990, 2026).cast("int"), between(u("month"), 1, 12).cast("int"), between(u("day"), 1, 28).cast("int"))
    return cases(u("line"), [
        (0.3, cases(u("form"), [(1 / 3, F.date_format(day, f)) for f in ("yyyy.MM.dd", "yyyy-MM-dd", "dd/MM/yyyy")])),
        (0.25, F.concat_ws(" ", pick(u("label"), labels), between(u("value"), 1, 99_999).cast("string"))),
        (0.2, F.concat(F.lit(amount[0] + " "), between(u("whole"), 10, 99_999).cast("string"), F.format_string(".%02d", between(u("cents"), 0, 99)), F.lit(" " + amount[1]))),
        (0.15, F.concat(F.lit("0"), between(u("area"), 70, 77).cast("string"), between(u("number"), 1_000_000, 9_999_999).cast("string"))),
        (0.1, F.concat_ws("-", between(u("grade"), 1, 13).cast("string"), pick(u("class"), list("ABCDEFG")))),
    ])


def refrain(line: Column, suffixes: list[str], seed: Column, share: float = 0.15) -> Column:
    """With probability share the line's last dots give way to a mark of repetition."""
    return F.when(uniform(seed, "refrain") < share, F.concat(F.regexp_replace(line, r"\.+$", ""), pick(uniform(seed, "mark"), suffixes))).otherwise(line)


def collapsed(line: Column) -> Column:
    return F.array_join(T.words(line), " ")


def spans_of(rows: DataFrame, sentences: DataFrame, least: int = 4, longest: int = 6) -> DataFrame:
    """seed, line: for each row a run of 1 to `longest` words of a random sentence of at least `least` words (column line)."""
    long = sentences.where(F.size(T.words(F.col("line"))) >= least)
    return joined(rows, long, "line").select("seed", span(F.col("line"), longest, F.col("seed")).alias("line"))


def built(seeds: DataFrame, templates: list[str], slots: dict[str, list[str]], words: list[str], labels: list[str], amount: tuple[str, str], counts: tuple[int, int, int, int] = (1400, 900, 500, 250), least: int = 0, turns: int = 50, each: int = 500, seed: int = 42) -> DataFrame:
    """line, place: a corpus of the seeds (columns pos, line), lines from templates, spans of seeds, recombined words and numeric
    lines (counts), each distinct line once, in a random order (place, from 0).

    Below `least` lines it is topped up from templates by turns of `each` lines, `turns` at most: a turn counts if the lines
    before it are too few. Turns are rows of one plan, not a loop.
    """
    spark = seeds.sparkSession
    rows = lambda n, what: spark.range(n).select("id", F.xxhash64(F.lit(seed), F.lit(what), "id").alias("seed"))
    part = lambda k, own: own.select(F.lit(k).alias("part"), F.col("seed").alias("pos"), "line")
    parts = [
        seeds.select(F.lit(0).alias("part"), F.col("pos").cast("long").alias("pos"), "line"),
        part(1, from_templates(rows(counts[0], "template"), templates, slots)),
        part(2, spans_of(rows(counts[1], "span").select("seed"), seeds)),
        part(3, rows(counts[2], "words").select(random_words(F.col("seed"), words, 2, 8).alias("line"), "seed")),
        part(4, rows(counts[3], "number").select(labelled_numbers(F.col("seed"), labels, amount).alias("line"), "seed")),
    ]
    more = rows(turns * each, "more").select("seed", (F.lit(5) + F.floor(F.col("id") / each)).cast("int").alias("part"))
    lines = from_templates(more, templates, slots).join(more, "seed").select("part", F.col("seed").alias("pos"), "line")
    first = first_occurrences(reduce(DataFrame.unionByName, [*parts, lines]), "line", "part", "pos")
    turn = F.greatest(F.col("part"), F.lit(4))
    sizes = first.groupBy(turn.alias("turn")).agg(F.count("*").alias("n"))  # one row a turn
    before = F.coalesce(F.sum("n").over(W.orderBy("turn").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counted = sizes.select("turn", "n", before.alias("before")).where((F.col("turn") == 4) | (F.col("before") < least)).select("turn")
    kept = first.join(F.broadcast(counted), turn == F.col("turn"), "left_semi").select("line")
    return ranked(kept, seed, "line").select("line", "place")


def distinct_lines(df: DataFrame, value: str, *order: str) -> DataFrame:
    """Lines with white space collapsed, blank ones gone, each at its first place."""
    return first_occurrences(df.withColumn(value, collapsed(F.col(value))).where(F.col(value) != ""), value, *order)
