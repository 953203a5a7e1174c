"""Exact dedup by a tree merge of sorted digest runs, in DataFrame operations only.

Each row becomes a digest of its text without white space, an independent check (second hash and
length), its length and its id. The digests are cut into SLICES ranges, and in each the rows are dealt into
2^ROUNDS runs, aggregated before they are exchanged, so that a group of any size reaches a run as one row from each
task. In round r run i + 2^r goes to run i: one exchange brings the runs of a pair to one task, where they are
sorted into one by digest and of equal digests whose checks agree the best row and the summed size stay.
After the last round each slice is one run. A run has a digest once, so the work of a merge is bounded by the
distinct digests of its slice, whatever the groups.

The groups of more than one row are then joined to the rows again; a hot digest's partition is split by the
adaptive skew join, whose other side has one row for it.

Defined results: a null text is empty; texts of white space only are equal to the empty text; of equal
texts the row with the longest original, then the smallest id stays, one row exactly; a null id comes after all
others; rows that repeat an id and a text count as rows, of which one stays; an empty table gives no
rows; other columns of the input are ignored, whatever their names (kept_rows breaks ties by a hash of them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SLICES, ROUNDS = 4096, 4
#: The characters that equality ignores.
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def digests(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and any others): key, a number of each row that is the same once it is written, and what runs hold."""
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    plain = docs.select("doc_id", *more, F.length("text").cast("long").alias("chars"), normalised(F.col("text")).alias("plain"))
    return plain.select(F.monotonically_increasing_id().alias("key"), "doc_id", *more, "chars", F.unhex(F.sha2("plain", 256)).alias("digest"), F.xxhash64("plain").alias("hash"), F.octet_length("plain").alias("octets"))


def merged(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row for each digest: the row that stays and the number of rows. rows: digests(), and `tie`."""
    runs = ("slice", "run")
    best = F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie", "key")
    slice_ = F.pmod(F.xxhash64("digest"), F.lit(SLICES)).cast("int")
    level = rows.select(slice_.alias("slice"), F.pmod(F.xxhash64("doc_id", "key"), F.lit(1 << rounds)).cast("int").alias("run"), "digest", "hash", "octets", best.alias("best"), F.lit(1).cast("long").alias("size"))

    def merge(level: DataFrame) -> DataFrame:
        return level.groupBy(*runs, "digest", "hash", "octets").agg(F.min("best").alias("best"), F.sum("size").alias("size"))

    level = merge(level)
    for r in range(rounds):
        level = merge(level.withColumn("run", F.col("run").bitwiseAND(F.lit(~(1 << r)))).repartition(*runs))
    return level.drop(*runs)


def _with_groups(rows: DataFrame, tables: C.Tables) -> DataFrame:
    """rows with best (of groups of more than one row only) and size."""
    groups = merged(rows).where("size > 1").select(F.col("digest").alias("d"), F.col("hash").alias("h"), F.col("octets").alias("o"), "best", "size")
    groups = tables.written(groups, "groups")
    return rows.join(groups, (F.col("digest") == F.col("d")) & (F.col("hash") == F.col("h")) & (F.col("octets") == F.col("o")), "left").drop("d", "h", "o")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    tables = C.Tables(docs.sparkSession, "exact")
    rows = tables.written(digests(C.texts(docs, id_col, text_col).withColumn("tie", F.lit(0).cast("long"))), "rows")
    found = _with_groups(rows, tables)
    alone = F.col("size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("key") == F.col("best.key"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that tie in length and id the one of smallest hash of all columns."""
    tables = C.Tables(docs.sparkSession, "exact")
    docs = C.steady(docs, tables)
    rows = tables.written(digests(C.texts(docs, id_col, text_col, C.mark(docs).alias("tie"))), "rows")
    gone = _with_groups(rows, tables).where(F.col("size").isNotNull() & (F.col("key") != F.col("best.key")))
    gone = tables.written(gone.select(F.col("tie").alias("mark"), (F.col("tie") == F.col("best.tie")).alias("one")).distinct(), "gone")
    tables.drop("rows", "groups")
    return C.rest(docs, gone)
