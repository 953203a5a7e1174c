"""Readers and writers of label, line, character-set, history and log files. Order is kept in `pos`."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..operators import history as H

LINES = "path string, pos long, value string"


def file_lines(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """Lines of files with their place; paths and globs of which no file is there are left out.

    Files are read by splits: lines are numbered in each split, and the splits before it are summed.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    there = [p for p in paths if _exists(spark, p)]
    if not there:
        return spark.createDataFrame([], LINES)
    own = spark.read.text(there).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    sizes = own.groupBy("path", "block").agg(F.count("*").alias("n"))
    before = sizes.select("path", "block", (F.sum("n").over(W.partitionBy("path").orderBy("block")) - F.col("n")).alias("before"))
    within = F.row_number().over(W.partitionBy("path", "block").orderBy("at")) - 1
    return own.join(before, ["path", "block"]).select("path", (F.col("before") + within).cast("long").alias("pos"), "value")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop))


def labels(spark: SparkSession, paths: str | Iterable[str], strip: bool = False) -> DataFrame:
    """path<TAB>text lines: what follows the first tab is text; lines without a tab are left out."""
    parts = F.split("value", "\t", 2)
    own = file_lines(spark, paths).where(F.size(parts) == 2).select(F.col("path").alias("src"), "pos", parts[0].alias("rel_path"), parts[1].alias("text"))
    return own.withColumns({c: T.strip(F.col(c)) for c in ("rel_path", "text")}) if strip else own


def text_lines(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    return file_lines(spark, paths).where(T.strip(F.col("value")) != "")


def word_list(spark: SparkSession, paths: str | Iterable[str], comments: bool = True) -> DataFrame:
    """Stripped lines that are not blank; with comments, `#` lines go too."""
    own = file_lines(spark, paths).withColumn("value", T.strip(F.col("value"))).where("value <> ''")
    return own.where(~F.col("value").startswith("#")) if comments else own


def charset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True).select(F.posexplode("chars").alias("pos", "ch")).select((F.col("pos") + 1).alias("idx"), "ch")


#: What Windows-1252 has at 0x80 to 0x9F, by code.
WINDOWS = {c: x for c in range(0x80, 0xA0) if (x := bytes([c]).decode("cp1252", "ignore"))}


def log_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a log whose encoding its first bytes tell: UTF-16 by mark or by zero bytes, else UTF-8 if it is valid, else
    Windows-1252 if that has all its bytes, else UTF-8 with replacements.
    """
    string = F.col("content").cast("string")
    latin = F.translate(F.decode("content", "ISO-8859-1"), "".join(map(chr, WINDOWS)), "".join(WINDOWS.values()))
    head = F.hex(F.substring("content", 1, 4))
    text = (
        F.when(head.startswith("FFFE") | head.startswith("FEFF"), F.decode("content", "UTF-16"))
        .when(head.rlike("^..00..00"), F.decode("content", "UTF-16LE"))
        .when(head.startswith("EFBBBF"), F.decode(F.expr("substring(content, 4)"), "UTF-8"))
        .when(F.is_valid_utf8(string), string)
        .when(latin.rlike(r"[\x{80}-\x{9f}]"), F.make_valid_utf8(string))
        .otherwise(latin)
    )
    whole = spark.read.format("binaryFile").load(path).select("path", F.col("modificationTime").alias("modified"), F.regexp_replace(text, "\r\n?", "\n").alias("value"))
    return whole.select("path", "modified", F.posexplode(F.split("value", "\n")).alias("pos", "value"))


def page_spec(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map of pages; entries without lines (such as notes) are left out."""
    band = "struct<y0:int,y1:int,x0:int,x1:int>"
    spec = f"map<string,struct<mode:string,lines:array<string>,n:int,polarity:string,min_contrast:double,bands:array<{band}>,skip_crop_indices:array<int>,holdout:boolean>>"
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", spec)).alias("stem", "spec")).where("spec.lines is not null").select("stem", "spec.*")


def write_labels(df: DataFrame, path: str, split: str | None = None) -> None:
    rows = df.select(F.concat_ws("\t", "rel_path", "text").alias("value"), *([split] if split else []))
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(split) if split else writer).text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def train_history(spark: SparkSession, path: str) -> DataFrame:
    """Rows of history files, by their path; a file is one JSON value of any of the three shapes."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")
    return H.from_json(whole, "value", "source")


def find_train_log(spark: SparkSession, folder: str, preferred: list[str]) -> str | None:
    """The log of a folder to use, by preferred names, else the newest that tells of an epoch; None without one."""
    pattern = folder.rstrip("/") + "/*.log"
    row = H.find_log(log_text(spark, pattern), preferred).first() if _exists(spark, pattern) else None
    return row["path"] if row else None


def resolve_history(spark: SparkSession, folder: str, preferred: list[str], history: str | None = None, log: str | None = None, bundled: str | None = None) -> DataFrame:
    """Epochs of the given history, else the given log, else the folder's log, else its train_history.json, else the bundled one."""
    from_log = lambda p: H.parse_log(log_text(spark, p).withColumn("source", F.col("path")), "source")
    if history:
        return train_history(spark, history)
    if log or (log := find_train_log(spark, folder, preferred)):
        return from_log(log)
    for path in (folder.rstrip("/") + "/train_history.json", bundled):
        if path and _exists(spark, path):
            return train_history(spark, path)
    raise FileNotFoundError(f"no training history under {folder} or at {bundled}")


def eval_summary(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The JSON of the first path that is there."""
    for path in paths:
        if _exists(spark, path):
            return spark.read.json(path, multiLine=True)
    raise FileNotFoundError(f"no evaluation summary at {', '.join(paths)}")


def write_charset(df: DataFrame, path: str) -> None:
    """Characters (idx, ch) in order, as one JSON object with the list `chars`; a set has some hundreds."""
    whole = df.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "ch"))), lambda x: x["ch"]).alias("chars"))
    whole.coalesce(1).write.mode("overwrite").json(path)


def gt_lines(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """Lines of reference files that are not blank, as they are, numbered anew from 1; files that are not there have none."""
    own = text_lines(spark, paths)
    return own.select("path", F.row_number().over(W.partitionBy("path").orderBy("pos")).cast("long").alias("line_no"), F.col("value").alias("text"))
