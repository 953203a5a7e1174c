"""Training logs and histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The two kinds of log lines.
NUMBER = r"([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)"
TRAIN = rf"(?i)epoch\s+(\d+)\s*\|\s*train_loss\s*=\s*{NUMBER}(?:\s*\|\s*lr\s*=\s*{NUMBER})?"
VALID = rf"(?i)epoch\s+(\d+)\s*\|\s*val\s+CER\s*=\s*{NUMBER}(?:\s*\|\s*val\s+WER\s*=\s*{NUMBER})?"
METRICS = ("train_loss", "val_cer", "val_wer", "lr")


def parse_log(lines: DataFrame, *by: str) -> DataFrame:
    """One row an epoch from lines (pos, value): the last value given for each field."""
    get = lambda p, i: F.nullif(F.regexp_extract("value", p, i), F.lit(""))
    train = F.col("value").rlike(TRAIN)
    own = lines.where(train | F.col("value").rlike(VALID)).select(
        *by,
        "pos",
        F.coalesce(get(TRAIN, 1), get(VALID, 1)).cast("int").alias("epoch"),
        get(TRAIN, 2).try_cast("double").alias("train_loss"),
        get(TRAIN, 3).try_cast("double").alias("lr"),
        F.when(~train, get(VALID, 2)).try_cast("double").alias("val_cer"),
        F.when(~train, get(VALID, 3)).try_cast("double").alias("val_wer"),
    )
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c)
    return own.groupBy(*by, "epoch").agg(*map(last, METRICS))


def upsert_epoch(history: DataFrame, rows: DataFrame, *by: str) -> DataFrame:
    """Rows of an epoch that is there replace it; of an epoch that the update repeats its last row counts."""
    keys = [*by, "epoch"]
    last = rows.select(*keys, F.struct(*rows.columns).alias("_row"), F.monotonically_increasing_id().alias("_at")).groupBy(*keys).agg(F.max_by("_row", "_at").alias("_row")).select("_row.*")
    return history.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(last)


def best_value(history: DataFrame, *by: str, metric: str = "val_cer") -> DataFrame:
    """Number of epochs and the lowest value of a history; null where none was measured."""
    return history.groupBy(*by).agg(F.count("*").alias("n_epochs"), F.min(metric).alias(f"best_{metric}"))


def running_best(history: DataFrame, *by: str, metric: str = "val_cer", patience: int = 3) -> DataFrame:
    """Best value before and up to each validation, validations since it was last beaten, and where training stops."""
    own = history.where(F.col(metric).isNotNull())
    order = W.partitionBy(*by).orderBy("epoch")
    before = F.min(metric).over(order.rowsBetween(W.unboundedPreceding, -1))
    own = own.withColumn("improved", F.coalesce(F.col(metric) < before, F.lit(True))).withColumn("best", F.min(metric).over(order.rowsBetween(W.unboundedPreceding, 0)))
    own = own.withColumn("_run", F.sum(F.col("improved").cast("int")).over(order))
    own = own.withColumn("stale", F.row_number().over(W.partitionBy(*by, "_run").orderBy("epoch")) - 1).drop("_run")
    stop = F.min(F.when(F.col("stale") >= patience, F.col("epoch"))).over(W.partitionBy(*by) if by else W.partitionBy(F.lit(0)))
    return own.withColumn("stopped", F.coalesce(F.col("epoch") > stop, F.lit(False)))


def pad(df: DataFrame, *by: str) -> DataFrame:
    """A history of parallel arrays as rows; short arrays are filled with nulls, places beyond the epochs go."""
    return df.select(*by, F.inline(F.arrays_zip("epochs", *METRICS))).where("epochs is not null").withColumnRenamed("epochs", "epoch")


def eval_rows(summary: DataFrame) -> DataFrame:
    """Table rows of an evaluation summary; a missing word error rate shows as a dash."""
    shown = lambda c: F.coalesce(F.format_string("%.2f", 100 * (1 - c)), F.lit("—"))
    return summary.select("id", "label", "cer", F.when(F.col("cer").isNotNull(), shown(F.col("cer"))).otherwise("—").alias("char_accuracy"), F.when(F.col("wer").isNotNull(), shown(F.col("wer"))).otherwise("—").alias("word_accuracy"))


NUMBERS = "array<string>"
SHAPES = f"struct<epochs:array<int>,{','.join(f'{m}:{NUMBERS}' for m in METRICS)},history:array<struct<epoch:int,{','.join(f'{m}:string' for m in METRICS)}>>,best_val_cer:string>"


def from_json(df: DataFrame, value: str, *by: str) -> DataFrame:
    """by, pos, epoch, the metrics and best_val_cer from a history's JSON: columns, a list of records, or such a list as `history`.

    Columns that are too short are filled with nulls, what is no number is null; the best value is the given one, else the lowest.
    A history without epochs gives no row.
    """
    text = F.trim(value)
    own = df.select(*by, F.from_json(F.when(text.startswith("["), F.concat(F.lit('{"history":'), text, F.lit("}"))).otherwise(text), SHAPES).alias("_h"))
    of_columns = F.transform("_h.epochs", lambda e, i: F.struct(e.alias("epoch"), *(F.get(F.col(f"_h.{m}"), i).alias(m) for m in METRICS)))
    rows = F.when(F.size("_h.epochs") > 0, of_columns).otherwise(F.col("_h.history"))
    own = own.select(*by, "_h", F.transform(rows, lambda r: F.struct(r["epoch"].alias("epoch"), *(r[m].try_cast("double").alias(m) for m in METRICS))).alias("_r"))
    best = F.coalesce(F.col("_h.best_val_cer").try_cast("double"), F.array_min(F.transform("_r", lambda r: r["val_cer"])))
    return own.select(*by, best.alias("_b"), F.posexplode("_r").alias("_at", "_e")).select(*by, F.col("_at").alias("pos"), "_e.*", F.col("_b").alias("best_val_cer"))


def as_columns(rows: DataFrame, *by: str) -> DataFrame:
    """One row a history: epochs in order, each metric as an array (nulls kept) and the lowest val_cer; the form that is stored."""
    own = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("epoch", *METRICS))).alias("_r"))
    return own.select(*by, *(F.col("_r")[c].alias("epochs" if c == "epoch" else c) for c in ("epoch", *METRICS)), F.array_min(F.transform("_r", lambda r: r["val_cer"])).alias("best_val_cer"))


def points(rows: DataFrame, metric: str, *by: str) -> DataFrame:
    """Epochs at which a metric was measured, and its values."""
    return rows.where(F.col(metric).isNotNull()).select(*by, "epoch", metric)


def find_log(logs: DataFrame, preferred: list[str]) -> DataFrame:
    """path of the log to use, one row or none, from lines of logs (path, modified, pos, value).

    Usable is a log that tells of an epoch. The first of the preferred names goes before all others, the newest of these next, then the smaller path.
    """
    usable = parse_log(logs.select("path", "pos", "value"), "path").select("path").distinct()
    name = F.element_at(F.split("path", "/"), -1)
    place = F.array_position(F.array(*map(F.lit, preferred)) if preferred else F.expr("cast(array() as array<string>)"), name)
    place = F.when(place > 0, place).otherwise(len(preferred) + 1)
    newest = F.when(place > len(preferred), -F.unix_micros("modified")).otherwise(0)
    return usable.join(logs.select("path", "modified").distinct(), "path").orderBy(place, newest, "path").limit(1).select("path")
