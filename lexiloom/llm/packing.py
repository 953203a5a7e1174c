"""Packing by concatenation and cutting.

Pass one tokenises each document once (end id added) and writes its ids, two bytes each where the
vocabulary allows, with the document's place in its partition. Partition totals, one number a
partition, are summed to global offsets. Pass two cuts the ids of each document at the multiples of
the window; a document across a boundary gives a record to each sequence. Only the last sequence can
have padding. Pieces of a sequence come from neighbouring documents of a partition, and partitions
follow each other in the order of their numbers.

Defined results: a null or empty text is its end id alone; repeated rows are packed as documents of
their own; an empty table gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C
from . import pretokens as P

IDS_SCHEMA = "part string, doc_id long, base long, n long, wide boolean, ids binary"
SMALL = 1 << 18  # partitions whose offsets (some 80 bytes each, 20 MB) are broadcast; more are joined by the optimizer's choice
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Ids of each document with its end id; part and base: its partition and the ids before it there."""

    def run(batches):
        # an attempt has a name of its own, so what a repeated task wrote never mixes with another's
        part, base = f"{TaskContext.get().partitionId():012d}-{uuid.uuid4().hex}", 0
        for batch in C.text_slices(batches):
            ids, starts = P.encode_batch(tokenizer_path, batch.column("text"))
            ids = np.insert(ids, starts[1:], end_id)
            sizes = np.diff(starts) + 1
            wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
            raw = ids.astype("<u4" if wide else "<u2")
            before = base + np.cumsum(sizes) - sizes
            cuts = np.r_[0, np.cumsum(sizes)] * raw.itemsize
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.string()), batch.column("doc_id"), pa.array(before, pa.int64()), pa.array(sizes, pa.int64()), pa.array([wide] * n, pa.bool_()), C.binaries(raw.tobytes(), cuts)], ["part", "doc_id", "base", "n", "wide", "ids"])
            base += int(sizes.sum())

    return docs.mapInArrow(run, IDS_SCHEMA)


def packed(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: the document's ids [start, start + length) lie at offset of sequence_id."""
    tables = C.Tables(docs.sparkSession, "packing")
    ids = tables.written(tokenised(C.texts(docs, id_col, text_col), tokenizer_path, end_id), "ids")
    # one row a partition of the input: its size doesn't grow with the documents of a partition
    totals = ids.groupBy("part").agg(F.max(F.col("base") + F.col("n")).alias("total"))
    offsets = tables.written(totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("before")), "offsets")
    if offsets.count() <= SMALL:
        offsets = F.broadcast(offsets)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = (batch.column("before").to_numpy() + batch.column("base").to_numpy()).astype(np.int64)
        n = batch.column("n").to_numpy().astype(np.int64)
        first = at // window
        pieces = (at + n - 1) // window - first + 1
        row = np.repeat(np.arange(len(n)), pieces)
        k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        sequence = first[row] + k
        begin = np.maximum(sequence * window, at[row])
        stop = np.minimum((sequence + 1) * window, at[row] + n[row])
        start = begin - at[row]
        data, cuts = C.concatenated(batch.column("ids"))
        wide = batch.column("wide").to_numpy(zero_copy_only=False)
        crc = []
        for r, a, b in zip(row.tolist(), start.tolist(), (stop - at[row]).tolist(), strict=True):
            own = data[cuts[r] : cuts[r + 1]].view("<u4" if wide[r] else "<u2")[a:b]
            crc.append(zlib.crc32(own.astype("<u4").tobytes()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, stop - begin, np.array(crc, np.int64), n[row], sequence, begin - sequence * window))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    def cut(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                yield each(batch.slice(a, 500))

    with_before = ids.join(offsets, "part").select("doc_id", "base", "n", "wide", "ids", "before")
    return with_before.mapInArrow(cut, SCHEMA)
