"""What the operators of this package share: projections, written intermediate tables, text slices."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass works on at a time.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """Only (doc_id, text) and what is asked for besides, whatever else the input holds; a null text becomes empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session that is one process (tests) gets one of its own where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lexiloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


class Tables:
    """Parquet tables of one call, in a folder of its own under the shared one.

    A table cuts the lineage and survives lost executors. drop() takes those that nothing reads any more;
    what a lazy result still reads goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        atexit.register(self._end)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self.files.delete(self.path(f"{self.folder}/{name}"), True)

    def only(self, df: DataFrame) -> DataFrame:
        """df through a table; all others of the folder go."""
        out = self.written(df, "result")
        for found in self.files.listStatus(self.path(self.folder)):
            if found.getPath().getName() != "result":
                self.files.delete(found.getPath(), True)
        return out

    def _end(self) -> None:
        from py4j.protocol import Py4JError

        try:
            self.files.delete(self.path(self.folder), True)
        except (Py4JError, OSError):  # the JVM has gone first: what is left is the folder's owner's
            pass


#: Marks that are broadcast at most, some 80 bytes each; beyond that whole rows are exchanged by their marks.
SENT_ROWS = 1 << 21


def mark(docs: DataFrame) -> Column:
    """Two hashes of all columns of a row, the second one of which nulls are missing as well: equal for equal rows, whenever they are read."""
    return F.struct(F.xxhash64(*docs.columns).alias("a"), F.xxhash64(F.lit(1), *docs.columns, *(F.col(c).isNull() for c in docs.columns)).alias("b"))


def steady(docs: DataFrame, tables: Tables) -> DataFrame:
    """docs, through a table if reading it again could give other rows."""
    return docs if docs._jdf.queryExecution().analyzed().deterministic() else tables.written(docs, "whole")


def rest(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose mark is in gone (mark, one), but one of those of each mark where `one`.

    docs is read again rather than copied, and its rows stay in their partitions, so nothing is written and no text
    is exchanged, but for rows of which equal ones are gone. With more marks than SENT_ROWS all rows are exchanged.
    """
    marks, ones = gone.agg(F.count("*"), F.count(F.when(F.col("one"), 1))).first()
    sent = F.broadcast if marks <= SENT_ROWS else lambda df: df
    rows = docs.select(F.struct(*docs.columns).alias("row"), mark(docs).alias("mark"))
    out = rows.join(sent(gone.select("mark")), "mark", "left_anti").select("row.*")
    if ones:
        again = rows.join(sent(gone.where("one").select("mark")), "mark", "left_semi")
        out = out.union(again.groupBy("mark").agg(F.first("row").alias("row")).select("row.*"))
    return out


#: What the optimizer says when it knows nothing is over this.
UNKNOWN_BYTES = 1 << 52


def input_bytes(df: DataFrame) -> int:
    """About the bytes of the files below df: by the optimizer's statistics without a job, or by a sum over the texts where there are none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= UNKNOWN_BYTES:
        size = (df.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2
    return size


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has about `limit` bytes of `text`, one row at least."""
    for batch in batches:
        size = np.frombuffer(pc.binary_length(batch.column("text").cast(pa.binary())).cast(pa.int64()).fill_null(0).buffers()[1], np.int64)[: batch.num_rows] if batch.num_rows else np.zeros(0, np.int64)
        ends, start = np.cumsum(size), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """All texts of a column as one byte string, and where each starts (one more entry for the end)."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = b"" if data is None else data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes()
    return whole, offsets - offsets[0]


def map_texts(df: DataFrame, one: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over text slices; `one()` is called once a task and gives the function of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = one()
        for piece in text_slices(batches):
            yield each(piece)

    return df.mapInArrow(run, schema)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... of each run, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - before, lengths)


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def binaries(data: bytes, starts: np.ndarray, ends_too: bool = True) -> pa.Array:
    """Consecutive byte strings of data, cut at starts (which also has the end)."""
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(starts, np.int32)), pa.py_buffer(data)])


def concatenated(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data bytes of a binary array without nulls or offset, and its offsets."""
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)), offsets - (offsets[0] if len(offsets) else 0)


#: Packed documents of a chunk: ids and text hashes as 64-bit integers, sizes as 32-bit ones, texts by zstd.
PACKED = "chunk int, ids binary, hashes binary, sizes binary, data binary"
NO_ID = np.iinfo(np.int64).max


def squeeze(data: bytes | np.ndarray) -> bytes:
    """zstd with the size before it: what travels takes half the disk of the session's own codec."""
    raw = data.tobytes() if isinstance(data, np.ndarray) else data
    return len(raw).to_bytes(8, "little") + (pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True) if raw else b"")


def unsqueeze(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.Codec("zstd").decompress(data[8:], decompressed_size=size, asbytes=True) if size else b""


def dealt(docs: DataFrame, chunks: int) -> DataFrame:
    """docs (doc_id, text) packed by chunk, a hash of the id; a chunk's rows come from many tasks."""
    keyed = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", F.xxhash64("text").alias("hash"), "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in text_slices(batches, 16 << 20):
            chunk = batch.column("chunk").to_numpy()
            order = np.argsort(chunk, kind="stable")
            data, bounds = utf8(batch.column("text"))
            raw, sizes = np.frombuffer(data, np.uint8), np.diff(bounds)
            ids, hashes = batch.column("doc_id").fill_null(NO_ID).to_numpy(), batch.column("hash").to_numpy()
            sorted_ = chunk[order]
            head = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
            rows = [order[a:b] for a, b in zip(head, np.r_[head[1:], len(order)], strict=True)]
            parts = [raw[ragged(bounds[:-1][r], sizes[r])] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(sorted_[head], pa.int32()), *(pa.array(x, pa.binary()) for x in ([ids[r].tobytes() for r in rows], [hashes[r].tobytes() for r in rows], [sizes[r].astype(np.int32).tobytes() for r in rows], [squeeze(x) for x in parts]))], ["chunk", "ids", "hashes", "sizes", "data"])

    return keyed.mapInArrow(pack, PACKED)


def release() -> None:
    """In a worker: freed Arrow memory goes back to the system."""
    pa.set_memory_pool(pa.system_memory_pool())


class Chunk:
    """The documents of a chunk in the order of their ids, then of their text hashes."""

    def __init__(self, packed: pa.Table) -> None:
        get = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in packed.column(name).to_pylist())])
        ids, hashes, sizes = get("ids", np.int64), get("hashes", np.int64), get("sizes", np.int32).astype(np.int64)
        raw = np.frombuffer(b"".join(unsqueeze(x) for x in packed.column("data").to_pylist()), np.uint8)
        order = np.lexsort((hashes, ids))
        begins = np.cumsum(sizes) - sizes
        self.ids, self.hashes = ids[order], hashes[order]
        self.data = raw[ragged(begins[order], sizes[order])].tobytes()
        self.bounds = np.r_[0, np.cumsum(sizes[order])]

    def slices(self, limit: int) -> Iterator[tuple[int, bytes, np.ndarray]]:
        """First document, bytes and bounds of runs of documents of about limit bytes."""
        at = 0
        while at < len(self.ids):
            stop = max(at + 1, int(np.searchsorted(self.bounds, self.bounds[at] + limit, "right")) - 1)
            yield at, self.data[self.bounds[at] : self.bounds[stop]], self.bounds[at : stop + 1] - self.bounds[at]
            at = stop

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.ids == NO_ID)
