"""Values of a table for rows that ask for many of them, without a row for each question."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Bytes of rows that make one part; a row alone may be more.
PART = 1 << 22
#: Questions sent on at once.
SENT = 1 << 16
ASKED = pa.schema([("part", pa.int64()), ("at", pa.int32()), ("w", pa.string()), ("body", pa.binary())])


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task in batches of about PART bytes."""
    held, size = [], 0
    for batch in batches:
        step = max(1, batch.num_rows * PART // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            held.append(batch.slice(at, step))
            size += held[-1].nbytes
            if size >= PART:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def looked_up(rows: DataFrame, table: DataFrame, ask: Callable[[pa.RecordBatch], pa.Array], answer: Callable[[pa.RecordBatch, pa.Array], pa.RecordBatch], schema: str) -> DataFrame:
    """What `answer` makes of rows and the table's values (w, value; each w once) for the words that `ask` names, null where there is none.

    Rows go in parts: a part travels packed, and asks for each of its distinct words once. `ask` must give the same
    words in the same order for the same rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(parts(batches)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            body = sink.getvalue().to_pybytes()
            # a part that is made again from other rows gets another name, so answers never meet the wrong rows
            name = hashlib.blake2b(body + b"%d,%d" % (TaskContext.get().partitionId(), k), digest_size=8).digest()
            part, words = int.from_bytes(name, "little", signed=True), ask(batch)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([-1 - len(words)], pa.int32()), pa.array([name.hex()]), pa.array([body], pa.binary())], schema=ASKED)
            for at in range(0, len(words), SENT):
                own = words.slice(at, SENT)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part)), pa.array(np.arange(at, at + len(own), dtype=np.int32)), own, pa.nulls(len(own), pa.binary())], schema=ASKED)

    def put(found: pa.Table) -> pa.Table:
        at = found["at"].to_numpy()
        (head,) = np.flatnonzero(at < 0)
        if found.num_rows - 1 != -1 - at[head]:
            raise RuntimeError("a part's rows were made twice and differ; their source gives other rows each time")
        (batch,) = pa.ipc.open_stream(found["body"][int(head)].as_buffer())
        values = found["value"].take(pa.array(np.argsort(at)[1:])).combine_chunks()
        return pa.Table.from_batches([answer(batch, values)])

    asked = rows.mapInArrow(cut, "part long, at int, w string, body binary")
    found = asked.join(table.select("w", "value"), "w", "left").select("part", "at", "value", "body")
    return found.groupBy("part").applyInArrow(put, schema)
