"""Token counts by a map-side two-tier lookup.

First tier: a compact table of frequent pre-tokens and their token counts, broadcast (FREQUENT
entries of at most MAX_ENTRY bytes, so under 2 MB whatever the corpus). It is fitted on all rows, by
a pass that counts them in each task: a summary keeps KEPT pre-tokens (Misra and Gries), and the
packed summaries, one row a task, are merged in a tree. Each pre-token that makes up more than one
KEPT-th of the corpus is in it. The table only decides what is looked up fast: counts are exact for
every pre-token.
Second tier: misses are encoded by the library and kept in the worker's bounded cache. No pre-token
is shuffled.

Defined results: a null or empty text has 0 bytes and 0 tokens; a special string inside a text is
one token, as the library has it by default; repeated rows give repeated rows; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import pretokens as P

FREQUENT = 32_768
MAX_ENTRY = 48
#: Pre-tokens of a summary; it is cut back to these when it holds twice as many.
KEPT = 32_768
#: Bytes of input whose summaries meet first, and summaries that meet in later rounds.
FIRST_BYTES, FAN_IN = 1 << 30, 64
SUMMARY = "part long, words binary, sizes binary, counts binary"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Summary:
    """Counts of the most frequent pre-tokens. A cut takes the first count that doesn't fit from all, so none is short by more than total / kept."""

    def __init__(self, kept: int) -> None:
        self.kept, self.counts = kept, {}

    def add(self, words: list[bytes], counts: list[int]) -> None:
        own = self.counts
        for w, n in zip(words, counts, strict=True):
            own[w] = own.get(w, 0) + n
        if len(own) > 2 * self.kept:
            self.cut()

    def cut(self) -> None:
        if len(self.counts) > self.kept:
            less = heapq.nlargest(self.kept + 1, self.counts.values())[-1]
            self.counts = {w: n - less for w, n in self.counts.items() if n > less}

    def packed(self, part: int) -> list[pa.Array]:
        self.cut()
        row = b"".join(self.counts), bytes(map(len, self.counts)), np.array(list(self.counts.values()), "<i8").tobytes()
        return [pa.array([part], pa.int64()), *(pa.array([x], pa.binary()) for x in row)]


def _unpacked(words: bytes, sizes: bytes, counts: bytes) -> tuple[list[bytes], list[int]]:
    ends = np.cumsum(np.frombuffer(sizes, np.uint8).astype(np.int64)).tolist()
    return [words[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else [], np.frombuffer(counts, "<i8").tolist()


def frequent_words(docs: DataFrame, tokenizer_path: str, entries: int = FREQUENT, kept: int = KEPT) -> list[bytes]:
    """The most frequent pre-tokens of at most MAX_ENTRY bytes of all of docs (doc_id, text), ties by their bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, summary = P.worker(tokenizer_path), Summary(kept)
        for piece in C.text_slices(batches):
            words = P.words_of(t, piece.column("text"))[0]
            if len(words):
                n = np.bincount(words.indices.to_numpy(zero_copy_only=False), minlength=len(words.dictionary)).tolist()
                each = [(w, k) for w, k in zip(words.dictionary.to_pylist(), n, strict=True) if len(w) <= MAX_ENTRY]
                summary.add([w for w, _ in each], [k for _, k in each])
        if summary.counts:
            yield pa.RecordBatch.from_arrays(summary.packed(TaskContext.get().partitionId()), ["part", "words", "sizes", "counts"])

    def merge(found: pa.Table) -> pa.Table:
        summary = Summary(kept)
        for i in range(found.num_rows):
            summary.add(*_unpacked(*(found.column(x)[i].as_py() for x in ("words", "sizes", "counts"))))
        return pa.Table.from_arrays(summary.packed(found.column("part")[0].as_py()), ["part", "words", "sizes", "counts"])

    merged, groups = docs.select("text").mapInArrow(count, SUMMARY), -(-C.input_bytes(docs) // FIRST_BYTES) or 1
    while True:
        merged = merged.withColumn("part", F.pmod("part", F.lit(groups))).groupBy("part").applyInArrow(merge, SUMMARY)
        if groups == 1:
            break
        groups = -(-groups // FAN_IN)
    last = merged.first()  # one row, of KEPT entries at most
    if last is None:
        return []
    own = zip(*_unpacked(bytes(last["words"]), bytes(last["sizes"]), bytes(last["counts"])), strict=True)
    return [w for w, _ in sorted(own, key=lambda x: (-x[1], x[0]))[:entries]]


def frequent_lengths(docs: DataFrame, tokenizer_path: str, entries: int = FREQUENT) -> tuple[bytes, bytes, bytes]:
    """The compact table: joined pre-tokens, their sizes (one byte each) and their token counts (one byte each)."""
    kept, t = frequent_words(docs, tokenizer_path, entries), P.worker(tokenizer_path)
    return b"".join(kept), bytes(map(len, kept)), bytes(len(t.ids(w)) for w in kept)


@functools.lru_cache(maxsize=4)
def _tables(compact: tuple[bytes, bytes, bytes]) -> tuple[dict[bytes, int], dict[bytes, int]]:
    joined, sizes, counts = compact
    ends = np.cumsum(np.frombuffer(sizes, np.uint8).astype(np.int64)).tolist()
    starts = [0, *ends[:-1]] if ends else []
    return {joined[a:b]: n for a, b, n in zip(starts, ends, counts, strict=True)}, {}


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    docs = C.texts(docs, id_col, text_col)
    compact = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer_path))

    def one():
        t = P.worker(tokenizer_path)
        frequent, cache = _tables(compact.value)

        def lengths(words: list[bytes]) -> np.ndarray:
            found = [frequent.get(w) or cache.get(w) for w in words]
            missing = [i for i, n in enumerate(found) if n is None]
            if len(cache) + len(missing) > P.CACHE_WORDS:
                cache.clear()
            for i in missing:
                found[i] = n = len(t.ids(words[i]))
                if len(cache) < P.CACHE_WORDS:
                    cache[words[i]] = n
            return np.array(found, np.int64)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, first, _, bounds = P.words_of(t, batch.column("text"))
            if len(words):
                total = np.r_[0, np.cumsum(lengths(words.dictionary.to_pylist())[words.indices.to_numpy()])]
                n = np.diff(total[first])
            else:
                n = np.zeros(batch.num_rows, np.int64)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return each

    return C.map_texts(docs, one, SCHEMA)
