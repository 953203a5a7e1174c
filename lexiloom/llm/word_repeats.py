"""Substring dedup over windows of words: super-k-mers in minimiser buckets, sorted there.

Buckets get runs of windows that share a minimiser as one packed string (words joined by one space).
Equal strings are found first; where a minimiser has several distinct strings, their windows are sorted as
whole word sequences within the minimiser's bucket, and neighbours that are equal are one window.

Defined results: a null, empty or blank text has no words; fewer words than a window make none; rows
with equal ids are never smaller than one another; a null id comes after all others; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common as C
from .repeats import Strings, Units, without_repeats

SCHEMA = "doc_id long, n_words long, n_removed long, kept string"


def distinct_strings(s: Strings) -> tuple[np.ndarray, np.ndarray]:
    """Code of each string (equal strings, equal codes), and the smallest document of each code."""
    text = pa.Array.from_buffers(pa.large_binary(), len(s.sizes), [None, pa.py_buffer(np.r_[s.begins, len(s.data)].astype(np.int64)), pa.py_buffer(s.data)])
    code = text.dictionary_encode().indices.to_numpy().astype(np.int64)
    least = np.full(int(code.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, code, s.ids)
    return code, least


def shared_minimiser(grams: np.ndarray) -> np.ndarray:
    """Which of these distinct strings share their minimiser with another."""
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    out = np.zeros(len(grams), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def resolve(u: Units, s: Strings) -> np.ndarray:
    code, least = distinct_strings(s)
    first = np.full(len(least), -1, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]  # a string of each code
    windows = np.cumsum(s.counts[first]) - s.counts[first]
    result = np.repeat(least, s.counts[first])
    several = np.flatnonzero(shared_minimiser(s.grams[first]))
    if len(several):
        own = first[several]
        flat = s.data[C.ragged(s.begins[own], s.sizes[own])]
        begins = np.cumsum(s.sizes[own]) - s.sizes[own]
        # starts of all words of these strings; window w of a string runs from word w to word w + k - 1
        head = np.zeros(len(flat), bool)
        head[1:] = flat[:-1] == 32
        head[begins] = True
        starts = np.flatnonzero(head)
        word = np.searchsorted(starts, begins)
        a = C.ragged(word, s.counts[own])
        ends_of = np.r_[starts[1:] - 1, len(flat)]
        ends_of[np.r_[word[1:] - 1, len(starts) - 1]] = begins + s.sizes[own]
        lo, hi = starts[a], ends_of[a + u.k - 1]
        text = pa.Array.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(np.r_[0, np.cumsum(hi - lo)].astype(np.int64)), pa.py_buffer(flat[C.ragged(lo, hi - lo)])])
        order = pc.sort_indices(text)
        ordered = text.take(order)
        new = np.r_[True, pc.not_equal(ordered[1:], ordered[:-1]).to_numpy(zero_copy_only=False)] if len(lo) > 1 else np.ones(len(lo), bool)
        group = np.cumsum(new) - 1
        at = C.ragged(windows[several], s.counts[own])[order.to_numpy()]
        low = np.minimum.reduceat(result[at], np.flatnonzero(new))
        result[at] = low[group]
    return result[C.ragged(windows[code], s.counts)]


def word_repeats(docs: DataFrame, window: int = 50, gram: int = 6, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and `kept`, the words that stay joined by one space (or the SHA-256 of that)."""

    def out(data: bytes, bounds: np.ndarray, units: np.ndarray, covered: np.ndarray) -> pa.Table:
        kept, n = [], np.add.reduceat(np.r_[covered, False], units[:-1]) * (np.diff(units) > 0) if len(units) > 1 else np.zeros(0, np.int64)
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            words = data[a:b].split()
            if n[i]:
                words = compress(words, (~covered[units[i] : units[i + 1]]).tolist())
            text = b" ".join(words)
            kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
        return pa.table({"n_words": pa.array(np.diff(units), pa.int64()), "n_removed": pa.array(n, pa.int64()), "kept": pa.array(kept, pa.string())})

    return without_repeats(C.texts(docs, id_col, text_col), Units(True, window, gram), resolve, out, SCHEMA)
