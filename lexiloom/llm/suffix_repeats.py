"""Suffix-array dedup over bytes: suffixes sorted by a mergesort whose comparisons are of hashes.

In a minimiser's bucket, suffixes of the packed strings that share the minimiser are sorted: prefix
polynomial hashes (modulo 2^64) give the hash of any substring, a binary search over lengths finds how far
two suffixes agree, and the next byte decides, so a comparison takes a logarithmic number of steps. Suffixes are
dealt by their first 16 bytes before, so merges start from those that agree so far. Whole
strings are sorted first; only where a minimiser has several distinct strings are their windows sorted
too. Neighbours in the order that agree for a whole window are compared byte by byte, so equal hashes of
different bytes never count; a bucket in which that ever fails is sorted by its bytes.

Defined results: a null or empty text has no bytes; texts shorter than a window have none; matches never
cross documents; rows with equal ids are never smaller than one another; a null id comes after all others;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C
from .repeats import BYTE_CODES, Strings, Units, both_powers, prefix, without_repeats
from .word_repeats import shared_minimiser

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


class Hashes:
    """Hash of any substring of data, whatever its place."""

    def __init__(self, data: np.ndarray) -> None:
        self.data, self.sums, self.back = data, prefix(BYTE_CODES[data]), both_powers(len(data) + 1)[1]

    def agree(self, p: np.ndarray, q: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes at p and q, up to limit."""
        if not len(p):
            return np.zeros(0, np.int64)
        sp, sq, bp, bq = self.sums[p], self.sums[q], self.back[p], self.back[q]
        same = lambda i, t: (self.sums[p[i] + t] - sp[i]) * bp[i] == (self.sums[q[i] + t] - sq[i]) * bq[i]
        every = slice(None)
        out = np.where(same(every, limit), limit, 0)  # mostly all agrees; the others are searched
        rest = np.flatnonzero((out == 0) & (limit > 0))
        if len(rest):
            p, q, sp, sq, bp, bq, limit = p[rest], q[rest], sp[rest], sq[rest], bp[rest], bq[rest], limit[rest]
            low, step = np.zeros(len(rest), np.int64), 1 << int(limit.max()).bit_length()
            while step:
                ok = low + step <= limit
                to = np.where(ok, low + step, 0)
                low = np.where(ok & same(every, to), to, low)
                step >>= 1
            out[rest] = low
        return out

    def less(self, p: np.ndarray, q: np.ndarray, sp: np.ndarray, sq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the suffix of sp bytes at p comes before that of sq bytes at q, and whether they are equal."""
        limit = np.minimum(sp, sq)
        n = self.agree(p, q, limit)
        inside = n < limit
        last = len(self.data) - 1
        a, b = self.data[np.minimum(p + n, last)], self.data[np.minimum(q + n, last)]
        return np.where(inside, a < b, sp < sq), ~inside & (sp == sq)


def leading(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first 8 bytes of each suffix as a number in their order; zeros stand for what a shorter one lacks."""
    out = np.zeros(len(starts), np.uint64)
    for i in range(8):
        own = data[np.minimum(starts + i, len(data) - 1)]
        out = out << np.uint64(8) | np.where(i < sizes, own, np.uint8(0)).astype(np.uint64)
    return out


def merge_sort(h: Hashes, starts: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes by group, then by their bytes: dealt by the first 16, then a bottom-up merge of those that agree there, all at once."""
    keys = leading(h.data, starts + 8, sizes - 8), leading(h.data, starts, sizes), group
    order = np.lexsort(keys)
    new = np.zeros(max(len(order) - 1, 0), bool)
    for k in keys:
        new |= k[order[1:]] != k[order[:-1]]
    head = np.flatnonzero(np.r_[True, new])
    count = np.diff(np.r_[head, len(order)])
    base, own = np.repeat(head, count), np.repeat(count, count)
    local = np.arange(len(order)) - base
    width, most = 1, int(count.max()) if len(count) else 0
    while width < most:
        live = np.flatnonzero(own > width)
        run = local[live] // width
        other = run ^ 1  # the sibling run of each element
        lo = np.minimum(other * width, own[live])
        hi = np.minimum(lo + width, own[live])
        left = (run & 1) == 0
        a, b, item = lo.copy(), hi.copy(), order[live]
        open_ = np.flatnonzero(a < b)
        while len(open_):  # place among the sibling's suffixes; of equals the left run's come first
            mid = (a[open_] + b[open_]) // 2
            rival = order[base[live[open_]] + mid]
            mine = item[open_]
            before, equal = h.less(starts[rival], starts[mine], sizes[rival], sizes[mine])
            right = before | (equal & ~left[open_])
            a[open_[right]] = mid[right] + 1
            b[open_[~right]] = mid[~right]
            open_ = open_[a[open_] < b[open_]]
        at = local[live] - run * width + (a - lo) + (run & ~1) * width
        fresh = order.copy()
        fresh[base[live] + at] = item
        order = fresh
        width *= 2
    return order


def classes(h: Hashes, starts: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """A number for each suffix; equal numbers for equal bytes of one group."""
    order = merge_sort(h, starts, sizes, group)
    p, q = order[:-1], order[1:]
    near = np.flatnonzero((group[p] == group[q]) & (sizes[p] == sizes[q]))
    near = near[h.agree(starts[p[near]], starts[q[near]], sizes[p[near]]) == sizes[p[near]]]
    n = sizes[p[near]]
    differ = h.data[C.ragged(starts[p[near]], n)] != h.data[C.ragged(starts[q[near]], n)]
    if differ.any():  # a collision: by the bytes themselves
        raw = h.data.tobytes()
        seen: dict[tuple, int] = {}
        return np.array([seen.setdefault((int(k), raw[a : a + m]), len(seen)) for k, a, m in zip(group, starts.tolist(), sizes.tolist(), strict=True)], np.int64)
    new = np.ones(len(order), bool)
    new[near + 1] = False
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _least(code: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.full(int(code.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(out, code, ids)
    return out


#: Bytes of strings that are sorted together, whole minimisers each; what a comparison reads stays in the processor's cache.
PART_BYTES = 1 << 20


def resolve(u: Units, s: Strings) -> np.ndarray:
    order = np.argsort(s.grams, kind="stable")
    ends = np.cumsum(s.sizes[order])
    heads = np.flatnonzero(np.r_[True, s.grams[order][1:] != s.grams[order][:-1]])
    before = np.r_[0, ends][heads]  # bytes before each minimiser's strings
    windows = np.cumsum(s.counts) - s.counts
    out, at = np.empty(int(s.counts.sum()), np.int64), 0
    while at < len(heads):
        stop = max(at + 1, int(np.searchsorted(before, before[at] + PART_BYTES, "right")) - 1) if ends[-1] - before[at] > PART_BYTES else len(heads)
        own = order[heads[at] : heads[stop] if stop < len(heads) else len(order)]
        sizes, counts = s.sizes[own], s.counts[own]
        part = Strings(s.ids[own], counts, s.grams[own], s.places[own], np.cumsum(sizes) - sizes, sizes, s.data[C.ragged(s.begins[own], sizes)])
        out[C.ragged(windows[own], counts)] = _resolve(u, part)
        at = stop
    return out


def _resolve(u: Units, s: Strings) -> np.ndarray:
    h = Hashes(s.data)
    code = classes(h, s.begins, s.sizes, s.grams)
    least = _least(code, s.ids)
    first = np.full(len(least), -1, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    counts = s.counts[first]
    windows = np.cumsum(counts) - counts
    result = np.repeat(least, counts)
    several = np.flatnonzero(shared_minimiser(s.grams[first]))
    if len(several):
        own = first[several]
        k = C.ragged(np.zeros(len(own), np.int64), s.counts[own])
        starts = np.repeat(s.begins[own], s.counts[own]) + k
        # equal windows have their minimiser at one place
        place = np.repeat(s.places[own], s.counts[own]) - k
        gram = np.repeat(np.unique(s.grams[own], return_inverse=True)[1].astype(np.int64), s.counts[own])
        window = classes(h, starts, np.full(len(starts), u.k, np.int64), gram * (u.k + 1) + place)
        at = C.ragged(windows[several], s.counts[own])
        result[at] = _least(window, result[at])[window]
    return result[C.ragged(windows[code], s.counts)]


def suffix_repeats(docs: DataFrame, window: int = 50, gram: int = 20, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and `kept`, the bytes that stay (or their SHA-256 in hexadecimal)."""

    def out(data: bytes, bounds: np.ndarray, units: np.ndarray, covered: np.ndarray) -> pa.Table:
        raw, kept, removed, spans = np.frombuffer(data, np.uint8), [], [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            gone = covered[a:b]
            n = int(np.count_nonzero(gone))
            left = raw[a:b][~gone].tobytes() if n else data[a:b]
            removed.append(n)
            spans.append(int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0]) if n else 0)
            kept.append(hashlib.sha256(left).hexdigest() if digest else left)
        return pa.table({"n_bytes": pa.array(np.diff(bounds), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.string() if digest else pa.binary())})

    schema = SCHEMA.replace("kept binary", "kept string") if digest else SCHEMA
    return without_repeats(C.texts(docs, id_col, text_col), Units(False, window, gram), resolve, out, schema)
