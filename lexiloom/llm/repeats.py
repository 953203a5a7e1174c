"""Windows of k units that start in more than one document: the exchange that both repeat operators share.

Documents are dealt into chunks by a hash of their id, buckets hold minimiser values.

1. Each chunk takes the minimiser (smallest hashed gram of m units) of each of its windows and sends the
   distinct ones, packed, to their buckets, with the size of what it has of each.
2. A bucket answers with two bits for each: does it occur in two documents anywhere, and is it hot, that is,
   are there more than HOT runs of it?
3. Windows whose minimiser occurs once cannot repeat. Runs of consecutive windows with one repeated
   minimiser (super-k-mers) go, packed as one string, to the minimiser's bucket; of equal strings in a
   chunk only those of its smallest document go, and the others are known to be repeats at once. A run of a hot
   minimiser is cut in two, the windows that hold all of the (k - m) / 2 units before it and those that
   hold all of as many after it, and each part goes by the minimiser and these units: equal windows hold
   equal ones, so they still meet, but a phrase with many surroundings is spread over all buckets.
4. The bucket finds for each distinct window its smallest document, exactly, and answers with a bit for
   each window of each string: does it start in a smaller document?
5. Chunks join the answers and cover the units.

A minimiser that a third of all documents hold reaches its bucket once from each chunk in step 1 and with
the distinct strings of the chunks in step 3, so no task gathers a row for each document of a group. A message is
what one chunk has for one bucket, so there are never more messages than minimisers or strings in them, and
no more than chunks times buckets; all that travels is in proportion to the text. Every step is a pure function
of rows that are there again after an executor is lost. A document has fewer than 2^28 units; a longer one
raises an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common as C

INDEX_BITS = np.uint64(28)
SLICE_UNITS = 1 << 19
#: Of the files' bytes; a chunk's texts are some four times as large in memory. LEAST keeps all cores busy on small tables.
CHUNK_BYTES, BUCKET_BYTES, LEAST = 2 << 20, 1 << 20, 64
FACTOR = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(FACTOR), -1, 1 << 64))

LOW = np.uint64(63)  # bits of a minimiser that hold something else in step 1
HOT = 4096

REPLY = "chunk int, bucket int, bits binary"
MESSAGE = "chunk int, bucket int, whole boolean, data binary"
#: The arrays of a message, in order; of one that isn't whole only the first three.
FIELDS = (("rows", np.int32), ("starts", np.int32), ("counts", np.uint8), ("ids", np.int64), ("grams", np.uint64), ("places", np.uint8), ("sizes", np.int32))
ANSWERED = (*FIELDS[:3], ("masks", np.uint64))


def packed(arrays: list[np.ndarray], rest: bytes = b"") -> bytes:
    return len(arrays[0]).to_bytes(4, "little") + b"".join(a.tobytes() for a in arrays) + rest


def unpacked(data: bytes, fields) -> tuple[list[np.ndarray], bytes]:
    n, at, out = int.from_bytes(data[:4], "little"), 4, []
    for _, kind in fields:
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out, data[at:]


def messages(chunks: list[int], buckets: list[int], whole: list[bool], data: list[bytes]) -> pa.Table:
    return pa.table({"chunk": pa.array(chunks, pa.int32()), "bucket": pa.array(buckets, pa.int32()), "whole": pa.array(whole, pa.bool_()), "data": pa.array(data, pa.binary())})


def grid(docs: DataFrame) -> tuple[int, int]:
    """Chunks of documents and buckets of hashes for a table of this size."""
    size = C.input_bytes(docs)
    return int(max(LEAST, size // CHUNK_BYTES)), int(max(LEAST, size // BUCKET_BYTES))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def both_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """FACTOR and its inverse to the powers 0 to n - 1, modulo 2^64."""
    size = 1 << max(10, (n - 1).bit_length())
    if size > 1 << 22:
        return powers(FACTOR, n), powers(INVERSE, n)
    if 0 not in _POWERS or len(_POWERS[0][0]) < size:
        _POWERS[0] = powers(FACTOR, size), powers(INVERSE, size)
    return _POWERS[0][0][:n], _POWERS[0][1][:n]


def prefix(units: np.ndarray) -> np.ndarray:
    """S with S[b] - S[a] = sum of units[i] * FACTOR^i for i in [a, b)."""
    return np.r_[np.uint64(0), np.cumsum(units * both_powers(len(units))[0])]


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Units:
    """What the windows are made of: bytes, or words between white space."""

    words: bool
    k: int  # units of a window
    m: int  # units of a gram


@dataclass
class Cut:
    """A run of documents: unit hashes, unit bounds of documents, byte starts and ends of units."""

    codes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray | None
    ends: np.ndarray | None


def cut_units(u: Units, data: bytes, bounds: np.ndarray) -> Cut:
    raw = np.frombuffer(data, np.uint8)
    if not u.words:
        return Cut(BYTE_CODES[raw], bounds, None, None)
    word = ~_BLANK[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = bounds[(bounds > 0) & (bounds < len(raw))]
    first[edges] = word[edges]
    last[edges - 1] = word[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    s = prefix(BYTE_CODES[raw])
    codes = mix((s[ends] - s[starts]) * both_powers(len(raw) + 1)[1][starts] + (ends - starts).astype(np.uint64))
    return Cut(codes, np.searchsorted(starts, bounds), starts, ends)


def grams_of(codes: np.ndarray, m: int) -> np.ndarray:
    s = prefix(codes)
    n = len(codes) - m + 1
    return mix((s[m:] - s[:n]) * both_powers(n)[1]) if n > 0 else np.zeros(0, np.uint64)


def super_kmers(u: Units, cut: Cut) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first window, windows, gram hash and gram place of each maximal run of windows with one minimiser."""
    none = np.zeros(0, np.int64)
    if len(cut.codes) < u.k:
        return none, none, none, np.zeros(0, np.uint64), none
    if len(cut.codes) >> int(INDEX_BITS):
        raise ValueError("a document has 2^28 units or more")
    gram = grams_of(cut.codes, u.m)
    key = ((gram >> INDEX_BITS) << INDEX_BITS) | np.arange(len(gram), dtype=np.uint64)
    width, span, low = u.k - u.m + 1, 1, key
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(key) - width + 1], low[width - span : width - span + len(key) - width + 1])
    place = (low & np.uint64((1 << int(INDEX_BITS)) - 1)).astype(np.int64)
    sizes = np.diff(cut.bounds)
    doc = np.repeat(np.arange(len(sizes)), np.maximum(sizes - u.k + 1, 0))
    window = C.ragged(cut.bounds[:-1], np.maximum(sizes - u.k + 1, 0))
    place = place[window]
    head = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]) if len(window) else none
    counts = np.diff(np.r_[head, len(window)])
    # minimisers are small by choice: hashed again, they spread over the buckets
    return doc[head], window[head], counts, mix(gram[place[head]]), place[head]


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hash, so sorted hashes lie bucket by bucket."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def minimisers(chunk: C.Chunk, u: Units) -> np.ndarray:
    """Sorted distinct minimisers of a chunk; in the low bits whether two of its documents hold each, and the bit length of how many runs it has."""
    found, docs = [], []
    for at, data, bounds in chunk.slices(SLICE_UNITS):
        doc, _, _, gram, _ = super_kmers(u, cut_units(u, data, bounds))
        found.append(gram & ~LOW)
        docs.append(chunk.ids[doc + at])
    gram, ids = np.concatenate([np.zeros(0, np.uint64), *found]), np.concatenate([np.zeros(0, np.int64), *docs])
    if not len(gram):
        return gram
    order = np.argsort(gram, kind="stable")
    gram, ids = gram[order], ids[order]
    head = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    several = np.minimum.reduceat(ids, head) != np.maximum.reduceat(ids, head)
    size = np.frexp(np.diff(np.r_[head, len(gram)]))[1].astype(np.uint64)
    return gram[head] | size << np.uint64(1) | several


def _by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = bucket_of(hashes, buckets)
    head = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    return b[head], head, np.r_[head[1:], len(b)].astype(np.int64)[: len(head)]


def _ask(u: Units, buckets: int) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        C.release()
        gram = minimisers(C.Chunk(table), u)
        b, lo, hi = _by_bucket(gram, buckets)
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(b), pa.int32()), "bucket": pa.array(b, pa.int32()), "bits": pa.array([gram[x:y].tobytes() for x, y in zip(lo, hi, strict=True)], pa.binary())})

    return run


def _reply(table: pa.Table) -> pa.Table:
    """Which minimisers of each chunk occur in two documents, and (where any is) which are hot."""
    parts = [np.frombuffer(x, np.uint64) for x in table.column("bits").to_pylist()]
    gram = np.concatenate(parts)
    value = gram & ~LOW
    order = np.argsort(value, kind="stable")
    ordered = value[order]
    head = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    size = np.diff(np.r_[head, len(gram)])
    runs = np.add.reduceat(1 << ((gram[order] & LOW) >> np.uint64(1)).astype(np.int64) >> 1, head)
    many, hot = np.empty(len(gram), bool), np.empty(len(gram), bool)
    many[order], hot[order] = np.repeat(size > 1, size), np.repeat(runs > HOT, size)
    many |= (gram & np.uint64(1)).astype(bool)
    cuts = np.cumsum([0, *map(len, parts)])
    bits = [np.packbits(many[a:b]).tobytes() + (np.packbits(hot[a:b]).tobytes() if hot[a:b].any() else b"") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})


def _halves(u: Units, codes: np.ndarray, window: np.ndarray, n: np.ndarray, g: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, ...]:
    """Run, first window, windows and key of the two parts of runs of hot minimisers."""
    side = (u.k - u.m) // 2
    near = grams_of(codes, side)
    left = np.clip(p - side - window + 1, 0, n)
    first, second = np.flatnonzero(left > 0), np.flatnonzero(left < n)
    key = np.r_[mix(g[first] ^ near[p[first] - side]), mix(g[second] ^ mix(near[p[second] + u.m]))] & ~LOW
    return np.r_[first, second], np.r_[window[first], (window + left)[second]], np.r_[left[first], (n - left)[second]], key


def _requests(u: Units, buckets: int) -> Callable:
    def run(key: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows or not replies.num_rows:
            return messages([], [], [], [])
        chunk = C.Chunk(docs)
        order = np.argsort(replies.column("bucket").to_numpy())
        bits = replies.column("bits").to_pylist()
        cuts, row, first, count, gram, place, sizes, data = [], [], [], [], [], [], [], []
        # one pass finds all runs, then the replies (aligned with the sorted distinct minimisers) choose
        for at, raw, bounds in chunk.slices(SLICE_UNITS):
            cut = cut_units(u, raw, bounds)
            cuts.append((at, raw, bounds, cut, super_kmers(u, cut)))
            cut.codes = None
        every = np.sort(np.concatenate([k[3] & ~LOW for *_, k in cuts]))
        every = every[np.r_[True, every[1:] != every[:-1]]] if len(every) else every
        _, lo, hi = _by_bucket(every, buckets)
        if not len(every):
            return messages([], [], [], [])
        many, hot = np.zeros(len(every), bool), np.zeros(len(every), bool)
        for i, x, y in zip(order.tolist(), lo.tolist(), hi.tolist(), strict=True):
            own = np.frombuffer(bits[i], np.uint8)
            size = -(-(y - x) // 8)
            many[x:y] = np.unpackbits(own[:size])[: y - x]
            if len(own) > size:
                hot[x:y] = np.unpackbits(own[size:])[: y - x]
        for at, raw, bounds, cut, (doc, window, n, g, p) in cuts:
            g = g & ~LOW
            spot = np.searchsorted(every, g)
            hit = many[spot]
            doc, window, n, g, p, burning = doc[hit], window[hit], n[hit], g[hit], p[hit], hot[spot[hit]]
            if burning.any():
                halves = np.flatnonzero(burning)
                part, begin, size, sub = _halves(u, cut_units(u, raw, bounds).codes, window[halves], n[halves], g[halves], p[halves])
                doc, p = np.r_[doc[~burning], doc[halves][part]], np.r_[p[~burning], p[halves][part]]
                window, n, g = np.r_[window[~burning], begin], np.r_[n[~burning], size], np.r_[g[~burning], sub]
            last = window + n - 1 + u.k  # unit after the last window
            if u.words:
                a, b = (cut.starts[window], cut.ends[last - 1]) if len(window) else (window, window)
                flat = np.frombuffer(raw, np.uint8)[C.ragged(a, b - a)]
                flat = np.where(_BLANK[flat], np.uint8(32), flat)
                if len(a):  # one space between words, whatever was there
                    begins = np.cumsum(b - a) - (b - a)
                    blank = flat == 32
                    extra = blank.copy()
                    extra[1:] &= blank[:-1]
                    extra[0] = False
                    gone = np.add.reduceat(extra, begins)
                    flat, b = flat[~extra], b - gone
            else:
                a, b = window, last
                flat = np.frombuffer(raw, np.uint8)[C.ragged(a, b - a)]
            row.append(doc + at)
            first.append(window - cut.bounds[doc])
            count.append(n)
            gram.append(g)
            place.append(p - window)
            sizes.append(b - a)
            data.append(flat)
        if not sum(map(len, row)):
            return messages([], [], [], [])
        row, first, count, place, sizes = (np.concatenate(x).astype(np.int64) for x in (row, first, count, place, sizes))
        gram, data = np.concatenate(gram), np.concatenate(data)
        begins = np.cumsum(sizes) - sizes
        # equal strings of the chunk: those of its smallest document go
        text = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.r_[begins, len(data)].astype(np.int64)), pa.py_buffer(data)])
        code = text.dictionary_encode().indices.to_numpy().astype(np.int64)
        own = chunk.ids[row]
        least = np.full(code.max() + 1, C.NO_ID)
        np.minimum.at(least, code, own)
        goes = own == least[code]
        stay = np.flatnonzero(~goes)
        order = np.flatnonzero(goes)
        order = order[np.argsort(gram[order], kind="stable")]
        b, lo, hi = _by_bucket(gram[order], buckets)
        columns = dict(rows=row, starts=first, counts=count, ids=own, grams=gram, places=place, sizes=sizes)
        fields = lambda at, kinds: [columns[c][at].astype(kind) for c, kind in kinds]
        going, flat, ends = fields(order, FIELDS), data[C.ragged(begins[order], sizes[order])], np.r_[0, np.cumsum(sizes[order])]
        out = [packed([c[x:y] for c in going], C.squeeze(flat[ends[x] : ends[y]])) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
        to, whole, me = b.tolist(), [True] * len(b), key[0].as_py()
        if len(stay):  # known without the bucket's answer, which passes them on
            out.append(packed(fields(stay, FIELDS[:3])))
            to, whole = [*to, me % buckets], [*whole, False]
        return messages([me] * len(out), to, whole, out)

    return run


@dataclass
class Strings:
    """The super-k-mers of a bucket."""

    ids: np.ndarray
    counts: np.ndarray
    grams: np.ndarray
    places: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray
    data: np.ndarray


#: Gives for each window of each string (string after string) the smallest document it starts in.
Resolve = Callable[[Units, Strings], np.ndarray]


def _answers(u: Units, resolve: Resolve) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        C.release()
        known = table.filter(pc.invert(table.column("whole")))
        table = table.filter(table.column("whole"))
        if not table.num_rows:
            return known
        got = [unpacked(x, FIELDS) for x in table.column("data").to_pylist()]
        column = {c: np.concatenate([own[i] for own, _ in got]) for i, (c, _) in enumerate(FIELDS[2:], 2)}
        data = np.frombuffer(b"".join(C.unsqueeze(rest) for _, rest in got), np.uint8)
        sizes, counts = column["sizes"].astype(np.int64), column["counts"].astype(np.int64)
        s = Strings(column["ids"], counts, column["grams"], column["places"].astype(np.int64), np.cumsum(sizes) - sizes, sizes, data)
        least = resolve(u, s)
        gone = least < np.repeat(s.ids, counts)
        bit = np.uint64(1) << (np.arange(len(gone)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64)
        masks = np.add.reduceat(np.where(gone, bit, np.uint64(0)), np.cumsum(counts) - counts)
        parts, answers, chunks, buckets = np.cumsum([0, *(len(own[0]) for own, _ in got)]), [], [], []
        for (own, _), a, b, chunk, bucket in zip(got, parts[:-1], parts[1:], table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), strict=True):
            some = masks[a:b] != 0
            if some.any():
                answers.append(packed([*(x[some] for x in own[:3]), masks[a:b][some]]))
                chunks.append(chunk)
                buckets.append(bucket)
        return pa.concat_tables([messages(chunks, buckets, [True] * len(answers), answers), known])

    return run


def _covered(u: Units, answers: pa.Table, bounds: np.ndarray) -> np.ndarray:
    """Which units of a chunk (documents one after another) lie in a window that starts in a smaller document."""
    edge = np.zeros(int(bounds[-1]) + 1, np.int64)
    for whole, data in zip(answers.column("whole").to_pylist(), answers.column("data").to_pylist(), strict=True):
        (rows, starts, counts, *masks), _ = unpacked(data, ANSWERED if whole else FIELDS[:3])
        at = bounds[rows] + starts
        if not whole:
            np.add.at(edge, at, 1)
            np.add.at(edge, at + counts.astype(np.int64) - 1 + u.k, -1)
            continue
        bits = np.unpackbits(np.ascontiguousarray(masks[0]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        which, bit = np.nonzero(bits)
        begin = at[which] + bit
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + u.k, -1)
    return np.cumsum(edge)[:-1] > 0


def without_repeats(docs: DataFrame, u: Units, resolve: Resolve, out: Callable[[bytes, np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """out(data, bounds, unit bounds, covered) of each chunk, after its doc_id column. docs: doc_id, text without nulls."""
    chunks, buckets = grid(docs)
    dealt = C.dealt(docs, chunks)
    asked = dealt.groupBy("chunk").applyInArrow(_ask(u, buckets), REPLY)
    replies = asked.groupBy("bucket").applyInArrow(_reply, REPLY)
    requests = dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_requests(u, buckets), MESSAGE)
    answers = requests.groupBy("bucket").applyInArrow(_answers(u, resolve), MESSAGE)

    def finish(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return out(b"", np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, bool)).add_column(0, "doc_id", pa.array([], pa.int64()))
        chunk = C.Chunk(docs)
        bounds = chunk.bounds
        if u.words:
            n = np.zeros(len(chunk.ids), np.int64)
            for at, raw, b in chunk.slices(SLICE_UNITS):
                n[at : at + len(b) - 1] = np.diff(cut_units(u, raw, b).bounds)
            bounds = np.r_[0, np.cumsum(n)]
        covered = _covered(u, answers, bounds)
        return out(chunk.data, chunk.bounds, bounds, covered).add_column(0, "doc_id", chunk.id_column())

    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)
