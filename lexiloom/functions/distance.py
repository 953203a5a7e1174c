"""Edit distance of pairs, bit-parallel: one step of whole-number arithmetic a character instead of one a cell."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of the first side that one number holds; no result depends on it.
BLOCK = 1 << 13


def _block(a: Sequence, b: Sequence, into: list[int] | None) -> list[int] | int:
    """A band of rows of the table (Myers 1999, Hyyro 2003). into: the steps along its upper edge, None for the table's own edge."""
    m = len(a)
    mask, top, masks = (1 << m) - 1, 1 << (m - 1), {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    up, down, get, out = mask, 0, masks.get, []
    for j, y in enumerate(b):
        step = 1 if into is None else into[j]
        eq = get(y, 0)
        xv = eq | down
        if step < 0:
            eq |= 1
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (mask & ~(xh | up))
        mh = up & xh
        out.append(1 if ph & top else -1 if mh & top else 0)
        ph, mh = (ph << 1) & mask | (step > 0), (mh << 1) & mask | (step < 0)
        up, down = mh | (mask & ~(xv | ph)), ph & xv
    return out


def _single(a: Sequence, b: Sequence) -> int:
    """As one block without its edges: the distance is read off the last column."""
    mask, masks = (1 << len(a)) - 1, {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    up, down, get = mask, 0, masks.get
    for y in b:
        eq = get(y, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (mask ^ (mask & (xh | up)))
        mh = (up & xh) << 1 & mask
        ph = (ph << 1 | 1) & mask
        up, down = mh | (mask ^ (mask & (xv | ph))), ph & xv
    return len(b) + up.bit_count() - down.bit_count()


def distance(a: Sequence, b: Sequence) -> int:
    """Insertions, deletions and substitutions that make b of a; exact at any length, in memory of a block and one row."""
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    start, end = 0, len(b)
    while start < end and a[start] == b[start]:
        start += 1
    cut = 0
    while cut < end - start and a[-1 - cut] == b[-1 - cut]:
        cut += 1
    # the shorter side gives the steps, the longer one the bits
    a, b = a[start : len(a) - cut], b[start : end - cut]
    if not b:
        return len(a)
    if len(a) <= BLOCK:
        return _single(a, b)
    into = None
    for at in range(0, len(a), BLOCK):
        into = _block(a[at : at + BLOCK], b, into)
    return len(a) + sum(into)


def edits(a: Column, b: Column) -> Column:
    """Characters (of texts) or items (of arrays) to change; null where a side is null."""

    @F.pandas_udf("int")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        own = lambda x: x if isinstance(x, str) else list(x)
        return pd.Series([None if x is None or y is None else distance(own(x), own(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return of(a, b)


#: What all_edits gives.
COUNTS = ["edits", "word_edits", "ref_words", "hyp_words"]


def all_edits(ref: Column, hyp: Column) -> Column:
    """A struct of COUNTS for two arrays of lines, an array each, line by line as far as both go. Python's blanks are those of text.words()."""

    @F.pandas_udf(f"struct<{','.join(f'{c}:array<int>' for c in COUNTS)}>")
    def of(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
        def counts(x: str | None, y: str | None) -> tuple:
            u, v = (None if t is None else t.split() for t in (x, y))
            both = u is not None and v is not None
            return distance(x, y) if both else None, distance(u, v) if both else None, None if u is None else len(u), None if v is None else len(v)

        rows = []
        for xs, ys in zip(ref, hyp, strict=True):
            each = [] if xs is None or ys is None else [counts(x, y) for x, y in zip(xs, ys)]
            rows.append([list(c) for c in zip(*each)] or [[]] * len(COUNTS))
        return pd.DataFrame(rows, columns=COUNTS)

    return of(ref, hyp)
