"""Column functions over text: blanks, words, edit distance, error rates, characters of a fixed set."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import distance

#: Unicode white space as text tools strip it; Java's class lacks four separators.
BLANK = r"(?U)[\s\x1c-\x1f]"
#: The same as characters.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: The default character set in order; index 0 is the blank, characters count from 1.
DIGITS = "0123456789"
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
PUNCTUATION = " .,:;!?'\"()[]{}-+/\\@#%&*=_<>|~`$"
JOINERS = "\u200d\u200c"
BLOCK = (0x0D80, 0x0DFF)


def strip(c: Column) -> Column:
    """Without the blanks at both ends; in time linear in the text, whatever runs of blanks are in it."""
    return F.btrim(c, F.lit(BLANKS))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{BLANK}+"), lambda w: w != "")


def lines(c: Column) -> Column:
    """Stripped lines that are not blank, in order."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n"), strip), lambda x: x != "")


def characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def edits(a: Column, b: Column) -> Column:
    """Not for the body of a lambda, as it runs in Python."""
    return distance.edits(a, b)


def word_edits(a: Column, b: Column) -> Column:
    """Word-level distance of two arrays."""
    return distance.edits(a, b)


def rate(errors: Column, size: Column, hypothesis_size: Column) -> Column:
    """errors / size; of an empty reference 0 if the hypothesis is empty too, else 1."""
    return F.when(size > 0, errors / size).when(hypothesis_size > 0, 1.0).otherwise(0.0)


def cer(ref: Column, hyp: Column) -> Column:
    return rate(edits(ref, hyp), F.length(ref), F.length(hyp))


def wer(ref: Column, hyp: Column) -> Column:
    a, b = words(ref), words(hyp)
    return rate(word_edits(a, b), F.size(a), F.size(b))


def accuracy(error_rate: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.coalesce(error_rate.try_cast("double"), F.lit(1.0)))


def accuracy_pct(error_rate: Column) -> Column:
    return 100 * accuracy(error_rate)


@functools.cache
def other_digits() -> str:
    """Digits by their Unicode property that are no decimal digits, as ranges of a character class."""
    found = [i for i in range(0x110000) if chr(i).isdigit() and not chr(i).isdecimal()]
    starts = [i for i in found if i - 1 not in found]
    ends = [i for i in found if i + 1 not in found]
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True))


def digits(c: Column) -> Column:
    """Number of Unicode digits; superscripts and circled ones count, other numbers don't. What is no digit goes by runs, plain characters first."""
    return F.length(F.regexp_replace(c, rf"[\x{{0}}-/:-\x{{7f}}]++|[^\p{{Nd}}{other_digits()}]++", ""))


def digit_ratio(c: Column) -> Column:
    """Share of digits()."""
    return digits(c) / F.greatest(F.lit(1), F.length(c))


def looks_like_garbage(c: Column, threshold: float = 0.4, count: Column | None = None) -> Column:
    """count: digits(c), where it is at hand; blanks at the ends hold none."""
    size = F.length(strip(c))
    return (size > 0) & ((digits(c) if count is None else count) / F.greatest(F.lit(1), size) >= threshold)


def with_warning(c: Column, truth: Column, warning: str = "[?] ") -> Column:
    return F.when(truth.isNull() & looks_like_garbage(c), F.concat(F.lit(warning), c)).otherwise(c)


def default_characters(punctuation: str = PUNCTUATION) -> list[str]:
    """Digits, letters, punctuation, the two joiners and the script's block; first occurrence wins."""
    return list(dict.fromkeys([*DIGITS, *LETTERS, *punctuation, *JOINERS, *map(chr, range(BLOCK[0], BLOCK[1] + 1))]))


def num_classes(chars: list[str]) -> int:
    """The characters and the blank."""
    return len(chars) + 1


def encode(c: Column, chars: list[str]) -> Column:
    """Indices from 1; characters outside the set are left out."""
    known = F.array(*map(F.lit, chars))
    return F.filter(F.transform(characters(c), lambda ch: F.array_position(known, ch).cast("int")), lambda i: i > 0)


def decode(indices: Column, chars: list[str]) -> Column:
    known = F.array(*map(F.lit, chars))
    return F.array_join(F.transform(F.filter(indices, lambda i: i.between(1, len(chars))), lambda i: F.element_at(known, i)), "")


def as_bool(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("1", "true", "yes", "y", "on")


def log_add(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)), stable; -1e30 stands for minus infinity."""
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(low <= -1e30, high).otherwise(high + F.log1p(F.exp(low - high)))
