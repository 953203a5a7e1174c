"""The ordered rewrite rules for recognised lines, as a chain of expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Consonants, vowels written before them, the end of a word, and the rules in order.
CONSONANTS = "කඛගඝඞඟචඡජඣඤටඨඩඪණතථදධනපඵබභමයරලවශෂසහළෆඳඬ"
BEFORE = "ෙේෛොෝෞ"
END = r"(?=(?:\s|$|[.…/]))"
FIRST = [("ෙ([" + CONSONANTS + "])ී", "$1ේ"), ("ෙණ්" + END, "ණේ"), ("ේී", "ේ"), ("ණී" + END, "ණේ")]
SECOND = [
    ("[" + BEFORE + "]්", "්"),
    (r"(?<!\.)\.\.(?=/)", "..."),
    ("ලෙලෙ", "ලෙල"),
    ("වැවි" + END, "වැව්"),
    ("ුණි" + END, "ුණේ"),
    (r"මැවුණ\s*$", "මැවුණේ"),
    ("(?<!මිනි)ස්සු" + END, "ස්සූ"),
    ("හදවෙතේ", "හදවතේ"),
    ("හමුවලා", "හමුවෙලා"),
    ("උපදිමි" + END, "උපදිම්"),
    ("හිත්" + END, "හිතේ"),
    ("මගහැරී", "මඟහැරී"),
]


def chain(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, into in rules:
        c = F.regexp_replace(c, "(?U)" + pattern, into)
    return c


def reorder(c: Column) -> Column:
    """A vowel sign that follows no consonant changes places with the consonant after it; one scan from the left.

    The fold carries the text so far and the sign that waits for its next character. A swap uses both up, and
    the next character sees the swapped sign before it.
    """
    is_cons = lambda x: F.contains(F.lit(CONSONANTS), x) & (x != "")
    is_sign = lambda x: F.contains(F.lit(BEFORE), x) & (x != "")

    def step(acc: Column, ch: Column) -> Column:
        waits, last = acc["wait"], acc["last"]
        swap = (waits != "") & is_cons(ch) & ~is_cons(last)
        begin = is_sign(ch)
        out = F.when(swap, F.concat(acc["out"], ch, waits)).when(begin, F.concat(acc["out"], waits)).otherwise(F.concat(acc["out"], waits, ch))
        wait = F.when(swap | ~begin, F.lit("")).otherwise(ch)
        # `last` is the character before the waiting sign
        before = F.when(swap, waits).when(begin, F.when(waits != "", waits).otherwise(last)).otherwise(ch)
        return F.struct(out.alias("out"), wait.alias("wait"), before.alias("last"))

    start = F.struct(F.lit("").alias("out"), F.lit("").alias("wait"), F.lit("").alias("last"))
    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), start, step, lambda acc: F.concat(acc["out"], acc["wait"]))


def fix_line(c: Column) -> Column:
    """All rules but the one that asks a language model."""
    first = chain(c, FIRST)
    moved = F.when(first.rlike("[" + BEFORE + "][" + CONSONANTS + "]"), reorder(first)).otherwise(first)
    return chain(moved, SECOND)


#: Marks that may follow a word, and the ending that a language model may change.
MARKS = "[.…/]"
ENDING, INSTEAD = "මි", "ම්"


def parts(c: Column) -> Column:
    """Words and the blanks between them, in turn; joined they are the text again."""
    return F.regexp_extract_all(c, F.lit(r"(?U)[\s\x1c-\x1f]+|[^\s\x1c-\x1f]+"), F.lit(0))


def without_marks(part: Column) -> Column:
    return F.regexp_replace(part, MARKS + "+$", "")


def other_ending(core: Column, ending: str = ENDING, instead: str = INSTEAD) -> Column:
    """The word with the other ending; null where it doesn't end so, or is the ending alone."""
    return F.when(core.endswith(ending) & (F.length(core) > len(ending)), F.concat(core.substr(F.lit(1), F.length(core) - len(ending)), F.lit(instead)))


def word_with(ending: str) -> re.Pattern[str]:
    """Matches a word without its marks where it ends so and is more than the ending; Python's blanks are those of parts()."""
    return re.compile(rf"(?<!\S)\S+?(?<=\S{re.escape(ending)})(?<!{MARKS})(?={MARKS}*(?:\s|\Z))")
