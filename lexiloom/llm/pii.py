"""Personal data by weak supervision, in DataFrame operations only.

Base detectors give spans that always stay. Looser detectors add candidates: base matches that fail their
validity test, card numbers inside a longer run of digits, and numbers in a national form outside valid phone
numbers (also inside a match that failed as a whole). Four labelers vote on every candidate (1 for, -1
against, 0 for no opinion): the pattern's validity test, a gazetteer (domains, country codes, issuers and their
lengths, octet ranges), the words on both sides, and the characters next to it. Votes are counted by their
pattern, of which there are a few thousand at most whatever the corpus; expectation-maximisation on these
counts gives each labeler's reliability, and its posteriors train a logistic span classifier over votes,
kind and size. A candidate beyond the base is a span if the classifier gives it over 1/2.

All work on a text grows in proportion to it: a match can only begin at the start of a run of
its characters or where the last match ended, and repeats give nothing back; places are running sums of the
lengths of matches and of what lies between them, summed in blocks; no step cuts from the start of the text.

Defined results: a null or empty text has no spans; kinds are searched apart, so spans of two kinds may
overlap; the sides that a labeler sees end at the neighbouring match; repeated rows give repeated rows; an empty
table gives no rows and trains nothing; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone", "national")
BASE = KINDS[:4]
#: The patterns of the kinds, and of card numbers within a longer run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "national": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{2,3}[-.\x20][0-9]{4}(?![0-9.-])",
}
CARD_PART = r"(?<![0-9])(?:[0-9]{16}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])"
#: What a text needs for a kind's pattern to be tried at all.
NEEDS = {"email": "@", "phone": "+"}
TRIED = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "national": r"[0-9]{3}\)?[-.\x20]"}
#: Gazetteers and the words that speak for a kind, of four languages.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "ch", "at", "be", "it")
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "61", "62", "64", "65", "81", "82", "86", "90", "91")
CONTEXT = {
    "email": r"mail|contact|kontakt|correo|courriel|write to|reach",
    "ip": r"\bip\b|host|server|address|adresse",
    "card": r"card|karte|carte|tarjeta|visa|credit|iban",
    "phone": r"phone|tel|call|fax|mobil|cell|contact|anruf|appel|llama",
    "national": r"phone|tel|call|fax|mobil|cell|ssn|social security|anruf|appel|llama",
}
AGAINST = r"version|isbn|issn|section|chapter|figure|order no|serial|\bv$"
GLUE_BEFORE, GLUE_AFTER = r"[\p{L}0-9_=#\"'/-]$", r"^[\p{L}0-9_=\"'/-]"
OPEN_BEFORE, OPEN_AFTER = r"(?:^|[\s(\[<:;,.!?])$", r"^(?:$|[\s)\]>:;,.!?])"
SIDE = 32
BLOCK = 256  # elements of a running sum that are appended one by one
LABELERS = 4
#: How often a labeler's opinion is for what is no span, and for a span, before anything is counted; a validity test errs least.
START = ((0.05, 0.95), (0.35, 0.85), (0.35, 0.85), (0.35, 0.85))

PLACED = "struct<value:string,start:bigint,end:bigint,before:string,after:string>"
SPAN = "struct<kind:int,start:bigint,end:bigint,base:boolean,votes:array<int>,size:int>"


def empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, wherever body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """What step(state, item) -> (state, out) gives for each item in turn.

    Items are taken in blocks, first for the state before each and then for what comes out, so appending
    costs no square; items are reached by place, as a slice or a nested transform would copy all of them.
    """

    def whole(xs: Column) -> Column:
        places = lambda k: F.sequence(k * BLOCK, F.least((k + 1) * BLOCK, F.size(xs)) - 1)
        blocks = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))

        def after(states: Column, k: Column) -> Column:
            return F.array_append(states, F.aggregate(places(k), F.element_at(states, -1), lambda state, i: step(state, F.get(xs, i))[0]))

        def one(acc: Column, i: Column) -> Column:
            state, made = step(acc["state"], F.get(xs, i))
            return F.struct(state.alias("state"), F.array_append(acc["out"], made).alias("out"))

        outs = lambda states: F.transform(blocks, lambda k: F.aggregate(places(k), F.struct(F.get(states, k).alias("state"), empty(out).alias("out")), one)["out"])
        return F.flatten(let(F.aggregate(blocks, F.array(zero), after), outs))

    return let(items, lambda xs: F.when(F.size(xs) > 0, whole(xs)).otherwise(empty(out)))


def tail(c: Column) -> Column:
    return F.substring(c, -SIDE, SIDE)


def located(text: Column, pattern: str, may: Column | None = None) -> Column:
    """array of (value, start, end, before, after): places in code points, and what is next to the match on both sides."""

    def placed(values: Column) -> Column:
        def items(gaps: Column) -> Column:
            return F.transform(values, lambda v, i: F.struct(v.alias("value"), F.length(F.get(gaps, i)).cast("long").alias("gap"), tail(F.get(gaps, i)).alias("before"), F.substring(F.get(gaps, i + 1), 1, SIDE).alias("after")))

        def step(at: Column, x: Column) -> tuple[Column, Column]:
            end = at + x["gap"] + F.length(x["value"])
            return end, F.struct(x["value"].alias("value"), (at + x["gap"]).alias("start"), end.alias("end"), x["before"].alias("before"), x["after"].alias("after"))

        return scan(let(F.split(text, pattern, -1), items), F.lit(0).cast("long"), step, PLACED)

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda values: F.when(F.size(values) > 0, placed(values)).otherwise(empty(PLACED)))
    return found if may is None else F.when(may, found).otherwise(empty(PLACED))


def shifted(found: Column, by: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["value"].alias("value"), (x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["before"].alias("before"), x["after"].alias("after")))


def _may(kind: str) -> Column:
    return F.contains("text", F.lit(NEEDS[kind])) if kind in NEEDS else F.col("text").rlike(TRIED[kind])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, -i, F.lit(1))) - 48
        twice = F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return acc + twice

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _octets(value: Column) -> Column:
    # an octet's zeros in front don't count; three digits at most are left of one that is small enough
    return F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.coalesce(F.try_to_number(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))), F.lit("9999")), F.lit(0)) <= 255), F.lit(False)))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return _octets(value)
    if kind == "card":
        return let(_digits(value), lambda digits: F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(kind == "email")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _gazetteer(kind: str, x: Column) -> Column:
    value = x["value"]
    if kind == "email":
        return _vote(F.lower(F.substring_index(value, ".", -1)).isin(*DOMAINS), F.lit(False))
    if kind == "ip":
        return _vote(value.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])\."), value.rlike(r"^0"))
    if kind == "card":
        return _vote(value.rlike(r"^[3-6]") & F.length(_digits(value)).between(15, 16), value.rlike(r"^[01789]"))
    if kind == "phone":
        return _vote(F.regexp_extract(value, r"^\+([0-9]{1,3})", 1).rlike("^(?:" + "|".join(COUNTRY_CODES) + ")"), value.startswith("+0"))
    return _vote(x["before"].rlike(r"\+(?:" + "|".join(COUNTRY_CODES) + r")\x20?$"), F.lit(False))


def _judged(found: Column, kind: str, base: bool = True) -> Column:
    """Placed candidates of a kind with their votes."""

    def one(x: Column) -> Column:
        sides = F.lower(F.concat(x["before"], F.lit(" \n "), x["after"]))
        context = _vote(sides.rlike(CONTEXT[kind]), F.lower(x["before"]).rlike(AGAINST))
        glued = x["before"].rlike(GLUE_BEFORE) | x["after"].rlike(GLUE_AFTER)
        near = F.when(glued, -1).when(x["before"].rlike(OPEN_BEFORE) & x["after"].rlike(OPEN_AFTER), 1).otherwise(0)
        size = F.least(F.lit(20), F.length(_digits(x["value"]))) if kind != "email" else F.lit(0)

        def span(valid: Column) -> Column:
            votes = F.array(_vote(valid, F.lit(kind != "national")), _gazetteer(kind, x), context, near)
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), (valid & F.lit(base)).alias("base"), votes.alias("votes"), size.cast("int").alias("size"))

        return let(_valid(kind, x["value"]), span)

    return F.transform(found, one)


def _cards() -> Column:
    """Whole runs that could be a card by their length, and card numbers within runs that fail."""

    def both(runs: Column) -> Column:
        whole = F.filter(runs, lambda x: F.length(_digits(x["value"])).between(13, 19))
        longer = F.filter(runs, lambda x: (F.length(x["value"]) > 16) & ~_valid("card", x["value"]))
        parts = F.flatten(F.transform(longer, lambda x: shifted(located(x["value"], CARD_PART), x["start"])))
        return F.concat(_judged(whole, "card"), _judged(F.filter(parts, lambda x: _valid("card", x["value"])), "card", base=False))

    return let(located(F.col("text"), PATTERNS["card"], _may("card")), both)


def _phones() -> Column:
    """Numbers with a country code, and national ones between them or within those that fail."""

    def between(found: Column) -> Column:
        gaps = F.when(F.size(found) > 0, F.split("text", PATTERNS["phone"], -1)).otherwise(F.array("text"))

        def inside(pieces: Column) -> Column:
            begin = lambda i: F.when(i > 0, F.get(found, i - 1)["end"]).otherwise(F.lit(0).cast("long"))
            return F.flatten(F.transform(pieces, lambda p, i: shifted(located(p, PATTERNS["national"], p.rlike(TRIED["national"])), begin(i))))

        failed = F.filter(found, lambda x: ~_valid("phone", x["value"]))
        within = F.flatten(F.transform(failed, lambda x: shifted(located(x["value"], PATTERNS["national"]), x["start"])))
        national = F.when(F.col("text").rlike(TRIED["national"]), F.concat(let(gaps, inside), within)).otherwise(empty(PLACED))
        return F.concat(_judged(found, "phone"), _judged(national, "national"))

    return let(located(F.col("text"), PATTERNS["phone"], _may("phone")), between)


def candidates(docs: DataFrame) -> DataFrame:
    """All columns of docs (one of them `text`) and `found`: all candidates with their votes."""
    simple = (_judged(located(F.col("text"), PATTERNS[k], _may(k)), k) for k in ("email", "ip"))
    return docs.withColumn("found", F.concat(*simple, _cards(), _phones()).cast(f"array<{SPAN}>"))


def counted(found: DataFrame) -> list[tuple]:
    """(kind, votes, size, n) of each pattern: len(KINDS) x 3^LABELERS x 21 rows at most, whatever the corpus."""
    one = found.select(F.explode("found").alias("f")).groupBy("f.kind", "f.votes", "f.size").agg(F.count("*").alias("n"))
    return [(r["kind"], tuple(r["votes"]), r["size"], r["n"]) for r in one.collect()]


class Model:
    """Labelers' reliabilities by expectation-maximisation, and the span classifier trained on its posteriors."""

    def __init__(self, counts: list[tuple], rounds: int = 50, epochs: int = 300) -> None:
        self.counts = sorted(counts)
        rates = [list(r) for r in START]  # rates[l][y]: share of 1 among the opinions of labeler l on class y
        prior, post = {k: 0.5 for k in range(len(KINDS))}, {}
        for _ in range(rounds):
            post = {}
            for kind, votes, size, _ in self.counts:
                p = [1 - prior[kind], prior[kind]]
                for y in (0, 1):
                    for l, v in enumerate(votes):
                        if v:  # no opinion says nothing about the class
                            p[y] *= rates[l][y] if v > 0 else 1 - rates[l][y]
                # what the validity test confirms is certain, and anchors which class is which
                post[kind, votes, size] = 1.0 if votes[0] == 1 else p[1] / max(sum(p), 1e-300)
            for k in prior:
                own = [(post[c[:3]], c[3]) for c in self.counts if c[0] == k]
                prior[k] = (sum(p * n for p, n in own) + 5) / (sum(n for _, n in own) + 10)
            for l in range(LABELERS):
                for y in (0, 1):
                    yes, all_ = 20 * START[l][y], 20.0
                    for kind, votes, size, n in self.counts:
                        share = n * (post[kind, votes, size] if y else 1 - post[kind, votes, size])
                        yes, all_ = yes + share * (votes[l] > 0), all_ + share * (votes[l] != 0)
                    rates[l][y] = yes / all_
        self.rates, self.prior, self.posterior = rates, prior, post
        # the classifier starts from the reliabilities, then learns the posteriors; kinds weigh alike, however rare
        ratio = lambda l: math.log(rates[l][1] * (1 - rates[l][0]) / (rates[l][0] * (1 - rates[l][1]))) / 2
        self.weights = [*(ratio(l) for l in range(LABELERS)), *(math.log(prior[k] / (1 - prior[k])) for k in range(len(KINDS))), 0.0]
        of_kind = {k: sum(c[3] for c in self.counts if c[0] == k) * len({c[0] for c in self.counts}) for k in range(len(KINDS))}
        for _ in range(epochs if self.counts else 0):
            slope = [0.0] * len(self.weights)
            for kind, votes, size, n in self.counts:
                miss = post[kind, votes, size] - self.score(kind, votes, size)
                for j, x in self._features(kind, votes, size):
                    slope[j] += n / of_kind[kind] * miss * x
            self.weights = [w + s - 1e-4 * w for w, s in zip(self.weights, slope, strict=True)]

    def _features(self, kind: int, votes: tuple, size: int) -> list[tuple[int, float]]:
        return [*((l, float(v)) for l, v in enumerate(votes)), (LABELERS + kind, 1.0), (LABELERS + len(KINDS), size / 20)]

    def score(self, kind: int, votes: tuple, size: int) -> float:
        z = sum(self.weights[j] * x for j, x in self._features(kind, votes, size))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def expression(self, f: Column) -> Column:
        """The same score of a span column."""
        w = self.weights
        z = sum((w[l] * F.element_at(f["votes"], l + 1) for l in range(LABELERS)), F.lit(0.0))
        z = z + F.element_at(F.array(*(F.lit(x) for x in w[LABELERS : LABELERS + len(KINDS)])), f["kind"] + 1) + w[-1] * f["size"] / 20
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, tables: C.Tables | None = None) -> DataFrame:
    """`doc_id` and `spans` (kind, start, end, base; by kind, then start) of every row; keep: its whole row too, as `row`."""
    tables = tables or C.Tables(docs.sparkSession, "pii")
    more = [F.struct(*docs.columns).alias("row")] if keep else []
    found = tables.written(candidates(C.texts(docs, id_col, text_col, *more)).drop("text"), "candidates")
    model = Model(counted(found))
    spans = F.transform(F.filter("found", lambda f: f["base"] | (model.expression(f) > 0.5)), lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end"), f["base"].alias("base")))
    return found.withColumn("spans", F.sort_array(spans)).drop("found")


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", F.element_at(names, f["kind"] + 1), f["start"].cast("string"), f["end"].cast("string"))), ",")


def span_digests(docs: DataFrame) -> DataFrame:
    spans = personal_spans(docs)
    base = F.filter("spans", lambda f: f["base"])
    count = lambda k: F.size(F.filter("spans", lambda f: f["base"] & (f["kind"] == KINDS.index(k)))).cast("long").alias(f"n_{k}")
    return spans.select("doc_id", *(count(k) for k in BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


CUT = 1024


def masked(text: Column, spans: Column) -> Column:
    """text with each maximal run of overlapping spans replaced by its first kind in brackets; grows with text and spans, not their product."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    ordered = F.sort_array(F.transform(spans, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["kind"].alias("kind"))))

    def step(at: Column, f: Column) -> tuple[Column, Column]:
        return F.greatest(at, f["end"]), F.struct(at.alias("at"), f["start"].alias("start"), f["kind"].alias("kind"))

    def between(parts: Column, a: Column, b: Column) -> Column:
        """Code points a to b, from the pieces of CUT code points that hold them."""
        first = F.floor(a / CUT).cast("int")
        held = F.array_join(F.slice(parts, first + 1, F.floor(b / CUT).cast("int") - first + 1), "")
        return F.substring(held, (a - first * CUT + 1).cast("int"), (b - a).cast("int"))

    def whole(parts: Column) -> Column:
        runs = scan(ordered, F.lit(0).cast("long"), step, "struct<at:bigint,start:bigint,kind:int>")
        kept = F.transform(F.filter(runs, lambda r: r["start"] >= r["at"]), lambda r: F.concat(between(parts, r["at"], r["start"]), F.element_at(names, r["kind"] + 1)))
        last = F.array_max(F.transform(spans, lambda f: f["end"]))
        return F.concat(F.array_join(kept, ""), let(last, lambda at: between(parts, at, F.size(parts).cast("long") * CUT)))

    return F.when(F.size(spans) > 0, let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)), whole)).otherwise(text)


def masked_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with the personal data of each text masked, and its length (where there is such a column) counted again."""
    tables = C.Tables(docs.sparkSession, "pii")
    found = personal_spans(docs, id_col, text_col, keep=True, tables=tables)
    found = found.withColumn("masked", masked(F.col("row").getField(text_col), F.col("spans")))
    new = {text_col: F.col("masked"), chars_col: F.length("masked").cast("long")}
    return tables.only(found.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns)))
