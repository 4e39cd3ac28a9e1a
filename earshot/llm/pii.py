"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

DataFrame functions alone. Java's engine finds leftmost matches; their places follow from the text between them:
split() gives what lies between the matches of regexp_extract_all(), so that lengths add up to code-point offsets.
Patterns use possessive groups (which Java runs as loops, without recursion) and look-behinds that let a match
begin only where a run of its characters begins, which keeps each search linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters of an account number by country, as registered or in use there.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def iban_pattern() -> str:
    """Finds the first four characters of account numbers; group 1 is the whole: as long as its country has it, or the
    longest run for other countries. What a number that checks refuse runs over is searched too."""
    listed = [rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}+" for n, codes in IBAN_LENGTHS.items()]
    other = rf"(?!{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}+"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}} ?[A-Z0-9])(?=({'|'.join([*listed, other])})(?![A-Za-z0-9]))[A-Z]{{2}}[0-9]{{2}}"


# The base patterns, as stated for the kinds, in forms that match the same spans.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": iban_pattern(),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
#: What a confirmed span starts with, what a context word near it adds, and what added kinds need.
START_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT_SCORE = 0.2
ADDED_THRESHOLD = 0.5
#: Code points on each side in which context words count.
CONTEXT = 40
#: Matches handled together, and pieces on each side that hold what is near them (a piece has a character at least, and
#: an account number reaches over up to 70).
PORTION, BESIDE = 128, 120
# Context words by kind.
CONTEXT_WORDS = {
    "email": "mail|e-mail|email|contact|write|kontakt|correo|courriel",
    "ip": "ip|address|host|server|login|adresse",
    "card": "card|visa|credit|payment|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax|telefon|telefono",
    "iban": "iban|bank|account|konto|cuenta|compte",
    "ssn": "ssn|social|security|taxpayer",
}


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    places = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number, without spaces, leaves 1 modulo 97 (letters count 10 to 35)."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(4)))

    def step(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (a * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), step) == 1


def confirmed(kind: str, found: Column) -> Column:
    digits = digits_of(found)
    if kind == "ip":
        parts = F.transform(F.split(found, "\\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return mod97(F.replace(found, F.lit(" "), F.lit("")))
    if kind == "ssn":
        return ~found.rlike("^(?:000|666|9..)|-00-|-0000$")
    return F.lit(True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def upto(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def portion(i: Column, n: Column) -> Column:
    """The places of the i-th PORTION of n."""
    return F.sequence(i * PORTION, F.least((i + 1) * PORTION, n) - 1)


def portions(n: Column) -> Column:
    return F.ceil(n / PORTION).cast("int")


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of some whole numbers, what combine (a sum or a maximum) makes of 0 and those before it, and one more
    for all of them. Arrays grow by copies, so portions are run through one by one from their own starts: time grows
    with the number of values, not with its square."""

    def grow(a: Column, x: Column) -> Column:
        return F.concat(a, F.array(combine(F.element_at(a, -1), x)))

    def whole(v: Column) -> Column:
        n = F.size(v)
        zero = F.array(F.lit(0))
        totals = F.transform(upto(portions(n)), lambda i: F.aggregate(portion(i, n), F.lit(0), lambda a, k: combine(a, F.get(v, k))))
        return let(F.aggregate(totals, zero, grow), lambda heads: F.concat(
            F.flatten(F.transform(upto(portions(n)), lambda i: let(F.aggregate(portion(i, n), F.array(F.get(heads, i)), lambda a, k: grow(a, F.get(v, k))), lambda a: F.slice(a, F.lit(1), F.size(a) - 1)))),
            F.array(F.element_at(heads, -1))))

    return let(values, whole)


def proposals(kind: str, text: Column) -> Column:
    """array<struct<start, end, found, near>> of the pattern's matches: offsets in code points, end exclusive, and the
    text within CONTEXT of the span on both sides.

    Matches and what lies between them are pieces of the text, whose lengths add up to offsets. What is near comes from
    the pieces around, so that no match needs a walk from the text's start.
    """
    ahead = kind == "iban"  # its match is four characters, its first group the span
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(1 if ahead else 0))
    consumed = (lambda x: F.left(x, F.lit(4))) if ahead else (lambda x: x)

    def located(s: Column) -> Column:
        n = F.size(s["found"])
        lengths = F.transform(upto(n), lambda k: F.length(F.get(s["gaps"], k)) + F.length(consumed(F.get(s["found"], k))))
        return let(running(lengths, lambda a, b: a + b), lambda begins: F.flatten(F.transform(upto(portions(n)), lambda i: part(s, begins, i, n))))

    def part(s: Column, begins: Column, i: Column, n: Column) -> Column:
        first, last = F.greatest(i * PORTION - BESIDE, F.lit(0)), F.least((i + 1) * PORTION + BESIDE, n)
        pieces = F.transform(F.sequence(first, last - 1), lambda k: F.concat(F.get(s["gaps"], k), consumed(F.get(s["found"], k))))
        here = F.concat(F.array_join(pieces, ""), F.get(s["gaps"], last))
        return let(F.struct(here.alias("text"), F.get(begins, first).alias("base")), lambda h: F.transform(portion(i, n), lambda k: span(s, begins, h, k)))

    def span(s: Column, begins: Column, h: Column, k: Column) -> Column:
        begin = F.get(begins, k) + F.length(F.get(s["gaps"], k))

        def with_near(x: Column) -> Column:
            start, end = x["start"] - h["base"], x["end"] - h["base"]
            near = F.concat(F.substr(h["text"], F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT))), F.lit(" "), F.substr(h["text"], end + 1, F.lit(CONTEXT)))
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found"), F.lower(near).alias("near"))

        own = F.get(s["found"], k)
        return let(F.struct(begin.alias("start"), (begin + F.length(own)).alias("end"), own.alias("found")), with_near)

    cut = F.struct(F.split(text, PATTERNS[kind], -1).alias("gaps"), found.alias("found"))
    none = F.expr("cast(array() as array<struct<start:int,end:int,found:string,near:string>>)")
    return F.when(F.regexp_instr(text, F.lit(PATTERNS[kind])) > 0, let(cut, located)).otherwise(none)


def spans_of(text: Column) -> Column:
    """array<struct<start, rank, kind, end, score>> of a text, in order of start, then kind."""
    body = F.coalesce(text, F.lit(""))

    def judged(kind: str) -> Column:
        def score(x: Column) -> Column:
            more = F.when(x["near"].rlike(rf"(?<![a-z])(?:{CONTEXT_WORDS[kind]})(?![a-z])"), F.lit(CONTEXT_SCORE)).otherwise(F.lit(0.0))
            return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"), (F.lit(START_SCORE[kind]) + more).alias("score"))

        valid = F.transform(F.filter(proposals(kind, body), lambda x: confirmed(kind, x["found"])), score)
        return valid if kind in BASE else F.filter(valid, lambda x: x["score"] >= ADDED_THRESHOLD)

    return F.array_sort(F.concat(*map(judged, KINDS)))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one more column `pii`: array<struct<start, rank, kind, end, score>> in order of start, then kind.

    Kinds rank as in KINDS. email, ip, card and phone spans that their checks confirm are always there; iban spans
    need mod-97, ssn spans a context word nearby. score (0 to 1) is the kind's start score and more for a context
    word within CONTEXT code points. A null or empty text has no spans; very long texts and many matches are searched
    whole; other columns are kept, whatever their names, but for a column `pii`, which this one replaces.
    """
    return docs.withColumn("pii", spans_of(F.col(text)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def merged(spans: Column) -> Column:
    """Spans in order of start, with overlapping ones as one that has the first one's kind."""
    reach = running(F.transform(spans, lambda x: x["end"]), F.greatest)  # the end of all spans before each

    def joined_up(s: Column) -> Column:
        firsts = F.filter(upto(F.size(s["spans"])), lambda k: F.get(s["spans"], k)["start"] >= F.get(s["reach"], k))

        def one(f: Column, j: Column, k: Column) -> Column:
            next_first = F.coalesce(F.get(f, j + 1), F.size(s["spans"]))
            return F.struct(F.get(s["spans"], k)["start"].alias("start"), F.get(s["reach"], next_first).alias("end"), F.get(s["spans"], k)["kind"].alias("kind"))

        return let(firsts, lambda f: F.transform(f, lambda k, j: one(f, j, k)))

    return let(F.struct(spans.alias("spans"), reach.alias("reach")), joined_up)


def rewritten(text: Column, spans: Column) -> Column:
    """text with each of some spans, in order and apart, replaced by [KIND]."""

    def whole(s: Column) -> Column:
        n = F.size(s["spans"])
        end = lambda k: F.coalesce(F.when(k > 0, F.get(s["spans"], k - 1)["end"]), F.lit(0))

        def part(i: Column) -> Column:
            first, last = i * PORTION, F.least((i + 1) * PORTION, n)
            cut = F.struct(F.substr(s["text"], end(first) + 1, end(last) - end(first)).alias("text"), end(first).alias("base"))

            def piece(h: Column, k: Column) -> Column:
                x = F.get(s["spans"], k)
                kept = F.substr(h["text"], end(k) - h["base"] + 1, x["start"] - end(k))
                return F.concat(kept, F.lit("["), F.upper(x["kind"]), F.lit("]"))

            return let(cut, lambda h: F.array_join(F.transform(portion(i, n), lambda k: piece(h, k)), ""))

        return F.concat(F.array_join(F.transform(upto(portions(n)), part), ""), F.substr(s["text"], end(n) + 1, F.length(s["text"])))

    return let(F.struct(text.alias("text"), spans.alias("spans")), whole)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of find() replaced by [KIND]; overlapping spans become one, named by the first. A text
    without spans, or null, stays; all columns stay, whatever their names."""
    changed = let(spans_of(F.col(text)), lambda found: F.when(F.size(found) > 0, rewritten(F.col(text), merged(found))).otherwise(F.col(text)))
    return docs.withColumn(text, changed)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, from find()."""
    found = find(docs.select("doc_id", "text"))
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))
