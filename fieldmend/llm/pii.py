"""Personal data in texts, by DataFrame functions alone.

Regular expressions propose spans, validators (octet range, Luhn, mod 97, digit counts) confirm them, and words
near a span move its score. The base kinds email, ip, card and phone follow fixed patterns, leftmost and
non-overlapping; a match that its validator refuses is dropped without another try. They are always reported,
whatever their score. The other kinds, iban, ssn and secret (keys, tokens), are reported from a score of THRESHOLD on.

Positions are code points, the end exclusive. Null texts count as empty; spans of different kinds may overlap;
every row of the input gives one row, equal rows equal ones; other columns are passed over (kept by `redact`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked

#: Kinds in the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]

#: Characters of an IBAN by its country (fixed values).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR PS QA UA",
    30: "JO KW MU", 31: "MT SC",
}
IBAN = "|".join(f"(?:{'|'.join(countries.split())})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, countries in IBAN_LENGTHS.items())

#: Java patterns. They match what the base patterns match; look-behinds and possessive repeats only keep long
#: runs from being tried again at each of their characters, and keep Java from recursing.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": IBAN,
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"[A-Za-z0-9_+/-]{20,}+",
}
#: What a text must hold for its pattern to be tried at all.
GUARDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"),
    "ssn": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]"),
    "secret": lambda t: t.rlike(r"[A-Za-z0-9_+/-]{20}"),
}
#: Score without context, and the words (lower case) that add or take 0.3 within WINDOW characters before a span.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "secret": 0.4}
FOR = {
    "email": r"mail|contact|write",
    "ip": r"\bip\b|address|host|server|login",
    "card": r"card|visa|credit|debit|payment|cvv",
    "phone": r"phone|call|tel|mobile|fax",
    "iban": r"iban|bank|account|konto|compte",
    "ssn": r"ssn|social|security|tax",
    "secret": r"token|secret|key|passw|bearer|auth",
}
AGAINST = r"version|order|invoice|isbn|serial|build|example"
WINDOW, STEP, THRESHOLD = 40, 0.3, 0.6
#: Matches that are walked over in one go.
BLOCK = 256


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits is a multiple of 10. From the right, each second digit counts as
    the digit sum of its double."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """ISO 7064 mod 97-10: the first four characters moved to the end, letters as 10 to 35, leave 1."""
    plain = F.regexp_replace(iban, "\x20", "")
    moved = F.concat(F.substr(plain, F.lit(5), F.length(plain)), F.substr(plain, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substr(moved, i, F.lit(1)))
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def octets(ip: Column) -> Column:
    """All parts are 255 at most, whatever their leading zeros."""

    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) <= 3) & (F.coalesce(F.when(F.length(bare) <= 3, bare).try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(ip, r"\."), small)


VALID = {
    "email": lambda m: F.lit(True),
    "ip": octets,
    "card": lambda m: F.length(digits_of(m)).between(14, 19) & luhn(digits_of(m)),
    "phone": lambda m: F.length(digits_of(m)).between(10, 15),
    "iban": mod97,
    "ssn": lambda m: ~m.rlike(r"^(000|666|9)|-00-|-0000$"),
    # No checksum is known for these: letters and digits mixed, ten characters or more of them different.
    "secret": lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(m, ""))) >= 10),
}


def found(text: Column, kind: str) -> Column:
    """All matches of a kind's pattern as array<struct<start, match, near>>, near being the WINDOW characters before it. A walk over
    the texts between the matches tells where each begins and what stands before it, so that no part of a text is looked at
    more than a few times. Arrays grow by copies, so the walk goes by blocks of BLOCK matches."""
    matches = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)  # one more than the matches
    spans = "array<struct<start:int,match:string,near:string>>"
    none = F.array().cast(spans)
    end = lambda of: F.right(of, F.lit(WINDOW))

    def add(state: Column, x: Column) -> Column:
        start, near = state["at"] + F.length(x["0"]), end(F.concat(state["tail"], x["0"]))
        span = F.struct(start.alias("start"), x["1"].alias("match"), near.alias("near"))
        return F.struct((start + F.length(x["1"])).alias("at"), end(F.concat(near, x["1"])).alias("tail"), F.concat(state["spans"], F.array(span)).cast(spans).alias("spans"))

    def add_block(state: Column, block: Column) -> Column:
        begin = F.struct(state["at"].alias("at"), state["tail"].alias("tail"), none.alias("spans"))
        return F.aggregate(block, begin, add, lambda done: F.struct(done["at"].alias("at"), done["tail"].alias("tail"), F.concat(state["all"], F.array(done["spans"])).cast(f"array<{spans}>").alias("all")))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(f"array<{spans}>").alias("all"))

    def walked(pairs: Column) -> Column:
        n = F.size(pairs) - 1
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(pairs, b * BLOCK + 1, F.least(F.lit(BLOCK), n - b * BLOCK)))
        return F.when(n > 0, F.aggregate(blocks, begin, add_block, lambda done: F.flatten(done["all"]))).otherwise(none)

    pairs = F.zip_with(between, matches, lambda a, b: F.struct(a.alias("0"), b.alias("1")))
    # As the only item of an array the pairs are worked out once, not anew wherever a lambda names them.
    once = F.get(F.transform(F.array(pairs), walked), F.lit(0))
    return F.when(GUARDS[kind](text), once).otherwise(none)


def scored(text: Column, kind: str, order: int) -> Column:
    """The confirmed spans of a kind with their scores."""

    def score(x: Column) -> Column:
        near = F.lower(x["near"])
        plus = F.when(near.rlike(FOR[kind]), STEP).otherwise(0.0)
        minus = F.when(near.rlike(AGAINST), STEP).otherwise(0.0)
        return F.struct(
            x["start"].alias("start"),
            F.lit(order).alias("rank"),
            (x["start"] + F.length(x["match"])).alias("end"),
            F.lit(kind).alias("kind"),
            F.round(F.lit(SCORES[kind]) + plus - minus, 2).alias("score"),
        )

    return F.transform(F.filter(found(text, kind), lambda x: VALID[kind](x["match"])), score)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and its spans, array<struct<start, rank, end, kind, score>> ordered by start, then kind."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for k, kind in enumerate(KINDS):
        text = text.withColumn(f"of_{kind}", scored(F.col("text"), kind, k))
    added = [F.filter(f"of_{kind}", lambda x: x["score"] >= THRESHOLD) for kind in KINDS[4:]]
    return text.select("doc_id", F.array_sort(F.concat(*(F.col(f"of_{k}") for k in BASE), *added)).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each personal-data span of the text replaced by its kind in brackets; of overlapping spans the
    one that starts first. All columns stay."""
    spans, text = F.col("fm_spans"), F.col("fm_row.text")
    rows = packed(docs)
    for k, kind in enumerate(KINDS):
        rows = rows.withColumn(f"fm_{kind}", F.when(text.isNotNull(), scored(text.cast("string"), kind, k)))
    added = [F.filter(f"fm_{kind}", lambda x: x["score"] >= THRESHOLD) for kind in KINDS[4:]]
    rows = rows.withColumn("fm_spans", F.array_sort(F.concat(*(F.col(f"fm_{k}") for k in BASE), *added)))

    def step(state: Column, x: Column) -> Column:
        clear = x["start"] >= state["at"]
        return F.struct(
            F.when(clear, x["end"]).otherwise(F.greatest(state["at"], x["end"])).alias("at"),
            F.when(clear, F.concat(state["out"], F.substr(text, state["at"] + 1, x["start"] - state["at"]), F.lit("["), x["kind"], F.lit("]"))).otherwise(state["out"]).alias("out"),
        )

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    whole = F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text)))
    return rows.select(*unpacked(rows, docs.columns, text=F.when(F.size(spans) > 0, whole).otherwise(text)))
