r"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust the score.

Everything is built-in DataFrame functions. A pattern splits a text into gaps and matches; the lengths of both give the
positions, by sums over blocks of ``BLOCK`` matches so that a text full of matches stays cheap. The patterns
carry look-behinds and possessive quantifiers that change no match but keep the time linear on very long runs.

Kinds: ``email``; ``ip`` with parts of at most 255; ``card`` with 16 to 19 digits that pass Luhn; ``phone`` with 8 to 15
digits; and, beyond these, ``iban`` that passes mod-97. An account number may end at any word boundary within 34 characters;
of the ends that pass, the one at its country's length counts, else the longest. Every possible start is tried, also within
other candidates; of spans that overlap, those at their country's length go first, then the earlier.
A span's score is its kind's base score, plus ``BONUS`` where a context word of its kind stands within ``NEAR`` characters
before it, 1 at most.

Edge cases: null and empty texts have no spans; failing matches are dropped and not retried; repeated rows give repeated
results; other columns pass through unless called ``pii``, which is replaced. Positions are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

BLOCK = 64
NEAR = 40
BONUS = 0.3
SPANS = "array<struct<kind: string, start: bigint, end: bigint, score: double>>"

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# The start of an account number and what may follow it; the start alone is consumed, so none hides another.
IBAN = r"(?<![\p{L}\p{N}_])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})"
IBAN_WHOLE = r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}"
IBAN_LEAST, IBAN_SPAN = 15, 64
# Lengths by country (ISO 13616).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}

# Kind: base score, context words.
KINDS = {
    "email": (0.8, "mail|e-mail|email|contact|write to"),
    "ip": (0.6, "ip|address|host|server|login"),
    "card": (0.7, "card|visa|credit|debit|payment|karte|carte|tarjeta"),
    "phone": (0.5, "phone|call|tel|mobile|fax|cell|whatsapp"),
    "iban": (0.9, "iban|account|bank|konto|compte|cuenta"),
}


def _sums(x: Column) -> Column:
    """The sums of every BLOCK numbers of an array."""
    some = lambda b: F.aggregate(F.slice(x, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), some)


def located(text: Column, pattern: str, body) -> Column:
    """``body(f)`` where there are matches of ``pattern``, from the left, without overlaps; an empty array of spans otherwise.

    f.m are the matches, f.gap the texts between them (one more), f.start their places: sums over blocks, and blocks of blocks, of what comes before.
    """

    def with_sums(f: Column) -> Column:
        both = F.zip_with(f["gap"], f["m"], lambda g, m: (F.length(g) + F.coalesce(F.length(m), F.lit(0))).cast("bigint"))
        return let(both, lambda x: let(_sums(x), lambda y: let(_sums(y), lambda z: body(F.struct(f["m"].alias("m"), f["gap"].alias("gap"), starts(f, x, y, z).alias("start"))))))

    def starts(f: Column, x: Column, y: Column, z: Column) -> Column:
        def start(i: Column) -> Column:
            out = F.length(F.element_at(f["gap"], i + 1)).cast("bigint")
            for sums, begin, stop in ((z, F.lit(0), F.floor(i / BLOCK**2)), (y, F.floor(i / BLOCK**2) * BLOCK, F.floor(i / BLOCK)), (x, F.floor(i / BLOCK) * BLOCK, i)):
                out = out + F.aggregate(F.slice(sums, begin.cast("int") + 1, (stop - begin).cast("int")), F.lit(0).cast("bigint"), lambda a, v: a + v)
            return out

        return F.transform(f["m"], lambda m, i: start(i))

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"))
    return let(found, lambda f: F.when(F.size(f["m"]) > 0, let(with_sums(f), lambda spans: spans)).otherwise(F.expr(f"cast(array() as {SPANS})")))


def _before(f: Column, i: Column) -> Column:
    """The NEAR characters before match i: its gap, and the matches and gaps before it, two characters each at least."""
    piece = lambda j: F.concat(F.when(j > 0, F.right(F.get(f["m"], j - 1), F.lit(NEAR))).otherwise(F.lit("")), F.right(F.get(f["gap"], j), F.lit(NEAR)))
    own = F.right(F.get(f["gap"], i), F.lit(NEAR))
    more = F.array_join(F.transform(F.sequence(F.greatest(i - NEAR // 2, F.lit(0)), i), piece), "")
    return F.when(F.length(own) == NEAR, own).otherwise(F.right(more, F.lit(NEAR)))


def _ahead(f: Column, i: Column, size: int, least: int) -> Column:
    """``size`` characters from the begin of match i on; matches have ``least`` characters or more."""
    piece = lambda j: F.concat(F.coalesce(F.get(f["m"], j), F.lit("")), F.left(F.get(f["gap"], j + 1), F.lit(size)))
    own = F.left(piece(i), F.lit(size))
    more = F.array_join(F.transform(F.sequence(i, F.least(i + size // least + 1, F.size(f["m"]) - 1)), piece), "")
    return F.when(F.length(own) == size, own).otherwise(F.left(more, F.lit(size)))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes Luhn."""
    units = F.transform(F.split(F.reverse(d), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.floor(x.cast("int") * 2 / 10).cast("int") + x.cast("int") * 2 % 10))
    return F.aggregate(F.filter(units, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number (letters and digits) passes the mod-97 check."""

    def step(a: Column, c: Column) -> Column:
        v = F.when(c.between("A", "Z"), F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return F.when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97)

    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def small_part(p: Column) -> Column:
    """Whether a string of digits of any length is at most 255."""
    return let(F.regexp_replace(p, "^0+", ""), lambda z: (F.length(z) < 3) | ((F.length(z) == 3) & (z <= "255")))


def passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), small_part)
    if kind == "card":
        return let(digits(m), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    return F.lit(True)


def country_length(iban: Column) -> Column:
    """The length of a country's account numbers; 0 for an unknown country."""
    known = F.lit(0)
    for n, countries in IBAN_LENGTHS.items():
        known = F.when(F.substr(iban, F.lit(1), F.lit(2)).isin(*countries.split()), F.lit(n)).otherwise(known)
    return known


def account_numbers(f: Column) -> Column:
    """array<struct<m, start, i>> of the account numbers that pass mod-97, by start, without overlaps, of the located begins ``f``."""

    def best(i: Column) -> Column:
        """(usual, size, m) of the best end of a candidate, null without one."""
        return let(_ahead(f, i, IBAN_SPAN + 1, 4), lambda ahead: let(F.struct(ahead.alias("ahead"), F.regexp_extract(ahead, IBAN_WHOLE, 0).alias("body")), ends))

    def ends(c: Column) -> Column:
        # A word boundary: a character of the candidate, then none of a word.
        at = F.filter(
            F.sequence(F.lit(IBAN_LEAST), F.greatest(F.length(c["body"]), F.lit(IBAN_LEAST))),
            lambda i: (F.substr(c["body"], i, F.lit(1)) != " ") & ~F.substr(c["ahead"], i + 1, F.lit(1)).rlike(r"[\p{L}\p{N}_]"),
        )
        tried = F.transform(at, lambda i: let(F.substr(c["body"], F.lit(1), i), lambda m: let(F.regexp_replace(m, " ", ""), lambda v: F.struct((F.length(v) == country_length(v)).alias("usual"), F.length(v).alias("size"), m.alias("m"), v.alias("v")))))
        return F.array_max(F.filter(tried, lambda e: F.when(e["size"] >= IBAN_LEAST, mod97(e["v"])).otherwise(F.lit(False))))

    def apart(spans: Column) -> Column:
        crossed = lambda x, y: (x["start"] < y["start"] + F.length(y["m"])) & (y["start"] < x["start"] + F.length(x["m"]))
        first = F.filter(spans, lambda x: x["usual"] | ~F.exists(spans, lambda y: y["usual"] & crossed(x, y)))
        return let(first, lambda s: F.aggregate(s, F.slice(s, F.lit(1), F.lit(0)), lambda a, x: F.when(F.exists(F.slice(a, F.greatest(F.size(a), F.lit(1)), F.lit(1)), lambda y: crossed(x, y)), a).otherwise(F.concat(a, F.array(x)))))

    found = F.transform(f["start"], lambda start, i: let(best(i), lambda b: F.struct(b["m"].alias("m"), start.alias("start"), i.alias("i"), b["usual"].alias("usual"))))
    return let(F.filter(found, lambda x: x["m"].isNotNull()), lambda s: F.when(F.size(s) > 1, apart(s)).otherwise(s))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``: array of (kind, start, end, score), by kind in the order of ``KINDS``, then by start."""
    t = F.coalesce(F.col(text), F.lit(""))
    # What a text must hold for a kind at all; cheap, and spares most texts the expensive expressions.
    digit = t.rlike("[0-9]")
    gates = {"email": F.instr(t, "@") > 0, "ip": t.rlike(r"[0-9]\.[0-9]"), "card": digit, "phone": F.instr(t, "+") > 0, "iban": t.rlike("[A-Z]{2}[0-9]{2}")}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN}
    none = F.expr(f"cast(array() as {SPANS})")

    def spans_of(kind: str) -> Column:
        score, words = KINDS[kind]

        def body(f: Column) -> Column:
            def scored(x: Column) -> Column:
                bonus = F.when(_before(f, x["i"]).rlike(rf"(?i)\b(?:{words})\b"), F.lit(BONUS)).otherwise(F.lit(0.0))
                return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end"), F.least(F.lit(1.0), F.lit(score) + bonus).alias("score"))

            every = F.transform(f["start"], lambda start, i: F.struct(F.get(f["m"], i).alias("m"), start.alias("start"), i.alias("i")))
            return F.transform(account_numbers(f) if kind == "iban" else F.filter(every, lambda x: passes(kind, x["m"])), scored)

        return F.when(gates[kind], located(t, patterns[kind], body)).otherwise(none)

    return docs.withColumn("pii", F.concat(*[spans_of(kind) for kind in KINDS]))
