"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

A span's score is in whole hundredths: what its kind's form is worth, what a checksum adds, what a context word nearby adds.
Kinds with a fixed contract (email, ip, card, phone) stand at any score; the method adds spans of other kinds that reach
NEEDED: IBANs (unbroken, or printed in groups of four) that pass mod-97, and card numbers of 13 to 15 digits that pass
Luhn, whose weaker form needs a card word nearby. Built-in functions only.

Defined cases: a null text counts as empty; a long text is read whole (every pattern is linear in it: possessive, and
not tried again inside a run that failed). Rows are independent, so repeated rows and ids do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm._common import documents
from parley.llm.spans import listed, spans

# Fixed values of the contract, each written so that Java's engine reads a run once.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
#: Only runs that can have enough digits; a run is taken whole either way.
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"
#: In groups of four; a shorter group may come last.
GROUPED = r"[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3}(?![A-Za-z0-9_]))?"
SHORT_CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"

#: Words that speak for a kind when they stand within WINDOW code points of the span.
CONTEXT = {
    "email": "mail|contact|kontakt|correo|courriel",
    "ip": "host|server|address|login|adresse",
    "card": "card|visa|amex|mastercard|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|telefon|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
WINDOW = 40
#: In hundredths: what a kind's form is worth (with its checksum, where it has one), what a context word adds, and what an added kind needs.
WORTH = {"email": 70, "ip": 40, "card": 70, "phone": 40, "iban": 80, "grouped_iban": 80, "short_card": 70}
NEARBY, NEEDED = 20, 80
#: The kind whose context words count.
WORDS_OF = {"grouped_iban": "iban", "short_card": "card"}
BASE = ("email", "ip", "card", "phone")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 modulo 97."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c < 58, rest * 10 + c - 48).otherwise(rest * 100 + c - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def _near(text: Column, s: Column, kind: str) -> Column:
    """Whether a context word of the kind is nearby."""
    around = F.concat_ws(" ", F.substring(text, F.greatest(s["start"] - WINDOW + 1, F.lit(1)), F.least(s["start"], F.lit(WINDOW))), F.substring(text, s["end"] + 1, F.lit(WINDOW)))
    return around.rlike(f"(?i)({CONTEXT[kind]})")


def _alone(text: Column, s: Column) -> Column:
    """Whether no ASCII letter or digit touches the span."""
    before = F.when(s["start"] > 0, F.substring(text, s["start"], F.lit(1))).otherwise("")
    return ~F.concat(before, F.lit(" "), F.substring(text, s["end"] + 1, F.lit(1))).rlike("[A-Za-z0-9]")


def found(text: Column) -> dict[str, Column]:
    """Spans of each kind, the contract's four first."""
    digits = lambda s: F.regexp_replace(s["value"], "[^0-9]", "")
    parts = lambda s: F.split(s["value"], r"\.")
    has_digit = text.rlike("[0-9]")
    card = F.filter(spans(text, CARD, has_digit), lambda s: F.length(digits(s)).between(16, 19) & luhn(digits(s)))
    small = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3  # noqa: E731  so that the cast cannot overflow
    ip = F.filter(spans(text, IP, has_digit), lambda s: F.forall(parts(s), lambda p: small(p) & (F.when(small(p), p.cast("int")).otherwise(256) <= 255)))
    joined = lambda s: F.replace(s["value"], F.lit(" "), F.lit(""))
    added = {
        "iban": F.filter(spans(text, IBAN, has_digit), lambda s: _alone(text, s) & mod97(s["value"])),
        "grouped_iban": F.filter(spans(text, GROUPED, has_digit), lambda s: _alone(text, s) & F.length(joined(s)).between(15, 34) & mod97(joined(s))),
        # a short number passes Luhn once in ten: its form alone is not enough
        "short_card": F.filter(spans(text, SHORT_CARD, has_digit), lambda s: F.length(digits(s)).between(13, 15) & _alone(text, s) & luhn(digits(s))),
    }
    phone = F.filter(spans(text, PHONE, text.contains("+")), lambda s: F.length(digits(s)).between(8, 15))
    out = {"email": spans(text, EMAIL, text.contains("@")), "ip": ip, "card": card, "phone": phone}
    with_score = lambda k: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), _score(text, s, k).alias("score"))
    out = {k: F.transform(c, with_score(k)) for k, c in (out | added).items()}
    return out | {k: F.filter(out[k], lambda s: s["score"] >= NEEDED) for k in added}


def _score(text: Column, s: Column, kind: str) -> Column:
    return F.lit(WORTH[kind]) + F.when(_near(text, s, WORDS_OF.get(kind, kind)), NEARBY).otherwise(0)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and one array of spans (start, end, value, score) for each kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents(docs, id_col, text_col).select("doc_id", *(c.alias(k) for k, c in found(text).items()))


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kind, start, end, value, score: one row for each span."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = lambda k: lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["score"].alias("score"))
    return documents(docs, id_col, text_col).select("doc_id", F.inline(F.concat(*(F.transform(c, named(k)) for k, c in found(text).items()))))


def redact(docs: DataFrame, mask: str = "<{}>", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with each span of the contract's kinds and of the added ones replaced by its kind's mask.

    Spans of different kinds may overlap; the one that starts first (then the longer one) is replaced."""
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = documents(docs, id_col, text_col)
    kinds = found(text)
    of = lambda k, c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), F.lit(mask.format(k)).alias("mask")))
    every = F.array_sort(F.concat(*(of(k, c) for k, c in kinds.items())))
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    step = lambda acc, s: F.when(s["start"] < acc["pos"], acc).otherwise(F.struct((-s["neg"]).alias("pos"), F.concat(acc["out"], F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), s["mask"]).alias("out")))
    done = F.aggregate(every, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
    return raw.select("doc_id", done.alias("text"))


def digest(rows: DataFrame) -> DataFrame:
    """The contract's columns from what find_pii() returns, and the scores of all spans in their order."""
    every = [(k, F.col(k)) for k in WORTH]
    return rows.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(listed(every[:4]), 256).alias("base_sha256"),
        listed(every).alias("spans"),
        F.array_join(F.concat(*(F.transform(k, lambda s: s["score"].cast("string")) for k in WORTH)), ",").alias("scores"),
    )
