"""German transcript normalisation as column expressions, and a rule for cardinal numbers."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import lexicon as lx

FIL = "<fil>"
_ONES = "null ein zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn".split()
_TENS = "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split()


_LARGE = ((10**18, "eine Trillion", "Trillionen"), (10**15, "eine Billiarde", "Billiarden"), (10**12, "eine Billion", "Billionen"), (10**9, "eine Milliarde", "Milliarden"), (10**6, "eine Million", "Millionen"))


def cardinal(n: int) -> str:
    """The German cardinal as transcribers write it ("hundert", not "einhundert")."""
    return re.sub("^ein(?=hundert|tausend)", "", full_cardinal(n))


def full_cardinal(n: int) -> str:
    if n < 0:
        return f"minus {full_cardinal(-n)}"
    return "eins" if n == 1 else _below_million(n) if n < 10**6 else _millions(n)


def _below_million(n: int) -> str:
    head, rest = divmod(n, 1000)
    out = f"{_below_thousand(head)}tausend" if head else ""
    if rest or not n:
        out += "eins" if rest == 1 else _below_thousand(rest)
    return out


def _below_thousand(n: int) -> str:
    head, rest = divmod(n, 100)
    out = f"{_ONES[head]}hundert" if head else ""
    if not rest and head:
        return out
    if rest == 1 and head:
        return out + "eins"
    if rest < 20:
        return out + _ONES[rest]
    ten, one = divmod(rest, 10)
    return out + (f"{_ONES[one]}und" if one else "") + _TENS[ten - 2]


def _millions(n: int) -> str:
    for size, one, many in _LARGE:
        head, rest = divmod(n, size)
        if head:
            first = one if head == 1 else f"{full_cardinal(head)} {many}"
            return first if not rest else f"{first} {full_cardinal(rest)}"
    return _below_million(n)


def number_words() -> list[str]:
    return [*(cardinal(i) for i in range(10_000)), *lx.NUMBER_EXTRAS]


def cardinal_column(digits: Column, full: bool = False) -> Column:
    """cardinal() of a string of digits below a million, as built-in functions: no look-up table, no UDF.

    full: full_cardinal(), to below 10**21. Larger numbers stay as they are."""
    ones = F.array(*map(F.lit, _ONES))
    tens = F.array(*map(F.lit, _TENS))
    at = lambda a, i: F.element_at(a, (i + 1).cast("int"))

    def below_hundred(n: Column) -> Column:
        one, ten = n % 10, F.floor(n / 10)
        return F.when(n < 20, at(ones, F.least(n, F.lit(19)))).otherwise(F.concat(F.when(one > 0, F.concat(at(ones, one), F.lit("und"))).otherwise(""), at(tens, F.greatest(ten - 2, F.lit(0)))))

    def below_thousand(n: Column, end: bool) -> Column:
        head, rest = F.floor(n / 100), n % 100
        tail = F.when(rest == 0, "").when((rest == 1) & F.lit(end), "eins").otherwise(below_hundred(rest))
        return F.concat(F.when(head > 0, F.concat(at(ones, head), F.lit("hundert"))).otherwise(""), tail)

    def below_million(n: Column) -> Column:
        head, rest = F.floor(n / 1000), n % 1000
        return F.concat(F.when(head > 0, F.concat(below_thousand(head, False), F.lit("tausend"))).otherwise(""), below_thousand(rest, True))

    n = digits.try_cast("long")
    if not full:
        out = F.regexp_replace(F.when(n == 0, "null").otherwise(below_million(n)), "^ein(?=hundert|tausend)", "")
        return F.when(n.isNull() | (n >= 10**6), digits).otherwise(out)
    bare = F.ltrim(digits, F.lit("0"))
    three = lambda k: F.substring(F.lpad(bare, 21, "0"), 3 * k + 1, 3).try_cast("int")
    large = [F.when(three(k) == 1, one).when(three(k) > 1, F.concat(below_thousand(three(k), True), F.lit(f" {many}"))) for k, (_, one, many) in enumerate(_LARGE)]
    rest = F.substring(F.lpad(bare, 21, "0"), 16, 6).try_cast("int")
    out = F.concat_ws(" ", *large, F.when(rest > 0, below_million(rest)))
    return F.when(F.length(bare) > 21, digits).when(bare == "", "null").otherwise(out)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _mapped(tokens: Column, table: dict[str, str]) -> Column:
    """Each token through a table that may give several words; tokens without an entry in the table are not touched."""
    if not table:
        return tokens
    m = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return let(tokens, lambda ts: F.when(F.arrays_overlap(ts, F.array(*map(F.lit, table))), F.flatten(F.transform(ts, lambda t: F.split(F.coalesce(m[t], t), " ")))).otherwise(ts))


#: Where none of these is found, no step for figures, abbreviations or fillers has anything to do.
_DIGIT = r"\p{Nd}"
_SHORT = "(?U)" + "|".join(p for p, _ in lx.ABBREVIATIONS)
_MAY_FILL = r"(?<!\p{L})[äöehmuÄÖEHMU]+(?!\p{L})"


def _replaced(t: Column, able: Callable[[Column], Column], *steps: tuple[str, str]) -> Column:
    """The replacements in turn, where able() says that there may be one."""

    def all_of(x: Column) -> Column:
        for p, r in steps:
            x = F.regexp_replace(x, p, r)
        return x

    return let(t, lambda x: F.when(able(x), all_of(x)).otherwise(x))


def raw_words(text: Column, numbers: bool = True, tags: bool = True, spelling: bool = True) -> Column:
    """Lower-cased words with fillers as <fil>, other tags dropped, symbols, abbreviations and digits spelled out."""
    marks = [(f"(?i){lx.UNKNOWN_TAG}", " "), *([(f"(?iU){lx.FILLER_TAG}", f" {FIL} "), (r"\[[^\]]*\]", " ")] if tags else [])]
    t = F.lower(_replaced(F.coalesce(text, F.lit("")), lambda x: x.contains("["), *marks))
    t = _replaced(t, lambda x: x.rlike(_DIGIT), (r"(?U)(\d)\.(\d{3})\b", "$1$2"), (r"(\d),(\d)", "$1 komma $2"), (r"(?U)(\d)\s*%", "$1 prozent"))
    t = _replaced(F.replace(t, F.lit("€"), F.lit(" euro ")), lambda x: x.rlike(_SHORT), *((f"(?U){p}", r) for p, r in lx.ABBREVIATIONS))
    found = lambda x: F.regexp_extract_all(x, F.lit(rf"(?U){FIL}|\d+|[^\W\d_]+"), F.lit(0))
    spelled = lambda x: F.transform(found(x), lambda w: F.when(w.rlike("^[0-9]+$"), cardinal_column(w)).otherwise(w))
    toks = let(t, lambda x: F.when(x.rlike("[0-9]"), spelled(x)).otherwise(found(x))) if numbers else found(t)
    return _mapped(toks, lx.SPELLING) if spelling else toks


def tokens(text: Column, variant: str = "normalized", compounds: Column | None = None, elision: bool = True, fragments: bool = True, **steps: bool) -> Column:
    """verbatim keeps fillers; normalized drops them and word fragments and writes elisions out; norep also drops repeats.

    compounds: a map column word -> its two parts joined by a space, learned from the data."""
    whole = text
    if variant != "verbatim" and fragments:
        text = _replaced(text, lambda x: x.contains("-"), (f"(?U){lx.FRAGMENT}", " "))
    out = raw_words(text, **steps)
    if compounds is not None:
        out = F.flatten(F.transform(out, lambda t: F.split(F.coalesce(compounds[t], t), " ")))
    fill = lambda ts: F.transform(ts, lambda t: F.when(t.rlike(lx.FILLER), FIL).otherwise(t))
    out = fill(out) if compounds is not None else let(out, lambda ts: F.when(whole.rlike(_MAY_FILL), fill(ts)).otherwise(ts))
    if variant == "verbatim":
        return out
    out = F.array_remove(out, FIL)
    out = _mapped(out, lx.ELISION) if elision else out
    return without_repeats(out) if variant == "norep" else out


def without_repeats(toks: Column) -> Column:
    return let(toks, lambda ts: F.filter(ts, lambda t, i: t.isNotNull() & ~t.eqNullSafe(F.get(ts, i - 1))))


def board_words(text: Column) -> Column:
    """Words by the public leaderboard's rule: tags and bracketed asides out, compatibility forms folded, symbols as spaces,
    thousands joined and numbers spelled out."""
    from parley.functions.arrow import nfkc

    t = F.lower(F.coalesce(text, F.lit("")))
    t = _replaced(t, lambda x: x.rlike(r"[<\[(]"), (r"[<\[][^>\]]*[>\]]", ""), (r"\([^)]+\)", ""))
    t = F.regexp_replace(F.regexp_replace(F.lower(nfkc(t)), r"[\p{S}\p{P}]", " "), r"(?U)[^\w\s]", "")
    t = F.regexp_replace(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")), r"(?U)(\d) (\d{3})\b", "$1$2")
    runs = lambda x: F.regexp_extract_all(x, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    spelled = lambda x: F.array_join(F.transform(runs(x), lambda r: F.when(r.rlike("^[0-9]"), cardinal_column(r, full=True)).otherwise(r)), "")
    return F.filter(F.split(let(t, lambda x: F.when(x.rlike("[0-9]"), spelled(x)).otherwise(x)), " "), lambda x: x != "")


def learn_compounds(words_of: DataFrame, words_col: str = "words", least: int = 8) -> DataFrame:
    """word, parts: closed compounds that the corpus also writes open, split at the first place that occurs as a bigram.

    words_of: one array of words per text. Bigrams and candidate splits meet in an equi-join; nothing is broadcast
    unless it is small."""
    w = F.col(words_col)
    pairs = words_of.where(F.size(w) > 1).select(F.explode_outer(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.struct(F.element_at(w, i).alias("a"), F.element_at(w, i + 1).alias("b")))).alias("p"))
    bigrams = pairs.select("p.a", "p.b").distinct()
    long = words_of.select(F.explode(w).alias("word")).where(F.length("word") >= least).distinct()
    cut = long.select("word", F.explode(F.sequence(F.lit(2), F.length("word") - 2)).alias("i"))
    cut = cut.select("word", "i", F.substring("word", F.lit(1), F.col("i")).alias("a"), F.substring("word", F.col("i") + 1, F.length("word")).alias("b"))
    return cut.join(bigrams, ["a", "b"]).groupBy("word").agg(F.min_by(F.concat_ws(" ", "a", "b"), "i").alias("parts"))
