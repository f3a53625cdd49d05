"""Surface issues of transcript lines as column expressions: a line is cut into words and what lies between, each word goes
through a table of rules, and the answers are either listed with their places or put back into the line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions import german
from parley.functions import lexicon as lx

_PIECE = f"(?U){lx.ISSUE_WORD}"


def _table(entries: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in entries.items() for x in kv))


def _small_number(w: Column) -> Column:
    """1 to 13 in digits: spelled out, with a capital at the start of a sentence."""
    plain = F.when(w["word"].rlike("^[1-9][0-9]?$"), w["word"].try_cast("int"))
    spelled = F.element_at(F.array(*(F.lit(german.full_cardinal(n)) for n in range(1, 14))), F.least(plain, F.lit(13)))
    return F.when(plain <= 13, F.when(w["opens"], F.initcap(spelled)).otherwise(spelled))


def _marker(w: Column) -> Column:
    return F.when(F.lower(w["word"]).isin("[unk]", "[unk*]"), F.lit("[unknown]"))


def _elision(w: Column) -> Column:
    """A stem, and what an apostrophe hangs on it, written out; a capital is kept.

    Stems that are imperatives too count beside "ich" only; a bare apostrophe needs a stem that is known to lose a letter."""
    low = F.lower(w["word"])
    stem, tail = F.substring_index(low, "'", 1), F.substring(low, F.instr(low, F.lit("'")) + 1, F.length(low))
    long, hung = _table(lx.ISSUE_ELISION)[stem], _table(lx.ISSUE_SUFFIX)[tail]
    joined = F.trim(F.concat_ws(" ", F.when(stem != "", F.coalesce(long, stem)), hung))
    full = F.when(~low.contains("'"), long).when(tail == "", long).when(hung.isNotNull(), joined)
    spared = low.isin(lx.ENGLISH_APOSTROPHES) | (stem.isin(lx.IMPERATIVES) & ~w["by_ich"])
    capital = w["word"].rlike(r"^\p{Lu}")
    return F.when(~spared, F.when(capital, F.concat(F.upper(F.left(full, F.lit(1))), F.substring(full, F.lit(2), F.length(full)))).otherwise(full))


#: What is put right without listening, in order of precedence: category -> suggestion for a word, or null.
RULES: dict[str, Callable[[Column], Column]] = {"digit_1_13": _small_number, "unk_marker": _marker, "elision": _elision}


#: What any of RULES can tell: other words need not be put to them.
_TOLD = r"(?iu)^(?:[1-9][0-9]?|\[unk\*?\]|(?s:.*'.*)|" + "|".join(lx.ISSUE_ELISION) + ")$"


def _cut(text: Column) -> tuple[Column, Column]:
    """(words, what lies before, between and after them): one more gap than words."""
    line = F.coalesce(text, F.lit(""))
    return F.regexp_extract_all(line, F.lit(_PIECE), F.lit(0)), F.split(line, _PIECE)


def _told(words: Column, gaps: Column) -> Column:
    """array<struct<word, category, suggestion>> over all words of a line. What stands beside a word is looked up where a rule may tell."""
    ich = lambda c: F.coalesce(F.lower(c) == "ich", F.lit(False))

    def seen(word: Column, i: Column) -> Column:
        gap = F.get(gaps, i)
        opens = gap.rlike(r"(?U)[.?!]\s*$") | ((i == 0) & gap.rlike(r"(?U)^\s*$"))
        return F.struct(word.alias("word"), (ich(F.get(words, i - 1)) | ich(F.get(words, i + 1))).alias("by_ich"), opens.alias("opens"))

    def judged(w: Column) -> Column:
        ruled = F.coalesce(*(F.when(s.isNotNull(), F.struct(F.lit(k).alias("category"), s.alias("suggestion"))) for k, s in ((k, rule(w)) for k, rule in RULES.items())))
        return F.struct(w["word"].alias("word"), ruled["category"].alias("category"), ruled["suggestion"].alias("suggestion"))

    none = F.lit(None).cast("string")
    untold = lambda word: F.struct(word.alias("word"), none.alias("category"), none.alias("suggestion"))
    return F.transform(words, lambda word, i: F.when(word.rlike(_TOLD), german.let(seen(word, i), judged)).otherwise(untold(word)))


def _listed(words: Column, gaps: Column, told: Column) -> Column:
    """array<struct<category, start, end, token, suggestion>> of the told words that have a category; places from the lengths before them."""
    numbered = F.filter(F.transform(told, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda x: x["t"]["category"].isNotNull())
    before = lambda x: F.length(F.array_join(F.slice(gaps, F.lit(1), x["i"] + 1), "")) + F.length(F.array_join(F.slice(words, F.lit(1), x["i"]), ""))
    entry = lambda x, at: F.struct(x["t"]["category"].alias("category"), at.alias("start"), (at + F.length(x["t"]["word"])).alias("end"), x["t"]["word"].alias("token"), x["t"]["suggestion"].alias("suggestion"))
    return F.transform(numbered, lambda x: entry(x, before(x)))


def issues(text: Column) -> Column:
    """All issues of a line, those of RULES first; a garbled "Videotelefonat" is only listed, as it needs listening."""
    words, gaps = _cut(text)
    pattern = f"(?iU){lx.VIDEO_GARBLE}"
    line = F.coalesce(text, F.lit(""))
    garbled = F.regexp_extract_all(line, F.lit(pattern), F.lit(0))
    as_told = F.transform(garbled, lambda g: F.struct(g.alias("word"), F.lit("video_garble").alias("category"), F.lit("Videotelefonat?").alias("suggestion")))
    cut = german.let(F.struct(words.alias("words"), gaps.alias("gaps")), lambda c: F.struct(c["words"].alias("words"), c["gaps"].alias("gaps"), _told(c["words"], c["gaps"]).alias("told")))
    ruled = german.let(cut, lambda c: _listed(c["words"], c["gaps"], c["told"]))
    return F.concat(ruled, _listed(garbled, F.split(line, pattern), as_told))


def converted(text: Column) -> Column:
    """The line with the suggestions of RULES in place; null stays null."""
    words, gaps = _cut(text)

    def put(c: Column) -> Column:
        fixed = F.concat(F.transform(_told(c["words"], c["gaps"]), lambda t: F.coalesce(t["suggestion"], t["word"])), F.array(F.lit("")))
        return F.array_join(F.zip_with(c["gaps"], fixed, lambda g, w: F.concat(g, w)), "")

    return F.when(text.isNotNull(), german.let(F.struct(words.alias("words"), gaps.alias("gaps")), put))
