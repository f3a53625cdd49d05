"""Text cleaning and the sentence gate as column expressions. Java's (?U) makes classes Unicode-aware, as the lists need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions import lexicon as lx


def squeeze(text: Column) -> Column:
    """White space collapsed and trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and numbers of any kind; Java's \\w would add marks and joiners, and leave out ² and the like."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def similarity_form(text: Column) -> Column:
    """Case- and punctuation-insensitive form; functions.arrow.nfkc_form has full compatibility folding."""
    return F.array_join(words(text), " ")


def whitespace_tokens(text: Column) -> Column:
    t = squeeze(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def ends_sentence(text: Column) -> Column:
    return F.rtrim(text).rlike(lx.SENTENCE_FINAL)


def starts_with_capital(text: Column) -> Column:
    return F.trim(text).rlike("^[" + "".join("\\" + c if c in "[-" else c for c in lx.OPENING) + r"]*\p{Lu}")


def is_short_response(text: Column) -> Column:
    w = words(text)
    return F.size(w).between(1, 2) & F.try_element_at(w, F.lit(1)).isin(lx.SHORT_RESPONSES)


def is_backchannel(text: Column) -> Column:
    return F.array_join(words(text), " ").isin(lx.BACKCHANNELS)


def is_likert(text: Column) -> Column:
    return F.array_join(words(text), " ").rlike("(?U)" + lx.LIKERT)


def strip_credits(text: Column) -> Column:
    """Without the subtitle credits at its start, however many."""
    return F.trim(F.regexp_replace(squeeze(text), rf"(?iU)^(?:{lx.CREDIT}[,.!]?\s*)+", ""))


def is_artifact(text: Column) -> Column:
    t = squeeze(text)
    out = ~t.rlike(r"(?U)[\p{L}\p{N}]")
    for p in lx.ARTIFACTS:
        out = out | t.rlike(rf"(?U)^(?:{p})$")
    return out


def brackets_balanced(text: Column) -> Column:
    """A fold with the open brackets as a string; once wrong, it stays wrong."""
    only = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\[\](){}]", ""), "")

    def step(stack: Column, c: Column) -> Column:
        match = (F.right(stack, F.lit(1)) == F.when(c == ")", "(").when(c == "]", "[").otherwise("{"))
        return F.when((c == "") | (stack == "!"), stack).when(c.isin("(", "[", "{"), F.concat(stack, c)).when(match, F.substring(stack, F.lit(1), F.length(stack) - 1)).otherwise("!")

    return F.aggregate(only, F.lit(""), step) == ""


def incomplete_end(text: Column, last_pos: Column | None = None, before_pos: Column | None = None, last_tag: Column | None = None) -> Column:
    """The sentence stops short: by its last word, or by a tagger's columns where there are any."""
    w = words(text)
    out = (F.size(w) == 0) | F.try_element_at(w, F.lit(-1)).isin(lx.UNAMBIGUOUS_INCOMPLETE_FINAL)
    if last_pos is not None:
        out = out | last_pos.isin("ADP", "CCONJ", "DET", "SCONJ")
        if before_pos is not None and last_tag is not None:
            out = out | ((before_pos == "DET") & (last_tag == "ADJA") & ~ends_sentence(text))
    return F.coalesce(out, F.lit(False))


def has_finite_verb(tokens: Column, explicit: bool = False) -> Column:
    """tokens: array<struct<pos, verb_form>> of a tagger; without a form, a verb counts unless explicit."""
    form = lambda t: F.coalesce(F.array_contains(t["verb_form"], "Fin"), F.lit(False))
    none = lambda t: t["verb_form"].isNull() | (F.size(t["verb_form"]) == 0)
    return F.exists(tokens, lambda t: t["pos"].isin("VERB", "AUX") & (form(t) if explicit else form(t) | none(t)))


def unresolved_clause(tokens: Column) -> Column:
    """tokens: array<struct<text, pos, verb_form>>; a dependent opener that no finite verb follows."""
    after = lambda i: F.slice(tokens, i + 2, F.size(tokens))
    return F.exists(F.transform(tokens, lambda t, i: F.lower(t["text"]).isin(lx.DEPENDENT_INITIAL) & ~has_finite_verb(after(i))), lambda x: x)


def gate_reason(text: Column, tokens: Column | None = None) -> Column:
    """The first reason that keeps a sentence out, or null. tokens (a tagger's) add the syntactic reasons."""
    w = words(text)
    n, last, first = F.size(w), F.try_element_at(w, F.lit(-1)), F.try_element_at(w, F.lit(1))
    pos = (lambda k: F.try_element_at(tokens, F.lit(k))) if tokens is not None else None
    short = incomplete_end(text, pos(-1)["pos"], pos(-2)["pos"], pos(-1)["tag"]) if pos else incomplete_end(text)
    out = (
        F.when(~brackets_balanced(text), "unbalanced_brackets")
        .when(n < lx.MIN_SENTENCE_TOKENS, "too_few_words")
        .when(~starts_with_capital(text), "lowercase_sentence_start")
        .when(F.rtrim(text).endswith("...") | F.rtrim(text).endswith("…"), "truncated_ellipsis")
        .when(~ends_sentence(text), "missing_terminal_punctuation")
        .when(n > lx.MAX_SENTENCE_TOKENS, "overlong_sentence")
        .when(short & ~is_likert(text), "incomplete_final_syntax")
        .when(last.isin("also", "denn"), "incomplete_final_syntax")
    )
    if tokens is not None:
        out = out.when((first == "sie") & ~has_finite_verb(F.slice(tokens, 2, 3), explicit=True), "leading_question_fragment")
    return out


def join_fragments(parts: Column) -> Column:
    """Fragments joined by a space, but for closing punctuation."""
    def step(acc: Column, p: Column) -> Column:
        t = squeeze(p)
        return F.when(t == "", acc).when(acc == "", t).when(t.rlike(r"^[,.;:!?…)\]}»”’]"), F.concat(acc, t)).otherwise(F.concat_ws(" ", acc, t))

    return F.aggregate(parts, F.lit(""), step)


def alignment_text(text: Column) -> Column:
    """For forced alignment: tags out, spaces collapsed, none before punctuation."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[[^\]]*\]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), r" ([,.;:!?])", "$1"))


def parser_form(word: Column) -> Column:
    """Without edge punctuation, unless nothing is left."""
    bare = F.regexp_replace(word, r"(?U)^[^\w]+|[^\w]+$", "")
    return F.when(bare == "", word).otherwise(bare)


def cue_word(word: Column) -> Column:
    return F.btrim(F.lower(word), F.lit(".,;:!?\"'"))


def append_unique(a: Column, b: Column) -> Column:
    """Both lists, first occurrences in order."""
    return F.array_distinct(F.concat(a, b))


def with_word_spaces(ws: Column, special: list[str]) -> Column:
    """A space before each word but the first and special tokens."""
    return F.transform(ws, lambda w, i: F.when((i == 0) | w.isin(special), w).otherwise(F.concat(F.lit(" "), w)))


def mask_cues(tokens: Column, cues: Column, special: str | None) -> Column:
    """Cue tokens replaced by the special token (null: scope masks with cue positions off, given as tokens)."""
    return F.zip_with(tokens, cues, lambda t, c: F.when(c == 1, F.lit(special)).otherwise(t))


def scope_without_cues(scope: Column, cues: Column) -> Column:
    return F.zip_with(scope, cues, lambda s, c: F.when(c == 1, F.lit(0)).otherwise(s))


def id_order(value: Column) -> Column:
    """Numbers first by value, then other ids by their JSON text: for orderBy."""
    number = value.try_cast("double")
    return F.struct(number.isNull().alias("other"), number.alias("number"), value.cast("string").alias("text"))


def stable_hash(parts: Column) -> Column:
    """SHA-256 of rows' JSON in sorted order: the same for the same rows, whatever their order."""
    return F.sha2(F.to_json(F.array_sort(parts)), 256)
