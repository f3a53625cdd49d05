"""Sentences of role blocks: boundaries, gate and attributes.

A boundary depends on the last one accepted, so a block's words go through an Arrow UDF one by one; what the rules need of
the open sentence (words, brackets, finite verb, dependent clause) is kept as running state, so the work is linear. A
tagger, where there is one, is a function from words to Tags; without one, a list of frequent finite verbs and the place
next to a subject pronoun tell finite verbs, and no parser proposes boundaries.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import lexicon as lx
from parley.functions import text as tx
from parley.shared import materialize, spread

_WORD = re.compile(r"[^\W_]+")
_LIKERT = re.compile(lx.LIKERT)
_ABBREVIATION = re.compile(rf"(?:\b(?:{'|'.join(lx.ABBREVIATED)})\.|\b[dz]\s*\.\s*[bh]\.|\d\.\d)$", re.IGNORECASE)
_BOUNDARY = re.compile(lx.SENTENCE_FINAL)
_EDGES = ".,;:!?…\"'»«“”„’‘()[]{}"
#: Finite forms of frequent verbs; with the neighbours of a subject pronoun, a stand-in where no tagger is given.
_FINITE = set("bin bist ist sind seid war waren habe hast hat haben hatte hatten werde wird werden wurde wurden kann können konnte muss müssen soll sollen will wollen darf dürfen mag möchte würde würden gibt geht macht finde denke glaube weiß sage sagt kommt trifft".split())
_SUBJECTS = set("ich du er sie es wir ihr man".split())
_PERSONAL = re.compile(r"[a-zäöüß]{2,}(?:e|en|st|t)$")


class Tag(NamedTuple):
    """What a tagger says of a word. sure: finite by its form, not only by default; starts: a parser begins a sentence here."""

    pos: str = ""
    tag: str = ""
    finite: bool = False
    sure: bool = False
    starts: bool = False


def lexical_tags(words: Sequence[str]) -> list[Tag]:
    """Tags of bare words without a tagger: finite verbs only."""
    out = []
    for k, w in enumerate(words):
        before, after = words[k - 1].casefold() if k else "", words[k + 1].casefold() if k + 1 < len(words) else ""
        by_subject = _PERSONAL.match(w) and w not in _SUBJECTS and (after in _SUBJECTS or (before == "ich" and w.endswith("e")))
        finite = w.casefold() in _FINITE or bool(by_subject)
        out.append(Tag(finite=finite, sure=finite))
    return out


class _Open:
    """The sentence that is open: a few facts, brought up to date word by word."""

    def __init__(self) -> None:
        self.first = self.last = self.text = ""
        self.count, self.finite, self.clause, self.copula, self.credit = 0, False, False, False, False
        self.brackets: list[str] = []
        self.torn, self.likert = False, False
        self.recent: list[str] = []
        self.tags: list[Tag] = []

    def add(self, text: str, bare: str, tag: Tag) -> None:
        words = [w.casefold() for w in _WORD.findall(text)]
        if not self.text:
            self.credit = text.casefold().startswith(("untertitel", "©"))
        for w in words:
            self.first = self.first or w
            self.last = w
            self.recent = [*self.recent[-4:], w]
            self.copula |= w in ("bin", "bist", "ist", "sind", "war", "waren")
            self.likert |= w == "zu" and bool(_LIKERT.search(" ".join(self.recent)))
        self.count += len(words)
        self.text = text
        self.tags = [*self.tags[-1:], tag]
        for c in text:
            if c in "([{":
                self.brackets.append(c)
            elif c in ")]}":
                self.torn |= not self.brackets or self.brackets.pop() + c not in ("()", "[]", "{}")
        if bare.casefold() in lx.DEPENDENT_INITIAL:
            self.clause = True
        if tag.finite:
            self.finite, self.clause = True, False

    def bars(self) -> set[str]:
        """What speaks against an end here, by name."""
        last = self.tags[-1]
        attribute = last.tag == "ADJA" and len(self.tags) > 1 and self.tags[-2].pos == "DET" and not _BOUNDARY.search(self.text)
        hangs = not self.count or self.last in lx.UNAMBIGUOUS_INCOMPLETE_FINAL or last.pos in ("ADP", "CCONJ", "DET", "SCONJ") or attribute
        named = {
            "bracket": self.torn or bool(self.brackets),
            "hangs": hangs and not self.likert,
            "scale": hangs and self.likert,  # "trifft eher zu" ends in a word that elsewhere waits for more
            "clause": self.clause,
            "opinion": self.last in lx.PARSER_INCOMPLETE_FINAL,
            "credit": self.credit and not _BOUNDARY.search(self.text),
            "short": self.count < 4,
            "verbless": not self.finite and self.count >= 6,
            "verbless and short": not self.finite and self.count < 6,
            "joined": self.text[-1] in lx.JOINING,
        }
        return {name for name, holds in named.items() if holds}

    def asks(self, following: Tag) -> bool:
        """Only the beginning of a question, which a parser likes to cut off."""
        verbal = self.copula or self.tags[-1].pos in ("AUX", "VERB")
        return verbal and self.count <= 6 and self.first in lx.QUESTION_WORDS and following.pos in lx.QUESTION_GOES_ON


#: What keeps an end from each kind of start: one that a parser proposes, a word that may start a sentence, and one that surely does.
_KEEPS = {
    "parser": {"bracket", "hangs", "scale", "clause", "opinion", "credit"},
    "may": {"hangs", "clause", "opinion", "short", "verbless", "verbless and short", "joined"},
    "sure": {"hangs", "clause", "opinion", "short", "verbless and short", "joined"},
}


class _Start(NamedTuple):
    """A word that starts sentences: how far ahead its finite verb may be (0: it needs none), what may be next (empty: anything)."""

    reach: int
    then: frozenset[str]
    capital: bool


_STARTS = {w: _Start(4 if w in lx.VERBAL_RESTARTS else 0, frozenset(), True) for w in lx.RESTARTS}
_STARTS |= {w: _Start(reach, frozenset(then.split()), False) for words, reach, then in lx.LOWER_RESTARTS for w in words.split()}


def openings(bare: Sequence[str], tags: Sequence[Tag]) -> list[str]:
    """For each word whether it "may" start a sentence without punctuation before it, is "sure" to, or neither (""); one pass
    from the end, which knows how far ahead the next finite verb is."""
    out, verb = [""] * len(bare), len(bare) + 5
    for k in range(len(bare) - 1, -1, -1):
        s = _STARTS.get(bare[k])
        if s and (not s.reach or verb <= s.reach) and (not s.then or k + 1 < len(bare) and bare[k + 1].casefold() in s.then):
            out[k] = "sure" if s.capital and verb <= 4 else "may"
        verb = 1 if tags[k].sure else verb + 1
    return out


def split_sentences(text: str, tagger: Callable[[Sequence[str]], Sequence[Tag]] = lexical_tags) -> list[tuple[int, int]]:
    """[start, end) of each sentence of a block."""
    found = list(re.finditer(r"\S+", text or ""))
    words = [m.group() for m in found]
    bare = [w.strip(_EDGES) or w for w in words]
    tags = tagger(bare)
    opening = openings(bare, tags)
    out, start, left = [], 0, _Open()
    for k, word in enumerate(words):
        if k > start:
            if _BOUNDARY.search(words[k - 1]):
                cut = not _ABBREVIATION.search(" ".join(words[max(k - 2, 0) : k]))
            elif _ABBREVIATION.search(words[k - 1]):
                cut = False
            else:
                ways = [w for w in ("parser" if tags[k].starts and not left.asks(tags[k]) else "", opening[k]) if w]
                bars = left.bars() if ways else set()
                cut = any(not _KEEPS[w] & bars for w in ways)
            if cut:
                out.append((found[start].start(), found[k - 1].end()))
                start, left = k, _Open()
        left.add(word, bare[k], tags[k])
    if words:
        out.append((found[start].start(), found[-1].end()))
    return out


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]))


@F.arrow_udf(_SPAN)
def sentences_of(text: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
    return pa.array([[{"start": a, "end": b, "text": t[a:b]} for a, b in split_sentences(t)] for t in (x or "" for x in text.to_pylist())], kind)


def block_texts(offsets: DataFrame) -> DataFrame:
    """interview_id, role, block_idx, text from dialogue.block_offsets()."""
    return offsets.groupBy("interview_id", "role", "block_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_idx", "text"))), lambda x: x["text"]), " ").alias("text"))


def segment(offsets: DataFrame) -> DataFrame:
    """All sentences of all blocks with their gate reason and attributes; survivors have a dense index within their role.

    offsets: turns with block_idx, role_turn_idx, span_start, span_end, text (dialogue.block_offsets())."""
    keys = ["interview_id", "role", "block_idx"]
    # dear for each block, however few bytes; explode() would have them cut again, in a filter pushed below
    sents = spread(block_texts(offsets)).select(*keys, F.explode_outer(sentences_of("text")).alias("s")).where("s IS NOT NULL").select(*keys, F.col("s.start").alias("sent_start"), F.col("s.end").alias("sent_end"), tx.strip_credits(F.col("s.text")).alias("sentence"))
    pieces = offsets.select(*keys, "turn_idx", "role_turn_idx", "span_start", "span_end")
    hit = (F.col("sent_start") < F.col("span_end")) & (F.col("sent_end") > F.col("span_start"))
    by = sents.join(pieces, keys).where(hit).groupBy(*keys, "sent_start", "sent_end", "sentence").agg(
        F.min("role_turn_idx").alias("primary_turn_index_within_role"), F.array_sort(F.collect_set("turn_idx")).alias("source_turns"), (F.count(F.lit(1)) > 1).alias("cross_turn_sentence")
    )
    # written: both those that stay and those that do not are made of it
    ok = materialize(by.where(~tx.is_artifact(F.col("sentence"))).withColumn("reason", tx.gate_reason(F.col("sentence"))), "sentences")
    w = W.partitionBy("interview_id", "role").orderBy("block_idx", "sent_start")
    kept = ok.where("reason IS NULL").withColumn("sentence_index_within_role", (F.row_number().over(w) - 1).cast("long"))
    return attributes(kept).unionByName(ok.where("reason IS NOT NULL"), allowMissingColumns=True)


def attributes(sents: DataFrame, fragment: Column | None = None) -> DataFrame:
    """n_tokens, short_responsive, fragment, review_required."""
    has = F.exists(tx.words(F.col("sentence")), lambda w: w.isin(*_FINITE))
    out = sents.withColumn("n_tokens", F.size(tx.words(F.col("sentence")))).withColumn("short_responsive", tx.is_short_response(F.col("sentence"))).withColumn("fragment", ~has if fragment is None else fragment)
    return out.withColumn("review_required", F.col("cross_turn_sentence") | (F.col("fragment") & (F.col("n_tokens") >= lx.MIN_REVIEW_TOKENS)))


def reason_counts(sents: DataFrame) -> DataFrame:
    return sents.where("reason IS NOT NULL").groupBy("interview_id", "reason").agg(F.count(F.lit(1)).alias("n"))
