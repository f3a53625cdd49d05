import random

import pytest
from pyspark.sql import functions as F

from parley.functions import arrow, german, issues
from parley.functions import text as tx
from parley.operators import asr


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t"))).first()[0]


def tokens(spark, text, variant, **more):
    return one(spark, lambda t: german.tokens(t, variant, **more), text)


def test_token_variants(spark):
    cases = {
        ("Öhm, wir gehen gehen jetzt [unk] heim.", "verbatim"): "<fil> wir gehen gehen jetzt heim",
        ("Öhm, wir gehen gehen jetzt [unk] heim.", "normalized"): "wir gehen gehen jetzt heim",
        ("wir gehen gehen jetzt", "norep"): "wir gehen jetzt",
        ("Los [laughter] [HM] weiter [noise]", "verbatim"): "los <fil> weiter",
        ("Etwa 2.300 Stück, 15 % hm", "normalized"): "etwa zweitausenddreihundert stück fünfzehn prozent",
        ("Skype-Treffen 7.", "normalized"): "skype treffen sieben",
        ("hätt ich nen Wagen", "normalized"): "hätte ich einen wagen",
        ("hätt ich nen Wagen", "verbatim"): "hätt ich nen wagen",
        ("und ver- ver- versuchen, Online- oder", "normalized"): "und versuchen online oder",
        ("und ver- versuchen", "verbatim"): "und ver versuchen",
        ("Ich find das grad erstmal okay", "normalized"): "ich finde das gerade erst mal ok",
        ("Das kostet ca. 5 €, d. h. wenig usw.", "normalized"): "das kostet circa fünf euro das heißt wenig und so weiter",
        (None, "normalized"): "",
    }
    assert {k: " ".join(tokens(spark, *k)) for k in cases} == cases
    assert tokens(spark, "8 Tage", "normalized", numbers=False) == ["8", "tage"]


def test_compounds(spark):
    words = spark.createDataFrame([(["das", "home", "office"],), (["homeoffice", "heute"],)], "words array<string>")
    learned = {r["word"]: r["parts"] for r in german.learn_compounds(words).collect()}
    assert learned == {"homeoffice": "home office"}
    assert tokens(spark, "Homeoffice", "normalized", compounds=F.create_map(F.lit("homeoffice"), F.lit("home office"))) == ["home", "office"]


def test_number_rule_agrees_with_columns(spark):
    n = [*range(0, 1300, 7), 1600, 9999, 10_000, 100_001, 999_999]
    got = spark.createDataFrame([(str(x),) for x in n], "d string").select("d", german.cardinal_column(F.col("d")).alias("w")).collect()
    assert {r["d"]: r["w"] for r in got} == {str(x): german.cardinal(x) for x in n}
    n += [1_000_000, 1_000_001, 2_300_000, 101_000_000, 1_000_000_000, 5_001_000_013, 999_999_999_999_999, 4_785_380_592_391_139, 10**20 + 1]
    got = spark.createDataFrame([(str(x),) for x in n], "d string").select("d", german.cardinal_column(F.col("d"), full=True).alias("w")).collect()
    assert {r["d"]: r["w"] for r in got} == {str(x): german.full_cardinal(x) for x in n}
    assert german.cardinal(1400) == "tausendvierhundert" and german.full_cardinal(1400) == "eintausendvierhundert"
    assert len(german.number_words()) == 10_005


def test_scores_of_a_document(spark):
    pair = spark.createDataFrame([("s", "d", "Sie haben keine Zeit, äh, zwölf Tage.", "Sie haben Zeit zwölf Tage")], "system string, doc string, ref_text string, hyp_text string")
    r = asr.score_documents(asr.alignments(pair), german.number_words()[:100]).first()
    want = {"cue_hit": 0, "cue_ref": 1, "cue_ins": 0, "num_hit": 1, "num_ref": 1, "num_ins": 0, "yn_ref": 0, "normalized_N": 6, "normalized_E": 1, "norep_E": 1, "verbatim_N": 7, "verbatim_E": 2}
    want |= {"S": 0, "D": 1, "I": 0, "hyp_N": 5, "fil_ref": 1, "fil_hit": 0, "fil_hyp": 0, "cer_E": 6, "cer_N": 31, "drop_runs": 0, "ins_runs": 0, "drop_words": 0, "ins_words": 0, "en": 0}
    assert {k: r[k] for k in want} == want


def dense(ref, hyp):
    """Steps of the alignment that a whole table gives between what both sides begin and end with, traced from its end: a
    deletion, an insertion that is cheaper than the diagonal, the diagonal."""
    head = next((k for k, (a, b) in enumerate(zip(ref, hyp)) if a != b), min(len(ref), len(hyp)))
    tail = next((k for k, (a, b) in enumerate(zip(ref[head:][::-1], hyp[head:][::-1])) if a != b), min(len(ref), len(hyp)) - head)
    inner = middle(ref[head : len(ref) - tail], hyp[head : len(hyp) - tail])
    return [("equal", k, k) for k in range(head)] + [(op, i + head, j + head) for op, i, j in inner] + [("equal", len(ref) - tail + k, len(hyp) - tail + k) for k in range(tail)]


def middle(ref, hyp):
    cost = [[i + j if not i or not j else 0 for j in range(len(hyp) + 1)] for i in range(len(ref) + 1)]
    for i, a in enumerate(ref, 1):
        for j, b in enumerate(hyp, 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (a != b), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    i, j, steps = len(ref), len(hyp), []
    while i or j:
        if i and (not j or cost[i][j] == cost[i - 1][j] + 1):
            i -= 1
            steps.append(("delete", i, j))
        elif not i or cost[i][j - 1] < cost[i - 1][j - 1]:
            j -= 1
            steps.append(("insert", i, j))
        else:
            i, j = i - 1, j - 1
            steps.append(("equal" if ref[i] == hyp[j] else "substitute", i, j))
    return steps[::-1]


def test_alignment_equals_a_dense_table():
    rng = random.Random(6)
    pairs = [("", ""), ("", "ab"), ("abc", ""), ("a" * 40, "b" * 5)]
    for _ in range(150):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        b = [rng.choice("abcd") if rng.random() < 0.2 else x for x in a if rng.random() > 0.15] if rng.random() < 0.7 else [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        pairs.append((a, b))
    for a, b in pairs:
        flat = [(op, rs + k if op != "insert" else rs, hs + k if op != "delete" else hs) for op, rs, re_, hs, he in arrow.edit_ops(a, b) for k in range(max(re_ - rs, he - hs))]
        assert flat == dense(a, b), (a, b)
        runs = [x[0] for x in arrow.edit_ops(a, b)]
        assert all(x != y for x, y in zip(runs, runs[1:]))


def test_long_alignments_keep_to_a_band():
    a = [str(i % 997) for i in range(30_000)]
    b = a[:100] + ["x"] + a[101:20_000] + a[20_003:]
    assert [x for x in arrow.edit_ops(a, b) if x[0] != "equal"] == [("substitute", 100, 101, 100, 101), ("delete", 20_000, 20_003, 20_000, 20_000)]


def test_alignment_counts_equal_levenshtein(spark):
    rows = [("a b c d", "a x c"), ("", "a b"), ("a b", ""), ("", ""), ("x y z x", "y z x x q"), ("a a a", "a")]
    df = spark.createDataFrame(rows, "r string, h string").select(tx.whitespace_tokens(F.col("r")).alias("r"), tx.whitespace_tokens(F.col("h")).alias("h"))
    for x in df.select(asr.word_errors(F.col("r"), F.col("h")).alias("e"), arrow.word_chunks("r", "h").alias("c"), "r", "h").collect():
        assert sum(max(c["re"] - c["rs"], c["he"] - c["hs"]) for c in x["c"] if c["op"] != "equal") == x["e"], x


def test_issues(spark):
    line = "Komm doch, ich komm 2.000 und 4 hätt in'm That's Videotelephon"
    found = one(spark, issues.issues, line)
    assert [(x["category"], x["token"], x["suggestion"]) for x in found] == [("elision", "komm", "komme"), ("digit_1_13", "4", "vier"), ("elision", "hätt", "hätte"), ("elision", "in'm", "in dem"), ("video_garble", "Videotelephon", "Videotelefonat?")]
    assert all(line[x["start"] : x["end"]] == x["token"] for x in found)
    assert one(spark, issues.issues, None) == [] and one(spark, issues.issues, " 😀 ") == []
    assert [x["start"] for x in one(spark, issues.issues, "😀 3 Eis")] == [2]
    fixed = {
        "5. Geht's gut? 11 Boys' Nights, [unk] 07 Uhr, ich mach' 3 ne'n.": "Fünf. Geht es gut? Elf Boys' Nights, [unknown] 07 Uhr, ich mache drei ne'n.",
        "  13 mal, 14 mal": "  Dreizehn mal, 14 mal",
        "Wär's so!\n2 [UNK*]": "Wäre es so!\nZwei [unknown]",
        "'s ist 1 Test": "es ist eins Test",
        "": "",
    }
    got = spark.createDataFrame([(k,) for k in fixed], "t string").select("t", issues.converted(F.col("t")).alias("c")).collect()
    assert {r["t"]: r["c"] for r in got} == fixed
    assert one(spark, issues.converted, None) is None


def test_leaderboard_words_and_joined_compounds(spark):
    cases = {"Öh, 3.250 Leute (lacht) [unknown] Skype-Chat": "öh dreitausendzweihundertfünfzig leute skype chat", "ﬁn b2b 1.100 <x> 2 000 2000000": "fin bzweib eintausendeinhundert zweitausend zwei Millionen", None: "", "(leise)": ""}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", F.array_join(german.board_words(F.col("t")), " ").alias("b")).collect()
    assert {r["t"]: r["b"] for r in got} == cases
    assert arrow.joined_where_equal("unser team meeting".split(), "unser teammeeting ja".split()) == (["unser", "team", "meeting"], ["unser", "teammeeting", "ja"])
    assert arrow.joined_where_equal("unser team meeting ja".split(), "unser teammeeting ja".split()) == (["unser", "teammeeting", "ja"],) * 2
    assert arrow.joined_where_equal([], ["a"]) == ([], ["a"]) and arrow.joined_where_equal([], []) == ([], [])


def test_gate_reasons(spark):
    cases = {
        "Wir sind (fertig.": "unbalanced_brackets",
        "Nein.": "too_few_words",
        "wir sind fertig.": "lowercase_sentence_start",
        "Wir sind fertig...": "truncated_ellipsis",
        "Wir sind fertig": "missing_terminal_punctuation",
        "Sie kommt oder.": "incomplete_final_syntax",
        "Er kam denn.": "incomplete_final_syntax",
        "Es war " + "sehr " * 120 + "gut.": "overlong_sentence",
        "Trifft gar nicht zu.": None,
        "„Wir sind fertig.”": None,
        "Es ist ([so]).": None,
        "Es ist ([so)].": "unbalanced_brackets",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tx.gate_reason(F.col("t")).alias("r"))
    assert {r["t"]: r["r"] for r in df.collect()} == cases


TAGGED = "array<struct<text: string, pos: string, tag: string, verb_form: array<string>>>"


def tagged(words):
    """word/POS/tag/form, the latter two optional."""
    parts = [(w.split("/") + [None, None])[:4] for w in words.split()]
    return [(t, p, g, f.split("|") if f else []) for t, p, g, f in parts]


@pytest.mark.parametrize(
    ("text", "words", "reason"),
    [
        ("Sie Ruhe in einem Raum mit Licht?", "Sie/PRON Ruhe/NOUN in/ADP einem/DET Raum/NOUN mit/ADP Licht/NOUN", "leading_question_fragment"),
        ("Sie haben das gelesen?", "Sie/PRON haben/AUX/VAFIN/Fin das/PRON gelesen/VERB/VVPP/Part", None),
        ("Hier steht ein Tisch, an dem.", "Hier/ADV steht/VERB/VVFIN/Fin ein/DET Tisch/NOUN an/ADP dem/PRON", "incomplete_final_syntax"),
        ("Wir kommen morgen mit.", "Wir/PRON kommen/VERB/VVFIN/Fin morgen/ADV mit/ADP/PTKVZ", "incomplete_final_syntax"),
        ("Wir holen es ab.", "Wir/PRON holen/VERB/VVFIN/Fin es/PRON ab/ADP/PTKVZ", "incomplete_final_syntax"),
        ("Wir holen es bald.", "Wir/PRON holen/VERB/VVFIN/Fin es/PRON bald/ADV", None),
    ],
)
def test_gate_reasons_of_a_tagger(spark, text, words, reason):
    df = spark.createDataFrame([(text, tagged(words))], f"t string, w {TAGGED}")
    assert df.select(tx.gate_reason(F.col("t"), F.col("w"))).first()[0] == reason


def test_syntax_columns(spark):
    rows = [("wenn er kommt/x", "wenn/SCONJ er/PRON kommt/VERB/VVFIN/Fin"), ("wenn er", "wenn/SCONJ er/PRON"), ("gehen", "gehen/VERB/VVINF/Inf"), ("geht", "geht/VERB"), ("Haus", "Haus/NOUN")]
    df = spark.createDataFrame([(t, tagged(w)) for t, w in rows], f"t string, w {TAGGED}")
    got = {r["t"]: tuple(r)[1:] for r in df.select("t", tx.has_finite_verb(F.col("w")).alias("a"), tx.has_finite_verb(F.col("w"), explicit=True).alias("b"), tx.unresolved_clause(F.col("w")).alias("c")).collect()}
    assert got == {"wenn er kommt/x": (True, True, False), "wenn er": (False, False, True), "gehen": (False, False, False), "geht": (True, False, False), "Haus": (False, False, False)}


def test_text_scalars(spark):
    assert one(spark, tx.alignment_text, "Etwa vier [unk] !") == "Etwa vier!"
    assert one(spark, tx.strip_credits, "Untertitel des ZDF, 2019 Untertitelung Jetzt los.") == "Jetzt los."
    assert one(spark, tx.is_artifact, "Untertitelung, 1999") is True
    assert one(spark, tx.is_artifact, "[Musik]") is True and one(spark, tx.is_artifact, "Musik an") is False
    assert one(spark, tx.squeeze, None) == ""
    assert one(spark, tx.parser_form, "»Baum«") == "Baum" and one(spark, tx.parser_form, "...") == "..."
    assert one(spark, tx.cue_word, '"Kein!"') == "kein"
    assert one(spark, tx.join_fragments, ["So", "!", "  ", "dann", "?"], "array<string>") == "So! dann?"


def test_list_columns(spark):
    df = spark.createDataFrame([(["Ja", "nicht", "so"], [0, 1, 0], [1, 1, 0], ["so", "x"])], "t array<string>, c array<int>, s array<int>, u array<string>")
    r = df.select(tx.mask_cues(F.col("t"), F.col("c"), "[CUE]").alias("m"), tx.scope_without_cues(F.col("s"), F.col("c")).alias("s"), tx.append_unique(F.col("t"), F.col("u")).alias("a"), tx.with_word_spaces(F.col("t"), ["nicht"]).alias("w")).first()
    assert tuple(r) == (["Ja", "[CUE]", "so"], [1, 0, 0], ["Ja", "nicht", "so", "x"], ["Ja", "nicht", " so"])
    ids = spark.createDataFrame([("10",), ("b",), ("9",), ("a",)], "i string")
    assert [x["i"] for x in ids.orderBy(tx.id_order(F.col("i"))).collect()] == ["9", "10", "a", "b"]
    two = [spark.createDataFrame(rows, "a int, b string").agg(tx.stable_hash(F.collect_list(F.struct("a", "b")))).first()[0] for rows in ([(1, "x"), (2, None)], [(2, None), (1, "x")])]
    assert two[0] == two[1] and len(two[0]) == 64


def test_tree_depths_and_uuid():
    assert arrow.longest_depths([5, 5, 6], [6, 7, 7]) == {5: 0, 6: 1, 7: 2}
    assert arrow.item_uuid(7, "Interviewer", 3, "Gut, SO!") == arrow.item_uuid(7, "Interviewer", 3, "gut so") != arrow.item_uuid(7, "Interviewer", 4, "gut so")
