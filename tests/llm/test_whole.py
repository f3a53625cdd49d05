"""Rows that a bound or a missing id must not lose."""

from parley.llm import chat, decontaminate, exact_dedup, langid, pii


def test_items_without_an_id_contaminate(spark):
    bench = spark.createDataFrame([(None, "a b c d e f g h i j k"), (7, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j k y"), (2, "nothing of that"), (3, "one two three four five six seven eight nine ten, a b c d e f g h i j")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.digest(decontaminate.verdicts(*decontaminate.scan(docs, bench))).collect()}
    assert [(got[i]["n_hit"], got[i]["n_items"], got[i]["contaminated"]) for i in (1, 2, 3)] == [(11, 0, True), (0, 0, False), (20, 1, True)]
    assert [r["doc_id"] for r in decontaminate.clean(docs, bench).collect()] == [2]


def test_a_rare_language_is_learned_from_a_large_table(spark):
    rows = [(i, f"the house and the garden {i}", "en") for i in range(3000)] + [(9000 + i, f"żółta łódź płynie wąską rzeką {i}", "pl") for i in range(6)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=30)
    assert model.languages == ["en", "pl"]
    told = langid.predict(spark.createDataFrame([(1, "łódź płynie rzeką"), (2, "the garden")], "doc_id long, text string"), model)
    assert {r["doc_id"]: r["lang_pred"] for r in told.collect()} == {1: "pl", 2: "en"}


def test_shares_keep_the_bound():
    assert langid.shares({"a": 1000, "b": 5, "c": 40}, 100) == {"b": 5, "c": 40, "a": 55}
    assert langid.shares({"a": 1000, "b": 1000}, 100) == {"a": 50, "b": 50}


def test_a_letter_gets_a_learned_language(spark):
    model = langid.fit(spark.createDataFrame([(i, f"the house {i}", "en") for i in range(9)] + [(50 + i, f"das haus {i}", "de") for i in range(9)], "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, "x"), (2, "ひらがな"), (3, "12"), (4, None)], "doc_id long, text string")
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()} == {1: ("de", 0), 2: ("de", 0), 3: ("und", 0), 4: ("und", 0)}
    assert langid.keep(docs, model, 0.0).count() == 0


def test_repeated_rows_and_string_ids(spark):
    mail = "write to a@b.cd"
    rows = [("x", mail), ("x", mail), ("y", None), ("z", mail + " ")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = sorted((r["doc_id"], r["n_email"], r["spans"]) for r in pii.digest(pii.find_pii(docs)).collect())
    assert found == [("x", 1, "email:9:15")] * 2 + [("y", 0, ""), ("z", 1, "email:9:15")]
    told = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs).collect())
    assert told == [("x", "z", 3, False)] * 2 + [("y", "y", 1, True), ("z", "z", 3, True)]
    stay = exact_dedup.keep_first(docs, exact_dedup.exact_dedup(docs))
    assert sorted(r["doc_id"] for r in stay.collect()) == ["y", "z"]
    again = spark.createDataFrame([("x", mail), ("x", mail)], "doc_id string, text string")
    assert exact_dedup.keep_first(again, exact_dedup.exact_dedup(again)).count() == 1
    hits = decontaminate.digest(decontaminate.verdicts(*decontaminate.scan(docs, docs.where("doc_id = 'x'").withColumnRenamed("doc_id", "item_id")))).collect()
    assert sorted((r["doc_id"], r["contaminated"]) for r in hits) == [("x", True), ("x", True), ("y", False), ("z", True)]


def test_turns_that_tie_or_repeat(spark):
    labelled = [(k, t, r, x) for k in range(6) for t, (r, x) in enumerate([("user", "What now?"), ("assistant", "y " * 80)] * 2)]
    model = chat.fit(spark.createDataFrame(labelled, "conv_id long, turn long, role string, text string"))
    rows = [(1, 0, "What now?"), (1, 0, "What now?"), (1, 1, "y " * 80), (1, 1, "y " * 80), (2, 0, "y " * 80), (2, 0, "What now?")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got, again = (sorted((r["conv"], r["pos"], r["text"], r["role_pred"]) for r in chat.recover_roles(d, model).collect()) for d in (df, df.repartition(4)))
    assert len(got) == len(rows) and got == again and all(r[3] in ("user", "assistant") for r in got)
    none = chat.recover_roles(df.limit(0), model)
    assert none.count() == 0


def test_transcripts_may_start_anywhere(spark):
    """Positions from 0, 1 or 1000 on: the same roles, since the first unit opens a transcript; units without a transcript or place too."""
    labelled = [(k, t, r, x) for k in range(6) for t, (r, x) in enumerate([("user", "What now?"), ("assistant", "y " * 80)] * 2)]
    table = lambda rows: spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    models = [chat.fit(table([(k, t + at, r, x) for k, t, r, x in labelled])) for at in (0, 1, 1000)]
    assert all((m.emit["opens"] == models[0].emit["opens"]).all() for m in models)
    opened = chat.units(table([(1, 5, None, "a"), (1, 6, None, "b"), (2, 0, None, "c"), (None, 0, None, "d"), (3, None, None, "e"), (4, -7, None, "f")]), "conv_id", "turn", "text", 256)
    assert {r["text"]: r["opens"] for r in opened.collect()} == {"a": 1, "b": 0, "c": 1, "d": 1, "e": 1, "f": 1}


def test_ties_go_to_the_language_that_sorts_first(spark):
    same = [(2 * k + j, f"la casa {k}", x) for k in range(8) for j, x in enumerate(["pt", "es"])]
    model = langid.fit(spark.createDataFrame(same, "doc_id long, text string, lang string"))
    got = langid.predict(spark.createDataFrame([(1, "la casa"), (1, "la casa")], "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] for r in got] == ["es", "es"] and got[0]["score"] == got[1]["score"] > 0
