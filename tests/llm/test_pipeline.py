import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import langid

SF = "/root/testdata/sf0.001"
STAGE = {name: stage for name, stage in corpus_pipeline.STAGES}


def test_stages_keep_the_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF).persist()
        counts.append(docs.count())
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    assert all(a >= b for a, b in zip([n, *counts], counts)) and counts[3] > 0.6 * n
    taken = docs.collect()
    assert all(0 < r["taken"] <= 2 * r["size"] for r in taken)
    # what stays has no equal texts
    assert len({"".join(r["text"].split()) for r in taken}) == len(taken)


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


WORDS = {"en": "the house and garden with some people who went there again because of light rain".split(), "de": "das haus und der garten mit vielen leuten die dort wieder waren wegen leichtem regen".split()}
COLUMNS = "doc_id long, text string, lang string, source string, size long, taken string, rk string, node string, digest string, row int, first_slot string, comp string, stays string"


def planted():
    """rows, benchmark items: clean texts, copies, near copies, benchmark passages, foreign texts, nulls, repeats, a long text."""
    rng = random.Random(21)
    make = lambda lang, n: " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "s", "en"]) for _ in range(n))
    base = [(make(x, 60), x) for x in ["en", "de"] * 12]
    item = make("en", 14)
    texts = [*base, (base[0][0].replace(" ", "  "), "en"), (base[1][0], "de"), (base[2][0] + " extra", "en"), (" ".join(base[3][0].split()[:-1]), "de"), (base[4][0] + " " + item.upper() + " " + make("en", 5), "en")]
    texts += [(None, "en"), (None, None), ("", "de"), ("12 + 34 = 46", None), ("ひらがな カタカナ", None), (make("de", 30_000), "de"), (make("en", 40), None)]
    rows = [(k, t, x, ("a", "b", None)[k % 3], 7, "t", "k", "n", "d", 1, "f", "c", "s") for k, (t, x) in enumerate(texts)]
    return [*rows, rows[5], (None, make("en", 50), "en", "a", *rows[0][4:])], [(1, item), (2, None), (None, "too few"), (3, "?!")]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rows, items = planted()
    root = tmp_path_factory.mktemp("planted")
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), spark.read.parquet(f"{root}/documents.parquet"), rows, items


def kept(df):
    return sorted((str(r["doc_id"]), r["text"] or "") for r in df.collect())


def told(rows):
    return sorted((str(r[0]), r[1] or "") for r in rows)


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def exact(rows):
    """One row of each group of equal texts: the longest, then the least id, null last."""
    best: dict = {}
    for r in rows:
        key = (-len(r[1] or ""), r[0] is None, r[0] or 0)
        if squeezed(r[1]) not in best or key < best[squeezed(r[1])][0]:
            best[squeezed(r[1])] = (key, r)
    return [r for _, r in best.values()]


def near(rows):
    """Rows of the least id of each component of similar five-word sets; rows without words or id stay."""
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        return frozenset(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    able = [k for k in range(len(rows)) if sets[k] and rows[k][0] is not None]
    for a in able:
        for b in able:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k in able:
        least[root(k)] = min(rows[k][0], least.get(root(k), rows[k][0]))
    return [r for k, r in enumerate(rows) if k not in able or r[0] == least[root(k)]]


def clean(rows, items):
    word = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    wins = {tuple(w[k : k + 10]) for _, t in items if (w := word(t)) for k in range(max(len(w) - 9, 1))}
    hit = lambda w: any(tuple(w[k : k + n]) in wins for n in {len(x) for x in wins} for k in range(len(w) - n + 1))
    return [r for r in rows if not hit(word(r[1]))]


def test_language_stage(spark, table):
    root, docs, rows, _ = table
    out = STAGE["language ID"](spark, docs, root)
    gone = {None, "", "12 + 34 = 46", "ひらがな カタカナ"}
    assert out.columns == docs.columns and kept(out) == told([r for r in rows if r[1] not in gone])
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert kept(STAGE["language ID"](spark, none, root)) == told(rows)


def test_exact_stage(spark, table):
    root, docs, rows, _ = table
    out = STAGE["exact dedup"](spark, docs, root)
    assert out.columns == docs.columns and kept(out) == told(exact(rows))


def test_near_stage(spark, table):
    root, docs, rows, _ = table
    out = STAGE["MinHash near-dedup"](spark, docs, root)
    assert out.columns == docs.columns and kept(out) == told(near(rows)) and len(kept(out)) < len(rows)


def test_benchmark_stage(spark, table):
    root, docs, rows, items = table
    out = STAGE["benchmark decontamination"](spark, docs, root)
    assert out.columns == docs.columns and kept(out) == told(clean(rows, items)) and len(kept(out)) == len(rows) - 1


def test_mixing_stage(spark, table):
    root, docs, rows, _ = table
    out = STAGE["mixing sources to target weights"](spark, docs, root)
    assert out.columns == [*docs.columns, "size_mix", "target", "taken_mix", "first_slot_mix"]
    got = out.collect()
    assert all(0 < r["taken_mix"] <= 2 * r["size_mix"] for r in got) and all(r["text"] for r in got)
    # a source whose target is twice its size gives every document with words, equal rows as often as they are there
    full = {r["source"] for r in got if r["target"] == 2 * sum(len((x[1] or "").split()) for x in rows if x[3] == r["source"])}
    assert full and all(kept(out.where(F.col("source").eqNullSafe(F.lit(s)))) == told([r for r in rows if r[3] == s and (r[1] or "").split()]) for s in full)


def test_run_equals_brute_force(spark, table):
    root, docs, rows, items = table
    model = langid.fit(docs)
    known = {(str(r["doc_id"]), r["rk"]) for r in langid.predict(docs, model).where(f"lang_pred <> 'und' AND score >= {corpus_pipeline.LEAST_SCORE} AND score > 0").collect()}
    keys = {(str(r["doc_id"]), r["text"]): r["rk"] for r in docs.select("doc_id", "text", F.xxhash64("text").alias("rk")).collect()}
    left = [r for r in rows if (str(r[0]), keys[str(r[0]), r[1]]) in known]
    left = clean(near(exact(left)), items)
    size: dict = {}
    for r in left:
        size[r[3]] = size.get(r[3], 0) + len(r[1].split())
    out = corpus_pipeline.run(spark, root).collect()
    assert {(str(r["doc_id"]), r["text"]) for r in out} <= {(str(r[0]), r[1]) for r in left} and len({r["doc_id"] for r in out}) == len(out)
    total = sum(size.values())
    for s in size:
        mine = [r for r in out if r["source"] == s]
        assert sum(r["taken_mix"] for r in mine) == pytest.approx(mine[0]["target"], abs=1)
        if mine[0]["target"] == 2 * size[s]:
            assert sorted(r["text"] for r in mine) == sorted(r[1] for r in left if r[3] == s)
    assert sum(r["taken_mix"] for r in out) == pytest.approx(min(1.5 * total, 2 * total), abs=len(size))
