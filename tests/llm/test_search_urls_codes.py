"""Ranked search, URL filters and vector codes against brute force, with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import codes, search, sql, urls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def ranked(docs, items, k):
    """item -> its k best (score, id), by the contract's formula."""
    own = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in own), sum(len(w) for _, w in own)
    asked, df = {}, {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    for _, w in own:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = {}
    for i, wanted in asked.items():
        found = []
        for d, w in own:
            m = 50 + 50 * len(w) * n_docs // n_terms if w else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * w.count(x) // (1000 * w.count(x) + 20 * m)) for x in wanted if x in w)
            if s > 0:
                found.append((-s, d is None, d))
        out[i] = [(-s, d) for s, _, d in sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k]]
    return out


@pytest.fixture(scope="module")
def library():
    rng = random.Random(11)
    words = [a + b for a in ("ka", "Lo", "mi", "ÄÖ", "日本", "9", "x1") for b in ("", "n", "r", "ß")]
    make = lambda n: "".join(rng.choice(words) + rng.choice((" ", ", ", "\n", "-", "_", "\x7f")) for _ in range(n))
    docs = [(i, make(rng.choice((1, 3, 20, 60)))) for i in range(120)]
    docs += [(900, None), (901, ""), (902, " .,-\x00"), (903, "rare " * 40_000), (904, docs[3][1]), (905, docs[3][1]), (None, docs[3][1]), (None, "rare word"), (7, "another row of that id"), docs[5], docs[5]]
    items = [(k, make(6)) for k in range(9)] + [(20, None), (21, ""), (22, "unknownterm"), (23, "Rare RARE"), (None, "word"), (24, "ka"), (24, "mi")]
    return docs, items


@pytest.mark.parametrize("most", [500_000, 20], ids=["one block", "many blocks"])
def test_search(spark, library, most):
    docs, items = library
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in docs], "doc_id long, text string, term string, terms string, score int").repartition(5)
    want = {i: x for i, x in ranked(docs, items, 7).items() if x}
    got = {}
    for r in search.search(df, spark.createDataFrame([(*x, 3) for x in items], "item_id long, text string, rank int"), k=7, most=most).collect():
        got.setdefault(r["item_id"], []).append((r["rank"], r["score"], r["doc_id"]))
    assert {i: [x[1:] for x in sorted(own)] for i, own in got.items()} == want
    assert all([x[0] for x in sorted(own)] == list(range(1, len(own) + 1)) for own in got.values())
    assert 23 in want and want[23][0][1] in (903, None)


def test_search_of_nothing(spark, library):
    docs, items = (spark.createDataFrame(x, f"{k} string, text string") for x, k in zip(([(str(a), b) for a, b in y] for y in library), ("doc_id", "item_id")))
    assert search.search(docs.limit(0), items).count() == search.search(docs, items.limit(0)).count() == 0
    got = search.search(docs, items, k=3).where("item_id = '24'").orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3] and all(isinstance(r["doc_id"], str) for r in got)


def test_radix_order():
    rng = np.random.default_rng(0)
    for most in (1, 70_000, 1 << 40):
        key = rng.integers(0, most, 5000)
        assert (search.radix_order(key, most) == np.argsort(key, kind="stable")).all()


def test_equal_scores_go_by_id_in_every_task(spark):
    """More ties than places, spread over tasks and batches."""
    docs = spark.range(5000).select((F.lit(9000) - F.col("id")).alias("doc_id"), F.lit("same words here").alias("text")).repartition(7).unionByName(spark.range(5000).select("id", F.lit("other").alias("text")).withColumnRenamed("id", "doc_id"))
    got = search.search(docs, spark.createDataFrame([(1, "same here")], "item_id int, text string"), k=20).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == list(range(4001, 4021)) and len({r["score"] for r in got}) == 1


# -- URL filters --------------------------------------------------------------------------------------------------------


def test_hosts_paths_and_rules(spark):
    rows = [
        (1, "https://A.Example.ORG/es/7", "a.example.org", "/es/7", "example.org/es/", "block"),
        (2, "http://example.org/en/15?x=/es/", "example.org", "/en/15", "example.org/en/1", "block"),
        (3, "http://other.org/es/1#top", "other.org", "/es/1", "org/", "allow"),
        (4, "ftp://x.com/de/", "x.com", "/de/", "com/de/", "block"),
        (5, "x://com/fr/a", "com", "/fr/a", "com/fr/", "allow"),
        (6, "http://xcom/fr/a", "xcom", "/fr/a", None, "allow"),
        (7, "http://org", "org", "", None, "allow"),
        (8, "http://org?q=1", "org", "", None, "allow"),
        (9, "no scheme/org/", "", "", None, "allow"),
        (10, None, "", "", None, "allow"),
        (11, "", "", "", None, "allow"),
        (12, "a://b://c.org/es/", "b:", "//c.org/es/", None, "allow"),
        (13, "http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        (14, "http://ÄB.org/" + "x" * 100_000, "Äb.org", "/" + "x" * 100_000, "org/", "allow"),
        (15, "http://a.net" + "/s" * 20_000, "a.net", "/s" * 20_000, None, "allow"),
    ]
    pages = spark.createDataFrame([(*r[:2], "h", "s") for r in rows], "page_id long, url string, host string, segs string")
    got = {r["page_id"]: tuple(r)[1:5] for r in urls.judge(pages).collect()}
    assert got == {r[0]: r[2:] for r in rows}
    assert urls.judge(pages.limit(0)).count() == 0


def crawl():
    """Hosts of many shapes: one large, one of single pages, one of many names, deep paths, codes, files and folders."""
    rng = random.Random(6)
    out = []
    for host, n in (("big.net", 900), ("a.com", 200), ("b.com", 60), ("c.org", 50), ("d.example.org", 90), ("e.com", 9)):
        for _ in range(n):
            lang = rng.choice(("en", "de", "fr", "es"))
            end = rng.choice(("", "/", ".html", "?q=1", "#x", f"/{rng.randrange(16**20):020x}", "/".join(["", *rng.choices("abcd", k=rng.randrange(8))])))
            page = rng.choice((str(rng.randrange(10**6)), f"post-{rng.choice('abcdefghijklmnopqrstuvwxyz')}{rng.choice('xyz')}", "about", "x" * 70))
            out.append(f"https://{host}/{lang}/{page}{end}")
    out += ["http://big.net", "http://big.net/", None, "nothing", "http:///x"] + out[:40]
    return [(i, u) for i, u in enumerate(out)]


def test_trees_equal_the_sql(spark, tmp_path):
    rows = crawl()
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    con = duckdb.connect()
    pages.coalesce(1).write.parquet(str(tmp_path / "pages"))
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    rel = con.execute(sql.ORACLES["op12_urls"])
    names = [c[0] for c in rel.description]
    want = {r[0]: dict(zip(names, r)) for r in rel.fetchall()}
    got = {r["page_id"]: r.asDict() for r in urls.judge(pages).collect()}
    assert len(got) == len(rows) and {i: {**r, "purity": pytest.approx(r["purity"])} for i, r in got.items()} == want
    assert any("*" in r["template"] for r in got.values()) and any(r["template"].endswith("/**") for r in got.values())


def test_templates_of_a_bad_branch_are_rejected(spark):
    """Labels on some pages of a branch decide its others; branches that labels tell apart are not merged; a host without labels is left alone."""
    rules = [urls.Rule("block", "shop.net", "/deals/1"), urls.Rule("block", "shop.net", "/deals/2"), urls.Rule("allow", "shop.net", "/help/")]
    rows = [f"http://shop.net/deals/{n}{k}" for n in range(1, 10) for k in range(30)] + [f"http://shop.net/help/{k}" for k in range(50)] + [f"http://shop.net/{w}/{k}" for w in ("team", "jobs") for k in range(40)] + [f"http://far.net/deals/{k}" for k in range(100)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    told = {}
    for r in urls.judge(pages, rules).collect():
        told.setdefault((r["host"], r["path"].split("/")[1]), set()).add((r["verdict"], r["template"]))
    assert told["shop.net", "deals"] == {("block", "/deals/0")} and told["shop.net", "help"] == {("allow", "/help/0")}
    assert {v for v, _ in told["far.net", "deals"]} == {"allow"}
    assert told["shop.net", "team"] == told["shop.net", "jobs"] == {("allow", "/jobs/0")}  # alike, so one branch


# -- vector codes -------------------------------------------------------------------------------------------------------


def lloyd(rows, parts, entries, rounds):
    """Plain rounds over the kept rows: (id -> (code, error)), codebooks."""
    ok = [(i, v) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ok = [r for r in ok if len(r[1]) == len(ok[0][1])]
    x = np.array([[math.floor(256 * c) for c in v] for _, v in ok], np.int64)
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % parts))).reshape(len(ok), parts, -1)
    book = x[:entries].copy().transpose(1, 0, 2)
    for r in range(rounds + 1):
        d = ((x[:, :, None] - book[None]) ** 2).sum(3)
        code = d.argmin(2)
        if r < rounds:
            for p in range(parts):
                for e in range(book.shape[1]):
                    if (code[:, p] == e).any():
                        own = x[code[:, p] == e, p]
                        book[p, e] = own.sum(0) // len(own)
    return [(i, bytes(c.tolist()).hex(), int(d[k, np.arange(parts), c].sum())) for k, ((i, _), c) in enumerate(zip(ok, code))], book


@pytest.mark.parametrize(("dim", "parts", "entries", "rounds"), [(32, 16, 64, 2), (10, 4, 7, 3), (8, 2, 64, 1), (4, 4, 3, 0)])
def test_codes(spark, dim, parts, entries, rounds):
    rng = np.random.default_rng(dim)
    centres = rng.normal(0, 1, (20, dim))
    rows = [(1000 - i, (centres[i % 20] + rng.normal(0, 0.2, dim)).round(2 if i % 3 else 0).tolist(), (None, 1, 2)[i % 3]) for i in range(400)]
    rows += [(5, None, 1), (6, [], 1), (7, [float("nan")] * dim, 2), (8, [None] + [0.5] * (dim - 1), 2), (9, [float("inf")] + [0.0] * (dim - 1), 1), (2000, [0.5] * (dim + 1), 1)]
    rows += [(None, [0.25] * dim, None), (990, rows[0][1], 1), (990, rows[0][1], 1), (1500, [0.0] * dim, 2), (1501, [-0.001] * dim, 2)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    want, book = lloyd(rows, parts, entries, rounds)
    out, mine = codes.compress(df, parts=parts, entries=entries, rounds=rounds)
    order = lambda x: sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    assert (mine == book).all()
    assert order((r["vec_id"], r["code"], r["error"]) for r in out.collect()) == order(want)
    label = {}
    for r in out.collect():
        label[r["label"]] = label.get(r["label"], 0) + r["error"]
    told = codes.digest(out, mine).collect()
    assert len(told) == len(want) and {r["codebooks_sha256"] for r in told} == {hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()}
    assert sorted({r["label_error"] for r in told}) == sorted(set(label.values()))


def test_codes_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([(1, [0.5] * 16, 1), (2, None, 1)], "vec_id long, embedding array<float>, label int")
    out, book = codes.compress(df)
    assert [tuple(r) for r in out.collect()] == [(1, 1, "00" * 16, 0)] and book.shape == (16, 1, 1)
    none, book = codes.compress(df.where("vec_id = 2"))
    assert none.count() == codes.digest(none, book).count() == 0


def test_pruning_is_exact_and_saves_distances():
    """Bounds that are packed, moved and unpacked give what all distances give, ties included."""
    rng = np.random.default_rng(3)
    x = np.concatenate([c + rng.integers(-4, 5, (300, 4)) for c in rng.integers(-60, 60, (12, 4))])
    e = x[rng.choice(len(x), 33, replace=False)]
    own, upper, lower = codes.nearest(x, e)
    tried = 0
    for _ in range(6):
        to = np.stack([x[own == k].sum(0) // (own == k).sum() if (own == k).any() else e[k] for k in range(len(e))])
        book = codes.books(to[None], e[None])
        low = codes.unpack(upper, codes.pack(upper, lower), len(e)) - book.moved[0]
        own, upper, lower, n = codes.pruned(x, to, book.apart[0], own, upper + book.moved[0][own], low)
        d = ((x[:, None] - to[None]) ** 2).sum(2)
        assert (own == d.argmin(1)).all() and (upper**2 >= d.min(1)).all()
        others = np.arange(len(e)) != own[:, None]
        assert (np.sign(lower) * lower**2 <= d)[others].all()
        tried, e = tried + n, to
    assert tried < 6 * len(x) * len(e) / 3


def test_roots_are_exact():
    x = np.array([0, 1, 2, 3, 4, 2**52 - 1, 2**52, 2**60 - 1, 2**60, 10**18 - 1, 10**18, 10**18 + 1])
    want = [math.isqrt(int(v)) for v in x]
    assert codes.root(x).tolist() == want
    assert codes.root_up(x).tolist() == [r + (r * r < int(v)) for r, v in zip(want, x)]
