"""Each operator against brute force on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import chat, decontaminate, exact_dedup, langid, mixing, near_dedup, pii, secrets, substrings, warc
from parley.llm._common import small_batches

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, rk string, node string, digest string, size string, n long"


def low(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(5)
    words = [a + b for a in ("ka", "lo", "mi", "tu", "Re", "É") for b in ("n", "r", "st", "la")]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [make(120) for _ in range(12)]
    texts = [None, "", " \t\n", "one", "One", "two words", "x" * 30_000, "😀 ß ı İ", *base]
    for b in base[:6]:
        w = b.split()
        texts += [b, b.replace(" ", "\n"), b.upper() if b.isascii() else b, " ".join(w[:100] + make(4).split() + w[104:]), " ".join(w[:60]) + " " + make(60), make(10) + " " + " ".join(w[20:90]) + " " + make(30)]
    texts += [base[0] + " ." + " " * 50, make(3000), base[7] + " " + make(2000) + " " + base[7]]
    out = [(i, t, ("en", "de", None)[i % 3], ("a", "b", "c", None)[i % 4]) for i, t in enumerate(texts)]
    return out + [out[9], (3, "one", "en", "a")]  # repeated rows


@pytest.fixture(scope="session")
def docs(spark, rows):
    small_batches(spark)
    return spark.createDataFrame([(*r, "x", "y", "z", "w", 1) for r in rows], COLUMNS).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def test_near_dedup(docs, rows, empty):
    def sets(t):
        w = SPACE.findall(low(t))
        return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else [])

    s = {i: sets(t) for i, t, *_ in rows}
    up = {i: i for i in s}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    got = near_dedup.near_dedup(docs, shingle=2, block=4, crowd=2).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(s[i]), root(i), root(i) == i) for i in s}
    assert near_dedup.near_dedup(empty).count() == 0


def test_near_dedup_tells_texts_of_one_id_apart(spark):
    rng = random.Random(9)
    a, b = ([f"{x}{rng.randrange(1000)}" for _ in range(80)] for x in "ab")
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (5, near(a)), (5, " ".join(b)), (7, near(b))]
    for kind in ("long", "string"):
        docs = spark.createDataFrame([((i if kind == "long" else str(i)), t) for i, t in rows], f"doc_id {kind}, text string")
        got = near_dedup.near_dedup(docs)
        assert sorted((int(r["doc_id"]), int(r["component_id"]), r["kept"], r["stays"]) for r in got.collect()) == [(1, 1, True, True), (5, 1, False, False), (5, 5, True, True), (7, 5, False, False)]
        assert sorted(r["text"] for r in near_dedup.keep_one(docs, got).collect()) == sorted([rows[0][1], rows[2][1]])


def test_signatures_miss_hardly_any_similar_pair():
    """Sets of similarity 0.8 exactly, as drawn: the share within the distance; and the chance that the README states."""
    from math import comb

    rng = np.random.default_rng(3)
    signer, found, n = near_dedup.Signer(16, 5, 1), 0, 400
    for _ in range(n):
        x = rng.integers(0, 1 << 63, 1000, np.uint64)
        s, t = np.sort(x[:900]), np.sort(x[100:])
        sig = signer.signature(np.concatenate([s, t]), np.array([0, 900, 1800]))
        found += int((sig[0] != sig[1]).sum()) <= 31
    assert found == n
    assert sum(comb(80, k) * 0.2**k * 0.8 ** (80 - k) for k in range(32, 81)) < 4e-5


def test_signatures_guarantee_the_distance():
    rng = np.random.default_rng(1)
    signer = near_dedup.Signer(16, 5, 1)
    a = rng.integers(0, 1 << 16, (200, 80)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(80, 31, replace=False)] ^= np.uint16(1)
    ka, kb = signer.keys(a), signer.keys(b)
    d, part = signer.first_shared(a, b, 1)
    assert (d == 31).all() and (part >= 0).all()
    assert all(ka[i, part[i]] == kb[i, part[i]] and not (ka[i, : part[i]] == kb[i, : part[i]]).any() for i in range(200))


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(F.unhex(F.sha2(t, 256)), 1, 0)], ids=["sha256", "all collide"])
def test_exact_dedup(docs, rows, empty, digest):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    want = {i: (min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}
    got = exact_dedup.exact_dedup(docs, digest=digest, files_per_batch=1).collect()
    assert len(got) == len(rows) and {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got} == want
    if digest is exact_dedup.sha256:
        stay = exact_dedup.keep_first(docs, exact_dedup.exact_dedup(docs))
        assert stay.columns == docs.columns and sorted(r["doc_id"] for r in stay.collect()) == sorted(i for i, w in want.items() if w[2])
        assert exact_dedup.exact_dedup(empty).count() == 0


def test_mixing(docs, rows, empty):
    size = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len(SPACE.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, s))
    weight, free, left, target = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, set(names), 1.5 * sum(size.values()), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > 2 * size[s]]
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = 2 * size[s]
            left -= target[s]
            free.discard(s)
    mix, sized = mixing.mix_sources(docs, block=64)
    got = mixing.taken_words(mix, sized).collect()
    assert len(got) == len(rows)
    for s in names:
        mine = [r for r in got if r["source"] == s]
        assert mine[0]["source_size"] == size[s] and mine[0]["target"] == pytest.approx(target[s])
        assert all(r["taken"] <= 2 * r["size"] for r in mine)
        assert sum(r["taken"] for r in mine) == pytest.approx(target[s], abs=1)
    slots = mix.select("slot", "src").distinct().orderBy("slot").collect()
    assert len({r["slot"] for r in slots}) == len(slots)
    columns = ["doc_id", "rk", "off", "slot", "src", "from_word", "to_word"]
    again, _ = mixing.mix_sources(docs.repartition(7), block=64)
    assert sorted(map(tuple, mix.select(columns).collect()), key=str) == sorted(map(tuple, again.select(columns).collect()), key=str)
    assert mixing.taken_words(*mixing.mix_sources(empty)).count() == 0


def test_schedule_equals_brute_force(spark):
    block, targets = 10, {0: 333.5, 1: 0.0, 2: 41.0, 3: 1200.0, 4: 3.0}
    need = {s: -(-t // block) for s, t in targets.items() if t > 0}
    total = sum(need.values())
    bounds, low = {}, 0.0
    for s in sorted(need):
        bounds[s] = (low / total, (low + need[s]) / total)
        low += need[s]
    n = int(total + 4 * len(need) * (int(np.log2(total + 2)) + 4))
    want, have = [], dict.fromkeys(need, 0)
    for i in range(n):
        u = (i * mixing.GOLDEN % mixing.ONE) / mixing.ONE
        s = next(s for s, (lo, hi) in bounds.items() if lo <= u < hi)
        if have[s] < need[s]:
            want.append((i, s, have[s]))
        have[s] += 1
    got = mixing.schedule(spark.createDataFrame(list(targets.items()), "src int, target double"), block)
    assert sorted(tuple(r) for r in got.select("slot", "src", "block_no").collect()) == want
    assert all(have[s] >= need[s] for s in need)


def test_mix_keeps_equal_rows_and_foreign_columns(spark):
    rows = [(1, "a b c", "s", 5, "x", "y"), (1, "a b c", "s", 5, "x", "y"), (2, None, None, 1, "", ""), (3, "d " * 40, "t", 1, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, taken string, row string")
    out = mixing.keep_taken(docs)
    assert out.columns == [*docs.columns, "size_mix", "target", "taken_mix", "first_slot"]
    got = sorted(tuple(r) for r in out.select("doc_id", "size", "size_mix", "taken", "row").collect())
    assert [g for g in got if g[0] == 1] == [(1, 5, 3, "x", "y")] * 2 and 2 not in [g[0] for g in got]


def test_decontamination(spark, docs, rows, empty):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    items = [(1, rows[8][1]), (2, "Two words"), (3, None), (4, " ".join((rows[9][1] or "").split()[5:18])), (10, "ONE"), (5, " ".join(rows[10][1].split()[7:13])), (4, "?!")]
    wins = {}
    for i, t in items:
        w = word.findall(low(t))
        for k in range(max(len(w) - 9, 1) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = {}
    for d, t, *_ in rows:
        w, hit, ids = word.findall(low(t)), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if found := wins.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= found
        want[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit))
    bench = spark.createDataFrame([(*x, "extra") for x in items], "item_id long, text string, window string")
    for most in (1_000_000, 0):  # broadcast and shuffled
        got = decontaminate.digest(decontaminate.verdicts(*decontaminate.scan(docs, bench, most_broadcast=most))).collect()
        assert len(got) == len(rows) and {r["doc_id"]: tuple(r)[1:] for r in got} == want
    # a long text that the shuffled way must not carry along: no row is wider than a block, or the words around it
    long = spark.createDataFrame([(1, "w " * 300_000 + items[0][1] + " w" * 1000), (None, items[1][1])], "doc_id long, text string")
    both = [sorted(map(str, decontaminate.digest(decontaminate.verdicts(*decontaminate.scan(long, bench, most_broadcast=m))).collect())) for m in (1_000_000, 0)]
    assert both[0] == both[1] and "contaminated=True" in both[0][0]
    assert sorted({r["doc_id"] for r in decontaminate.clean(docs, bench).collect()}) == sorted(d for d, w in want.items() if not w[4])
    left = {r["doc_id"]: r["words"] for r in decontaminate.spans_removed(docs, bench).collect()}
    assert all(len(left[d]) == w[0] - w[1] for d, w in want.items())
    none = bench.limit(0)
    assert decontaminate.verdicts(*decontaminate.scan(docs, none)).where("n_hit > 0").count() == 0
    assert decontaminate.verdicts(*decontaminate.scan(empty, bench)).count() == 0


PERSONAL = [
    None, "", "mail a.b+c@x-y.co.uk, then z@nodot and a@b.c@d.e 😀 q@w.e", "ip 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.2.3.004", "card 4111 1111 1111 1111 or 4111-1111-1111-1112, amex card 378282246310005",
    "no words 378282246310005", "tel +49 (30) 1234-567, +1 ((( , +12 34 56 78 90 12 34 56", "IBAN DE89370400440532013000 and DE89370400440532013001", "a" * 20_000 + "@", "1 2 3 4 5 " * 500, "." * 300 + "@" + "a." * 3000, "+1" + " " * 20_000,
]


def test_pii(spark, empty):
    digits = lambda v: re.sub("[^0-9]", "", v)
    luhn = lambda v: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits(v)))) % 10 == 0
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))), ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(digits(v)) <= 19 and luhn(v)), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(digits(v)) <= 15)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(PERSONAL)], "doc_id long, text string, email string")
    got = {r["doc_id"]: r for r in pii.digest(pii.find_pii(df)).collect()}
    for i, t in enumerate(PERSONAL):
        spans = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if ok(m.group())] for k, p, ok in kinds]
        assert [got[i][f"n_{k[0]}"] for k in kinds] == list(map(len, spans)), t and t[:60]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(x for s in spans for x in s).encode()).hexdigest()
        assert got[i]["spans"].startswith(",".join(x for s in spans for x in s))
    assert got[7]["spans"] == "iban:5:27" and "short_card" in got[4]["spans"] and "short_card" not in got[5]["spans"]
    assert [r["score"] for r in pii.scored(df).where("kind = 'iban'").collect()] == [100] and got[7]["scores"] == "100"
    assert pii.redact(df).where("doc_id = 7").first()["text"] == "IBAN <iban> and DE89370400440532013001"
    assert pii.digest(pii.find_pii(empty)).count() == 0


def test_context_tips_a_span(spark):
    """The same number stands with a word nearby and not without; scores are those of the spans, in their order; IBANs in groups."""
    rows = [
        ("378282246310005 is an order", "", ""),
        ("378282246310005 is an Amex", "short_card:0:15", "90"),
        ("378282246310005" + " " * 41 + "amex", "", ""),
        ("DE89 3704 0044 0532 0130 00, so", "grouped_iban:0:27", "80"),
        ("account DE89 3704 0044 0532 0130 00", "grouped_iban:8:35", "100"),
        ("DE89 3704 0044 0532 0130 01 xDE89 3704 0044 0532 0130 00", "", ""),
        ("NO93 8601 1117 947 and BE68 5390 0754 7034", "grouped_iban:0:18,grouped_iban:23:42", "80,80"),
        ("a@b.cd, contact 1.2.3.4 host", "email:0:6,ip:16:23", "90,60"),
    ]
    got = pii.digest(pii.find_pii(spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "doc_id long, text string"))).orderBy("doc_id").collect()
    assert [(r["spans"], r["scores"]) for r in got] == [r[1:] for r in rows]


def test_secrets(spark, empty):
    key = "ghp_" + "a1B2" * 10
    texts = [None, "", "Password: 'hunter22' TOKEN==abc password = x", "AKIA" + "Q" * 16 + " AKIA" + "Q" * 15, "f" * 24 + " 😀 " + "0a" * 11 + "z", f"see {key}", "api-key api_key=abcdef apikey:\"zzzzzz\"", "token" + " " * 20_000 + "= secret=abcdef123"]
    rows = [(i, t, f"s{i}", "x") for i, t in enumerate(texts)] + [(100 + i, "secret=changeme1", f"s{i}", "x") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, cands string")
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan_secrets(df)).collect()}
    kinds = [("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(1)) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m.group()) >= 24)]
    for i, t, *_ in rows:
        spans = [(m.start(), n, f"{k}:{m.start()}:{m.end()}") for n, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, t or "") if ok(m)]
        assert [got[i][f"n_{k[0]}"] for k in kinds] == [sum(x[1] == n for x in spans) for n in range(3)], t
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(x[2] for x in sorted(spans)).encode()).hexdigest()
    assert got[5]["spans"] == "provider:4:48" and got[100]["n_example"] == 1 and got[100]["n_live"] == 0 and got[5]["n_live"] == 1
    many = spark.createDataFrame([(i, f"see {key}", f"s{i}") for i in range(4)], "doc_id long, text string, source string")
    assert {r["spans"] for r in secrets.digest(secrets.scan_secrets(many)).collect()} == {""}  # a widely copied example
    assert secrets.digest(secrets.scan_secrets(empty)).count() == 0


def covered(rows):
    """Brute force of the removed words: {id: (words, removed, digest of the rest)}."""
    first, words = {}, {i: SPACE.findall(t or "") for i, t, *_ in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    want = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return want


@pytest.mark.parametrize("crowd", [1000, 1], ids=["buckets", "all crowded"])
def test_substring_dedup(docs, rows, empty, crowd):
    want = covered(rows)
    got = substrings.substring_dedup(docs, crowd=crowd, piece=30).collect()
    assert len(got) == len(rows) and {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == want
    assert any(w[1] for w in want.values())
    if crowd == 1:
        assert substrings.substring_dedup(empty).count() == 0
        named = substrings.substring_dedup(docs.where("doc_id > 9").withColumn("doc_id", F.format_string("%05d", "doc_id")), crowd=crowd)
        assert {int(r["doc_id"]): r["n_removed"] for r in named.collect() if r["n_removed"]} == {i: w[1] for i, w in covered([r for r in rows if r[0] > 9]).items() if w[1]}


def test_windows_are_sorted_by_content():
    rng = random.Random(8)
    texts = [[rng.choice("ab") for _ in range(rng.randint(1, 40))] for _ in range(60)]
    row, k, cls = substrings.sorted_windows([" ".join(t).encode() for t in texts], 7)
    windows = [tuple(t[i : i + 7]) for t in texts for i in range(len(t) - 6)]
    assert len(windows) == len(cls) and len(set(windows)) == len(set(cls.tolist())) == len(set(zip(windows, cls.tolist(), strict=True)))
    assert [(r, i) for r, t in enumerate(texts) for i in range(len(t) - 6)] == list(zip(row.tolist(), k.tolist(), strict=True))


def test_substrings_of_long_repetitive_texts(spark):
    n = 1_200_000
    rows = [(1, "a " * n), (2, "b " + "a " * n), (3, "a " * 49 + "c")]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (n, 0), 2: (n + 1, n), 3: (50, 0)}


def test_warc_inflates_no_payload_of_a_rejected_record(tmp_path):
    """Headers alone, some bytes more at most, whatever the payload; all of it where the record passes."""
    body = [bytes([65 + i % 3]) * n for i, n in enumerate((7_800, 3_000_000, 50_000_000, 10))]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(warc.member(warc.record({"WARC-Type": "response" if i < 3 else "revisit", "WARC-Target-URI": f"u{i}"}, b)) for i, b in enumerate(body)))
    part = warc.Part(str(path), 0, path.stat().st_size)
    none, one, bare = warc.Reader({"path": str(tmp_path)}), warc.Reader({"path": str(tmp_path)}), warc.Reader({"path": str(tmp_path), "payload": "false"})
    none.tests, one.tests = [("warc-type", "is", ("metadata",))], [("warc-target-uri", "is", ("u1",))]
    assert not list(none._records(part)) and none.inflated <= 4 * 1024
    assert [(h["warc-target-uri"], p) for h, p in one._records(part)] == [("u1", body[1])] and one.inflated <= len(body[1]) + 5 * 1024
    assert len(list(bare._records(part))) == 4 and bare.inflated <= 4 * 1024


def test_warc_of_text_ids_and_a_large_page(spark):
    big = "x y " * 12_500_000
    rows = [("a:b>c", "p" * 2000), ("ä z", "p" * 2000), ("null", "q" * 1500), (None, "q" * 1500), ("big", big), ("", "short")]
    df = spark.createDataFrame(rows[:4] + rows[5:], "page_id string, html string").unionByName(spark.createDataFrame([("big",)], "page_id string").withColumn("html", F.repeat(F.lit("x y "), 12_500_000))).withColumn("url", F.lit("http://u/"))
    got = {r["page_id"]: tuple(r)[1:] for r in warc.digest(warc.read(spark, warc.archive(df)), "string").collect() if r["page_id"] or r["payload_bytes"] > 1000}
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert got == {"a:b>c": (2000, sha(rows[0][1]), "revisit", "ä z"), "ä z": (2000, sha(rows[0][1]), "response", None), "null": (1500, sha(rows[2][1]), "response", None), None: (1500, sha(rows[2][1]), "response", None), "big": (50_000_000, sha(big), "response", None)}


def test_warc_round_trip(spark, tmp_path):
    long = "<p>ä</p>" * 300
    pages = [(1, "u1", long), (2, "u2", long), (3, "u3", "short"), (4, "u4", "short"), (5, "u\r\n5", None), (6, None, "x\r\n\r\nWARC/1.1" * 200), (7, "u2/7", long), (None, "n", "null id")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, sha string").repartition(3)
    path = warc.archive(df)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.digest(warc.read(spark, path)).collect()}
    for i, _, h in pages:
        b = (h or "").encode()
        again = h == long and i != 7
        assert got[i] == (len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 7 if again else None)
    some = warc.read(spark, path).where("record_type = 'revisit' AND target_uri LIKE 'u2%'")
    assert [r["record_id"] for r in some.collect()] == ["<urn:page:2>"]
    bare = warc.read(spark, path, payload=False)
    assert bare.where("payload IS NOT NULL").count() == 0 and bare.count() == len(pages)
    raw = {r["record_id"]: bytes(r["payload"] or b"") for r in warc.read(spark, path).collect()}
    assert raw["<urn:page:6>"] == pages[5][2].encode()
    assert warc.read(spark, warc.archive(df.limit(0))).count() == 0
    profiles = {r["profile"] for r in warc.read(spark, path).where("record_type = 'revisit'").collect()}
    assert profiles == {warc.IDENTICAL}
    twice = warc.digest(warc.read(spark, warc.archive(df.where("page_id IN (3, 7)").union(df.where("page_id IN (3, 7)")).withColumn("url", F.lit("  u ")))))
    assert sorted((r["page_id"], r["record_type"]) for r in twice.collect()) == [(3, "response")] * 2 + [(7, "response")] * 2
    blank = warc.read(spark, warc.archive(df.where("page_id = 3").withColumn("url", F.lit("  u "))))
    assert [r["target_uri"] for r in blank.collect()] == ["  u "]
    small = spark.read.format("warc").option("ahead_bytes", "10").load(path)
    assert sorted(map(str, small.collect())) == sorted(map(str, warc.read(spark, path).collect()))
    # archives of another origin: plain records, and members that don't tell their length
    import gzip

    rec = [warc.record({"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{i}>"}, b"body" * i) for i in range(3)]
    (tmp_path / "a.warc").write_bytes(b"".join(rec))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, rec)))
    assert sorted(len(r["payload"]) for r in warc.read(spark, str(tmp_path)).collect()) == [0, 0, 4, 4, 8, 8]


def test_language_id(spark, docs, empty):
    rng = random.Random(3)
    syl = {"aa": ["the", "ing", "er", "on"], "bb": ["sch", "ung", "ein", "ich"], "cc": ["eau", "oi", "que", "ez"]}
    make = lambda x, n: " ".join("".join(rng.choice(syl[x]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    data = [(i, make(x, rng.randint(3, 80)), x) for i, x in enumerate(["aa", "bb", "cc"] * 100)] + [(1000, None, "aa"), (1001, "12 34 !!", "aa"), (1002, make("bb", 5000), None), (1003, "", None)]
    df = spark.createDataFrame([(*r, "q") for r in data], "doc_id long, text string, lang string, rk string")
    train = df.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    model = langid.fit(train)
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    held = [(i, x) for i, _, x in data if zlib.crc32(str(i).encode()) % 3 == 1 and i < 1000]
    assert sum(got[i]["lang_pred"] == x for i, x in held) / len(held) > 0.98
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1003)) and got[1002]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.keep(df, model, 0.3)
    assert kept.columns == df.columns and kept.where("doc_id < 1000").count() == 300 and kept.where("doc_id IN (1000, 1001, 1003)").count() == 0
    # a filter holds every learned n-gram, and more than 64 languages have several words of bits
    grams = {f"l{k:02}": np.arange(k * 50, k * 50 + 80, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k in range(70)}
    big = langid.build(grams)
    for k, name in enumerate(big.languages):
        mask = big.member(grams[name])
        assert ((mask[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).all()
    none = langid.fit(df.limit(0))
    assert {r["lang_pred"] for r in langid.predict(df, none).collect()} == {"und"} and langid.keep(df, none, 0.3).count() == df.count()
    assert langid.predict(empty, model).count() == 0


@pytest.mark.parametrize("n_langs", [1, 4, 11, 70])
def test_language_scores_equal_a_dense_scorer(n_langs):
    """One language at a time, one n-gram at a time, from the definition: against sets of positions in Python integers."""
    import pyarrow as pa

    from parley.llm import _words

    rng = random.Random(n_langs)
    texts = ["", "a", "x  y", "Größe, die   GROSSE! 12", None, "é", *(" ".join("".join(rng.choice("abcde é") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 60))) for _ in range(40))]

    def grams(text, n):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        symbols = [0 if b < 128 and not chr(b).isalpha() else b - 96 if b < 128 else b - 101 for b in re.sub(rb"[^a-z\x80-\xff]+", b" ", low.encode())]
        return [sum(x * 155 ** (n - 1 - j) for j, x in enumerate(symbols[i : i + n])) for i in range(len(symbols) - n + 1)]

    hashed = lambda codes, n: [int(x) for x in _words.mix(np.array(codes, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n))]
    known = {f"l{k:02}": {h for t in rng.sample(texts[6:], 3) for n in langid.ORDERS for h in hashed(grams(t, n), n)} for k in range(n_langs)}
    model = langid.build({x: np.array(sorted(v), np.uint64) for x, v in known.items()})
    size, places = len(model.rows), {}
    at = lambda h: [(h + k * (h >> 32 | 1)) % (1 << 64) % size for k in range(model.probes)]
    for x, v in known.items():
        places[x] = {p for h in v for p in at(h)}
    best, score = model.score(*_words.buffers(pa.array(texts, pa.string())))
    for t, b, s in zip(texts, best, score, strict=True):
        total, hits = 0.0, dict.fromkeys(known, 0.0)
        for n in langid.ORDERS:
            for h in hashed(grams(t, n), n):
                has = [x for x in known if all(p in places[x] for p in at(h))]
                total += 1 / max(len(has), 1)
                for x in has:
                    hits[x] += 1 / len(has)
        want = {}
        for x in known:
            wrong = (len(places[x]) / size) ** model.probes
            want[x] = min(max((hits[x] / max(total, 1e-9) - wrong) / (1 - wrong), 0), 1)
        top = max(want.values())
        assert s == pytest.approx(top, abs=1e-9) and (b < 0 if top <= 0 else want[model.languages[b]] == pytest.approx(top, abs=1e-9))


def test_chat(spark, empty):
    rng = random.Random(2)
    say = {"user": lambda: "What " + "x " * rng.randint(1, 20) + "?", "assistant": lambda: "\n".join("y " * 80 for _ in range(rng.randint(1, 4))), "system": lambda: "Be kind."}
    rows = []
    for c in range(40):
        roles = (["system"] if c % 4 == 0 else []) + ["user", "assistant"] * rng.randint(1, 3)
        rows += [(c, t, r, say[r]()) for t, r in enumerate(roles)]
    rows += [(500, t, ("user", "assistant")[t % 2], say[("user", "assistant")[t % 2]]()) for t in range(60)]
    rows += [(600, 0, None, None), (601, None, None, "x"), (None, 0, None, "User: hi"), (None, 1, None, "[Assistant] " + "y " * 80)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, block string")
    model = chat.fit(df)
    for block in (256, 7):  # one pass, and blocks that are chained
        got = chat.recover_roles(df, model, role_col="role", block=block).collect()
        known = [r for r in got if r["role"]]
        assert len(got) == len(rows) and sum(r["role"] == r["role_pred"] for r in known) / len(known) > 0.97
        by = {(r["conv"], r["pos"]): r["role_pred"] for r in got if r["conv"] == 500}
        whole = by if block == 256 else whole
        assert by == whole
    # the chained blocks follow a plain Viterbi pass
    u = chat.units(df.where("conv_id = 500"), "conv_id", "turn", "text", 256).orderBy("pos").toPandas()
    s = model.scores({k: u[k].to_numpy().astype(int) for k in chat.SIZES})
    v, back = chat.viterbi(model, s, None)
    path = [int(v.argmax())]
    for t in range(len(s) - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    assert [model.roles[x] for x in reversed(path)] == [whole[500, t] for t in range(60)]
    marked = {r["rendered"] for r in got if r["conv"] is None}
    assert marked == {"<|user|>\nhi<|end|>\n", "<|assistant|>\n" + "y " * 80 + "<|end|>\n"}
    text = spark.createDataFrame([(1, "User: What hello?\nthere?\n\nAssistant: " + "yes " * 60)], "conv_id long, text string")
    turns = chat.merged(chat.recover_roles(chat.lines(text, "conv_id", "text"), model)).orderBy("turn").collect()
    assert turns[0]["role_pred"] == "user" and turns[-1]["role_pred"] == "assistant"
    none = chat.fit(df.limit(0))
    assert chat.recover_roles(df, none).where("role_pred IS NULL").count() == len(rows)
    assert chat.recover_roles(df.limit(0), model).count() == 0
