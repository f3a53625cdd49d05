"""DuckDB SQL for the queries of this folder that SQL can express.

Left out: the schedule of op4 and the models of op3 and op10 (they are tested against brute force and held-out rows)."""

from __future__ import annotations

from parley.llm import pii, secrets, urls

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = f"translate(coalesce(text, ''), '{_UP}', '{_LOW}')"
_WORD = "[^\\x20\\x09-\\x0D]+"

OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) END AS s FROM w),
x AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, unnest(s) AS g FROM s), p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (na + nb - k)), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT doc_id AS node, doc_id AS c FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.node WHERE r.c < u.b),
m AS (SELECT node, min(c) AS c FROM r GROUP BY 1) SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN m ON m.node = s.doc_id"""

OP2 = """WITH n AS (SELECT doc_id, coalesce(length(text), 0) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM k"""

_ITEM = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
OP5 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_ITEM}') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all({_FOLD}, '{_ITEM}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, (SELECT DISTINCT n FROM bw))),
h AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw ON bw.win = dw.win AND bw.n = dw.n), c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS STRING), ',' ORDER BY CAST(item_id AS STRING)) AS items FROM h GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""


def _spans(pattern: str, keep: str = "TRUE", group: int | None = None) -> str:
    """List of structs s, e, v, g: matches with their positions; `keep` is a condition on v, g, s, e and text t."""
    p = pattern.replace("'", "''")
    m, gaps = f"regexp_extract_all(t, '{p}')", f"string_split_regex(t, '{p}')"
    part = f"regexp_extract_all(t, '{p}', {group})" if group else m
    start = "list_sum(list_transform(g.gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(g.m[1:i - 1], lambda x: length(x))), 0)"
    made = f"SELECT list(struct_pack(s := CAST(s AS BIGINT), e := CAST(s + length(v) AS BIGINT), v := v, g := part) ORDER BY s) FROM (SELECT t, {start} AS s, g.m[i] AS v, g.part[i] AS part, i FROM (SELECT {m} AS m, {gaps} AS gaps, {part} AS part) AS g, (SELECT unnest(range(1, len({m}) + 1)) AS i)) AS z WHERE {keep}"
    return f"coalesce(({made}), [])"


def _luhn(v: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    digit = f"CAST(substr({d}, length({d}) - i + 1, 1) AS INTEGER)"
    return f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)) % 10 = 0"


def _digits(v: str, lo: int, hi: int) -> str:
    return f"length(regexp_replace({v}, '[^0-9]', '', 'g')) BETWEEN {lo} AND {hi}"


_ALONE = "NOT regexp_matches(concat(CASE WHEN s > 0 THEN substr(t, CAST(s AS BIGINT), 1) ELSE '' END, ' ', substr(t, CAST(s + length(v) + 1 AS BIGINT), 1)), '[A-Za-z0-9]')"


def _scored(kind: str, spans: str) -> str:
    """The spans with the score that nearby words adjust."""
    near = f"regexp_matches(concat_ws(' ', substr(t, CAST(greatest(x.s - {pii.WINDOW} + 1, 1) AS BIGINT), CAST(least(x.s, {pii.WINDOW}) AS BIGINT)), substr(t, x.e + 1, {pii.WINDOW})), '(?i)({pii.CONTEXT[pii.WORDS_OF.get(kind, kind)]})')"
    return f"list_transform({spans}, lambda x: struct_pack(s := x.s, e := x.e, z := {pii.WORTH[kind]} + CASE WHEN {near} THEN {pii.NEARBY} ELSE 0 END))"


_V = "replace(v, ' ', '')"
_C = f"substr(concat(substr({_V}, 5), substr({_V}, 1, 4)), CAST(k AS BIGINT), 1)"
_MOD97 = f"list_reduce(list_concat([0], list_transform(range(1, length({_V}) + 1), lambda k: CASE WHEN ascii({_C}) < 58 THEN ascii({_C}) - 48 ELSE ascii({_C}) - 55 END)), lambda a, x: (a * CASE WHEN x < 10 THEN 10 ELSE 100 END + x) % 97) = 1"
_KINDS = {
    "email": _spans(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": _spans(r"[0-9]+(?:\.[0-9]+){3}", "coalesce(list_bool_and(list_transform(string_split(v, '.'), lambda x: coalesce(TRY_CAST(x AS INTEGER) <= 255, FALSE))), FALSE)"),
    "card": _spans(r"[0-9](?:[\x20-]?[0-9])+", f"{_digits('v', 16, 19)} AND {_luhn('v')}"),
    "phone": _spans(r"\+[0-9][\x20().0-9-]+[0-9]", _digits("v", 8, 15)),
    "iban": _spans("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", f"{_ALONE} AND {_MOD97}"),
    "grouped_iban": _spans(r"[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3}\b)?", f"{_ALONE} AND length({_V}) BETWEEN 15 AND 34 AND {_MOD97}"),
    "short_card": _spans(r"[0-9](?:[\x20-]?[0-9])+", f"{_digits('v', 13, 15)} AND {_ALONE} AND {_luhn('v')}"),
}


def _text(kind: str, rank: int, by_start: bool = False) -> str:
    a, b = ("x.s", str(rank)) if by_start else (str(rank), "x.s")
    return f"list_transform({kind}, lambda x: struct_pack(a := CAST({a} AS BIGINT), b := CAST({b} AS BIGINT), t := concat('{kind}:', x.s, ':', x.e)))"


def _listed(kinds: list[str], by_start: bool = False) -> str:
    parts = [_text(k, i, by_start) for i, k in enumerate(kinds)]
    both = parts[0]
    for p in parts[1:]:
        both = f"list_concat({both}, {p})"
    return f"coalesce(array_to_string(list_transform(list_sort({both}), lambda x: x.t), ','), '')"


_BASE6 = ["email", "ip", "card", "phone"]
_SCORED = {k: _scored(k, k) if k in _BASE6 else f"list_filter({_scored(k, k)}, lambda x: x.z >= {pii.NEEDED})" for k in _KINDS}
_ALL6 = ", ".join(f"list_transform({k}, lambda x: CAST(x.z AS VARCHAR))" for k in _KINDS)
OP6 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS MATERIALIZED (SELECT doc_id, t, {', '.join(f'{c} AS {k}' for k, c in _KINDS.items())} FROM d), f AS (SELECT doc_id, {', '.join(f'{c} AS {k}' for k, c in _SCORED.items())} FROM p)
SELECT doc_id, {', '.join(f'CAST(len({k}) AS BIGINT) AS n_{k}' for k in _BASE6)}, sha256({_listed(_BASE6)}) AS base_sha256, {_listed(list(_KINDS))} AS spans, coalesce(array_to_string(flatten([{_ALL6}]), ','), '') AS scores FROM f"""

OP7 = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND top > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND top > page_id THEN top END AS refers_to FROM m"""

OP8 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents), x AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM d)),
f AS (SELECT win, min(doc_id) AS first FROM x GROUP BY 1), g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM x JOIN f USING (win) WHERE first < doc_id), c AS (SELECT doc_id, list(p) AS ps FROM g GROUP BY 1),
k AS (SELECT d.doc_id, p, word, g.p IS NOT NULL AS gone FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) AS d LEFT JOIN g USING (doc_id, p)),
r AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept, count(*) FILTER (WHERE gone) AS n FROM k GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)"""


def _any_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_any_case(x) for x in ("password", "passwd", "secret", "token", "api_?key"))
_SECRETS = {
    "assign": _spans(rf"(?:{_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "length(part) >= 6", group=1),
    "access": _spans("AKIA[A-Z0-9]+", "length(v) >= 20"),
    "hex": _spans("[0-9a-f]{24,}"),
    "provider": _spans(secrets.PROVIDER.replace("}+", "}")),
    "signed": _spans(secrets.SIGNED.replace("}+", "}")),
    "key_block": _spans(secrets.KEY_BLOCK),
}
_ALL9 = "UNION ALL ".join(f"SELECT doc_id, source, '{k}' AS kind, unnest({k}) AS x FROM f " for k in _SECRETS)
OP9 = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), f AS MATERIALIZED (SELECT doc_id, source, {', '.join(f'{c} AS {k}' for k, c in _SECRETS.items())} FROM d),
c AS (SELECT doc_id, source, kind, x.s AS s, x.e AS e, substr(sha256(x.g), 1, 16) AS value FROM ({_ALL9})), o AS (SELECT value, count(DISTINCT source) AS owners FROM c GROUP BY 1),
l AS (SELECT c.*, owners <= 2 AS live, CASE kind {' '.join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(_SECRETS))} END AS rank FROM c JOIN o USING (value)),
n AS (SELECT doc_id, string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, rank) FILTER (WHERE rank < 3 OR live) AS spans, string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, rank) FILTER (WHERE rank < 3) AS base, count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_example FROM l GROUP BY 1)
SELECT f.doc_id, CAST(len(assign) AS BIGINT) AS n_assign, CAST(len(access) AS BIGINT) AS n_access, CAST(len(hex) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM f LEFT JOIN n USING (doc_id)"""

_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
OP11 = f"""WITH t AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_TERM}') AS w FROM documents), d AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM t WHERE len(w) > 0), c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_FOLD}, '{_TERM}')) AS term FROM benchmark), f AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY term, n_docs), s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN w USING (term) JOIN d USING (doc_id), c GROUP BY 1, 2),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0) SELECT * FROM r WHERE rank <= 50"""



def _codes(rounds: int = 2, parts: int = 16, entries: int = 64) -> str:
    """Plain Lloyd rounds: every part against every entry of its codebook."""
    width = f"(len(embedding) // {parts})"
    out = [
        "k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, p, embedding[p * {width} + 1:(p + 1) * {width}] AS x FROM k, range({parts}) AS r(p))",
        f"s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT {entries})",
        "b0 AS (SELECT p, e, x FROM p JOIN s USING (vec_id))",
    ]
    for i in range(rounds + 1):
        out.append(f"a{i} AS MATERIALIZED (SELECT vec_id, p, v.x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT vec_id, v.p, v.x, e, list_sum(list_transform(list_zip(v.x, b{i}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p AS v JOIN b{i} ON v.p = b{i}.p) AS v GROUP BY 1, 2, 3)")
        if i < rounds:
            mean = f"SELECT p, e, list(m ORDER BY j) AS x FROM (SELECT p, e, j, CAST(floor(sum(c) / count(*)) AS BIGINT) AS m FROM (SELECT p, e, unnest(x) AS c, unnest(range(len(x))) AS j FROM a{i}) GROUP BY 1, 2, 3) GROUP BY 1, 2"
            out.append(f"b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.x, b{i}.x) AS x FROM b{i} LEFT JOIN ({mean}) AS m USING (p, e))")
    out.append(f"c AS (SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY 1)")
    out.append(f"h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM b{rounds})")
    return f"WITH {', '.join(out)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM c JOIN k USING (vec_id), h"


def _urls() -> str:
    """The rules, and the tree level by level: wildcards, then branches of siblings that the tests do not tell apart."""
    r = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    fits = [(f"(host = '{x.host}' OR ends_with(host, '.{x.host}')) AND starts_with(path, '{x.path}')", x) for x in sorted(urls.RULES, key=lambda x: -len(x.host + x.path))]
    case = lambda f: f"CASE {' '.join(f'WHEN {c} THEN {f(x)!r}' for c, x in fits)} END"
    shape = f"CASE WHEN length(s) > {urls.LONG} THEN '~' WHEN length(s) >= 16 AND regexp_matches(s, '^[0-9a-fA-F-]+$') AND regexp_matches(s, '[0-9]') THEN 'x' ELSE regexp_replace(s, '[0-9]+', '0', 'g') END"
    cut = "string_split(substr(path, 2), '/')"
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in urls.SUMS)
    number = "last = '0' AND NOT contains(last, '.')"
    out = [
        f"u AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{_UP}', '{_LOW}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, coalesce({r}, '') AS r FROM pages))",
        f"g AS (SELECT *, {case(lambda x: x.host + x.path)} AS rule, {case(lambda x: x.verdict)} AS told, list_concat(list_transform({cut}[1:{urls.DEPTH}], lambda s: {shape}), CASE WHEN len({cut}) > {urls.DEPTH} THEN ['**'] ELSE [] END) AS segs FROM u)",
        f"z AS (SELECT *, CAST(contains(last, '.') AS INT) AS f_file, CAST(last = '' AS INT) AS f_dir, CAST({number} AS INT) AS f_number, CAST(NOT (contains(last, '.') OR last = '' OR {number}) AS INT) AS f_name, 1 AS n, CAST(coalesce(told = 'block', FALSE) AS INT) AS n_block, CAST(told IS NOT NULL AS INT) AS n_label FROM (SELECT *, segs[-1] AS last FROM g))",
        f"s0 AS MATERIALIZED (SELECT host, segs, '' AS t, {sums} FROM z GROUP BY 1, 2)",
    ]
    unequal = lambda f: f"((CAST({f} AS DOUBLE) * p_n - CAST(p_{f} AS DOUBLE) * n) * (CAST({f} AS DOUBLE) * p_n - CAST(p_{f} AS DOUBLE) * n) / (CAST(n AS DOUBLE) * p_n * ({f} + p_{f})))"
    forms = " + ".join(f"CASE WHEN {f} + p_{f} > 0 THEN {unequal(f)} ELSE 0 END" for f in urls.FORMS)
    diff = "(CAST(n_block AS DOUBLE) * p_n_label - CAST(p_n_block AS DOUBLE) * n_label)"
    labels = f"CASE WHEN n_label > 0 AND p_n_label > 0 AND n_block + p_n_block > 0 AND n_block + p_n_block < n_label + p_n_label THEN {diff} * {diff} * (n_label + p_n_label) / (CAST(n_label AS DOUBLE) * p_n_label * (n_block + p_n_block) * (n_label + p_n_label - n_block - p_n_block)) ELSE 0 END"
    order = "PARTITION BY host, t ORDER BY n_label > 0, CASE WHEN n_label > 0 THEN n_block / n_label ELSE 0 END, seg"
    for k in range(urls.DEPTH + 1):
        lags = ", ".join(f"lag({c}) OVER ({order}) AS p_{c}" for c in urls.SUMS)
        out += [
            f"c{k} AS (SELECT host, t, segs[{k + 1}] AS seg, {sums} FROM s{k} WHERE len(segs) > {k} GROUP BY 1, 2, 3)",
            f"h{k} AS (SELECT *, {lags} FROM (SELECT * FROM c{k} QUALIFY count(*) OVER (PARTITION BY host, t) <= {urls.MANY} OR n * {urls.SHARE} >= sum(n) OVER (PARTITION BY host, t)))",
            f"d{k} AS (SELECT *, sum(CASE WHEN p_n IS NULL OR (n_label > 0) <> (p_n_label > 0) OR {labels} > {urls.LABELS_DIFFER} OR {forms} > {urls.FORMS_DIFFER} THEN 1 ELSE 0 END) OVER ({order} ROWS UNBOUNDED PRECEDING) AS branch FROM h{k})",
            f"b{k} AS (SELECT host, t, seg, min(seg) OVER (PARTITION BY host, t, branch) AS name FROM d{k})",
            f"s{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (t, t{k}), concat(t, coalesce('/' || t{k}, '')) AS t, t{k} FROM (SELECT s.*, CASE WHEN len(segs) > {k} THEN coalesce(name, '*') END AS t{k} FROM s{k} AS s LEFT JOIN b{k} AS b ON b.host = s.host AND b.t = s.t AND b.seg = segs[{k + 1}]))",
        ]
    top = f"s{urls.DEPTH + 1}"
    steps = [f"t{i}" for i in range(urls.DEPTH + 1)]
    out.append(f"q0 AS (SELECT host, t, {', '.join(steps)}, sum(n_block) AS x, sum(n_label) AS y, CASE WHEN sum(sum(n_label)) OVER () > 0 THEN (sum(sum(n_block)) OVER () + 1.0) / (sum(sum(n_label)) OVER () + 2) ELSE 0 END AS purity FROM {top} GROUP BY ALL)")
    for k in range(urls.DEPTH + 2):
        node = f"(PARTITION BY {', '.join(['host', *steps[:k]])})"
        below = f"(sum(x) OVER {node} + {urls.PRIOR} * purity) / (sum(y) OVER {node} + {urls.PRIOR})"
        out.append(f"q{k + 1} AS (SELECT * EXCLUDE (purity), {below if k == 0 else f'CASE WHEN t{k - 1} IS NULL THEN purity ELSE {below} END'} AS purity FROM q{k})")
    return f"WITH {', '.join(out)} SELECT page_id, g.host, path, rule, coalesce(told, CASE WHEN CAST(purity AS DOUBLE) >= {urls.REJECT} THEN 'block' ELSE 'allow' END) AS verdict, q.t AS template, CAST(purity AS DOUBLE) AS purity FROM g JOIN {top} AS s ON s.host = g.host AND s.segs = g.segs JOIN q{urls.DEPTH + 2} AS q ON q.host = g.host AND q.t = s.t"


ORACLES: dict[str, str] = {"op1_near_dedup": OP1, "op2_exact_dedup": OP2, "op5_decontamination": OP5, "op6_pii": OP6, "op7_warc": OP7, "op8_substrings": OP8, "op9_secrets": OP9, "op11_search": OP11, "op12_urls": _urls(), "op13_codes": _codes()}
