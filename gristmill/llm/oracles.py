"""DuckDB twins of the operators that SQL can express: url filters, quality rules, secret scans."""

from __future__ import annotations

from . import quality_rules as qr
from . import secret_scans as sc
from . import url_filters as uf


#: Levels that the url twin spells out; the operator itself has no such bound.
SQL_DEPTH = 10


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secret_scans() -> str:
    """Starts are sums of the lengths of gaps and matches before."""
    rows = []
    for i, k in enumerate(sc.KINDS):
        p = q(k.pattern)
        rows.append(f"""SELECT doc_id, {i} AS k, {q(k.name)} AS name, length(m[i]) AS size, length(g[i]) AS measured, {k.least} AS least,
            (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))))::BIGINT AS stop
            FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM (SELECT doc_id, regexp_split_to_array(t, {p}) AS gaps, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {k.group}) AS g FROM d WHERE regexp_matches(t, {p})))""")
    base = len(sc.BASE_KINDS)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (SELECT doc_id, k, name, stop - size AS start, stop FROM ({" UNION ALL ".join(rows)}) WHERE measured >= least),
    f AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < {base}) AS own, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, k) AS every FROM s GROUP BY doc_id)
    SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(own, '')) AS base_sha256, coalesce(every, '') AS spans, sha256(t) AS blob FROM d LEFT JOIN f USING (doc_id)"""


def quality_rules() -> str:
    word = q(qr.WORD)
    classes = [f"length(regexp_replace(t, {q(p)}, '', 'g'))" for p in qr.CLASSES.values()]
    n_common = len(qr.COMMON_WORDS["en"]) + 1
    common = "CASE lang " + " ".join(f"WHEN {q(lang)} THEN [" + ", ".join(f"len(list_filter(w, lambda x: x = {q(c)}))" for c in ws) + "]" for lang, ws in qr.COMMON_WORDS.items()) + " ELSE [" + ", ".join(["0"] * (n_common - 1)) + "] END"
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{i + 1}])" for i in range(n)) + "]"

    def js(a: str, b: str, n: int) -> str:
        p, r = f"({a}[i] / list_sum({a}))", f"({b}[i] / list_sum({b}))"
        part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {r}) / 2)) ELSE 0.0 END"
        return f"CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN sqrt(greatest(list_sum(list_transform(range(1, {n + 1}), lambda i: ({part(p)} + {part(r)}) / 2)), 0)) ELSE 0.0 END"

    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lang, regexp_extract_all(coalesce(text, ''), {word}) AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {word})) AS lines FROM documents),
    win AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, v) AS n FROM (SELECT doc_id, p, w[p:p + {qr.WINDOW - 1}] AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - {qr.WINDOW - 2})) AS p FROM d))),
    rep AS (SELECT doc_id, count(DISTINCT p + k) AS r FROM (SELECT doc_id, p, unnest(range(0, {qr.WINDOW})) AS k FROM win WHERE n > 1) GROUP BY doc_id),
    m0 AS (SELECT doc_id, t, length(t) AS nc, len(w) AS n_words, len(lines) - len(list_distinct(lines)) AS dup, coalesce(r, 0) AS r, CASE WHEN lang IN ({", ".join(map(q, qr.COMMON_WORDS))}) THEN lang ELSE '{qr.POOLED}' END AS l, [{", ".join(classes)}] AS c, {common} AS o FROM d LEFT JOIN rep USING (doc_id)),
    m AS (SELECT * REPLACE (list_append(c, nc - list_sum(c)) AS c, list_append(o, CASE WHEN l <> '{qr.POOLED}' THEN n_words - list_sum(o) ELSE 0 END) AS o) FROM m0),
    e AS (SELECT l, {sums("c", len(qr.CLASSES) + 1)} AS rc, {sums("o", n_common)} AS ro FROM m GROUP BY l),
    refs AS (SELECT * FROM e WHERE l <> '{qr.POOLED}' UNION ALL SELECT '{qr.POOLED}', {sums("rc", len(qr.CLASSES) + 1)}, {sums("ro", n_common)} FROM e),
    v AS (SELECT m.*, {js("c", "rc", len(qr.CLASSES) + 1)} AS cd, CASE WHEN n_words >= {qr.MIN_JUDGED_WORDS} THEN {js("o", "ro", n_common)} ELSE 0.0 END AS wd, n_words < {qr.MIN_WORDS} OR 100 * r > {qr.MAX_REPEAT_PERCENT} * n_words AS failed FROM m LEFT JOIN refs USING (l))
    SELECT doc_id, n_words::BIGINT AS n_words, (nc - c[4])::BIGINT AS word_chars, c[6]::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, r::BIGINT AS n_repeat_words, failed AS base_failed, NOT failed AND NOT ((nc >= {qr.MIN_CHARS} AND cd > {qr.MAX_CLASS_DISTANCE}) OR wd > {qr.MAX_WORD_DISTANCE}) AS kept, round(cd, 6)::DOUBLE AS class_distance, round(wd, 6)::DOUBLE AS word_distance FROM v"""


def url_filters() -> str:
    ranked = sorted(uf.RULES, key=lambda r: (-len(r.text), r.text))
    fits = lambda r: f"((host = {q(r.host)} OR ends_with(host, {q('.' + r.host)})) AND starts_with(path, {q(r.path)}))"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN {q(r.text)}" for r in ranked) + " END"
    said = "CASE " + " ".join(f"WHEN {fits(r)} THEN {q(r.verdict)}" for r in ranked) + " END"
    general = "CASE WHEN regexp_matches(s, '^[0-9a-f-]{12,}$') AND regexp_matches(s, '[0-9]') THEN '<x>' ELSE regexp_replace(s, '[0-9]+', '<n>', 'g') END"
    bins = [f"k_{k}" for k in uf.CHILD_KINDS]
    kind = "CASE WHEN child IS NULL THEN 'end' " + " ".join(f"WHEN regexp_matches(child, {q(p)}) THEN '{k}'" for k, p in uf.CHILD_KINDS.items() if p is not None) + " END"
    first = lambda c: f"first({c}) OVER (PARTITION BY host, template, list_position([{', '.join(bins)}], greatest({', '.join(bins)})) ORDER BY labels DESC, support DESC, segment) AS a_{c}"
    chi = "0.0 + " + " + ".join(f"CASE WHEN {k} + a_{k} > 0 THEN (sqrt(a_support / support) * {k} - sqrt(support / a_support) * a_{k}) ** 2 / ({k} + a_{k}) ELSE 0.0 END" for k in bins)
    freedom = "-1 + " + " + ".join(f"CASE WHEN {k} + a_{k} > 0 THEN 1 ELSE 0 END" for k in bins)
    pooled = "((b + a_b) / (labels + a_labels))"
    rates = f"CASE WHEN labels > 0 AND a_labels > 0 THEN abs(b / labels - a_b / a_labels) <= {uf.Z} * sqrt({pooled} * (1 - {pooled}) * (1 / labels + 1 / a_labels)) ELSE true END"
    steps = []
    for k in range(SQL_DEPTH):
        steps.append(f"""d{k} AS (SELECT host, template, shape[{k + 1}] AS segment, shape[{k + 2}] AS child, n, b, a, sum(n) OVER (PARTITION BY host, template) AS total FROM t{k} WHERE len(shape) > {k}),
        b{k} AS (SELECT host, template, segment, sum(n) AS support, sum(b) AS b, sum(b + a) AS labels, {", ".join(f"sum(CASE WHEN kind = '{c}' THEN n ELSE 0 END) AS k_{c}" for c in uf.CHILD_KINDS)} FROM (SELECT *, {kind} AS kind FROM d{k} WHERE total >= {uf.MIN_SUPPORT}) GROUP BY host, template, segment, total
            HAVING sum(n) >= {uf.MIN_SHARE} * total AND (sum(n) >= {uf.MIN_SUPPORT} OR sum(b + a) >= {uf.MIN_LABELLED})),
        m{k} AS (SELECT host, template, segment, CASE WHEN ({chi}) <= ({freedom}) + {uf.Z} * sqrt(2.0 * ({freedom})) AND {rates} THEN a_segment ELSE segment END AS into_ FROM (SELECT *, {", ".join(map(first, ("segment", "support", "labels", "b", *bins)))} FROM b{k})),
        c{k} AS (SELECT host, template, segment, CASE WHEN count(*) OVER (PARTITION BY host, template, into_) > 1 THEN '{uf.MERGED}' || into_ ELSE segment END AS name FROM m{k}),
        t{k + 1} AS (SELECT t.host, t.shape, t.n, t.b, t.a, CASE WHEN len(t.shape) > {k} THEN t.template || '/' || coalesce(c.name, '{uf.WILD}') ELSE t.template END AS template FROM t{k} t LEFT JOIN c{k} c ON t.host = c.host AND t.template = c.template AND t.shape[{k + 1}] = c.segment)""")
    smooth = lambda b, n, towards: f"(({b}) + {uf.PRIOR_WEIGHT} * {towards}) / (({n}) + {uf.PRIOR_WEIGHT})"
    host = lambda c: f"sum({c}) OVER (PARTITION BY host)"
    return f"""WITH u AS (SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{uf._UPPER}', '{uf._LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    p AS (SELECT page_id, host, path, {rule} AS rule, {said} AS said, list_filter(string_split(path, '/'), lambda s: s <> '') AS parts FROM h),
    r AS (SELECT *, list_transform(parts, lambda s: {general}) AS shape FROM p),
    t0 AS (SELECT host, shape, count(*) AS n, count(*) FILTER (said = 'block') AS b, count(*) FILTER (said = 'allow') AS a, '' AS template FROM r GROUP BY host, shape), {", ".join(steps)},
    g AS (SELECT host, template, sum(b) AS b, sum(b + a) AS labelled FROM t{SQL_DEPTH} GROUP BY host, template),
    prior AS (SELECT CASE WHEN sum(labelled) > 0 THEN sum(b) / sum(labelled) ELSE 0.0 END AS p FROM g),
    z0 AS (SELECT *, {smooth(host("b"), host("labelled"), "p")} AS ph FROM g, prior),
    z AS (SELECT host, template, {smooth("b", "labelled", "ph")} AS purity, labelled >= {uf.MIN_LABELLED} AND {smooth("b", "labelled", "ph")} >= {uf.MIN_PURITY} AS rejected FROM z0)
    SELECT page_id, host, path, rule, coalesce(said, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 6)::DOUBLE AS purity FROM r LEFT JOIN t{SQL_DEPTH} USING (host, shape) LEFT JOIN z USING (host, template)"""


ORACLE_SQL = {"op2_url_filters": url_filters(), "op7_quality_rules": quality_rules(), "op8_secret_scans": secret_scans()}
