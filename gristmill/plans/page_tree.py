"""Queries over the trees of pages: nodes, main content, markdown. Their twins say the same in SQL windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE
from ..operators import pages as pg
from .catalog import _entities, pages, q, query

#: Structure that the pages lack, put before their end: lists in lists, a table, a quotation, code, line breaks.
EXTRA = '<div><ol><li>one <i>two</i><ul><li>deep &copy;</li><li><a href="/x?a=1">link</a></li></ul></li><li><p>three</p></li></ol><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td><p>2</p></td></tr></table><blockquote>said<br>so <code>x &lt; y</code> <b>now</b></blockquote><pre>  k = 1\n    j</pre><img src="p.png" alt="a pic"></div>'


def _pattern_list(names: list[str]) -> str:
    return "(" + ", ".join(q(n) for n in names) + ")"


def _tokens(table: str) -> str:
    h = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for tag in pg.SILENT:
        h = f"regexp_replace({h}, '(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>', '', 'g')"
    h = f"regexp_replace({h}, '<![^>]*>', '', 'g')"
    run = "(PARTITION BY page ORDER BY pos ROWS UNBOUNDED PRECEDING)"
    level = lambda names: f"sum(CASE WHEN name IN {_pattern_list(names)} THEN CASE WHEN opens THEN 1 WHEN closes THEN -1 ELSE 0 END ELSE 0 END) OVER {run}"
    return f"""k0 AS (SELECT page_id AS page, unnest(l) AS tok, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all({h}, {q(pg.TOKEN)}) AS l FROM {table} WHERE html IS NOT NULL)),
    k1 AS (SELECT *, lower(regexp_extract(tok, {q(pg.NAME)}, 1)) AS name FROM k0),
    k2 AS (SELECT *, CASE WHEN name = '' THEN {_entities('tok')} END AS body, name <> '' AND NOT starts_with(tok, '</') AND NOT ends_with(tok, '/>') AS opens, name <> '' AND starts_with(tok, '</') AS closes FROM k1),
    k3 AS (SELECT *, CASE WHEN name = '' THEN length(regexp_replace(body, {q(f'[{SPACE}]')}, '', 'g')) ELSE 0 END AS text FROM k2),
    k4 AS (SELECT *, {level(pg.CONTAINERS)} AS depth, {level(pg.AROUND)} > 0 AS around, coalesce(last_value(CASE WHEN name = 'a' THEN opens END IGNORE NULLS) OVER {run}, false) AS link FROM k3),
    k5 AS (SELECT *, sum(text) OVER {run} AS text_sum, sum(CASE WHEN link OR around THEN text ELSE 0 END) OVER {run} AS thin_sum FROM k4),
    k6 AS (SELECT *, CASE WHEN name IN {_pattern_list(pg.CONTAINERS)} THEN CASE WHEN opens THEN depth WHEN closes THEN depth + 1 END END AS node_depth FROM k5),
    k7 AS (SELECT *, lead(pos) OVER s AS e, coalesce(lead(text_sum) OVER s, max(text_sum) OVER (PARTITION BY page)) - text_sum AS t, coalesce(lead(thin_sum) OVER s, max(thin_sum) OVER (PARTITION BY page)) - thin_sum AS h FROM k6 WINDOW s AS (PARTITION BY page, node_depth ORDER BY pos)),
    k8 AS (SELECT *, CASE WHEN node_depth IS NOT NULL AND opens THEN coalesce(e, {pg._END}) END AS node_end, CASE WHEN node_depth IS NOT NULL AND opens THEN t END AS node_text, CASE WHEN node_depth IS NOT NULL AND opens THEN h END AS node_thin FROM k7)"""


def _main() -> str:
    good = "(node_text - node_thin)"
    marked = f"(name IN {_pattern_list(pg.MAIN)} AND node_text > 0)"
    return f"""m0 AS (SELECT *, CASE WHEN node_end IS NOT NULL AND ({marked} OR {good} > 0) THEN row({marked}::INT, CASE WHEN {marked} THEN 0 ELSE {good} * {good} // greatest(node_text, 1) END, CASE WHEN {marked} THEN 0 ELSE depth END, -pos, node_end, around) END AS found FROM k8),
    m1 AS (SELECT *, max(found) OVER (PARTITION BY page) AS best FROM m0),
    kept AS (SELECT * FROM m1 WHERE (best IS NULL OR pos BETWEEN -best[4] AND best[5]) AND (coalesce(best[6], false) OR NOT around))"""


def _markdown(source: str) -> str:
    run = lambda by="": f"(PARTITION BY page{by} ORDER BY pos ROWS UNBOUNDED PRECEDING)"
    level = lambda names: f"sum(CASE WHEN name IN {_pattern_list(names)} THEN CASE WHEN opens THEN 1 WHEN closes THEN -1 ELSE 0 END ELSE 0 END) OVER {run()}"
    last = lambda e, by="": f"last_value({e} IGNORE NULLS) OVER {run(by)}"
    attribute = lambda n: f"regexp_extract(tok, {q(pg.attribute_pattern(n))}, 1)"
    h = "try_cast(nullif(regexp_extract(name, '^h([1-6])$', 1), '') AS INT)"
    cell = "(tables > 0 AND name NOT IN ('table', 'tr'))"
    nested = "(lists > CASE WHEN closes THEN 0 ELSE 1 END)"
    gap = f"CASE WHEN {cell} OR (pre AND name <> 'pre') THEN 0 WHEN name = 'br' THEN 1 WHEN name IN {_pattern_list(pg.LINES)} THEN 2 WHEN name IN ('ul', 'ol') THEN CASE WHEN {nested} THEN 2 ELSE 3 END WHEN name IN {_pattern_list(pg.BLOCKS)} THEN 3 ELSE 0 END"
    image = f"(name = 'img' AND {attribute('src')} <> '')"
    linked = "(href <> '' AND NOT starts_with(href, '#'))"
    wrapped = " ".join(f"WHEN name = '{t}' THEN '{m}'" for t, m in pg.WRAPPED.items())
    flat = f"replace(regexp_replace(body, {q(f'[{SPACE}]+')}, ' ', 'g'), chr(13), '')"
    blocks = _pattern_list([*pg.BLOCKS, *pg.LINES, "br"])
    shown = f"CASE WHEN name = '' THEN CASE WHEN pre THEN body ELSE {flat} END WHEN {image} THEN '![' || regexp_extract(tok, {q(pg.alt_pattern())}, 1) || '](' || {attribute('src')} || ')' WHEN name = 'code' AND NOT pre THEN '`' WHEN name = 'a' AND {linked} AND opens THEN '[' WHEN name = 'a' AND {linked} AND closes THEN '](' || href || ')' WHEN {cell} AND name IN {blocks} THEN ' ' {wrapped} ELSE '' END"
    marker = "CASE WHEN lists > 0 AND item.pos > coalesce(held, -1) THEN CASE WHEN item.kind = 'ol' THEN item.number || '. ' ELSE '* ' END WHEN lists > 0 THEN '  ' ELSE '' END"
    prefix = f"repeat('> ', greatest(quotes, 0)::INT) || repeat('  ', greatest(lists, 0)::INT) || {marker} || CASE WHEN heading > 0 THEN repeat('#', heading) || ' ' ELSE '' END"
    piece = "CASE WHEN name IN ('td', 'th') AND opens THEN CASE WHEN cells > 1 THEN ' | ' ELSE '' END ELSE shown END"
    return f"""l0 AS (SELECT *, {level(['ul', 'ol'])} AS lists, {level(['blockquote'])} AS quotes, {level(['pre'])} > 0 AS pre, {level(['table'])} AS tables, coalesce({last(f'CASE WHEN {h} IS NOT NULL THEN CASE WHEN opens THEN {h} ELSE 0 END END')}, 0) AS heading, coalesce({last(f"CASE WHEN name = 'a' AND opens THEN {attribute('href')} END")}, '') AS href, {last("CASE WHEN name = 'table' AND opens THEN pos END")} AS tab FROM {source}),
    l1 AS (SELECT *, {last("CASE WHEN name IN ('ul', 'ol') AND opens THEN pos END", ', lists')} AS list, {last("CASE WHEN name IN ('ul', 'ol') AND opens THEN name END", ', lists')} AS kind FROM l0),
    l2 AS (SELECT *, sum(CASE WHEN name = 'li' AND opens THEN 1 ELSE 0 END) OVER {run(', list')} AS number FROM l1),
    l3 AS (SELECT *, {last("CASE WHEN name = 'li' AND opens THEN {'pos': pos, 'kind': kind, 'number': number} END")} AS item, {gap} AS gap, text > 0 OR {image} AS content, {shown} AS shown FROM l2),
    l4 AS (SELECT *, sum((gap > 0)::INT) OVER {run()} AS line, max(CASE WHEN content THEN pos END) OVER (PARTITION BY page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM l3),
    l5 AS (SELECT *, sum(CASE WHEN name IN ('td', 'th') AND opens THEN 1 ELSE 0 END) OVER {run(', line')} AS cells FROM l4),
    l6 AS (SELECT page, line, max(gap) AS gap, max(cells) AS cells, string_agg({piece}, '' ORDER BY pos) AS text, arg_min({prefix}, pos) FILTER (content) AS prefix, arg_min(pre, pos) FILTER (content) AS pre, arg_min(CASE WHEN tables > 0 THEN tab ELSE -1 END, pos) FILTER (content) AS tab, bool_or(content) AS content FROM l5 GROUP BY page, line),
    l7 AS (SELECT *, count(*) FILTER (content) OVER (PARTITION BY page ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS block FROM l6),
    l8 AS (SELECT * FROM (SELECT * REPLACE (max(gap) OVER (PARTITION BY page, block) AS gap) FROM l7) WHERE content),
    l9 AS (SELECT *, min(CASE WHEN cells > 0 THEN line END) OVER (PARTITION BY page, tab) AS top FROM l8),
    l10 AS (SELECT page, line, gap, prefix || CASE WHEN pre THEN regexp_replace(regexp_replace(text, '^\n+|\\s+$', '', 'g'), '(?m)^', '    ', 'g') ELSE trim(regexp_replace(text, ' {{2,}}', ' ', 'g')) END || CASE WHEN tab >= 0 AND cells > 0 AND line = top THEN chr(10) || repeat('---|', cells::INT - 1) || '---' ELSE '' END AS text, row_number() OVER (PARTITION BY page ORDER BY line) AS r FROM l9),
    md AS (SELECT page, string_agg(CASE WHEN r = 1 THEN '' WHEN gap = 3 THEN chr(10) || chr(10) WHEN gap = 2 THEN chr(10) ELSE '  ' || chr(10) END || text, '' ORDER BY line) AS markdown FROM l10 GROUP BY page)"""


STRUCTURED = f"(SELECT page_id, url, coalesce(html, '') || {q(EXTRA)} AS html FROM pages)"
PLAIN_PAGES = "(SELECT page_id, url, replace(replace(html, '<article', '<div'), '</article', '</div') AS html FROM pages)"


@query("h8_markdown", f"WITH {_tokens(STRUCTURED)}, {_markdown('k8')} SELECT page_id, sha256(coalesce(markdown, '')) AS digest, length(coalesce(markdown, ''))::INT AS length FROM {STRUCTURED} LEFT JOIN md ON page = page_id")
def h8(spark: SparkSession, d: str) -> DataFrame:
    rows = pages(spark, d).select("page_id", F.concat(F.coalesce("html", F.lit("")), F.lit(EXTRA)).alias("html"))
    return pg.to_markdown(rows).select("page_id", F.sha2(F.col("markdown").cast("binary"), 256).alias("digest"), F.length("markdown").alias("length"))


_TITLE = f"trim(regexp_replace({_entities("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, {q(f'[{SPACE}]+')}, ' ', 'g'))"


def _article(table: str) -> str:
    titled = "CASE WHEN title = '' OR body = '' OR starts_with(body, '# ') THEN body ELSE '# ' || title || chr(10) || chr(10) || body END"
    return f"WITH {_tokens(table)}, {_main()}, {_markdown('kept')} SELECT page_id, sha256({titled}) AS digest, length({titled})::INT AS length FROM (SELECT page_id, {_TITLE} AS title, coalesce(markdown, '') AS body FROM {table} LEFT JOIN md ON page = page_id)"


def _readable(rows: DataFrame) -> DataFrame:
    return pg.to_markdown(rows, readable=True).select("page_id", F.sha2(F.col("markdown").cast("binary"), 256).alias("digest"), F.length("markdown").alias("length"))


@query("h9_article", _article("pages"))
def h9(spark: SparkSession, d: str) -> DataFrame:
    return _readable(pages(spark, d).select("page_id", "html"))


@query("h9_by_density", _article(PLAIN_PAGES))
def h9_by_density(spark: SparkSession, d: str) -> DataFrame:
    """Pages without an article element: the balance of text and links decides."""
    html = F.replace(F.replace("html", F.lit("<article"), F.lit("<div")), F.lit("</article"), F.lit("</div"))
    return _readable(pages(spark, d).select("page_id", html.alias("html")))


@query("h9_nodes", f"WITH {_tokens('pages')} SELECT page AS page_id, pos, name, depth::BIGINT AS depth, node_text::BIGINT AS node_text, node_thin::BIGINT AS node_thin, node_end::INT AS node_end FROM k8 WHERE node_end IS NOT NULL")
def h9_nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = pages(spark, d).select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("page"))
    return pg.nodes(pages(spark, d)).join(rows, "page").drop("page")
