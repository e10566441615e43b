"""Queries of text rules and of declared configuration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import asof, backfill, graphs, store
from ..operators import config as C
from ..operators import quotes as Q
from ..sources import strict as S
from ..streaming import flows as W
from .base import fx, query
from .scans import RUNS, runs
from .statement import LINES, VALUES

_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_URL = """concat(CASE WHEN page_id % 3 = 0 THEN replace(replace(url, 'https://', 'HTTPS://'), 'http://', 'Http://u:p@') ELSE url END, CASE page_id % 4
  WHEN 0 THEN '?api%4Bey=S1&ref=7&Access-Token=x#top' WHEN 1 THEN '/v2/secret_9?a=1&PASSWORD=p' WHEN 2 THEN '/0123456789abcdefghij_k/0x00112233445566778899aabbccddeeff00112233' ELSE '' END)"""


def _scrub_sql(u):
    """CTEs that scrub addresses: u has id and url; k gives id and clean."""
    return f"""
u AS ({u}), p AS (SELECT id, url, regexp_extract(url, '^((?i:https?|wss?)://)', 1) AS scheme, regexp_extract(url, '^(?i:https?|wss?)://(?:[^/?#@]*@)?([^/?#]*)', 1) AS host,
  list_filter(string_split(regexp_extract(url, '^(?i:https?|wss?)://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS seg, string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&') AS pars, regexp_matches(url, '^[^?#]*\\?') AS has FROM u),
q AS (SELECT *, list_filter(seg, lambda s, i: regexp_full_match(s, '0x([0-9a-fA-F]{{40}}|[0-9a-fA-F]{{64}})') OR NOT (
    (i = len(seg) AND i > 1 AND coalesce(regexp_full_match(seg[i - 1], 'v[0-9]+'), false) AND regexp_full_match(s, '[A-Za-z0-9_-]{{8,}}') AND regexp_matches(s, '[0-9_]'))
    OR regexp_full_match(s, '[A-Za-z0-9_-]{{20,}}') AND regexp_matches(s, '[0-9]'))) AS kept, list_filter(pars, lambda x: regexp_replace(lower(url_decode(string_split(x, '=')[1])), '[-_]', '', 'g') NOT IN {_LIST(T.SECRET_PARAMETERS)}) AS open FROM p),
r AS (SELECT *, CASE WHEN len(open) = len(pars) THEN open ELSE list_transform(open, lambda x: url_encode(url_decode(string_split(x, '=')[1])) || '=' || url_encode(url_decode(regexp_replace(x, '^[^=]*=?', '')))) END AS shown FROM q),
k AS (SELECT id, CASE WHEN scheme = '' THEN url ELSE lower(scheme) || lower(host) || '/' || array_to_string(kept, '/') || CASE WHEN has AND len(shown) > 0 THEN '?' || array_to_string(shown, '&') ELSE '' END END AS clean FROM r)"""


@query("scrub_urls", _scrub_sql(f"SELECT page_id AS id, {_URL} AS url FROM pages") + " --- SELECT id AS page_id, clean AS url FROM k")
def scrub_urls(spark, sf):
    return fx(spark, sf, "pages").selectExpr("page_id", f"{_URL} AS url").select("page_id", T.scrubbed(F.col("url")).alias("url"))


@query("scrub_locators", _scrub_sql(f"SELECT page_id AS id, {_URL} AS url FROM pages") + """ ---
SELECT id AS page_id, concat('{"endpoint":"', clean, '","headers":{},"auth":"","token":"kept","params":[{"note":"see ', clean, ' twice ', clean, '","n":', id, '}]}') AS shown FROM k""")
def scrub_locators(spark, sf):
    """Locators with addresses at several depths, secret entries, headers and auth."""
    url = F.expr(_URL)
    parts = ['{"endpoint":"', url, '","headers":{"x":"', url, '"},"auth":"a","Api-Key":"k","token":"kept","params":[{"note":"see ', url, " twice ", url, '","n":', F.col("page_id").cast("string"), ',"private_key":["', url, '"]}]}']
    locator = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    return fx(spark, sf, "pages").select("page_id", T.scrubbed_locator(locator).alias("shown"))


@query("reading_detail", """SELECT event_id, concat('{"k":', json_extract_string(props, '$.k'), ',"source":"', event_type, '","list":[1,true,null],"deep":{"day":"d', user_id, '","n":[', user_id, ']}}') AS shown FROM events""")
def reading_detail(spark, sf):
    """Texts that are not ours are dropped at any depth."""
    e = fx(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    parts = ['{"k":', k, ',"error":"<b>', F.col("event_type"), '</b>","source":"', F.col("event_type"), '","list":[1,"a",true,null],"deep":{"day":"d', F.col("user_id"), '","note":"x","n":["', k, '",', F.col("user_id"), "]}}"]
    detail = F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return e.select("event_id", T.reading_of(detail).alias("shown"))


_INLINE = "|".join(T.INLINE_TAGS)
_SPLIT = "'\n[ \t\r]*\n'"


def _plain(x):
    """SQL of a text without tags, entities, typographic marks and runs of white space."""
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    x = rf"regexp_replace({x}, '!?\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\([^\s()]*(?:\([^\s()]*\)[^\s()]*)*\)', '\1', 'g')"
    x = f"replace({x}, '&#233;', 'é')"
    for entity, character in T.ENTITIES.items():
        x = f"regexp_replace({x}, '(?i)&{entity};', '{character.replace(chr(39), chr(39) * 2)}', 'g')"
    x = f"translate({x}, '‘’‚′“”„″‐‑‒–—―−', '{chr(39) * 8}\"\"\"\"-------')"
    return rf"trim(regexp_replace({x}, '[\s\x{{00A0}}]+', ' ', 'g'))"


#: bl: page_id, block of the real pages, whose é are written as numeric entities; wh: page_id, url and the whole plain text.
_BLOCKS = rf"""
pg AS (SELECT page_id, url, html, regexp_replace(replace(html, 'é', '&#233;'), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', chr(10) || chr(10), 'g') AS body FROM pages),
c1 AS (SELECT page_id, unnest(range(1, len(x) + 1)) AS c, unnest(x) AS chunk FROM (SELECT page_id, regexp_split_to_array(body, {_SPLIT}) AS x FROM pg)),
c2 AS (SELECT page_id, c, regexp_replace(regexp_replace(chunk, '\s+', ' ', 'g'), '(?i)<(/?(?:{_INLINE})(?:[^a-z0-9>-][^>]*)?)>', chr(1) || '\1' || chr(2), 'g') AS x FROM c1),
c3 AS (SELECT page_id, c, translate(regexp_replace(regexp_replace(x, '(?i)</?br(?:[^a-z0-9>-][^>]*)?>', chr(10), 'g'), '(?i)</?[a-z][a-z0-9-]*\b[^>]*>', chr(10) || chr(10), 'g'), chr(1) || chr(2), '<>') AS x FROM c2),
c4 AS (SELECT page_id, c, unnest(range(1, len(x) + 1)) AS h, unnest(x) AS part FROM (SELECT page_id, c, regexp_split_to_array(x, {_SPLIT}) AS x FROM c3)),
c5 AS (SELECT page_id, c, h, unnest(range(1, len(x) + 1)) AS l, unnest(x) AS line FROM (SELECT page_id, c, h, string_split(part, chr(10)) AS x FROM c4)),
c6 AS (SELECT page_id, c, h, l, {_plain("line")} AS line FROM c5),
c7 AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[a-z]') THEN 0 ELSE 1 END) OVER (PARTITION BY page_id, c, h ORDER BY l) AS g FROM c6 WHERE line <> ''),
bl AS (SELECT page_id, string_agg(line, ' ' ORDER BY l) AS block FROM c7 GROUP BY page_id, c, h, g),
wh AS (SELECT page_id, url, {_plain("body")} AS whole FROM pg)"""


def _pages(spark, sf):
    """Pages as texts. Python takes them in batches of 1,000 in a session that has Spark's default: a page may be long."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return fx(spark, sf, "pages").selectExpr("page_id", "url", "html", "replace(html, 'é', '&#233;') as text")


@query("page_blocks", _BLOCKS + " --- SELECT page_id, block FROM bl")
def page_blocks(spark, sf):
    """The blocks of the whole pages."""
    return Q.page_pieces(_pages(spark, sf), "page_id").select("page_id", F.col("text").alias("block"))


_AD = "regexp_extract(html, '<div class=\"ad\">([^<]*)<', 1)"
_QUOTES = f"""
SELECT page_id AS quote_id, CASE page_id % 5 WHEN 4 THEN concat(url, '/nowhere') WHEN 3 THEN concat(replace(url, 'http', 'HTTP'), '#part') ELSE url END AS url,
  CASE page_id % 5 WHEN 1 THEN concat(regexp_extract(html, '<h1>([^<]*)<', 1), ' ', substr(regexp_extract(html, '<p><b>([^<]*)<', 1), 1, 30)) WHEN 2 THEN substr({_AD}, 1, 15) WHEN 3 THEN lead({_AD}) OVER (ORDER BY page_id) ELSE {_AD} END AS quote
FROM {{pages}}"""
_NEXT = f"lead({_AD}) OVER (ORDER BY page_id)"


def _quotes(spark, pages):
    """The rows of _QUOTES; the next page's advertisement is found in ranges of pages, not in one window over all."""
    marks = pages.select("page_id", F.struct(F.expr(_AD).alias("ad")).alias("m")).repartitionByRange("page_id").withColumn("part", F.spark_partition_id())
    marks = W.saved(marks, spark, "page-marks")
    firsts = marks.groupBy("part").agg(F.min_by("m", "page_id").alias("m"))
    behind = firsts.select("part", F.lead("m").over(Window.orderBy("part")).alias("behind"))  # a row for each range
    next_ = F.coalesce(F.lead("m").over(Window.partitionBy("part").orderBy("page_id")), F.col("behind"))["ad"]
    following = marks.join(behind, "part").select("page_id", next_.alias("next_ad")).where("page_id % 5 = 3")
    rows = pages.join(following.hint("merge"), "page_id", "left")
    return spark.sql(_QUOTES.replace(_NEXT, "next_ad"), pages=rows).withColumn("quote", F.coalesce("quote", F.lit("")))


_NURL = "regexp_replace(lower(regexp_extract(url, '^[^:]*://[^/?#]*')) || regexp_replace(regexp_replace(url, '^[^:]*://[^/?#]*', ''), '#.*', ''), '/$', '')"


@query("quote_verdicts", _BLOCKS + f""",
qs AS ({_QUOTES.replace("{pages}", "pages")}), qp AS (SELECT quote_id, {_NURL} AS u, {_plain("coalesce(quote, '')")} AS quote FROM qs), pu AS (SELECT page_id, whole, {_NURL} AS u FROM wh)
---
SELECT quote_id, CASE WHEN length(quote) < 20 THEN 'quote_too_short' WHEN NOT EXISTS (SELECT 1 FROM pu WHERE pu.u = qp.u) THEN 'not_fetched' WHEN EXISTS (SELECT 1 FROM pu JOIN bl USING (page_id) WHERE pu.u = qp.u AND contains(block, quote)) THEN 'found'
  WHEN EXISTS (SELECT 1 FROM pu WHERE pu.u = qp.u AND contains(whole, quote)) THEN 'quote_spans_blocks' ELSE 'quote_not_found' END AS verdict FROM qp""")
def quote_verdicts(spark, sf):
    """Quotes of each page's own words, spliced from two blocks, too short, of another page, and of a page not fetched."""
    return Q.cited(_quotes(spark, fx(spark, sf, "pages")), _pages(spark, sf).select("url", "text"))


@query("quote_places", _BLOCKS + f""",
qs AS (SELECT min(page_id) AS quote_id, quote FROM (SELECT page_id, {_plain(_AD)} AS quote FROM pages) WHERE length(quote) >= 20 GROUP BY quote)
---
SELECT quote_id, page_id, count(*) AS n FROM qs JOIN bl ON contains(block, quote) GROUP BY quote_id, page_id""")
def quote_places(spark, sf):
    """Every advertisement's words, looked for in the blocks of all pages."""
    pages = _pages(spark, sf)
    quotes = pages.select("page_id", T.plain_text(F.expr(_AD)).alias("quote")).where("char_length(quote) >= 20").groupBy("quote").agg(F.min("page_id").alias("quote_id"))
    pieces = W.saved(Q.page_pieces(pages, "page_id"), spark, "pieces")
    return Q.found_in(W.saved(quotes, spark, "quotes"), pieces, "page_id").groupBy("quote_id", "page_id").agg(F.count("*").alias("n"))


_LINE = "concat('[', lpad(CAST(turn AS VARCHAR(9)), 2, '0'), ':00] ', replace(text, chr(10), ' '))"


@query("transcript_quotes", f"""
sg AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, turn, replace(text, chr(10), ' ') AS t FROM conversations),
x AS (SELECT conv_id, max(t) FILTER (WHERE i = 0) AS t0, max(t) FILTER (WHERE i = 1) AS t1, max(t) FILTER (WHERE i = 2) AS t2, max(t) FILTER (WHERE i = 3) AS t3, string_agg(t, ' ' ORDER BY i) AS whole FROM sg GROUP BY conv_id),
q AS (SELECT conv_id, {_plain("whole")} AS whole, {_plain("coalesce(CASE conv_id % 4 WHEN 0 THEN right(t0, 25) || ' ' || left(t1, 25) WHEN 1 THEN left(t1, 60) WHEN 2 THEN right(t0, 9) || ' ' || t1 || ' ' || t2 || ' ' || left(t3, 9) ELSE '[01:00] ' || left(t1, 30) END, '')")} AS quote FROM x),
w AS (SELECT conv_id, turn, i, unnest([1, 2, 3]) AS n, unnest([t, concat(t, ' ', lead(t) OVER v), concat(t, ' ', lead(t) OVER v, ' ', lead(t, 2) OVER v)]) AS t, unnest([true, lead(t) OVER v IS NOT NULL, lead(t, 2) OVER v IS NOT NULL]) AS ok FROM sg WINDOW v AS (PARTITION BY conv_id ORDER BY i)),
f AS (SELECT q.conv_id, arg_min(w.turn, struct_pack(n := n, i := i)) AS turn FROM q JOIN (SELECT conv_id, turn, i, n, {_plain("t")} AS t FROM w WHERE ok) w ON w.conv_id = q.conv_id AND contains(w.t, q.quote) WHERE length(q.quote) >= 20 GROUP BY q.conv_id)
---
SELECT q.conv_id AS quote_id, CASE WHEN length(quote) < 20 THEN 'quote_too_short' WHEN f.conv_id IS NOT NULL THEN 'found' WHEN contains(whole, quote) THEN 'quote_spans_blocks' ELSE 'quote_not_found' END AS verdict,
  CASE WHEN f.conv_id IS NOT NULL THEN concat(lpad(CAST(f.turn AS VARCHAR), 2, '0'), ':00') END AS locator FROM q LEFT JOIN f USING (conv_id)""")
def transcript_quotes(spark, sf):
    """Quotes over one, two and four segments of each conversation, and one that copies a stamp."""
    turns = fx(spark, sf, "conversations").withColumn("t", F.expr("replace(text, chr(10), ' ')"))
    line = F.expr(_LINE)
    lists = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line"), "t"))).alias("s"))  # a conversation's turns
    t = lambda i: f"get(s, {i}).t"
    quote = f"coalesce(case conv_id % 4 when 0 then concat(right({t(0)}, 25), ' ', left({t(1)}, 25)) when 1 then left({t(1)}, 60) when 2 then concat(right({t(0)}, 9), ' ', {t(1)}, ' ', {t(2)}, ' ', left({t(3)}, 9)) else concat('[01:00] ', left({t(1)}, 30)) end, '')"
    lists = W.saved(lists.selectExpr("conv_id", "array_join(transform(s, x -> x.line), '\n') as text", f"{quote} as quote"), spark, "transcripts")
    return Q.cited_transcripts(lists.selectExpr("conv_id as quote_id", "conv_id as doc_id", "quote"), lists.selectExpr("conv_id as doc_id", "text"))


_SOURCES = "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'measured' WHEN 1 THEN 'derived' ELSE 'disclosed' END AS method, CASE user_id % 6 WHEN 0 THEN 'log_scan' WHEN 1 THEN 'contract_state' WHEN 2 THEN 'third_party' WHEN 3 THEN 'constant' WHEN 4 THEN 'first_party_api' ELSE 'pool_scan' END AS source_type, CASE WHEN event_id % 5 = 0 THEN 'chain.supply' WHEN event_id % 5 = 1 THEN 'api.book' END AS adapter, CASE WHEN event_id % 7 = 0 THEN 'manual_sum' WHEN event_id % 7 = 1 THEN 'ratio' END AS formula, CASE WHEN event_id % 11 = 0 THEN 'api' END AS input_origin FROM fx_events"


@query("value_origins", f"""
s AS ({_SOURCES})
---
SELECT event_id, CASE WHEN method = 'disclosed' THEN CASE WHEN source_type = 'constant' OR adapter IS NOT NULL THEN 'api' ELSE 'manual' END
  WHEN method = 'derived' THEN CASE WHEN formula = 'manual_sum' THEN 'manual' WHEN input_origin = 'api' OR source_type = 'third_party' THEN 'api' ELSE 'onchain' END
  WHEN source_type IN ('log_scan', 'pool_scan') THEN 'onchain' WHEN source_type = 'contract_state' AND coalesce(adapter, '') <> 'api.book' THEN 'onchain' ELSE 'api' END AS origin FROM s""")
def value_origins(spark, sf):
    s = spark.sql(_SOURCES.replace("fx_events", "{e}"), e=fx(spark, sf, "fx_events"))
    elsewhere = F.when(F.col("adapter") == "api.book", "api")  # what the adapters declare
    return s.select("event_id", T.origin(F.col("method"), F.col("source_type"), F.col("adapter"), elsewhere, F.col("formula"), F.col("input_origin")).alias("origin"))


_KINDS = "CASE page_id % 5 WHEN 0 THEN 'adapter' WHEN 1 THEN 'http_json' WHEN 2 THEN 'coingecko' WHEN 3 THEN 'contract_read' END"


@query("source_labels", f"""SELECT page_id, concat('third_party:', CASE WHEN {_KINDS} IS NULL THEN 'manual' WHEN {_KINDS} = 'adapter' THEN 'feed.x' WHEN {_KINDS} = 'http_json' THEN regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) ELSE {_KINDS} END) AS label,
  CASE WHEN {_KINDS} = 'coingecko' THEN 'coingecko' WHEN {_KINDS} = 'contract_read' THEN 'chain_levels' ELSE concat({_KINDS}, ':', 'n', page_id) END AS source_id FROM pages WHERE {_KINDS} IS NOT NULL
UNION ALL SELECT page_id, 'third_party:manual', NULL FROM pages WHERE {_KINDS} IS NULL""")
def source_labels(spark, sf):
    s = fx(spark, sf, "pages").selectExpr("page_id", "url", f"{_KINDS} AS kind")
    number = F.concat(F.lit("n"), F.col("page_id").cast("string"))
    return s.select("page_id", T.source_label(F.lit("third_party"), F.col("kind"), F.lit("feed.x"), F.col("url")).alias("label"), T.source_id(F.col("kind"), number).alias("source_id"))


@query("price_closure", """
e AS (SELECT CAST(p_partkey AS BIGINT) AS node, CASE WHEN p_partkey = 1 THEN 4 WHEN p_partkey > 10 THEN p_partkey // 3 WHEN p_partkey = 4 THEN 1 END AS input FROM part),
r AS (SELECT DISTINCT p_brand AS origin, CAST(p_partkey AS BIGINT) AS node FROM part WHERE p_size = 50 UNION SELECT r.origin, e.input FROM r JOIN e ON e.node = r.node WHERE e.input IS NOT NULL)
---
SELECT origin, node FROM r""")
def price_closure(spark, sf):
    """The entries that each brand's parts lean on, over any number of quotes; two entries quote each other."""
    part = fx(spark, sf, "part")
    start = part.where("p_size = 50").select(F.col("p_brand").alias("origin"), F.col("p_partkey").cast("long").alias("node"))
    return C.closure(spark, start, part.selectExpr("cast(p_partkey as bigint) as node", "cast(case when p_partkey = 1 then 4 when p_partkey > 10 then p_partkey div 3 when p_partkey = 4 then 1 end as bigint) as input"))


_LEANS = "SELECT CAST(p_partkey AS BIGINT) AS node, CAST(CASE WHEN p_partkey = 1 THEN 13 WHEN p_partkey > 10 THEN {third} WHEN p_partkey = 4 THEN 1 WHEN p_partkey = 9 THEN 9 WHEN p_partkey = 8 THEN 4 END AS BIGINT) AS input FROM {part}"


@query("circular_metrics", f"""
e AS ({_LEANS.format(third="p_partkey // 3", part="part")}), r AS (SELECT node AS origin, input AS node FROM e WHERE input IS NOT NULL UNION SELECT r.origin, e.input FROM r JOIN e USING (node) WHERE e.input IS NOT NULL)
---
SELECT node FROM r WHERE origin = node""")
def circular_metrics(spark, sf):
    """1 leans on 13, 13 on 4 and 4 on 1, and 9 on itself; the others only on these."""
    return graphs.circular(spark, spark.sql(_LEANS.format(third="p_partkey div 3", part="{part}"), part=fx(spark, sf, "part")))


_CFG = f"cfg(line, section, kind, metric, weight, bucket, haircut, base, by_metric, over_metric, rr) AS (VALUES {VALUES})"


@query("listing_bar", f"""
{_CFG}, t AS (SELECT metric, CASE min(id) % 3 WHEN 0 THEN 'log_scan' WHEN 1 THEN 'third_party' ELSE 'contract_state' END AS source_type FROM fx_stmt_daily GROUP BY metric),
x AS (SELECT line, m, i FROM (SELECT line, list_filter([metric, by_metric, over_metric], lambda m: m IS NOT NULL) AS ms FROM cfg WHERE section IN ('revenue', 'holders', 'below')), (SELECT unnest([1, 2, 3]) AS i), LATERAL (SELECT CASE WHEN len(ms) = 0 AND i = 1 THEN NULL ELSE ms[i] END AS m, len(ms) AS n) WHERE i <= n OR n = 0 AND i = 1)
---
SELECT line, arg_min(coalesce(source_type, '-'), i) AS source_type FROM x LEFT JOIN t ON t.metric = x.m WHERE x.m IS NULL OR source_type = 'third_party' GROUP BY line""")
def listing_bar(spark, sf):
    lines = spark.createDataFrame([(r[0], [m for m in (r[3], r[8], r[9]) if m]) for r in LINES if r[1] in ("revenue", "holders", "below")], "line string, metrics array<string>")
    types = fx(spark, sf, "fx_stmt_daily").groupBy("metric").agg(F.min("id").alias("id")).selectExpr("metric", "case id % 3 when 0 then 'log_scan' when 1 then 'third_party' else 'contract_state' end as source_type")
    return C.failing_lines(lines, types, ["log_scan", "contract_state"]).withColumn("source_type", F.coalesce("source_type", F.lit("-")))


@query("statement_metrics", f"{_CFG} --- SELECT metric FROM cfg WHERE metric IS NOT NULL UNION SELECT by_metric FROM cfg WHERE by_metric IS NOT NULL UNION SELECT over_metric FROM cfg WHERE over_metric IS NOT NULL")
def statement_metrics(spark, sf):
    lines = spark.createDataFrame([(r[3], r[8], r[9]) for r in LINES], "metric string, by_metric string, over_metric string")
    return C.named_metrics(lines, "metric", "by_metric", "over_metric")


_DEFS = "SELECT p_name AS metric, p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'level' WHEN 1 THEN 'schedule' WHEN 2 THEN 'flow' ELSE 'event' END AS kind, CASE p_partkey % 5 WHEN 0 THEN 'derived' WHEN 1 THEN 'constant' WHEN 2 THEN NULL ELSE 'adapter' END AS source, p_partkey % 3 = 0 AS monitor_only, p_partkey % 2 = 0 AS watched FROM part"


@query("hourly_metrics", f"SELECT metric FROM ({_DEFS}) WHERE kind IN ('level', 'schedule') AND source = 'adapter' AND (NOT monitor_only OR watched)")
def hourly_metrics(spark, sf):
    return C.level_metrics(spark.sql(_DEFS.replace("FROM part", "FROM {p}"), p=fx(spark, sf, "part")))


@query("config_scan", """
b AS (SELECT c_nationkey, CASE WHEN c_nationkey % 7 = 3 THEN 'not json' ELSE concat('{"id":"n', c_nationkey, '","lines":[', string_agg(c_custkey, ',' ORDER BY c_custkey), ']}') END AS body FROM customer GROUP BY c_nationkey)
---
SELECT CASE WHEN c_nationkey % 7 <> 3 THEN concat('n', c_nationkey) END AS id, CASE WHEN c_nationkey % 7 <> 3 THEN json_array_length(json_extract(body, '$.lines'))::INTEGER END AS n, sha256(body || chr(10)) AS digest, CASE WHEN c_nationkey % 7 = 3 THEN 'not of the schema' END AS fault FROM b""")
def config_scan(spark, sf):
    """Config files are written, read back whole, parsed against their schema and hashed."""
    ids = fx(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_custkey")).alias("lines"))  # a file's lines
    body = F.when(F.col("c_nationkey") % 7 == 3, "not json").otherwise(F.to_json(F.struct(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("id"), "lines")))
    folder = W.shared_folder(spark, "config")
    ids.select(body.alias("body")).write.option("maxRecordsPerFile", 1).text(folder)
    found = C.read_config(spark, folder, "id string, lines array<bigint>")
    return found.select("config.id", F.when(F.col("config.id").isNotNull(), F.size("config.lines")).alias("n"), "digest", "fault")


@query("market_rows", "SELECT c_custkey AS id, c_acctbal AS price, CASE WHEN c_acctbal > 0 THEN c_acctbal * 2 END AS supply FROM customer")
def market_rows(spark, sf):
    """Values by id from one reply for all of a nation."""
    c = fx(spark, sf, "customer")
    row = F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_acctbal").alias("current_price"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") * 2).alias("total_supply"))
    bodies = c.groupBy("c_nationkey", F.expr("c_custkey div 250")).agg(F.to_json(F.collect_list(row)).alias("body"))  # 250 ids in a reply at most
    found = bodies.select(F.explode(C.market_values(F.col("body"))).alias("r"))
    return found.select(F.col("r.id").cast("long").alias("id"), F.col("r.current_price").alias("price"), F.col("r.total_supply").alias("supply"))


@query("tokens_by_ids", "SELECT id, token_ref, amount FROM fx_flow_rows WHERE id IN (SELECT event_id FROM fx_events WHERE v > 50)")
def tokens_by_ids(spark, sf):
    wanted = fx(spark, sf, "fx_events").where("v > 50").select(F.col("event_id").alias("id"))
    return fx(spark, sf, "fx_flow_rows").join(wanted, "id", "left_semi").select("id", "token_ref", "amount")


@query("constant_levels", "SELECT DISTINCT asset_id, metric_key, 12.5::DOUBLE AS value, DATE '2024-02-01' AS observed FROM fx_readings")
def constant_levels(spark, sf):
    return fx(spark, sf, "fx_readings").select("asset_id", "metric_key").distinct().select("asset_id", "metric_key", F.lit(12.5).alias("value"), F.lit("2024-02-01").cast("date").alias("observed"))


@query("move_pct", "SELECT id, CASE WHEN p <> 0 THEN round((value - p) / p * 100, 4) END AS pct FROM (SELECT id, value, (SELECT value FROM fx_readings b WHERE b.asset_id = a.asset_id AND b.metric_key = a.metric_key AND b.hour < a.hour ORDER BY b.hour DESC, b.id DESC LIMIT 1) AS p FROM fx_readings a)")
def move_pct(spark, sf):
    return asof.previous(fx(spark, sf, "fx_readings"), "asset_id", "metric_key").select("id", V.move_pct(F.col("value"), F.col("previous")).alias("pct"))


@query("input_units", "SELECT user_id, sum(10 * event_id + 12.5::DOUBLE * hour + user_id) AS tenths FROM fx_events GROUP BY user_id")
def input_units(spark, sf):
    return fx(spark, sf, "fx_events").groupBy("user_id").agg(F.sum(V.input_tenths(F.col("event_id"), F.col("hour"), F.col("user_id"))).alias("tenths"))


@query("slots", "SELECT event_id, hour - hour % 6 AS newest, hour - hour % 6 + 6 AS upcoming FROM fx_events")
def slots(spark, sf):
    return fx(spark, sf, "fx_events").select("event_id", V.newest_slot(F.col("hour"), 6).alias("newest"), (V.newest_slot(F.col("hour"), 6) + 6).alias("upcoming"))


@query("same_rows", "SELECT true AS same, false AS fewer")
def same_rows(spark, sf):
    """A table against its rows in another order, and against its distinct rows."""
    rows = fx(spark, sf, "orders").select("o_orderstatus", "o_orderpriority")
    other = fx(spark, sf, "orders").orderBy("o_totalprice").select("o_orderstatus", "o_orderpriority")
    return spark.createDataFrame([(store.same_multiset(rows, other), store.same_multiset(rows, rows.distinct()))], "same boolean, fewer boolean")


@query("source_status", f"""
r AS (SELECT e.event_type AS asset, e.hour AS run, e.user_id % 5 AS metric, x.id, x.status FROM ({RUNS}) x JOIN fx_events e ON e.event_id = x.id), n AS (SELECT asset, run FROM (SELECT asset, run, row_number() OVER (PARTITION BY asset ORDER BY run DESC) AS k FROM (SELECT DISTINCT asset, run FROM r)) WHERE k <= 20)
---
SELECT asset, metric, arg_max(status, id) AS status, max(run) AS run FROM r JOIN n USING (asset, run) GROUP BY asset, metric""")
def source_status(spark, sf):
    """How the last fetch of each source went, among each asset's 20 newest runs."""
    entries = runs(spark, sf).join(fx(spark, sf, "fx_events").select(F.col("event_id").alias("id"), F.col("event_type").alias("asset"), F.col("hour").alias("run"), (F.col("user_id") % 5).alias("metric")), "id")
    return backfill.newest_runs(entries, 20, "asset", "run").groupBy("asset", "metric").agg(F.max_by("status", "id").alias("status"), F.max("run").alias("run"))


@query("growth_weighted", """
d AS (SELECT day, sum(value * CASE metric WHEN '1' THEN 1 ELSE 0.5::DOUBLE END) AS v, count(*) AS n FROM fx_daily WHERE metric IN ('1', '2') GROUP BY day),
w AS (SELECT x.day, (SELECT CASE WHEN count(*) = 3 THEN sum(v) END FROM d y WHERE n = 2 AND y.day > x.day - 3 AND y.day <= x.day) AS cur, (SELECT CASE WHEN count(*) = 3 THEN sum(v) END FROM d y WHERE n = 2 AND y.day > x.day - 6 AND y.day <= x.day - 3) AS pri FROM d x WHERE n = 2)
---
SELECT day, round(cur, 6) AS "current", round(pri, 6) AS prior, round(CASE WHEN pri > 0 THEN cur / pri - 1 END, 9) AS change FROM w""")
def growth_weighted(spark, sf):
    """Growth of several series taken together, each with its weight; a day that misses one is missing."""
    from ..operators import series

    weight = F.when(F.col("metric") == "1", 1.0).otherwise(0.5)
    days = fx(spark, sf, "fx_daily").where("metric in ('1', '2')").groupBy("day").agg(F.sum(F.col("value") * weight).alias("value"), F.count("*").alias("n")).where("n = 2")
    g = series.growth(days.withColumn("all", F.lit(0)), 3, "all")
    return g.select("day", F.round("current", 6).alias("current"), F.round("prior", 6).alias("prior"), F.round("change", 9).alias("change"))


@query("tx_refs_digest", """
SELECT token, sink, day, count(*) AS n, sha256('["' || string_agg(CAST(transfer_id AS VARCHAR), '","' ORDER BY CAST(transfer_id AS VARCHAR)) || '"]') AS digest FROM fx_transfers GROUP BY token, sink, day""")
def tx_refs_digest(spark, sf):
    """SHA-256 of the ordered list of a day's references, as a stored day row keeps it; refs of one day and sink."""
    from ..operators import scan

    return scan.day_digest(fx(spark, sf, "fx_transfers"), "transfer_id", "token", "sink", "day").select("token", "sink", "day", "n", "digest")


@query("canonical_digest", """SELECT event_id, sha256(concat('{"a":[', user_id, ',{"x":true,"y":null}],"k":', json_extract_string(props, '$.k'), ',"z":"', event_type, '"}')) AS digest FROM events""")
def canonical_digest(spark, sf):
    e = fx(spark, sf, "events")
    parts = ['{ "z": "', F.col("event_type"), '", "k": ', F.get_json_object("props", "$.k"), ', "a": [', F.col("user_id").cast("string"), ', {"y": null, "x": true}]}']
    return e.select("event_id", F.sha2(T.canonical_json(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))), 256).alias("digest"))


#: Lines with a fault each: line, section, metric, level, not_measured, weight, by_metric, over_metric.
FAULTY = [
    ("good", "revenue", "a", None, None, 1.0, None, None), ("again", "revenue", "b", None, None, 0.5, None, None), ("again", "holders", "b", None, None, 0.5, None, None),
    ("none", "revenue", None, None, None, None, None, None), ("both", "holders", "a", "lv", None, 1.0, None, None), ("ghost", "holders", "nowhere", None, None, 1.0, None, None),
    ("ratio", "holders", "r", None, None, 1.0, None, None), ("flat", "below", None, "a", None, None, None, None), ("twin", "revenue", "a", None, None, 1.5, None, None),
    ("p1", "holders", "c", None, None, 1.0, "t1", "t"), ("p2", "holders", "c", None, None, 1.0, "t2", "t"), ("q1", "holders", "d", None, None, 1.0, "t1", "t"), ("blank", "below", None, None, True, None, None, None),
]


@query("line_issues", """
SELECT * FROM (VALUES ('again', 'id is not unique'), ('none', 'needs one source of its value'), ('both', 'needs one source of its value'), ('ghost', 'metric is not declared'), ('ratio', 'metric is no flow in usd'),
  ('flat', 'level is no level'), ('twin', 'series is read twice'), ('twin', 'weight outside (0, 1]'), ('q1', 'parts do not make up the total')) v(line, issue)""")
def line_issues(spark, sf):
    lines = spark.createDataFrame(FAULTY, "line string, section string, metric string, level string, not_measured boolean, weight double, by_metric string, over_metric string")
    metrics = spark.createDataFrame([(m, "flow", "usd") for m in ("a", "b", "c", "d", "t", "t1", "t2")] + [("r", "ratio", None), ("lv", "level", "usd")], "metric string, kind string, unit string")
    parts = spark.createDataFrame([("t", "t1"), ("t", "t2")], "total string, part string")
    return C.line_issues(lines, metrics, parts)


#: The schema of the derived config files.
RULES = [
    S.Rule("", "object"), S.Rule("id", "string", True, pattern="^n[0-9]+$"), S.Rule("chain", "string", choices=("a", "b")), S.Rule("metrics", "object", True, fewest=1),
    S.Rule("metrics.*", "object"), S.Rule("metrics.*.type", "string", True, choices=("flow", "level")), S.Rule("metrics.*.unit", "string", True), S.Rule("metrics.*.share", "number", low=0.0, high=1.0),
    S.Rule("metrics.*.inputs", "list", fewest=1), S.Rule("metrics.*.inputs[]", "string|integer"),
]
_FACTS = "SELECT c_custkey, c_nationkey, c_custkey % 13 = 0 AS typed, c_custkey % 17 = 0 AS odd, c_custkey % 19 <> 0 AS has_unit, floor(c_acctbal) / 8192 AS share, c_custkey % 23 = 0 AS bare, c_custkey % 29 = 0 AS other FROM {customer}"


@query("strict_config", f"""
f AS ({_FACTS.replace("{customer}", "customer")}), g AS (SELECT concat('n', c_nationkey) AS name, concat('metrics.m', c_custkey) AS p, * FROM f), b AS (SELECT c_nationkey, max(c_acctbal) < 9990 AS low FROM customer GROUP BY c_nationkey)
---
SELECT name, p || '.type' AS path, 'is not string' AS issue FROM g WHERE typed UNION ALL SELECT name, p || '.units', 'is not known' FROM g WHERE odd UNION ALL SELECT name, p || '.unit', 'is missing' FROM g WHERE NOT has_unit
UNION ALL SELECT name, p || '.share', 'is out of bounds' FROM g WHERE share < 0 OR share > 1 UNION ALL SELECT name, p || '.inputs', 'has too few entries' FROM g WHERE bare
UNION ALL SELECT name, p || '.inputs[1]', 'is not string or integer' FROM g WHERE other AND NOT bare UNION ALL SELECT name, p || '.type', 'is none of flow, level' FROM g WHERE c_custkey % 31 = 0 AND NOT typed
UNION ALL SELECT concat('n', c_nationkey), 'chain', 'is none of a, b' FROM b WHERE low UNION ALL SELECT concat('n', c_nationkey), 'id', 'has another form' FROM b WHERE c_nationkey % 7 = 3""")
def strict_config(spark, sf):
    """A config file for each nation, JSON and YAML, with a metric for each of its customers, some of them faulty."""
    rows = spark.sql(_FACTS, customer=fx(spark, sf, "customer"))
    kind = F.when(F.col("typed"), F.lit("7")).when(F.col("c_custkey") % 31 == 0, F.lit('"ratio"')).otherwise(F.lit('"flow"'))
    unit = F.when(F.col("has_unit"), F.lit(',"unit":"usd"')).otherwise("")
    inputs = F.when(F.col("bare"), F.lit("[]")).when(F.col("other"), F.lit('["a",true]')).otherwise(F.lit('["a",3]'))
    metric = F.concat(F.lit('"m'), "c_custkey", F.lit('":{"type":'), kind, unit, F.when(F.col("odd"), F.lit(',"units":"eur"')).otherwise(""), F.lit(',"share":'), "share", F.lit(',"inputs":'), inputs, F.lit("}"))
    files = rows.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list(metric)), ",").alias("metrics"))  # a file's
    chains = fx(spark, sf, "customer").groupBy("c_nationkey").agg(F.when(F.max("c_acctbal") < 9990, "x").otherwise("a").alias("chain"))
    own = F.when(F.col("c_nationkey") % 7 == 3, "who").otherwise(F.concat(F.lit("n"), "c_nationkey"))
    text = F.concat(F.lit('{"id":"'), own, F.lit('","chain":"'), "chain", F.lit('","metrics":{'), "metrics", F.lit("}}"))
    text = F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("# a note\n"), text)).otherwise(text)  # JSON with a comment is YAML
    files = files.join(chains, "c_nationkey").select(F.concat(F.lit("n"), "c_nationkey").alias("name"), F.when(F.col("c_nationkey") % 2 == 0, "yaml").otherwise("json").alias("form"), text.alias("text"))
    return S.issues(W.saved(S.parsed(files), spark, "configs"), RULES)


@query("partition_proofs", """
l AS (SELECT c_nationkey AS asset, c_custkey AS line, c_mktsegment AS metric, concat('s', c_custkey % 4) AS "by", CASE WHEN c_custkey % 50 = 0 THEN 't2' ELSE 't1' END AS total FROM customer WHERE c_custkey % 3 = 0),
c AS (SELECT c_nationkey AS asset, list_sort(list(DISTINCT concat('s', c_custkey % 4))) AS parts, min(c_custkey) % 2 = 0 AS tight FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY c_nationkey),
s AS (SELECT asset, metric, count(DISTINCT total) AS totals, count(*) AS n, list_sort(list(DISTINCT "by")) AS parts, min(total) AS total FROM l GROUP BY asset, metric)
---
SELECT asset, metric, CASE WHEN totals > 1 THEN 'lines name different totals' WHEN len(s.parts) < n THEN 'a part is named twice' WHEN tight IS NULL THEN 'needs a sum check of its parts' ELSE 'its sum check must be daily and tight' END AS issue
FROM s LEFT JOIN c USING (asset, parts) WHERE totals > 1 OR len(s.parts) < n OR total <> 't1' OR tight IS NULL OR NOT tight""")
def partition_proofs(spark, sf):
    c = fx(spark, sf, "customer")
    part = F.concat(F.lit("s"), F.col("c_custkey") % 4)
    lines = c.where("c_custkey % 3 = 0").select(F.col("c_nationkey").alias("asset"), F.col("c_custkey").alias("line"), F.col("c_mktsegment").alias("metric"), part.alias("by"), F.when(F.col("c_custkey") % 50 == 0, "t2").otherwise("t1").alias("total"))
    checks = c.where("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("asset")).agg(F.collect_set(part).alias("parts"), F.when(F.min("c_custkey") % 2 == 0, 0.0).otherwise(0.5).alias("tolerance_pct"))  # four parts
    checks = checks.select("asset", F.lit("c").alias("check"), F.array(F.lit("t1")).alias("total"), "parts", F.lit(1).alias("window_days"), "tolerance_pct", F.lit(1.0).alias("tolerance_abs"))
    return S.partition_issues(lines, checks)
