"""Queries over single rows: URL, text, price, candidate and message columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import html as H, messages as M, text as TX, urls as U
from siftline.operators import evidence as EV, runs as R
from siftline.sources import files, tables as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _u():
    return F.col("url")

# --- URLs -----------------------------------------------------------------------------------------
# SQL helpers: authority, path and query of a URL cut with plain string functions.
_SPLIT = """
SELECT *, coalesce(url, '') AS u,
  CASE WHEN contains(coalesce(url,''), '://') THEN regexp_extract(url, '^[^/?#]*://([^/?#]*)', 1) ELSE '' END AS auth,
  CASE WHEN contains(coalesce(url,''), '://') THEN regexp_extract(url, '^[^/?#]*://[^/?#]*([^?#]*)', 1)
       ELSE regexp_extract(coalesce(url,''), '^([^?#]*)', 1) END AS rawpath,
  CASE WHEN contains(coalesce(url,''), '?') THEN split_part(substr(url, strpos(url, '?') + 1), '#', 1) ELSE '' END AS q
FROM {src}"""
_PATHS = """SELECT *, regexp_replace(rawpath, ';[^/]*$', '') AS path FROM split"""


def _url_sql(src: str, body: str, tables: list[str] | None = None) -> str:
    return T.with_tables(tables or [src], body, {"split": _SPLIT.format(src=src), "cut": _PATHS})


_add(
    "url_domain_key",
    lambda s, d: T.url_variants(s, d).select("seq", U.domain_key(_u()).alias("domain"), U.netloc_key(_u()).alias("netloc")),
    _url_sql("url_variants", r"""
SELECT seq, regexp_replace(CASE WHEN contains(u, '://') THEN lower(auth) ELSE lower(trim(u)) END, '^www\.', '') AS domain,
  regexp_replace(lower(auth), '^www\.', '') AS netloc FROM cut"""),
)
_add(
    "url_host_key",
    lambda s, d: T.url_variants(s, d).select("seq", U.host_key(_u()).alias("host")),
    _url_sql("url_variants", r"""
SELECT seq, regexp_replace(lower(split_part(list_last(string_split(auth, '@')), ':', 1)), '^www\.', '') AS host FROM cut"""),
)
_add(
    "url_root_page",
    lambda s, d: T.url_variants(s, d).filter(_u().isNotNull()).select("seq", U.is_root_page(_u()).alias("is_root")),
    _url_sql("url_variants", r"""
SELECT seq, q = '' AND (p IN ('/', '/nl', '/en', '/fr', '/de', '/be', '/nl-be', '/fr-be')
   OR (length(p) <= 4 AND length(p) - length(replace(p, '/', '')) <= 1)) AS is_root
FROM (SELECT seq, q, CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END AS p FROM cut WHERE url IS NOT NULL)"""),
)
_add(
    "url_search_page",
    lambda s, d: T.url_variants(s, d).filter(_u().isNotNull()).select("seq", U.is_search_page(_u()).alias("is_search")),
    _url_sql("url_variants", r"""
SELECT seq, contains(q, '=') OR regexp_matches(lower(path), '/zoeken|/search|/results|/vakantie/|/all-inclusive|/serp|/find') AS is_search
FROM cut WHERE url IS NOT NULL"""),
)
_add(
    "url_specificity",
    lambda s, d: T.search_urls(s, d).select("seq", U.detail_flag(_u()).alias("detail"), U.detail_length(_u()).alias("path_chars")),
    T.with_tables(["search_urls"], r"""
SELECT seq, CASE WHEN regexp_matches(lower(url), '/zoeken|/search|/results|/vakanties\?|sort=|offset=|limit=') THEN 0 ELSE 1 END AS detail,
  length(split_part(lower(url), '?', 1)) AS path_chars FROM search_urls"""),
)
_add(
    "url_param_names",
    lambda s, d: T.url_variants(s, d).filter(_u().isNotNull()).select("seq", F.array_join(U.param_names(U.url_query(_u())), "|").alias("names")),
    _url_sql("url_variants", r"""
SELECT seq, coalesce((SELECT string_agg(n, '|' ORDER BY i) FROM (
    SELECT n, min(i) AS i FROM (
      SELECT url_decode(replace(regexp_replace(split_part(pair, '=', 1), '%([^0-9A-Fa-f]|$)', '%25\1', 'g'), '+', ' ')) AS n, i
      FROM (SELECT unnest(string_split(q, '&')) AS pair, unnest(range(len(string_split(q, '&')))) AS i) WHERE pair <> '') GROUP BY n)), '') AS names
FROM cut WHERE url IS NOT NULL"""),
)
_add(
    "search_url_gate",
    lambda s, d: T.search_urls(s, d).select("seq", U.is_learnable_search_url(_u()).alias("learnable"), U.mentions_search(_u()).alias("mentions_search")),
    _url_sql("search_urls", r"""
SELECT seq, starts_with(url, 'http') AND auth <> '' AND (q <> '' OR contains(path, '/zoeken') OR contains(lower(path), '/search'))
   AND (regexp_matches(path, '(?i)/(zoeken|search|results?)/?') OR len(list_filter(string_split(q, '&'), lambda x: regexp_matches(lower(url_decode(split_part(x, '=', 1))),
     'participant|adult|pax|person|traveler|traveller|guest|date|depart|arrival|checkin|checkout|meal|board|duration|night|airport|from|origin|transport|room'))) > 0) AS learnable,
  contains(lower(url), 'zoeken') OR contains(lower(url), 'search') AS mentions_search
FROM cut"""),
)
_add(
    "search_url_template",
    lambda s, d: T.search_urls(s, d).select("seq", U.search_template(_u(), U.param_names(U.url_query(_u()))).alias("template")),
    _url_sql("search_urls", r"""
SELECT seq, split_part(url, '://', 1) || '://' || auth || CASE WHEN path = '' THEN '/' ELSE path END ||
  CASE WHEN q = '' THEN '' ELSE '?' || array_to_string(list_transform(string_split(q, '&'), lambda x: url_decode(split_part(x, '=', 1)) || '=…'), '&') END AS template
FROM cut"""),
)

# --- text -----------------------------------------------------------------------------------------
_add(
    "search_query_keywords",
    lambda s, d: T.read(s, d, "documents").select("doc_id", TX.search_query(F.col("text")).alias("q")).select("doc_id", "q.query", "q.warning"),
    r"""
WITH t AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS q FROM documents),
w AS (SELECT doc_id, q, regexp_split_to_array(q, '\s+') AS words FROM t),
h AS (SELECT *, len(words) AS n, array_to_string(words[1:12], ' ') AS head FROM w),
c AS (SELECT *, CASE WHEN length(head) > 120 THEN regexp_replace(left(head, 120), ' [^ ]*$', '') ELSE head END AS short,
   n > 12 OR length(q) > 120 OR (n >= 8 AND right(q, 1) IN ('?', '.', '!')) AS long FROM h)
SELECT doc_id, CASE WHEN long THEN short ELSE q END AS query,
  CASE WHEN q = '' THEN 'empty query' WHEN long THEN 'Query was long/sentence-like (' || n || ' words, ' || length(q) ||
    ' chars). Truncated for search engines. Prefer 2–8 keywords next time. Used: ' ||
    CASE WHEN contains(short, '''') AND NOT contains(short, '"') THEN '"' || replace(short, '\', '\\') || '"'
         ELSE '''' || replace(replace(short, '\', '\\'), '''', '\''') || '''' END END AS warning
FROM c""",
)
_VISIBLE_SQL = r"array_to_string(list_filter(list_transform(regexp_split_to_array({c}, '\r\n|[\n\r\x0b\f\x1c-\x1e]'), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> ''), chr(10))"
_HTML_SQL = r"""
blocks AS (SELECT page_id, regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>|<nav\b[^>]*>.*?</nav\s*>|<footer\b[^>]*>.*?</footer\s*>|<header\b[^>]*>.*?</header\s*>|<!--.*?-->', chr(10), 'g') AS h FROM pages),
cut AS (SELECT page_id, regexp_extract(h, '(?is)<title[^>]*>(.*?)</title\s*>', 1) AS t, regexp_replace(h, '(?s)<[!/a-zA-Z][^>]*>', chr(10), 'g') AS b FROM blocks),
plain AS (SELECT page_id, replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t,
   replace(replace(replace(replace(b, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS b FROM cut),
page_text AS (SELECT page_id, trim(t) AS title, """ + _VISIBLE_SQL.format(c="b") + " AS text FROM plain)"


def page_texts(s, d):
    html = F.col("html")
    return T.read(s, d, "pages").select("page_id", "url", H.page_title(html).alias("title"), H.page_text(html).alias("text"))


_add("page_scan", lambda s, d: T.read(s, d, "pages").select("page_id", "url", F.length("html").alias("html_chars")),
     "SELECT page_id, url, length(html) AS html_chars FROM pages")
_add("html_title_text", lambda s, d: page_texts(s, d).select("page_id", "title", "text"),
     f"WITH {_HTML_SQL} SELECT page_id, title, text FROM page_text")
_add(
    "visible_text",
    lambda s, d: T.read(s, d, "documents").select("doc_id", TX.visible_text(F.col("text")).alias("text")),
    f"SELECT doc_id, {_VISIBLE_SQL.format(c='text')} AS text FROM documents",
)
_add(
    "truncate_markers",
    lambda s, d: T.read(s, d, "documents").select(
        "doc_id", TX.cut_page(F.col("text")).alias("page"), TX.cut_body(F.col("text"), F.lit(4000)).alias("body"), TX.cut_other(F.col("text")).alias("other")
    ),
    r"""
SELECT doc_id,
  CASE WHEN length(text) > 12000 THEN left(text, 12000) || chr(10) || chr(10) || '...[truncated at 12000 chars]' ELSE text END AS page,
  CASE WHEN length(text) > 4000 THEN left(text, 4000) || chr(10) || '...[truncated ' || length(text) || ' -> 4000 chars; scroll or open a more specific URL if you need lower content]' ELSE text END AS body,
  CASE WHEN length(text) > 2500 THEN left(text, 2500) || '...[truncated ' || length(text) || ' chars]' ELSE text END AS other
FROM documents""",
)
_HINTS_SQL = r"""
SELECT id, coalesce(string_agg(line, ' || ' ORDER BY i), '') AS hints, count(line) AS n FROM (
  SELECT a.id, l.line, l.i, row_number() OVER (PARTITION BY a.id ORDER BY l.i) AS k FROM texts a LEFT JOIN (
    SELECT id, arg_min(line, i) AS line, min(i) AS i FROM (
      SELECT id, trim(unnest(string_split(text, chr(10)))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM texts)
    WHERE length(line) BETWEEN 4 AND 180 AND (regexp_matches(line, '(?i)(€|eur|euro)\s?\d') OR regexp_matches(line, '(?i)\d[\d\s.,]{2,}\s?(€|eur)')
      OR regexp_matches(line, '(?i)(vanaf|from|dès|ab|per persoon|p\.?p\.?|pp\b).{0,20}\d') OR regexp_matches(line, '(?i)(total|totaal|prix|price).{0,30}\d'))
    GROUP BY id, lower(line)) l ON a.id = l.id) WHERE k <= 15 GROUP BY id"""


def _hint_texts(s, d):
    docs = T.read(s, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    return T.listings(s, d).select(F.concat(F.lit("l"), F.col("listing_id").cast("string")).alias("id"), "text").unionByName(docs)


_add(
    "price_hint_lines",
    lambda s, d: _hint_texts(s, d).withColumn("h", TX.price_hints(F.col("text"))).select("id", F.array_join("h", " || ").alias("hints"), F.size("h").alias("n")),
    T.with_tables(["listings"], _HINTS_SQL, {"texts": "SELECT 'l' || listing_id AS id, text FROM listings UNION ALL SELECT 'd' || doc_id, text FROM documents"}),
)
_add(
    "price_numbers",
    lambda s, d: T.candidates(s, d).select("seq", TX.price_number(F.col("price")).alias("price_num")),
    T.with_tables(["candidates"], r"""
SELECT seq, TRY_CAST(replace(nullif(regexp_extract(replace(price, ' ', ''), '[0-9]+[.,]?[0-9]*'), ''), ',', '.') AS DOUBLE) AS price_num FROM candidates"""),
)
_add(
    "candidate_name_key",
    lambda s, d: T.candidates(s, d).select("seq", TX.name_key(F.col("name")).alias("name_key")),
    T.with_tables(["candidates"], r"""
SELECT seq, regexp_replace(list_reduce(['hotel','resort','spa','apartments','apartment','boutique','the','adults only','adults-only','holiday','club','suites','suite'],
   lambda acc, t: replace(acc, t, ' '), lower(name)), '[^a-z0-9]+', '', 'g') AS name_key FROM candidates"""),
)
_add(
    "clean_lists",
    lambda s, d: T.candidates(s, d).select(
        "seq", F.array_join(TX.clean_list(F.col("unmatched")), "|").alias("unmatched"), F.array_join(TX.clean_list(F.col("unknown")), "|").alias("unknown"),
        F.array_join(TX.clean_list_json(F.concat(F.lit(chr(34)), "name", F.lit(" " + chr(34)))), "|").alias("single"),
    ),
    T.with_tables(["candidates"], r"""
SELECT seq, array_to_string(list_filter(list_transform(unmatched, lambda x: trim(x)), lambda x: x <> ''), '|') AS unmatched,
  array_to_string(list_filter(list_transform(unknown, lambda x: trim(x)), lambda x: x <> ''), '|') AS unknown, trim(name) AS single FROM candidates"""),
)
_add(
    "result_previews",
    lambda s, d: T.tool_results(s, d).select("seq", TX.preview(F.col("text"), 500).alias("result_preview"), TX.preview(F.col("error"), 300).alias("error")),
    T.with_tables(["tool_results"], "SELECT seq, left(text, 500) AS result_preview, left(error, 300) AS error FROM tool_results"),
)
_add(
    "run_slugs",
    lambda s, d: T.candidates(s, d).select("seq", TX.run_slug(F.col("ts"), F.concat("name", F.lit(" – é/?"), "details")).alias("run_id")),
    T.with_tables(["candidates"], r"""
SELECT seq, strftime(ts, '%Y-%m-%dT%H-%M-%S') || '_' || regexp_replace(left(name || ' – é/?' || details, 40), '[^\p{L}\p{N}_-]', '_', 'g') AS run_id
FROM candidates"""),
)

# --- messages -------------------------------------------------------------------------------------
_WS = "' ' || chr(9) || chr(10) || chr(13)"
_add(
    "message_text",
    lambda s, d: T.messages(s, d).select("run_id", "turn", M.message_text(F.col("content"), F.col("thinking")).alias("text")),
    T.with_tables(["messages"], f"""
SELECT run_id, turn, CASE WHEN trim(coalesce(content, ''), {_WS}) <> '' THEN trim(content, {_WS}) ELSE trim(coalesce(thinking, ''), {_WS}) END AS text FROM messages"""),
)
_add(
    "message_done",
    lambda s, d: T.messages(s, d).select("run_id", "turn", M.is_done(F.col("content")).alias("done")),
    T.with_tables(["messages"], "SELECT run_id, turn, content ILIKE '%RESEARCH\\_COMPLETE%' ESCAPE '\\' AS done FROM messages"),
)


def _model_messages(s, d):
    """Model messages as JSON text with two tool calls each; every fifth has unreadable arguments."""
    args = F.to_json(F.struct(F.col("arg_url").alias("url"), F.col("session_id").cast("string").alias("n")))
    bad = F.when(F.col("seq") % 5 == 0, F.lit("{not json")).otherwise(args)
    call = lambda name, a: F.struct(F.struct(name.alias("name"), a.alias("arguments")).alias("function"))
    message = F.struct(
        F.lit("assistant").alias("role"), F.lit("").alias("content"),
        F.when(F.col("seq") % 9 > 0, F.array(call(F.col("tool"), bad), call(F.lit("web_search"), F.lit('{"query":"q"}')))).alias("tool_calls"),
    )
    return T.tool_events(s, d).select("seq", F.from_json(F.to_json(message), M.MESSAGE_TYPE).alias("message"))


_add(
    "tool_calls",
    lambda s, d: M.tool_calls(_model_messages(s, d)).select(
        "seq", "call_no", "tool", F.col("arguments")["url"].alias("arg_url"), F.col("arguments")["query"].alias("query"), F.size("arguments").alias("n_args")
    ),
    T.with_tables(["tool_events"], """
SELECT seq, 0 AS call_no, tool, CASE WHEN seq % 5 > 0 THEN arg_url END AS arg_url, NULL AS query,
  CASE WHEN seq % 5 = 0 THEN 0 WHEN arg_url IS NULL THEN 1 ELSE 2 END AS n_args FROM tool_events WHERE seq % 9 > 0
UNION ALL SELECT seq, 1, 'web_search', NULL, 'q', 1 FROM tool_events WHERE seq % 9 > 0"""),
)
_add(
    "message_disposition",
    lambda s, d: T.messages(s, d).select(
        "run_id", "turn", M.disposition(F.when(F.col("turn") % 4 == 1, 1).otherwise(0), F.col("content")).alias("disposition")
    ),
    T.with_tables(["messages"], """
SELECT run_id, turn, CASE WHEN turn % 4 = 1 THEN 'tool_calls' WHEN contains(upper(content), 'RESEARCH_COMPLETE') THEN 'complete'
  WHEN length(content) > 500 THEN 'nudge' ELSE 'continue' END AS disposition FROM messages"""),
)


def _plan_messages(s, d):
    """Planner answers: bare, fenced, wrapped in prose, more steps than kept, and unreadable ones."""
    k, name = F.col("p_partkey"), F.col("p_name")
    items = F.concat(F.lit('[" '), name, F.lit('", "b", " ", "'), "p_type", F.lit('", "'), "p_brand", F.lit('"]'))
    raw = (
        F.when(k % 5 == 0, items)
        .when(k % 5 == 1, F.concat(F.lit("```json\n"), items, F.lit("\n```")))
        .when(k % 5 == 2, F.concat(F.lit("Plan: "), items, F.lit(" done.")))
        .when(k % 5 == 3, F.concat(F.lit("no plan for "), name))
        .otherwise(F.lit('["broken", oops]'))
    )
    return T.read(s, d, "part").select(k.alias("plan_id"), raw.alias("raw"), F.concat(F.lit("Task about "), name).alias("task"))


_add(
    "plan_steps",
    lambda s, d: _plan_messages(s, d).withColumn("steps", M.plan_steps(F.col("raw"), F.col("task"))).select("plan_id", F.array_join("steps", "|").alias("steps"), F.size("steps").alias("n")),
    """
SELECT p_partkey AS plan_id, CASE WHEN p_partkey % 5 < 3 THEN trim(p_name) || '|b|' || p_type ELSE 'Task about ' || p_name END AS steps,
  CASE WHEN p_partkey % 5 < 3 THEN 3 ELSE 1 END AS n FROM part""",
)
_add(
    "subtask_budget",
    lambda s, d: T.read(s, d, "orders").select("o_orderkey", R.subtask_budget(F.col("o_custkey") % 90, F.col("o_orderkey") % 5).alias("budget")),
    """
SELECT o_orderkey, greatest(8, greatest(80 - o_custkey % 90 - 4, 8 * greatest(o_orderkey % 5, 1)) // greatest(o_orderkey % 5, 1)) AS budget FROM orders""",
)

# --- documents and lines as sources -----------------------------------------------------------------
_add(
    "task_texts",
    lambda s, d: T.read(s, d, "documents").select("doc_id", TX.utrim(F.concat(F.lit("\n  "), "text", F.lit(" \n"))).alias("task")),
    f"SELECT doc_id, trim(text, {_WS}) AS task FROM documents",
)


def _props_lines(s, d):
    """The events' ``props`` as log lines; some are cut off in the middle."""
    line = F.when(F.col("event_id") % 50 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    return T.read(s, d, "events").select((F.col("user_id") % 10).alias("run_id"), F.col("event_id").alias("seq"), line.alias("line"))


_add(
    "json_lines_tail",
    lambda s, d: files.tail_lines(files.parse_lines(_props_lines(s, d), "line", "k long"), 80),
    """
SELECT run_id, seq, k FROM (SELECT user_id % 10 AS run_id, event_id AS seq, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
   row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id DESC) AS r FROM events WHERE event_id % 50 <> 0) WHERE r <= 80""",
)


def _item_documents(s, d):
    """One JSON document per part: a list, an object with items, an object with strategies, or broken."""
    k = F.col("p_partkey")
    item = F.concat(F.lit('{"name":"'), "p_name", F.lit('","price":"'), F.col("p_size").cast("string"), F.lit('"}'))
    doc = (
        F.when(k % 4 == 0, F.concat(F.lit("["), item, F.lit(","), item, F.lit("]")))
        .when(k % 4 == 1, F.concat(F.lit('{"items":['), item, F.lit("]}")))
        .when(k % 4 == 2, F.concat(F.lit('{"strategies":['), item, F.lit('],"updated_at":"x"}')))
        .otherwise(F.concat(F.lit("["), item))
    )
    return T.read(s, d, "part").select(k.alias("doc_id"), doc.alias("body"))


_add(
    "json_documents",
    lambda s, d: files.document_items(_item_documents(s, d), "body", "struct<name:string,price:string>").select("doc_id", "pos", "item.name", "item.price"),
    """
SELECT p_partkey AS doc_id, pos, p_name AS name, CAST(p_size AS VARCHAR) AS price
FROM part JOIN (SELECT unnest([0, 1]) AS pos) ON (pos = 0 AND p_partkey % 4 < 3) OR (pos = 1 AND p_partkey % 4 = 0)""",
)
_add(
    "log_default_ts",
    lambda s, d: files.with_default_ts(
        T.read(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("ts")).alias("ts")), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    ),
    "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN ts ELSE TIMESTAMP '2024-02-01 00:00:00' END AS ts FROM events",
)


def _api_hits(s, d):
    """Raw search hits in either API's field names, some with blanks."""
    e = T.search_urls(s, d)
    blank = F.lit(None).cast("string")
    hit = lambda t, h, l, b, sn: F.struct(t.alias("title"), h.alias("href"), l.alias("link"), b.alias("body"), sn.alias("snippet"))
    url, n = F.col("url"), F.concat(F.lit("t"), F.col("seq").cast("string"))
    new, old = hit(n, url, blank, n, blank), hit(blank, F.lit(""), url, F.lit(""), n)
    return e.select("seq", F.array(new, old, hit(n, blank, blank, blank, blank)).alias("hits"))


_add(
    "search_hits",
    lambda s, d: EV.search_hits(_api_hits(s, d)),
    T.with_tables(["search_urls"], """
SELECT seq, 0 AS pos, 't' || seq AS title, url, 't' || seq AS snippet FROM search_urls
UNION ALL SELECT seq, 1, '', url, 't' || seq FROM search_urls UNION ALL SELECT seq, 2, 't' || seq, '', '' FROM search_urls"""),
)
