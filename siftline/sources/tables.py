"""Logical input tables derived from the delivered tables.

Each table is written once as DataFrame code and once as SQL (``SQL``), so that a query and its SQL check
start from the same rows. ``event_id`` is unique and serves as ``seq``. Table counts enter as literals;
every join is on a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(value: Column) -> Column:
    """A derived column that is computed once per row.

    The optimizer would copy the expression into every filter and column that uses it, until the generated
    code is too large to compile. It does not move expressions across a generator.
    """
    return F.explode(F.array(value))


def _n(df: DataFrame) -> Column:
    """Row count as a literal (read from the file footers): a subquery in the plan would keep Spark from
    recognizing equal shuffles."""
    return F.lit(df.count())


def _div(c: str, n: int) -> Column:
    return F.expr(f"{c} div {n}")


def _event_pages(spark: SparkSession, d: str, key: Column | None = None) -> DataFrame:
    pages = read(spark, d, "pages").select("page_id", "url")
    key = F.col("event_id") if key is None else key
    return read(spark, d, "events").withColumn("page_id", key % _n(pages)).join(pages, "page_id")


def _event_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text", "source")
    return _event_pages(spark, d).withColumn("doc_id", F.col("event_id") % _n(docs)).join(docs, "doc_id")


def _e() -> Column:
    return F.col("event_id")


def _tool(kind: str = "event_type") -> Column:
    k = F.col(kind)
    return (
        F.when(k.isin("view", "error"), "web_fetch")
        .when(k == "signup", "browser_open")
        .when(k == "click", "browser_click")
        .otherwise("browser_scroll")
    )


_TOOL_SQL = """CASE e.event_type WHEN 'view' THEN 'web_fetch' WHEN 'error' THEN 'web_fetch'
  WHEN 'signup' THEN 'browser_open' WHEN 'click' THEN 'browser_click' ELSE 'browser_scroll' END"""


def tool_events(spark: SparkSession, d: str) -> DataFrame:
    """Tool-event log: three pages in three variants per session."""
    rows = _event_pages(spark, d, F.col("user_id") * 13 + _e() % 3)
    url = F.concat("url", F.lit("/v"), (_div("event_id", 3) % 3).cast("string"))
    kind = F.col("event_type")
    return rows.select(
        _e().alias("seq"), "ts", (F.col("user_id") % 10).alias("run_id"), F.col("user_id").alias("session_id"),
        _tool().alias("tool"), url.alias("url"), F.when(kind.isin("view", "error", "signup"), url).alias("arg_url"),
        (kind != "error").alias("ok"), (kind == "error").alias("blocked"),
        F.when(kind == "error", "403 Forbidden/Unauthorized").alias("error"), F.col("value").alias("duration_ms"),
        F.when(_e() % 4 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("€ "), (_e() % 3).cast("string")))).alias("price_hints"),
    )


SQL["tool_events"] = f"""
SELECT e.event_id AS seq, e.ts, e.user_id % 10 AS run_id, e.user_id AS session_id, {_TOOL_SQL} AS tool,
  p.url || '/v' || CAST((e.event_id // 3) % 3 AS VARCHAR) AS url,
  CASE WHEN e.event_type IN ('view','error','signup')
       THEN p.url || '/v' || CAST((e.event_id // 3) % 3 AS VARCHAR) END AS arg_url,
  e.event_type <> 'error' AS ok, e.event_type = 'error' AS blocked,
  CASE WHEN e.event_type = 'error' THEN '403 Forbidden/Unauthorized' END AS error, e.value AS duration_ms,
  CASE WHEN e.event_id % 4 = 0 THEN CAST([] AS VARCHAR[])
       ELSE ['€ ' || CAST(e.event_id % 3 AS VARCHAR)] END AS price_hints
FROM events e JOIN pages p ON p.page_id = (e.user_id * 13 + e.event_id % 3) % (SELECT count(*) FROM pages)"""


def browser_events(spark: SparkSession, d: str) -> DataFrame:
    """Browser-only log with some failures: every event acts on one of the session's pages."""
    rows = tool_events(spark, d)
    bad = F.col("tool") == "web_fetch"
    tools = F.when(F.col("seq") % 7 == 0, "browser_open").otherwise("browser_click")
    return rows.withColumns(
        {
            "error": F.when(bad & (F.col("seq") % 2 == 0), "Timeout 60000ms exceeded"),
            "blocked": bad & (F.col("seq") % 4 == 1),
            "ok": ~(bad & (F.col("seq") % 2 == 0)),
            "tool": F.when(bad, tools).otherwise(F.col("tool")),
        }
    )


SQL["browser_events"] = """
SELECT * REPLACE (
  CASE WHEN tool = 'web_fetch' AND seq % 2 = 0 THEN 'Timeout 60000ms exceeded' END AS error,
  (tool = 'web_fetch' AND seq % 4 = 1) AS blocked,
  NOT (tool = 'web_fetch' AND seq % 2 = 0) AS ok,
  CASE WHEN tool <> 'web_fetch' THEN tool WHEN seq % 7 = 0 THEN 'browser_open' ELSE 'browser_click' END AS tool)
FROM tool_events"""


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """Attempted browser actions: home pages, search URLs and detail pages of a session's hosts."""
    rows = browser_events(spark, d)
    base = F.regexp_replace("url", r"^(https?://[^/]+).*$", "$1")
    opened = (
        F.when(F.col("seq") % 5 == 0, F.concat(base, F.lit("/")))
        .when(F.col("seq") % 5 == 1, F.concat(base, F.lit("/search?checkin="), (F.col("seq") % 7).cast("string")))
        .otherwise(F.col("url"))
    )
    tool = F.when(F.col("seq") % 3 == 0, "browser_open").otherwise(F.col("tool"))
    return rows.withColumns(
        {
            "tool": tool,
            "arg_url": F.when(tool == "browser_open", opened),
            "url": F.when(F.col("error").isNotNull(), F.lit("")).when(tool == "browser_open", opened).otherwise(F.col("url")),
        }
    )


SQL["attempts"] = r"""
SELECT * EXCLUDE (t, opened) REPLACE (
  t AS tool,
  CASE WHEN t = 'browser_open' THEN opened END AS arg_url,
  CASE WHEN error IS NOT NULL THEN '' WHEN t = 'browser_open' THEN opened ELSE url END AS url)
FROM (SELECT *, CASE WHEN seq % 3 = 0 THEN 'browser_open' ELSE tool END AS t,
        CASE seq % 5 WHEN 0 THEN regexp_extract(url, '^(https?://[^/]+)', 1) || '/'
          WHEN 1 THEN regexp_extract(url, '^(https?://[^/]+)', 1) || '/search?checkin=' || CAST(seq % 7 AS VARCHAR)
          ELSE url END AS opened
      FROM browser_events)"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidate mentions with every rejection arm and unparseable prices."""
    part = read(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_retailprice")
    rows = _event_pages(spark, d).withColumn("p_partkey", _e() % _n(part)).join(part, "p_partkey")
    whole = F.floor("p_retailprice").cast("long").cast("string")
    name = (
        F.when(_e() % 4 == 0, F.concat(F.lit("Hotel "), "p_name"))
        .when(_e() % 4 == 1, F.upper("p_name"))
        .when(_e() % 4 == 2, F.concat(F.lit("The "), "p_name", F.lit(" Resort")))
        .otherwise(F.col("p_name"))
    )
    price = (
        F.when(_e() % 97 == 0, "op aanvraag")
        .when((_e() % 97).isin(1, 2), F.lit(None))
        .when(_e() % 2 == 0, F.concat(F.lit("€ "), whole))
        .otherwise(F.concat(whole, F.lit(",50 EUR")))
    )
    empty = F.array().cast("array<string>")
    return rows.select(
        _e().alias("seq"), "ts", (F.col("user_id") % 10).alias("run_id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session"),
        name.alias("name"), F.when(_e() % 5 == 0, "").otherwise(F.col("url")).alias("source_url"), price.alias("price"),
        F.concat("p_type", F.lit(" "), "p_brand").alias("details"),
        F.when(_e() % 11 == 0, "bogus").when(_e() % 11 == 1, "full").alias("match_status"),
        F.when(_e() % 2 == 0, F.array(F.lit("pool"))).otherwise(empty).alias("matched"),
        F.when(_e() % 3 == 0, F.array(F.lit("beach"), F.lit(" "))).otherwise(empty).alias("unmatched"),
        F.when(_e() % 7 == 0, F.array(F.lit("spa"))).otherwise(empty).alias("unknown"),
    )


SQL["candidates"] = """
SELECT e.event_id AS seq, e.ts, e.user_id % 10 AS run_id, 's' || CAST(e.user_id AS VARCHAR) AS session,
  CASE e.event_id % 4 WHEN 0 THEN 'Hotel ' || p.p_name WHEN 1 THEN upper(p.p_name)
       WHEN 2 THEN 'The ' || p.p_name || ' Resort' ELSE p.p_name END AS name,
  CASE WHEN e.event_id % 5 = 0 THEN '' ELSE g.url END AS source_url,
  CASE e.event_id % 97 WHEN 0 THEN 'op aanvraag' WHEN 1 THEN NULL WHEN 2 THEN NULL
       ELSE CASE e.event_id % 2 WHEN 0 THEN '€ ' || CAST(CAST(floor(p.p_retailprice) AS BIGINT) AS VARCHAR)
            ELSE CAST(CAST(floor(p.p_retailprice) AS BIGINT) AS VARCHAR) || ',50 EUR' END END AS price,
  p.p_type || ' ' || p.p_brand AS details,
  CASE e.event_id % 11 WHEN 0 THEN 'bogus' WHEN 1 THEN 'full' ELSE NULL END AS match_status,
  CASE WHEN e.event_id % 2 = 0 THEN ['pool'] ELSE CAST([] AS VARCHAR[]) END AS matched,
  CASE WHEN e.event_id % 3 = 0 THEN ['beach', ' '] ELSE CAST([] AS VARCHAR[]) END AS unmatched,
  CASE WHEN e.event_id % 7 = 0 THEN ['spa'] ELSE CAST([] AS VARCHAR[]) END AS unknown
FROM events e
JOIN part p ON p.p_partkey = e.event_id % (SELECT count(*) FROM part)
JOIN pages g ON g.page_id = e.event_id % (SELECT count(*) FROM pages)"""


def search_urls(spark: SparkSession, d: str) -> DataFrame:
    """Results of visited URLs: search URLs with hinted and percent-encoded parameters, search paths, plain pages; some
    from other tools, some failed, half with price hints."""
    rows = _event_pages(spark, d)
    bare = F.substring_index(F.substring_index("url", "#", 1), "?", 1)
    num = lambda m: (_e() % m).cast("string")
    url = (
        F.when(_e() % 5 == 0, F.concat(bare, F.lit("?checkin=1&adults="), num(9)))
        .when(_e() % 5 == 1, F.concat(bare, F.lit("?k"), num(60), F.lit("=&Date%5B0%5D=2")))
        .when(_e() % 5 == 2, F.concat(F.regexp_replace("url", r"^(https?://[^/]+).*$", "$1"), F.lit("/search/"), num(12)))
        .otherwise(F.col("url"))
    )
    ten = _div("event_id", 10)
    return rows.select(
        _e().alias("seq"), "ts", once(url).alias("url"), F.when(ten % 8 == 7, "web_fetch").otherwise("browser_open").alias("tool"),
        F.when(ten % 9 == 8, "Timeout 60000ms exceeded").when(ten % 9 == 7, "").alias("error"),
        F.when(_div("event_id", 5) % 2 == 0, F.array(F.lit("€ 1"))).otherwise(F.array().cast("array<string>")).alias("price_hints"),
    )


SQL["search_urls"] = r"""
SELECT e.event_id AS seq, e.ts,
  CASE e.event_id % 5
    WHEN 0 THEN split_part(split_part(p.url,'#',1),'?',1) || '?checkin=1&adults=' || CAST(e.event_id % 9 AS VARCHAR)
    WHEN 1 THEN split_part(split_part(p.url,'#',1),'?',1) || '?k' || CAST(e.event_id % 60 AS VARCHAR) || '=&Date%5B0%5D=2'
    WHEN 2 THEN regexp_replace(p.url, '^(https?://[^/]+).*$', '\1') || '/search/' || CAST(e.event_id % 12 AS VARCHAR)
    ELSE p.url END AS url,
  CASE WHEN (e.event_id // 10) % 8 = 7 THEN 'web_fetch' ELSE 'browser_open' END AS tool,
  CASE (e.event_id // 10) % 9 WHEN 8 THEN 'Timeout 60000ms exceeded' WHEN 7 THEN '' END AS error,
  CASE WHEN (e.event_id // 5) % 2 = 0 THEN ['€ 1'] ELSE CAST([] AS VARCHAR[]) END AS price_hints
FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)"""


def url_variants(spark: SparkSession, d: str) -> DataFrame:
    """URLs as logs hold them: ports, user info, upper case, bare hosts, home and locale pages, blanks."""
    rows = _event_pages(spark, d)
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    pick = _div("event_id", 7) % 4
    root = F.when(pick == 0, "").when(pick == 1, "/").when(pick == 2, "/nl").otherwise("/nl-be/")
    url = (
        F.when(_e() % 7 == 0, F.concat(F.lit("HTTPS://WWW."), F.upper(host), F.lit(":8080/a/b?x=1")))
        .when(_e() % 7 == 1, F.concat(F.lit("http://user:pw@"), host, F.lit("/zoeken/page;v=1?q=&&b%20c=2&q=3#top")))
        .when(_e() % 7 == 2, F.concat(F.lit(" www."), host, F.lit(" ")))
        .when(_e() % 7 == 3, F.concat(F.lit("https://"), host, root))
        .when(_e() % 7 == 4, F.concat(F.lit("https://"), host, F.lit("/vakantie/all-inclusive?a+b=1&100%=2&=3")))
        .when(_e() % 70 == 5, F.lit(None))
        .otherwise(F.col("url"))
    )
    return rows.select(_e().alias("seq"), once(url).alias("url"))


SQL["url_variants"] = r"""
SELECT e.event_id AS seq,
  CASE WHEN e.event_id % 7 = 0 THEN 'HTTPS://WWW.' || upper(h) || ':8080/a/b?x=1'
    WHEN e.event_id % 7 = 1 THEN 'http://user:pw@' || h || '/zoeken/page;v=1?q=&&b%20c=2&q=3#top'
    WHEN e.event_id % 7 = 2 THEN ' www.' || h || ' '
    WHEN e.event_id % 7 = 3 THEN 'https://' || h || CASE (e.event_id // 7) % 4 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN '/nl' ELSE '/nl-be/' END
    WHEN e.event_id % 7 = 4 THEN 'https://' || h || '/vakantie/all-inclusive?a+b=1&100%=2&=3'
    WHEN e.event_id % 70 = 5 THEN NULL ELSE e.url END AS url
FROM (SELECT e.event_id, p.url, regexp_extract(p.url, '^https?://([^/?#]+)', 1) AS h
      FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)) e"""


def tool_results(spark: SparkSession, d: str) -> DataFrame:
    """Page results with whole document texts, failures, blocked and short pages."""
    rows = _event_documents(spark, d)
    err = F.col("event_type") == "error"
    denied = err & (_e() % 2 == 0)
    slow = ~err & (_e() % 13 == 0)
    return rows.select(
        _e().alias("seq"), "ts", (F.col("user_id") % 10).alias("run_id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session"),
        _tool().alias("tool"), F.when(slow, "").otherwise(F.col("url")).alias("url"), F.col("url").alias("arg_url"),
        F.when(denied, "").otherwise(F.col("source")).alias("title"), F.when(denied, "").otherwise(F.col("text")).alias("text"),
        F.when(err, "403 Forbidden/Unauthorized").when(slow, "Timeout 60000ms exceeded").alias("error"),
        (err | ((F.col("event_type") == "view") & (F.length("text") < 400))).alias("blocked"),
        (err & (_e() % 4 == 0)).alias("prefer_browser"),
        F.when(_e() % 4 == 0, F.array().cast("array<string>"))
        .otherwise(F.transform(F.sequence(F.lit(0), _e() % 30), lambda i: F.concat(F.lit("€ "), i.cast("string")))).alias("price_hints"),
    )


SQL["tool_results"] = f"""
SELECT e.event_id AS seq, e.ts, e.user_id % 10 AS run_id, 's' || CAST(e.user_id AS VARCHAR) AS session, {_TOOL_SQL} AS tool,
  CASE WHEN e.event_type <> 'error' AND e.event_id % 13 = 0 THEN '' ELSE p.url END AS url, p.url AS arg_url,
  CASE WHEN e.event_type = 'error' AND e.event_id % 2 = 0 THEN '' ELSE d.source END AS title,
  CASE WHEN e.event_type = 'error' AND e.event_id % 2 = 0 THEN '' ELSE d.text END AS text,
  CASE WHEN e.event_type = 'error' THEN '403 Forbidden/Unauthorized' WHEN e.event_id % 13 = 0 THEN 'Timeout 60000ms exceeded' END AS error,
  (e.event_type = 'error' OR (e.event_type = 'view' AND length(d.text) < 400)) AS blocked,
  (e.event_type = 'error' AND e.event_id % 4 = 0) AS prefer_browser,
  CASE WHEN e.event_id % 4 = 0 THEN CAST([] AS VARCHAR[])
       ELSE list_transform(range(0, e.event_id % 30 + 1), lambda i: '€ ' || CAST(i AS VARCHAR)) END AS price_hints
FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)
JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)"""

_HIT = "struct<title:string,url:string,snippet:string>"


def search_results(spark: SparkSession, d: str) -> DataFrame:
    """Searches with their hits: whole texts, notices and error rows."""
    rows = _event_documents(spark, d).filter(F.col("event_type") == "view")
    hit = lambda t, u, s: F.struct(t.alias("title"), u.alias("url"), s.alias("snippet"))
    lit, col = F.lit, F.col
    notice, failed = hit(lit("Query notice"), lit(""), lit("long")), hit(lit("Search error"), lit(""), lit("timeout"))
    found = F.array(
        notice, hit(col("text"), col("url"), col("text")), hit(lit(""), col("url"), lit("")),
        hit(col("source"), F.concat("url", lit("/alt")), lit("x")),
    )
    results = F.when(_e() % 6 == 0, F.array(failed)).when(_e() % 6 == 1, F.array(notice, failed)).otherwise(found)
    return rows.select(
        _e().alias("seq"), (F.col("user_id") % 10).alias("run_id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session"),
        F.col("text").alias("query"), results.cast(f"array<{_HIT}>").alias("results"),
    )


SQL["search_results"] = """
SELECT e.event_id AS seq, e.user_id % 10 AS run_id, 's' || CAST(e.user_id AS VARCHAR) AS session, d.text AS query,
  CASE e.event_id % 6
    WHEN 0 THEN [{'title':'Search error','url':'','snippet':'timeout'}]
    WHEN 1 THEN [{'title':'Query notice','url':'','snippet':'long'},{'title':'Search error','url':'','snippet':'timeout'}]
    ELSE [{'title':'Query notice','url':'','snippet':'long'},{'title':d.text,'url':p.url,'snippet':d.text},
          {'title':'','url':p.url,'snippet':''},{'title':d.source,'url':p.url || '/alt','snippet':'x'}] END AS results
FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)
JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)
WHERE e.event_type = 'view'"""


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Chat messages; late assistant turns carry the completion mark, some assistant turns only thinking."""
    c = read(spark, d, "conversations")
    assistant = F.col("role") == "assistant"
    content = (
        F.when(assistant & (F.col("turn") >= 3), F.concat(F.lit("Research_Complete\n"), "text"))
        .when(assistant & (F.col("conv_id") % 3 == 0), F.lit("  "))
        .otherwise(F.col("text"))
    )
    return c.select(F.col("conv_id").alias("run_id"), "turn", "role", content.alias("content"), F.when(assistant, F.col("text")).alias("thinking"))


SQL["messages"] = """
SELECT conv_id AS run_id, turn, role,
  CASE WHEN role = 'assistant' AND turn >= 3 THEN 'Research_Complete' || chr(10) || text
       WHEN role = 'assistant' AND conv_id % 3 = 0 THEN '  ' ELSE text END AS content,
  CASE WHEN role = 'assistant' THEN text END AS thinking
FROM conversations"""


def listings(spark: SparkSession, d: str) -> DataFrame:
    """Listing texts with price lines, near misses and repeats that differ in case only."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    more = F.transform(
        F.when(key % 25 == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("long"), key % 25)),
        lambda i: F.concat(F.lit("prix "), i.cast("string")),
    )
    return read(spark, d, "part").select(
        key.alias("listing_id"),
        F.concat_ws(
            "\n",
            F.concat(F.lit("  vanaf € "), F.col("p_retailprice").cast("string"), F.lit("  ")),
            F.concat("p_name", F.lit(" 1."), size, F.lit(" EUR")),
            F.lit("   "),
            F.concat(F.lit("Totaal prijs: "), size),
            F.concat(F.lit("TOTAAL PRIJS: "), size),
            F.concat(F.lit("DÈS "), size, F.lit(" pp")),
            F.lit("€ 5"),
            F.col("p_name"),
            F.array_join(more, "\n"),
        ).alias("text"),
    )


SQL["listings"] = """
SELECT p_partkey AS listing_id,
  concat_ws(chr(10), '  vanaf € ' || CAST(p_retailprice AS VARCHAR) || '  ', p_name || ' 1.' || CAST(p_size AS VARCHAR) || ' EUR',
    '   ', 'Totaal prijs: ' || CAST(p_size AS VARCHAR), 'TOTAAL PRIJS: ' || CAST(p_size AS VARCHAR),
    'DÈS ' || CAST(p_size AS VARCHAR) || ' pp', '€ 5', p_name,
    array_to_string(list_transform(range(1, p_partkey % 25 + 1), lambda i: 'prix ' || CAST(i AS VARCHAR)), chr(10))) AS text
FROM part"""


def run_log(spark: SparkSession, d: str) -> DataFrame:
    """Run log: model steps, tool results by tool, session ends with their status, and planner calls in seven of ten runs, whose
    answers are sometimes followed by an error."""
    e = read(spark, d, "events")
    k = F.col("event_type")
    planner = F.when(_e() % 47 == 1, "planner_request").when(_e() % 47 == 2, "planner_response").when((_e() % 47 == 3) & (_e() % 2 == 0), "planner_error")
    kind = F.coalesce(F.when(F.col("user_id") % 10 < 7, planner), F.when(k.isin("signup", "error"), "llm_request").when(_e() % 29 == 0, "session_end").otherwise("tool_result"))
    tool = F.when(kind == "tool_result", F.when(k == "view", "web_search").when(k == "click", "browser_click").otherwise("web_fetch"))
    status = F.when(
        kind == "session_end",
        F.when(_e() % 4 == 0, "completed").when(_e() % 4 == 1, "timeout_llm").when(_e() % 4 == 2, "session_budget").otherwise("llm_error"),
    )
    return e.select(
        _e().alias("seq"), "ts", (F.col("user_id") % 10).alias("run_id"), F.col("user_id").alias("session"),
        kind.alias("type"), tool.alias("tool"), status.alias("status"),
    )


SQL["run_log"] = """
SELECT seq, ts, run_id, session, type,
  CASE WHEN type = 'tool_result' THEN CASE k WHEN 'view' THEN 'web_search' WHEN 'click' THEN 'browser_click' ELSE 'web_fetch' END END AS tool,
  CASE WHEN type = 'session_end' THEN CASE seq % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'timeout_llm' WHEN 2 THEN 'session_budget' ELSE 'llm_error' END END AS status
FROM (SELECT event_id AS seq, ts, user_id % 10 AS run_id, user_id AS session, event_type AS k,
        CASE WHEN user_id % 10 < 7 AND event_id % 47 = 1 THEN 'planner_request' WHEN user_id % 10 < 7 AND event_id % 47 = 2 THEN 'planner_response'
          WHEN user_id % 10 < 7 AND event_id % 47 = 3 AND event_id % 2 = 0 THEN 'planner_error'
          WHEN event_type IN ('signup','error') THEN 'llm_request' WHEN event_id % 29 = 0 THEN 'session_end' ELSE 'tool_result' END AS type
      FROM events)"""


def session_ends(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Runs with their mode and synthesis outcome, and their sessions' statuses (one run per customer)."""
    runs = read(spark, d, "customer").select(
        F.col("c_custkey").alias("run_id"),
        F.when(F.col("c_custkey") % 3 == 0, "single").otherwise("planned").alias("mode"),
        (F.col("c_custkey") % 2 == 0).alias("synthesis_ok"),
    )
    mix = (F.col("o_orderkey") + _div("o_orderkey", 8)) % 11
    status = (
        F.when(mix == 0, "timeout_runtime").when(mix == 1, "timeout_llm").when(mix == 2, "timeout_tools")
        .when(mix == 3, "cancelled").when(mix.isin(4, 5), "llm_error").when(mix == 6, "error")
        .when(mix == 7, "session_budget").otherwise("completed")
    )
    sessions = read(spark, d, "orders").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("session_no"), status.alias("status")
    )
    return runs, sessions


SQL["runs"] = """
SELECT c_custkey AS run_id, CASE WHEN c_custkey % 3 = 0 THEN 'single' ELSE 'planned' END AS mode, c_custkey % 2 = 0 AS synthesis_ok
FROM customer"""
SQL["sessions"] = """
SELECT o_custkey AS run_id, o_orderkey AS session_no,
  CASE (o_orderkey + o_orderkey // 8) % 11 WHEN 0 THEN 'timeout_runtime' WHEN 1 THEN 'timeout_llm' WHEN 2 THEN 'timeout_tools'
    WHEN 3 THEN 'cancelled' WHEN 4 THEN 'llm_error' WHEN 5 THEN 'llm_error' WHEN 6 THEN 'error' WHEN 7 THEN 'session_budget'
    ELSE 'completed' END AS status
FROM orders"""


def stored_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Stored strategies: some repeat a seed trigger, some have a blank one."""
    k = F.col("p_partkey")
    trigger = F.when(k % 7 == 0, "Enough candidates with sources already collected").when(k % 7 == 1, "").otherwise(F.col("p_name"))
    return read(spark, d, "part").select(
        k.alias("pos"), trigger.alias("trigger"), F.col("p_type").alias("tactic"), F.col("p_brand").alias("efficiency_gain")
    )


SQL["stored_strategies"] = """
SELECT p_partkey AS pos, CASE p_partkey % 7 WHEN 0 THEN 'Enough candidates with sources already collected' WHEN 1 THEN '' ELSE p_name END AS trigger,
  p_type AS tactic, p_brand AS efficiency_gain
FROM part"""


USES = {
    "browser_events": ["tool_events"],
    "attempts": ["browser_events"],
}


def with_tables(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """A SQL text with the named tables (and those they are built from) as common table expressions."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in USES.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({SQL[n].strip()})" for n in order] + [f"{n} AS ({q.strip()})" for n, q in (extra or {}).items()]
    return f"WITH {', '.join(parts)}\n{body.strip()}" if parts else body.strip()
