"""Queries that turn pages and tool results into evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import urls as U
from siftline.operators import evidence as EV
from siftline.plans.columns import _HTML_SQL, page_texts
from siftline.sources import tables as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


# --- shared SQL ------------------------------------------------------------------------------------
_WS = "' ' || chr(9) || chr(10) || chr(13)"
NOTES_SQL = f"""
SELECT seq, run_id, session, tool AS source_type, title, CASE WHEN url <> '' THEN url ELSE arg_url END AS url,
  CASE WHEN error IS NOT NULL AND body = '' THEN 'ERROR: ' || error
       WHEN blk AND length(body) < 400 THEN 'BLOCKED/SHORT (' || coalesce(error, 'little text') || '). Treat claims from this URL as unverified until browser succeeds.'
       WHEN len(price_hints) > 0 THEN left('PRICES: ' || array_to_string(price_hints[1:8], ' | ') || chr(10) || left(body, 800), 1200)
       ELSE left(body, 800) END AS summary,
  CASE WHEN (error IS NOT NULL AND body = '') OR (blk AND length(body) < 400) THEN false ELSE error IS NULL END AS ok, blk AS blocked
FROM (SELECT *, trim(text, {_WS}) AS body, blocked OR prefer_browser AS blk FROM tool_results)"""
SEARCH_NOTES_SQL = """
SELECT seq, run_id, session, 'search' AS source_type, 'search: ' || left(query, 80) AS title,
  coalesce(list_filter(list_transform(results, lambda r: r.url), lambda u: u <> '')[1], '') AS url,
  left(array_to_string(list_filter(list_transform(results, lambda r: r.title), lambda t: t <> '')[1:5], '; '), 500) AS summary,
  array_to_string(list_filter(list_transform(results, lambda r: r.url), lambda u: u <> '')[1:5], '|') AS urls
FROM search_results"""
SOURCES_SQL = """
SELECT seq, pos, run_id, session, r.url AS url, r.title AS title, 'search_result' AS source_type, r.snippet AS snippet, NULL AS error, CAST(NULL AS VARCHAR) AS price_hints
FROM (SELECT seq, run_id, session, unnest(results) AS r, unnest(range(len(results))) AS pos FROM search_results) WHERE r.url <> ''
UNION ALL
SELECT seq, 0, run_id, session, url, title, CASE WHEN tool = 'web_fetch' THEN 'page' ELSE 'browser' END, NULL, error,
  CASE WHEN len(price_hints) > 0 THEN array_to_string(price_hints[1:15], '|') END
FROM tool_results WHERE url <> ''"""


# --- queries ----------------------------------------------------------------------------------------
def _fetches(s, d):
    """Stored pages with a status code, a content type and a learned hint derived from the page id."""
    k = F.col("page_id")
    status = (
        F.when(k % 11 == 0, 403).when(k % 11 == 1, 401).when(k % 11 == 2, 429).when(k % 11 == 3, 503)
        .when(k % 11 == 4, 404).when(k % 11 == 5, F.lit(None)).otherwise(200)
    )
    kind = F.when(k % 7 == 0, "application/pdf").when(k % 7 == 1, "text/plain").when(k % 7 == 2, F.lit(None)).otherwise("text/html; charset=utf-8")
    return page_texts(s, d).select(
        "page_id",
        EV.fetch_outcome(F.col("url"), status, kind, F.col("title"), F.col("text"), k % 13 == 0).alias("o"),
    ).select("page_id", "o.*")


_add(
    "fetch_outcomes",
    _fetches,
    f"""WITH {_HTML_SQL},
f AS (SELECT p.page_id, p.url, t.title, t.text, p.page_id % 13 = 0 AS hint,
    CASE p.page_id % 11 WHEN 0 THEN 403 WHEN 1 THEN 401 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN 404 WHEN 5 THEN NULL ELSE 200 END AS st,
    CASE p.page_id % 7 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/plain' WHEN 2 THEN NULL ELSE 'text/html; charset=utf-8' END AS ct
  FROM pages p JOIN page_text t USING (page_id)),
g AS (SELECT *, CASE WHEN length(text) > 12000 THEN left(text, 12000) || chr(10) || chr(10) || '...[truncated at 12000 chars]' ELSE text END AS body,
    CASE WHEN hint THEN 'hint' WHEN st IN (401, 403) THEN 'denied' WHEN st IS NULL OR st >= 400 THEN 'failed'
         WHEN ct LIKE 'text/%' THEN 'read' ELSE 'other' END AS arm FROM f)
SELECT page_id, CASE WHEN arm = 'read' THEN title ELSE '' END AS title,
  CASE arm WHEN 'read' THEN body WHEN 'other' THEN '[Non-text content type: ' || coalesce(ct, '') || ']' ELSE '' END AS text,
  CASE WHEN arm = 'hint' THEN 'Learned tactic for ' || regexp_replace(lower(regexp_extract(url, '^[^/]*//([^/?#]*)', 1)), '^www\\.', '') ||
         ': prefer browser_open (previous HTTP fetches failed). Use browser_open.'
       WHEN arm = 'denied' THEN st || ' Forbidden/Unauthorized – use browser_open'
       WHEN arm = 'failed' THEN 'request failed: ' || coalesce(CAST(st AS VARCHAR), 'no response')
       WHEN arm = 'read' AND length(body) < 400 THEN 'Page text very short – consider browser_open' END AS error,
  CASE WHEN arm IN ('denied', 'read', 'other') THEN st END AS status_code,
  arm IN ('hint', 'denied') OR (arm = 'read' AND length(body) < 400) AS blocked,
  arm <> 'hint' AND coalesce(st IN (429, 503), false) AS retryable, hint AS prefer_browser
FROM g""",
)


def _outcomes(s, d):
    none = F.lit(None)
    pages = T.tool_results(s, d).select(
        "seq", "tool",
        EV.tool_outcome(F.col("tool"), F.col("arg_url"), F.col("url"), F.col("text"), F.col("error"), F.col("blocked"), none.cast(f"array<{EV.SEARCH_HIT}>")).alias("o"),
    )
    searches = T.search_results(s, d).select(
        "seq", F.lit("web_search").alias("tool"),
        EV.tool_outcome(F.lit("web_search"), none.cast("string"), none.cast("string"), none.cast("string"), none.cast("string"), none.cast("boolean"), F.col("results")).alias("o"),
    )
    return pages.unionByName(searches).select("seq", "tool", "o.*")


_add(
    "tool_outcomes",
    _outcomes,
    T.with_tables(["tool_results", "search_results"], """
SELECT seq, tool, CASE WHEN url <> '' THEN url ELSE arg_url END AS url, error IS NULL OR (text <> '' AND NOT blocked) AS ok, blocked, error FROM tool_results
UNION ALL
SELECT seq, 'web_search', NULL, len(rest) > 0 AND NOT (len(rest) = 1 AND rest[1].title = 'Search error'), false, NULL
FROM (SELECT seq, list_filter(results, lambda r: r.title <> 'Query notice') AS rest FROM search_results)"""),
)
_add(
    "page_notes",
    lambda s, d: EV.notes_from_results(T.tool_results(s, d)),
    T.with_tables(["tool_results"], NOTES_SQL),
)
_add(
    "search_notes",
    lambda s, d: EV.notes_from_searches(T.search_results(s, d)).select("seq", "run_id", "session", "source_type", "title", "url", "summary", F.array_join("urls", "|").alias("urls")),
    T.with_tables(["search_results"], SEARCH_NOTES_SQL),
)
_add(
    "note_scores",
    lambda s, d: EV.notes_from_results(T.tool_results(s, d)).select("seq", EV.note_priority(F.col("source_type"), F.col("summary"), F.col("ok")).alias("score")),
    T.with_tables(["tool_results"], """
SELECT seq, CASE WHEN source_type IN ('browser_open','browser_click','browser_type','browser_extract_text','browser') THEN 30 WHEN source_type = 'web_fetch' THEN 15
    WHEN source_type = 'search' THEN 5 ELSE 0 END
  + CASE WHEN regexp_matches(lower(summary), 'price|€|eur|prijs') THEN 25 ELSE 0 END
  - CASE WHEN NOT ok OR regexp_matches(lower(summary), 'error|blocked') THEN 5 ELSE 0 END
  - CASE WHEN starts_with(lower(summary), 'search error') THEN 20 ELSE 0 END AS score FROM notes""", {"notes": NOTES_SQL}),
)


def _ceilings(s, d):
    cols = ["run_id", "source_type", "url", "ok", "blocked"]
    pages = EV.notes_from_results(T.tool_results(s, d)).select(*cols)
    hits = EV.notes_from_searches(T.search_results(s, d)).withColumn("url", F.explode("urls")).select(*cols)
    return EV.evidence_ceiling(pages.unionByName(hits)).select("run_id", "url", "ceiling")


_add(
    "evidence_ceiling",
    _ceilings,
    T.with_tables(["tool_results", "search_results"], """
SELECT run_id, url, CASE max(lvl) WHEN 2 THEN 'verified' WHEN 1 THEN 'partly' ELSE 'unconfirmed' END AS ceiling
FROM (SELECT run_id, url, CASE WHEN ok THEN 2 WHEN blocked THEN 1 ELSE 0 END AS lvl FROM notes
      UNION ALL SELECT run_id, unnest(string_split(urls, '|')), 1 FROM search_notes WHERE urls <> '')
WHERE url <> '' GROUP BY run_id, url""", {"notes": NOTES_SQL, "search_notes": SEARCH_NOTES_SQL}),
)
_add(
    "context_searches",
    lambda s, d: T.search_results(s, d).select("seq", F.posexplode(EV.search_for_context(F.col("results"))).alias("pos", "r")).select("seq", "pos", "r.*"),
    T.with_tables(["search_results"], """
SELECT seq, pos, left(r.title, 200) AS title, r.url AS url, left(r.snippet, 300) AS snippet
FROM (SELECT seq, unnest(results[1:5]) AS r, unnest(range(least(len(results), 5))) AS pos FROM search_results)"""),
)
_add(
    "context_pages",
    lambda s, d: EV.page_for_context(T.tool_results(s, d)).select("seq", "tool", "url", "title", "error", "blocked", "text", F.array_join("price_hints", "|").alias("hints")),
    T.with_tables(["tool_results"], """
SELECT seq, tool, url, title, error, blocked, array_to_string(price_hints[1:25], '|') AS hints,
  CASE WHEN length(text) > b THEN left(text, b) || chr(10) || '...[truncated ' || length(text) || ' -> ' || b ||
    ' chars; scroll or open a more specific URL if you need lower content]' ELSE text END AS text
FROM (SELECT *, CASE WHEN starts_with(tool, 'browser_') THEN 4000 ELSE 2500 END AS b FROM tool_results)"""),
)
_add(
    "first_items",
    lambda s, d: T.tool_results(s, d).select("seq", *[F.array_join(F.slice("price_hints", 1, n), "|").alias(f"first_{n}") for n in (8, 15, 20, 25)]),
    T.with_tables(["tool_results"], "SELECT seq, " + ", ".join(f"array_to_string(price_hints[1:{n}], '|') AS first_{n}" for n in (8, 15, 20, 25)) + " FROM tool_results"),
)
_add(
    "all_sources",
    lambda s, d: EV.all_sources(T.search_results(s, d), T.tool_results(s, d)).withColumn("price_hints", F.array_join("price_hints", "|")),
    T.with_tables(["search_results", "tool_results"], SOURCES_SQL),
)
_add(
    "distinct_sources",
    lambda s, d: EV.distinct_sources(EV.all_sources(T.search_results(s, d), T.tool_results(s, d))).select("run_id", "url", "seq", "source_type", "title", "error"),
    T.with_tables(["search_results", "tool_results"], """
SELECT run_id, url, seq, source_type, title, error
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, url ORDER BY seq, pos) AS r FROM sources) WHERE r = 1""", {"sources": SOURCES_SQL}),
)


def _ordered_union(s, d):
    """Parameter names of two successive visits as one ordered set."""
    v = T.search_urls(s, d)
    names = U.param_names(U.url_query(F.col("url")))
    later = v.select((F.col("seq") - 1).alias("seq"), names.alias("later"))
    return v.select("seq", names.alias("names")).join(later, "seq").select(
        "seq", F.array_join(F.array_distinct(F.concat("names", "later")), "|").alias("names")
    )


_add(
    "ordered_union",
    _ordered_union,
    T.with_tables(["search_urls"], """
SELECT seq, coalesce(string_agg(n, '|' ORDER BY i), '') AS names FROM (
  SELECT seq, n, min(i) AS i FROM (
    SELECT a.seq, unnest(list_concat(a.ns, b.ns, [NULL])) AS n, unnest(range(len(a.ns) + len(b.ns) + 1)) AS i
    FROM names a JOIN names b ON b.seq = a.seq + 1) GROUP BY seq, n) GROUP BY seq""", {
        "names": """SELECT seq, CASE WHEN contains(url, '?') THEN list_transform(string_split(split_part(split_part(url, '?', 2), '#', 1), '&'),
            lambda x: url_decode(split_part(x, '=', 1))) ELSE CAST([] AS VARCHAR[]) END AS ns FROM search_urls"""}),
)
