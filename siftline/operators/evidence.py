"""Tool results to evidence: outcomes, notes, prompt-sized results and sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftline import constants as K
from siftline.functions import text as TX, urls as U

SEARCH_HIT = "struct<title:string,url:string,snippet:string>"


def _some(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


# --- fetch and tool outcomes ----------------------------------------------------------------------


def fetch_outcome(
    url: Column,
    status_code: Column,
    content_type: Column,
    title: Column,
    text: Column,
    prefers_browser: Column,
    max_chars: int = K.PAGE_MAX_CHARS,
) -> Column:
    """Outcome of a plain fetch as ``struct<title, text, error, status_code, blocked, retryable, prefer_browser>``.

    ``status_code`` NULL means the request itself failed; ``text`` is the page's visible text.
    """
    hinted = F.coalesce(prefers_browser, F.lit(False))
    denied = status_code.isin(401, 403)
    busy = F.coalesce(status_code.isin(429, 503), F.lit(False))
    failed = status_code.isNull() | (status_code >= 400)
    content_type = F.coalesce(content_type, F.lit(""))
    other_type = ~(content_type.contains("text/html") | content_type.contains("text/plain"))
    body = TX.cut_page(text, max_chars)
    short = F.length(body) < K.SHORT_PAGE_CHARS
    read = ~hinted & ~F.coalesce(failed, F.lit(True)) & ~other_type
    error = (
        F.when(hinted, learned_tactic_error(url))
        .when(denied, F.concat(status_code.cast("string"), F.lit(" Forbidden/Unauthorized – use browser_open")))
        .when(failed, F.concat(F.lit("request failed: "), F.coalesce(status_code.cast("string"), F.lit("no response"))))
        .when(read & short, F.lit(K.SHORT_PAGE_ADVICE))
    )
    return F.struct(
        F.when(read, title).otherwise("").alias("title"),
        F.when(hinted | failed, "")
        .when(other_type, F.concat(F.lit("[Non-text content type: "), content_type, F.lit("]")))
        .otherwise(body)
        .alias("text"),
        error.alias("error"),
        F.when(hinted | (failed & ~denied), F.lit(None)).otherwise(status_code).alias("status_code"),
        F.coalesce(hinted | denied | (read & short), F.lit(False)).alias("blocked"),
        (busy & ~hinted).alias("retryable"),
        hinted.alias("prefer_browser"),
    )


def learned_tactic_error(url: Column) -> Column:
    return F.concat(
        F.lit("Learned tactic for "), U.netloc_key(url),
        F.lit(": prefer browser_open (previous HTTP fetches failed). Use browser_open."),
    )


def search_ok(results: Column) -> Column:
    """A search worked when something other than notices and a lone error row came back."""
    rest = F.filter(results, lambda r: F.coalesce(r["title"], F.lit("")) != "Query notice")
    lone_error = (F.size(rest) == 1) & F.coalesce(F.element_at(F.transform(rest, lambda r: r["title"]), 1) == "Search error", F.lit(False))
    return F.coalesce((F.size(rest) > 0) & ~lone_error, F.lit(False))


def tool_outcome(tool: Column, arg_url: Column, url: Column, text: Column, error: Column, blocked: Column, results: Column) -> Column:
    """``struct<url, ok, blocked, error>`` of one call; searches carry no URL."""
    is_search = tool == "web_search"
    err = F.when(~is_search & _some(error), error)
    blk = ~is_search & F.coalesce(blocked, F.lit(False))
    return F.struct(
        F.when(~is_search, F.coalesce(F.nullif(url, F.lit("")), arg_url)).alias("url"),
        F.when(is_search, search_ok(results)).otherwise(err.isNull() | (_some(text) & ~blk)).alias("ok"),
        blk.alias("blocked"),
        err.alias("error"),
    )


# --- notes ----------------------------------------------------------------------------------------


def search_note(query: Column, results: Column) -> Column:
    """``struct<title, summary, url, urls>`` of a search: first five non-empty titles and URLs."""
    pick = lambda f: F.slice(F.filter(F.transform(results, lambda r: r[f]), lambda v: v != ""), 1, 5)
    urls, titles = pick("url"), pick("title")
    return F.struct(
        F.concat(F.lit("search: "), F.substring(F.coalesce(query, F.lit("")), 1, 80)).alias("title"),
        F.substring(F.array_join(titles, "; "), 1, 500).alias("summary"),
        F.coalesce(F.try_element_at(urls, F.lit(1)), F.lit("")).alias("url"),
        urls.alias("urls"),
    )


def page_note(tool: Column, arg_url: Column, url: Column, title: Column, text: Column, error: Column, blocked: Column, prefer_browser: Column, hints: Column) -> Column:
    """``struct<title, url, summary, ok, blocked>`` of a page read; NULL for tools that leave no note."""
    body = TX.utrim(F.coalesce(text, F.lit("")))
    err = F.coalesce(error, F.lit(""))
    blk = F.coalesce(blocked, F.lit(False)) | F.coalesce(prefer_browser, F.lit(False))
    failed = (err != "") & (body == "")
    short = blk & (F.length(body) < K.SHORT_PAGE_CHARS)
    some_hints = F.coalesce(F.size(hints), F.lit(0)) > 0
    priced = F.concat(F.lit("PRICES: "), F.array_join(F.slice(hints, 1, 8), " | "), F.lit("\n"))
    head = F.substring(body, 1, 800)
    summary = (
        F.when(failed, F.concat(F.lit("ERROR: "), err))
        .when(
            short,
            F.concat(
                F.lit("BLOCKED/SHORT ("),
                F.when(err == "", F.lit("little text")).otherwise(err),
                F.lit("). Treat claims from this URL as unverified until browser succeeds."),
            ),
        )
        .otherwise(F.substring(F.when(some_hints, F.concat(priced, head)).otherwise(head), 1, 1200))
    )
    note = F.struct(
        F.coalesce(title, F.lit("")).alias("title"),
        F.coalesce(F.nullif(url, F.lit("")), arg_url, F.lit("")).alias("url"),
        summary.alias("summary"),
        F.when(failed | short, F.lit(False)).otherwise(err == "").alias("ok"),
        F.when(failed, blk).when(short, F.lit(True)).otherwise(blk).alias("blocked"),
    )
    return F.when(tool.isin(K.PAGE_TOOLS), note)


def notes_from_results(results: DataFrame) -> DataFrame:
    """Notes table from page results (``seq, run_id, session, tool, arg_url, url, title, text, ...``)."""
    note = page_note(*[F.col(c) for c in ("tool", "arg_url", "url", "title", "text", "error", "blocked", "prefer_browser", "price_hints")])
    return (
        results.filter(F.col("tool").isin(K.PAGE_TOOLS))
        .select("seq", "run_id", "session", F.col("tool").alias("source_type"), note.alias("_n"))
        .select("seq", "run_id", "session", "source_type", "_n.*")
    )


def notes_from_searches(searches: DataFrame) -> DataFrame:
    """Notes table from search results; ``ok`` and ``blocked`` are not set on search notes."""
    return searches.select(
        "seq", "run_id", "session", F.lit("search").alias("source_type"), search_note(F.col("query"), F.col("results")).alias("_n")
    ).select(
        "seq", "run_id", "session", "source_type", "_n.title", "_n.url", "_n.summary",
        F.lit(None).cast("boolean").alias("ok"), F.lit(None).cast("boolean").alias("blocked"), "_n.urls",
    )


def prioritized(notes: DataFrame) -> DataFrame:
    """Notes with their ``score`` and their place ``pos`` in the run, best first, ties by arrival.

    All notes of a run are ranked in one window: hand over the last ones, as for a synthesis.
    """
    scored = notes.withColumn("score", note_priority(F.col("source_type"), F.col("summary"), F.col("ok")))
    return scored.withColumn("pos", F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("score"), "seq")))


def note_priority(source_type: Column, summary: Column, ok: Column) -> Column:
    """Usefulness of a note for synthesis."""
    kind = F.lower(F.coalesce(source_type, F.lit("")))
    s = F.lower(F.coalesce(summary, F.lit("")))
    priced = reduce(lambda a, b: a | b, [s.contains(w) for w in K.PRICE_WORDS])
    points = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    return (
        points(kind.isin(K.SCORED_BROWSER_TYPES), 30)
        + points(kind == "web_fetch", 15)
        + points(kind == "search", 5)
        + points(priced, 25)
        - points((ok == F.lit(False)) | s.contains("error") | s.contains("blocked"), 5)
        - points(s.startswith("search error"), 20)
    )


def evidence_ceiling(notes: DataFrame) -> DataFrame:
    """How far claims about a URL may be trusted: read pages over snippets and blocked pages over nothing.

    ``notes`` has one row per (note, url); search notes give their hits one row each.
    """
    read = F.col("source_type").isin(K.PAGE_TOOLS) & F.col("ok")
    partial = (F.col("source_type") == "search") | F.col("blocked")
    level = F.when(read, 2).when(partial, 1).otherwise(0)
    label = F.when(F.col("level") == 2, "verified").when(F.col("level") == 1, "partly").otherwise("unconfirmed")
    return (
        notes.filter(_some(F.col("url")))
        .groupBy("run_id", "url")
        .agg(F.max(F.coalesce(level, F.lit(0))).alias("level"))
        .withColumn("ceiling", label)
    )


# --- results for a prompt -------------------------------------------------------------------------


def search_for_context(results: Column, limit: int = 5) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.transform(
        F.slice(results, 1, limit),
        lambda r: F.struct(
            F.substring(blank(r["title"]), 1, 200).alias("title"),
            blank(r["url"]).alias("url"),
            F.substring(blank(r["snippet"]), 1, 300).alias("snippet"),
        ),
    )


def page_for_context(results: DataFrame, max_chars: int = K.CONTEXT_CHARS) -> DataFrame:
    """Page results cut to prompt size: flags and scalars stay, hints are bounded, the body gets a budget."""
    budget = F.when(F.col("tool").startswith("browser_"), max(max_chars, K.BROWSER_CONTEXT_CHARS)).otherwise(max_chars)
    return results.withColumns(
        {"price_hints": F.slice("price_hints", 1, 25), "text": TX.cut_body(F.col("text"), budget)}
    )


# --- search hits and sources ----------------------------------------------------------------------


def search_hits(raw: DataFrame, hits: str = "hits") -> DataFrame:
    """Exploded search rows with the field names of either API version (``href``/``link``, ``body``/``snippet``)."""
    first = lambda *names: F.coalesce(*[F.nullif(F.col(f"_h.{n}"), F.lit("")) for n in names], F.lit(""))
    return raw.select(
        *[c for c in raw.columns if c != hits], F.posexplode(hits).alias("pos", "_h")
    ).select(
        *[c for c in raw.columns if c != hits], "pos",
        first("title").alias("title"), first("href", "link").alias("url"), first("body", "snippet").alias("snippet"),
    )


def all_sources(searches: DataFrame, pages: DataFrame) -> DataFrame:
    """Every source a run touched: search hits with a URL and page reads; repeats stay."""
    hits = searches.select("seq", "run_id", "session", F.posexplode("results").alias("pos", "r")).filter(_some(F.col("r.url")))
    from_search = hits.select(
        "seq", "pos", "run_id", "session", F.col("r.url").alias("url"), F.coalesce("r.title", F.lit("")).alias("title"),
        F.lit("search_result").alias("source_type"), F.coalesce("r.snippet", F.lit("")).alias("snippet"),
    )
    from_pages = pages.filter(F.col("tool").isin(K.PAGE_TOOLS) & _some(F.col("url"))).select(
        "seq", F.lit(0).alias("pos"), "run_id", "session", "url", F.coalesce("title", F.lit("")).alias("title"),
        F.when(F.col("tool") == "web_fetch", "page").otherwise("browser").alias("source_type"), "error",
        F.when(F.size("price_hints") > 0, F.slice("price_hints", 1, 15)).alias("price_hints"),
    )
    return from_search.unionByName(from_pages, allowMissingColumns=True)


def distinct_sources(sources: DataFrame) -> DataFrame:
    """First row per (run, URL)."""
    rest = [c for c in sources.columns if c not in ("run_id", "url")]
    return (
        sources.filter(_some(F.col("url")))
        .groupBy("run_id", "url")
        .agg(F.min_by(F.struct(*rest), F.struct("seq", "pos")).alias("_s"))
        .select("run_id", "url", "_s.*")
    )
