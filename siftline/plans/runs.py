"""Queries over whole runs: audits, summaries, digests, reports and prompt tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline import constants as K
from siftline.functions import messages as M
from siftline.operators import audit as AU, digests as DG, evidence as EV, guard as GD, ordered as OR, prompts as PR, runs as R
from siftline.plans import learning as LN, shortlists as SH
from siftline.plans.evidence import NOTES_SQL, SOURCES_SQL
from siftline.sources import tables as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


BLOCK = 1 << 12
_WS = "' ' || chr(9) || chr(10) || chr(13)"
_HOST = r"regexp_replace(lower(split_part(regexp_extract({c}, '^[^/]*//([^/?#]*)', 1), ':', 1)), '^www\.', '')"
ACTIONS_SQL = f"SELECT *, {_HOST.format(c='url')} AS host FROM browser_events WHERE starts_with(tool, 'browser_')"


def notes(s, d):
    return EV.notes_from_results(T.tool_results(s, d))


def actions(s, d):
    return AU.browser_actions(T.browser_events(s, d))


# --- status and counters ----------------------------------------------------------------------------
_add(
    "run_status",
    lambda s, d: R.run_status(*T.session_ends(s, d)).withColumn("succeeded", R.succeeded(F.col("status"))),
    T.with_tables(["runs", "sessions"], """
SELECT *, status = 'completed' OR ends_with(status, '+forced_report') AS succeeded FROM (
  SELECT run_id, mode,
    CASE WHEN mode = 'single' THEN first || CASE WHEN synthesis_ok AND (first LIKE 'timeout%' OR first = 'llm_error') THEN '+forced_report' ELSE '' END
      WHEN stopped = 'cancelled' THEN 'cancelled'
      WHEN synthesis_ok THEN CASE WHEN stopped IS NOT NULL THEN 'limit+forced_report' WHEN erred THEN 'llm_error+forced_report' ELSE 'completed' END
      ELSE coalesce(stopped, 'error') END AS status,
    CASE WHEN mode = 'single' THEN CASE WHEN first LIKE 'timeout%' THEN 'limit' WHEN first <> 'completed' THEN first END
      WHEN stopped = 'cancelled' THEN 'cancelled' WHEN stopped IS NOT NULL THEN 'limit' WHEN erred THEN 'llm_error'
      WHEN NOT synthesis_ok THEN 'critic_failed' END AS stop_reason
  FROM (SELECT r.*, s.first, s.stopped, s.erred FROM runs r JOIN (
      SELECT run_id, arg_min(status, session_no) AS first, arg_min(status, session_no) FILTER (stop) AS stopped,
        coalesce(bool_or(status = 'llm_error' AND session_no < coalesce(stop_at, 9223372036854775807)), false) AS erred
      FROM (SELECT *, status LIKE 'timeout%' OR status = 'cancelled' AS stop,
              min(CASE WHEN status LIKE 'timeout%' OR status = 'cancelled' THEN session_no END) OVER (PARTITION BY run_id) AS stop_at FROM sessions)
      GROUP BY run_id) s USING (run_id)))"""),
)


def run_summary(s, d):
    sources = EV.all_sources(T.search_results(s, d), T.tool_results(s, d))
    return R.run_summary(T.run_log(s, d), notes(s, d), sources, SH.merged(s, d))


SUMMARY_SQL = """
SELECT l.run_id, arg_max(status, seq) FILTER (status IS NOT NULL) AS status, CASE WHEN bool_or(starts_with(type, 'planner_')) THEN 'planned' ELSE 'single' END AS mode, min(ts) AS started_at, max(ts) AS finished_at,
  round(epoch_us(max(ts))/1e6 - epoch_us(min(ts))/1e6, 1) AS elapsed_seconds, count(*) FILTER (type IN ('llm_request', 'planner_request')) AS llm_calls,
  count(*) FILTER (type = 'tool_result') AS tool_calls, count(*) FILTER (tool = 'web_search') AS search_calls,
  (SELECT count(*) FROM notes n WHERE n.run_id = l.run_id) AS notes_count,
  (SELECT count(*) FROM sources n WHERE n.run_id = l.run_id) AS sources_count,
  (SELECT count(*) FROM merged n WHERE n.run_id = l.run_id) AS shortlist_count
FROM run_log l GROUP BY l.run_id"""
_ALL = {"notes": NOTES_SQL, "sources": SOURCES_SQL, **SH.CTES}
_add("run_summary", run_summary, T.with_tables(["run_log", "tool_results", "search_results", "candidates"], SUMMARY_SQL, _ALL))
_add(
    "state_documents",
    lambda s, d: R.state_document(
        run_summary(s, d).withColumns({"updated_at": F.col("finished_at"), "progress": F.lit("finished"), "key_findings": F.lit("")})
    ),
    T.with_tables(["run_log", "tool_results", "search_results", "candidates"], """
SELECT run_id, concat_ws(chr(10), '# Research state', '', '- Updated: ' || strftime(finished_at, '%Y-%m-%dT%H:%M:%S'), '- Status: ' || coalesce(status, 'running'), '- LLM calls: ' || llm_calls,
  '- Tool calls: ' || tool_calls, '- Sources: ' || sources_count, '- Notes: ' || notes_count, '', '## Progress', 'finished', '', '## Key findings (compact)', '(none yet)', '') AS document
FROM summary""", {**_ALL, "summary": SUMMARY_SQL}),
)

# --- audits -----------------------------------------------------------------------------------------
_add(
    "limit_breaches",
    lambda s, d: AU.limit_breaches(T.run_log(s, d), session_budget=12, max_runtime=86400 * 3, block_rows=BLOCK),
    T.with_tables(["run_log"], """
SELECT run_id, seq, reason, llm_before, tools_before FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS k FROM (
    SELECT run_id, seq, llm - 1 AS llm_before, tools AS tools_before,
      CASE WHEN ts - start > INTERVAL 3 DAY THEN 'timeout_runtime' WHEN llm - 1 >= 80 THEN 'timeout_llm' WHEN sess - 1 >= 12 THEN 'session_budget' WHEN tools >= 150 THEN 'timeout_tools' END AS reason
    FROM (SELECT *, count(*) FILTER (type IN ('llm_request', 'planner_request')) OVER (PARTITION BY run_id ORDER BY seq) AS llm, count(*) FILTER (type = 'tool_result') OVER (PARTITION BY run_id ORDER BY seq) AS tools,
            count(*) FILTER (type = 'llm_request') OVER (PARTITION BY run_id, session ORDER BY seq) AS sess, min(ts) OVER (PARTITION BY run_id) AS start FROM run_log)
    WHERE type = 'llm_request') WHERE reason IS NOT NULL) WHERE k = 1"""),
)
_add(
    "refused_searches",
    lambda s, d: AU.refused_searches(T.run_log(s, d), block_rows=BLOCK),
    T.with_tables(["run_log"], "SELECT * FROM (SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS search_no FROM run_log WHERE tool = 'web_search') WHERE search_no > 60"),
)
_add(
    "host_action_counts",
    lambda s, d: AU.host_action_counts(actions(s, d), block_rows=BLOCK),
    T.with_tables(["browser_events"], """
SELECT seq, run_id, session_id, host, n AS action_no, n >= 8 AS over_budget
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, session_id, host ORDER BY seq) AS n FROM actions)""", {"actions": ACTIONS_SQL}),
)
_NOOPS_SQL = """
SELECT seq, run_id, session_id, host, url, error, pu IS NOT NULL AND (error IS NOT NULL OR (url = pu AND len(list_filter(price_hints, lambda x: NOT list_contains(ph, x))) = 0)) AS noop
FROM (SELECT *, lag(url) OVER w AS pu, lag(price_hints) OVER w AS ph FROM actions WINDOW w AS (PARTITION BY run_id, session_id, host ORDER BY seq))"""
_add("noop_actions", lambda s, d: AU.noop_actions(actions(s, d), BLOCK).select("seq", "run_id", "session_id", "host", "noop"),
     T.with_tables(["browser_events"], "SELECT seq, run_id, session_id, host, noop FROM noops", {"actions": ACTIONS_SQL, "noops": _NOOPS_SQL}))
_add(
    "hint_subsets",
    lambda s, d: OR.running(T.tool_results(s, d).select("run_id", "seq", "price_hints"), ["run_id"], "seq", BLOCK, lags={"before": F.col("price_hints")})
    .filter(F.col("before").isNotNull()).select("run_id", "seq", AU.subset_of("price_hints", "before").alias("subset")),
    T.with_tables(["tool_results"], """
SELECT run_id, seq, len(list_filter(price_hints, lambda x: NOT list_contains(b, x))) = 0 AS subset
FROM (SELECT *, lag(price_hints) OVER (PARTITION BY run_id ORDER BY seq) AS b FROM tool_results) WHERE b IS NOT NULL"""),
)
_add(
    "noop_streaks",
    lambda s, d: AU.noop_streaks(AU.noop_actions(actions(s, d), BLOCK), block_rows=BLOCK).select("seq", "run_id", "session_id", "host", "streak", "abandoned"),
    T.with_tables(["browser_events"], """
SELECT seq, run_id, session_id, host, k AS streak, k >= 2 AS abandoned FROM (
  SELECT *, CASE WHEN noop THEN count(*) FILTER (noop) OVER (PARTITION BY run_id, session_id, host, island ORDER BY seq) ELSE 0 END AS k
  FROM (SELECT *, count(*) FILTER (NOT noop) OVER (PARTITION BY run_id, session_id, host ORDER BY seq) AS island FROM noops))""",
                  {"actions": ACTIONS_SQL, "noops": _NOOPS_SQL}),
)
_add(
    "failure_streaks",
    lambda s, d: AU.failure_streaks(T.browser_events(s, d), block_rows=BLOCK).select("seq", "run_id", "session_id", "streak", "fires"),
    T.with_tables(["browser_events"], """
SELECT seq, run_id, session_id, k AS streak, k > 0 AND k % 3 = 0 AS fires FROM (
  SELECT *, CASE WHEN failed THEN count(*) FILTER (failed) OVER (PARTITION BY run_id, session_id, island ORDER BY seq) ELSE 0 END AS k
  FROM (SELECT *, count(*) FILTER (NOT failed) OVER (PARTITION BY run_id, session_id ORDER BY seq) AS island
        FROM (SELECT *, error IS NOT NULL OR blocked OR NOT ok AS failed FROM browser_events WHERE starts_with(tool, 'browser_'))))"""),
)
_add(
    "live_tab",
    lambda s, d: AU.live_tab(T.attempts(s, d), BLOCK),
    T.with_tables(["attempts"], """
SELECT seq, run_id, session_id, tool, coalesce(arg_url, lag(tab_after) OVER (PARTITION BY run_id, session_id ORDER BY seq)) AS url_in_force, tab_after
FROM (SELECT *, last_value(CASE WHEN starts_with(tool, 'browser_') AND starts_with(url, 'http') THEN url WHEN tool = 'browser_open' AND error IS NULL THEN arg_url END IGNORE NULLS)
        OVER (PARTITION BY run_id, session_id ORDER BY seq) AS tab_after FROM attempts)"""),
)
# The guard's verdicts feed back on themselves: one recursion step takes the next attempt of every session.
_URL_CUT = {
    "q": "CASE WHEN contains({u}, '?') THEN split_part(split_part({u}, '?', 2), '#', 1) ELSE '' END",
    "p": "regexp_extract(split_part(split_part({u}, '#', 1), '?', 1), '^[^/]*//[^/]*(.*)$', 1)",
}
_GUARD_CTES = {
    **LN.PATTERN_CTES,
    "keyed": rf"SELECT DISTINCT {_HOST.format(c='arg_url')} AS host FROM attempts WHERE tool = 'browser_open' AND regexp_matches(arg_url, '^https?://[^/?#]+/?$')",
    "matched": LN._MATCH_SQL,
    "cuts": f"SELECT *, coalesce(arg_url, '') AS arg, coalesce(url, '') AS u, {_URL_CUT['q'].format(u='arg_url')} AS q, rtrim({_URL_CUT['p'].format(u='arg_url')}, '/') AS p FROM attempts WHERE starts_with(tool, 'browser_')",
    "facts": rf"""
SELECT c.run_id, c.session_id, c.seq, c.tool, c.arg, c.u, coalesce(c.error, '') <> '' AS errored, c.price_hints[1:20] AS hints, c.arg_host, c.url_host, c.arg_root, c.arg_search,
  c.tool = 'browser_open' AND c.arg_root AND m.pattern_key IS NOT NULL AS known, row_number() OVER (PARTITION BY run_id, session_id ORDER BY seq) AS k
FROM (SELECT *, {_HOST.format(c='arg')} AS arg_host, {_HOST.format(c='u')} AS url_host,
    arg <> '' AND q = '' AND (p IN ('', '/nl', '/en', '/fr', '/de', '/be', '/nl-be', '/fr-be') OR (length(p) <= 4 AND length(p) - length(replace(p, '/', '')) <= 1)) AS arg_root,
    contains(q, '=') OR regexp_matches(lower(p) || '/', '/zoeken|/search|/results|/vakantie/|/all-inclusive|/serp|/find') AS arg_search FROM cuts) c
LEFT JOIN matched m ON m.host = c.arg_host""",
}
GUARD_SQL = f"""
SELECT run_id, session_id, seq, tool, host, verdict, noop, action_no FROM (
WITH RECURSIVE steps(run_id, session_id, k, seq, tool, tab, tab_host, counts, noops, blocked, graced, pages, seen, host, verdict, noop, action_no) AS (
  SELECT DISTINCT run_id, session_id, 0::BIGINT, 0::BIGINT, '', '', '', MAP {{}}::MAP(VARCHAR, BIGINT), MAP {{}}::MAP(VARCHAR, BIGINT), []::VARCHAR[], []::VARCHAR[],
    MAP {{}}::MAP(VARCHAR, VARCHAR), MAP {{}}::MAP(VARCHAR, VARCHAR[]), '', '', false, 0::BIGINT FROM facts
  UNION ALL
  SELECT run_id, session_id, k, seq, tool, tab, tab_host,
    CASE WHEN acts THEN map_concat(counts, MAP {{host: n}}) ELSE counts END, CASE WHEN acts THEN map_concat(noops, MAP {{host: idle}}) ELSE noops END,
    CASE WHEN acts AND (idle >= {K.MAX_NOOPS_PER_HOST} OR n >= {K.MAX_ACTIONS_PER_HOST}) OR verdict = 'budget' THEN list_append(blocked, host) ELSE blocked END, graced,
    CASE WHEN acts THEN map_concat(pages, MAP {{host: page}}) ELSE pages END, CASE WHEN acts THEN map_concat(seen, MAP {{host: hints}}) ELSE seen END,
    host, verdict, noop, CASE WHEN acts THEN n WHEN host = '' OR verdict IN ('run', 'grace') THEN 0 ELSE before END
  FROM (SELECT *, CASE WHEN noop THEN coalesce(noops[host], 0) + 1 ELSE 0 END AS idle, coalesce(counts[host], 0) AS before, coalesce(counts[host], 0) + 1 AS n
   FROM (SELECT *, coalesce(acts AND map_contains(pages, host) AND (errored OR (page <> '' AND page = pages[host] AND len(list_filter(hints, lambda h: NOT list_contains(seen[host], h))) = 0)), false) AS noop
    FROM (SELECT *, goes AND host <> '' AS acts, CASE WHEN tab <> '' THEN tab ELSE u END AS page
     FROM (SELECT * REPLACE (new_tab AS tab, new_host AS tab_host), CASE WHEN NOT goes THEN target WHEN new_host <> '' THEN new_host WHEN url_host <> '' THEN url_host ELSE target END AS host
      FROM (SELECT *, CASE WHEN goes AND starts_with(u, 'http') THEN u WHEN goes AND opens THEN arg ELSE tab END AS new_tab,
          CASE WHEN goes AND starts_with(u, 'http') THEN url_host WHEN goes AND opens THEN arg_host ELSE tab_host END AS new_host
       FROM (SELECT *, verdict IN ('run', 'grace') AS goes, tool = 'browser_open' AND arg <> '' AND NOT errored AS opens
        FROM (SELECT * REPLACE (CASE WHEN forgiven THEN list_append(graced, target) ELSE graced END AS graced, CASE WHEN forgiven THEN list_filter(blocked, lambda b: b <> target) ELSE blocked END AS blocked,
            CASE WHEN forgiven THEN map_concat(noops, MAP {{target: 0::BIGINT}}) ELSE noops END AS noops),
            CASE WHEN shut AND NOT forgiven THEN 'blocked_host' WHEN tool = 'browser_open' AND target <> '' AND arg <> '' AND known THEN 'blocked_root_open'
              WHEN target <> '' AND coalesce(counts[target], 0) >= {K.MAX_ACTIONS_PER_HOST} THEN 'budget' WHEN forgiven THEN 'grace' ELSE 'run' END AS verdict
         FROM (SELECT *, shut AND tool = 'browser_open' AND NOT list_contains(graced, target) AND arg <> '' AND arg <> tab AND arg_search AND NOT arg_root AS forgiven
          FROM (SELECT *, target <> '' AND list_contains(blocked, target) AS shut
           FROM (SELECT s.tab, s.tab_host, s.counts, s.noops, s.blocked, s.graced, s.pages, s.seen, f.*, CASE WHEN f.arg <> '' THEN f.arg_host ELSE s.tab_host END AS target
             FROM steps s JOIN facts f ON f.run_id = s.run_id AND f.session_id = s.session_id AND f.k = s.k + 1))))))))))
) SELECT * FROM steps WHERE k > 0)"""
_add(
    "session_guard",
    lambda s, d: GD.guard_sessions(GD.attempts_with_facts(T.attempts(s, d), LN.patterns(s, d))),
    T.with_tables(["attempts", "search_urls"], GUARD_SQL, _GUARD_CTES),
)

# --- digests, handoffs, reports ----------------------------------------------------------------------
LINES_SQL = """
SELECT *, '- [' || source_type || '] ' || coalesce(nullif(title, ''), nullif(url, ''), '') || ': ' || left(summary, 400) ||
  CASE WHEN url <> '' THEN ' (' || url || ')' ELSE '' END || CASE WHEN session <> '' THEN ' {session:' || session || '}' ELSE '' END AS line,
  CASE WHEN source_type LIKE 'browser%' AND source_type <> 'browser_scroll' THEN 30 WHEN source_type = 'web_fetch' THEN 15 ELSE 0 END
   + CASE WHEN regexp_matches(lower(summary), 'price|€|eur|prijs') THEN 25 ELSE 0 END
   - CASE WHEN NOT ok OR regexp_matches(lower(summary), 'error|blocked') THEN 5 ELSE 0 END
   - CASE WHEN starts_with(lower(summary), 'search error') THEN 20 ELSE 0 END AS score
FROM notes"""
# Running budget: the line that overflows becomes the marker, everything after it is dropped.
_BUDGET = """
SELECT {keys}, string_agg(CASE WHEN total <= {n} THEN line WHEN total - length(line) <= {n} AND cuts = 1 THEN '...[more notes truncated]' END, chr(10) ORDER BY pos) AS digest
FROM (SELECT *, count(*) FILTER (total > {n}) OVER (PARTITION BY {keys} ORDER BY pos) AS cuts FROM (
  SELECT *, sum(length(line)) OVER (PARTITION BY {keys} ORDER BY pos) AS total FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS pos FROM {src}))) GROUP BY {keys}"""
_NOTE_CTES = {"notes": NOTES_SQL, "lines": LINES_SQL}
_add(
    "notes_digest",
    lambda s, d: DG.notes_digest(notes(s, d), ["run_id"]),
    T.with_tables(["tool_results"], _BUDGET.format(keys="run_id", n=6000, order="seq", src="lines"), _NOTE_CTES),
)
_add(
    "notes_digest_prioritized",
    lambda s, d: DG.notes_digest(notes(s, d), ["run_id"], prioritize=True),
    T.with_tables(["tool_results"], _BUDGET.format(keys="run_id", n=6000, order="score DESC, seq", src="lines"), _NOTE_CTES),
)


def _budget_prefix(s, d):
    lines = notes(s, d).select("run_id", "session", "seq", DG.note_line().alias("line"))
    fit = DG.within_budget(lines, ["run_id", "session"], [F.asc("seq")], 4000, DG.MIN_NOTE_LINE, "seq")
    return fit.filter("fits").select("run_id", "session", "seq", "pos")


_add(
    "budget_prefix",
    _budget_prefix,
    T.with_tables(["tool_results"], """
SELECT run_id, session, seq, pos FROM (SELECT *, row_number() OVER w AS pos, sum(length(line)) OVER w AS total FROM lines
  WINDOW w AS (PARTITION BY run_id, session ORDER BY seq)) WHERE total <= 4000""", _NOTE_CTES),
)
_add(
    "prioritized_notes",
    lambda s, d: EV.prioritized(DG.latest_notes(notes(s, d))).select("run_id", "seq", "score", "pos"),
    T.with_tables(["tool_results"], """
SELECT run_id, seq, score, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, seq) AS pos
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS k FROM lines) WHERE k <= 80""", _NOTE_CTES),
)
_add(
    "latest_notes",
    lambda s, d: DG.latest_notes(notes(s, d)).select("run_id", "seq", "title", "url"),
    T.with_tables(["tool_results"], "SELECT run_id, seq, title, url FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS k FROM notes) WHERE k <= 80", {"notes": NOTES_SQL}),
)


def handoffs(s, d):
    sessions = T.read(s, d, "events").select((F.col("user_id") % 10).alias("run_id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session")).distinct()
    return DG.session_handoff(notes(s, d), sessions)


HANDOFF_CTES = {
    **_NOTE_CTES,
    "recent": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS k FROM lines) WHERE k <= 80",
    "all_sessions": "SELECT DISTINCT user_id % 10 AS run_id, 's' || user_id AS sess FROM events",
    "scoped": """SELECT s.sess, r.* FROM all_sessions s JOIN recent r ON r.run_id = s.run_id WHERE r.session = s.sess OR (r.k <= 15 AND NOT EXISTS (
        SELECT 1 FROM recent x WHERE x.run_id = s.run_id AND x.session = s.sess))""",
    "handoff": _BUDGET.format(keys="run_id, sess", n=2500, order="score DESC, seq", src="scoped"),
}
_add("session_handoffs", handoffs, T.with_tables(["tool_results"], "SELECT run_id, sess AS session, digest FROM handoff", HANDOFF_CTES))


def _unfinished(s, d):
    """Runs to report on, one per conversation, with their first user message as the task."""
    first = T.messages(s, d).filter(F.col("role") == "user").groupBy("run_id").agg(F.min_by("content", "turn").alias("task"))
    return first.withColumn("status", F.when(F.col("run_id") % 2 == 0, "timeout_llm").otherwise("error"))


def _short_drafts(s, d):
    """Messages without the long drafts of every other run, so that both kinds of report occur."""
    return T.messages(s, d).withColumn("role", F.when(F.col("run_id") % 2 == 0, "tool").otherwise(F.col("role")))


def partial_reports(s, d):
    sources = EV.all_sources(T.search_results(s, d), T.tool_results(s, d))
    digests = DG.notes_digest(DG.latest_notes(notes(s, d)), ["run_id"], 4000)
    return DG.partial_report_lines(_unfinished(s, d), _short_drafts(s, d), sources, digests)


_add(
    "partial_reports",
    partial_reports,
    T.with_tables(["messages", "tool_results", "search_results"], """
SELECT run_id, section, "at", pos, line FROM (
  SELECT run_id, 0 AS section, 0 AS "at", 0 AS pos, '# Research Report (partial – status: ' || status || ')' || chr(10) AS line FROM open
  UNION ALL SELECT run_id, 1, 0, 0, CASE WHEN draft IS NOT NULL THEN '> Run did not complete normally. Best available draft below.' || chr(10) ELSE '## Research question' END FROM open
  UNION ALL SELECT run_id, 2, 0, 0, coalesce(draft, left(task, 800) || CASE WHEN length(task) > 800 THEN '...' ELSE '' END || chr(10)) FROM open
  UNION ALL SELECT run_id, 3, 0, 0, '## Notes collected' FROM open WHERE draft IS NULL
  UNION ALL SELECT run_id, 4, 0, 0, coalesce(g.digest, '(none)') || chr(10) FROM open LEFT JOIN digests g USING (run_id) WHERE draft IS NULL
  UNION ALL SELECT run_id, 5, 0, 0, '## Sources retrieved' FROM open WHERE draft IS NULL
  UNION ALL SELECT o.run_id, 6, coalesce(f.seq, 0), coalesce(f.pos, 0),
     CASE WHEN f.url IS NULL THEN '- (no sources retrieved)' ELSE '- ' || coalesce(nullif(f.title, ''), f.url) || ' — ' || f.url || coalesce(' (error: ' || f.error || ')', '') END
     FROM open o LEFT JOIN firsts f USING (run_id) WHERE draft IS NULL
  UNION ALL SELECT run_id, 7, 0, 0, chr(10) || '## Uncertainties & limitations' FROM open WHERE draft IS NULL
  UNION ALL SELECT run_id, 8, 0, 0, '- Run ended with status: `' || status || '`' FROM open WHERE draft IS NULL
  UNION ALL SELECT run_id, 9, 0, 0, '- No complete agent report was produced.' || chr(10) FROM open WHERE draft IS NULL)""", {
        **_NOTE_CTES, "sources": SOURCES_SQL,
        "recent": HANDOFF_CTES["recent"], "digests": _BUDGET.format(keys="run_id", n=4000, order="seq", src="recent"),
        "firsts": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, url ORDER BY seq, pos) AS k FROM sources) WHERE k = 1",
        "texts": f"SELECT run_id, turn, role, CASE WHEN trim(content, {_WS}) <> '' THEN trim(content, {_WS}) ELSE trim(coalesce(thinking, ''), {_WS}) END AS t FROM messages",
        "open": """SELECT q.run_id, q.task, CASE WHEN q.run_id % 2 = 0 THEN 'timeout_llm' ELSE 'error' END AS status, m.draft
          FROM (SELECT run_id, arg_min(content, turn) AS task FROM messages WHERE role = 'user' GROUP BY run_id) q
          LEFT JOIN (SELECT run_id, arg_max(t, turn) AS draft FROM texts WHERE role = 'assistant' AND run_id % 2 = 1 AND length(t) > 200 GROUP BY run_id) m USING (run_id)"""}),
)

# --- prompt tables ----------------------------------------------------------------------------------


def _subtasks(s, d):
    """Three planned sub-tasks per run, in a plan message read by the plan parser."""
    raw = F.concat(F.lit('["Explore '), F.col("session"), F.lit('", "Verify", "Deepen"]'))
    first = T.candidates(s, d).groupBy("run_id").agg(F.min_by("session", "seq").alias("session"))
    return first.select("run_id", F.lit("Find a quiet place").alias("task"), F.posexplode(M.plan_steps(raw, F.lit("x"))).alias("pos", "subtask"))


def subtask_prompts(s, d):
    plan = _subtasks(s, d).withColumn("session", F.when(F.col("pos") > 0, F.concat(F.lit("s"), (F.col("run_id") + 10 * F.col("pos")).cast("string"))))
    prior = DG.session_handoff(notes(s, d), plan.filter(F.col("session").isNotNull()).select("run_id", "session"))
    return PR.subtask_prompts(plan, SH.shortlist_digest(s, d), prior)


_q = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
_add(
    "subtask_prompts",
    subtask_prompts,
    T.with_tables(["candidates", "tool_results"], f"""
SELECT p.run_id, p.pos, '## Full research task (context only)' || chr(10) || 'Find a quiet place' || chr(10) || chr(10) || '## Your focus for this session (' || (p.pos + 1) || '/3)' || chr(10) ||
  p.subtask || chr(10) || coalesce({_q(K.PROMPT_SHORTLIST_HEAD)} || trim(s.digest, {_WS}) || {_q(K.PROMPT_SHORTLIST_TAIL)}, CASE WHEN p.pos > 0 THEN {_q(K.PROMPT_SHORTLIST_NONE)} ELSE '' END) ||
  coalesce({_q(K.PROMPT_HANDOFF_HEAD)} || trim(h.digest, {_WS}) || chr(10), '') || {_q(K.PROMPT_SUBTASK_TAIL)} AS prompt
FROM (SELECT run_id, pos, CASE pos WHEN 0 THEN 'Explore ' || session WHEN 1 THEN 'Verify' ELSE 'Deepen' END AS subtask
      FROM (SELECT run_id, arg_min(session, seq) AS session FROM candidates GROUP BY run_id) CROSS JOIN (SELECT unnest([0, 1, 2]) AS pos)) p
LEFT JOIN shortlist_text s USING (run_id)
LEFT JOIN handoff h ON h.run_id = p.run_id AND p.pos > 0 AND h.sess = 's' || (p.run_id + 10 * p.pos)""",
                  {**HANDOFF_CTES, "all_sessions": "SELECT DISTINCT user_id % 10 AS run_id, 's' || (user_id % 10 + 10 * pos) AS sess FROM events CROSS JOIN (SELECT unnest([1, 2]) AS pos)",
                   **SH.CTES, "shortlist_text": SH.DIGEST_SQL.format(n=6000)}),
)


def synthesis_prompts(s, d):
    tasks = T.read(s, d, "events").select((F.col("user_id") % 12).alias("run_id")).distinct().withColumn("task", F.lit("Find a quiet place"))
    latest = DG.latest_notes(notes(s, d))
    return PR.synthesis_prompts(tasks, SH.shortlist_digest(s, d, 8000), DG.notes_digest(latest, ["run_id"], 6000, prioritize=True))


_add(
    "synthesis_prompts",
    synthesis_prompts,
    T.with_tables(["candidates", "tool_results"], f"""
SELECT t.run_id, 'Research question:' || chr(10) || 'Find a quiet place' || chr(10) || chr(10) || '## SHORTLIST (primary source for Ranking)' || chr(10) || coalesce(s.digest, '(shortlist empty)') ||
  chr(10) || chr(10) || '## Supporting notes (evidence / limitations only)' || chr(10) || coalesce(n.digest, '(no notes yet)') || chr(10) || chr(10) || {_q(K.PROMPT_SYNTHESIS_HEAD)} ||
  CASE WHEN s.digest IS NULL THEN {_q(K.RULE_NO_SHORTLIST)} ELSE {_q(K.RULE_SHORTLIST)} END || {_q(K.PROMPT_SYNTHESIS_TAIL)} AS prompt
FROM (SELECT DISTINCT user_id % 12 AS run_id FROM events) t LEFT JOIN shortlist_text s USING (run_id) LEFT JOIN note_text n USING (run_id)""",
                  {**HANDOFF_CTES, **SH.CTES, "shortlist_text": SH.DIGEST_SQL.format(n=8000),
                   "note_text": _BUDGET.format(keys="run_id", n=6000, order="score DESC, seq", src="recent")}),
)
_add(
    "response_repairs",
    lambda s, d: T.messages(s, d).filter(F.col("role") == "assistant").select("run_id", "turn", PR.repaired_report(F.col("content"), F.col("thinking")).alias("report")),
    T.with_tables(["messages"], f"""
SELECT run_id, turn, CASE WHEN length(t) > 100 THEN CASE WHEN contains(upper(t), 'RESEARCH_COMPLETE') THEN t ELSE 'RESEARCH_COMPLETE' || chr(10) || chr(10) || t END END AS report
FROM (SELECT run_id, turn, role, CASE WHEN trim(content, {_WS}) <> '' THEN trim(content, {_WS}) ELSE trim(coalesce(thinking, ''), {_WS}) END AS t FROM messages) WHERE role = 'assistant'"""),
)
