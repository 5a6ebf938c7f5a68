"""Queries over what is learned across runs: access tactics, search-URL patterns, strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline import constants as K
from siftline.functions import urls as U
from siftline.operators import digests as DG, patterns as PT, strategies as ST, tactics as TC
from siftline.sources import tables as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


AS_OF = "2024-02-20 00:00:00"


def tactics(s, d):
    return TC.learn_tactics(T.tool_events(s, d))


def patterns(s, d):
    visits = T.search_urls(s, d)
    return PT.learn_patterns(visits)


# --- shared SQL ------------------------------------------------------------------------------------
_DOMAIN = r"regexp_replace(lower(regexp_extract({c}, '^[^/]*//([^/?#]*)', 1)), '^www\.', '')"
_HOST = r"regexp_replace(lower(split_part(regexp_extract({c}, '^[^/]*//([^/?#]*)', 1), ':', 1)), '^www\.', '')"
TACTICS_SQL = f"""
SELECT domain, 'browser_open' AS preferred_tool, CASE WHEN bool_or(fail) THEN 'HTTP fetch blocked or 403' ELSE 'browser succeeded' END AS reason,
  arg_max(ts, seq) AS last_verified, count(*) AS success_count, min(seq) AS pos
FROM (SELECT *, min(CASE WHEN fail OR (win AND blocked) THEN seq END) OVER (PARTITION BY domain) AS lock FROM (
  SELECT seq, ts, blocked, {_DOMAIN.format(c='url')} AS domain, tool = 'web_fetch' AND (blocked OR coalesce(contains(error, '403'), false)) AS fail,
    tool = 'browser_open' AND ok AS win FROM tool_events))
WHERE (fail OR win) AND seq >= lock AND domain <> '' GROUP BY domain"""
LOOKUP_SQL = """
SELECT DISTINCT d.domain, (SELECT t.preferred_tool FROM tactics t WHERE t.domain = d.domain OR ends_with(d.domain, '.' || t.domain)
  ORDER BY t.domain <> d.domain, t.pos LIMIT 1) AS preferred_tool FROM (SELECT DISTINCT domain FROM keyed) d"""
LEARNABLE_SQL = rf"""
SELECT seq, ts, {_DOMAIN.format(c='url')} AS domain, CASE WHEN path = '' THEN '/' ELSE path END AS path, ns,
  split_part(url, '://', 1) || '://' || auth || CASE WHEN path = '' THEN '/' ELSE path END ||
    CASE WHEN len(ns) = 0 THEN '' ELSE '?' || array_to_string(list_transform(ns[1:15], lambda x: x || '=…'), '&') END AS template
FROM (SELECT *, CASE WHEN q = '' THEN CAST([] AS VARCHAR[]) ELSE list_transform(string_split(q, '&'), lambda x: url_decode(split_part(x, '=', 1))) END AS ns
  FROM (SELECT seq, ts, url, regexp_extract(url, '^[^/]*//([^/?#]*)', 1) AS auth, regexp_replace(regexp_extract(url, '^[^/]*//[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS path,
    CASE WHEN contains(url, '?') THEN split_part(split_part(url, '?', 2), '#', 1) ELSE '' END AS q FROM search_urls
    WHERE starts_with(tool, 'browser_') AND coalesce(error, '') = '' AND (len(price_hints) > 0 OR contains(lower(url), 'zoeken') OR contains(lower(url), 'search'))))
WHERE starts_with(url, 'http') AND (len(ns) > 0 OR contains(path, '/zoeken') OR contains(lower(path), '/search'))
  AND (regexp_matches(path, '(?i)/(zoeken|search|results?)/?') OR len(list_filter(ns, lambda x: regexp_matches(lower(x),
    'participant|adult|pax|person|traveler|traveller|guest|date|depart|arrival|checkin|checkout|meal|board|duration|night|airport|from|origin|transport|room'))) > 0)"""
# Lists with a fixed number of places are folded in arrival order: an absent value enters in front.
_SLOTS = "list_reduce(list([{c}] ORDER BY seq), lambda acc, x: CASE WHEN list_contains(acc, x[1]) THEN acc ELSE list_concat(x, acc)[1:{n}] END, CAST([] AS VARCHAR[]))"
PATTERNS_SQL = f"""
SELECT g.*, p.param_names FROM (
  SELECT domain, count(*) AS success_count, arg_max(ts, seq) AS last_verified, min(seq) AS pos,
    {_SLOTS.format(c='path', n=8)} AS path_hints, {_SLOTS.format(c='template', n=5)} AS example_urls FROM learnable GROUP BY domain) g
LEFT JOIN (SELECT domain, list(n ORDER BY seq, i) AS param_names FROM (
    SELECT *, row_number() OVER (PARTITION BY domain ORDER BY seq, i) AS k FROM (
      SELECT domain, n, min(seq) AS seq, arg_min(i, seq) AS i FROM (SELECT domain, seq, unnest(ns) AS n, unnest(range(len(ns))) AS i FROM learnable) GROUP BY domain, n))
  WHERE k <= 40 GROUP BY domain) p USING (domain)"""
PATTERN_CTES = {"learnable": LEARNABLE_SQL, "patterns": PATTERNS_SQL}

# --- queries ----------------------------------------------------------------------------------------
_add("site_tactics", tactics, T.with_tables(["tool_events"], TACTICS_SQL))


def _lookup_urls(s, d):
    """URL variants plus sub-domains and parents of known hosts."""
    host = U.domain_key(F.col("url"))
    deeper = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("https://shop."), host, F.lit("/x"))).otherwise(
        F.concat(F.lit("https://"), F.regexp_replace(host, r"^[^.]+\.", ""), F.lit("/y"))
    )
    both = F.explode(F.array(F.struct("seq", "url"), F.struct((F.col("seq") + (1 << 40)).alias("seq"), deeper.alias("url"))))
    return T.tool_events(s, d).select(both.alias("v")).select("v.seq", "v.url")


_LOOKUP_URLS_SQL = rf"""
SELECT seq, url, {_DOMAIN.format(c='url')} AS domain, {_HOST.format(c='url')} AS host FROM (
  SELECT seq, url FROM tool_events UNION ALL
  SELECT seq + 1099511627776, CASE WHEN seq % 3 = 0 THEN 'https://shop.' || h || '/x' ELSE 'https://' || regexp_replace(h, '^[^.]+\.', '') || '/y' END
  FROM (SELECT seq, {_DOMAIN.format(c='url')} AS h FROM tool_events))"""
_add(
    "tactic_lookup",
    lambda s, d: TC.with_preferred_tool(_lookup_urls(s, d), tactics(s, d)).select("seq", "domain", "preferred_tool"),
    T.with_tables(["tool_events"], "SELECT k.seq, k.domain, l.preferred_tool FROM keyed k JOIN lookup l USING (domain)",
                  {"tactics": TACTICS_SQL, "keyed": _LOOKUP_URLS_SQL, "lookup": LOOKUP_SQL}),
)


def tool_routing(s, d):
    """Which tool each fetched URL should use, counted per domain: the flagship query.

    Events are counted per domain before the lookup, so the join sees one row per domain.
    """
    counts = _lookup_urls(s, d).groupBy(U.domain_key(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("events"))
    return counts.join(TC.preferred_tools(counts, tactics(s, d)), "domain", "left").select(
        "domain", F.coalesce("preferred_tool", F.lit("web_fetch")).alias("tool"), "events"
    )


_add(
    "tool_routing",
    tool_routing,
    T.with_tables(["tool_events"], "SELECT k.domain, coalesce(l.preferred_tool, 'web_fetch') AS tool, count(*) AS events FROM keyed k JOIN lookup l USING (domain) GROUP BY ALL",
                  {"tactics": TACTICS_SQL, "keyed": _LOOKUP_URLS_SQL, "lookup": LOOKUP_SQL}),
)
_add(
    "fetch_reroutes",
    lambda s, d: TC.reroute_fetches(T.tool_events(s, d), tactics(s, d)).select("seq", "url", "rerouted", "blocked", "error"),
    T.with_tables(["tool_events"], f"""
SELECT seq, url, coalesce(l.preferred_tool = 'browser_open', false) AS rerouted, blocked OR coalesce(l.preferred_tool = 'browser_open', false) AS blocked,
  CASE WHEN l.preferred_tool = 'browser_open' THEN 'Learned tactic for ' || k.domain || ': prefer browser_open (previous HTTP fetches failed). Use browser_open.' ELSE error END AS error
FROM keyed k JOIN lookup l USING (domain) WHERE tool = 'web_fetch'""",
                  {"tactics": TACTICS_SQL, "keyed": f"SELECT *, {_DOMAIN.format(c='url')} AS domain FROM tool_events", "lookup": LOOKUP_SQL}),
)


def _as_of_urls(s, d):
    """The events' own URLs, and those of sub-domains and parents in their place for some."""
    host = U.domain_key(F.col("url"))
    url = F.when(F.col("seq") % 4 == 1, F.concat(F.lit("https://shop."), host, F.lit("/x"))).when(
        F.col("seq") % 4 == 3, F.concat(F.lit("https://"), F.regexp_replace(host, r"^[^.]+\.", ""), F.lit("/y"))
    ).otherwise(F.col("url"))
    return T.tool_events(s, d).select("seq", url.alias("url"))


_AS_OF_URLS_SQL = rf"""
SELECT seq, CASE seq % 4 WHEN 1 THEN 'https://shop.' || h || '/x' WHEN 3 THEN 'https://' || regexp_replace(h, '^[^.]+\.', '') || '/y' ELSE url END AS url
FROM (SELECT seq, url, {_DOMAIN.format(c='url')} AS h FROM tool_events)"""
_VERSIONS_SQL = f"""
SELECT domain, seq, count(*) OVER w AS success_count, min(seq) OVER w AS pos
FROM (SELECT *, min(CASE WHEN fail OR (win AND blocked) THEN seq END) OVER (PARTITION BY domain) AS lock FROM (
  SELECT seq, blocked, {_DOMAIN.format(c='url')} AS domain, tool = 'web_fetch' AND (blocked OR coalesce(contains(error, '403'), false)) AS fail, tool = 'browser_open' AND ok AS win FROM tool_events))
WHERE (fail OR win) AND seq >= lock AND domain <> '' WINDOW w AS (PARTITION BY domain ORDER BY seq)"""
_KNOWN_SQL = """
SELECT seq, arg_min(success_count, (key <> domain)::BIGINT * 4611686018427387904 + pos) AS success_count
FROM (SELECT k.seq, k.domain, k.key, v.pos, v.success_count
  FROM (SELECT seq, domain, unnest([array_to_string(string_split(domain, '.')[i:], '.') FOR i IN range(1, len(string_split(domain, '.')) + 1)]) AS key FROM keyed) k
  ASOF JOIN versions v ON v.domain = k.key AND v.seq < k.seq) GROUP BY seq"""
_add(
    "tactic_lookup_as_of",
    lambda s, d: TC.with_tactic_as_of(_as_of_urls(s, d), TC.tactic_versions(T.tool_events(s, d))).select("seq", "domain", "tactic.preferred_tool", "tactic.success_count"),
    T.with_tables(["tool_events"], "SELECT k.seq, k.domain, CASE WHEN n.seq IS NOT NULL THEN 'browser_open' END AS preferred_tool, n.success_count FROM keyed k LEFT JOIN known n USING (seq)",
                  {"asked": _AS_OF_URLS_SQL, "versions": _VERSIONS_SQL, "keyed": f"SELECT seq, {_DOMAIN.format(c='url')} AS domain FROM asked", "known": _KNOWN_SQL}),
)
_add(
    "fetch_reroutes_as_of",
    lambda s, d: TC.reroute_fetches_as_of(T.tool_events(s, d), TC.tactic_versions(T.tool_events(s, d))).select("seq", "url", "rerouted", "blocked", "error"),
    T.with_tables(["tool_events"], """
SELECT k.seq, url, n.seq IS NOT NULL AS rerouted, blocked OR n.seq IS NOT NULL AS blocked,
  CASE WHEN n.seq IS NOT NULL THEN 'Learned tactic for ' || k.domain || ': prefer browser_open (previous HTTP fetches failed). Use browser_open.' ELSE error END AS error
FROM keyed k LEFT JOIN known n USING (seq)""",
                  {"versions": _VERSIONS_SQL, "keyed": f"SELECT *, {_DOMAIN.format(c='url')} AS domain FROM tool_events WHERE tool = 'web_fetch'", "known": _KNOWN_SQL}),
)
_add(
    "tactic_staleness",
    lambda s, d: tactics(s, d).select("domain", "last_verified", TC.is_stale(F.col("last_verified"), F.lit("2024-02-28 12:00:00").cast("timestamp_ntz")).alias("stale")),
    T.with_tables(["tool_events"], "SELECT domain, last_verified, last_verified < TIMESTAMP '2024-02-28 12:00:00' - INTERVAL 30 DAY AS stale FROM tactics", {"tactics": TACTICS_SQL}),
)
_lists = ("param_names", "path_hints", "example_urls")
_add(
    "url_patterns",
    lambda s, d: patterns(s, d).withColumns({c: F.array_join(c, "|") for c in _lists}),
    T.with_tables(["search_urls"], "SELECT domain, success_count, last_verified, pos, " +
                  ", ".join(f"coalesce(array_to_string({c}, '|'), '') AS {c}" for c in _lists) + " FROM patterns", PATTERN_CTES),
)


def _lookup_hosts(s, d):
    return _lookup_urls(s, d).withColumnRenamed("url", "arg_url")


_MATCH_SQL = """
SELECT h.host, (SELECT p.domain FROM patterns p WHERE p.domain = h.host OR ends_with(h.host, '.' || p.domain) OR ends_with(p.domain, '.' || h.host)
  ORDER BY p.domain <> h.host, p.pos LIMIT 1) AS pattern_key FROM (SELECT DISTINCT host FROM keyed WHERE host <> '') h"""
_add(
    "pattern_lookup",
    lambda s, d: PT.with_pattern(_lookup_hosts(s, d), patterns(s, d)).select("seq", "host", "pattern_key"),
    T.with_tables(["tool_events", "search_urls"], "SELECT k.seq, k.host, m.pattern_key FROM keyed k LEFT JOIN matched m USING (host)",
                  {**PATTERN_CTES, "keyed": _LOOKUP_URLS_SQL, "matched": _MATCH_SQL}),
)
_add(
    "root_open_rejections",
    lambda s, d: PT.reject_root_opens(T.attempts(s, d), patterns(s, d)).select("seq", "host", "error", "advice"),
    T.with_tables(["attempts", "search_urls"], r"""
SELECT k.seq, k.host, 'Memory-first: host ' || k.host || ' has learned search URL patterns. Do not open the bare homepage first.' AS error,
  'Build a deep-link/search URL using learned path + params, with values from the current task constraints. paths=[' || array_to_string(p.path_hints[1:3], ', ') ||
  '] params=[' || coalesce(array_to_string(p.param_names[1:10], ', '), '') || ']. Only use the homepage if that deep-link fails (404/empty).' AS advice
FROM keyed k JOIN matched m USING (host) JOIN patterns p ON p.domain = m.pattern_key""", {
        **PATTERN_CTES,
        "keyed": rf"SELECT seq, {_HOST.format(c='arg_url')} AS host FROM attempts WHERE tool = 'browser_open' AND regexp_matches(arg_url, '^https?://[^/?#]+/?$')",
        "matched": _MATCH_SQL}),
)
_MATCH_AS_OF_SQL = """
SELECT k.*, (SELECT p.domain FROM (SELECT domain, min(seq) AS pos FROM learnable GROUP BY domain) p
  WHERE p.pos < k.seq AND (p.domain = k.host OR ends_with(k.host, '.' || p.domain) OR ends_with(p.domain, '.' || k.host)) ORDER BY p.domain <> k.host, p.pos LIMIT 1) AS pattern_key FROM keyed k"""
_add(
    "pattern_lookup_as_of",
    lambda s, d: PT.patterns_known(_as_of_urls(s, d).withColumnRenamed("url", "arg_url"), PT.pattern_versions(T.search_urls(s, d))[2]).select("seq", "host", "pattern_key"),
    T.with_tables(["tool_events", "search_urls"], "SELECT seq, host, pattern_key FROM matched",
                  {"asked": _AS_OF_URLS_SQL, "learnable": LEARNABLE_SQL, "keyed": f"SELECT seq, {_HOST.format(c='url')} AS host FROM asked", "matched": _MATCH_AS_OF_SQL}),
)
_add(
    "root_open_rejections_as_of",
    lambda s, d: PT.reject_root_opens_as_of(T.attempts(s, d), PT.pattern_versions(T.search_urls(s, d))).select("seq", "host", "error", "advice"),
    T.with_tables(["attempts", "search_urls"], r"""
SELECT k.seq, k.host, 'Memory-first: host ' || k.host || ' has learned search URL patterns. Do not open the bare homepage first.' AS error,
  'Build a deep-link/search URL using learned path + params, with values from the current task constraints. paths=[' || array_to_string(p.items[1:3], ', ') ||
  '] params=[' || coalesce(array_to_string(n.items[1:10], ', '), '') || ']. Only use the homepage if that deep-link fails (404/empty).' AS advice
FROM matched k JOIN paths_then p USING (seq) LEFT JOIN params_then n USING (seq)""", {
        "learnable": LEARNABLE_SQL,
        "keyed": rf"SELECT seq, {_HOST.format(c='arg_url')} AS host FROM attempts WHERE tool = 'browser_open' AND regexp_matches(arg_url, '^https?://[^/?#]+/?$')",
        "matched": _MATCH_AS_OF_SQL,
        "paths_then": f"SELECT opened AS seq, {_SLOTS.format(c='path', n=8)} AS items FROM (SELECT k.seq AS opened, l.seq, l.path FROM matched k JOIN learnable l ON l.domain = k.pattern_key AND l.seq < k.seq) GROUP BY opened",
        "firsts": "SELECT domain, n, min(seq) AS seq, arg_min(i, seq) AS i FROM (SELECT domain, seq, unnest(ns) AS n, unnest(range(len(ns))) AS i FROM learnable) GROUP BY domain, n",
        "params_then": "SELECT k.seq, list(f.n ORDER BY f.seq, f.i) AS items FROM matched k JOIN firsts f ON f.domain = k.pattern_key AND f.seq < k.seq GROUP BY k.seq"}),
)
_SEEDS_SQL = " UNION ALL ".join(
    "SELECT {} AS pos, {} AS trigger, {} AS tactic, {} AS efficiency_gain".format(i, *["'" + v.replace("'", "''") + "'" for v in row])
    for i, row in enumerate(K.SEED_STRATEGIES)
)
STRATEGIES_SQL = """
SELECT 0 AS seeded, pos, trigger, tactic, efficiency_gain FROM stored_strategies
UNION ALL SELECT 1, pos, trigger, tactic, efficiency_gain FROM seeds WHERE trigger NOT IN (SELECT trigger FROM stored_strategies)"""


def strategies(s, d):
    return ST.merge_seeds(T.stored_strategies(s, d), ST.seed_strategies(s))


_add("strategy_merge", strategies, T.with_tables(["stored_strategies"], STRATEGIES_SQL, {"seeds": _SEEDS_SQL}))
_add(
    "recent_tactics",
    lambda s, d: tactics(s, d).orderBy(F.desc("last_verified"), F.asc("pos")).limit(K.MAX_TACTICS).select("domain", "last_verified"),
    T.with_tables(["tool_events"], "SELECT domain, last_verified FROM tactics ORDER BY last_verified DESC, pos LIMIT 40", {"tactics": TACTICS_SQL}),
)
_add(
    "memory_digest",
    lambda s, d: DG.memory_digest(tactics(s, d), patterns(s, d), strategies(s, d), F.lit(AS_OF).cast("timestamp_ntz")),
    T.with_tables(["tool_events", "search_urls", "stored_strategies"], f"""
SELECT '### Learned site tactics (prefer these tools)' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY last_verified DESC, pos) FROM (
    SELECT last_verified, pos, '- ' || domain || ': prefer `' || preferred_tool || '` (' || reason || ')' ||
      CASE WHEN last_verified < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY THEN ' [stale—consider retesting cheaper method]' ELSE '' END AS line
    FROM tactics ORDER BY last_verified DESC, pos LIMIT 40)) || chr(10) || chr(10) ||
  '### Learned search URL patterns (reuse; rebuild with task constraints)' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY last_verified DESC, pos) FROM (
    SELECT last_verified, pos, '- ' || domain || ': paths=[' || array_to_string(path_hints[1:3], ', ') || '] params=[' || coalesce(array_to_string(param_names[1:12], ', '), '') ||
      '] (hits=' || success_count || ')' || chr(10) || '  e.g. ' || example_urls[1] AS line
    FROM patterns ORDER BY last_verified DESC, pos LIMIT 20)) || chr(10) || chr(10) ||
  '### General strategies' || chr(10) || (SELECT string_agg('- When: ' || trigger || ' → ' || tactic, chr(10) ORDER BY seeded, pos) FROM (
    SELECT * FROM strategies ORDER BY seeded, pos LIMIT 15)) AS digest""",
                  {"tactics": TACTICS_SQL, **PATTERN_CTES, "seeds": _SEEDS_SQL, "strategies": STRATEGIES_SQL}),
)
