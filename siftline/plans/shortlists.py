"""Queries over candidate mentions: checks, the merged shortlist, its URLs, notes and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import audit as AU, digests as DG, shortlist as SL
from siftline.sources import tables as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def checked(s, d):
    return SL.check_candidates(T.candidates(s, d))


def merged(s, d):
    return SL.merge_candidates(SL.accepted(checked(s, d)))


# --- shared SQL ------------------------------------------------------------------------------------
CHECKED_SQL = r"""
SELECT *, CASE WHEN trim(name) = '' THEN 'name is required'
    WHEN coalesce(match_status, '') NOT IN ('', 'full', 'partial', 'unknown') THEN 'match_status must be "full", "partial", or "unknown"'
    WHEN coalesce(match_status, '') = '' AND len(m) + len(um) + len(uk) = 0 THEN
      'constraints_check empty: list at least one item under matched, unmatched, or unknown (labels from the task), or set match_status.'
    WHEN trim(source_url) = '' AND trim(coalesce(price, '')) = '' THEN 'Provide at least source_url or price for a shortlist candidate' END AS reject_reason,
  CASE WHEN coalesce(match_status, '') <> '' THEN match_status WHEN len(um) > 0 THEN 'partial'
    WHEN len(m) > 0 AND len(uk) = 0 THEN 'full' ELSE 'unknown' END AS status,
  regexp_replace(list_reduce(['hotel','resort','spa','apartments','apartment','boutique','the','adults only','adults-only','holiday','club','suites','suite'],
    lambda acc, t: replace(acc, t, ' '), lower(trim(name))), '[^a-z0-9]+', '', 'g') AS name_key
FROM (SELECT *, list_filter(list_transform(matched, lambda x: trim(x)), lambda x: x <> '') AS m,
   list_filter(list_transform(unmatched, lambda x: trim(x)), lambda x: x <> '') AS um,
   list_filter(list_transform(unknown, lambda x: trim(x)), lambda x: x <> '') AS uk FROM candidates)"""
ROWS_SQL = r"""
SELECT *, TRY_CAST(replace(nullif(regexp_extract(replace(price, ' ', ''), '[0-9]+[.,]?[0-9]*'), ''), ',', '.') AS DOUBLE) AS num,
  row_number() OVER (PARTITION BY run_id, name_key ORDER BY seq) AS nth
FROM checked WHERE reject_reason IS NULL"""
URLS_SQL = r"""
SELECT run_id, name_key, url, first_seen, row_number() OVER (PARTITION BY run_id, name_key ORDER BY detail DESC, path_chars DESC, first_seen) AS pos
FROM (SELECT run_id, name_key, source_url AS url, min(seq) AS first_seen, length(split_part(lower(source_url), '?', 1)) AS path_chars,
   CASE WHEN regexp_matches(lower(source_url), '/zoeken|/search|/results|/vakanties\?|sort=|offset=|limit=') THEN 0 ELSE 1 END AS detail
 FROM rows WHERE source_url <> '' GROUP BY run_id, name_key, source_url)"""
# The fold over arrival order, written with windows: the last unparseable price resets the minimum.
MERGED_SQL = r"""
SELECT r.run_id, r.name_key,
  (SELECT n.name FROM rows n WHERE n.run_id = r.run_id AND n.name_key = r.name_key ORDER BY length(n.name) DESC, n.seq DESC LIMIT 1) AS name,
  coalesce(u.url, '') AS source_url,
  coalesce(low.price, rs.price, r.price, '') AS price,
  CASE WHEN det.seq = r.seq OR length(det.details) < length(left(r.details, 1200)) THEN left(r.details, 1200) ELSE det.details END AS details,
  l.status AS match_status, array_to_string(l.m, '|') AS matched, array_to_string(l.um, '|') AS unmatched, array_to_string(l.uk, '|') AS unknown,
  l.session AS session, r.seq AS first_seq, l.seq AS last_seq, l.ts AS updated_at, l.nth AS mentions
FROM rows r
JOIN (SELECT *, row_number() OVER (PARTITION BY run_id, name_key ORDER BY seq DESC) AS b FROM rows) l ON l.run_id = r.run_id AND l.name_key = r.name_key AND l.b = 1
JOIN (SELECT run_id, name_key, seq, left(trim(details), 1200) AS details,
        row_number() OVER (PARTITION BY run_id, name_key ORDER BY least(length(trim(details)), 1200) DESC, seq DESC) AS b FROM rows) det
  ON det.run_id = r.run_id AND det.name_key = r.name_key AND det.b = 1
LEFT JOIN resets rs ON rs.run_id = r.run_id AND rs.name_key = r.name_key
LEFT JOIN (SELECT x.run_id, x.name_key, x.price, row_number() OVER (PARTITION BY x.run_id, x.name_key ORDER BY x.num, x.seq) AS b
           FROM rows x LEFT JOIN resets y ON x.run_id = y.run_id AND x.name_key = y.name_key
           WHERE x.num IS NOT NULL AND x.seq > coalesce(y.seq, -1)) low ON low.run_id = r.run_id AND low.name_key = r.name_key AND low.b = 1
LEFT JOIN urls u ON u.run_id = r.run_id AND u.name_key = r.name_key AND u.pos = 1
WHERE r.nth = 1"""
RESETS_SQL = r"""
SELECT run_id, name_key, seq, price FROM (SELECT *, row_number() OVER (PARTITION BY run_id, name_key ORDER BY seq DESC) AS b
  FROM rows WHERE num IS NULL AND trim(coalesce(price, '')) <> '') WHERE b = 1"""
CTES = {"checked": CHECKED_SQL, "rows": ROWS_SQL, "urls": URLS_SQL, "resets": RESETS_SQL, "merged": MERGED_SQL}
DIGEST_SQL = r"""
SELECT run_id, candidates, 'Shortlist (' || candidates || ' unique candidates):' || chr(10) || body AS digest FROM (
  SELECT run_id, max(candidates) AS candidates,
    string_agg(CASE WHEN total <= {n} THEN line WHEN before <= {n} THEN '...[shortlist truncated]' END, chr(10) ORDER BY pos) AS body
  FROM (SELECT *, total - length(line) AS before FROM (
    SELECT *, sum(length(line)) OVER (PARTITION BY run_id ORDER BY pos) AS total FROM (
      SELECT run_id, pos, candidates, pos || '. ' || name || ' | match=' || match_status || ' | price=' || CASE WHEN price = '' THEN '—' ELSE price END ||
        ' | urls=' || coalesce(us, '—') || ' | ' || left(details, 200) AS line
      FROM (SELECT m.*, row_number() OVER (PARTITION BY m.run_id ORDER BY first_seq) AS pos, count(*) OVER (PARTITION BY m.run_id) AS candidates,
              (SELECT string_agg(u.url, '; ' ORDER BY u.pos) FROM urls u WHERE u.run_id = m.run_id AND u.name_key = m.name_key AND u.pos <= 4) AS us
            FROM merged m)))) GROUP BY run_id)"""


def sql(body: str, tables: list[str] | None = None, extra: dict[str, str] | None = None) -> str:
    return T.with_tables(["candidates", *(tables or [])], body, {**CTES, **(extra or {})})


# --- queries ----------------------------------------------------------------------------------------
_add(
    "constraint_checks",
    lambda s, d: checked(s, d).select(
        "seq", "check.ok", "check.error", "check.match_status", F.array_join("check.matched", "|").alias("matched"), F.array_join("check.unmatched", "|").alias("unmatched")
    ),
    sql("""
SELECT seq, err IS NULL AS ok, err AS error, CASE WHEN err IS NULL THEN status END AS match_status, array_to_string(m, '|') AS matched, array_to_string(um, '|') AS unmatched
FROM (SELECT *, CASE WHEN starts_with(coalesce(reject_reason, ''), 'Provide') THEN NULL ELSE reject_reason END AS err FROM checked)"""),
)
_add("candidate_rejects", lambda s, d: checked(s, d).select("seq", "run_id", "name_key", "reject_reason"),
     sql("SELECT seq, run_id, name_key, reject_reason FROM checked"))
_add(
    "shortlist",
    lambda s, d: merged(s, d).withColumns({c: F.array_join(c, "|") for c in ("matched", "unmatched", "unknown")}).drop("notes"),
    sql("SELECT * FROM merged"),
)
_add(
    "shortlist_urls",
    lambda s, d: SL.candidate_urls(SL.accepted(checked(s, d))).select("run_id", "name_key", "url", "first_seen"),
    sql("SELECT run_id, name_key, url, first_seen FROM urls"),
)


def _items(s, d):
    rows = SL.accepted(checked(s, d))
    return SL.shortlist_items(SL.merge_candidates(rows), SL.candidate_urls(rows)).select(
        "run_id", "name_key", "source_url", F.array_join("source_urls", "|").alias("source_urls")
    )


_add(
    "shortlist_items",
    _items,
    sql("""SELECT m.run_id, m.name_key, m.source_url, coalesce((SELECT string_agg(u.url, '|' ORDER BY u.pos) FROM urls u
  WHERE u.run_id = m.run_id AND u.name_key = m.name_key), '') AS source_urls FROM merged m"""),
)
_ACTION = """CASE WHEN reject_reason IS NOT NULL THEN NULL
  WHEN row_number() OVER (PARTITION BY run_id, name_key, reject_reason IS NULL ORDER BY seq) = 1 THEN 'added' ELSE 'updated' END"""
_add(
    "upsert_actions",
    lambda s, d: SL.upsert_actions(checked(s, d)).select("seq", "run_id", "action"),
    sql(f"SELECT seq, run_id, {_ACTION} AS action FROM checked"),
)
_add(
    "shortlist_notes",
    lambda s, d: SL.shortlist_notes(SL.upsert_actions(checked(s, d))),
    sql(f"""SELECT seq, run_id, session, 'shortlist' AS source_type, name AS title, source_url AS url, action IS NOT NULL AS ok,
  coalesce(action, 'None') || ': price=' || coalesce(price, 'None') || ' url=' || source_url || ' ' || left(details, 200) AS summary
FROM (SELECT *, {_ACTION} AS action FROM checked)"""),
)


def shortlist_digest(s, d, max_chars: int = 6000):
    rows = SL.accepted(checked(s, d))
    return DG.shortlist_digest(SL.merge_candidates(rows), SL.candidate_urls(rows), max_chars)


_add("shortlist_digest", shortlist_digest, sql(DIGEST_SQL.format(n=6000)))
_add(
    "shortlisted_host_events",
    lambda s, d: AU.shortlisted_host_events(T.tool_events(s, d), SL.candidate_urls(SL.accepted(checked(s, d)))).select("seq", "run_id", "host"),
    sql(r"""SELECT seq, run_id, host FROM (SELECT seq, run_id, regexp_replace(lower(regexp_extract(url, '^[^/]*//([^/?#]*)', 1)), '^www\.', '') AS host FROM tool_events)
WHERE (run_id, host) IN (SELECT (run_id, regexp_replace(lower(regexp_extract(url, '^[^/]*//([^/?#]*)', 1)), '^www\.', '')) FROM urls)""", ["tool_events"]),
)
_add(
    "empty_shortlist_nudges",
    lambda s, d: AU.empty_shortlist_nudges(T.tool_events(s, d), SL.accepted(checked(s, d))).select("seq", "run_id", "tool", "nudge"),
    sql("""SELECT e.seq, e.run_id, e.tool, 'You are seeing price-like signals on this page and the structured shortlist is still empty. Call add_to_shortlist for concrete candidates (name + price and/or detail URL) before further navigation.' AS nudge
FROM tool_events e WHERE starts_with(e.tool, 'browser_') AND len(e.price_hints) > 0
  AND NOT EXISTS (SELECT 1 FROM rows r WHERE r.run_id = e.run_id AND r.seq <= e.seq)""", ["tool_events"]),
)
