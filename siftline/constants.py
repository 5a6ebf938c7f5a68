"""Limits, word lists, patterns and texts that results depend on."""

# --- Fixed values: limits -------------------------------------------------------------------------
MAX_RUNTIME_SECONDS = 120 * 60
MAX_LLM_CALLS = 80
MAX_TOOL_CALLS = 150
MAX_SEARCH_CALLS = 60
MAX_ACTIONS_PER_HOST = 8
MAX_NOOPS_PER_HOST = 2
FAILURE_STREAK = 3
RETEST_AFTER_DAYS = 30
MAX_TACTICS = 40
MAX_PATTERNS = 20
MAX_STRATEGIES = 15
QUERY_MAX_WORDS = 12
QUERY_MAX_CHARS = 120
PAGE_MAX_CHARS = 12000
SHORT_PAGE_CHARS = 400
CONTEXT_CHARS = 2500
BROWSER_CONTEXT_CHARS = 4000
KEPT_PARAMS = 40
KEPT_PATHS = 8
KEPT_EXAMPLES = 5
TEMPLATE_PARAMS = 15

# --- Fixed values: tool names ---------------------------------------------------------------------
PAGE_TOOLS = [
    "web_fetch",
    "browser_open",
    "browser_extract_text",
    "browser_click",
    "browser_type",
    "browser_scroll",
    "browser_wait",
    "browser_dismiss_cookies",
]
SCORED_BROWSER_TYPES = ["browser_open", "browser_click", "browser_type", "browser_extract_text", "browser"]

# --- Fixed values: URL word lists -----------------------------------------------------------------
LOCALE_PATHS = ["/nl", "/en", "/fr", "/de", "/be", "/nl-be", "/fr-be"]
SEARCH_PATH_HINTS = ["/zoeken", "/search", "/results", "/vakantie/", "/all-inclusive", "/serp", "/find"]
LIST_URL_HINTS = ["/zoeken", "/search", "/results", "/vakanties?", "sort=", "offset=", "limit="]
PARAM_HINTS = [
    "participant", "adult", "pax", "person", "traveler", "traveller", "guest", "date", "depart", "arrival",
    "checkin", "checkout", "meal", "board", "duration", "night", "airport", "from", "origin", "transport", "room",
]

# --- Fixed values: text patterns ------------------------------------------------------------------
PRICE_LINE_PATTERNS = [
    r"(€|eur|euro)\s?\d",
    r"\d[\d\s.,]{2,}\s?(€|eur)",
    r"(vanaf|from|dès|ab|per persoon|p\.?p\.?|pp\b).{0,20}\d",
    r"(total|totaal|prix|price).{0,30}\d",
]
NAME_TOKENS = [
    "hotel", "resort", "spa", "apartments", "apartment", "boutique", "the", "adults only", "adults-only",
    "holiday", "club", "suites", "suite",
]
PRICE_WORDS = ["price", "€", "eur", "prijs"]
DROPPED_TAGS = ["script", "style", "noscript", "nav", "footer", "header"]
DONE_MARK = "RESEARCH_COMPLETE"

# --- Fixed values: messages of the candidate checks -----------------------------------------------
ERR_NAME = "name is required"
ERR_CONSTRAINTS_MISSING = (
    'constraints_check is required: {"matched": [...], "unmatched": [...], "unknown": [...]} '
    "using hard requirements from the task (free-text labels), "
    'or include match_status: "full"|"partial"|"unknown".'
)
ERR_MATCH_STATUS = 'match_status must be "full", "partial", or "unknown"'
ERR_CONSTRAINTS_EMPTY = (
    "constraints_check empty: list at least one item under matched, unmatched, or unknown "
    "(labels from the task), or set match_status."
)
ERR_NO_EVIDENCE = "Provide at least source_url or price for a shortlist candidate"

# --- Fixed values: tactic reasons and digest texts ------------------------------------------------
REASON_BLOCKED = "HTTP fetch blocked or 403"
REASON_BROWSER = "browser succeeded"
NO_NOTES = "(no notes yet)"
NOTES_CUT = "...[more notes truncated]"
SHORTLIST_EMPTY = "(shortlist empty)"
SHORTLIST_CUT = "...[shortlist truncated]"
STALE_MARK = " [stale—consider retesting cheaper method]"
TACTICS_HEAD = "### Learned site tactics (prefer these tools)"
PATTERNS_HEAD = "### Learned search URL patterns (reuse; rebuild with task constraints)"
STRATEGIES_HEAD = "### General strategies"
MEMORY_EMPTY = (
    "### Learned tactics\n"
    "(none yet — discover by trying web_fetch first; on 403/blocked use browser_open; "
    "successful escalations are saved automatically.)"
)
SHORT_PAGE_ADVICE = "Page text very short – consider browser_open"
NUDGE = (
    "You are seeing price-like signals on this page and the structured shortlist is still empty. "
    "Call add_to_shortlist for concrete candidates (name + price and/or detail URL) before "
    "further navigation."
)

# --- Fixed values: seed strategies (trigger, tactic, efficiency gain) -----------------------------
SEED_STRATEGIES = [
    (
        "HTTP 403, blocked, or empty body from web_fetch",
        "Retry same URL with browser_open",
        "Avoids repeated failed fetches",
    ),
    (
        "JS-heavy page or cookie wall, little useful text from fetch",
        "Use browser_open; dismiss cookies then browser_extract_text",
        "Gets visible content when static fetch fails",
    ),
    (
        "Enough candidates with sources already collected",
        "Stop extra searches; write RESEARCH_COMPLETE report",
        "Prevents context bloat and LLM timeouts",
    ),
    (
        "Learned URL patterns exist for a host",
        "First browser_open on that host must be a search/deep-link URL (path+params from memory, values from "
        "task); never site root first",
        "Skips homepage form thrash and cookie walls",
    ),
    (
        "Two form click/type no-ops on same host",
        "Stop UI clicks; one browser_open with a different search URL (query params), not another homepage; "
        "then abandon if that fails",
        "URL-param recovery before permanent block",
    ),
    (
        "Deep-link/search URL returns 404 or empty after patterns were used",
        "Brief homepage relearn (few actions only); update url_patterns; do not enter long form loops",
        "Recovers from stale patterns without wasting the session",
    ),
    (
        "Adding a candidate to the shortlist",
        "Always include constraints_check (matched/unmatched/unknown from task hard requirements) so partial "
        "matches are explicit",
        "Prevents silent junk shortlist entries",
    ),
]

# --- Fixed values: prompt texts -------------------------------------------------------------------
PROMPT_SHORTLIST_HEAD = "\n## Structured shortlist so far (authoritative candidates)\n"
PROMPT_SHORTLIST_TAIL = (
    "\n\nYour job in this phase is to **verify / deepen these items only** "
    "(reviews, facilities, price checks on secondary sources if the task allows). "
    "Do **not** start a broad new market scan or add unrelated new destinations.\n"
    "After each useful verification, call `add_to_shortlist` again with the "
    "same name and richer details / better source_url so the final report sees updates.\n"
    "Prefer hotel/package **detail pages** over search-result list URLs.\n"
)
PROMPT_SHORTLIST_NONE = (
    "\n## Structured shortlist so far\n(empty)\n"
    "Previous phase did not structure candidates. "
    "You may continue primary-source discovery if still in scope, "
    "or document limitations and complete.\n"
)
PROMPT_HANDOFF_HEAD = "\n## Findings from previous phase (read-only)\n"
PROMPT_SUBTASK_TAIL = (
    "\nWork only on this focus. "
    "When you see a concrete candidate (name + price and/or URL), call "
    "`add_to_shortlist` immediately — prefer a detail/booking URL over a search list. "
    "If form UI clicks fail twice with no page change, try **one** `browser_open` "
    "with task constraints as URL query parameters (persons, dates, …) instead of "
    "more clicks on the same controls. "
    "When this focus is done (enough verified info or clear dead end), "
    "output RESEARCH_COMPLETE with a short Markdown summary for this "
    "sub-task only (not the global final ranking)."
)
RULE_SHORTLIST = (
    "The SHORTLIST below is authoritative for Ranking. "
    "If it is non-empty, you MUST rank those items; "
    "you MUST NOT claim that no candidates were found.\n"
)
RULE_NO_SHORTLIST = (
    "The SHORTLIST is empty. You may conclude that no concrete candidates were structured. "
    "Use notes/events only to explain limitations (failed sites, timeouts, 404s) — do not invent names.\n"
)
PROMPT_SYNTHESIS_HEAD = "STOP. No tools. Write the final Markdown report now.\nRules:\n- "
PROMPT_SYNTHESIS_TAIL = (
    "- Use ONLY facts from shortlist + notes. Invent nothing.\n"
    "- Every ranked item must come from the shortlist when it is non-empty.\n"
    "- Mark verification status honestly from the evidence you have.\n"
    "First line exact: RESEARCH_COMPLETE\n"
    "Structure: Research question, Executive summary, Ranking, Details, Uncertainties, Sources."
)

# The refusal of a home page whose host has learned patterns, and its advice, around the values between.
ROOT_OPEN_ERROR = ("Memory-first: host ", " has learned search URL patterns. Do not open the bare homepage first.")
ROOT_OPEN_ADVICE = (
    "Build a deep-link/search URL using learned path + params, with values from the current task constraints. paths=[",
    "] params=[",
    "]. Only use the homepage if that deep-link fails (404/empty).",
)
