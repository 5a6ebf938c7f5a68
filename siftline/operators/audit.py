"""Audit of runs: limits, host budgets, no-ops, streaks, the live tab and shortlist hints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siftline import constants as K
from siftline.functions import urls as U
from siftline.operators.ordered import BLOCK_ROWS, running, salted_join, streaks
from siftline.operators.runs import model_call

HOST_KEYS = ["run_id", "session_id", "host"]
SESSION_KEYS = ["run_id", "session_id"]


def limit_breaches(
    log: DataFrame,
    session_budget: int | None = None,
    max_runtime: int = K.MAX_RUNTIME_SECONDS,
    max_llm: int = K.MAX_LLM_CALLS,
    max_tools: int = K.MAX_TOOL_CALLS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """First model step per run at which a limit was already reached, with the limit that fires first.

    Planner calls count for the run's limit; the session budget counts the session's steps only.
    """
    is_llm = model_call().cast("long")
    is_tool = (F.col("type") == "tool_result").cast("long")
    starts = log.groupBy("run_id").agg(F.min("ts").alias("started_at"))
    narrow = log.select("run_id", "session", "seq", "ts", "type")
    counted = running(narrow, ["run_id"], "seq", block_rows, sums={"llm_used": is_llm, "tools_used": is_tool})
    if session_budget is not None:
        counted = running(counted, ["run_id", "session"], "seq", block_rows, sums={"session_used": (F.col("type") == "llm_request").cast("long")})
    else:
        counted = counted.withColumn("session_used", F.lit(0).cast("long"))
    steps = salted_join(counted.filter(F.col("type") == "llm_request"), starts, ["run_id"], "seq")
    elapsed = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    reason = (
        F.when(elapsed > max_runtime * 1_000_000, "timeout_runtime")
        .when(F.col("llm_used") - 1 >= max_llm, "timeout_llm")
        .when(F.lit(session_budget is not None) & (F.col("session_used") - 1 >= (session_budget or 0)), "session_budget")
        .when(F.col("tools_used") >= max_tools, "timeout_tools")
    )
    found = steps.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    picked = found.groupBy("run_id").agg(
        F.min_by(F.struct("seq", "reason", (F.col("llm_used") - 1).alias("llm_before"), F.col("tools_used").alias("tools_before")), "seq").alias("_b")
    )
    return picked.select("run_id", "_b.*")


def refused_searches(log: DataFrame, max_search: int = K.MAX_SEARCH_CALLS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Search calls beyond the limit, with their number in the run."""
    calls = log.filter((F.col("type") == "tool_result") & (F.col("tool") == "web_search")).select("run_id", "seq")
    return running(calls, ["run_id"], "seq", block_rows, sums={"search_no": F.lit(1).cast("long")}).filter(F.col("search_no") > max_search)


def browser_actions(events: DataFrame) -> DataFrame:
    """Browser events with the host they acted on; rows without a host take no part."""
    return (
        events.filter(F.col("tool").startswith("browser_"))
        .select("seq", *SESSION_KEYS, "tool", "url", "arg_url", "ok", "blocked", "error", "price_hints")
        .withColumn("host", U.host_key(F.coalesce("url", "arg_url")))
        .filter(F.col("host") != "")
    )


def host_action_counts(actions: DataFrame, limit: int = K.MAX_ACTIONS_PER_HOST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Running number of actions per host and session, flagged once the budget is used up."""
    counted = running(actions.select("seq", *HOST_KEYS), HOST_KEYS, "seq", block_rows, sums={"action_no": F.lit(1).cast("long")})
    return counted.withColumn("over_budget", F.col("action_no") >= limit)


def subset_of(a: str, b: str):
    """Whether every hint of ``a`` is in ``b``."""
    return F.size(F.array_except(a, b)) == 0


def noop_actions(actions: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Actions that changed nothing: same URL and no new price hint since the last one on the host, or an error."""
    flat = actions.select("seq", *HOST_KEYS, "url", "error", F.slice("price_hints", 1, 20).alias("hints"))
    prior = running(flat, HOST_KEYS, "seq", block_rows, lags={"prev": F.struct("url", "hints")})
    same = (F.col("url") != "") & (F.col("url") == F.col("prev.url")) & subset_of("hints", "prev.hints")
    erred = F.coalesce("error", F.lit("")) != ""
    noop = F.col("prev").isNotNull() & (F.coalesce(same, F.lit(False)) | erred)
    return prior.withColumn("noop", noop).drop("prev", "hints")


def noop_streaks(noops: DataFrame, limit: int = K.MAX_NOOPS_PER_HOST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """No-op streak per host and session, flagged where the host is given up."""
    return streaks(noops, HOST_KEYS, "seq", "noop", "streak", block_rows).withColumn("abandoned", F.col("streak") >= limit)


def failure_streaks(events: DataFrame, every: int = K.FAILURE_STREAK, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Failure streak over a session's browser events; fires at every third failure in a row."""
    failed = (F.coalesce("error", F.lit("")) != "") | F.coalesce("blocked", F.lit(False)) | ~F.coalesce("ok", F.lit(False))
    flat = events.filter(F.col("tool").startswith("browser_")).select("seq", *SESSION_KEYS, failed.alias("failed"))
    return streaks(flat, SESSION_KEYS, "seq", "failed", "streak", block_rows).withColumn(
        "fires", F.col("failed") & (F.col("streak") % every == 0)
    )


def live_tab(events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """URL in force for every event: its own argument, else the last page the session's browser showed."""
    browser = F.col("tool").startswith("browser_")
    shown = F.when(browser & F.col("url").startswith("http"), F.col("url")).when(
        (F.col("tool") == "browser_open") & (F.coalesce("error", F.lit("")) == ""), F.col("arg_url")
    )
    flat = events.select("seq", *SESSION_KEYS, "tool", "arg_url", shown.alias("shown"))
    before = running(flat, SESSION_KEYS, "seq", block_rows, lasts_before={"tab_before": F.col("shown")})
    return before.select(
        "seq", *SESSION_KEYS, "tool", F.coalesce("arg_url", "tab_before").alias("url_in_force"),
        F.coalesce("shown", "tab_before").alias("tab_after"),
    )


def shortlisted_host_events(events: DataFrame, urls: DataFrame) -> DataFrame:
    """Events on hosts that occur among their run's shortlisted URLs."""
    hosts = urls.select("run_id", U.host_key(F.col("url")).alias("host")).filter(F.col("host") != "").distinct()
    keyed = events.withColumn("host", U.host_key(F.col("url")))
    return keyed.join(hosts, ["run_id", "host"], "left_semi")


def empty_shortlist_nudges(events: DataFrame, accepted_rows: DataFrame) -> DataFrame:
    """Browser events with price hints before the run's first accepted candidate."""
    firsts = accepted_rows.groupBy("run_id").agg(F.min("seq").alias("first_accepted"))
    seen = events.filter(F.col("tool").startswith("browser_") & (F.size("price_hints") > 0))
    joined = salted_join(seen, firsts, ["run_id"], "seq", "left")
    early = F.col("first_accepted").isNull() | (F.col("seq") < F.col("first_accepted"))
    return joined.filter(early).withColumn("nudge", F.lit(K.NUDGE))
