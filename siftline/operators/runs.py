"""Run bookkeeping: counters, status derivation, budgets and state documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftline import constants as K

LIMIT_STATUSES = ["timeout_runtime", "timeout_llm", "timeout_tools"]


def model_call() -> Column:
    """Whether a row of the run log is a call of the model: a step, or the planner."""
    return F.col("type").isin("llm_request", "planner_request")


def run_counters(log: DataFrame) -> DataFrame:
    """Counts and times per run from the run log (``run_id, seq, ts, type, tool``).

    A planner call counts once, by its request: an answer that does not parse leaves a response and an error.
    """
    planner = F.col("type").startswith("planner_")
    return log.groupBy("run_id").agg(
        F.count_if(model_call()).alias("llm_calls"),
        F.count_if(F.col("type") == "tool_result").alias("tool_calls"),
        F.count_if((F.col("type") == "tool_result") & (F.col("tool") == "web_search")).alias("search_calls"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("finished_at"),
        F.when(F.bool_or(planner), "planned").otherwise("single").alias("mode"),
        F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("status"),
    )


def run_summary(log: DataFrame, notes: DataFrame, sources: DataFrame, shortlist: DataFrame) -> DataFrame:
    """Run metadata: the log's counters with the number of notes, sources and shortlisted candidates."""
    count = lambda df, name: df.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))
    elapsed = F.round((F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6, 1)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        run_counters(log)
        .join(count(notes, "notes_count"), "run_id", "left")
        .join(count(sources, "sources_count"), "run_id", "left")
        .join(count(shortlist, "shortlist_count"), "run_id", "left")
        .select(
            "run_id", "status", "mode", "started_at", "finished_at", elapsed.alias("elapsed_seconds"),
            "llm_calls", "tool_calls", "search_calls", zero("notes_count"), zero("sources_count"), zero("shortlist_count"),
        )
    )


def run_status(runs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Final status and stop reason of every run.

    ``runs``: ``run_id, mode, synthesis_ok``. ``sessions``: ``run_id, session_no, status``. A limit or a
    cancel ends a run, a model error lets a planned run go on; a cancelled run skips the synthesis.
    """
    status, no = F.col("status"), F.col("session_no")
    stops = status.isin(*LIMIT_STATUSES, "cancelled")
    folded = sessions.groupBy("run_id").agg(
        F.min_by("status", "session_no").alias("first"),
        F.min_by("status", F.when(stops, no)).alias("stopped"),
        F.min(F.when(stops, no)).alias("stopped_at"),
        F.min(F.when(status == "llm_error", no)).alias("error_at"),
    )
    d = runs.join(folded, "run_id")
    erred = F.col("error_at").isNotNull() & (F.col("stopped_at").isNull() | (F.col("error_at") < F.col("stopped_at")))
    planned_reason = F.when(F.col("stopped").isin(LIMIT_STATUSES), "limit").when(erred, "llm_error")
    planned = (
        F.when(F.col("stopped") == "cancelled", "cancelled")
        .when(F.col("synthesis_ok"), F.coalesce(F.concat(planned_reason, F.lit("+forced_report")), F.lit("completed")))
        .otherwise(F.coalesce("stopped", F.lit("error")))
    )
    single_reason = (
        F.when(F.col("first").isin(LIMIT_STATUSES), "limit")
        .when(F.col("first").isin("llm_error", "cancelled", "error", "session_budget"), F.col("first"))
    )
    forced = F.col("synthesis_ok") & single_reason.isin("limit", "llm_error")
    single = F.when(forced, F.concat("first", F.lit("+forced_report"))).otherwise(F.col("first"))
    is_planned = F.col("mode") == "planned"
    final = F.when(is_planned, planned).otherwise(single)
    reason = (
        F.when(~is_planned, single_reason)
        .when(F.col("stopped") == "cancelled", "cancelled")
        .otherwise(F.coalesce(planned_reason, F.when(~F.col("synthesis_ok"), "critic_failed")))
    )
    return d.select("run_id", "mode", final.alias("status"), reason.alias("stop_reason"))


def succeeded(status: Column) -> Column:
    return (status == "completed") | status.endswith("+forced_report")


def subtask_budget(used_llm: Column, n_subtasks: Column, max_llm: int = K.MAX_LLM_CALLS) -> Column:
    """Model calls each planned sub-task may use, with headroom for the synthesis."""
    n = F.greatest(n_subtasks, F.lit(1))
    remaining = F.greatest(F.lit(max_llm) - used_llm - 4, n * 8)
    return F.greatest(F.lit(8), F.floor(remaining / n).cast("long"))


def state_document(summary: DataFrame) -> DataFrame:
    """Readable state text per run."""
    line = lambda label, c: F.concat(F.lit(f"- {label}: "), F.col(c).cast("string"))
    text = F.concat_ws(
        "\n",
        F.lit("# Research state\n"),
        F.concat(F.lit("- Updated: "), F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss")),
        F.concat(F.lit("- Status: "), F.coalesce("status", F.lit("running"))),
        line("LLM calls", "llm_calls"), line("Tool calls", "tool_calls"), line("Sources", "sources_count"), line("Notes", "notes_count"),
        F.lit("\n## Progress"),
        F.coalesce(F.nullif("progress", F.lit("")), F.lit("(none)")),
        F.lit("\n## Key findings (compact)"),
        F.coalesce(F.nullif("key_findings", F.lit("")), F.lit("(none yet)")),
        F.lit(""),
    )
    return summary.select("run_id", text.alias("document"))
