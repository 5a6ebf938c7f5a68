"""Prompt tables for batch inference: sub-task prompts, synthesis prompts and response repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftline import constants as K
from siftline.functions.messages import is_done, message_text
from siftline.functions.text import utrim


def subtask_prompts(plan: DataFrame, shortlists: DataFrame, handoffs: DataFrame) -> DataFrame:
    """Prompt per (run, sub-task). ``plan``: ``run_id, task, pos, subtask, session`` with the session handed over from."""
    steps = plan.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    rows = (
        plan.join(steps, "run_id")
        .join(shortlists.select("run_id", F.col("digest").alias("shortlist")), "run_id", "left")
        .join(handoffs.select("run_id", "session", F.col("digest").alias("handoff")), ["run_id", "session"], "left")
    )
    listed = utrim(F.coalesce("shortlist", F.lit("")))
    handed = utrim(F.coalesce("handoff", F.lit("")))
    index = (F.col("pos") + 1).cast("string")
    shortlist_block = (
        F.when((listed != "") & (listed != K.SHORTLIST_EMPTY), F.concat(F.lit(K.PROMPT_SHORTLIST_HEAD), listed, F.lit(K.PROMPT_SHORTLIST_TAIL)))
        .when(F.col("pos") > 0, K.PROMPT_SHORTLIST_NONE)
        .otherwise("")
    )
    handoff_block = F.when(handed != "", F.concat(F.lit(K.PROMPT_HANDOFF_HEAD), handed, F.lit("\n"))).otherwise("")
    prompt = F.concat(
        F.lit("## Full research task (context only)\n"), "task",
        F.lit("\n\n## Your focus for this session ("), index, F.lit("/"), F.col("n").cast("string"), F.lit(")\n"), "subtask", F.lit("\n"),
        shortlist_block, handoff_block, F.lit(K.PROMPT_SUBTASK_TAIL),
    )
    return rows.select("run_id", "pos", prompt.alias("prompt"))


def synthesis_prompts(tasks: DataFrame, shortlists: DataFrame, notes: DataFrame) -> DataFrame:
    """Prompt per run for the final report: the shortlist first, notes as support, ranking rule by shortlist."""
    rows = tasks.join(shortlists.select("run_id", F.col("digest").alias("shortlist")), "run_id", "left").join(
        notes.select("run_id", F.col("digest").alias("notes")), "run_id", "left"
    )
    rule = F.when(F.col("shortlist").isNull(), K.RULE_NO_SHORTLIST).otherwise(K.RULE_SHORTLIST)
    prompt = F.concat(
        F.lit("Research question:\n"), "task",
        F.lit("\n\n## SHORTLIST (primary source for Ranking)\n"), F.coalesce("shortlist", F.lit(K.SHORTLIST_EMPTY)),
        F.lit("\n\n## Supporting notes (evidence / limitations only)\n"), F.coalesce("notes", F.lit(K.NO_NOTES)),
        F.lit("\n\n" + K.PROMPT_SYNTHESIS_HEAD), rule, F.lit(K.PROMPT_SYNTHESIS_TAIL),
    )
    return rows.select("run_id", prompt.alias("prompt"))


def repaired_report(content: Column, thinking: Column) -> Column:
    """Usable report text of a synthesis answer, the completion mark put in front when missing; NULL when too short."""
    text = message_text(content, thinking)
    return F.when(
        F.length(text) > 100, F.when(is_done(text), text).otherwise(F.concat(F.lit(K.DONE_MARK + "\n\n"), text))
    )
