"""Chat-message columns: text, completion, tool calls, plans and dispositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftline import constants as K
from siftline.functions.text import utrim

MESSAGE_TYPE = (
    "struct<role:string,content:string,thinking:string,"
    "tool_calls:array<struct<function:struct<name:string,arguments:string>>>>"
)


def message_text(content: Column, thinking: Column) -> Column:
    body = utrim(F.coalesce(content, F.lit("")))
    return F.when(body != "", body).otherwise(utrim(F.coalesce(thinking, F.lit(""))))


def is_done(content: Column) -> Column:
    return F.upper(F.coalesce(content, F.lit(""))).contains(K.DONE_MARK)


def disposition(n_tool_calls: Column, content: Column) -> Column:
    """What a loop does with a model message."""
    return (
        F.when(n_tool_calls > 0, "tool_calls")
        .when(is_done(content), "complete")
        .when(F.length(F.coalesce(content, F.lit(""))) > 500, "nudge")
        .otherwise("continue")
    )


def plan_steps(raw: Column, task: Column, limit: int = 3) -> Column:
    """Steps of a plan message (JSON array, fenced or with text around it); the whole task when unreadable."""
    text = utrim(F.coalesce(raw, F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\s*", ""), r"\s*```$", "")
    unfenced = F.when(text.startswith("```"), bare).otherwise(text)
    items = F.from_json(F.regexp_extract(unfenced, r"(?s)\[.*\]", 0), "array<string>")
    steps = F.slice(
        F.filter(F.transform(items, lambda x: utrim(F.coalesce(x, F.lit("None")))), lambda x: x != ""), 1, limit
    )
    return F.when(F.size(steps) > 0, steps).otherwise(F.array(task))


def tool_calls(messages: DataFrame, message: str = "message") -> DataFrame:
    """One row per tool call; arguments that are not a JSON object become an empty map."""
    exploded = messages.select(
        *[c for c in messages.columns if c != message], F.posexplode(F.col(message)["tool_calls"]).alias("call_no", "_c")
    )
    args = F.from_json(F.col("_c.function.arguments"), "map<string,string>")
    return exploded.select(
        *[c for c in exploded.columns if c != "_c"],
        F.coalesce(F.col("_c.function.name"), F.lit("")).alias("tool"),
        F.coalesce(args, F.create_map().cast("map<string,string>")).alias("arguments"),
    )
