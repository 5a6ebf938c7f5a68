"""Character-budgeted texts: note, shortlist and memory digests, handoffs and partial reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftline import constants as K
from siftline.functions.messages import message_text
from siftline.operators.evidence import distinct_sources, note_priority
from siftline.operators.ordered import top_k
from siftline.operators.shortlist import url_order
from siftline.operators.tactics import is_stale

MIN_NOTE_LINE = 7
MIN_SHORTLIST_LINE = 30


def within_budget(lines: DataFrame, keys: list[str], order: list[Column], max_chars: int, min_line: int, spread_on: str) -> DataFrame:
    """Lines per key up to the first one that would exceed the budget, with ``pos`` and a ``fits`` flag.

    A line has at least ``min_line`` characters, so no more than ``max_chars / min_line`` lines can fit; one
    more is kept to see the overflow. That bound makes the cut a top-k, so a hot key shrinks before it meets
    in one place, and the running sum sees a bounded number of rows.
    """
    few = top_k(lines, keys, order, max_chars // min_line + 1, spread_on, rank="pos")
    upto = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.sum(F.length("line")).over(upto)
    # Lengths are not negative: once the sum is over the budget it stays over, so this keeps a prefix.
    return few.withColumn("fits", total <= max_chars)


def join_lines(budgeted: DataFrame, keys: list[str], cut_marker: str, out: str = "digest") -> DataFrame:
    """Kept lines joined in order, with the marker when any line was cut."""
    kept = F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("pos", "line"))))
    text = F.array_join(F.transform(kept, lambda x: x["line"]), "\n")
    cut = F.bool_or(~F.col("fits"))
    some = F.bool_or("fits")
    return budgeted.groupBy(*keys).agg(
        F.when(~cut, text)
        .when(some, F.concat(text, F.lit("\n" + cut_marker)))
        .otherwise(F.lit(cut_marker))
        .alias(out)
    )


def note_line() -> Column:
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.concat(
        F.lit("- ["), F.coalesce("source_type", F.lit("note")), F.lit("] "),
        F.coalesce(some("title"), some("url"), F.lit("")), F.lit(": "),
        F.substring(F.coalesce("summary", F.lit("")), 1, 400),
        F.coalesce(F.concat(F.lit(" ("), some("url"), F.lit(")")), F.lit("")),
        F.coalesce(F.concat(F.lit(" {session:"), some("session"), F.lit("}")), F.lit("")),
    )


def notes_digest(notes: DataFrame, keys: list[str], max_chars: int = 6000, prioritize: bool = False) -> DataFrame:
    """Digest text per key; high-priority notes first when asked, arrival order otherwise."""
    score = note_priority(F.col("source_type"), F.col("summary"), F.col("ok"))
    lines = notes.select(*dict.fromkeys([*keys, "seq"]), note_line().alias("line"), (score if prioritize else F.lit(0)).alias("score"))
    fit = within_budget(lines, keys, [F.desc("score"), F.asc("seq")], max_chars, MIN_NOTE_LINE, "seq")
    return join_lines(fit, keys, K.NOTES_CUT)


def latest_notes(notes: DataFrame, limit: int = 80) -> DataFrame:
    """Last notes of every run."""
    return top_k(notes, ["run_id"], [F.desc("seq")], limit, "seq")


def session_handoff(notes: DataFrame, sessions: DataFrame, max_chars: int = 2500, tail: int = 80, fallback: int = 15) -> DataFrame:
    """Prioritized digest of a session's notes among the run's last ones; the run's last few when it has none.

    ``sessions`` lists the (run_id, session) pairs to hand over from.
    """
    last = top_k(notes, ["run_id"], [F.desc("seq")], tail, "seq", rank="recency")
    own = notes_digest(last.join(sessions, ["run_id", "session"], "left_semi"), ["run_id", "session"], max_chars, prioritize=True)
    # One text per run serves all its silent sessions.
    shared = notes_digest(last.filter(F.col("recency") <= fallback), ["run_id"], max_chars, prioritize=True).withColumnRenamed("digest", "_shared")
    text = F.coalesce("digest", "_shared", F.lit(K.NO_NOTES))
    return sessions.join(own, ["run_id", "session"], "left").join(shared, "run_id", "left").select("run_id", "session", text.alias("digest"))


def shortlist_digest(merged: DataFrame, urls: DataFrame, max_chars: int = 6000) -> DataFrame:
    """Numbered shortlist per run: at most four URLs and 200 characters of details per candidate."""
    best = top_k(urls, ["run_id", "name_key"], url_order(), 4, "url", rank="_r")
    listed = best.groupBy("run_id", "name_key").agg(F.array_sort(F.collect_list(F.struct("_r", "url"))).alias("_u"))
    body = F.concat(
        F.lit(". "), "name", F.lit(" | match="), F.coalesce(F.nullif("match_status", F.lit("")), F.lit("?")),
        F.lit(" | price="), F.coalesce(F.nullif("price", F.lit("")), F.lit("—")),
        F.lit(" | urls="), F.coalesce(F.nullif(F.array_join(F.transform("_u", lambda x: x["url"]), "; "), F.lit("")), F.lit("—")),
        F.lit(" | "), F.substring(F.coalesce("details", F.lit("")), 1, 200),
    )
    rows = merged.join(listed, ["run_id", "name_key"], "left").select("run_id", "first_seq", body.alias("body"))
    few = top_k(rows, ["run_id"], [F.asc("first_seq")], max_chars // MIN_SHORTLIST_LINE + 1, "first_seq", rank="pos")
    numbered = few.withColumn("line", F.concat(F.col("pos").cast("string"), F.col("body")))
    upto = W.partitionBy("run_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    fit = numbered.withColumn("fits", F.sum(F.length("line")).over(upto) <= max_chars)
    counts = merged.groupBy("run_id").agg(F.count(F.lit(1)).alias("candidates"))
    head = F.concat(F.lit("Shortlist ("), F.col("candidates").cast("string"), F.lit(" unique candidates):\n"))
    return join_lines(fit, ["run_id"], K.SHORTLIST_CUT).join(counts, "run_id").select(
        "run_id", "candidates", F.concat(head, "digest").alias("digest")
    )


def memory_digest(tactics: DataFrame, patterns: DataFrame, strategies: DataFrame, as_of: Column,
                  max_tactics: int = K.MAX_TACTICS, max_patterns: int = K.MAX_PATTERNS,
                  max_strategies: int = K.MAX_STRATEGIES, days: int = K.RETEST_AFTER_DAYS) -> DataFrame:
    """One text of what is learned: recent tactics, recent patterns, first strategies (each a top-k)."""
    newest = lambda df, k: df.orderBy(F.desc_nulls_last("last_verified"), F.asc("pos")).limit(k)
    t = newest(tactics, max_tactics).select(
        F.lit(1).alias("section"), "last_verified", "pos",
        F.concat(
            F.lit("- "), "domain", F.lit(": prefer `"), "preferred_tool", F.lit("` ("), F.coalesce("reason", F.lit("")), F.lit(")"),
            F.when(is_stale(F.col("last_verified"), as_of, days), K.STALE_MARK).otherwise(""),
        ).alias("line"),
    )
    listed = lambda c, n: F.array_join(F.slice(c, 1, n), ", ")
    p = newest(patterns, max_patterns).select(
        F.lit(2).alias("section"), "last_verified", "pos",
        F.concat(
            F.lit("- "), "domain", F.lit(": paths=["), listed("path_hints", 3), F.lit("] params=["), listed("param_names", 12),
            F.lit("] (hits="), F.col("success_count").cast("string"), F.lit(")"),
            F.coalesce(F.concat(F.lit("\n  e.g. "), F.try_element_at("example_urls", F.lit(1))), F.lit("")),
        ).alias("line"),
    )
    s = strategies.orderBy("seeded", "pos").limit(max_strategies).select(
        F.lit(3).alias("section"), F.lit(None).cast("timestamp_ntz").alias("last_verified"),
        (F.col("seeded") * (1 << 40) + F.col("pos")).alias("pos"),
        F.concat(F.lit("- When: "), F.coalesce("trigger", F.lit("")), F.lit(" → "), F.coalesce("tactic", F.lit(""))).alias("line"),
    )
    # At most max_tactics + max_patterns + max_strategies rows get here.
    rows = t.unionByName(p).unionByName(s)
    key = F.struct((-F.unix_micros(F.col("last_verified").cast("timestamp"))).alias("a"), F.col("pos").alias("b"), F.col("line"))

    def section(n: int) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == n, key))), lambda x: x["line"]), "\n")

    def block(head: str, body: str) -> Column:
        return F.when(F.col(body) != "", F.concat(F.lit(head + "\n"), body))

    texts = rows.agg(section(1).alias("t"), section(2).alias("p"), section(3).alias("s"))
    joined = F.concat_ws("\n", block(K.TACTICS_HEAD, "t"), block("\n" + K.PATTERNS_HEAD, "p"), block("\n" + K.STRATEGIES_HEAD, "s"))
    return texts.select(F.coalesce(F.nullif(joined, F.lit("")), F.lit(K.MEMORY_EMPTY)).alias("digest"))


def last_draft(messages: DataFrame, min_chars: int = 200) -> DataFrame:
    """Last assistant message per run that is long enough to serve as a draft."""
    text = message_text(F.col("content"), F.col("thinking"))
    return (
        messages.filter(F.col("role") == "assistant")
        .select("run_id", "turn", text.alias("text"))
        .filter(F.length("text") > min_chars)
        .groupBy("run_id")
        .agg(F.max_by("text", "turn").alias("draft"))
    )


def partial_report_lines(runs: DataFrame, messages: DataFrame, sources: DataFrame, digests: DataFrame) -> DataFrame:
    """Report of an unfinished run as ordered lines ``run_id, section, at, pos, line``.

    The last long assistant message is the report when there is one; else the question, the notes digest,
    the distinct sources and the limitations. Source lines stay rows, as a run may have any number of them;
    concatenating the lines in (section, at, pos) order gives the text. ``runs`` carries ``task`` and ``status``.
    """
    r = runs.join(last_draft(messages), "run_id", "left")
    title = F.concat(F.lit("# Research Report (partial – status: "), "status", F.lit(")\n"))
    zero = F.lit(0).cast("long")
    fixed = lambda section, line: F.struct(F.lit(section).alias("section"), zero.alias("at"), zero.alias("pos"), line.alias("line"))
    drafted = F.array(
        fixed(0, title),
        fixed(1, F.lit("> Run did not complete normally. Best available draft below.\n")),
        fixed(2, F.col("draft")),
    )
    question = F.concat(F.substring("task", 1, 800), F.when(F.length("task") > 800, "...").otherwise(""))
    assembled = F.array(
        fixed(0, title),
        fixed(1, F.lit("## Research question")),
        fixed(2, F.concat(question, F.lit("\n"))),
        fixed(3, F.lit("## Notes collected")),
        fixed(4, F.concat(F.coalesce(F.nullif("digest", F.lit("")), F.lit("(none)")), F.lit("\n"))),
        fixed(5, F.lit("## Sources retrieved")),
        fixed(7, F.lit("\n## Uncertainties & limitations")),
        fixed(8, F.concat(F.lit("- Run ended with status: `"), "status", F.lit("`"))),
        fixed(9, F.lit("- No complete agent report was produced.\n")),
    )
    frame = (
        r.join(digests, "run_id", "left")
        .select("run_id", F.explode(F.when(F.col("draft").isNotNull(), drafted).otherwise(assembled)).alias("_l"))
        .select("run_id", "_l.*")
    )
    bare = r.filter(F.col("draft").isNull()).select("run_id")
    cited = sources.select("run_id", "url", "seq", "pos", "title", "error").filter(F.coalesce("url", F.lit("")) != "")
    found = distinct_sources(cited)
    line = F.concat(
        F.lit("- "), F.coalesce(F.nullif("title", F.lit("")), "url"), F.lit(" — "), "url",
        F.coalesce(F.concat(F.lit(" (error: "), F.nullif("error", F.lit("")), F.lit(")")), F.lit("")),
    )
    # A run without sources has one row with no URL, which becomes the line that says so.
    listed = bare.join(found, "run_id", "left").select(
        "run_id", F.lit(6).alias("section"), F.coalesce(F.col("seq").cast("long"), zero).alias("at"), F.coalesce(F.col("pos").cast("long"), zero).alias("pos"),
        F.coalesce(line, F.lit("- (no sources retrieved)")).alias("line"),
    )
    return frame.unionByName(listed)
