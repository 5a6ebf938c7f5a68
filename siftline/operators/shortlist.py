"""Candidate mentions to a checked, merged shortlist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftline import constants as K
from siftline.functions import text as TX, urls as U
from siftline.operators.ordered import running, salted_join

DETAILS_CHARS = 1200


def constraint_check(matched: Column, unmatched: Column, unknown: Column, status: Column, notes: Column, shorthand: Column) -> Column:
    """Checked constraint lists: ``struct<ok, error, match_status, matched, unmatched, unknown, notes>``.

    ``status`` NULL means the check does not carry one; only then ``shorthand`` counts.
    """
    hits, misses, open_ = TX.clean_list(matched), TX.clean_list(unmatched), TX.clean_list(unknown)
    given = F.coalesce(matched, unmatched, unknown).isNotNull() | status.isNotNull() | notes.isNotNull()
    short = F.nullif(shorthand, F.lit(""))
    stated = F.lower(TX.utrim(F.coalesce(status, short, F.lit(""))))
    derived = (
        F.when(F.size(misses) > 0, "partial")
        .when((F.size(hits) > 0) & (F.size(open_) == 0), "full")
        .otherwise("unknown")
    )
    error = (
        F.when(~given & short.isNull(), K.ERR_CONSTRAINTS_MISSING)
        .when((stated != "") & ~stated.isin("full", "partial", "unknown"), K.ERR_MATCH_STATUS)
        .when((stated == "") & (F.size(hits) + F.size(misses) + F.size(open_) == 0), K.ERR_CONSTRAINTS_EMPTY)
    )
    text = F.substring(TX.utrim(F.coalesce(notes, F.lit(""))), 1, 500)
    return F.struct(
        error.isNull().alias("ok"),
        error.alias("error"),
        F.when(error.isNull(), F.when(stated != "", stated).otherwise(derived)).alias("match_status"),
        hits.alias("matched"),
        misses.alias("unmatched"),
        open_.alias("unknown"),
        F.nullif(text, F.lit("")).alias("notes"),
    )


def check_candidates(candidates: DataFrame) -> DataFrame:
    """Candidate rows with trimmed fields, their merge key, the constraint check and a reject reason (NULL = accepted).

    ``given_name`` keeps the name as it was given.
    """
    null = F.lit(None).cast("string")
    inner = F.col("constraint_status") if "constraint_status" in candidates.columns else null
    notes = F.col("constraint_notes") if "constraint_notes" in candidates.columns else null
    check = constraint_check(F.col("matched"), F.col("unmatched"), F.col("unknown"), inner, notes, F.col("match_status"))
    name = TX.utrim(F.coalesce("name", F.lit("")))
    reason = (
        F.when(F.col("_name") == "", K.ERR_NAME)
        .when(~F.col("check.ok"), F.col("check.error"))
        .when(TX.is_blank(F.col("source_url")) & TX.is_blank(F.col("price")), K.ERR_NO_EVIDENCE)
    )
    return (
        candidates.withColumns({"check": check, "_name": name})
        .withColumns({"reject_reason": reason, "given_name": F.col("name"), "name": F.col("_name"), "name_key": TX.name_key(F.col("_name"))})
        .drop("_name")
    )


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNull())


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNotNull())


KEY = ["run_id", "name_key"]


def merge_candidates(rows: DataFrame) -> DataFrame:
    """One row per (run, merge key) from accepted candidate rows.

    Folding the rows in arrival order is written as order-aware aggregates, which combine map-side. Only the
    price needs to know something first: an unparseable price resets the minimum, so the last reset per key
    is found in a narrow pass of its own and joined back. A column ``mentions`` says how many mentions a row stands for.
    """
    price, seq = F.col("price"), F.col("seq")
    number = TX.price_number(price)
    has_price = ~TX.is_blank(price)
    resets = (
        rows.filter(has_price & number.isNull())
        .groupBy(*KEY)
        .agg(F.max("seq").alias("_reset"), F.max_by("price", "seq").alias("_reset_price"))
    )
    url = TX.utrim(F.coalesce("source_url", F.lit("")))
    details = TX.utrim(F.coalesce("details", F.lit("")))
    flat = rows.select(
        *KEY, "seq", "ts", "session", "name", "price", "check", number.alias("_number"), url.alias("_url"),
        F.substring(F.coalesce("details", F.lit("")), 1, DETAILS_CHARS).alias("_raw"),
        F.substring(details, 1, DETAILS_CHARS).alias("_details"),
        *[c for c in ("extra", "mentions") if c in rows.columns],
    )
    joined = salted_join(flat, resets, KEY, "seq", "left")
    live = F.col("_number").isNotNull() & (seq > F.coalesce("_reset", F.lit(-1)))
    has_url = F.col("_url") != ""
    merged = joined.groupBy(*KEY).agg(
        F.max_by("name", F.struct(F.length("name"), seq)).alias("name"),
        F.max_by("_url", F.when(has_url, F.struct(U.detail_flag(F.col("_url")), U.detail_length(F.col("_url")), -seq))).alias("_primary"),
        F.min_by("price", F.when(live, F.struct("_number", seq))).alias("_lowest"),
        F.max("_reset_price").alias("_reset_price"),
        F.min_by("price", "seq").alias("_first_price"),
        F.max_by(F.struct("_details", "seq"), F.struct(F.length("_details"), seq)).alias("_best"),
        F.min_by("_raw", "seq").alias("_first_raw"),
        F.max_by("check", "seq").alias("constraints"),
        F.max_by("session", F.when(F.col("session") != "", seq)).alias("_session"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        F.max_by("ts", "seq").alias("updated_at"),
        (F.sum("mentions") if "mentions" in rows.columns else F.count(F.lit(1))).alias("mentions"),
        *([F.max_by("extra", "seq").alias("extra")] if "extra" in rows.columns else []),
    )
    # The first row's details are kept as written, later ones trimmed; the longest wins, the latest on ties.
    keep_first = (F.col("_best.seq") == F.col("first_seq")) | (F.length("_best._details") < F.length("_first_raw"))
    return merged.select(
        *KEY,
        "name",
        F.coalesce("_primary", F.lit("")).alias("source_url"),
        F.coalesce("_lowest", "_reset_price", "_first_price", F.lit("")).alias("price"),
        F.when(keep_first, F.col("_first_raw")).otherwise(F.col("_best._details")).alias("details"),
        F.col("constraints.match_status").alias("match_status"),
        F.col("constraints.matched").alias("matched"),
        F.col("constraints.unmatched").alias("unmatched"),
        F.col("constraints.unknown").alias("unknown"),
        F.col("constraints.notes").alias("notes"),
        F.coalesce("_session", F.lit("")).alias("session"),
        "first_seq", "last_seq", "updated_at", "mentions",
        *(["extra"] if "extra" in rows.columns else []),
    )


#: Columns of accepted rows that the merge reads.
MERGED = [*KEY, "seq", "ts", "session", "name", "price", "check", "source_url", "details"]


def decisive_rows(rows: DataFrame) -> DataFrame:
    """The accepted rows on which the merge of their key depends, whatever rows come later and in any order.

    Those are the first and the last row, the ones with the longest name, the best URL, the longest details, the last
    session and the last price reset, and of the numeric prices after that reset each that no later one undercuts, since
    a reset between them may still arrive; of equal price texts in a row the last is enough. ``merge_candidates`` gives
    the same for these rows as for all, and the decisive rows of decisive rows and others are those of all. ``mentions``
    moves the number of all rows to the first one. ``seq`` is unique within a key; of rows that share one, any one stays.
    """
    seq, price = F.col("seq"), F.col("price")
    number, url = TX.price_number(price), TX.utrim(F.coalesce("source_url", F.lit("")))
    reset = ~TX.is_blank(price) & number.isNull()
    weighed = rows if "mentions" in rows.columns else rows.withColumn("mentions", F.lit(1).cast("long"))
    details = F.substring(TX.utrim(F.coalesce("details", F.lit(""))), 1, DETAILS_CHARS)
    found = weighed.groupBy(*KEY).agg(
        F.min("seq").alias("_first"), F.max("seq").alias("_last"), F.sum("mentions").alias("_total"), F.max(F.when(reset, seq)).alias("_reset"),
        F.max_by("seq", F.struct(F.length("name"), seq)).alias("_name"),
        F.max_by("seq", F.when(url != "", F.struct(U.detail_flag(url), U.detail_length(url), -seq))).alias("_url"),
        F.max_by("seq", F.struct(F.length(details), seq)).alias("_details"),
        F.max(F.when(F.col("session") != "", seq)).alias("_session"),
    )
    places = [F.struct(F.col(c).alias("seq"), (F.col("_total") if c == "_first" else F.lit(0)).cast("long").alias("_mentions")) for c in ("_first", "_last", "_reset", "_name", "_url", "_details", "_session")]
    single = found.select(*KEY, F.inline(F.array(*places))).filter(seq.isNotNull())
    priced = weighed.filter(~TX.is_blank(price) & number.isNotNull()).select(*KEY, "seq", "price", number.alias("_number"), (-seq).alias("_back"))
    live = salted_join(priced, found.select(*KEY, "_reset"), KEY, "seq", "left").filter(seq > F.coalesce("_reset", F.lit(-1)))
    low = running(live, KEY, "_back", maxes={"_lowest": -F.col("_number")}).filter(F.col("_number") == -F.col("_lowest"))
    steps = running(low.select(*KEY, "_back", "price"), KEY, "_back", lags={"_next": price}).filter(~F.col("_next").eqNullSafe(price))
    decided = single.unionByName(steps.select(*KEY, (-F.col("_back")).alias("seq"), F.lit(0).cast("long").alias("_mentions")))
    # The pairs of key and number hash evenly, however many rows a key has.
    once = decided.groupBy(*KEY, "seq").agg(F.max("_mentions").alias("mentions"))
    return weighed.drop("mentions").dropDuplicates([*KEY, "seq"]).join(once, [*KEY, "seq"]).select(*[c for c in weighed.columns])


def candidate_urls(rows: DataFrame) -> DataFrame:
    """Distinct URLs per candidate as rows with their ranking columns (detail pages, longer paths, first seen)."""
    url = TX.utrim(F.coalesce("source_url", F.lit("")))
    return (
        rows.select(*KEY, url.alias("url"), "seq")
        .filter(F.col("url") != "")
        .groupBy(*KEY, "url")
        .agg(F.min("seq").alias("first_seen"))
        .withColumns({"detail": U.detail_flag(F.col("url")), "path_chars": U.detail_length(F.col("url"))})
    )


def url_order() -> list[Column]:
    return [F.desc("detail"), F.desc("path_chars"), F.asc("first_seen")]


def shortlist_items(merged: DataFrame, urls: DataFrame) -> DataFrame:
    """Shortlist rows with the whole ranked ``source_urls`` list, the nested form that sinks write.

    The list is part of the row, so it holds every distinct URL of that one candidate.
    """
    ranked = F.array_sort(
        F.collect_list(F.struct((-F.col("detail")).alias("a"), (-F.col("path_chars")).alias("b"), F.col("first_seen").alias("c"), F.col("url")))
    )
    lists = urls.groupBy(*KEY).agg(F.transform(ranked, lambda u: u["url"]).alias("source_urls"))
    return merged.join(lists, KEY, "left").withColumn(
        "source_urls", F.coalesce("source_urls", F.array().cast("array<string>"))
    )


def upsert_actions(checked: DataFrame) -> DataFrame:
    """Per attempt: ``added`` for the first accepted row of a key, ``updated`` after it, NULL when rejected."""
    ok = F.col("reject_reason").isNull()
    firsts = checked.filter(ok).groupBy(*KEY).agg(F.min("seq").alias("_first"))
    joined = checked.join(firsts, KEY, "left")
    action = F.when(ok, F.when(F.col("seq") == F.col("_first"), "added").otherwise("updated"))
    return joined.withColumn("action", action).drop("_first")


def shortlist_notes(actions: DataFrame) -> DataFrame:
    """The note left by every upsert attempt (rows of :func:`upsert_actions`), built from the arguments as given."""
    none = lambda c: F.coalesce(c, F.lit("None"))
    summary = F.concat(
        none(F.col("action")), F.lit(": price="), none(F.col("price")), F.lit(" url="), none(F.col("source_url")),
        F.lit(" "), F.substring(F.coalesce("details", F.lit("")), 1, 200),
    )
    return actions.select(
        "seq", "run_id", "session", F.lit("shortlist").alias("source_type"), F.col("given_name").alias("title"),
        F.coalesce("source_url", F.lit("")).alias("url"), summary.alias("summary"),
        F.col("action").isNotNull().alias("ok"),
    )
