"""Learned access tactics per domain: learning, lookup, rerouting and staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftline import constants as K
from siftline.functions import urls as U
from siftline.operators.evidence import learned_tactic_error
from siftline.operators.ordered import BLOCK_ROWS, as_of, running, salted_join

COLUMNS = ["domain", "preferred_tool", "reason", "last_verified", "success_count", "pos"]


def tactic_signals(events: DataFrame) -> DataFrame:
    """``domain, seq, ts, fail, win, blocked`` of the events that can teach a tactic: failed fetches and browser successes."""
    err = F.coalesce("error", F.lit(""))
    fail = (F.col("tool") == "web_fetch") & (F.coalesce("blocked", F.lit(False)) | err.contains("403"))
    win = (F.col("tool") == "browser_open") & F.coalesce("ok", F.lit(False))
    return (
        events.select(U.domain_key(F.col("url")).alias("domain"), "seq", "ts", fail.alias("fail"), win.alias("win"), F.coalesce("blocked", F.lit(False)).alias("blocked"))
        .filter((F.col("domain") != "") & (F.col("fail") | F.col("win")))
    )


def learn_tactics(events: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Tactics from a tool-event log, on top of ``prior`` tactics when given.

    A domain is locked to the browser by its first blocked fetch (or a blocked browser success, or a prior
    lock). Every fetch failure and browser success from the lock on counts. Both passes aggregate map-side;
    the lock is joined back on a salted key.
    """
    signals = tactic_signals(events)
    locks = (
        signals.filter(F.col("fail") | F.col("blocked")).groupBy("domain").agg(F.min("seq").alias("lock"))
    )
    if prior is not None:
        held = prior.filter(F.col("preferred_tool") == "browser_open").select("domain", F.lit(-1).cast("long").alias("lock"))
        locks = locks.unionByName(held).groupBy("domain").agg(F.min("lock").alias("lock"))
    counted = (
        salted_join(signals, locks, ["domain"], "seq")
        .filter(F.col("seq") >= F.col("lock"))
        .groupBy("domain")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max_by("ts", "seq").alias("last"),
            F.bool_or("fail").alias("failed"),
            F.min("seq").alias("pos"),
        )
    )
    if prior is None:
        return counted.select(
            "domain",
            F.lit("browser_open").alias("preferred_tool"),
            F.when(F.col("failed"), K.REASON_BLOCKED).otherwise(K.REASON_BROWSER).alias("reason"),
            F.col("last").alias("last_verified"),
            F.col("n").alias("success_count"),
            "pos",
        )
    old = prior.select("domain", *[F.col(c).alias(f"_{c}") for c in COLUMNS[1:]])
    seen = F.col("n").isNotNull()
    return counted.join(old, "domain", "full").select(
        "domain",
        F.when(seen, F.lit("browser_open")).otherwise(F.col("_preferred_tool")).alias("preferred_tool"),
        F.when(F.col("failed"), K.REASON_BLOCKED)
        .otherwise(F.coalesce(F.nullif("_reason", F.lit("")), F.when(seen, K.REASON_BROWSER)))
        .alias("reason"),
        F.coalesce("last", "_last_verified").alias("last_verified"),
        (F.coalesce("n", F.lit(0)) + F.coalesce("_success_count", F.lit(0))).alias("success_count"),
        F.coalesce("_pos", "pos").alias("pos"),
    )


def preferred_tools(domains: DataFrame, tactics: DataFrame) -> DataFrame:
    """Preferred tool per distinct ``domain``: its own tactic, else the earliest stored parent domain's.

    The suffix match is an equi-join on the exploded parent domains.
    """
    suffixes = domains.select("domain").filter(F.col("domain") != "").distinct().select(
        "domain", F.explode(U.host_suffixes(F.col("domain"))).alias("_key")
    )
    stored = tactics.select(F.col("domain").alias("_key"), "preferred_tool", "pos")
    return (
        suffixes.join(stored, "_key")
        .groupBy("domain")
        .agg(F.min_by("preferred_tool", F.struct(F.col("_key") != F.col("domain"), "pos")).alias("preferred_tool"))
    )


def with_preferred_tool(events: DataFrame, tactics: DataFrame, url: str = "url", spread_on: str = "seq") -> DataFrame:
    """Events with the learned tool of their URL's domain (NULL when nothing is learned)."""
    keyed = events.withColumn("domain", U.domain_key(F.col(url)))
    return salted_join(keyed, preferred_tools(keyed, tactics), ["domain"], spread_on, "left")


def reroute_fetches(events: DataFrame, tactics: DataFrame) -> DataFrame:
    """Fetches with a ``rerouted`` flag: a domain that prefers the browser is answered without fetching."""
    fetches = events.filter(F.col("tool") == "web_fetch")
    hit = F.coalesce(F.col("preferred_tool") == "browser_open", F.lit(False))
    return with_preferred_tool(fetches, tactics).withColumns(
        {
            "rerouted": hit,
            "blocked": hit | F.coalesce("blocked", F.lit(False)),
            "error": F.when(hit, learned_tactic_error(F.col("url"))).otherwise(F.col("error")),
        }
    )


def tactic_versions(events: DataFrame, prior: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every state of every tactic: ``domain, seq, tactic``, a row for each event after which the domain's tactic is another.

    The last version of a domain is what :func:`learn_tactics` returns. Stored tactics are versions before any event. Lock,
    count, reason and time run over a domain's signals in blocks.
    """
    no = F.lit(False)
    none = lambda kind: F.lit(None).cast(kind)
    steps = tactic_signals(events).select("domain", "seq", "ts", "fail", (F.col("fail") | F.col("blocked")).alias("locks"), F.lit(1).cast("long").alias("n"),
                                          none("string").alias("tool"), none("string").alias("reason"), none("long").alias("pos"))
    if prior is not None:
        held = F.col("preferred_tool") == "browser_open"
        steps = steps.unionByName(prior.select("domain", F.lit(-1).cast("long").alias("seq"), F.col("last_verified").alias("ts"), no.alias("fail"), held.alias("locks"),
                                               F.coalesce("success_count", F.lit(0)).cast("long").alias("n"), F.col("preferred_tool").alias("tool"), "reason", "pos"))
    locked = running(steps, ["domain"], "seq", block_rows, maxes={"_lock": F.when(F.col("locks"), 1)})
    counted = locked.filter(F.col("_lock").isNotNull() | (F.col("seq") < 0))
    summed = running(
        counted, ["domain"], "seq", block_rows, sums={"_n": F.col("n")}, maxes={"_failed": F.when(F.col("fail"), 1), "_first": -F.col("seq")},
        lasts={"_ts": F.col("ts"), "_tool": F.col("tool"), "_reason": F.nullif("reason", F.lit("")), "_pos": F.col("pos")},
    )
    event = F.col("seq") >= 0
    return summed.select(
        "domain", "seq",
        F.struct(
            F.when(event, F.lit("browser_open")).otherwise(F.col("_tool")).alias("preferred_tool"),
            F.when(F.col("_failed").isNotNull(), K.REASON_BLOCKED).otherwise(F.coalesce("_reason", F.when(event, K.REASON_BROWSER))).alias("reason"),
            F.col("_ts").alias("last_verified"), F.col("_n").alias("success_count"), F.coalesce("_pos", -F.col("_first")).alias("pos"),
        ).alias("tactic"),
    )


def with_tactic_as_of(events: DataFrame, versions: DataFrame, url: str = "url", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Events with ``tactic``, what was known for their URL's domain before them: its own, else the earliest stored parent's.

    Each event looks at every parent of its domain as of its ``seq``, on thin rows; ``seq`` is unique.
    """
    keyed = events.withColumn("domain", U.domain_key(F.col(url)))
    wanted = keyed.filter(F.col("domain") != "").select("seq", "domain", F.explode(U.host_suffixes(F.col("domain"))).alias("_key"))
    known = as_of(wanted, versions.withColumnRenamed("domain", "_key"), ["_key"], "seq", "tactic", block_rows).filter(F.col("tactic").isNotNull())
    best = known.groupBy("seq").agg(F.min_by("tactic", F.struct(F.col("_key") != F.col("domain"), F.col("tactic.pos"))).alias("tactic"))
    return keyed.join(best, "seq", "left")


def reroute_fetches_as_of(events: DataFrame, versions: DataFrame) -> DataFrame:
    """:func:`reroute_fetches` by what was known at each fetch: a failure that comes later reroutes nothing before it."""
    hit = F.coalesce(F.col("tactic.preferred_tool") == "browser_open", F.lit(False))
    return with_tactic_as_of(events.filter(F.col("tool") == "web_fetch"), versions).withColumns(
        {
            "rerouted": hit,
            "blocked": hit | F.coalesce("blocked", F.lit(False)),
            "error": F.when(hit, learned_tactic_error(F.col("url"))).otherwise(F.col("error")),
        }
    )


def is_stale(last_verified: Column, as_of: Column, days: int = K.RETEST_AFTER_DAYS) -> Column:
    """Verified longer ago than the retest interval; unknown times are not stale."""
    return F.coalesce(last_verified < as_of - F.make_dt_interval(F.lit(days)), F.lit(False))


def parse_verified(text: Column) -> Column:
    """ISO time text to a timestamp, NULL when unreadable."""
    return F.try_to_timestamp(text)
