"""Session guard: which attempted browser actions run, and which are refused and why.

Every verdict depends on the verdicts before it in the session, so a session is replayed in order. Rows are
hash-partitioned by session and sorted by Spark; a task reads them as a stream and holds the counters of
one session at a time, never its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from siftline import constants as K
from siftline.functions import urls as U
from siftline.operators.ordered import salted_join
from siftline.operators.patterns import match_patterns

COLUMNS = [
    "run_id", "session_id", "seq", "tool", "arg_url", "url", "errored", "hints",
    "arg_host", "url_host", "arg_root", "arg_search", "known_host",
]
OUTPUT = "run_id long, session_id long, seq long, tool string, host string, verdict string, noop boolean, action_no long"


@dataclass
class Session:
    """Counters of one session."""

    tab: str = ""
    tab_host: str = ""
    count: dict[str, int] = field(default_factory=dict)
    noops: dict[str, int] = field(default_factory=dict)
    blocked: set[str] = field(default_factory=set)
    graced: set[str] = field(default_factory=set)
    last: dict[str, tuple[str, frozenset[str]]] = field(default_factory=dict)


def judge(s: Session, a, max_actions: int, max_noops: int) -> tuple[str, str, bool, int]:
    """Verdict on one attempt, as (host, verdict, noop, action number); updates the session."""
    target = a.arg_host if a.arg_url else s.tab_host
    verdict = "run"
    if target and target in s.blocked:
        recovers = (
            a.tool == "browser_open" and target not in s.graced and a.arg_url and a.arg_url != s.tab
            and a.arg_search and not a.arg_root
        )
        if not recovers:
            return target, "blocked_host", False, s.count.get(target, 0)
        s.graced.add(target)
        s.blocked.discard(target)
        s.noops[target] = 0
        verdict = "grace"
    if a.tool == "browser_open" and target and a.arg_url and a.arg_root and a.known_host:
        return target, "blocked_root_open", False, s.count.get(target, 0)
    if target and s.count.get(target, 0) >= max_actions:
        s.blocked.add(target)
        return target, "budget", False, s.count[target]
    if a.url and a.url.startswith("http"):
        s.tab, s.tab_host = a.url, a.url_host
    elif a.tool == "browser_open" and a.arg_url and not a.errored:
        s.tab, s.tab_host = a.arg_url, a.arg_host
    host = s.tab_host or a.url_host or target
    if not host:
        return "", verdict, False, 0
    s.count[host] = s.count.get(host, 0) + 1
    page, hints = s.tab or a.url or "", frozenset(a.hints)
    before = s.last.get(host)
    noop = before is not None and (bool(a.errored) or (page != "" and page == before[0] and hints <= before[1]))
    s.last[host] = (page, hints)
    s.noops[host] = s.noops.get(host, 0) + 1 if noop else 0
    if s.noops[host] >= max_noops or s.count[host] >= max_actions:
        s.blocked.add(host)
    return host, verdict, noop, s.count[host]


def attempts_with_facts(attempts: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Browser attempts with everything a verdict needs that does not depend on other verdicts."""
    arg = F.coalesce("arg_url", F.lit(""))
    flat = attempts.filter(F.col("tool").startswith("browser_")).select(
        "run_id", "session_id", "seq", "tool", arg.alias("arg_url"), F.coalesce("url", F.lit("")).alias("url"),
        (F.coalesce("error", F.lit("")) != "").alias("errored"), F.slice("price_hints", 1, 20).alias("hints"),
        U.host_key(arg).alias("arg_host"), U.host_key(F.col("url")).alias("url_host"),
        U.is_root_page(arg).alias("arg_root"), U.is_search_page(arg).alias("arg_search"),
    )
    if patterns is None:
        return flat.withColumn("known_host", F.lit(False))
    useful = patterns.filter((F.size("param_names") > 0) | (F.size("path_hints") > 0))
    roots = flat.filter(F.col("arg_root") & (F.col("tool") == "browser_open")).select(F.col("arg_host").alias("host"))
    known = match_patterns(roots, useful).select(F.col("host").alias("arg_host"), F.lit(True).alias("known_host"))
    return salted_join(flat, known, ["arg_host"], "seq", "left").withColumn("known_host", F.coalesce("known_host", F.lit(False)))


def guard_sessions(facts: DataFrame, max_actions: int = K.MAX_ACTIONS_PER_HOST, max_noops: int = K.MAX_NOOPS_PER_HOST) -> DataFrame:
    """Verdict per attempted browser action."""
    keys = ["run_id", "session_id"]

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, session = None, Session()
        for batch in batches:
            out = []
            for a in batch.itertuples(index=False):
                if (a.run_id, a.session_id) != at:
                    at, session = (a.run_id, a.session_id), Session()
                out.append((a.run_id, a.session_id, a.seq, a.tool, *judge(session, a, max_actions, max_noops)))
            yield pd.DataFrame(out, columns=["run_id", "session_id", "seq", "tool", "host", "verdict", "noop", "action_no"])

    ordered = facts.select(*COLUMNS).repartition(*keys).sortWithinPartitions(*keys, "seq")
    return ordered.mapInPandas(replay, OUTPUT)
