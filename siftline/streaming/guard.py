"""Session guard on a stream of attempts: the session's counters live in Spark's state store."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siftline import constants as K
from siftline.operators.guard import OUTPUT, Session, judge

COLUMNS = ["run_id", "session_id", "seq", "tool", "host", "verdict", "noop", "action_no"]
IDLE_MS = 6 * 3600 * 1000


def dump(s: Session) -> str:
    return json.dumps(
        {
            "tab": s.tab, "tab_host": s.tab_host, "count": s.count, "noops": s.noops,
            "blocked": sorted(s.blocked), "graced": sorted(s.graced),
            "last": {h: [u, sorted(hints)] for h, (u, hints) in s.last.items()},
        }
    )


def load(text: str) -> Session:
    d = json.loads(text)
    return Session(
        d["tab"], d["tab_host"], d["count"], d["noops"], set(d["blocked"]), set(d["graced"]),
        {h: (u, frozenset(hints)) for h, (u, hints) in d["last"].items()},
    )


class GuardProcessor(StatefulProcessor):
    """Judges a session's attempts in order; with a time-to-live, the state of idle sessions is dropped."""

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "body string", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session = load(self.state.get()[0]) if self.state.exists() else Session()
        batch = pd.concat(list(rows)).sort_values("seq")
        out = [
            (a.run_id, a.session_id, a.seq, a.tool, *judge(session, a, K.MAX_ACTIONS_PER_HOST, K.MAX_NOOPS_PER_HOST))
            for a in batch.itertuples(index=False)
        ]
        self.state.update((dump(session),))
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def guard_stream(facts: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Verdicts for a stream of attempts with facts; a session's rows of one micro-batch are judged together.

    A micro-batch is bounded by the source's rate options, so what one session brings per batch is too. Set
    ``idle_ms`` (say :data:`IDLE_MS`) for a query that runs on: its processing-time clock never lets an
    ``availableNow`` run end. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    return facts.groupBy("run_id", "session_id").transformWithStateInPandas(
        statefulProcessor=GuardProcessor(idle_ms),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="None" if idle_ms is None else "ProcessingTime",
    )
