"""The same waits on a stream: keyed state holds what was seen of each, and a timer ends it at its deadline."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from stratamill.functions.scalars import poll_cap, seconds
from stratamill.operators.waiting import error_of, state_of

#: What a stream of waits gives, once for each.
OUTCOME = "wait_id string, outcome string, error string, polls long, elapsed_s double, status string"
_SEEN = "at double, rank string, state string, status string, error string"
_WAIT = "started double, deadline double, most long, polls long, status string, over boolean"


class _Waits(StatefulProcessor):
    """Holds observations until the watermark has passed them, and then takes them in the order of time."""

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", _SEEN)
        self.wait = handle.getValueState("wait", _WAIT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        wait, new = self.wait.get(), []
        for table in rows:
            for r in table.itertuples(index=False):
                if wait is None:
                    wait = (r.started, r.deadline, int(r.most), 0, None, False)
                    self.wait.update(wait)
                    self.handle.registerTimer(_after(r.started + r.deadline))
                if not wait[5] and wait[0] <= r.at <= wait[0] + wait[1]:
                    new.append((float(r.at), r.rank, r.state, _text(r.status), _text(r.error)))
        if new:
            self.seen.appendList(new)
            self.handle.registerTimer(_after(min(new)[0]))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        wait = self.wait.get()
        if wait is None or wait[5]:
            yield pd.DataFrame()
            return
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        started, deadline, most, polls, status, _ = wait
        held = sorted(self.seen.get(), key=lambda x: (x[0], x[1]))
        due = [x for x in held if _after(x[0]) <= now]
        outcome, error, elapsed, before = None, None, deadline, None
        for at, _, state, seen, failed in due:
            if at == before:  # told more than once
                continue
            before = at
            if polls >= most:
                break
            polls += 1
            if state == "pending":
                status = status if failed else seen
                continue
            outcome, error, elapsed, status = state, failed, at - started, None if failed else seen
            break
        if outcome is None and now >= _after(started + deadline):
            outcome = "timeout"
        if outcome is None:
            self.wait.update((started, deadline, most, polls, status, False))
            self.seen.clear()
            if later := held[len(due) :]:
                self.seen.appendList([tuple(x) for x in later])
                self.handle.registerTimer(_after(later[0][0]))
            yield pd.DataFrame()
            return
        self.wait.update((started, deadline, most, polls, status, True))
        self.seen.clear()
        told = {"failed": "ProviderRejected", "timeout": "WaitTimeout", "aborted": error}.get(outcome)
        yield pd.DataFrame([(key[0], outcome, told, polls, elapsed, status)], columns=["wait_id", "outcome", "error", "polls", "elapsed_s", "status"])

    def close(self) -> None:
        pass


def _after(at: float) -> int:
    """Milliseconds by which all of a time has been."""
    return int(at * 1000) + 1


def _text(x) -> str | None:
    return None if x is None or x != x else str(x)


def waited(observations: DataFrame, requests: DataFrame, late: str = "10 minutes", at_col: str = "at") -> DataFrame:
    """OUTCOME of each wait of a stream, told once, when the watermark has passed the observation that decides it, or
    its deadline. As in ``operators.waiting.waited``, but that ``at`` is a timestamp, that a wait begins to be
    looked at with its first observation, and that requests with a malformed timeout give nothing. Observations may come in
    any order, be late by as much as ``late``, and come more than once.

    State is what was seen of each wait that is not over, at most an observation for each that the watermark
    has not passed, and a row for each that is. The session needs the RocksDB state store.
    """
    asked = requests.select("wait_id", "kind", "target", F.col("started").cast("double").alias("started"), seconds(F.col("timeout")).cast("double").alias("deadline")).where("deadline is not null")
    marked = observations.withWatermark(at_col, late).join(asked, "wait_id")
    state: Column = state_of(F.col("kind"), F.col("target"), F.col("action_state"), F.col("status"), F.col("missing"), F.col("error"))
    # of observations of one time the same counts as in a table: the least, nulls first
    parts = ("error", "action_state", "status", F.col("missing").cast("int").cast("string"))
    rank = F.concat_ws("\0", *(F.coalesce(F.concat(F.lit("1"), p), F.lit("0")) for p in parts))
    rows = marked.select("wait_id", at_col, rank.alias("rank"), F.col(at_col).cast("double").alias("seconds"), "started", "deadline", poll_cap(F.col("deadline")).alias("most"), state.alias("state"), "status", "error")
    rows = rows.withColumnsRenamed({at_col: "_event", "seconds": "at"})
    told = rows.groupBy("wait_id").transformWithStateInPandas(_Waits(), OUTCOME, "append", "EventTime")
    outcome = F.col("outcome")
    return told.withColumn("error", F.coalesce("error", error_of(outcome, F.col("error"))))
