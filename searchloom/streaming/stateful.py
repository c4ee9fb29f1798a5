"""Keyed state for streams: chained request budgets and ledger transitions.

The ledger check keeps arriving records in a buffer until the watermark has passed them and takes them by their sequence, so its
result does not depend on how the log was split into triggers, and records that come after their place has been passed
are named as late. The budgets order a trigger's rows of one key before use; trigger size is bounded by the source options.
Streams with keyed state need the RocksDB state store: start them inside ``windows.keyed_state`` or name it in the session.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from searchloom.functions.dates import instant_of
from searchloom.operators.ledger import LEGAL_MOVES

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Request budget of a key and of an address, and the window in seconds.
KEY_LIMIT = 6
ADDRESS_LIMIT = 20
WINDOW_SECONDS = 60
_MICRO = 1_000_000
BUDGET_SCHEMA = "key string, address string, event_id bigint, ts timestamp, ts_us bigint, allowed boolean, retry_after int, refused_by string"
BUDGET_COLUMNS = [field.split()[0] for field in BUDGET_SCHEMA.split(", ")]
MOVE_SCHEMA = "project_id string, change_id string, sequence bigint, previous_status string, status string, issue string"
MOVE_COLUMNS = [field.split()[0] for field in MOVE_SCHEMA.split(", ")]
# records of one change that go to the store, or come from it, in one message
_AT_ONCE = 10_000
_MOVES = {f"{a}>{b}" for a, targets in LEGAL_MOVES.items() for b in targets}


def _ordered(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(by, kind="stable")


class Budget(StatefulProcessor):
    """Fixed window opened by the first event; events over the limit get a waiting time.

    Rows without a budget here (``asks`` false: refused before, or nothing to count by) pass unchanged and leave no state.
    """

    def __init__(self, limit: int, window_seconds: int, name: str):
        self.limit, self.span, self.name = limit, window_seconds * _MICRO, name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "reset_us bigint, used int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        reset, used = self.window.get() if self.window.exists() else (None, 0)
        frame = _ordered(rows, ["ts_us", "event_id"])
        allowed, waits, refused = frame["allowed"].tolist(), frame["retry_after"].tolist(), frame["refused_by"].tolist()
        for k, (asks, at) in enumerate(frame[["asks", "ts_us"]].itertuples(index=False)):
            if not asks:
                continue
            if reset is None or reset <= at:
                reset, used = at + self.span, 0
            if used < self.limit:
                used += 1
            else:
                allowed[k], waits[k], refused[k] = False, max(1, -((at - reset) // _MICRO)), self.name
        if reset is not None:
            self.window.update((int(reset), int(used)))
            self.handle.registerTimer(int(reset // 1000))
        yield frame.assign(allowed=allowed, retry_after=[int(w) for w in waits], refused_by=refused)[BUDGET_COLUMNS]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A window fully behind the watermark frees its state."""
        if self.window.exists() and self.window.get()[0] // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


class Transitions(StatefulProcessor):
    """Takes a change's records by sequence once the watermark has passed them; emits illegal moves and late records.

    A record waits while a record of the change with a smaller sequence waits, whatever their times say. One whose sequence has been
    passed already is late: it is emitted as such and judged no further. ``keep_seconds`` bounds how long a silent change's last status is
    kept; None keeps it for good.
    """

    def __init__(self, keep_seconds: int | None = None):
        self.keep = keep_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, sequence bigint, ts_us bigint")
        # in order of arrival; many records go in one message
        self.waiting = handle.getListState("waiting", "sequence bigint, status string, ts_us bigint")

    def _wait(self, records: list[tuple]) -> None:
        for low in range(0, len(records), _AT_ONCE):
            self.waiting.appendList(records[low : low + _AT_ONCE])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()
        passed = last[1] if last else None
        late, soonest = [], None
        for batch in rows:
            arrived = []
            for sequence, status, ts_us, mark in zip(*(batch[c].tolist() for c in ("sequence", "status", "ts_us", "end_mark"))):
                if mark:
                    continue
                if passed is not None and sequence <= passed:
                    late.append((key[0], key[1], int(sequence), None, status, "late_record"))
                    continue
                arrived.append((int(sequence), status, int(ts_us)))
                soonest = ts_us if soonest is None else min(soonest, ts_us)
            self._wait(arrived)
        if soonest is not None:
            self.handle.registerTimer(int(soonest // 1000) + 1)
        if late:
            yield pd.DataFrame(late, columns=MOVE_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        previous, passed, seen = self.last.get() or (None, None, None)
        # a record that came again counts once, with its last time
        times = {(sequence, status): ts_us for sequence, status, ts_us in self.waiting.get()}
        waiting = sorted((*k, ts_us) for k, ts_us in times.items())
        out, left = [], []
        for at, (sequence, status, ts_us) in enumerate(waiting):
            if ts_us // 1000 >= watermark:
                # the records behind this one wait with it
                self.handle.registerTimer(int(ts_us // 1000) + 1)
                left = waiting[at:]
                break
            if passed is not None and sequence <= passed:
                out.append((key[0], key[1], sequence, previous, status, "repeated_sequence"))
                continue
            if previous is None:
                issue = None if status == "planned" else "first_status_not_planned"
            else:
                issue = None if f"{previous}>{status}" in _MOVES else "transition_not_allowed"
            if issue:
                out.append((key[0], key[1], sequence, previous, status, issue))
            previous, passed, seen = status, sequence, ts_us
        if len(left) < len(waiting):
            self.waiting.clear()
            self._wait(left)
        if passed is not None:
            self.last.update((previous, passed, seen))
            if self.keep is not None and not waiting:
                if seen // 1000 + self.keep * 1000 < watermark:
                    self.last.clear()
            if self.keep is not None and waiting:
                self.handle.registerTimer(int(seen // 1000) + self.keep * 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=MOVE_COLUMNS)

    def close(self) -> None:
        pass


def request_budget(
    events: DataFrame,
    key: str,
    address: str | None = None,
    key_limit: int = KEY_LIMIT,
    address_limit: int = ADDRESS_LIMIT,
    window_seconds: int = WINDOW_SECONDS,
    delay: str = "10 minutes",
) -> DataFrame:
    """``key, address, event_id, allowed, retry_after, refused_by`` for a stream with ``event_id`` and ``ts`` (time without zone, read as UTC).

    A key's budget comes first; what it lets through counts against the budget of its address, which the second operator keeps by the same event
    times. Events without an address, or all where ``address`` is None, have the first budget only.
    """
    place = F.lit(None).cast("string") if address is None else F.col(address).cast("string")
    timed = events.select(
        F.col(key).cast("string").alias("key"), place.alias("address"), "event_id", instant_of(F.col("ts")).alias("ts"),
        F.lit(True).alias("asks"), F.lit(True).alias("allowed"), F.lit(0).alias("retry_after"), F.lit(None).cast("string").alias("refused_by"),
    )
    first = timed.withColumn("ts_us", F.unix_micros("ts")).withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(
        Budget(key_limit, window_seconds, "key"), BUDGET_SCHEMA, "Append", "EventTime", eventTimeColumnName="ts"
    )
    # rows that ask for nothing more are spread by their key, so that no group gathers them
    asks = F.col("allowed") & F.col("address").isNotNull()
    owner = F.when(asks, F.concat(F.lit("="), "address")).otherwise(F.concat(F.lit("-"), F.coalesce("key", F.lit(""))))
    second = first.withColumns({"asks": asks, "owner": owner}).groupBy("owner").transformWithStateInPandas(
        Budget(address_limit, window_seconds, "address"), BUDGET_SCHEMA, "Append", "EventTime", eventTimeColumnName="ts"
    )
    return second.select("key", "address", "event_id", "allowed", "retry_after", "refused_by")


def transition_check(records: DataFrame, delay: str = "10 minutes", keep_seconds: int | None = None) -> DataFrame:
    """Illegal moves and late records of an arriving ledger: ``project_id, change_id, sequence, status, ts, end_mark``.

    ``ts`` is when a record was written (time without zone, read as UTC); ``delay`` is how much later than younger records it may arrive. ``end_mark``
    is true on rows that only move the clock (``windows.run_timed_to_end`` writes one).
    """
    timed = records.select(
        F.coalesce("project_id", F.lit("")).alias("project_id"), F.coalesce("change_id", F.lit("")).alias("change_id"), "sequence", "status",
        instant_of(F.col("ts")).alias("ts"), F.coalesce("end_mark", F.lit(False)).alias("end_mark"),
    ).withColumn("ts_us", F.unix_micros("ts"))
    # without the time column rows older than the watermark still arrive, to be told as late
    clocked = timed.withWatermark("ts", delay).select("project_id", "change_id", "sequence", "status", "ts_us", "end_mark")
    return clocked.groupBy("project_id", "change_id").transformWithStateInPandas(
        Transitions(keep_seconds), MOVE_SCHEMA, "Append", "EventTime"
    )
