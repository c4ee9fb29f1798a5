"""Keyed state against a replay in plain Python, however the input was split into triggers."""

import datetime as dt
import os
import random

import pandas as pd
import pytest

from searchloom.operators.ledger import LEGAL_MOVES
from searchloom.streaming import stateful, windows

START = dt.datetime(2024, 1, 1)
MOVES = "project_id string, change_id string, sequence bigint, status string, ts timestamp_ntz"


def files(spark, folder, parts, schema):
    """One file a trigger, in the order of ``parts``."""
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/{k:03}")
        # the file source takes files by their time of change
        for path in (folder / f"{k:03}").glob("*.parquet"):
            path.rename(folder / f"part-{k:03}.parquet")
            (folder / f"part-{k:03}.parquet").touch()
            stamp = 1_700_000_000 + k
            os.utime(folder / f"part-{k:03}.parquet", (stamp, stamp))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "part-*.parquet").parquet(str(folder))


def batch(records):
    out, last = set(), {}
    for p, c, seq, status, _ in sorted(records, key=lambda r: r[2]):
        before = last.get((p, c))
        if before is None:
            issue = None if status == "planned" else "first_status_not_planned"
        else:
            issue = None if status in LEGAL_MOVES.get(before, ()) else "transition_not_allowed"
        if issue:
            out.add((p, c, seq, before, status, issue))
        last[(p, c)] = status
    return out


def moves(count=60, seed=1):
    rng = random.Random(seed)
    names = ["planned", "implemented", "artifact_verified", "outcome_pending", "reviewed", "cancelled"]
    return [("p", f"c{rng.randrange(5)}", n, rng.choice(names), START + dt.timedelta(minutes=n)) for n in range(count)]


@pytest.mark.parametrize("split", ["one", "four in disorder", "single records in disorder"])
def test_ledger_in_any_split_gives_the_batch_result(spark, tmp_path, split):
    records = moves(60 if split != "single records in disorder" else 14)
    size = {"one": 60, "four in disorder": 15, "single records in disorder": 1}[split]
    order = list(records)
    random.Random(5).shuffle(order)
    parts = [order[k : k + size] for k in range(0, len(order), size)]
    stream = files(spark, tmp_path, parts, MOVES)
    got = windows.run_timed_to_end(stream, lambda s: stateful.transition_check(s, delay="2 hours"), "moves").collect()
    assert {tuple(r) for r in got} == batch(records) and len(got) == len(batch(records))


def test_late_and_repeated_records_are_named(spark, tmp_path):
    at = lambda n: START + dt.timedelta(minutes=n)
    parts = [
        [("p", "c", 1, "planned", at(1)), ("p", "c", 3, "artifact_verified", at(3)), ("p", "c", 3, "implemented", at(3)), ("p", "d", 9, "planned", at(4))],
        [("p", "z", 50, "planned", at(600))],
        # the clock of the trigger before holds from here on
        [("p", "z", 51, "implemented", at(601))],
        [("p", "c", 2, "implemented", at(2)), ("p", "c", 4, "cancelled", at(601)), ("p", "d", 10, "implemented", at(602))],
    ]
    got = windows.run_timed_to_end(files(spark, tmp_path, parts, MOVES), lambda s: stateful.transition_check(s, delay="1 minute"), "late").collect()
    assert {tuple(r) for r in got} == {
        ("p", "c", 3, "planned", "artifact_verified", "transition_not_allowed"), ("p", "c", 3, "artifact_verified", "implemented", "repeated_sequence"),
        ("p", "c", 2, None, "implemented", "late_record"), ("p", "c", 4, "artifact_verified", "cancelled", "transition_not_allowed"),
    }


class Store:
    """State in memory that counts the messages to it."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def __getattr__(self, name):
        def call(value=None, *more):
            self.calls += 1
            if name == "get":
                return iter(self.rows) if self.many else self.value
            if name == "appendList":
                self.rows += value
            elif name == "clear":
                self.rows, self.value = [], None
            elif name == "update":
                self.value = value
            elif name in ("updateValue", "removeKey", "iterator", "exists"):
                raise AssertionError(f"a message for each record: {name}")

        return call


def test_records_of_a_change_go_to_the_store_together():
    names = ["planned", "implemented", "artifact_verified", "cancelled"]
    rows = [(n, names[n % 4], n * 1000, False) for n in range(30_000)]
    order = random.Random(3).sample(rows, len(rows)) + rows[:50]
    frames = [pd.DataFrame(order[k : k + 4000], columns=["sequence", "status", "ts_us", "end_mark"]) for k in range(0, len(order), 4000)]
    task = stateful.Transitions()
    task.last, task.waiting, task.handle = Store(), Store(), Store()
    task.last.many, task.last.value, task.waiting.many = False, None, True

    class Clock:
        getCurrentWatermarkInMs = staticmethod(lambda: 20_000)

    assert not list(task.handleInputRows(("p", "c"), iter(frames), Clock))
    found = pd.concat(task.handleExpiredTimer(("p", "c"), Clock, None))
    assert set(found.itertuples(index=False, name=None)) == batch([("p", "c", n, status, None) for n, status, _, _ in rows[:20_000]])
    assert task.waiting.rows == [r[:3] for r in rows[20_000:]]
    assert task.last.calls + task.waiting.calls + task.handle.calls < 20


def replay(events, key_limit, address_limit, span):
    """What the two budgets say, event by event in time order."""
    state, out = {}, {}

    def consume(name, limit, at):
        reset, used = state.get(name, (None, 0))
        if reset is None or reset <= at:
            reset, used = at + dt.timedelta(seconds=span), 0
        if used >= limit:
            state[name] = (reset, used)
            return max(1, -((at - reset) // dt.timedelta(seconds=1)))
        state[name] = (reset, used + 1)
        return 0

    for key, address, event_id, at in sorted(events, key=lambda e: (e[3], e[2])):
        wait, by = consume(("key", key), key_limit, at), "key"
        if not wait and address is not None:
            wait, by = consume(("address", address), address_limit, at), "address"
        out[event_id] = (not wait, wait, by if wait else None)
    return out


@pytest.mark.parametrize("triggers", [1, 3])
def test_two_budgets(spark, tmp_path, triggers):
    rng = random.Random(4)
    events = [(rng.choice("abcd"), rng.choice(["x", "y", None]), n, START + dt.timedelta(seconds=n * 5 + rng.randrange(4))) for n in range(150)]
    size = len(events) // triggers
    parts = [events[k : k + size] for k in range(0, len(events), size)]
    for part in parts:
        rng.shuffle(part)
    stream = files(spark, tmp_path, parts, "who string, place string, event_id bigint, ts timestamp_ntz")
    got = windows.run_to_end(stateful.request_budget(stream, "who", "place", 3, 5, 60), "budgets").collect()
    want = replay(events, 3, 5, 60)
    assert {r["event_id"]: (r["allowed"], r["retry_after"], r["refused_by"]) for r in got} == want and len(got) == len(events)
    assert {w[2] for w in want.values()} == {None, "key", "address"}


def test_the_session_keeps_its_state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with windows.keyed_state(spark):
        assert spark.conf.get(name) == windows.ROCKSDB
    assert spark.conf.get(name, None) == before
