"""Stateful streams against what a batch over the whole log says."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quorumlab.operators import boards
from quorumlab.sources.files import shared_folder
from quorumlab.streaming import community

EVENT = "event_id bigint, ts timestamp, session_id string, paper_id string, reviewer_key string, action string"
START = dt.datetime(2024, 3, 1)


def stream_of(spark, batches):
    folder = shared_folder(spark, "test-events")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/batch={i}")
    reader = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    return reader.parquet(folder)


@pytest.fixture(scope="module")
def log():
    rng = random.Random(4)
    rows = []
    for i in range(600):
        at = START + dt.timedelta(seconds=rng.randint(0, 12 * 3600), microseconds=rng.randint(0, 999_999))
        rows.append((i, at, f"s{rng.randint(0, 5)}", f"p{rng.randint(0, 1)}", "R1", rng.choice(["vote_up", "vote_down", "vote_none", "comment", "reaction", "other"])))
    return sorted(rows, key=lambda r: r[1]), rng


def test_trailing_limits_equal_the_batch_form(spark, log):
    rows, rng = log
    batches = [rows[i : i + 150] for i in range(0, 600, 150)]
    for b in batches:
        rng.shuffle(b)
    limits = {"vote": 3, "reaction": 2, "comment": 1}
    found = community.run_available(community.over_limit(stream_of(spark, batches), limits, late="1 minutes"), shared_folder(spark, "test-limits"))
    found = {(r["event_id"], r["kind"], r["n"]) for r in found.collect()}
    closed = rows[-1][1].replace(microsecond=rows[-1][1].microsecond // 1000 * 1000) - dt.timedelta(minutes=1)
    batch = boards.rate_limited(spark.createDataFrame(rows, EVENT), limits).where(F.col("ts") < F.lit(closed))
    expected = {(r["event_id"], r["kind"], r["n"]) for r in batch.collect()}
    assert found == expected and len(expected) > 50


def test_choices_are_replaced_and_taken_back(spark, log):
    rows, _ = log
    batches = [rows[i : i + 200] for i in range(0, 600, 200)]
    votes = community.run_available(community.vote_state(stream_of(spark, batches)), shared_folder(spark, "test-votes"), "update")
    last = votes.groupBy(*community.KEYS).agg(F.max(F.struct("ts", "event_id", "choice"))["choice"].alias("action")).where("action <> 'vote_none'")
    batch = boards.live_votes(spark.createDataFrame(rows, EVENT))
    key = lambda df: sorted((r["paper_id"], r["reviewer_key"], r["session_id"], r["action"]) for r in df.collect())
    assert key(last) == key(batch)


def test_state_ends_after_its_time(spark):
    day = dt.timedelta(days=1)
    event = lambda i, days, session, action: (i, START + day * days, session, "p", "R1", action)
    # the vote of the first day is forgotten when an older one of its key comes after a long time: it counts as new
    batches = [[event(0, 0, "a", "vote_up")], [event(1, 20, "b", "vote_up")], [event(2, 21, "b", "vote_down")], [event(3, 20, "a", "vote_down")], [event(4, 22, "b", "vote_none")]]
    changes = community.run_available(community.vote_state(stream_of(spark, batches), keep="5 days", late="2 days"), shared_folder(spark, "test-ends"), "update")
    assert [(r["session_id"], r["choice"]) for r in changes.orderBy("event_id").collect()] == [("a", "vote_up"), ("b", "vote_up"), ("b", "vote_down"), ("a", "vote_down"), ("b", "vote_none")]


def test_panes_merge_into_windows(spark, log):
    rows, _ = log
    tail = [(10_000, START + dt.timedelta(hours=30), "s", "p9", "R1", "other")]
    panes = community.run_available(community.activity_panes(stream_of(spark, [rows, tail])), shared_folder(spark, "test-panes"))
    assert panes.count() == len({(r[3], r[1].hour) for r in rows})
    found = {(r["until"], r["paper_id"]): r for r in community.windows_of(panes, 5).collect()}
    for hour in (3, 5, 12, 16):
        until = START + dt.timedelta(hours=hour)
        for paper in ("p0", "p1"):
            own = [r for r in rows if r[3] == paper and until - dt.timedelta(hours=5) <= r[1] < until]
            got = found[until, paper]
            assert (got["comments"], got["votes"], got["reactions"]) == tuple(sum(r[5].startswith(a) for r in own) for a in ("comment", "vote", "reaction"))
            exact = len({r[2] for r in own if r[5] == "comment"})
            assert abs(got["commenters"] - exact) <= max(1, 0.05 * exact)


class Calls:
    """A state store that counts what is asked of it."""

    def __init__(self):
        self.n, self.value, self.timers = 0, None, []

    def getValueState(self, *_):
        return self

    getListState = getValueState

    def __getattr__(self, name):
        def call(*given):
            self.n += 1
            if name == "update":
                self.value = given[0]
            elif name == "registerTimer":
                self.timers.append(given[0])
            elif name == "deleteTimer":
                self.timers.remove(given[0])
            return {"get": self.value, "exists": self.value is not None, "listTimers": list(self.timers)}.get(name)

        return call


def rows_of(n, **columns):
    at = pd.Series(pd.Timestamp(START) + pd.to_timedelta(range(n), unit="s"))
    return pd.DataFrame({"paper_id": "p", "reviewer_key": "R1", "session_id": [f"s{i % (n // 2)}" for i in range(n)], "choice": "vote_up", "event_id": range(n), "ts": at, **columns})


def test_calls_of_choices_do_not_grow_with_keys():
    store = Calls()
    newest = community.Newest(5 * 86_400_000)
    newest.init(store)
    changed = pd.concat(newest.handleInputRows((0,), iter([rows_of(4000)]), None))
    assert sorted(changed["event_id"]) == list(range(2000, 4000)) and store.n < 10
    assert not list(newest.handleInputRows((0,), iter([rows_of(4000)]), None)) and len(store.timers) == 1


def test_calls_of_limits_do_not_grow_with_events():
    store = Calls()
    trailing = community.Trailing({"vote": 1}, 3_600_000)
    trailing.init(store)
    assert not list(trailing.handleInputRows((0,), iter([rows_of(4000, kind="vote"), rows_of(4000, kind="other")]), None))
    assert store.n < 10 and len(store.timers) == 1


def test_keys_of_one_group_are_apart(spark, log):
    rows, _ = log
    rows = [*rows, (9000, START + dt.timedelta(hours=14), None, "p0", "R1", "vote_up"), (9001, START + dt.timedelta(hours=14, seconds=1), None, "p0", "R1", "vote_down")]
    batches = [rows[i : i + 301] for i in range(0, 602, 301)]
    votes = community.run_available(community.vote_state(stream_of(spark, batches), groups=1), shared_folder(spark, "test-votes"), "update")
    last = votes.groupBy(*community.KEYS).agg(F.max(F.struct("ts", "event_id", "choice"))["choice"].alias("action")).where("action <> 'vote_none'")
    key = lambda df: sorted((r["paper_id"], r["reviewer_key"], r["session_id"] or "", r["action"]) for r in df.collect())
    assert key(last) == key(boards.live_votes(spark.createDataFrame(rows, EVENT)))
    limits = {"vote": 1, "comment": 1}
    end = [(9100, START + dt.timedelta(days=2), "z", "p0", "R1", "other")]
    found = community.run_available(community.over_limit(stream_of(spark, [rows, end]), limits, groups=1), shared_folder(spark, "test-limits"))
    batch = boards.rate_limited(spark.createDataFrame(rows, EVENT), limits)
    key = lambda df: sorted((r["event_id"], r["session_id"] or "", r["n"]) for r in df.collect())
    assert key(found) == key(batch) and any(r[1] == "" for r in key(found))


def test_each_key_of_a_group_ends_after_its_own_time(spark):
    day = dt.timedelta(days=1)
    event = lambda i, days, session, action: (i, START + day * days, session, "p", "R1", action)
    batches = [[event(0, 0, "a", "vote_up")], [event(1, 4, "b", "vote_up")], [event(2, 9, "c", "vote_up")], [event(3, 10, "c", "vote_none")], [event(4, 11, "b", "vote_down"), event(5, 12, "a", "vote_down")]]
    changes = community.run_available(community.vote_state(stream_of(spark, batches), keep="5 days", late="2 days", groups=1), shared_folder(spark, "test-ends"), "update")
    assert [(r["session_id"], r["choice"]) for r in changes.orderBy("event_id").collect()] == [("a", "vote_up"), ("b", "vote_up"), ("c", "vote_up"), ("c", "vote_none"), ("b", "vote_down"), ("a", "vote_down")]
