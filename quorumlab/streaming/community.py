"""Streams of community events: live votes and reactions, sliding activity and rate limits.

Late events are dropped by the watermark; the batch forms give the exact answers over a whole log. State is kept by
``transformWithState`` processors: values and event-time timers that end them, in the RocksDB state store. Keys are dealt
by hash to groups, whose rows Python works on as columns: calls to the state store count by groups, not by keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEYS = ["paper_id", "reviewer_key", "session_id"]
CHOICES = "paper_id string, reviewer_key string, session_id string, choice string, event_id bigint, ts timestamp"
EXCEEDED = "session_id string, kind string, event_id bigint, ts timestamp, n bigint"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Keys are dealt to so many groups; a group's keys are one state, which is read, merged and written as a whole.
GROUPS = 512
CHOICE_STATE = pa.schema([*((k, pa.string()) for k in KEYS), ("choice", pa.string()), ("event_id", pa.int64()), ("at", pa.int64())])
EVENT_STATE = pa.schema([("session_id", pa.string()), ("kind", pa.string()), ("event_id", pa.int64()), ("at", pa.int64()), ("told", pa.bool_())])


def micros(stamps: pd.Series) -> np.ndarray:
    return stamps.astype("datetime64[us]").astype("int64").to_numpy()


def packed(rows: pd.DataFrame, schema: pa.Schema) -> tuple[bytes]:
    """The rows of a group as the value of its state."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as writer:
        writer.write_table(pa.Table.from_pandas(rows, schema, preserve_index=False))
    return (sink.getvalue().to_pybytes(),)


def unpacked(state, schema: pa.Schema) -> pd.DataFrame:
    found = state.get()
    return (pa.ipc.open_stream(found[0]).read_all() if found else schema.empty_table()).to_pandas()


class Newest(StatefulProcessor):
    """The newest choice of each key of a group as a value state; a timer ends a choice ``keep_ms`` after its event."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "rows binary")

    def keep(self, rows: pd.DataFrame) -> None:
        """Hold the rows until the first of them ends."""
        self.newest.update(packed(rows, CHOICE_STATE))
        self.handle.registerTimer(int(rows["at"].min()) // 1000 + self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = unpacked(self.newest, CHOICE_STATE)
        came = pd.concat([part[[*KEYS, "choice", "event_id"]].assign(at=micros(part["ts"])) for part in rows])
        both = pd.concat([came.iloc[::-1].assign(new=True), before.assign(new=False)], ignore_index=True)  # of equals the earlier row stays
        now = both.sort_values(["at", "event_id"]).drop_duplicates(KEYS, keep="last")
        changed = now[now["new"].astype(bool)]
        if changed.empty:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.keep(now.drop(columns="new"))
        yield changed[[*KEYS, "choice", "event_id"]].assign(ts=pd.to_datetime(changed["at"], unit="us"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = unpacked(self.newest, CHOICE_STATE)
        rows = rows[rows["at"] // 1000 + self.keep_ms > timerValues.getCurrentWatermarkInMs()]
        if rows.empty:
            self.newest.clear()
        else:
            self.keep(rows)
        return iter(())

    def close(self) -> None:
        pass


class Trailing(StatefulProcessor):
    """Events that exceed the limit of their (session, kind) in the time before them, counted exactly.

    The events of a group's keys wait until the watermark has passed them, so those that come in another order count too;
    a group holds no more than the events of the window and of the allowed lateness, and none when both have passed."""

    def __init__(self, limits: dict[str, int], window_ms: int) -> None:
        self.limits, self.window = limits, window_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getValueState("events", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat([part[["session_id", "kind", "event_id"]].assign(at=micros(part["ts"]), told=False) for part in rows])
        came = came[came["kind"].isin(list(self.limits))]
        if len(came):
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.wait(pd.concat([unpacked(self.events, EVENT_STATE), came], ignore_index=True))
        return
        yield

    def wait(self, events: pd.DataFrame) -> None:
        """Hold the events until the first untold one has passed, or until all have left the window."""
        self.events.update(packed(events, EVENT_STATE))
        told = events["told"].to_numpy(bool)
        at = events["at"].to_numpy()
        self.handle.registerTimer(int(at.max() + self.window if told.all() else at[~told].min()) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = unpacked(self.events, EVENT_STATE)
        code = events.groupby(["session_id", "kind"], dropna=False, sort=False).ngroup().to_numpy()
        order = np.lexsort((events["event_id"].to_numpy(), events["at"].to_numpy(), code))
        events, code = events.iloc[order], code[order]
        at, told = events["at"].to_numpy(), events["told"].to_numpy(bool)
        n = np.zeros(len(at), np.int64)
        ends = np.append(np.flatnonzero(code[1:] != code[:-1]) + 1, len(code)).tolist()
        for first, end in zip([0, *ends[:-1]], ends, strict=True):
            own = at[first:end]
            n[first:end] = np.searchsorted(own, own, "right") - np.searchsorted(own, own - self.window, "left")
        due = ~told & (at < passed)
        over = due & (n > events["kind"].map(self.limits).to_numpy())
        events = events.assign(told=told | due)
        kept = events[~(told | due) | (at >= passed - self.window)]
        if len(kept):
            self.wait(kept)
        else:
            self.events.clear()
        if over.any():
            yield events.loc[over, ["session_id", "kind", "event_id"]].assign(ts=pd.to_datetime(at[over], unit="us"), n=n[over])

    def close(self) -> None:
        pass


def days_in_ms(span: str) -> int:
    return int(span.split()[0]) * 86_400_000


def live_choices(events: DataFrame, keep: str = "30 days", late: str = "1 day", groups: int = GROUPS) -> DataFrame:
    """Every change of the live choice (a vote or a reaction) of each (paper, reviewer, session).

    ``events``: the keys, choice, event_id, ts. A withdrawn choice comes as the choice that withdraws it. The state of a
    key is its newest event and ends ``keep`` after it. The live keys of one of ``groups`` are in memory together."""
    dealt = F.pmod(F.xxhash64(*KEYS), F.lit(groups)).alias("dealt")
    keyed = events.select(*KEYS, "choice", "event_id", "ts", dealt).withWatermark("ts", late).groupBy("dealt")
    return keyed.transformWithStateInPandas(Newest(days_in_ms(keep)), CHOICES, "Update", "EventTime")


def vote_state(events: DataFrame, keep: str = "30 days", late: str = "1 day", groups: int = GROUPS) -> DataFrame:
    """Changes of live votes; ``events`` have an action, of which those that begin with ``vote`` count."""
    return live_choices(events.where(F.col("action").startswith("vote")).withColumn("choice", F.col("action")), keep, late, groups)


def reaction_state(events: DataFrame, emoji: Column, keep: str = "30 days", late: str = "1 day", groups: int = GROUPS) -> DataFrame:
    """Changes of live reactions: another emoji replaces the one before, ``none`` takes it back."""
    return live_choices(events.where(F.col("action") == "reaction").withColumn("choice", emoji), keep, late, groups)


def over_limit(events: DataFrame, limits: dict[str, int], seconds: int = 3600, late: str = "10 minutes", groups: int = GROUPS) -> DataFrame:
    """(session, kind, event, n): the actions that exceed the limit of their kind in the ``seconds`` before them, as the
    batch form counts them, each told once the watermark has passed it."""
    kind = F.when(F.col("action").startswith("vote"), "vote").otherwise(F.col("action"))
    dealt = F.pmod(F.xxhash64("session_id", kind), F.lit(groups)).alias("dealt")
    keyed = events.select("session_id", kind.alias("kind"), "event_id", "ts", dealt).withWatermark("ts", late).groupBy("dealt")
    return keyed.transformWithStateInPandas(Trailing(limits, seconds * 1000), EXCEEDED, "Append", "EventTime")


def activity_panes(events: DataFrame, pane: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Comments, votes, reactions and a sketch of the commenters of each (paper, reviewer) and pane: one row a pane.

    An event goes to one pane, whatever windows are asked for later; ``windows_of`` merges panes."""
    comment = F.col("action") == "comment"
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", pane), "paper_id", "reviewer_key")
        .agg(
            F.hll_sketch_agg(F.when(comment, F.col("session_id"))).alias("sketch"),
            F.count_if(comment).alias("comments"),
            F.count_if(F.col("action").startswith("vote")).alias("votes"),
            F.count_if(F.col("action") == "reaction").alias("reactions"),
        )
        .select(F.col("window.start").alias("pane"), "paper_id", "reviewer_key", "sketch", "comments", "votes", "reactions")
    )


def windows_of(panes: DataFrame, panes_each: int = 48, pane_seconds: int = 3600) -> DataFrame:
    """Sliding windows of ``panes_each`` panes, one step a pane: exact counts and commenters within the sketch's error.

    Pane rows, not events, multiply; sketches merge as unions, so a commenter of several panes counts once."""
    steps = F.sequence(F.lit(1), F.lit(panes_each))
    ends = panes.withColumn("until", F.explode(F.transform(steps, lambda i: F.timestamp_seconds(F.unix_seconds("pane") + i * pane_seconds))))
    sums = [F.sum(c).alias(c) for c in ("comments", "votes", "reactions")]
    return ends.groupBy("until", "paper_id", "reviewer_key").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("commenters"), *sums)


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process what the source holds now, into Parquet under ``path``, and return it.

    Each micro-batch is one folder, written anew if the batch is replayed after a failure; its number stays in
    the rows as ``batch``.
    """
    spark = stream.sparkSession
    out = f"{path}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    kept = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)  # what processors with several states and timers need
    try:
        query = writer.foreachBatch(put).start()
    finally:
        spark.conf.set(PROVIDER, kept)
    query.awaitTermination()
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch int").parquet(out)


