"""Streaming queries: the events table read as a file stream, processed to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlab.plans import board_plans  # noqa: F401  (its stand-ins)
from quorumlab.plans import standins as S
from quorumlab.plans.registry import query
from quorumlab.sources.files import shared_folder
from quorumlab.streaming import community


def _events(spark: SparkSession, d: str, one_by_one: bool = True) -> DataFrame:
    """The activity of the events table as a stream of files, which a source may take in any order.

    One by one, a file that comes late by more than the watermark loses its rows; all at once, none does.
    """
    folder = shared_folder(spark, "activity")
    rows = S.view(spark, d, "v_activity").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(folder)
    reader = spark.readStream.schema(rows.schema)
    return (reader.option("maxFilesPerTrigger", 1) if one_by_one else reader).parquet(folder)


def _last(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*community.KEYS).agg(F.max(F.struct("ts", "event_id", "choice"))["choice"].alias("choice"))


@query(S.sql("SELECT paper_id, reviewer_key, session_id, action FROM live", "live"))
def vote_state_stream(spark: SparkSession, d: str) -> DataFrame:
    """The last change of each key's vote; withdrawn votes are gone."""
    changes = community.run_available(community.vote_state(_events(spark, d), late="40 days"), shared_folder(spark, "votes"), "update")
    return _last(changes).where("choice <> 'vote_none'").withColumnRenamed("choice", "action")


@query(
    S.sql(
        """SELECT paper_id, reviewer_key, session_id, emoji FROM (SELECT *, ['laugh', 'none', 'fire', 'clap'][CAST(floor(value * 10) AS BIGINT) % 4 + 1] AS emoji,
row_number() OVER (PARTITION BY paper_id, reviewer_key, session_id ORDER BY ts DESC, event_id DESC) AS rn FROM v_activity WHERE action = 'reaction') WHERE rn = 1 AND emoji <> 'none'""",
        "v_activity",
    )
)
def reaction_state_stream(spark: SparkSession, d: str) -> DataFrame:
    """The last reaction of each key; those taken back are gone."""
    emoji = F.element_at(F.array(*map(F.lit, ("laugh", "none", "fire", "clap"))), (F.floor(F.col("value") * 10) % 4 + 1).cast("int"))
    changes = community.run_available(community.reaction_state(_events(spark, d), emoji, late="40 days"), shared_folder(spark, "reactions"), "update")
    return _last(changes).where("choice <> 'none'").withColumnRenamed("choice", "emoji")


@query(
    S.sql(
        """SELECT make_timestamp(stop * 1000000) AS until, paper_id, reviewer_key, CAST(sum(comments) AS BIGINT) AS comments, CAST(sum(votes) AS BIGINT) AS votes, CAST(sum(reactions) AS BIGINT) AS reactions
FROM (SELECT unnest(range(pane + 1, pane + 49)) * 3600 AS stop, * FROM (
  SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS pane, paper_id, reviewer_key, count(*) FILTER (action = 'comment') AS comments, count(*) FILTER (starts_with(action, 'vote')) AS votes, count(*) FILTER (action = 'reaction') AS reactions FROM v_activity GROUP BY ALL)
  WHERE (pane + 1) * 3600 <= (SELECT max(epoch(ts)) - 7200 FROM v_activity)) GROUP BY stop, paper_id, reviewer_key HAVING sum(comments + votes + reactions) >= 2""",
        "v_activity",
    )
)
def activity_48h_stream(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows of 48 hours with two events or more, merged from closed hourly panes."""
    panes = community.run_available(community.activity_panes(_events(spark, d, one_by_one=False)), shared_folder(spark, "activity-panes"), "append")
    found = community.windows_of(panes).where("comments + votes + reactions >= 2")
    return found.select(F.col("until").cast("timestamp_ntz").alias("until"), "paper_id", "reviewer_key", "comments", "votes", "reactions")


@query(
    S.sql(
        """SELECT session_id, kind, event_id, n FROM (SELECT *, count(*) OVER (PARTITION BY session_id, kind ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, CASE WHEN prefix(action, 'vote') THEN 'vote' ELSE action END AS kind FROM v_activity))
WHERE n > CASE kind WHEN 'vote' THEN 3 WHEN 'reaction' THEN 2 WHEN 'comment' THEN 1 END AND epoch_us(ts) < (SELECT floor(max(epoch_us(ts)) / 1000) * 1000 - 600000000 FROM v_activity)""",
        "v_activity",
    )
)
def rate_limit_stream(spark: SparkSession, d: str) -> DataFrame:
    """Actions over their session's limit in the hour before them, up to ten minutes before the newest event."""
    stream = community.over_limit(_events(spark, d, one_by_one=False), {"vote": 3, "reaction": 2, "comment": 1})
    return community.run_available(stream, shared_folder(spark, "limits")).select("session_id", "kind", "event_id", "n")
