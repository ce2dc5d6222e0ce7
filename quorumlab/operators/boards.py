"""Ranked boards over scores and community activity.

Boards first rank inside a venue and keep a fixed number of rows of each, so that the global order only
sees that remnant; counts are joined to it afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlab.functions import text as T
from quorumlab.operators import scoring

NOISE = (
    "author-reviewer discussion", "we are currently in the author", "dear authors", "thank you for your helpful",
    "thank you again for your helpful", "thank you for trying", "we are delighted", "our responses", "updating the manuscript",
    "we will definitely", "we will update", "final state of the manuscript", "updating updating",
    "my concern has been addressed", "we sincerely thank", "thank you for the comments", "thank you for your comments",
)
RECUSAL = (
    "find another reviewer and disregard", "disregard my comments", "disregard my review",
    "unable to provide a meaningful review", "cannot provide a meaningful review", "outside my expertise",
    "out of my expertise", "not be able to perform my reviews", "will not be able to perform my reviews",
    "unable to perform my reviews", "kill a granny",
)
CONTRADICTIONS = (
    "not informative", "non-informative", "insufficient review", "no substantive", "not a substantive", "no actionable",
    "unhelpful", "low usefulness", "mostly summary", "uninformative summary", "too summary-like", "too vague",
)
#: Board name, metric column, ascending.
BOARDS = (("overall", "attention", False), ("toxic", "toxicity", False), ("helpful", "helpfulness", False), ("red", "score", False), ("black", "score", True))


def with_metrics(rows: DataFrame) -> DataFrame:
    """attention and score beside outrage, toxicity and helpfulness."""
    o, t, h = F.col("outrage"), F.col("toxicity"), F.col("helpfulness")
    score = F.bround(F.round(0.75 * h + 0.15 * (100 - o) + 0.10 * (100 - t), 6), 0).cast("int")
    return rows.withColumns({"attention": scoring.attention(o, h, t), "score": score})


def eligible(metric: Column) -> Column:
    """Whether a row may be shown on the board of a metric."""
    text = F.lower(F.coalesce("quote", F.lit("")))
    shown = (F.trim(text) != "") & ~T.any_word(text, NOISE) & ~T.any_word(text, RECUSAL)
    helpful = (F.col("helpfulness") >= 55) & (F.col("toxicity") <= 35) & ~T.any_word(text, CONTRADICTIONS)
    return shown & ((metric != "helpfulness") | helpful)


def venue_balanced(ranked: DataFrame, limit: int) -> DataFrame:
    """Round robin over venues in first-seen order up to a cap for each, then the rest in order.

    ``ranked``: board, venue, pos (1-based). Adds place, 1 to ``limit``.
    """
    venue = Window.partitionBy("board", "venue")
    rows = ranked.withColumns({"idx": F.row_number().over(venue.orderBy("pos")), "lead": F.min("pos").over(venue)})
    venues = ranked.groupBy("board").agg(F.countDistinct("venue").alias("venues"))
    rows = rows.join(venues, "board")
    cap = F.when(F.col("venues") <= 1, limit).otherwise(F.greatest(F.lit(2), F.ceil(F.lit(limit) / F.least(F.col("venues"), F.lit(limit)))))
    first = F.when(F.col("idx") <= cap, 0).otherwise(1)
    order = Window.partitionBy("board").orderBy("tier", F.when(F.col("tier") == 0, F.col("idx")).otherwise(F.col("pos")), "lead")
    return rows.withColumn("tier", first).withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= limit)


def leaderboards(scores: DataFrame, limit: int = 10) -> DataFrame:
    """Five boards: candidates per venue, display filter, then venue balance."""
    boards = F.array(*(F.struct(F.lit(n).alias("board"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(-1 if asc else 1).alias("sign")) for n, m, asc in BOARDS))
    rows = with_metrics(scores).withColumn("b", F.explode(boards)).select("*", "b.*").drop("b")
    key = F.when(F.col("sign") == 1, F.col("reviewer_key")), F.when(F.col("sign") == -1, F.col("reviewer_key"))
    order = [(F.col("value") * F.col("sign")).desc(), key[0].desc(), key[1].asc(), (F.col("row_id") * F.col("sign")).desc()]
    cut = rows.withColumn("rn", F.row_number().over(Window.partitionBy("board", "venue").orderBy(*order))).where(F.col("rn") <= max(4 * limit, 40))
    shown = cut.where(eligible(F.col("metric")))
    by_venue = Window.partitionBy("board").orderBy("venue", "rn")
    return venue_balanced(shown.withColumn("pos", F.row_number().over(by_venue)), limit)


def wilson(positive: Column, total: Column, z: float = 1.96) -> Column:
    """Lower bound of the share of positive votes."""
    n, p = total.cast("double"), positive / total
    bound = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    return F.when(total > 0, F.round(bound, 6)).otherwise(0.0)


def live_votes(activity: DataFrame) -> DataFrame:
    """The last vote of each (paper, reviewer, session); withdrawn votes are gone."""
    votes = activity.where(F.col("action").startswith("vote"))
    last = votes.groupBy("paper_id", "reviewer_key", "session_id").agg(F.max(F.struct("ts", "event_id", "action")).alias("v"))
    return last.select("paper_id", "reviewer_key", "session_id", "v.action").where("action <> 'vote_none'")


def vote_counts(activity: DataFrame) -> DataFrame:
    up, down = F.count_if(F.col("action") == "vote_up"), F.count_if(F.col("action") == "vote_down")
    return live_votes(activity).groupBy("paper_id", "reviewer_key").agg(up.alias("up"), down.alias("down"))


def community_counts(activity: DataFrame) -> DataFrame:
    """Live votes, comments and reactions of each (paper, reviewer)."""
    talk = activity.groupBy("paper_id", "reviewer_key").agg(F.count_if(F.col("action") == "comment").alias("comments"), F.count_if(F.col("action") == "reaction").alias("reactions"))
    out = talk.join(vote_counts(activity), ["paper_id", "reviewer_key"], "left")
    return out.withColumns({k: F.coalesce(k, F.lit(0)) for k in ("up", "down")})


def recent_activity(activity: DataFrame, hours: int = 48) -> DataFrame:
    """Commenters, comments, votes and reactions in the last hours before the newest event."""
    newest = activity.agg(F.max("ts").alias("now")).first()["now"]
    recent = activity.where(F.col("ts") >= F.lit(newest) - F.expr(f"interval {hours} hours"))
    comment = F.col("action") == "comment"
    return recent.groupBy("paper_id", "reviewer_key").agg(
        F.countDistinct(F.when(comment, F.col("session_id"))).alias("commenters"),
        F.count_if(comment).alias("comments"),
        F.count_if(F.col("action").startswith("vote")).alias("votes"),
        F.count_if(F.col("action") == "reaction").alias("reactions"),
    )


def outrage_candidates(scores: DataFrame, reviews: DataFrame, seed: int = 55) -> DataFrame:
    """Newest row of each (paper, reviewer) with an official review and enough outrage, then the display filter."""
    newest = scores.groupBy("paper_id", "reviewer_key").agg(F.max(F.struct("row_id", *(c for c in scores.columns if c not in ("paper_id", "reviewer_key", "row_id")))).alias("s"))
    rows = newest.select("paper_id", "reviewer_key", "s.*").where(F.col("outrage") >= seed)
    return rows.join(reviews, ["paper_id", "reviewer_key"], "left_semi").where(eligible(F.lit("outrage")))


def top(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows by an order, with their place; the cut is made before the numbering."""
    return rows.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def all_time(candidates: DataFrame, votes: DataFrame, limit: int = 12) -> DataFrame:
    """Rows of five votes or more by their Wilson bound; the rest fill up by seed."""
    rows = candidates.join(votes, ["paper_id", "reviewer_key"], "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("up", "down")})
    total = F.col("up") + F.col("down")
    rows = rows.withColumns({"total": total, "bound": wilson(F.col("up"), total)})
    warm = F.col("total") >= 5
    rows = rows.withColumn("cold_start", ~warm)
    order = [F.col("cold_start"), F.when(warm, F.col("bound")).otherwise(F.col("outrage")).desc(), F.when(warm, F.col("total")).desc(), F.col("row_id").desc()]
    return top(rows, order, limit)


def hot(candidates: DataFrame, votes: DataFrame, recent: DataFrame, limit: int = 12) -> DataFrame:
    """Threads with two commenters or three comments lately, by activity and controversy."""
    rows = candidates.join(recent, ["paper_id", "reviewer_key"]).where("commenters >= 2 or comments >= 3")
    rows = rows.join(votes, ["paper_id", "reviewer_key"], "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("up", "down")})
    total = F.col("up") + F.col("down")
    controversy = F.least(F.lit(10), total) * (1 - F.abs(F.col("up") - F.col("down")) / F.greatest(F.lit(1), total))
    score = F.round(4 * F.col("commenters") + 2 * F.col("comments") + F.col("votes") + F.col("reactions") + controversy, 6)
    rows = rows.withColumn("hot_score", score)
    return top(rows, [F.desc("hot_score"), F.desc("row_id")], limit)


def rate_limited(activity: DataFrame, limits: dict[str, int], seconds: int = 3600) -> DataFrame:
    """Actions that exceed their session's limit in the trailing window."""
    kind = F.when(F.col("action").startswith("vote"), "vote").otherwise(F.col("action"))
    rows = activity.withColumns({"kind": kind, "at": F.unix_micros(F.col("ts").cast("timestamp"))})
    trailing = Window.partitionBy("session_id", "kind").orderBy("at").rangeBetween(-seconds * 1_000_000, 0)
    rows = rows.withColumn("n", F.count(F.lit(1)).over(trailing))
    allowed = F.coalesce(F.try_element_at(T.map_of(limits), F.col("kind")), F.lit(1 << 30))
    return rows.where(F.col("n") > allowed)
