"""Queries over scores, votes, comments and scoring jobs."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumlab.operators import boards, search
from quorumlab.plans import standins as S
from quorumlab.plans.registry import query


def _words(low: str, words) -> str:
    return f"len(list_filter({S._list(words)}, lambda w: contains({low}, w))) > 0"


_LOW = "lower(coalesce(quote, ''))"
_SHOWN = f"(trim({_LOW}) <> '' AND NOT ({_words(_LOW, boards.NOISE)}) AND NOT ({_words(_LOW, boards.RECUSAL)}))"
_HELP = f"(helpfulness >= 55 AND toxicity <= 35 AND NOT ({_words(_LOW, boards.CONTRADICTIONS)}))"
S.add_cte(
    "metric",
    "SELECT *, CAST(round_even(round(0.75::DOUBLE * outrage + 0.15::DOUBLE * (100 - helpfulness) + 0.10::DOUBLE * toxicity, 6), 0) AS INTEGER) AS attention, CAST(round_even(round(0.75::DOUBLE * helpfulness + 0.15::DOUBLE * (100 - outrage) + 0.10::DOUBLE * (100 - toxicity), 6), 0) AS INTEGER) AS score FROM v_score",
    "v_score",
)
S.add_cte(
    "boarded",
    "SELECT *, unnest(['overall', 'toxic', 'helpful', 'red', 'black']) AS board, unnest(['attention', 'toxicity', 'helpfulness', 'score', 'score']) AS metric, CAST(unnest([attention, toxicity, helpfulness, score, score]) AS DOUBLE) AS value, unnest([1, 1, 1, 1, -1]) AS sign FROM metric",
    "metric",
)
S.add_cte("board_cut", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY board, venue ORDER BY value * sign DESC, CASE WHEN sign = 1 THEN reviewer_key END DESC NULLS LAST, CASE WHEN sign = -1 THEN reviewer_key END ASC NULLS FIRST, row_id * sign DESC) AS rn FROM boarded) WHERE rn <= 40", "boarded")


def _balanced(source: str, limit: int) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY board ORDER BY tier, CASE WHEN tier = 0 THEN idx ELSE pos END, lead) AS place FROM (
SELECT *, CASE WHEN idx <= CASE WHEN venues <= 1 THEN {limit} ELSE greatest(2, ceil({limit}::DOUBLE / least(venues, {limit}))) END THEN 0 ELSE 1 END AS tier FROM (
SELECT *, row_number() OVER (PARTITION BY board, venue ORDER BY pos) AS idx, min(pos) OVER (PARTITION BY board, venue) AS lead, (SELECT count(DISTINCT venue) FROM {source} x WHERE x.board = {source}.board) AS venues FROM {source}))) WHERE place <= {limit}"""


S.add_cte("board_shown", f"SELECT *, row_number() OVER (PARTITION BY board ORDER BY venue, rn) AS pos FROM board_cut WHERE {_SHOWN} AND (metric <> 'helpfulness' OR {_HELP})", "board_cut")


@query(S.sql(f"SELECT board, place, row_id, venue, value FROM ({_balanced('board_shown', 10)})", "board_shown"))
def leaderboards(spark: SparkSession, d: str) -> DataFrame:
    return boards.leaderboards(S.view(spark, d, "v_score")).select("board", "place", "row_id", "venue", "value")


@query(S.sql(f"SELECT metric, row_id FROM boarded WHERE board <> 'black' AND {_SHOWN} AND (metric <> 'helpfulness' OR {_HELP})", "boarded"))
def display_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = boards.with_metrics(S.view(spark, d, "v_score"))
    rows = rows.withColumn("metric", F.explode(F.array(*map(F.lit, ("attention", "toxicity", "helpfulness", "score")))))
    return rows.where(boards.eligible(F.col("metric"))).select("metric", "row_id")


S.add_cte("by_attention", "SELECT 'all' AS board, venue, row_id, row_number() OVER (ORDER BY attention DESC, row_id) AS pos FROM metric", "metric")


@query(S.sql(f"SELECT place, row_id, venue FROM ({_balanced('by_attention', 25)})", "by_attention"))
def venue_balance(spark: SparkSession, d: str) -> DataFrame:
    """Only the first 25 rows of a venue can be placed, so each venue is cut before the global order."""
    rows = boards.with_metrics(S.view(spark, d, "v_score")).withColumn("board", F.lit("all"))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("venue").orderBy(F.desc("attention"), "row_id"))).where("rn <= 25")
    ranked = rows.withColumn("pos", F.row_number().over(Window.partitionBy("board").orderBy(F.desc("attention"), "row_id")))
    return boards.venue_balanced(ranked, 25).select("place", "row_id", "venue")


S.add_cte("live", "SELECT paper_id, reviewer_key, session_id, action FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, reviewer_key, session_id ORDER BY ts DESC, event_id DESC) AS rn FROM v_activity WHERE prefix(action, 'vote')) WHERE rn = 1 AND action <> 'vote_none'", "v_activity")
S.add_cte("voted", "SELECT paper_id, reviewer_key, count(*) FILTER (action = 'vote_up') AS up, count(*) FILTER (action = 'vote_down') AS down FROM live GROUP BY ALL", "live")
S.add_cte("recent", "SELECT paper_id, reviewer_key, count(DISTINCT session_id) FILTER (action = 'comment') AS commenters, count(*) FILTER (action = 'comment') AS comments, count(*) FILTER (prefix(action, 'vote')) AS votes, count(*) FILTER (action = 'reaction') AS reactions FROM v_activity WHERE ts >= (SELECT max(ts) FROM v_activity) - INTERVAL 48 HOURS GROUP BY ALL", "v_activity")
S.add_cte("candidate", f"SELECT * FROM v_score WHERE outrage >= 55 AND {_SHOWN} AND (paper_id, reviewer_key) IN (SELECT paper_id, concat('R', reviewer_index) FROM v_review)", "v_score", "v_review")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    reviews = S.view(spark, d, "v_review").select("paper_id", F.concat(F.lit("R"), "reviewer_index").alias("reviewer_key"))
    return boards.outrage_candidates(S.view(spark, d, "v_score"), reviews)


@query(S.sql("SELECT * FROM live", "live"))
def vote_state(spark: SparkSession, d: str) -> DataFrame:
    return boards.live_votes(S.view(spark, d, "v_activity"))


@query(S.sql("SELECT paper_id, reviewer_key, count(*) FILTER (action = 'comment') AS comments, count(*) FILTER (action = 'reaction') AS reactions, coalesce(any_value(up), 0) AS up, coalesce(any_value(down), 0) AS down FROM v_activity LEFT JOIN voted USING (paper_id, reviewer_key) GROUP BY paper_id, reviewer_key", "v_activity", "voted"))
def community_counts(spark: SparkSession, d: str) -> DataFrame:
    return boards.community_counts(S.view(spark, d, "v_activity"))


@query(S.sql("SELECT * FROM recent", "recent"))
def activity_48h(spark: SparkSession, d: str) -> DataFrame:
    return boards.recent_activity(S.view(spark, d, "v_activity"))


@query(S.sql("SELECT row_id, paper_id, reviewer_key, outrage FROM candidate", "candidate"))
def outrage_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("row_id", "paper_id", "reviewer_key", "outrage")


@query(S.sql("SELECT row_id, row_number() OVER (ORDER BY row_id DESC) AS place FROM candidate QUALIFY place <= 12", "candidate"))
def board_latest(spark: SparkSession, d: str) -> DataFrame:
    return boards.top(_candidates(spark, d), [F.desc("row_id")], 12).select("row_id", "place")


_Z = "1.96::DOUBLE"
S.add_cte(
    "bounded",
    f"""SELECT *, total < 5 AS cold_start, CASE WHEN total > 0 THEN round((p + {_Z} * {_Z} / (2 * n) - {_Z} * sqrt((p * (1 - p) + {_Z} * {_Z} / (4 * n)) / n)) / (1 + {_Z} * {_Z} / n), 6) ELSE 0 END AS bound
FROM (SELECT *, total::DOUBLE AS n, up::DOUBLE / nullif(total, 0) AS p FROM (SELECT c.*, coalesce(v.up, 0) AS up, coalesce(v.down, 0) AS down, coalesce(v.up, 0) + coalesce(v.down, 0) AS total FROM candidate c LEFT JOIN voted v USING (paper_id, reviewer_key)))""",
    "candidate", "voted",
)


@query(S.sql("SELECT row_id, total, bound, cold_start, row_number() OVER (ORDER BY cold_start, CASE WHEN cold_start THEN outrage ELSE bound END DESC, CASE WHEN NOT cold_start THEN total END DESC NULLS LAST, row_id DESC) AS place FROM bounded QUALIFY place <= 12", "bounded"))
def board_all_time(spark: SparkSession, d: str) -> DataFrame:
    found = boards.all_time(_candidates(spark, d), boards.vote_counts(S.view(spark, d, "v_activity")))
    return found.select("row_id", "total", "bound", "cold_start", "place")


@query(
    S.sql(
        "SELECT row_id, hot_score, row_number() OVER (ORDER BY hot_score DESC, row_id DESC) AS place FROM (SELECT b.row_id, round(4 * r.commenters + 2 * r.comments + r.votes + r.reactions + least(10, total) * (1 - abs(up - down)::DOUBLE / greatest(1, total)), 6) AS hot_score FROM bounded b JOIN recent r USING (paper_id, reviewer_key) WHERE r.commenters >= 2 OR r.comments >= 3) QUALIFY place <= 12",
        "bounded", "recent",
    )
)
def board_hot(spark: SparkSession, d: str) -> DataFrame:
    activity = S.view(spark, d, "v_activity")
    return boards.hot(_candidates(spark, d), boards.vote_counts(activity), boards.recent_activity(activity)).select("row_id", "hot_score", "place")


@query(S.sql("SELECT row_id, stored, row_number() OVER (ORDER BY cold_start, CASE WHEN NOT cold_start THEN bound END DESC NULLS LAST, stored) AS place FROM (SELECT *, row_number() OVER (ORDER BY row_id DESC) AS stored FROM bounded QUALIFY stored <= 40)", "bounded"))
def refresh_board(spark: SparkSession, d: str) -> DataFrame:
    """Live counts over a stored board of 40 rows: rows of five votes or more lead by their bound, others keep their order."""
    stored = boards.top(_candidates(spark, d), [F.desc("row_id")], 40).withColumnRenamed("place", "stored")
    rows = stored.join(boards.vote_counts(S.view(spark, d, "v_activity")), ["paper_id", "reviewer_key"], "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("up", "down")})
    total = F.col("up") + F.col("down")
    order = Window.orderBy(total < 5, F.when(total >= 5, boards.wilson(F.col("up"), total)).desc_nulls_last(), "stored")
    return rows.select("row_id", "stored", F.row_number().over(order).cast("bigint").alias("place"))


@query(S.sql("SELECT paper_id, metric, array_to_string(list(reviewer_key ORDER BY value * sign DESC, row_id), ',') AS reviewers FROM boarded GROUP BY paper_id, board, metric HAVING board <> 'black'", "boarded"))
def paper_boards(spark: SparkSession, d: str) -> DataFrame:
    """Reviewer keys of each paper by each metric, at most ten."""
    rows = boards.with_metrics(S.view(spark, d, "v_score"))
    metrics = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("int").alias("value")) for m in ("attention", "toxicity", "helpfulness", "score")))
    rows = rows.select("paper_id", "reviewer_key", "row_id", F.inline(metrics))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("paper_id", "metric").orderBy(F.desc("value"), "row_id"))).where("rn <= 10")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "reviewer_key"))), lambda x: x["reviewer_key"]), ",")
    return rows.groupBy("paper_id", "metric").agg(listed.alias("reviewers"))


@query(S.sql("SELECT paper_id, reviewer_key, event_id, n FROM (SELECT *, count(*) OVER (PARTITION BY paper_id, reviewer_key) AS n, row_number() OVER (PARTITION BY paper_id, reviewer_key ORDER BY ts DESC, event_id DESC) AS rn FROM v_activity WHERE action = 'comment') WHERE rn <= 2", "v_activity"))
def comment_previews(spark: SparkSession, d: str) -> DataFrame:
    rows = S.view(spark, d, "v_activity").where("action = 'comment'")
    counts = rows.groupBy("paper_id", "reviewer_key").agg(F.count(F.lit(1)).alias("n"))
    newest = Window.partitionBy("paper_id", "reviewer_key").orderBy(F.desc("ts"), F.desc("event_id"))
    kept = rows.withColumn("rn", F.row_number().over(newest)).where("rn <= 2")
    return kept.join(counts, ["paper_id", "reviewer_key"]).select("paper_id", "reviewer_key", "event_id", "n")


@query(S.sql("SELECT event_id, kind, n FROM (SELECT *, count(*) OVER (PARTITION BY session_id, kind ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, CASE WHEN prefix(action, 'vote') THEN 'vote' ELSE action END AS kind FROM v_activity)) WHERE n > CASE kind WHEN 'vote' THEN 3 WHEN 'reaction' THEN 2 WHEN 'comment' THEN 1 END", "v_activity"))
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Batch form of the trailing-hour limits, with limits that the given events reach."""
    return boards.rate_limited(S.view(spark, d, "v_activity"), {"vote": 3, "reaction": 2, "comment": 1}).select("event_id", "kind", "n")


@query(S.sql("SELECT paper_id, row_id, helpfulness FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY row_id DESC) AS rn FROM v_score) WHERE rn = 1", "v_score"))
def latest_scorecard(spark: SparkSession, d: str) -> DataFrame:
    newest = S.view(spark, d, "v_score").groupBy("paper_id").agg(F.max(F.struct("row_id", "helpfulness")).alias("s"))
    return newest.select("paper_id", "s.row_id", "s.helpfulness")


_NEEDLES = (("org/", 20), (".", 13), ("THE", 50), ("no such text", 20))


@query(
    "WITH p AS (SELECT CAST(page_id AS VARCHAR) AS paper_id, url AS title, 'V' || page_id % 3 AS venue, page_id % 5 AS year FROM pages) "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS needle, CAST(floor((rn - 1) / {size}) AS BIGINT) AS page, (rn - 1) % {size} + 1 AS place, paper_id FROM (SELECT *, row_number() OVER (ORDER BY year DESC, title, paper_id) AS rn FROM p WHERE contains(lower(title), '{n.lower()}') OR contains(paper_id, '{n}')) WHERE rn <= 3 * {size}"
        for n, size in _NEEDLES
    )
)
def search_papers(spark: SparkSession, d: str) -> DataFrame:
    """The first three pages of some searches, each found behind the cursor of the page before."""
    papers = S.table(spark, d, "pages").select(
        F.col("page_id").cast("string").alias("paper_id"), F.col("page_id").cast("string").alias("forum_id"), F.col("url").alias("title"),
        F.concat(F.lit("V"), F.col("page_id") % 3).alias("venue"), (F.col("page_id") % 5).alias("year"),
    )
    index, pages = search.trigram_index(papers), []
    for needle, size in _NEEDLES:
        cursor = ""
        for page in range(3):
            found, cursor = search.search_papers(papers, index, needle=needle, limit=size, cursor=cursor)
            pages.append(found.select(F.lit(needle).alias("needle"), F.lit(page).cast("bigint").alias("page"), F.col("place").cast("bigint").alias("place"), "paper_id"))
            if cursor is None:
                break
    return functools.reduce(DataFrame.unionByName, pages)


@query(S.sql("SELECT n_name AS venue, count(c_custkey) AS papers, min(c_custkey % 7) AS first_year, max(c_custkey % 7) AS last_year FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name"))
def conference_rollup(spark: SparkSession, d: str) -> DataFrame:
    papers = S.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("papers"), F.min(F.col("c_custkey") % 7).alias("first_year"), F.max(F.col("c_custkey") % 7).alias("last_year"))
    venues = S.table(spark, d, "nation")
    joined = venues.join(papers, venues["n_nationkey"] == papers["c_nationkey"], "left")
    return joined.select(F.col("n_name").alias("venue"), F.coalesce("papers", F.lit(0)).alias("papers"), "first_year", "last_year")


S.add_cte("newest_job", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY created_at DESC, job_id DESC) AS rn FROM v_job) WHERE rn = 1", "v_job")
S.add_cte("scored_papers", "SELECT DISTINCT paper_id FROM v_score", "v_score")
S.add_cte("all_papers", "SELECT DISTINCT concat('p', c_custkey) AS paper_id FROM customer")


def _newest(spark: SparkSession, d: str) -> DataFrame:
    newest = S.view(spark, d, "v_job").groupBy("paper_id").agg(F.max(F.struct("created_at", "job_id", "status")).alias("j"))
    return newest.select("paper_id", "j.*")


@query(S.sql("SELECT CASE WHEN s.paper_id IS NOT NULL THEN 'scored' ELSE coalesce(j.status, 'not_queued') END AS state, count(*) AS papers FROM all_papers p LEFT JOIN newest_job j USING (paper_id) LEFT JOIN scored_papers s USING (paper_id) GROUP BY 1", "newest_job", "scored_papers", "all_papers"))
def job_status(spark: SparkSession, d: str) -> DataFrame:
    papers = S.table(spark, d, "customer").select(F.concat(F.lit("p"), "c_custkey").alias("paper_id"))
    done = S.view(spark, d, "v_score").select("paper_id").distinct().withColumn("done", F.lit(True))
    rows = papers.join(_newest(spark, d), "paper_id", "left").join(done, "paper_id", "left")
    state = F.when(F.col("done"), "scored").otherwise(F.coalesce("status", F.lit("not_queued")))
    return rows.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("papers"))


@query(S.sql("SELECT paper_id, 'enqueue' AS step FROM all_papers WHERE paper_id NOT IN (SELECT paper_id FROM scored_papers) AND paper_id NOT IN (SELECT paper_id FROM v_job WHERE status IN ('queued', 'running')) AND paper_id NOT IN (SELECT paper_id FROM newest_job WHERE status = 'failed') UNION ALL SELECT paper_id, 'retry' FROM newest_job WHERE status = 'failed' AND paper_id NOT IN (SELECT paper_id FROM scored_papers)", "newest_job", "scored_papers", "all_papers"))
def job_backlog(spark: SparkSession, d: str) -> DataFrame:
    """Papers to enqueue (neither scored nor active nor failed last) and failed papers to retry."""
    done = S.view(spark, d, "v_score").select("paper_id")
    active = S.view(spark, d, "v_job").where("status in ('queued', 'running')").select("paper_id")
    failed = _newest(spark, d).where("status = 'failed'").select("paper_id").join(done, "paper_id", "left_anti")
    papers = S.table(spark, d, "customer").select(F.concat(F.lit("p"), "c_custkey").alias("paper_id"))
    fresh = papers.join(done, "paper_id", "left_anti").join(active, "paper_id", "left_anti").join(failed, "paper_id", "left_anti")
    return fresh.withColumn("step", F.lit("enqueue")).unionByName(failed.withColumn("step", F.lit("retry")))
