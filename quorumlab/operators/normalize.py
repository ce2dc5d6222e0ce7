"""Threads to tables: reply classes, papers, reviews, decisions and auxiliary texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlab.functions import lexicons as L
from quorumlab.functions import text as T


def signer_role(signer: Column) -> Column:
    low = F.lower(F.coalesce(signer, F.lit("")))
    return (
        F.when(F.contains(low, F.lit("authors")), "authors")
        .when(F.contains(low, F.lit("reviewer")), "reviewer")
        .when(T.any_word(low, ("area_chair", "area-chair", "areachair")), "area_chair")
        .when(T.any_word(low, ("program_chair", "program-chair")), "program_chair")
        .when(F.contains(low, F.lit("ethics")), "ethics_reviewer")
        .when(F.contains(low, F.lit("conference")), "conference_role")
        .otherwise("unknown")
    )


def note_type(invitation: Column, title: Column, text: Column, role: Column) -> Column:
    """Ordered rules over the invitation, then the signer, then title and text."""
    invite, title, text = (F.lower(F.coalesce(x, F.lit(""))) for x in (invitation, title, text))
    author = (role == "authors") | T.any_word(invite, ("author", "rebuttal", "response")) | T.any_word(title, ("author response", "rebuttal")) | title.startswith("response to reviewer") | text.startswith("we thank the reviewer")
    return (
        F.when(T.any_word(invite, ("meta_review", "metareview", "meta-review")), "meta_review")
        .when(F.contains(invite, F.lit("decision")), "decision")
        .when(invite.rlike(r"/-/((official_)?review[0-9]*)$"), "official_review")
        .when(F.contains(invite, F.lit("withdraw")), "withdrawal")
        .when(author, "author_response")
        .when(T.any_word(invite, ("official_comment", "/comment")), "official_comment")
        .when(F.contains(invite, F.lit("revision")), "revision")
        .otherwise("other")
    )


def classified(notes: DataFrame) -> DataFrame:
    """One row per reply of each note, with its signer role and type."""
    rows = notes.select(F.col("id").alias("paper_id"), "venue", F.posexplode("replies").alias("pos", "r")).select("paper_id", "venue", "pos", "r.*")
    rows = rows.withColumn("role", signer_role(F.col("signer")))
    return rows.withColumn("note_type", note_type(F.col("invitation"), F.lit(""), F.col("text"), F.col("role")))


def papers_of(replies: DataFrame) -> DataFrame:
    """Per paper: reviews, decisions and the last non-empty decision text."""
    kind, text = F.col("note_type"), F.coalesce("text", F.lit(""))
    last = F.max(F.when((kind == "meta_review") & (text != ""), F.struct("pos", text.alias("text"))))["text"]
    return replies.groupBy("paper_id").agg(F.count_if(kind == "official_review").alias("reviews"), F.count_if(kind == "meta_review").alias("decisions"), F.coalesce(last, F.lit("")).alias("decision_text"))


def one_of(patterns: tuple[str, ...]) -> str:
    return "(?is)" + "|".join(f"(?:{p})" for p in patterns)


def rolling_reviews(papers: DataFrame, comments: DataFrame, year: int, least: int = 80) -> DataFrame:
    """Comments of a rolling venue that read as reviews, as reviews; papers without any are left out.

    ``papers``: paper_id, status, modified_ms. ``comments``: paper_id, reply_id, invitation, title, comment. Kept are
    decided papers and those of the year, and of their official comments those of at least ``least`` characters that
    have a reviewer's signal and nothing of an author's response or of administration.
    """
    status = F.coalesce("status", F.lit(""))
    current = T.any_word(F.lower(status), L.DECIDED_STATUS) | (F.year(F.timestamp_millis("modified_ms")) == year)
    papers = papers.where(current).select("paper_id", F.when(status == "", "Unknown").otherwise(T.clean_text(status)).alias("decision"))
    said = F.array_join(F.filter(F.array(T.stripped(F.coalesce("title", F.lit(""))), T.stripped(F.coalesce("comment", F.lit("")))), lambda x: x != ""), "\n")
    rows = comments.where(F.contains("invitation", F.lit("/-/Official_Comment"))).withColumn("said", said)
    compact = T.clean_ws("said")
    rows = rows.where((F.length(compact) >= least) & ~compact.rlike(one_of(L.AUTHOR_OR_ADMIN)) & F.col("said").rlike(one_of(L.REVIEWER_SIGNALS)))
    texts = [T.clean_text(x).alias(name) for x, name in (("said", "review_text"), ("title", "summary"), ("comment", "weaknesses"))]
    return rows.join(papers, "paper_id").select("paper_id", F.col("reply_id").alias("review_id"), "decision", *texts)


def auxiliary(replies: DataFrame) -> DataFrame:
    """Per paper: counts and lengths of author responses and of reviewer or chair discussion, and hashed reviewers."""
    kind, n = F.col("note_type"), F.length(F.coalesce("text", F.lit("")))
    response, talk = kind == "author_response", kind.isin("official_comment", "meta_review")
    identity = F.when(kind == "official_review", F.substring(F.sha1(F.concat_ws(":", "paper_id", "signer").cast("binary")), 1, 16))
    return replies.groupBy("paper_id").agg(
        F.count_if(response).alias("responses"),
        F.coalesce(F.sum(F.when(response, n)), F.lit(0)).alias("response_chars"),
        F.count_if(talk).alias("discussions"),
        F.coalesce(F.sum(F.when(talk, n)), F.lit(0)).alias("discussion_chars"),
        F.array_join(F.array_sort(F.collect_set(identity)), ",").alias("reviewers"),
    )


def in_year(papers: DataFrame, year: int, mode: str, accepted_only: bool = False) -> DataFrame:
    """Papers of a year by decision times, activity times, or decisions where there are any.

    ``papers``: paper_id, decision, decisions and activity (arrays of timestamps).
    """
    hit = lambda a: F.exists(a, lambda t: F.year(t) == year)
    by = {"decision_year": hit("decisions"), "activity_year": hit("activity"), "decision_or_activity_year": F.when(F.size("decisions") > 0, hit("decisions")).otherwise(hit("activity"))}
    rows = papers.where(by[mode])
    low = F.lower(F.coalesce("decision", F.lit("")))
    accepted = ~low.rlike(r"\breject(ed|ion)?\b") & low.rlike(r"\baccept(ed|ance)?\b|\bcertif(y|ied|ication)\b|\bpublished\b")
    return rows.where(accepted) if accepted_only else rows
