"""What papers have and which metrics that allows, as one bit mask a paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlab.functions import text as T

AVAILABLE = (
    "has_reviews", "has_two_or_more_reviews", "has_ratings", "has_confidence", "has_author_response", "has_meta_review", "has_meta_review_text",
    "has_decision_note", "has_decision_label", "has_decision_comment_text", "has_official_comments", "has_reviewer_or_ac_discussion",
    "has_post_rebuttal_reviewer_comments", "has_post_rebuttal_review_update",
)
#: The flags that each metric needs beside reviews, any of them where there are two.
METRICS = {
    "claim_grounding": ("has_reviews",),
    "rebuttal_alignment": ("has_author_response",),
    "concern_survival_meta_review": ("has_meta_review_text",),
    "concern_survival_decision_comment": ("has_decision_comment_text",),
    "concern_survival_meta_or_decision": ("has_meta_review_text", "has_decision_comment_text"),
    "reviewer_discussion_followup": ("has_reviewer_or_ac_discussion",),
    "post_rebuttal_discussion_followup": ("has_post_rebuttal_reviewer_comments",),
    "post_rebuttal_review_update_proxy": ("has_post_rebuttal_review_update",),
    "inter_review_consensus": ("has_two_or_more_reviews",),
    "rating_text_calibration": ("has_ratings",),
    "confidence_calibration": ("has_confidence",),
}
NAMES = (*AVAILABLE, *METRICS)
#: Metrics that need a fifth of the papers to be more than limited.
SPARSE = ("post_rebuttal_review_update_proxy", "concern_survival_decision_comment")
COUNTS = ("reviews", "author_responses", "meta_reviews", "decisions", "official_comments", "discussion", "post_comments", "review_updates")


def bit(name: str) -> int:
    return 1 << NAMES.index(name)


def holds(mask: Column, name: str) -> Column:
    return mask.bitwiseAND(F.lit(bit(name))) != 0


def paper_inventory(papers: DataFrame, replies: DataFrame) -> DataFrame:
    """Per paper: replies, counts of their kinds, decision, first response and the mask of ``NAMES`` (first name lowest).

    ``papers``: paper_id. ``replies``: paper_id, pos, note_type, signer_role, created_ms, modified_ms, text, comment_text,
    decision, rating_normalized, confidence_normalized. Papers without replies have zeros.
    """
    kind, created, modified = F.col("note_type"), F.col("created_ms"), F.col("modified_ms")
    first = replies.where(kind == "author_response").groupBy("paper_id").agg(F.min("created_ms").alias("first_ms"))
    rows = replies.join(first, "paper_id", "left")
    review, comment, decided = kind == "official_review", kind == "official_comment", kind == "decision"
    talk = comment & F.col("signer_role").isin("reviewer", "area_chair", "program_chair")
    earliest = lambda column: F.min(F.when(decided & (T.clean_text(column) != ""), F.struct("pos", T.clean_text(column).alias("v"))))["v"]
    counted = {
        "reviews": review,
        "author_responses": kind == "author_response",
        "meta_reviews": kind == "meta_review",
        "decisions": decided,
        "official_comments": comment,
        "discussion": talk,
        "post_comments": talk & (created > F.col("first_ms")),
        "review_updates": review & (modified > F.col("first_ms")) & (modified > created),
    }
    said = lambda where, column: F.coalesce(F.max(where & (F.coalesce(column, F.lit("")) != "")), F.lit(False))
    per = rows.groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("replies"),
        *(F.count_if(v).alias(k) for k, v in counted.items()),
        F.coalesce(earliest("decision"), earliest("text"), F.lit("")).alias("decision"),
        F.min("first_ms").alias("first_ms"),
        F.count_if(review & F.col("rating_normalized").isNotNull()).alias("ratings"),
        F.count_if(review & F.col("confidence_normalized").isNotNull()).alias("confidences"),
        said(kind == "meta_review", "text").alias("meta_text"),
        said(decided, "comment_text").alias("decision_comment"),
    )
    per = papers.select("paper_id").join(per, "paper_id", "left")
    zero = ("replies", *COUNTS, "ratings", "confidences")
    per = per.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero} | {c: F.coalesce(c, F.lit(False)) for c in ("meta_text", "decision_comment")})
    per = per.withColumn("decision", F.coalesce("decision", F.lit("")))
    n = F.col
    flags = (
        n("reviews") > 0, n("reviews") >= 2, n("ratings") > 0, n("confidences") > 0, n("author_responses") > 0, n("meta_reviews") > 0, n("meta_text"),
        n("decisions") > 0, n("decision") != "", n("decision_comment"), n("official_comments") > 0, n("discussion") > 0, n("post_comments") > 0, n("review_updates") > 0,
    )
    mask = F.lit(0)
    for name, flag in zip(AVAILABLE, flags, strict=True):
        mask = mask + F.when(flag, bit(name)).otherwise(0)
    per = T.computed(per, available=mask)
    mask = n("available")
    for name, needs in METRICS.items():
        some = mask.bitwiseAND(F.lit(sum(map(bit, needs)))) != 0
        mask = mask + F.when(holds(n("available"), "has_reviews") & some, bit(name)).otherwise(0)
    decision = F.when(n("decision") == "", "Unknown").otherwise(n("decision"))
    return per.select("paper_id", "replies", *COUNTS, decision.alias("decision"), "first_ms", mask.alias("mask"))


def inventory_report(inventory: DataFrame) -> DataFrame:
    """Papers and share of each flag and metric, and how far a metric carries: the masks are summed bit by bit in one
    aggregation and turned into rows once."""
    sums = inventory.agg(F.count(F.lit(1)).alias("papers"), *(F.count_if(holds(F.col("mask"), name)).alias(name) for name in NAMES))
    rows = sums.select("papers", F.inline(F.array(*(F.struct(F.lit(name).alias("flag"), F.col(name).alias("n")) for name in NAMES))))
    share = F.when(F.col("papers") > 0, F.col("n") / F.col("papers")).otherwise(0.0)
    metric = F.col("flag").isin(*METRICS)
    status = (
        F.when(~metric, F.lit(None))
        .when(F.col("n") == 0, "not_available")
        .when(F.col("flag").isin(*SPARSE) & (share < 0.2), "limited")
        .when(share >= 0.8, "strong")
        .when(share >= 0.4, "usable")
        .otherwise("limited")
    )
    return rows.select(F.when(metric, "metric").otherwise("availability").alias("section"), "flag", F.col("n").alias("papers"), F.round(share, 4).alias("rate"), status.alias("status"))
