"""Labels and validation rules, case by case."""

import pytest
from pyspark.sql import functions as F

from quorumlab.operators import adapters, claims, normalize


def test_rebuttal_labels_follow_actions_and_stances(spark):
    review = spark.createDataFrame([("d", i) for i in range(7)], "doc string, sentence int")
    rebuttal = [
        ("d", 0, [1, 6], "Rebuttal_Done ", "dispute", "fixed"),
        ("d", 1, [2], "rebuttal_future", "concur", "agreed"),
        ("d", 2, [3], "rebuttal_future", "dispute", "later"),
        ("d", 3, [4], "rebuttal_reject", "mitigate", "no"),
        ("d", 4, [5], "", "", ""),
        ("d", 5, [6], "rebuttal_answer", "answer", "fixed"),
        ("d", 6, None, "rebuttal_done", "concur", "about nothing"),
    ]
    rows = spark.createDataFrame(rebuttal, "doc string, pos int, targets array<int>, action string, stance string, text string")
    found = {r["sentence"]: r for r in adapters.alignments(review, rows).collect()}
    labels = ["not_addressed", "resolved_or_weakened", "specifically_addressed", "partially_addresses", "generic_or_unclear", "generic_or_unclear", "resolved_or_weakened"]
    assert [found[i]["gold_label"] for i in range(7)] == labels
    assert found[6]["context_text"] == "fixed" and found[6]["n"] == 2 and found[0]["n"] == 0


LONG = "This comment is long enough to be read as a whole review of something, or so it seems to us."


@pytest.mark.parametrize(
    "title, comment, kept",
    [
        ("", LONG, False),
        ("", "The paper: " + LONG, True),
        ("A concern", LONG, True),
        ("Response to reviewer", "The paper: " + LONG, False),
        ("", "We have updated the manuscript. The paper: " + LONG, False),
        ("", "The paper is short.", False),
        ("", "the " + LONG, False),
        ("Dear action editor", LONG + " The authors agree.", False),
    ],
)
def test_rolling_comments_read_as_reviews(spark, title, comment, kept):
    papers = spark.createDataFrame([("p", "Under review", 1_750_000_000_000), ("q", "Under review", 1_500_000_000_000)], "paper_id string, status string, modified_ms bigint")
    rows = [(p, f"{p}1", "V/-/Official_Comment", title, comment) for p in "pq"] + [("p", "p2", "V/-/Review", title, comment)]
    comments = spark.createDataFrame(rows, "paper_id string, reply_id string, invitation string, title string, comment string")
    assert [r["review_id"] for r in normalize.rolling_reviews(papers, comments, 2025).collect()] == (["p1"] if kept else [])


def test_decided_papers_of_other_years_stay(spark):
    papers = spark.createDataFrame([("p", "Withdrawn by authors", 0)], "paper_id string, status string, modified_ms bigint")
    comments = spark.createDataFrame([("p", "c", "V/-/Official_Comment", "T", "The paper: " + LONG)], "paper_id string, reply_id string, invitation string, title string, comment string")
    assert normalize.rolling_reviews(papers, comments, 2025).count() == 1


CLAIM = "review_id string, claim_text string, source_field string, source_sentence string, claim_type string, importance string"
TEXT = "Summary: The paper lacks a baseline. It is nice. Why is it so? The work is terrible. A weak reject is given, because of the proofs."


@pytest.mark.parametrize(
    "claim, field, quote, kind, weight, kept",
    [
        ("No baseline", "review_text", "The paper lacks a baseline.", "baseline", "major", ("No baseline", "baseline", "major")),
        ("No baseline", "review_text", "the  PAPER lacks a baseline.", "odd", "odd", ("No baseline", "general", "medium")),
        ("No baseline", "other", "The paper lacks a baseline.", "baseline", "major", None),
        ("No baseline", "review_text", "The paper lacks nothing.", "baseline", "major", None),
        ("It is nice", "review_text", "It is nice.", "general", "minor", None),
        ("It is nice", "review_text", "It is nice.", "general", "question", ("It is nice", "general", "question")),
        ("Unclear reason", "review_text", "Why is it so?", "general", "minor", ("Unclear reason", "general", "minor")),
        ("Bad words", "review_text", "The work is terrible.", "tone", "tone-only", ("Bad words", "tone", "tone-only")),
        ("The paper lacks tact", "review_text", "It is nice.", "tone", "minor", None),
        ("Rejected", "review_text", "A weak reject is given, because of the proofs.", "general", "minor", ("Rejected", "general", "minor")),
        ("Slacks", "review_text", "It is nice.", "general", "minor", None),
        ("A missing part (implied).", "review_text", "It is nice.", "general", "minor", ("A missing part", "general", "minor")),
        ("See the source sentence", "review_text", "Summary: The paper lacks a baseline.", "general", "minor", ("The paper lacks a baseline.", "general", "minor")),
        ("rating of 5", "review_text", "It is nice.", "general", "minor", None),
        ("", "review_text", "The paper lacks a baseline.", "general", "minor", None),
        ("No baseline", "review_text", "", "general", "minor", None),
    ],
)
def test_claims_are_validated(spark, claim, field, quote, kind, weight, kept):
    reviews = spark.createDataFrame([("r", TEXT)], "review_id string, review_text string").withColumn("summary", F.lit(None).cast("string"))
    found = claims.validated(spark.createDataFrame([("r", claim, field, quote, kind, weight)], CLAIM), reviews).collect()
    assert [(r["claim_text"], r["claim_type"], r["importance"]) for r in found] == ([kept] if kept else [])
