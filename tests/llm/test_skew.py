"""Joins with hot keys, exact keys of contaminated rows, and logs with drafts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quorumlab.llm import chat, decontaminate, skew


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 5)
    monkeypatch.setattr(skew, "SHARE", 4)


def counted(df):
    return Counter(repr(sorted(r.asDict().items())) for r in df.collect())


def test_salted_join_equals_a_plain_one(spark, small):
    rows = spark.range(200).select((F.col("id") % 3 * (F.col("id") % 2)).alias("k"), "id")
    named = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (9, "d")], "k bigint, name string")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert [r["parts"] > 1 for r in skew.hot_keys(counts, ["k"]).collect()] == [True]
    assert counted(skew.joined_salted(rows, named, ["k"], counts)) == counted(rows.join(named, "k"))


def test_join_in_cells_equals_a_plain_one(spark, small):
    left = spark.range(90).select(F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id")).alias("k"), F.lit("t").alias("t"), F.col("id").alias("a"))
    right = spark.range(70).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("k"), F.lit("t").alias("t"), F.col("id").alias("b"))
    assert counted(skew.joined_in_cells(left, right, ["k", "t"])) == counted(left.join(right, ["k", "t"]))
    assert skew.joined_in_cells(left.where("false"), right, ["k", "t"]).count() == 0


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def test_a_passage_in_most_documents(spark, small):
    docs = spark.createDataFrame([(i, f"{ITEM} tail{i}" if i % 4 else f"clean text number {i}") for i in range(80)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, ITEM), (2, "word"), (3, None)], "item_id bigint, text string")
    found = decontaminate.contamination(docs, items).collect()
    assert {r["doc_id"] for r in found if r["contaminated"]} == {i for i in range(80) if i % 4}
    assert {(r["n_hit"], r["n_items"]) for r in found if r["doc_id"] % 4} == {(14, 1)}


def test_clean_documents_tell_rows_apart(spark):
    rows = [(1, ITEM, "a"), (1, "clean text", "b"), (2, ITEM, "c"), (None, ITEM, "d"), (None, "clean", "e"), (3, None, "f"), (12, "x;=1", "g"), (1, ITEM, "h"), (4, "far " * 200_000 + ITEM, "i")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("__key", F.lit(1)).withColumn("n_words", F.lit("clash"))
    items = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    kept = decontaminate.clean_documents(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["source"] for r in kept.collect()) == ["b", "e", "f", "g", "i"]  # of a very long text the passage is under a twentieth


def test_logs_with_drafts_fold_to_the_stored_rows(spark):
    rows = [(c, t, ["user", "assistant", None][(c + t) % 3], [None, "", "short", "a long text " * 90][(c * t) % 4]) for c in range(6) for t in range(7)]
    talks = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    log = chat.events_of(talks, drafts=True)
    assert {"delta", "edit", "regenerate"} == {r["kind"] for r in log.select("kind").distinct().collect()}
    assert counted(chat.format_chats(log)) == counted(chat.format_chats(chat.events_of(talks)))


def test_an_edit_keeps_the_role(spark):
    events = [(1, 1, 1, "delta", "user", "a"), (1, 2, 1, "edit", None, "b"), (1, 3, 2, "delta", "assistant", "c"), (1, 4, 2, "regenerate", None, None), (1, 5, 2, "delta", "tool", "d")]
    log = spark.createDataFrame(events, "conv_id bigint, seq bigint, turn bigint, kind string, role string, text string")
    assert chat.format_chats(log).first()["formatted"] == "### user: b</turn>\n### tool: d</turn>\n"
