"""Steps that must not be computed, copied or shuffled more than once."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quorumlab.functions import text as T
from quorumlab.operators import adapters, audit, claims, retrieval, sampling


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("column", [lambda: T.snippet("t", T.words_of(("mentation", "there"))), lambda: T.split_segments("t"), lambda: T.concern_tokens("t")])
def test_a_text_is_cleaned_once(spark, column):
    plan = plan_of(spark.createDataFrame([("a",)], "t string").select(column().alias("x")))
    assert plan.count("<[^>]+>") == 1


def test_a_token_is_folded_once(spark):
    plan = plan_of(spark.createDataFrame([("a",)], "t string").select(T.concern_tokens("t").alias("x")))
    assert plan.count(", -, )") == 1
    rows = spark.createDataFrame([("Base-lines baseline, running ran; ablations &amp;ablated the-the",), (None,)], "t string").select(T.concern_tokens("t").alias("x")).collect()
    assert rows[0]["x"] == sorted(set(rows[0]["x"])) and "baseline" in rows[0]["x"] and "ablation" in rows[0]["x"] and rows[1]["x"] == []


def test_claims_of_a_review_are_found_in_its_row(spark):
    said = [f"The result number {i} is missing a clear baseline experiment here." for i in range(12)]
    texts = {"many": " ".join([said[0], said[0].upper(), *said]), "none": "Nice text of nothing. " * 60, "blank": " \n\t ", "null": None}
    found = claims.extracted(spark.createDataFrame(list(texts.items()), "review_id string, text string"))
    assert "Exchange" not in plan_of(found) and "Join" not in plan_of(found)
    rows = sorted((r["review_id"], r["claim_index"], r["claim"]) for r in found.collect())
    assert rows == [*(("many", i, s) for i, s in enumerate(said[:8])), ("none", 0, texts["none"].strip()[:600])]


def test_spans_meet_their_proof_in_one_group(spark):
    rng, rows = random.Random(1), []
    for i in range(30):
        review, label = "", []
        for j in range(rng.randint(0, 40)):
            piece = f" piece {i} {j} " if rng.random() < 0.9 else "  "
            label.append((len(review), len(review) + len(piece), ("Jus_" if j % 3 == 2 else "Eval_") + str(j // 3 - rng.randint(0, 1))))
            review += piece
        rows.append((i, review, label))
    df = spark.createDataFrame(rows, "id int, review string, label array<struct<start: int, stop: int, tag: string>>")
    found = adapters.spans(df)
    assert "Join" not in plan_of(found)
    expected = []
    for i, review, label in rows:
        cut = [(review[a:z].strip(" "), *tag.split("_")) for a, z, tag in label]
        for text, kind, key in cut:
            if kind == "Eval" and text:
                proof = [t for t, k, x in cut if k == "Jus" and x == key and t]
                expected.append((i, f"Eval_{key}", text, " ".join(proof), "substantiated" if proof else "unsubstantiated"))
    assert sorted(map(tuple, found.collect())) == sorted(expected)


@pytest.mark.parametrize("sample", ["targeted", "balanced"])
def test_a_pool_is_computed_once(spark, monkeypatch, sample):
    labels, staged = [], sampling.staged
    monkeypatch.setattr(sampling, "staged", lambda df, label: (labels.append(label), staged(df, label))[1])
    rows = spark.range(300).select(F.concat(F.lit("t"), "id").alias("task_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"))
    if sample == "targeted":
        found = sampling.targeted(rows, [("a", 0.3, F.col("label") == "a"), ("b", 0.7, F.col("label") == "b")], 40, 3)
    else:
        found = sampling.balanced(rows, "label", ("a", "b"), 40, 3)
    assert labels.count("pool") == 1 and found.count() == 40


@pytest.mark.parametrize("name, shuffles", [("top_keywords", 1), ("works_table", 2)])
def test_words_are_not_shuffled(spark, sf_dir, name, shuffles):
    plan = plan_of(entry.queries()[name](spark, sf_dir)).split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == shuffles


def test_empty_containers_are_not_filled(spark):
    df = spark.createDataFrame([("f", '{"a": [], "b": {}, "c": [null], "d": {"x": 0}, "e": [[]], "g": "", "h": 0, "i": false, "j": null, "k": "x", "l": 0.5}')], "file string, json string")
    filled = {r["at"]: r["filled"] for r in audit.walked(df).collect()}
    assert {k for k, v in filled.items() if v} == {"c", "d", "e", "k", "l"}


def test_memory_search_tokenizes_a_text_once_and_keeps_tokens_in_place(spark, sf_dir, monkeypatch):
    plans, staged = [], retrieval.staged
    monkeypatch.setattr(retrieval, "staged", lambda df, label: (plans.append((label, plan_of(df))), staged(df, label))[1])
    entry.queries()["memory_prior"](spark, sf_dir)
    assert sum(p.count("[a-z][a-z0-9_-]{2,}") for _, p in plans if "/documents.parquet" in p) == 1
    # whole token sets are not moved: words are looked up where they are, and only the numbers of known ones are grouped
    (index,) = (p for label, p in plans if label == "memory-sets")
    assert "BroadcastHashJoin" in index and index.count("Exchange hashpartitioning") == 1


def test_memories_may_share_token_sets(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["alpha", "betas", "gamma", "classes", "cities", "uses", "the", "ties"], k=rng.randint(0, 6))) for _ in range(30)] + [None]
    rows = [(f"{d}{i}", i, d, t, rng.randint(0, 2) / 2, "l") for i, t in enumerate(texts) for d in "xy"]
    memory = spark.createDataFrame(rows, "memory_id string, ord int, dimension string, input_text string, mapped_score double, gold_label string")
    queries = spark.createDataFrame([(1, "alpha class"), (2, "city use tie"), (3, "the"), (4, "unseen")], "query_id int, query_text string")
    sets = retrieval.token_sets(spark.createDataFrame(list(enumerate(texts)), "ord int, text string"), "text", "ord")
    named = memory.drop("input_text").join(sets.select("ord", "set_id"), "ord")
    key = lambda r: (r["query_id"], r["dimension"], r["rank"], r["memory_id"], r["similarity"])
    found = sorted(map(key, retrieval.memory_topk(queries, named, 3, sets=sets).collect()))
    assert found == sorted(map(key, retrieval.memory_topk(queries, memory, 3).collect())) and len(found) == 18
    words = spark.createDataFrame([(t,) for t in texts], "t string").select(T.token_set("t").alias("x"), F.array_sort(F.array_distinct(T.token_list("t"))).alias("y")).collect()
    assert [r["x"] for r in words] == [r["y"] for r in words]
