"""Operators on literal rows with known numbers, and under other partitionings."""

import html
import random

import pytest
from pyspark.sql import functions as F

from quorumlab.functions import text as T
from quorumlab.operators import adapters, boards, claims, exports, lifecycle, matching, normalize, reports, retrieval, sampling, scoring
from quorumlab.sources import files


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "rating"), [("8: accept", 8.0), ("4/5", 8.0), ("3 out of 5", 6.0), ("Rating 12", None), ("none", None), ("", None), ("6.5", 6.5)]
)
def test_ratings(spark, raw, rating):
    assert one(spark, T.normalize_rating("t"), t=raw) == rating


def test_text_functions(spark):
    assert one(spark, T.clean_text("t"), t=" a &amp; b\r\n\n\n\n<p>c</p> \t d ") == "a & b\n\n c d"
    assert one(spark, T.split_sentences("t"), t="- First point here. Second one; and a third\n* short") == ["First point here.", "and a third short"]
    assert one(spark, T.concern_tokens("t"), t="The evaluations lack missing baselines; limited novelty") == sorted({"evaluate", "lack", "baseline", "limitation", "novelty"})
    assert one(spark, T.token_list("t"), t="Studies of the boxes and cats") == ["study", "box", "cat"]
    assert one(spark, T.truncate_words("t", 12), t="alpha beta gamma") == "alpha..."
    assert one(spark, T.decision_class("t"), t="Accept (Oral)") == "accept"
    assert one(spark, F.unix_seconds(T.parse_time("t")), t="1700000000000") == 1700000000
    assert one(spark, F.unix_seconds(T.parse_time("t")), t="2023-11-14T22:13:20Z") == 1700000000
    assert one(spark, T.parse_time("t"), t="soon") is None


def test_classification_numbers(spark):
    rows = spark.createDataFrame([("yes", "yes"), ("no", "yes"), ("no", "no")], "gold string, predicted string")
    r = reports.classification(rows).first()
    assert (r["records"], r["accuracy"], r["balanced_accuracy"]) == (3, 0.6667, 0.75)


def test_alignment_numbers(spark):
    rows = spark.createDataFrame([(["a", "b"], ["a", "c"]), (["x"], []), ([], [])], "gold_ids array<string>, predicted_ids array<string>")
    found = reports.alignment(rows).collect()
    assert [(r["precision"], r["recall"], r["f1"], r["exact_match"]) for r in found] == [(0.5, 0.5, 0.5, False), (0.0, 0.0, 0.0, False), (0.0, 0.0, 0.0, False)]


def test_hybrid_score(spark):
    final, source = retrieval.hybrid(F.lit(0.9), F.lit(0.6))
    assert one(spark, final) == 0.78 and one(spark, source) == "hybrid"
    assert one(spark, retrieval.hybrid(F.lit(None).cast("double"), F.lit(0.6))[1]) == "memory_prior"


def test_memory_fills_up_with_the_best_scores(spark):
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "the of"), (3, "zzz unseen")], "query_id int, query_text string")
    rows = [(f"m{i}", i, "d", t, s, "l") for i, (t, s) in enumerate([("alpha", 0.1), ("beta alpha", 0.2), ("gamma", 0.9), ("delta", 0.9), ("omega", 0.5)])]
    memory = spark.createDataFrame(rows, "memory_id string, ord int, dimension string, input_text string, mapped_score double, gold_label string")
    found = retrieval.memory_topk(queries, memory, 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["memory_id"], r["similarity"]) for r in found] == [(1, "m1", 1.0), (1, "m0", 0.5), (1, "m2", 0.0), (3, "m2", 0.0), (3, "m3", 0.0), (3, "m4", 0.0)]


def test_bounded_searches_are_exact(spark):
    """Top lists with bounds against comparing every query with everything, with common words in all texts."""
    rng = random.Random(2)
    words = [f"word{i}" for i in range(60)]
    weights = [60 // (i + 1) + 1 for i in range(60)]
    texts = [" ".join(["common", *rng.choices(words, weights, k=rng.randint(1, 14))]) for _ in range(120)]
    queries = spark.createDataFrame([(i, " ".join(["common", *rng.choices(words, weights, k=rng.randint(1, 10))])) for i in range(25)] + [(99, "unseen thing")], "query_id int, query_text string")
    rows = [(f"m{i}", i, "ab"[i % 2], t, round(rng.random(), 2), "l") for i, t in enumerate(texts)]
    memory = spark.createDataFrame(rows, "memory_id string, ord int, dimension string, input_text string, mapped_score double, gold_label string")
    tokens = lambda t: set(t.split())
    expected = set()
    for r in queries.collect():
        for d in "ab":
            own = tokens(r["query_text"])
            ranked = sorted((-round(len(own & tokens(t)) / len(own | tokens(t)), 4), -s, i, m) for m, i, x, t, s, _ in rows if x == d)
            expected |= {(r["query_id"], d, n + 1, x[3]) for n, x in enumerate(ranked[:4])}
    for rare in (1, 3):
        found = {(r["query_id"], r["dimension"], r["rank"], r["memory_id"]) for r in retrieval.memory_topk(queries, memory, 4, rare).collect()}
        assert found == expected
    cases = spark.createDataFrame([(f"c{i:03}", f"p{i // 3}", "xy"[i % 2], t, "l") for i, t in enumerate(texts)], "case_id string, paper_id string, claim_type string, text string, label string")
    whole = {(r["query_id"], r["case_id"]): r["score"] for r in retrieval.case_retrieval(cases, 4, 1000).collect()}
    for rare in (1, 2):
        assert {(r["query_id"], r["case_id"]): r["score"] for r in retrieval.case_retrieval(cases, 4, rare).collect()} == whole


CLAIMS = [
    ("t1", "p1", "r1", 0, 0, "The baseline comparison is missing in every experiment", "baseline"),
    ("t2", "p1", "r2", 1, 0, "Missing baseline comparison for the main experiment", "baseline"),
    ("t3", "p1", "r2", 1, 1, "Figures look pleasant overall", "general"),
    ("t4", "p2", "r3", 0, 0, "Nobody else wrote about this paper", "general"),
]
SEGMENTS = [
    ("p1", "meta_review", 1, "Reviewers agree that the baseline comparison is missing."),
    ("p1", "author_response", 2, "We added the baseline comparison and the missing experiment"),
    ("p1", "official_comment", 3, "Thanks, still no word about the ethics statement"),
]


@pytest.mark.parametrize("parts", [1, 7])
def test_matches_do_not_depend_on_partitions(spark, parts):
    rows = spark.createDataFrame(CLAIMS, "task_id string, paper_id string, review_id string, turn int, claim_index int, claim_text string, claim_type string")
    rows = rows.withColumns({"source_sentence": F.col("claim_text"), "importance": F.lit("major"), "source_field": F.lit("weaknesses")}).repartition(parts)
    segments = spark.createDataFrame(SEGMENTS, "paper_id string, note_type string, ord int, segment string").repartition(parts)
    found = {r["task_id"]: r for r in matching.signals(rows, segments).collect()}
    assert [found[t]["survival_label"] for t in ("t1", "t3", "t4")] == ["survived", "not_found", "not_found"]
    assert (found["t1"]["consensus_proxy"], found["t1"]["matched_review_id"]) == ("strong", "r2") and found["t4"]["consensus_proxy"] == "none"
    assert found["t1"]["rebuttal_label"] == "likely_resolved_or_answered" and found["t3"]["rebuttal_label"] == "not_addressed"
    assert found["t1"]["discussion_label"] == "not_found"


def test_robustness_weights(spark):
    assert abs(sum(lifecycle.WEIGHTS.values()) - 1) < 1e-9
    assert [one(spark, lifecycle.robustness_label(F.lit(x))) for x in (0.72, 0.45, 0.4499)] == ["high", "medium", "low"]


def test_boards(spark):
    assert one(spark, boards.wilson(F.lit(5), F.lit(5))) == pytest.approx(0.565509, abs=1e-6)
    ranked = spark.createDataFrame([("b", v, i + 1) for i, v in enumerate("aaaabac")], "board string, venue string, pos int")
    found = boards.venue_balanced(ranked, 5).orderBy("place").collect()
    assert [(r["venue"], r["pos"]) for r in found] == [("a", 1), ("b", 5), ("c", 7), ("a", 2), ("a", 3)]


def test_votes_keep_the_last_and_drop_withdrawn(spark):
    rows = [(1, "2024-01-01", "p", "R1", "u1", "vote_up"), (2, "2024-01-02", "p", "R1", "u1", "vote_down"), (3, "2024-01-01", "p", "R1", "u2", "vote_up"), (4, "2024-01-03", "p", "R1", "u2", "vote_none")]
    log = spark.createDataFrame(rows, "event_id int, ts string, paper_id string, reviewer_key string, session_id string, action string")
    assert [(r["session_id"], r["action"]) for r in boards.live_votes(log).collect()] == [("u1", "vote_down")]


def test_reply_classes(spark):
    cases = [("V/P1/Reviewer_a", "V/-/Official_Review", "official_review"), ("V/P1/Authors", "V/-/Official_Comment", "author_response"), ("V/P1/Area_Chair_x", "V/-/Meta_Review", "meta_review"), ("V/P1/Reviewer_a", "V/-/Official_Comment", "official_comment"), ("V/Program_Chairs", "V/-/Decision", "decision"), ("x", "V/-/Withdraw", "withdrawal"), ("x", "y", "other")]
    rows = spark.createDataFrame(cases, "signer string, invitation string, expected string")
    found = rows.select("expected", normalize.note_type(F.col("invitation"), F.lit(""), F.lit(""), normalize.signer_role(F.col("signer"))).alias("got")).collect()
    assert all(r["expected"] == r["got"] for r in found)


def test_year_modes(spark):
    rows = spark.createDataFrame([("a", "Accept", ["2024-05-01"], ["2025-01-01"]), ("b", "Reject", [], ["2025-02-01"]), ("c", "accepted", [], ["2024-02-01"])], "paper_id string, decision string, d array<string>, a array<string>")
    rows = rows.select("paper_id", "decision", F.transform("d", lambda x: F.to_timestamp(x)).alias("decisions"), F.transform("a", lambda x: F.to_timestamp(x)).alias("activity"))
    ids = lambda *x: sorted(r["paper_id"] for r in normalize.in_year(rows, *x).collect())
    assert ids(2025, "decision_or_activity_year") == ["b"] and ids(2025, "activity_year") == ["a", "b"] and ids(2024, "decision_or_activity_year", True) == ["a", "c"]


def test_scores_are_clamped_and_capped(spark):
    rows = spark.createDataFrame([("130", "4.5", "n/a", "q w e r", "fine", True), ("2", "1", "9", "one", "fine", True), ("10", "0", "90", "many words in this quote", "Mostly summary", True)], "outrage string, toxicity string, helpfulness string, quote string, verdict string, actionable boolean")
    found = scoring.normalized_scores(rows).collect()
    assert [(r["outrage"], r["toxicity"], r["helpfulness"]) for r in found] == [(100, 4, 0), (20, 10, 45), (10, 0, 35)]


def test_claims_are_deduplicated_in_order(spark):
    rows = [("r", 0, "The paper lacks a baseline comparison on ImageNet"), ("r", 1, "A baseline comparison on ImageNet is lacking"), ("r", 2, "Proofs of theorem two are incomplete"), ("r", 3, None)]
    found = claims.deduplicated(spark.createDataFrame(rows, "review_id string, claim_index int, claim_text string"))
    assert {r["claim_index"] for r in found.collect()} >= {0, 2} and 1 not in {r["claim_index"] for r in found.collect()}


@pytest.mark.parametrize(
    ("texts", "kept"),
    [
        (["The authors should clarify the training setup and report the impact of each module.", "The authors should clarify the training setup."], [0]),
        (["The paper lacks any ablation study and does not compare to standard baselines.", "The review notes that there is no ablation and no standard baselines, which is a limitation to be addressed."], [0]),
        (["Weaknesses: Proofs need more details", "proofs need detail", "", None], [0, 2, 3]),
        (["Runtime memory figures are absent", "Licence terms remain unknown", "Runtime memory figures are absent while licence terms remain unknown"], [0, 1]),
    ],
)
def test_duplicate_claims_go(spark, texts, kept):
    rows = spark.createDataFrame([("r", i, t) for i, t in enumerate(texts)], "review_id string, claim_index int, claim_text string")
    assert sorted(r["claim_index"] for r in claims.deduplicated(rows).collect()) == kept


def test_quotes_are_located(spark):
    cases = [
        ("One two.\nThree  four.", "three four."), ("One two.\n\nThree  four.", "Three four."), ("a.b a+b (c)", " a+b "), ("x", "y"), (None, "y"), ("x", None), ("say A\\E  b", "a\\E b"),
        ("Intro.\n- one. Two here\n- three\nand four\n\n3) five &amp; six", "three and four"), ("Intro.\n- one. Two here\n- three\n \n3) five &amp; six", "five & six"), ("- a b. C d", "C d"),
    ]
    rows = spark.createDataFrame([(str(i), *c) for i, c in enumerate(cases)], "task_id string, field_text string, quote string")
    names = ("start", "stop", "strategy", "line_start", "line_end", "paragraph", "bullet", "sentence")
    found = [tuple(r[n] for n in names) for r in claims.located(rows).orderBy("task_id").collect()]
    none = (-1, -1, "none", None, None, None, None)
    assert found == [
        (9, 20, "normalized", 1, 1, 0, None, 1), (10, 21, "exact", 2, 2, 1, None, 1), (4, 7, "exact", 0, 0, 0, None, 0), (*none, None), (*none, None), (*none, 0), (4, 9, "normalized", 0, 0, 0, None, 0),
        (25, 39, "normalized", 2, 3, 0, 1, None), (36, 46, "exact", 4, 4, 1, 2, 4), (7, 10, "exact", 0, 0, 0, 0, 1),
    ]


def test_chunks_carry_their_section(spark):
    rows = spark.createDataFrame([("p", 1, "Abstract\nWe show.\n1 Introduction to It\nText one."), ("p", 2, "More text.\nAppendix A\nExtra.")], "paper_id string, page bigint, text string")
    found = claims.chunked_pages(rows).orderBy("page", "section").collect()
    assert [(r["section"], r["source_type"], r["body"]) for r in found] == [("1 Introduction to It", "paper", "Text one."), ("Abstract", "paper", "We show."), ("1 Introduction to It", "paper", "More text."), ("Appendix", "appendix", "Extra.")]


def test_batches_are_packed_next_fit(spark):
    rows = spark.createDataFrame([(f"c{i}", "v", t) for i, t in enumerate([6, 5, 4, 9, 1, 1])], "custom_id string, venue string, tokens bigint")
    found = exports.split_batches(rows, "venue", 10, 2).orderBy("custom_id").collect()
    assert [r["part"] for r in found] == [0, 1, 1, 2, 2, 3]


@pytest.mark.parametrize("block_rows", [1, 3, 7, 1000])
def test_parts_do_not_depend_on_blocks(spark, block_rows):
    """Parts chained over blocks of any size are those of one pass over the ordered requests."""
    rng = random.Random(block_rows)
    rows = [(f"c{i:04}", rng.choice("ab"), rng.choice((1, 2, 5, 9, 14))) for i in range(150)]
    expected = {}
    for venue in "ab":
        part = held = n = 0
        for key, _, t in sorted(r for r in rows if r[1] == venue):
            if n and (held + t > 12 or n >= 4):
                part, held, n = part + 1, 0, 0
            expected[key], held, n = part, held + t, n + 1
    table = spark.createDataFrame(rows, "custom_id string, venue string, tokens bigint")
    assert {r["custom_id"]: r["part"] for r in exports.split_batches(table.repartition(5), "venue", 12, 4, block_rows).collect()} == expected
    assert exports.split_batches(table.where("tokens > 99"), "venue", 12, 4).count() == 0


def test_predictions_follow_their_dimension(spark):
    rows = spark.createDataFrame([("1", "please clarify it", "yes", ""), ("2", "the table", "yes", "We added it"), ("3", "fine", "yes", "will include more")], "id string, text string, label string, context string")
    found = {d: [r["predicted_label"] for r in adapters.generic(rows, "D", d, {"yes": ("gold", 0.5)}).orderBy("task_id").collect()] for d in ("actionability", "specificity", "substantiation", "rebuttal_robustness", "tone")}
    assert found["actionability"] == ["actionable", "not_actionable", "actionable"] and found["specificity"] == ["vague", "specific", "vague"]
    assert found["substantiation"] == ["unsubstantiated", "substantiated", "substantiated"] and found["tone"] == ["gold"] * 3
    assert found["rebuttal_robustness"] == ["not_addressed", "resolved_or_weakened", "partially_addresses"]


def test_samples_are_the_same_under_any_partitioning(spark):
    rows = spark.range(300).select(F.concat(F.lit("t"), "id").alias("task_id"), F.when(F.col("id") % 10 == 0, "survived").when(F.col("id") % 3 == 0, "partial").otherwise("not_found").alias("survival_label"))
    a, b = (sorted(r["task_id"] for r in sampling.balanced(rows.repartition(n), "survival_label", ("survived", "partial", "not_found"), 120, 7).collect()) for n in (1, 9))
    assert a == b and len(a) == 120


def test_adapters(spark):
    odd = spark.createDataFrame([("1", "text one", "Accept"), ("2", "", "reject"), ("3", "text three", "other")], "ID string, `Review-Comment` string, Stance string")
    found = adapters.generic(odd, "D", "stance", {"accept": ("resolved", 0.1), "reject": ("contested", 0.8)}).collect()
    assert [(r["task_id"], r["gold_label"], r["mapped_score"]) for r in found] == [("D:1", "resolved", 0.1)]
    lines = spark.createDataFrame([(1, "a\tB\tB-1\tReview\tg"), (2, "b\tI\tI-1\tReview\tg"), (3, "c\tB\tB-1\tReply\tg"), (4, "d\tO\tO\tReply\tg"), (5, "short")], "line_no int, line string")
    r = adapters.argument_pairs(lines).collect()
    assert [(x["pair"], x["review"], x["reply"], x["is_pair"]) for x in r] == [("1", "a b", "c", True)]


def test_works_are_rebuilt(spark):
    rows = spark.createDataFrame([(0, "w1", "T", {"b": [1], "a": [0, 2]}), (1, "w1", "other", {"z": [0]}), (0, "w2", " ", {"a": [0]}), (0, "w3", "U", {})], "ord int, work_id string, title string, inverted map<string, array<int>>")
    assert [(r["work_id"], r["title"], r["abstract"]) for r in files.works_table(rows).collect()] == [("w1", "T", "a b a")]


def test_entities_cut_before_their_semicolon(spark):
    """Titles that end inside an entity, as in the table of pages: what ``html.unescape`` says."""
    texts = ["<title>and&amp</title><style>", "oo&amp;&amp;&am</title>", "a&ampb &amp", "x &lt</b> &gt&quot &nbsp&middot"]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.unescaped("t").alias("u")).collect()
    assert [r["u"] for r in sorted(found, key=lambda r: r["i"])] == [html.unescape(t) for t in texts]


def test_evidence_deals_its_rows_by_paper_once(spark):
    """Best sections of own papers, with a paper of none and nulls; terms are not shuffled."""
    claim = [("k1", "p1", "robust baselines missing", "other"), ("k2", "p2", "robust baselines", "other"), ("k3", None, "robust", "other"), ("k4", "p1", "", "other")]
    section = [("p1", "a", "Body", "paper", "robust baselines here"), ("p1", "b", "Body", "paper", "nothing"), ("p1", "c", "Body", "paper", None), ("p3", "d", "Body", "paper", "robust")]
    claims_ = spark.createDataFrame(claim, "task_id string, paper_id string, claim_text string, claim_type string")
    sections = spark.createDataFrame(section, "paper_id string, section_id string, section string, source_type string, text string")
    found = retrieval.bm25_evidence(claims_, sections)
    assert [(r["task_id"], r["section_id"], r["rank"], r["matched"]) for r in found.collect()] == [("k1", "a", 1, 2)]
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1


def test_self_consistency_counts_labels_once(spark, sf_dir, tmp_path):
    """Odd lines come out as before, and lines are neither joined with their claim nor doubled for distinct labels."""
    from quorumlab.plans import report_plans

    rows = [(1, "A", 2), (1, "B", 1), (1, "A", 3), (2, "N", 1), (2, "N", 1), (3, None, 1), (3, "R", 2), (4, "R", 1), (4, "A", 1), (4, "R", 5)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_returnflag string, l_linenumber bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = report_plans.self_consistency(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(1, 3, 1, False), (2, 2, 2, True), (3, 2, 0, True), (4, 3, 1, False)]
    plan = report_plans.self_consistency(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Expand" not in plan
