"""Two-ended cuts, chance rates, JSON walks, entities, substring search, consensus and bounded memory search."""

import html
import html.entities
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quorumlab.functions import text as T
from quorumlab.operators import audit, extremes, inventory, lifecycle, matching, reports, retrieval, search


@pytest.mark.parametrize("parts, held", [(1, 50_000), (7, 3)])
def test_both_ends_equal_sorting(spark, monkeypatch, parts, held):
    monkeypatch.setattr(extremes, "HELD", held)
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randint(-5, 5) / 2 if rng.random() < 0.95 else None, f"t{i:03}", i) for i in range(400)] + [("few", 1.0, "x", -1)]
    df = spark.createDataFrame(rows, "g string, v double, t string, n int").repartition(parts)
    found = {}
    for r in extremes.two_ended(df, ["g"], "v", ["t"], lowest=3, highest=4).collect():
        found.setdefault((r["g"], r["end"]), []).append((r["place"], r["v"], r["t"], r["n"]))
    for g in ("a", "b", None, "few"):
        own = [r for r in rows if r[0] == g and r[1] is not None]
        low = [(i + 1, *r[1:]) for i, r in enumerate(sorted(own, key=lambda r: (r[1], r[2]))[:3])]
        high = [(i + 1, *r[1:]) for i, r in enumerate(sorted(own, key=lambda r: (-r[1], r[2]))[:4])]
        assert sorted(found[g, "lowest"]) == low and sorted(found[g, "highest"]) == high
    plan = extremes.two_ended(df, ["g"], "v", ["t"], lowest=3)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Window" not in plan
    assert extremes.two_ended(df.where("false"), ["g"], "v", ["t"], lowest=1).count() == 0


@pytest.mark.parametrize("n, p", [(0, 0), (1, 0), (1, 1), (10, 3), (10, 10), (4, 1), (5000, 7)])
def test_chance_is_hypergeometric(spark, n, p):
    row = spark.range(1).select(*(retrieval.chance(F.lit(p).cast("bigint"), F.lit(n).cast("bigint"), k).alias(str(k)) for k in (1, 3, 5))).first()
    for k in (1, 3, 5):
        draws = min(k, n)
        exact = 0.0 if not n or not p else 1 - math.comb(n - p, draws) / math.comb(n, draws)
        assert row[str(k)] == pytest.approx(exact, abs=1e-12)


def paths(value, at=""):
    steps = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for key, child in steps:
        here = f"{at}[{key}]" if isinstance(value, list) else f"{at}.{key}" if at else key
        yield here
        yield from paths(child, here)


def test_json_is_walked_to_any_depth(spark):
    deep = {"papers": [{"paper_id": 1, "reviews": [{"review_id": "a", "odd": 1}, 5, None], "x": {"BODY": [{"Sections": {}}]}}, "no paper"], "a": {"b": [[{"pdf_url": None}]]}}
    nested = {"k": 1}
    for _ in range(30):
        nested = {"n": [nested]}
    files = {"deep": json.dumps(deep), "nested": json.dumps(nested), "bad": "{no", "empty": "{}", "number": "3", "none": None}
    df = spark.createDataFrame(list(files.items()), "file string, json string")
    found = {}
    for r in audit.walked(df).collect():
        found.setdefault(r["file"], []).append(r["at"])
    assert sorted(found.get("deep")) == sorted(paths(deep)) and sorted(found["nested"]) == sorted(paths(nested)) and set(found) == {"deep", "nested"}
    rows = {r["file"]: r for r in audit.normalized_files(df).collect()}
    assert rows["deep"]["forbidden_paths"] == "a.b[0][0].pdf_url;papers[0].x.BODY;papers[0].x.BODY[0].Sections"
    assert (rows["deep"]["paper_count"], rows["deep"]["review_count"], rows["deep"]["paper_extra_keys"], rows["deep"]["review_extra_keys"]) == (1, 3, "x", "odd")
    assert [rows[f]["status"] for f in ("deep", "nested", "bad", "empty", "none")] == ["failed", "ok", "unreadable", "ok", "unreadable"]


def test_all_entities_are_resolved(spark):
    names = list(html.entities.html5)
    texts = [f"a &{k} b" for k in names] + [f"&{k}x" for k in names] + [f"&#{n};&#x{n:X}z" for n in (*range(300), 8364, 128512, 0xD800, 0xFDD0, 0x1FFFF, 0x110000, 10**15)]
    texts += ["&", "&&amp;", "&notit;", "&copy", "& amp;", "&#;", "&#x;", "&unknown; &amp;lt;", "x&ampy", "&" + "a" * 40 + ";", "plain", "", "&#x1F600", "&amp"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.unescaped("t").alias("u")).collect()
    assert [ascii(r["t"]) for r in rows if r["u"] != html.unescape(r["t"])] == []


PAPERS = "paper_id string, forum_id string, title string, venue string, year int"


def test_pages_add_up_to_the_whole(spark):
    rng = random.Random(6)
    words = ["Deep", "deeper", "NETS", "of", "a%b", "x_y", "Ünï", ""]
    rows = [(f"p{i}", f"F{i % 7}", None if i % 19 == 0 else " ".join(rng.choices(words, k=3)), f"v{i % 2}", None if i % 11 == 0 else 2000 + i % 4) for i in range(120)]
    papers = spark.createDataFrame(rows, PAPERS)
    index = search.trigram_index(papers)

    def key(r):
        return (r[4] is None, -(r[4] or 0), r[2] is not None, r[2] or "", r[0])

    for needle, venue, year in (("dEEp", None, None), ("%", None, None), ("x", "v1", None), ("f3", None, 2001), ("ünï", None, None), ("", "v0", 2002), ("ts of", None, None), ("zzz", None, None)):
        low = needle.lower()
        whole = [r for r in sorted(rows, key=key) if any(low in (r[i] or "").lower() for i in range(3)) and venue in (None, r[3]) and year in (None, r[4])]
        got, cursor, pages = [], "", 0
        while cursor is not None:
            page, cursor = search.search_papers(papers, index, needle=needle, venue=venue, year=year, limit=17, cursor=cursor)
            got += [r["paper_id"] for r in page.orderBy("place").collect()]
            pages += 1
        assert got == [r[0] for r in whole] and pages == max(1, -(-len(whole) // 17)), needle
    assert "PushedFilters: [In(gram" in search.holding(index, "deep")._jdf.queryExecution().executedPlan().toString()


def test_consensus_equals_comparing_all_pairs(spark):
    rng = random.Random(11)
    words = ["baseline", "novelty", "missing", "proof", "theory", "figure", "unclear", "dataset", "tiny", "method"]
    rows = []
    for i in range(60):
        paper, review = f"p{i % 3}", f"r{i % 3}-{rng.randint(0, 3)}"
        rows.append((f"t{i:02}", paper, review, rng.choice(["a", "b", ""]), i % 4, i, " ".join(rng.choices(words, k=rng.randint(0, 4)))))
    claims = spark.createDataFrame(rows, "task_id string, paper_id string, review_id string, claim_type string, turn int, claim_index int, claim_text string")
    claims = claims.withColumns({"source_sentence": F.col("claim_text"), "source_field": F.lit("weaknesses"), "importance": F.lit("major")})
    found = {r["task_id"]: (r["consensus_score"], r["matched_review_id"]) for r in matching.consensus(claims).collect()}
    tokens = {r["task_id"]: r["tokens"] for r in matching.prepared(claims).collect()}
    sizes = spark.createDataFrame([(a[0], b[0], tokens[a[0]], tokens[b[0]], a[3] == b[3] != "", b[4], b[5], b[2]) for a in rows for b in rows if a[1] == b[1] and a[2] != b[2] and tokens[a[0]]], "a string, b string, x array<string>, y array<string>, same boolean, turn int, i int, r string")
    scored = sizes.select("a", F.least(F.lit(1.0), T.overlap_score(F.col("x"), F.col("y")) + F.when(F.col("same"), 0.05).otherwise(0.0)).alias("s"), "turn", "i", "r").where("s > 0").collect()
    best = {}
    for r in scored:
        rank = (r["s"], -r["turn"], -r["i"], r["r"])
        best[r["a"]] = max(best.get(r["a"], rank), rank)
    for task, *_ in rows:
        assert found[task] == ((round(best[task][0], 4), best[task][3]) if task in best else (0.0, "")), task


@pytest.mark.parametrize("seed, k", [(1, 2), (2, 5)])
def test_memory_search_equals_comparing_all(spark, seed, k):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i)}{chr(97 + j)}x" for i in range(9) for j in range(9)]
    text = lambda n: " ".join(rng.choices(words[: rng.choice([6, 81])], k=n))
    memory = [(f"m{i}", i, rng.choice("uvw"), text(rng.choice([0, 1, 4, 30, 90])), rng.randint(0, 3) / 2) for i in range(150)]
    memory += [(f"c{i}", 500 + i, "u", memory[3][3], 1.0) for i in range(40)]
    queries = [(q, text(rng.choice([0, 1, 5, 20]))) for q in range(12)]
    m = spark.createDataFrame([(*r, "g") for r in memory], "memory_id string, ord int, dimension string, input_text string, mapped_score double, gold_label string")
    q = spark.createDataFrame(queries, "query_id int, query_text string")
    found = {(r["query_id"], r["dimension"], r["rank"]): (r["memory_id"], r["similarity"]) for r in retrieval.memory_topk(q, m, k).collect()}
    expected = {}
    for query, said in queries:
        own = set(said.split())
        for d in "uvw" if own else "":
            scored = []
            for name, at, dim, body, score in memory:
                if dim == d:
                    both = set(body.split())
                    scored.append((-round(len(own & both) / len(own | both), 4), -score, at, name))
            for place, row in enumerate(sorted(scored)[:k]):
                expected[query, d, place + 1] = (row[3], -row[0])
    assert found.keys() == expected.keys()
    assert [v for v in expected if found[v][0] != expected[v][0] or found[v][1] != pytest.approx(expected[v][1])] == []


def test_flags_of_an_inventory(spark):
    note = "paper_id string, pos int, note_type string, signer_role string, created_ms bigint, modified_ms bigint, text string, comment_text string, decision string, rating_normalized double, confidence_normalized double"
    rows = [
        ("a", 0, "official_review", "reviewer", 1, 9, "t", "", None, None, 4.0), ("a", 1, "author_response", "authors", 5, 5, "t", "", None, None, None),
        ("a", 2, "official_comment", "authors", 6, 6, "t", "", None, None, None), ("a", 3, "decision", "program_chair", 7, 7, " no ", "", "", None, None),
        ("b", 0, "official_comment", "area_chair", None, None, None, None, None, None, None),
    ]
    papers = spark.createDataFrame([("a",), ("b",), ("c",)], "paper_id string")
    found = {r["paper_id"]: r for r in inventory.paper_inventory(papers, spark.createDataFrame(rows, note)).collect()}
    names = lambda mask: {n for i, n in enumerate(inventory.NAMES) if mask >> i & 1}
    assert names(found["a"]["mask"]) == {
        "has_reviews", "has_confidence", "has_author_response", "has_decision_note", "has_decision_label", "has_official_comments", "has_post_rebuttal_review_update",
        "claim_grounding", "rebuttal_alignment", "post_rebuttal_review_update_proxy", "confidence_calibration",
    }
    assert names(found["b"]["mask"]) == {"has_official_comments", "has_reviewer_or_ac_discussion"} and found["c"]["mask"] == 0
    assert (found["a"]["decision"], found["c"]["decision"]) == ("no", "Unknown")
    report = {r["flag"]: r for r in inventory.inventory_report(spark.createDataFrame([(m,) for m in [1 << 21] * 1 + [0] * 9], "mask int")).collect()}
    assert report["post_rebuttal_review_update_proxy"]["status"] == "limited" and report["claim_grounding"]["status"] == "not_available"


def test_quality_of_venues(spark):
    papers = spark.createDataFrame([("v", "a", "Accept", "x"), ("v", "b", "unknown", " "), ("v", "c", "Accept", ""), ("v", "d", "Reject", "y")], "venue string, paper_id string, decision string, abstract string")
    reviews = spark.createDataFrame([("v", "a", "t", 1.0, None), ("v", "a", " ", None, None), ("v", "b", "t", 2.0, 3.0)], "venue string, paper_id string, review_text string, rating_normalized double, confidence_normalized double")
    row = reports.quality_report(papers, reviews).first()
    assert (row["papers"], row["reviews"], row["least"], row["most"], row["histogram"], row["top_decisions"]) == (4, 3, 0, 2, "0:2,1:1,2:1", "Accept:2,Reject:1")
    assert (row["decision_coverage"], row["abstract_coverage"], row["empty_rate"]) == (0.75, 0.5, 0.3333)


def test_runs_of_one_task(spark):
    names = ["task_id", "robustness", "robustness_label", *(f"s_{k}" for k in lifecycle.WEIGHTS)]
    run = lambda rows: spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n in ('task_id', 'robustness_label') else 'double'}" for n in names))
    left = run([("a", 0.5, "low", *[0.0] * 6), ("b", 0.5, "low", *[0.0] * 6), ("only", 0.1, "low", *[0.0] * 6)])
    right = run([("a", 0.9, "high", *[0.5] * 6), ("b", 0.4, "low", *[0.1] * 6)])
    rows = {(r["section"], r["name"], r["place"]): (r["n"], r["value"]) for r in lifecycle.compared(left, right).collect()}
    assert rows["highest", "a", 1] == (1, 0.4) and rows["lowest", "b", 1] == (1, -0.1) and rows["changed", "labels", None] == (1, 0.5)
    assert rows["all", "all", None] == (2, 0.15) and rows["signal", "meta", None] == (2, 0.3) and rows["transition", "low->low", None] == (1, -0.1)
