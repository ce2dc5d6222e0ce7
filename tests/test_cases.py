"""Case retrieval in blocks against all pairs."""

import collections
import math
import random

import pytest

from quorumlab.operators import retrieval


def best_of_all_pairs(rows, k):
    """{query: [(case, score)]} by weighing every pair."""
    bags = {c: collections.Counter(t.split()) for c, _, _, t in rows}
    found = {}
    for q, paper, kind, _ in rows:
        others = [r for r in rows if r[1] != paper]
        mean = max(sum(sum(bags[r[0]].values()) for r in others) / max(len(others), 1), 1.0)
        scores = []
        for c, _, own, _ in others:
            raw, met = 0.0, False
            for term in bags[q]:
                tf, df = bags[c][term], sum(term in bags[r[0]] for r in others)
                if tf:
                    met = True
                    raw += math.log(1 + (len(others) - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * sum(bags[c].values()) / mean))
            if met:
                scores.append((-round(raw + (0.18 if own == kind else 0), 4), c))
        if scores:
            found[q] = [(c, -s) for s, c in sorted(scores)[:k]]
    return found


@pytest.mark.parametrize("rare, block_rows, held", [(3, 131_072, 2_000_000), (1, 40, 60), (2, 25, 1)])
def test_case_retrieval_equals_all_pairs(spark, monkeypatch, rare, block_rows, held):
    monkeypatch.setattr(retrieval, "HELD", held)
    rng = random.Random(7)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(60)]
    texts = [" ".join(words[min(int(rng.expovariate(0.08)), 59)] for _ in range(rng.randint(0, 9))) for _ in range(90)]
    texts[10:14] = ["copied waax wbax wcax"] * 4  # equal cases, more than k
    rows = [(f"c{i:03}", f"p{i // 3}", rng.choice(["x", "y", None]), t) for i, t in enumerate(texts)]
    cases = spark.createDataFrame([(*r, "l") for r in rows], "case_id string, paper_id string, claim_type string, text string, label string")
    found = {}
    for r in sorted(retrieval.case_retrieval(cases, 3, rare, block_rows=block_rows).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["case_id"], r["score"]))
    expected = best_of_all_pairs([(c, p, t or object(), x) for c, p, t, x in rows], 3)  # types that are null are equal to none
    assert {q: [c for c, _ in v] for q, v in found.items()} == {q: [c for c, _ in v] for q, v in expected.items()}
    assert all(s == pytest.approx(e, abs=1e-9) for q in found for (_, s), (_, e) in zip(found[q], expected[q]))


def test_no_pairs_of_cases_are_shuffled_or_staged(spark, monkeypatch):
    labels, staged = [], retrieval.staged
    monkeypatch.setattr(retrieval, "staged", lambda df, label: (labels.append(label), staged(df, label))[1])
    cases = spark.createDataFrame([(f"c{i}", f"p{i}", "x", "alpha beta", "l") for i in range(20)], "case_id string, paper_id string, claim_type string, text string, label string")
    rows = retrieval.case_retrieval(cases)
    assert rows.count() == 100 and "case-pairs" not in labels
    assert "SortMergeJoin" not in (plan := rows._jdf.queryExecution().optimizedPlan().toString()) and "Join" not in plan
