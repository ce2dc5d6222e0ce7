"""Benchmarks, agreement rates, crosstabs and quality reports as one- or two-level aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlab.functions import text as T
from quorumlab.sources.files import staged


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, F.round(2 * p * r / (p + r), 4)).otherwise(0.0)


def share(n: Column, of: Column) -> Column:
    return F.when(of > 0, F.round(n / of, 4)).otherwise(0.0)


def per_label(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 of each label, from one confusion table.

    ``rows``: gold, predicted and the keys.
    """
    table = rows.groupBy(*keys, "gold", "predicted").agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(
        F.struct(F.col("gold").alias("label"), F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("bigint").alias("fp"), F.when(F.col("gold") != F.col("predicted"), F.col("n")).otherwise(0).alias("fn")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.when(F.col("gold") != F.col("predicted"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("bigint").alias("fn")),
    )
    counts = table.select(*keys, F.inline(sides)).groupBy(*keys, "label").agg(*(F.sum(k).alias(k) for k in ("tp", "fp", "fn")))
    counts = counts.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
    return counts.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def classification(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, majority baseline, balanced accuracy and macro F1, per key or overall."""
    labels = per_label(rows, keys).groupBy(*keys).agg(T.mean4("recall").alias("balanced_accuracy"), T.mean4("f1").alias("macro_f1"))
    gold = rows.groupBy(*keys, "gold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold") == F.col("predicted")).alias("hit"))
    base = gold.groupBy(*keys).agg(F.sum("n").alias("records"), F.round(F.sum("hit") / F.sum("n"), 4).alias("accuracy"), F.round(F.max("n") / F.sum("n"), 4).alias("majority_baseline"))
    return base.join(labels, list(keys)) if keys else base.withColumn("k", F.lit(0)).join(labels.withColumn("k", F.lit(0)), "k").drop("k")


def facet_accuracy(rows: DataFrame, facets: tuple[str, ...]) -> DataFrame:
    """Accuracy overall and by each facet, in one pass."""
    pairs = F.array(F.struct(F.lit("all").alias("facet"), F.lit("all").alias("value")), *(F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in facets))
    return rows.select("gold", "predicted", F.inline(pairs)).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("records"), T.rate(F.col("gold") == F.col("predicted")).alias("accuracy"))


def alignment(rows: DataFrame) -> DataFrame:
    """Per row precision, recall, F1, exact match and overlap of gold and predicted id sets."""
    gold, found = F.array_distinct("gold_ids"), F.array_distinct("predicted_ids")
    both = F.size(F.array_intersect("gold_ids", "predicted_ids"))
    p, r = share(both, F.size(found)), share(both, F.size(gold))
    rows = rows.withColumns({"precision": p, "recall": r, "any_overlap": both > 0, "exact_match": (F.size(gold) > 0) & (F.array_sort(gold) == F.array_sort(found))})
    return rows.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def guardrail(current: DataFrame, baseline: DataFrame, keys: list[str], metrics: tuple[str, ...], least: float, drop: float) -> DataFrame:
    """pass, fail or skipped for each metric against a minimum and a largest drop."""

    def long(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*keys, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in metrics))))

    rows = long(current, "now").join(long(baseline, "before"), [*keys, "metric"], "left")
    status = F.when(F.col("now") < least, "fail").when(F.col("before").isNull(), "skipped").when(F.round(F.col("before") - F.col("now"), 4) > drop, "fail").otherwise("pass")
    return rows.select(*keys, "metric", "now", "before", status.alias("status"))


def crosstab(rows: DataFrame, row: str, column: str) -> DataFrame:
    """Counts of each pair with the share inside its row."""
    pairs = rows.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    total = pairs.groupBy(row).agg(F.sum("n").alias("total"))
    return pairs.join(total, row).select(row, column, "n", share(F.col("n"), F.col("total")).alias("share"))


def pairwise_majority(judgments: DataFrame) -> DataFrame:
    """Winner of a strict majority of each (claim, pair), or unstable."""
    votes = judgments.groupBy("claim_id", "pair", "addressability", "winner").agg(F.count(F.lit(1)).alias("n"))
    rows = votes.groupBy("claim_id", "pair", "addressability").agg(F.sum("n").alias("judgments"), F.max(F.struct("n", "winner")).alias("top"))
    stable = F.when(F.col("top.n") >= F.floor(F.col("judgments") / 2) + 1, F.col("top.winner")).otherwise("unstable")
    return rows.select("claim_id", "pair", "addressability", "judgments", stable.alias("stable_winner"))


def tokens_of(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(chars / 4.0, 0).cast("bigint"))


def quality_report(papers: DataFrame, reviews: DataFrame, top: int = 20, tracked: int = 10_000) -> DataFrame:
    """Per venue: papers, reviews, reviews per paper with their histogram, empty texts, coverage and top decisions.

    ``papers``: venue, paper_id, decision, abstract. ``reviews``: venue, paper_id, review_text, rating_normalized,
    confidence_normalized. Papers without reviews count. The likely top decisions come from a sketch of frequent items
    (twice ``top`` of them, mergeable and of fixed size); their counts come from an exact second pass.
    """
    blank = T.clean_ws("review_text") == ""
    per = reviews.groupBy("venue", "paper_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(blank).alias("empty"), F.count("rating_normalized").alias("rated"), F.count("confidence_normalized").alias("sure")
    )
    decision = T.clean_ws("decision")
    known = F.when((decision != "") & (F.lower(decision) != "unknown"), decision)
    rows = papers.select("venue", "paper_id", known.alias("decision"), (T.clean_ws("abstract") != "").alias("abstract")).join(per, ["venue", "paper_id"], "left")
    rows = staged(rows.na.fill(0, ["n", "empty", "rated", "sure"]), "paper-quality")
    n, one = F.sum("n"), F.count(F.lit(1))
    rate = lambda x, of: F.when(of > 0, F.round(x / of, 4)).otherwise(0.0)
    out = rows.groupBy("venue").agg(
        one.alias("papers"), n.alias("reviews"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(n / one, 3).alias("mean_reviews"),
        rate(F.sum("empty"), n).alias("empty_rate"), rate(F.sum("rated"), n).alias("rating_coverage"), rate(F.sum("sure"), n).alias("confidence_coverage"),
        rate(F.count("decision"), one).alias("decision_coverage"), rate(F.count_if("abstract"), one).alias("abstract_coverage"),
    )
    sizes = rows.groupBy("venue", "n").agg(one.alias("papers"))
    bars = F.transform(F.array_sort(F.collect_list(F.struct("n", "papers"))), lambda b: F.concat_ws(":", b["n"], b["papers"]))
    histogram = sizes.groupBy("venue").agg(F.array_join(bars, ",").alias("histogram"))
    likely = rows.where("decision IS NOT NULL").groupBy("venue").agg(F.expr(f"approx_top_k(decision, {2 * top}, {tracked})").alias("items"))
    likely = likely.select("venue", F.inline("items")).select("venue", F.col("item").alias("decision"))
    exact = rows.join(likely, ["venue", "decision"], "left_semi").groupBy("venue", "decision").agg(one.alias("held"))  # a bounded list a venue
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("held")).alias("order"), "decision", "held"))), 1, top)
    decisions = exact.groupBy("venue").agg(F.array_join(F.transform(ranked, lambda d: F.concat_ws(":", d["decision"], d["held"])), ",").alias("top_decisions"))
    return out.join(histogram, "venue").join(decisions, "venue", "left").withColumn("top_decisions", F.coalesce("top_decisions", F.lit("")))


def quality_gate(report: DataFrame, papers: int = 100, reviews: int = 120, empty_rate: float = 0.05) -> DataFrame:
    """pass or fail of each venue of a ``quality_report``."""
    gate = lambda bad, name: F.when(bad, "fail").otherwise("pass").alias(name)
    return report.select("venue", gate(F.col("papers") < papers, "paper_gate"), gate(F.col("reviews") < reviews, "review_gate"), gate(F.col("empty_rate") > empty_rate, "empty_gate"))
