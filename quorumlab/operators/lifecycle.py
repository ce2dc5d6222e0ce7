"""Claim robustness from six signals, review calibration and corpus summaries."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlab.functions import lexicons as L
from quorumlab.functions import text as T
from quorumlab.operators import extremes
from quorumlab.sources.files import staged

WEIGHTS = {"grounding": 0.15, "specificity": 0.15, "consensus": 0.18, "rebuttal": 0.25, "discussion": 0.07, "meta": 0.20}
MODES = ("deterministic_proxy", "consensus_labels", "rebuttal_labels", "all_labels")


def specificity(tokens: Column | None = None) -> Column:
    """From the claim's tokens (or those given), anchors, action words and vagueness."""
    text, tokens = T.clean_text("claim_text"), T.concern_tokens("claim_text") if tokens is None else tokens
    n = F.size(tokens)
    score = (
        F.least(F.lit(1.0), n / F.lit(18.0))
        + F.when(F.arrays_overlap(tokens, T.words_of(L.SPECIFIC_ANCHORS)), 0.15).otherwise(0.0)
        + F.when(F.lower(text).rlike(L.SPECIFIC_ACTIONS), 0.15).otherwise(0.0)
        - F.when((n < 6) | F.lower(text).isin(*L.VAGUE_TEXTS), 0.2).otherwise(0.0)
    )
    return F.when(n == 0, F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4))


def consensus_signal(use_label: Column) -> Column:
    label, proxy = F.col("consensus_label"), F.col("consensus_proxy")
    by_label = F.when(label == "same_concern", 1.0).when(label == "related_but_different", 0.55).when(label == "not_same_concern", 0.0).otherwise(0.25)
    by_proxy = F.when(proxy == "strong", 1.0).when(proxy == "partial", 0.55).otherwise(0.0)
    return F.when(use_label & label.isNotNull(), by_label).otherwise(by_proxy)


def rebuttal_signal(use_label: Column) -> Column:
    response, effect, proxy = F.col("response_label"), F.col("effect_label"), F.col("rebuttal_label")
    by_label = (
        F.when((effect == "resolved_or_weakened") | (response == "likely_resolved"), 0.0)
        .when((response == "specifically_addressed") | (effect == "partially_addresses"), 0.55)
        .when(response == "generic_or_unclear", 0.75)
        .when(effect == "unclear", 0.45)
        .when((response == "not_addressed") | (effect == "does_not_address"), 0.85)
        .otherwise(0.45)
    )
    by_proxy = F.when(proxy == "likely_resolved_or_answered", 0.15).when(proxy == "addressed_unclear_resolution", 0.55).when(proxy == "not_addressed", 0.70).otherwise(0.45)
    return F.when(use_label & (response.isNotNull() | effect.isNotNull()), by_label).otherwise(by_proxy)


def meta_signal(label: Column) -> Column:
    return F.when(label == "survived", 1.0).when(label == "partial", 0.60).otherwise(0.0)


def robustness_label(score: Column) -> Column:
    return F.when(score >= 0.72, "high").when(score >= 0.45, "medium").otherwise("low")


def scored(rows: DataFrame, consensus: Column, rebuttal: Column, meta: Column | None = None) -> DataFrame:
    """``rows`` (claim signals, labels may be null) with the six signal scores, robustness and label.

    ``consensus`` and ``rebuttal`` tell where labels replace the proxies; ``meta`` the meta-review label used.
    """
    return weighed(with_texts(rows), consensus, rebuttal, meta)


def with_texts(rows: DataFrame) -> DataFrame:
    """The two signals that read texts; no label mode changes them."""
    tokens = F.col("tokens") if "tokens" in rows.columns else None
    return rows.withColumns({"s_grounding": F.when(T.clean_text("source_sentence") != "", 1.0).otherwise(0.0), "s_specificity": specificity(tokens)})


def weighed(rows: DataFrame, consensus: Column, rebuttal: Column, meta: Column | None = None) -> DataFrame:
    signal = {
        "consensus": consensus_signal(consensus),
        "rebuttal": rebuttal_signal(rebuttal),
        "discussion": F.when(F.col("discussion_label") == "followed_up", 0.70).otherwise(0.0),
        "meta": meta_signal(F.col("survival_label") if meta is None else meta),
    }
    rows = rows.withColumns({f"s_{k}": v for k, v in signal.items()})
    total = sum((F.lit(w) * F.col(f"s_{k}") for k, w in WEIGHTS.items()), F.lit(0.0))
    rows = rows.withColumn("robustness", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4))
    return rows.withColumn("robustness_label", robustness_label(F.col("robustness")))


def factors(rows: DataFrame) -> DataFrame:
    """Reasons that support and weaken a scored claim."""

    def named(**conditions: Column) -> Column:
        return F.array_compact(F.array(*(F.when(v, k) for k, v in conditions.items())))

    return rows.withColumns(
        {
            "supporting": named(
                grounded_in_original_review=F.col("s_grounding") == 1,
                supported_or_overlapped_by_other_reviewers=F.col("s_consensus") >= 0.55,
                not_resolved_by_author_response=F.col("s_rebuttal") >= 0.70,
                followed_up_after_rebuttal=F.col("s_discussion") > 0,
                taken_up_in_meta_review=F.col("s_meta") >= 0.60,
            ),
            "weakening": named(
                not_grounded_in_original_review=F.col("s_grounding") == 0,
                no_inter_reviewer_support_found=F.col("s_consensus") == 0,
                author_response_likely_resolved_or_weakened_claim=F.col("s_rebuttal") <= 0.15,
                not_found_in_meta_review=F.col("s_meta") == 0,
            ),
        }
    )


def with_labels(signals: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join of labels; of repeated labels of a task the last one counts."""
    last = labels.groupBy("task_id").agg(F.max(F.struct(*(c for c in labels.columns if c != "task_id"))).alias("l"))
    return signals.join(last.select("task_id", "l.*"), "task_id", "left")


def by_mode(rows: DataFrame) -> DataFrame:
    """Every claim scored under each label mode, in one pass; texts are read before rows multiply."""
    modes = with_texts(rows).withColumn("mode", F.explode(T.words_of(MODES)))
    return weighed(modes, F.col("mode").isin("consensus_labels", "all_labels"), F.col("mode").isin("rebuttal_labels", "all_labels"))


def summarized(rows: DataFrame, key: str) -> DataFrame:
    """Counts, mean, exact median and label counts of robustness by a key."""
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("claim_count"),
        F.countDistinct("paper_id").alias("paper_count"),
        F.countDistinct("review_id").alias("review_count"),
        F.round(F.avg("robustness"), 4).alias("mean_score"),
        F.round(F.percentile("robustness", F.lit(0.5)), 4).alias("median_score"),
        *(F.count_if(F.col("robustness_label") == x).alias(f"{x}_count") for x in ("high", "medium", "low")),
        *(F.round(F.avg(f"s_{k}"), 4).alias(f"mean_{k}") for k in WEIGHTS),
    )


def importance_weight() -> Column:
    low = F.lower(F.coalesce("importance", F.lit("")))
    return F.when(low == "major", 1.0).when(low == "medium", 0.75).when(low == "minor", 0.45).when(low == "question", 0.35).otherwise(0.6)


def three_way(column: str, full: str) -> Column:
    return F.when(F.col(column) == full, 1.0).when(F.col(column) == "partial", 0.65).otherwise(0.0)


def reliability(grounded: Column, specific: Column, agreed: Column, taken: Column, resolved: Column, gap: Column, confidence: Column) -> Column:
    calibration = F.when(gap.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1.0 - F.least(F.abs(gap), F.lit(4.0)) / 4.0))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence / 10.0))
    alignment = F.when(confidence.isNull(), 0.5).otherwise(1.0 - F.abs(sure - (0.35 + 0.65 * ((specific + agreed + taken) / 3))))
    score = 0.2 * grounded + 0.2 * specific + 0.2 * agreed + 0.2 * taken + 0.1 * (1.0 - resolved) + 0.05 * calibration + 0.05 * alignment
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


def calibrated_reviews(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per review: claim rates, severity, expected rating, gap, reliability and labels.

    ``rows``: scored claims; ``reviews``: review_id, rating_normalized, confidence_normalized.
    """
    severity = importance_weight() * (
        0.25 * F.col("s_specificity")
        + 0.25 * three_way("consensus_proxy", "strong")
        + 0.35 * three_way("survival_label", "survived")
        + 0.15 * F.when(F.col("rebuttal_label") == "likely_resolved_or_answered", 0.0).otherwise(1.0)
    )
    labelled, answered = F.col("consensus_label").isNotNull(), F.col("effect_label").isNotNull()
    claims = rows.withColumn("severity", severity)
    per = claims.groupBy("paper_id", "review_id").agg(
        F.count(F.lit(1)).alias("claim_count"),
        T.rate(F.col("s_grounding") == 1).alias("grounded_rate"),
        T.mean4("s_specificity").alias("specificity"),
        T.rate(F.col("consensus_proxy").isin("strong", "partial")).alias("consensus_rate"),
        F.count_if(labelled).alias("labelled_consensus"),
        T.rate(F.col("consensus_label").isin("same_concern", "related_but_different"), labelled).alias("label_consensus_rate"),
        T.rate(F.col("survival_label").isin("survived", "partial")).alias("meta_uptake_rate"),
        T.rate(F.col("rebuttal_label") != "not_addressed").alias("rebuttal_addressed_rate"),
        T.rate(F.col("rebuttal_label") == "likely_resolved_or_answered").alias("rebuttal_resolved_rate"),
        F.count_if(answered).alias("labelled_rebuttal"),
        T.rate(F.col("effect_label") == "resolved_or_weakened", answered).alias("label_resolved_rate"),
        T.rate(F.col("discussion_label") == "followed_up").alias("followup_rate"),
        T.mean4("robustness").alias("mean_robustness"),
        T.rate(F.col("robustness_label") == "high").alias("high_rate"),
        # the four largest: a review has tens of claims at most
        F.slice(F.sort_array(F.collect_list("severity"), asc=False), 1, 4).alias("top"),
    )
    total = F.aggregate("top", F.lit(0.0), lambda a, x: a + x)
    per = per.withColumn("severity", F.round(total / F.size("top"), 4)).drop("top").join(reviews, "review_id", "left")
    per = per.withColumn("expected_rating", F.round(F.greatest(F.lit(1.0), F.least(F.lit(10.0), 8.5 - 6.0 * F.col("severity"))), 3))
    per = per.withColumn("rating_gap", F.round(F.col("rating_normalized") - F.col("expected_rating"), 3))
    gap, sure = F.col("rating_gap"), F.col("confidence_normalized")
    common = (F.col("grounded_rate"), F.col("specificity"))
    per = per.withColumn("reliability", reliability(*common, F.col("consensus_rate"), F.col("meta_uptake_rate"), F.col("rebuttal_resolved_rate"), gap, sure))
    agreed = F.when(F.col("labelled_consensus") > 0, F.col("label_consensus_rate")).otherwise(F.col("consensus_rate"))
    resolved = F.when(F.col("labelled_rebuttal") > 0, F.col("label_resolved_rate")).otherwise(F.col("rebuttal_resolved_rate"))
    per = per.withColumn("calibrated_reliability", reliability(*common, agreed, F.col("meta_uptake_rate"), resolved, gap, sure))
    score = F.col("reliability")
    return per.withColumns(
        {
            "rating_label": F.when(gap.isNull(), "rating_missing").when(gap <= -1.5, "harsher_than_claim_signals").when(gap >= 1.5, "more_lenient_than_claim_signals").otherwise("calibrated_to_claim_signals"),
            "confidence_label": F.when(sure.isNull(), "confidence_missing").when((sure / 10 >= 0.75) & (score < 0.45), "possibly_overconfident").when((sure / 10 <= 0.45) & (score >= 0.65), "possibly_underconfident").otherwise("confidence_reasonable"),
            "style_label": F.when(gap <= -1.5, "over_harsh_proxy").when(gap >= 1.5, "over_lenient_proxy").when((sure >= 7.5) & (score < 0.45), "confident_but_low_signal_proxy").when(score >= 0.65, "high_signal_review").otherwise("mixed_signal_review"),
        }
    )


def compared(left: DataFrame, right: DataFrame, examples: int = 8) -> DataFrame:
    """Two scored runs joined on the task, as rows of sections.

    ``all`` and each ``transition`` of labels: tasks and mean, median and mean absolute difference. ``changed``: tasks of
    another label and their share. ``signal``: the mean difference of each. ``lowest`` and ``highest``: the tasks of the
    largest drops and gains, by place.
    """
    signals = [f"s_{k}" for k in WEIGHTS]
    a = left.select("task_id", F.col("robustness").alias("a"), F.col("robustness_label").alias("la"), *(F.col(s).alias(f"a{s}") for s in signals))
    b = right.select("task_id", F.col("robustness").alias("b"), F.col("robustness_label").alias("lb"), *(F.col(s).alias(f"b{s}") for s in signals))
    deltas = [F.round(F.col(f"b{s}") - F.col(f"a{s}"), 4).alias(s) for s in signals]
    rows = a.join(b, "task_id").select("task_id", "la", "lb", F.round(F.col("b") - F.col("a"), 4).alias("delta"), *deltas)
    rows = staged(rows, "run-deltas")

    def measured(grouped):
        return grouped.agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.avg("delta"), 4).alias("value"),
            F.round(F.percentile("delta", F.lit(0.5)), 4).alias("median"),
            F.round(F.avg(F.abs("delta")), 4).alias("mean_abs"),
        )

    def section(df: DataFrame, name: str) -> DataFrame:
        kinds = {"name": "string", "place": "int", "n": "bigint", "value": "double", "median": "double", "mean_abs": "double"}
        return df.select(F.lit(name).alias("section") if name else F.col("section"), *((F.col(c) if c in df.columns else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()))

    changed = F.col("la") != F.col("lb")
    means = F.array(*(F.struct(F.lit(k).alias("name"), F.col(f"m_{k}").alias("value")) for k in WEIGHTS))
    by_signal = rows.agg(F.count(F.lit(1)).alias("n"), *(T.mean4(f"s_{k}").alias(f"m_{k}") for k in WEIGHTS)).select("n", F.inline(means))
    ends = extremes.two_ended(rows.select(F.lit(0).alias("g"), "task_id", "delta"), ["g"], "delta", ["task_id"], lowest=examples, highest=examples)
    parts = [
        section(measured(rows.groupBy()).withColumn("name", F.lit("all")), "all"),
        section(measured(rows.groupBy(F.concat_ws("->", "la", "lb").alias("name"))), "transition"),
        section(rows.agg(F.count_if(changed).alias("n"), T.rate(changed).alias("value")).withColumn("name", F.lit("labels")), "changed"),
        section(by_signal, "signal"),
        section(ends.select(F.col("end").alias("section"), F.col("task_id").alias("name"), "place", F.lit(1).cast("bigint").alias("n"), F.col("delta").alias("value")), ""),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def calibration_report(reviews: DataFrame, claims: DataFrame, examples: int = 8) -> DataFrame:
    """Means of calibrated reviews, overall and by style and rating, and examples of reviews and claims, by section.

    ``lowest`` and ``highest``: the reviews of least and largest reliability. ``rebuttal_resolved``, ``consensus``,
    ``high_robustness`` and ``low_robustness``: the first claims of each kind. ``reviews``: ``calibrated_reviews``.
    """
    reviews, claims = staged(reviews, "calibrated-reviews"), staged(claims.select("task_id", "robustness", "robustness_label", "rebuttal_label", "consensus_proxy"), "calibrated-claims")
    counts = [
        F.count(F.lit(1)).alias("review_count"),
        F.sum("claim_count").alias("claim_count"),
        F.round(F.avg("reliability"), 4).alias("reliability"),
        F.round(F.avg("calibrated_reliability"), 4).alias("calibrated_reliability"),
        F.round(F.avg("severity"), 4).alias("severity"),
    ]
    numbers = ["review_count", "claim_count", "reliability", "calibrated_reliability", "severity"]
    facts = ["review_id", "style_label", "rating_label", "claim_count", "reliability", "calibrated_reliability", "severity"]
    ends = extremes.two_ended(reviews.select(F.lit(0).alias("g"), *facts), ["g"], "reliability", ["review_id"], lowest=examples, highest=examples)
    kinds = F.filter(
        F.array(
            F.when(F.col("rebuttal_label") == "likely_resolved_or_answered", F.lit("rebuttal_resolved")),
            F.when(F.col("consensus_proxy").isin("strong", "partial"), F.lit("consensus")),
            F.when(F.col("robustness_label") == "high", F.lit("high_robustness")),
            F.when(F.col("robustness_label") == "low", F.lit("low_robustness")),
        ),
        lambda k: k.isNotNull(),
    )
    some = claims.select(F.explode(kinds).alias("section"), F.lit(0).alias("first"), "task_id", "robustness", "robustness_label")
    some = extremes.two_ended(some, ["section"], "first", ["task_id"], lowest=examples)
    none, zero = F.lit(None).cast("string"), F.lit(None).cast("int")
    groups = reviews.groupBy("style_label", "rating_label").agg(*counts)
    total = reviews.groupBy().agg(*counts)
    parts = [
        total.select(F.lit("all").alias("section"), none.alias("name"), zero.alias("place"), none.alias("style_label"), none.alias("rating_label"), *numbers),
        groups.select(F.lit("group").alias("section"), none.alias("name"), zero.alias("place"), "style_label", "rating_label", *numbers),
        ends.select(F.col("end").alias("section"), F.col("review_id").alias("name"), "place", "style_label", "rating_label", F.lit(1).cast("bigint").alias("review_count"), *numbers[1:]),
        some.select("section", F.col("task_id").alias("name"), "place", F.col("robustness_label").alias("style_label"), none.alias("rating_label"), F.lit(0).cast("bigint").alias("review_count"), F.lit(1).cast("bigint").alias("claim_count"), F.col("robustness").alias("reliability"), F.lit(None).cast("double").alias("calibrated_reliability"), F.lit(None).cast("double").alias("severity")),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def survival_report(claims: DataFrame, papers: DataFrame, examples: int = 12) -> DataFrame:
    """Survival counts and rates overall and by type, importance, field and decision, and the first claims of each label.

    ``claims``: task_id, paper_id, claim_type, importance, source_field, survival_label. ``papers``: paper_id, decision
    (of all papers, with claims or without). Decisions without claims have no row.
    """
    papers = papers.select("paper_id", T.decision_class("decision").alias("decision"))
    claims = staged(claims.select("task_id", "paper_id", "claim_type", "importance", "source_field", "survival_label").join(papers, "paper_id", "left"), "survival-claims")
    facets = ("claim_type", "importance", "source_field", "decision")
    pairs = F.array(F.struct(F.lit("all").alias("facet"), F.lit("all").alias("value")), *(F.struct(F.lit(k).alias("facet"), F.coalesce(F.nullif(k, F.lit("")), F.lit("unknown")).alias("value")) for k in facets))
    label = F.col("survival_label")
    counts = claims.select("survival_label", F.inline(pairs)).groupBy("facet", "value").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(label == "survived").alias("survived"),
        F.count_if(label == "partial").alias("partial"),
        T.rate(label == "survived").alias("strict_rate"),
        T.rate(label != "not_found").alias("loose_rate"),
    )
    decided = papers.groupBy(F.lit("decision").alias("facet"), F.col("decision").alias("value")).agg(F.count(F.lit(1)).alias("papers"))
    counts = counts.join(decided, ["facet", "value"], "left").withColumn("place", F.lit(None).cast("int"))
    first = extremes.two_ended(claims.select("survival_label", F.lit(0).alias("first"), "task_id"), ["survival_label"], "first", ["task_id"], lowest=examples)
    missing = [F.lit(None).cast(k).alias(c) for c, k in counts.dtypes if c not in ("facet", "value", "place")]
    named = first.select(F.concat(F.lit("example:"), "survival_label").alias("facet"), F.col("task_id").alias("value"), *missing, "place")
    return counts.unionByName(named)


def identity_summary(identities: DataFrame) -> DataFrame:
    """Reviews per hashed identity: with identity, unique, repeated, most."""
    each = identities.where("identity <> ''").groupBy("identity").agg(F.count(F.lit(1)).alias("n"))
    return each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("with_identity"),
        F.count(F.lit(1)).alias("unique_identities"),
        F.count_if(F.col("n") > 1).alias("repeated_identities"),
        F.coalesce(F.max("n"), F.lit(0)).alias("most_reviews"),
    )
