"""Queries over claims: matches, robustness, calibration and label modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlab.functions import lexicons as L
from quorumlab.functions import text as T
from quorumlab.operators import lifecycle, matching
from quorumlab.plans import standins as S
from quorumlab.plans.registry import query


def _signals(spark: SparkSession, d: str) -> DataFrame:
    return matching.signals(S.claims(spark, d), S.segments(spark, d))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.with_labels(_signals(spark, d), S.claim_labels(spark, d))



S.add_cte("ctok", f"SELECT *, {S.d_concern_tokens('claim_text')} AS tok, {S.d_concern_tokens(chr(99) + 'laim_text || chr(32) || claim_type')} AS tok2 FROM claims", "claims")
S.add_cte("stok", f"SELECT *, {S.d_concern_tokens('segment')} AS stk FROM segments", "segments")
S.add_cte(
    "meta_seg",
    "SELECT * FROM stok WHERE note_type = 'meta_review' UNION ALL SELECT * FROM stok WHERE note_type = 'author_response' AND paper_id NOT IN (SELECT paper_id FROM stok WHERE note_type = 'meta_review')",
    "stok",
)


def _best_sql(tokens: str, source: str) -> str:
    return f"""SELECT * FROM (SELECT task_id, segment, score, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, ord) AS rn
  FROM (SELECT c.task_id, s.segment, s.ord, {S.d_overlap(tokens, "stk")} AS score FROM ctok c JOIN ({source}) s ON c.paper_id = s.paper_id) WHERE score > 0) WHERE rn = 1"""


S.add_cte(
    "survival",
    f"""SELECT c.task_id, CASE WHEN coalesce(b.score, 0) >= 0.34 THEN 'survived' WHEN coalesce(b.score, 0) >= 0.2 THEN 'partial' ELSE 'not_found' END AS survival_label,
  round(coalesce(b.score, 0), 4) AS survival_score, coalesce(['claim_text', 'source_sentence', 'claim_plus_type'][basis + 1], '') AS match_basis, coalesce(b.segment, '') AS matched_segment
FROM ctok c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, basis, ord) AS rn FROM (
  SELECT c.task_id, s.ord, s.segment, q.basis, {S.d_overlap("q.tok", "s.stk")} AS score
  FROM (SELECT task_id, paper_id, 0 AS basis, tok FROM ctok UNION ALL SELECT task_id, paper_id, 1, tok FROM ctok UNION ALL SELECT task_id, paper_id, 2, tok2 FROM ctok) q
  JOIN ctok c ON c.task_id = q.task_id JOIN meta_seg s ON s.paper_id = q.paper_id) WHERE score > 0) WHERE rn = 1) b ON b.task_id = c.task_id""",
    "ctok", "meta_seg",
)
_CUE = S._list(L.RESOLUTION_CUES)
S.add_cte(
    "rebuttal",
    f"""SELECT c.task_id, CASE WHEN coalesce(score, 0) < 0.2 THEN 'not_addressed'
  WHEN score >= 0.3 AND list_has_any(string_split_regex(lower({S.d_clean("segment")}), '[ \\t\\n\\r\\f]+'), {_CUE}) THEN 'likely_resolved_or_answered'
  ELSE 'addressed_unclear_resolution' END AS rebuttal_label, round(coalesce(score, 0), 4) AS rebuttal_score
FROM ctok c LEFT JOIN ({_best_sql("c.tok", "SELECT * FROM stok WHERE note_type = 'author_response'")}) b ON b.task_id = c.task_id""",
    "ctok", "stok",
)
S.add_cte(
    "discussion",
    f"""SELECT c.task_id, CASE WHEN coalesce(score, 0) >= 0.2 THEN 'followed_up' ELSE 'not_found' END AS discussion_label, round(coalesce(score, 0), 4) AS discussion_score
FROM ctok c LEFT JOIN ({_best_sql("c.tok", "SELECT * FROM stok WHERE note_type = 'official_comment'")}) b ON b.task_id = c.task_id""",
    "ctok", "stok",
)
S.add_cte(
    "consensus",
    f"""SELECT c.task_id, CASE WHEN coalesce(score, 0) >= 0.34 THEN 'strong' WHEN coalesce(score, 0) >= 0.2 THEN 'partial' ELSE 'none' END AS consensus_proxy,
  round(coalesce(score, 0), 4) AS consensus_score, coalesce(other, '') AS matched_review_id
FROM ctok c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, t, i) AS rn FROM (
  SELECT a.task_id, b.review_id AS other, b.turn AS t, b.claim_index AS i,
    least(1.0::DOUBLE, {S.d_overlap("a.tok", "b.tok")} + CASE WHEN a.claim_type = b.claim_type THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END) AS score
  FROM ctok a JOIN ctok b ON a.paper_id = b.paper_id AND a.review_id <> b.review_id WHERE len(a.tok) > 0) WHERE score > 0) WHERE rn = 1) m ON m.task_id = c.task_id""",
    "ctok",
)
S.add_cte(
    "sig",
    "SELECT * FROM ctok JOIN survival USING (task_id) JOIN consensus USING (task_id) JOIN rebuttal USING (task_id) JOIN discussion USING (task_id) LEFT JOIN claim_labels USING (task_id)",
    "ctok", "survival", "consensus", "rebuttal", "discussion", "claim_labels",
)
_ANCHOR = S._list(L.SPECIFIC_ANCHORS)
_SPECIFIC = f"""CASE WHEN len(tok) = 0 THEN 0.0 ELSE round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, least(1.0::DOUBLE, len(tok) / 18.0::DOUBLE)
  + CASE WHEN list_has_any(tok, {_ANCHOR}) THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(lower({S.d_clean("claim_text")}), '{L.SPECIFIC_ACTIONS}') THEN 0.15::DOUBLE ELSE 0 END
  - CASE WHEN len(tok) < 6 OR lower({S.d_clean("claim_text")}) IN ({S._in(L.VAGUE_TEXTS)}) THEN 0.2::DOUBLE ELSE 0 END)), 4) END"""


def _scored_sql(name: str, source: str, use_consensus: str, use_rebuttal: str, meta: str = "survival_label") -> str:
    S.add_cte(
        name,
        f"""SELECT *, CASE WHEN robustness >= 0.72 THEN 'high' WHEN robustness >= 0.45 THEN 'medium' ELSE 'low' END AS robustness_label FROM (
SELECT *, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.0::DOUBLE + 0.15::DOUBLE * s_grounding + 0.15::DOUBLE * s_specificity + 0.18::DOUBLE * s_consensus + 0.25::DOUBLE * s_rebuttal + 0.07::DOUBLE * s_discussion + 0.20::DOUBLE * s_meta)), 4) AS robustness FROM (
SELECT *, CAST(CASE WHEN {S.d_clean("source_sentence")} <> '' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS s_grounding, CAST({_SPECIFIC} AS DOUBLE) AS s_specificity,
  CAST(CASE WHEN ({use_consensus}) AND consensus_label IS NOT NULL THEN CASE consensus_label WHEN 'same_concern' THEN 1.0 WHEN 'related_but_different' THEN 0.55 WHEN 'not_same_concern' THEN 0.0 ELSE 0.25 END
    ELSE CASE consensus_proxy WHEN 'strong' THEN 1.0 WHEN 'partial' THEN 0.55 ELSE 0.0 END END AS DOUBLE) AS s_consensus,
  CAST(CASE WHEN ({use_rebuttal}) AND (response_label IS NOT NULL OR effect_label IS NOT NULL) THEN CASE WHEN effect_label = 'resolved_or_weakened' OR response_label = 'likely_resolved' THEN 0.0
      WHEN response_label = 'specifically_addressed' OR effect_label = 'partially_addresses' THEN 0.55 WHEN response_label = 'generic_or_unclear' THEN 0.75 WHEN effect_label = 'unclear' THEN 0.45
      WHEN response_label = 'not_addressed' OR effect_label = 'does_not_address' THEN 0.85 ELSE 0.45 END
    ELSE CASE rebuttal_label WHEN 'likely_resolved_or_answered' THEN 0.15 WHEN 'addressed_unclear_resolution' THEN 0.55 WHEN 'not_addressed' THEN 0.70 ELSE 0.45 END END AS DOUBLE) AS s_rebuttal,
  CAST(CASE WHEN discussion_label = 'followed_up' THEN 0.70 ELSE 0.0 END AS DOUBLE) AS s_discussion,
  CAST(CASE {meta} WHEN 'survived' THEN 1.0 WHEN 'partial' THEN 0.60 ELSE 0.0 END AS DOUBLE) AS s_meta
FROM {source}))""",
        *([] if " " in source else [source]),
    )
    return name


_scored_sql("scored_all", "sig", "true", "true")
_scored_sql("scored_proxy", "sig", "false", "false")
S.add_cte("sig_modes", "SELECT *, unnest(['deterministic_proxy', 'consensus_labels', 'rebuttal_labels', 'all_labels']) AS mode FROM sig", "sig")
_scored_sql("scored_modes", "sig_modes", "mode IN ('consensus_labels', 'all_labels')", "mode IN ('rebuttal_labels', 'all_labels')")


@query(S.sql("SELECT task_id, survival_label, survival_score, match_basis FROM survival", "survival"))
def concern_survival(spark: SparkSession, d: str) -> DataFrame:
    found = matching.survival(S.claims(spark, d), S.segments(spark, d))
    return found.select("task_id", "survival_label", "survival_score", "match_basis")


_CUES = S._list(L.CONCERN_CUES)


@query(
    S.sql(
        f"SELECT task_id, field FROM (SELECT *, CASE WHEN claim_index % 2 = 0 THEN 'review_text' ELSE source_field END AS field FROM claims) WHERE field IN ('weaknesses', 'questions') OR (field = 'review_text' AND len(list_filter({_CUES}, lambda w: contains(lower(claim_text || ' ' || source_sentence), w))) > 0)",
        "claims",
    )
)
def concern_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = S.claims(spark, d)
    rows = rows.withColumn("source_field", F.when(F.col("claim_index") % 2 == 0, "review_text").otherwise(F.col("source_field")))
    return matching.is_concern(rows).select("task_id", F.col("source_field").alias("field"))


@query(S.sql("SELECT task_id, consensus_proxy, consensus_score, matched_review_id FROM consensus", "consensus"))
def consensus_match(spark: SparkSession, d: str) -> DataFrame:
    return matching.consensus(S.claims(spark, d))


@query(S.sql("SELECT * FROM rebuttal", "rebuttal"))
def rebuttal_match(spark: SparkSession, d: str) -> DataFrame:
    return matching.rebuttal(S.claims(spark, d), S.segments(spark, d))


@query(S.sql("SELECT * FROM discussion", "discussion"))
def discussion_match(spark: SparkSession, d: str) -> DataFrame:
    return matching.discussion(S.claims(spark, d), S.segments(spark, d))


@query(S.sql(f"SELECT task_id, CAST({_SPECIFIC} AS DOUBLE) AS specificity FROM ctok", "ctok"))
def specificity(spark: SparkSession, d: str) -> DataFrame:
    return S.claims(spark, d).select("task_id", lifecycle.specificity().alias("specificity"))


_SUPPORT = """array_to_string(list_filter([CASE WHEN s_grounding = 1 THEN 'grounded_in_original_review' END, CASE WHEN s_consensus >= 0.55 THEN 'supported_or_overlapped_by_other_reviewers' END,
  CASE WHEN s_rebuttal >= 0.70 THEN 'not_resolved_by_author_response' END, CASE WHEN s_discussion > 0 THEN 'followed_up_after_rebuttal' END, CASE WHEN s_meta >= 0.60 THEN 'taken_up_in_meta_review' END], lambda x: x IS NOT NULL), '|')"""
_WEAKEN = """array_to_string(list_filter([CASE WHEN s_grounding = 0 THEN 'not_grounded_in_original_review' END, CASE WHEN s_consensus = 0 THEN 'no_inter_reviewer_support_found' END,
  CASE WHEN s_rebuttal <= 0.15 THEN 'author_response_likely_resolved_or_weakened_claim' END, CASE WHEN s_meta = 0 THEN 'not_found_in_meta_review' END], lambda x: x IS NOT NULL), '|')"""


@query(S.sql(f"SELECT task_id, robustness, robustness_label, {_SUPPORT} AS supporting, {_WEAKEN} AS weakening FROM scored_all", "scored_all"))
def lifecycle_score(spark: SparkSession, d: str) -> DataFrame:
    rows = lifecycle.factors(lifecycle.scored(_labelled(spark, d), F.lit(True), F.lit(True)))
    return rows.select("task_id", "robustness", "robustness_label", F.array_join("supporting", "|").alias("supporting"), F.array_join("weakening", "|").alias("weakening"))


S.add_cte("v_rating", "SELECT reply_id AS review_id, CASE WHEN length(text) % 11 = 0 THEN NULL ELSE CAST(length(text) % 10 + 1 AS DOUBLE) END AS rating_normalized, CASE WHEN length(text) % 7 = 0 THEN NULL ELSE CAST((length(text) % 5 + 1) * 2 AS DOUBLE) END AS confidence_normalized FROM v_reply WHERE note_type = 'official_review'", "v_reply")


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    rows = S.view(spark, d, "v_reply").where("note_type = 'official_review'")
    return rows.select(F.col("reply_id").alias("review_id"), F.when(n % 11 != 0, (n % 10 + 1).cast("double")).alias("rating_normalized"), F.when(n % 7 != 0, ((n % 5 + 1) * 2).cast("double")).alias("confidence_normalized"))


def _rate_sql(cond: str, of: str = "true") -> str:
    return f"CASE WHEN count(*) FILTER ({of}) > 0 THEN round(count(*) FILTER (({cond}) AND ({of}))::DOUBLE / count(*) FILTER ({of}), 4) ELSE 0.0::DOUBLE END"


def _reliability_sql(agreed: str, resolved: str) -> str:
    return f"""round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.2::DOUBLE * grounded_rate + 0.2::DOUBLE * specificity + 0.2::DOUBLE * {agreed} + 0.2::DOUBLE * meta_uptake_rate + 0.1::DOUBLE * (1.0::DOUBLE - {resolved})
  + 0.05::DOUBLE * CASE WHEN rating_gap IS NULL THEN 0.5::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - least(abs(rating_gap), 4.0::DOUBLE) / 4.0::DOUBLE) END
  + 0.05::DOUBLE * CASE WHEN confidence_normalized IS NULL THEN 0.5::DOUBLE ELSE 1.0::DOUBLE - abs(greatest(0.0::DOUBLE, least(1.0::DOUBLE, confidence_normalized / 10.0::DOUBLE)) - (0.35::DOUBLE + 0.65::DOUBLE * ((specificity + {agreed} + meta_uptake_rate) / 3))) END)), 4)"""


S.add_cte(
    "calibrated",
    f"""SELECT *, CASE WHEN rating_gap IS NULL THEN 'rating_missing' WHEN rating_gap <= -1.5 THEN 'harsher_than_claim_signals' WHEN rating_gap >= 1.5 THEN 'more_lenient_than_claim_signals' ELSE 'calibrated_to_claim_signals' END AS rating_label,
  CASE WHEN confidence_normalized IS NULL THEN 'confidence_missing' WHEN confidence_normalized / 10 >= 0.75 AND reliability < 0.45 THEN 'possibly_overconfident' WHEN confidence_normalized / 10 <= 0.45 AND reliability >= 0.65 THEN 'possibly_underconfident' ELSE 'confidence_reasonable' END AS confidence_label,
  CASE WHEN rating_gap <= -1.5 THEN 'over_harsh_proxy' WHEN rating_gap >= 1.5 THEN 'over_lenient_proxy' WHEN confidence_normalized >= 7.5 AND reliability < 0.45 THEN 'confident_but_low_signal_proxy' WHEN reliability >= 0.65 THEN 'high_signal_review' ELSE 'mixed_signal_review' END AS style_label
FROM (SELECT *, {_reliability_sql("consensus_rate", "rebuttal_resolved_rate")} AS reliability,
  {_reliability_sql("CASE WHEN labelled_consensus > 0 THEN label_consensus_rate ELSE consensus_rate END", "CASE WHEN labelled_rebuttal > 0 THEN label_resolved_rate ELSE rebuttal_resolved_rate END")} AS calibrated_reliability
FROM (SELECT *, round(rating_normalized - expected_rating, 3) AS rating_gap FROM (SELECT *, round(greatest(1.0::DOUBLE, least(10.0::DOUBLE, 8.5::DOUBLE - 6.0::DOUBLE * severity)), 3) AS expected_rating
FROM (SELECT paper_id, review_id, count(*) AS claim_count, {_rate_sql("s_grounding = 1")} AS grounded_rate, {S.d_mean4("s_specificity")} AS specificity, {_rate_sql("consensus_proxy IN ('strong', 'partial')")} AS consensus_rate,
  count(*) FILTER (consensus_label IS NOT NULL) AS labelled_consensus, {_rate_sql("consensus_label IN ('same_concern', 'related_but_different')", "consensus_label IS NOT NULL")} AS label_consensus_rate,
  {_rate_sql("survival_label IN ('survived', 'partial')")} AS meta_uptake_rate, {_rate_sql("rebuttal_label <> 'not_addressed'")} AS rebuttal_addressed_rate, {_rate_sql("rebuttal_label = 'likely_resolved_or_answered'")} AS rebuttal_resolved_rate,
  count(*) FILTER (effect_label IS NOT NULL) AS labelled_rebuttal, {_rate_sql("effect_label = 'resolved_or_weakened'", "effect_label IS NOT NULL")} AS label_resolved_rate, {_rate_sql("discussion_label = 'followed_up'")} AS followup_rate,
  {S.d_mean4("robustness")} AS mean_robustness, {_rate_sql("robustness_label = 'high'")} AS high_rate, round(list_sum(list_sort(list(sev), 'DESC')[1:4]) / least(count(*), 4), 4) AS severity
FROM (SELECT *, CAST(CASE importance WHEN 'major' THEN 1.0 WHEN 'medium' THEN 0.75 WHEN 'minor' THEN 0.45 WHEN 'question' THEN 0.35 ELSE 0.6 END AS DOUBLE) * (0.25::DOUBLE * s_specificity + 0.25::DOUBLE * CASE consensus_proxy WHEN 'strong' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.65::DOUBLE ELSE 0.0::DOUBLE END
  + 0.35::DOUBLE * CASE survival_label WHEN 'survived' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.65::DOUBLE ELSE 0.0::DOUBLE END + 0.15::DOUBLE * CASE WHEN rebuttal_label = 'likely_resolved_or_answered' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS sev FROM scored_all)
GROUP BY paper_id, review_id) LEFT JOIN v_rating USING (review_id))))""",
    "scored_all", "v_rating",
)

_REVIEW_OUT = ("paper_id", "review_id", "claim_count", "grounded_rate", "specificity", "consensus_rate", "meta_uptake_rate", "rebuttal_addressed_rate", "rebuttal_resolved_rate", "followup_rate", "mean_robustness", "severity", "expected_rating", "rating_gap", "reliability", "calibrated_reliability", "rating_label", "confidence_label", "style_label")


def _calibrated(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.calibrated_reviews(lifecycle.scored(_labelled(spark, d), F.lit(True), F.lit(True)), _ratings(spark, d))


@query(S.sql(f"SELECT {', '.join(_REVIEW_OUT)} FROM calibrated", "calibrated"))
def review_calibration(spark: SparkSession, d: str) -> DataFrame:
    return _calibrated(spark, d).select(*_REVIEW_OUT)


_MEANS = "count(*) AS review_count, CAST(sum(claim_count) AS BIGINT) AS claim_count, round(avg(reliability), 4) AS reliability, round(avg(calibrated_reliability), 4) AS calibrated_reliability, round(avg(severity), 4) AS severity"
_KINDS = {
    "rebuttal_resolved": "rebuttal_label = 'likely_resolved_or_answered'",
    "consensus": "consensus_proxy IN ('strong', 'partial')",
    "high_robustness": "robustness_label = 'high'",
    "low_robustness": "robustness_label = 'low'",
}


@query(
    S.sql(
        f"""SELECT 'all' AS section, NULL AS name, NULL AS place, NULL AS style_label, NULL AS rating_label, {_MEANS} FROM calibrated
UNION ALL SELECT 'group', NULL, NULL, style_label, rating_label, {_MEANS} FROM calibrated GROUP BY style_label, rating_label
UNION ALL SELECT section, review_id, place, style_label, rating_label, 1, claim_count, reliability, calibrated_reliability, severity FROM (
  SELECT 'lowest' AS section, row_number() OVER (ORDER BY reliability, review_id) AS place, * FROM calibrated
  UNION ALL SELECT 'highest', row_number() OVER (ORDER BY reliability DESC, review_id), * FROM calibrated) WHERE place <= 8
UNION ALL SELECT section, task_id, place, robustness_label, NULL, 0, 1, robustness, NULL, NULL FROM ("""
        + " UNION ALL ".join(f"SELECT '{k}' AS section, row_number() OVER (ORDER BY task_id) AS place, * FROM scored_all WHERE {w}" for k, w in _KINDS.items())
        + ") WHERE place <= 8",
        "calibrated",
        "scored_all",
    )
)
def calibration_summary(spark: SparkSession, d: str) -> DataFrame:
    claims = lifecycle.scored(_labelled(spark, d), F.lit(True), F.lit(True))
    return lifecycle.calibration_report(lifecycle.calibrated_reviews(claims, _ratings(spark, d)), claims)


_SUMMARY = ", ".join(
    ["count(*) AS claim_count", "count(DISTINCT paper_id) AS paper_count", "count(DISTINCT review_id) AS review_count", "round(avg(robustness), 4) AS mean_score", "round(median(robustness), 4) AS median_score"]
    + [f"count(*) FILTER (robustness_label = '{x}') AS {x}_count" for x in ("high", "medium", "low")]
    + [f"round(avg(s_{k}), 4) AS mean_{k}" for k in lifecycle.WEIGHTS]
)


@query(S.sql(f"SELECT mode, {_SUMMARY} FROM scored_modes GROUP BY mode", "scored_modes"))
def ablation_modes(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.summarized(lifecycle.by_mode(_labelled(spark, d)), "mode")


S.add_cte("sig_strict", "SELECT * REPLACE (CASE WHEN consensus_label IS NULL OR mode = 'broad' THEN consensus_label WHEN consensus_label = 'same_concern' THEN consensus_label ELSE 'not_same_concern' END AS consensus_label) FROM (SELECT *, unnest(['broad', 'strict']) AS mode FROM sig)", "sig")
_scored_sql("scored_strict", "sig_strict", "true", "true")


@query(S.sql(f"SELECT mode, {_SUMMARY} FROM scored_strict GROUP BY mode", "scored_strict"))
def consensus_recalibration(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d).withColumn("mode", F.explode(T.words_of(("broad", "strict"))))
    label = F.col("consensus_label")
    strict = F.when(label.isNull() | (F.col("mode") == "broad") | (label == "same_concern"), label).otherwise("not_same_concern")
    return lifecycle.summarized(lifecycle.scored(rows.withColumn("consensus_label", strict), F.lit(True), F.lit(True)), "mode")


S.add_cte("sig_semantic", "SELECT *, CASE WHEN mode = 'semantic' AND meta_label IN ('survived', 'partial', 'not_found') THEN meta_label ELSE survival_label END AS used FROM (SELECT *, unnest(['proxy', 'semantic']) AS mode FROM sig)", "sig")
_scored_sql("scored_semantic", "sig_semantic", "true", "true", "used")


def _semantic(spark: SparkSession, d: str) -> DataFrame:
    rows = lifecycle.with_texts(_labelled(spark, d)).withColumn("mode", F.explode(T.words_of(("proxy", "semantic"))))
    used = F.when((F.col("mode") == "semantic") & F.col("meta_label").isin("survived", "partial", "not_found"), F.col("meta_label")).otherwise(F.col("survival_label"))
    rows = rows.withColumn("used", used)
    return lifecycle.weighed(rows, F.lit(True), F.lit(True), F.col("used"))


@query(S.sql(f"SELECT mode, {_SUMMARY} FROM scored_semantic GROUP BY mode", "scored_semantic"))
def semantic_modes(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.summarized(_semantic(spark, d), "mode")


@query(S.sql("SELECT task_id, survival_label AS proxy_label, used AS used_label, survival_label <> used AS changed, robustness FROM scored_semantic WHERE mode = 'semantic'", "scored_semantic"))
def semantic_overlay(spark: SparkSession, d: str) -> DataFrame:
    rows = _semantic(spark, d).where("mode = 'semantic'")
    return rows.select("task_id", F.col("survival_label").alias("proxy_label"), F.col("used").alias("used_label"), (F.col("survival_label") != F.col("used")).alias("changed"), "robustness")


S.add_cte(
    "run_deltas",
    "SELECT task_id, a.robustness_label AS la, b.robustness_label AS lb, round(b.robustness - a.robustness, 4) AS delta, "
    + ", ".join(f"round(b.s_{k} - a.s_{k}, 4) AS s_{k}" for k in lifecycle.WEIGHTS)
    + " FROM scored_proxy a JOIN scored_all b USING (task_id)",
    "scored_proxy",
    "scored_all",
)
_DELTAS = "count(*) AS n, round(avg(delta), 4) AS value, round(median(delta), 4) AS median, round(avg(abs(delta)), 4) AS mean_abs"


@query(
    S.sql(
        f"""SELECT 'all' AS section, 'all' AS name, NULL AS place, {_DELTAS} FROM run_deltas
UNION ALL SELECT 'transition', la || '->' || lb, NULL, {_DELTAS} FROM run_deltas GROUP BY la, lb
UNION ALL SELECT 'changed', 'labels', NULL, count(*) FILTER (la <> lb), {_rate_sql("la <> lb")}, NULL, NULL FROM run_deltas
UNION ALL SELECT 'signal', unnest({S._list(lifecycle.WEIGHTS)}), NULL, count(*), unnest([{", ".join(S.d_mean4(f"s_{k}") for k in lifecycle.WEIGHTS)}]), NULL, NULL FROM run_deltas
UNION ALL SELECT section, task_id, place, 1, delta, NULL, NULL FROM (
  SELECT 'lowest' AS section, row_number() OVER (ORDER BY delta, task_id) AS place, task_id, delta FROM run_deltas
  UNION ALL SELECT 'highest', row_number() OVER (ORDER BY delta DESC, task_id), task_id, delta FROM run_deltas) WHERE place <= 8""",
        "run_deltas",
    )
)
def compare_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d)
    return lifecycle.compared(lifecycle.scored(rows, F.lit(False), F.lit(False)), lifecycle.scored(rows, F.lit(True), F.lit(True)))


_DECISIONS = ("Accept (poster)", "Reject", "", "Withdrawn", "Oral")
S.add_cte("decided", f"SELECT paper_id, {S._list(_DECISIONS)}[CAST(sum(length(text)) AS BIGINT) % 5 + 1] AS said FROM v_reply GROUP BY paper_id", "v_reply")
S.add_cte("decision_of", "SELECT paper_id, CASE WHEN said = '' THEN 'unknown' WHEN said = 'Reject' THEN 'reject' WHEN said = 'Withdrawn' THEN 'other' ELSE 'accept' END AS decision FROM decided", "decided")


@query(
    S.sql(
        """SELECT facet, value, n, survived, partial, strict_rate, loose_rate, papers, NULL AS place FROM (
  SELECT facet, value, count(*) AS n, count(*) FILTER (survival_label = 'survived') AS survived, count(*) FILTER (survival_label = 'partial') AS partial,
         round(count(*) FILTER (survival_label = 'survived')::DOUBLE / count(*), 4) AS strict_rate, round(count(*) FILTER (survival_label <> 'not_found')::DOUBLE / count(*), 4) AS loose_rate
  FROM (SELECT survival_label, unnest(['all', 'claim_type', 'importance', 'source_field', 'decision']) AS facet, unnest(['all', claim_type, importance, source_field, decision]) AS value FROM sig JOIN decision_of USING (paper_id)) GROUP BY facet, value)
LEFT JOIN (SELECT 'decision' AS facet, decision AS value, count(*) AS papers FROM decision_of GROUP BY decision) USING (facet, value)
UNION ALL SELECT 'example:' || survival_label, task_id, NULL, NULL, NULL, NULL, NULL, NULL, place FROM (SELECT *, row_number() OVER (PARTITION BY survival_label ORDER BY task_id) AS place FROM sig) WHERE place <= 12""",
        "sig",
        "decision_of",
    )
)
def survival_report(spark: SparkSession, d: str) -> DataFrame:
    rows = S.claims(spark, d)
    rows = rows.join(matching.survival(rows, S.segments(spark, d)).select("task_id", "survival_label"), "task_id")
    size = F.sum(F.length("text")) % len(_DECISIONS)
    papers = S.view(spark, d, "v_reply").groupBy("paper_id").agg(F.element_at(T.words_of(_DECISIONS), (size + 1).cast("int")).alias("decision"))
    return lifecycle.survival_report(rows, papers)


@query(S.sql(f"SELECT kind, count(*) AS labelled, {_rate_sql('agree')} AS agreement, count(*) FILTER (proxy_positive AND NOT label_positive) AS false_positives, count(*) FILTER (label_positive AND NOT proxy_positive) AS false_negatives FROM (SELECT 'consensus' AS kind, consensus_proxy <> 'none' AS proxy_positive, consensus_label IN ('same_concern', 'related_but_different') AS label_positive, proxy_positive = label_positive AS agree FROM sig WHERE consensus_label IS NOT NULL UNION ALL SELECT 'rebuttal', rebuttal_label = 'likely_resolved_or_answered', effect_label = 'resolved_or_weakened', (rebuttal_label = 'likely_resolved_or_answered') = (effect_label = 'resolved_or_weakened') FROM sig WHERE effect_label IS NOT NULL) GROUP BY kind", "sig"))
def lexical_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d)
    pairs = F.array(
        F.when(F.col("consensus_label").isNotNull(), F.struct(F.lit("consensus").alias("kind"), (F.col("consensus_proxy") != "none").alias("proxy"), F.col("consensus_label").isin("same_concern", "related_but_different").alias("label"))),
        F.when(F.col("effect_label").isNotNull(), F.struct(F.lit("rebuttal").alias("kind"), (F.col("rebuttal_label") == "likely_resolved_or_answered").alias("proxy"), (F.col("effect_label") == "resolved_or_weakened").alias("label"))),
    )
    return rows.select(F.inline(F.array_compact(pairs))).groupBy("kind").agg(
        F.count(F.lit(1)).alias("labelled"),
        T.rate(F.col("proxy") == F.col("label")).alias("agreement"),
        F.count_if(F.col("proxy") & ~F.col("label")).alias("false_positives"),
        F.count_if(F.col("label") & ~F.col("proxy")).alias("false_negatives"),
    )


@query(S.sql("SELECT task_id, consensus_proxy AS proxy_label, consensus_label AS gold_label, confidence, CASE consensus_proxy WHEN 'strong' THEN 'same_concern' WHEN 'partial' THEN 'related_but_different' ELSE 'not_same_concern' END = consensus_label AS agrees, confidence = 'high' AND consensus_label <> 'unsure' AS training_candidate FROM sig WHERE consensus_label IS NOT NULL", "sig"))
def merge_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d).where("consensus_label is not null")
    mapped = F.when(F.col("consensus_proxy") == "strong", "same_concern").when(F.col("consensus_proxy") == "partial", "related_but_different").otherwise("not_same_concern")
    return rows.select("task_id", F.col("consensus_proxy").alias("proxy_label"), F.col("consensus_label").alias("gold_label"), "confidence", (mapped == F.col("consensus_label")).alias("agrees"), ((F.col("confidence") == "high") & (F.col("consensus_label") != "unsure")).alias("training_candidate"))


@query(S.sql(f"SELECT family, label, count(*) AS n, count(*) FILTER (confidence = 'high') AS high_confidence, {_rate_sql('proxy = label')} AS agreement FROM (SELECT 'consensus' AS family, consensus_label AS label, confidence, CASE consensus_proxy WHEN 'strong' THEN 'same_concern' WHEN 'partial' THEN 'related_but_different' ELSE 'not_same_concern' END AS proxy FROM sig WHERE consensus_label IS NOT NULL UNION ALL SELECT 'survival', meta_label, confidence, survival_label FROM sig WHERE meta_label IS NOT NULL UNION ALL SELECT 'rebuttal', response_label, confidence, CASE rebuttal_label WHEN 'not_addressed' THEN 'not_addressed' WHEN 'likely_resolved_or_answered' THEN 'likely_resolved' ELSE 'generic_or_unclear' END FROM sig WHERE response_label IS NOT NULL) GROUP BY family, label", "sig"))
def calibration_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d).where("consensus_label is not null")
    consensus = F.when(F.col("consensus_proxy") == "strong", "same_concern").when(F.col("consensus_proxy") == "partial", "related_but_different").otherwise("not_same_concern")
    answer = F.when(F.col("rebuttal_label") == "not_addressed", "not_addressed").when(F.col("rebuttal_label") == "likely_resolved_or_answered", "likely_resolved").otherwise("generic_or_unclear")
    family = F.array(*(F.struct(F.lit(k).alias("family"), F.col(label).alias("label"), p.alias("proxy")) for k, label, p in (("consensus", "consensus_label", consensus), ("survival", "meta_label", F.col("survival_label")), ("rebuttal", "response_label", answer))))
    return rows.select("confidence", F.inline(family)).groupBy("family", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") == "high").alias("high_confidence"), T.rate(F.col("proxy") == F.col("label")).alias("agreement"))


@query(S.sql(f"SELECT review_id, count(*) AS claim_count, count(consensus_label) AS labelled, round(count(consensus_label)::DOUBLE / count(*), 4) AS coverage, CASE WHEN count(consensus_label) > 0 THEN {_rate_sql('''consensus_label IN ('same_concern', 'related_but_different')''', 'consensus_label IS NOT NULL')} ELSE {_rate_sql('''consensus_proxy IN ('strong', 'partial')''')} END AS consensus_rate FROM sig GROUP BY review_id", "sig"))
def backfill_labels(spark: SparkSession, d: str) -> DataFrame:
    labelled = F.col("consensus_label").isNotNull()
    by_label, by_proxy = T.rate(F.col("consensus_label").isin("same_concern", "related_but_different"), labelled), T.rate(F.col("consensus_proxy").isin("strong", "partial"))
    return _labelled(spark, d).groupBy("review_id").agg(F.count(F.lit(1)).alias("claim_count"), F.count("consensus_label").alias("labelled"), T.rate(labelled).alias("coverage"), F.when(F.count_if(labelled) > 0, by_label).otherwise(by_proxy).alias("consensus_rate"))


@query(S.sql("SELECT task_id, claim_type FROM claims WHERE task_id NOT IN (SELECT task_id FROM claim_labels)", "claims", "claim_labels"))
def unlabelled_items(spark: SparkSession, d: str) -> DataFrame:
    return S.claims(spark, d).join(S.claim_labels(spark, d), "task_id", "left_anti").select("task_id", "claim_type")


@query(S.sql("SELECT count(*) AS with_identity, count(DISTINCT identity) AS unique_identities, count(DISTINCT identity) FILTER (n > 1) AS repeated_identities, max(n) AS most_reviews FROM (SELECT identity, count(*) OVER (PARTITION BY identity) AS n FROM (SELECT sha1(concat('u', length(text) % 50)) AS identity FROM v_reply WHERE note_type = 'official_review'))", "v_reply"))
def identity_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = S.view(spark, d, "v_reply").where("note_type = 'official_review'")
    return lifecycle.identity_summary(rows.select(F.sha1(F.concat(F.lit("u"), (F.length("text") % 50).cast("string")).cast("binary")).alias("identity")))
