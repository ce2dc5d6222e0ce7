"""Rule scores of claims and clean-up of model scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlab.functions import lexicons as L
from quorumlab.functions import text as T

ANCHOR_WORDS = r"\b(table|figure|section|appendix|equation|line|baseline|dataset|ablation)\b"
ACTION_WORDS = r"\b(add|compare|report|clarify|include|provide|explain|analyze|evaluate|discuss)\b"
RUDE_WORDS = r"\b(lazy|terrible|awful|nonsense|ridiculous|badly written)\b"
RISK_WORDS = r"\b(missing|lack|not clear|unclear|insufficient|unsupported|baseline|ablation)\b"
TONE_WORDS = ("idiot", "stupid", "nonsense", "worthless", "pathetic", "clown", "garbage", "lazy")


def heuristic(text: Column) -> dict[str, Column]:
    """Six scores of a claim from anchors, actions, politeness and length."""
    low, n = F.lower(text), F.size(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+"), F.lit(0)))
    anchor = low.rlike(ANCHOR_WORDS)
    specificity = F.when(anchor, 0.75).otherwise(0.6) + F.when(n >= 35, 0.08).otherwise(0.0) - F.when(n < 12, 0.18).otherwise(0.0)
    return {
        "specificity": F.round(F.least(F.lit(1.0), specificity), 4),
        "substantiation": F.when(anchor, 0.76).otherwise(0.55),
        "actionability": F.when(low.rlike(ACTION_WORDS), 0.82).otherwise(0.52),
        "consensus_conflict": F.lit(0.58),
        "rebuttal_robustness": F.when(low.rlike(RISK_WORDS), 0.74).otherwise(0.5),
        "professionalism": F.when(low.rlike(RUDE_WORDS), 0.25).otherwise(0.82),
    }


def rule_scores(text: Column, kind: Column) -> dict[str, Column]:
    """Specificity, auditability, actionability and tone, 1 to 4."""
    low = F.lower(text)
    hits, n = T.count_words(low, L.SPECIFICITY_WORDS), F.size(T.plain_tokens(text))
    number = text.rlike("[0-9]")
    rude = T.count_words(low, TONE_WORDS)
    return {
        "specificity": F.when((hits >= 2) | ((hits >= 1) & number), 4).when(hits == 1, 3).when(n >= 12, 2).otherwise(1),
        "auditability": F.when(kind == "tone", 4).when(kind.isin(*L.EXPERT_TYPES), 2).when(hits > 0, 4).when(n >= 10, 3).when(n >= 5, 2).otherwise(1),
        "actionability": F.when(T.any_word(low, L.ACTION_WORDS), F.when(T.any_word(low, ("because", "so that", "impact")), 4).otherwise(3)).when(T.any_word(low, ("why", "how", "what")), 2).otherwise(1),
        "tone": F.when(rude >= 2, 1).when(rude == 1, 2).when(T.any_word(low, ("clearly wrong", "obviously")), 3).otherwise(4),
    }


def evidence_support(verdict: Column) -> Column:
    return F.when(verdict == "supported", 3).when(verdict == "partially_supported", 2).when(verdict.isin("insufficient", "vague_or_not_checkable"), 1).when(verdict == "possibly_contradicted", 0)


def stance_of(verdict: Column, support: Column) -> Column:
    """From the support score where there is one, else from the verdict."""
    by_score = F.when(support >= 82, "strongly_agree").when(support >= 62, "agree").when(support >= 40, "mixed").when(support >= 20, "disagree").otherwise("strongly_disagree")
    by_verdict = F.when(verdict == "supported", "agree").when(verdict == "possibly_contradicted", "strongly_disagree").otherwise("mixed")
    return F.when(support.isNotNull(), by_score).otherwise(by_verdict)


def defaults(rows: DataFrame) -> DataFrame:
    """Default point type, support, stance, fairness, severity and question values of audited claims."""
    verdict, text = F.col("verdict"), F.lower(F.col("claim_text"))
    base = F.when(verdict == "supported", 85).when(verdict == "partially_supported", 58).when(verdict == "insufficient", 30).when(verdict == "possibly_contradicted", 18).when(verdict == "vague_or_not_checkable", 40).otherwise(50)
    mixed = F.bround((base + F.greatest(F.lit(0), F.least(F.lit(3), evidence_support(verdict))) / 3.0 * 100) / 2.0, 0).cast("int")
    support = F.when(verdict.isin("supported", "partially_supported", "insufficient"), mixed).otherwise(base)
    kind = (
        F.when((F.col("importance") == "question") | (F.col("source_field") == "questions") | text.endswith("?"), "question")
        .when(T.any_word(text, ("i rate", "my score", "i give", "rating", "score is")), "score_justification")
        .when(T.any_word(text, ("should", "could", "recommend", "suggest")), "suggestion")
        .when(F.col("source_field") == "summary", "summary")
        .otherwise("comment")
    )
    rows = rows.withColumns({"support_score": support, "point_type": kind})
    asked = F.col("point_type") == "question"
    coverage = F.when(verdict == "possibly_contradicted", 80).when(verdict == "supported", 70).when(verdict == "partially_supported", 50).when(verdict == "insufficient", 20).otherwise(F.col("support_score"))
    return rows.withColumns(
        {
            "stance": stance_of(verdict, F.col("support_score")),
            "fairness": F.when(verdict == "supported", 80).when(verdict == "partially_supported", 60).when(verdict == "possibly_contradicted", 35).when(verdict == "vague_or_not_checkable", 45).otherwise(50),
            "severity": F.when(verdict == "possibly_contradicted", 1).when(verdict == "needs_human_check", 2).when(verdict == "supported", 4).otherwise(3),
            "answer_coverage": F.when(asked, coverage).otherwise(0),
            "question_value": F.when(asked, F.bround((F.col("specificity") + F.col("actionability")) / 8.0 * 100, 0).cast("int")).otherwise(0),
        }
    )


def issue_flags() -> Column:
    """Flags of a claim from its verdict, importance and rule scores."""
    verdict, importance = F.col("verdict"), F.col("importance")
    flags = {
        "possibly-contradicted-by-paper": verdict == "possibly_contradicted",
        "unsupported-major-claim": (verdict == "insufficient") & importance.isin("major", "medium"),
        "vague-or-not-checkable": verdict == "vague_or_not_checkable",
        "vague-criticism": F.col("specificity") <= 1,
        "unprofessional-tone": F.col("tone") <= 2,
        "missing-actionable-suggestions": (F.col("actionability") <= 1) & ~importance.isin("tone-only", "question"),
        "requires-human-expert-check": F.col("claim_type").isin(*L.EXPERT_TYPES),
    }
    return F.array_compact(F.array(*(F.when(v, k) for k, v in flags.items())))


def gated(rows: DataFrame) -> DataFrame:
    """Post-check of judged claims: quotes must stand in the evidence, weak evidence lowers confidence, stances fit verdicts.

    ``rows``: verdict, stance, confidence, support_score, evidence_support, quote, evidence (array of texts), flags.
    """
    limited = F.col("verdict").isin("insufficient", "vague_or_not_checkable", "needs_human_check")
    bare = F.size("evidence") == 0
    tokens = F.array_join(T.plain_tokens("quote"), " ")
    found = F.exists("evidence", lambda e: F.contains(F.array_join(T.plain_tokens(e), " "), tokens)) & (tokens != "")
    bad_quote = (F.coalesce("quote", F.lit("")) != "") & ~found
    lowered = (F.col("confidence") == "high") & (limited | F.col("evidence_support").isNull() | (F.col("evidence_support") <= 1) | bare)
    low = F.when(F.col("verdict").isin("insufficient", "needs_human_check") | bare, "low").otherwise("medium")
    cut = limited & (F.col("support_score") > 60)
    clash = (
        ((F.col("verdict") == "supported") & F.col("stance").isin("disagree", "strongly_disagree"))
        | ((F.col("verdict") == "partially_supported") & F.col("stance").isin("strongly_agree", "strongly_disagree"))
        | ((F.col("verdict") == "possibly_contradicted") & F.col("stance").isin("agree", "strongly_agree"))
        | (limited & (F.col("stance") == "strongly_agree"))
        | ~F.col("stance").isin(*L.STANCES)
    )
    expected = F.when(F.col("verdict") == "supported", "agree").when(F.col("verdict") == "possibly_contradicted", "strongly_disagree").otherwise("mixed")
    added = F.array_compact(F.array(F.when(bad_quote, "unverified-quoted-evidence"), F.when(lowered, "confidence-downgraded-evidence-limited"), F.when(clash | cut, "stance-corrected-by-reliability-gate")))
    return rows.select(
        "*",
        F.when(lowered, low).otherwise(F.col("confidence")).alias("gated_confidence"),
        F.when(clash, expected).otherwise(F.col("stance")).alias("gated_stance"),
        F.when(cut, F.when(F.col("verdict") == "vague_or_not_checkable", 40).otherwise(30)).otherwise(F.col("support_score")).alias("gated_support"),
        F.array_union("flags", added).alias("gated_flags"),
    )


def clamp(x: Column) -> Column:
    """Half-even integer between 0 and 100; what is no number counts as 0."""
    return F.coalesce(F.least(F.lit(100), F.greatest(F.lit(0), F.bround(F.expr("0.0") + x.try_cast("double"), 0).cast("int"))), F.lit(0))


def normalized_scores(rows: DataFrame) -> DataFrame:
    """Model scores clamped, rescaled from tenths and capped by consistency; with the quality score.

    ``rows``: outrage, toxicity, helpfulness (text or numbers), quote, verdict, actionable.
    """
    names = ("outrage", "toxicity", "helpfulness")
    rows = rows.withColumns({k: clamp(F.col(k)) for k in names})
    top = F.greatest(*(F.col(k) for k in names))
    rows = rows.withColumn("tenths", (top > 0) & (top <= 10))
    rows = rows.withColumns({k: F.when(F.col("tenths"), F.col(k) * 10).otherwise(F.col(k)) for k in names}).drop("tenths")
    quote, verdict = T.truncate_words("quote", 180), T.truncate_words("verdict", 80)
    rows = rows.withColumns({"quote": quote, "verdict": verdict})
    cap = F.least(
        F.when(F.col("actionable"), 100).otherwise(45),
        F.when(T.any_word(F.lower("verdict"), L.LOW_SIGNAL_VERDICTS), 35).otherwise(100),
        F.when((F.col("quote") != "") & (F.size(F.split("quote", " ")) <= 3), 45).otherwise(100),
    )
    rows = rows.withColumn("helpfulness", F.least("helpfulness", cap))
    quality = 0.75 * F.col("helpfulness") + 0.15 * (100 - F.col("outrage")) + 0.10 * (100 - F.col("toxicity"))
    return rows.withColumn("quality_score", F.bround(F.round(quality, 6), 0).cast("int"))


def attention(outrage: Column, helpfulness: Column, toxicity: Column) -> Column:
    return F.bround(F.round(0.75 * outrage + 0.15 * (100 - helpfulness) + 0.10 * toxicity, 6), 0).cast("int")


def outrage_result(rows: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Second scorer: outrageous needs 70 and a real type, the secondary type differs from the first."""
    score = clamp(F.col("score"))
    kind = F.when(F.col("kind").isin(*types), F.col("kind")).otherwise("none")
    second = F.when(F.col("second").isin(*types) & (F.col("second") != kind), F.col("second")).otherwise("none")
    return rows.select("row_id", score.alias("score"), kind.alias("kind"), second.alias("second"), ((score >= 70) & (kind != "none")).alias("outrageous"), T.truncate_words("text", 240).alias("excerpt"))
