"""Best matches of claims within their paper: meta-review, other reviewers, response and discussion.

Claims and segments meet in one join on the paper, over token sets computed once per row, and the best
partners are partially aggregated maxima, so no group is sorted or gathered. Ties go to the earlier partner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlab.functions import lexicons as L
from quorumlab.functions import text as T
from quorumlab.sources.files import staged

STRONG, PARTIAL = 0.34, 0.2
RESOLVED = 0.3


def survival_label(score: Column) -> Column:
    return F.when(score >= STRONG, "survived").when(score >= PARTIAL, "partial").otherwise("not_found")


def consensus_label(score: Column) -> Column:
    return F.when(score >= STRONG, "strong").when(score >= PARTIAL, "partial").otherwise("none")


def is_concern(claims: DataFrame) -> DataFrame:
    """Claims from weakness or question fields, or free text with a concern cue."""
    field = F.lower(F.coalesce("source_field", F.lit("")))
    text = F.lower(F.concat_ws(" ", "claim_text", "source_sentence"))
    return claims.where(field.isin("weaknesses", "questions") | ((field == "review_text") & T.any_word(text, L.CONCERN_CUES)))


def prepared(claims: DataFrame) -> DataFrame:
    """``claims`` with their three token sets, unless they have them."""
    if "tokens" in claims.columns:
        return claims
    typed = F.concat_ws(" ", "claim_text", "claim_type")
    return claims.withColumns({"tokens": T.concern_tokens("claim_text"), "source_tokens": T.concern_tokens("source_sentence"), "typed_tokens": T.concern_tokens(typed)})


def pieces(segments: DataFrame) -> DataFrame:
    """Segments with their token sets; ``closing`` ones tell survival: meta-reviews, or responses where a paper has none."""
    if "found" in segments.columns:
        return segments
    judged = segments.where("note_type = 'meta_review'").select("paper_id", F.lit(True).alias("judged")).distinct()
    rows = segments.select("paper_id", "note_type", "ord", "segment", T.concern_tokens("segment").alias("found")).join(judged, "paper_id", "left")
    closing = F.when(F.col("judged"), F.col("note_type") == "meta_review").otherwise(F.col("note_type") == "author_response")
    return rows.withColumn("closing", closing).drop("judged")


def best_segments(claims: DataFrame, segments: DataFrame) -> DataFrame:
    """Per claim its best closing segment over three queries, its best response and its best comment.

    One join on the paper serves all of them; what a caller does not select is not computed. The higher score
    wins, then the earlier query, then the earlier segment; scores of 0 do not count.
    """
    queries = prepared(claims).select("task_id", "paper_id", "tokens", "source_tokens", "typed_tokens")
    pairs = queries.join(pieces(segments), "paper_id")
    # common tokens, then scores, are columns of their own, so that what refers to them does not compute them again
    named = {"tokens": "plain", "source_tokens": "by_source", "typed_tokens": "by_type"}
    wanted = {q: F.lit(True) if q == "tokens" else F.col("closing") for q in named}
    pairs = pairs.withColumns({f"{s}_common": F.when(wanted[q], F.array_intersect(q, "found")) for q, s in named.items()})
    pairs = pairs.where(F.size("plain_common") + F.coalesce(F.size("by_source_common"), F.lit(0)) + F.coalesce(F.size("by_type_common"), F.lit(0)) > 0)
    pairs = pairs.withColumns({s: T.overlap_of(F.col(f"{s}_common"), F.col(q), F.col("found")) for q, s in named.items()})

    def candidate(score: Column, basis: int, of: Column) -> Column:
        return F.when(of & (score > 0), F.struct(score.alias("score"), F.lit(-basis).alias("b"), (-F.col("ord")).alias("o"), "segment"))

    plain, closing = F.col("plain"), F.col("closing")
    ended = F.greatest(*(candidate(F.col(s), i, closing) for i, s in enumerate(named.values())))
    return pairs.groupBy("task_id").agg(
        F.max(ended).alias("ended"),
        F.max(candidate(plain, 0, F.col("note_type") == "author_response")).alias("response"),
        F.max(candidate(plain, 0, F.col("note_type") == "official_comment")).alias("comment"),
    )


def _score(name: str) -> Column:
    return F.coalesce(F.col(f"{name}.score"), F.lit(0.0))


def _survival() -> list[Column]:
    score, basis = _score("ended"), F.col("ended.b")
    named = F.when(basis == 0, "claim_text").when(basis == -1, "source_sentence").when(basis == -2, "claim_plus_type")
    return [
        survival_label(score).alias("survival_label"),
        T.round4(score).alias("survival_score"),
        F.coalesce(named, F.lit("")).alias("match_basis"),
        F.coalesce("ended.segment", F.lit("")).alias("matched_segment"),
    ]


def _rebuttal() -> list[Column]:
    score = _score("response")
    cue = F.arrays_overlap(F.split(F.lower(T.clean_text("response.segment")), r"[ \t\n\r\f]+"), T.words_of(L.RESOLUTION_CUES))
    label = F.when(score < PARTIAL, "not_addressed").when((score >= RESOLVED) & cue, "likely_resolved_or_answered").otherwise("addressed_unclear_resolution")
    return [label.alias("rebuttal_label"), T.round4(score).alias("rebuttal_score")]


def _discussion() -> list[Column]:
    score = _score("comment")
    return [F.when(score >= PARTIAL, "followed_up").otherwise("not_found").alias("discussion_label"), T.round4(score).alias("discussion_score")]


def _matched(claims: DataFrame, segments: DataFrame, columns: list[Column]) -> DataFrame:
    return claims.select("task_id").join(best_segments(claims, segments), "task_id", "left").select("task_id", *columns)


def survival(claims: DataFrame, segments: DataFrame) -> DataFrame:
    """Per claim: label, score and basis of its best match over three query texts."""
    return _matched(claims, segments, _survival())


def rebuttal(claims: DataFrame, segments: DataFrame) -> DataFrame:
    """How the authors' response answers each claim."""
    return _matched(claims, segments, _rebuttal())


def discussion(claims: DataFrame, segments: DataFrame) -> DataFrame:
    """Whether reviewers' comments take a claim up."""
    return _matched(claims, segments, _discussion())


def consensus(claims: DataFrame) -> DataFrame:
    """Best claim of another review of the same paper, with a bonus for an equal type.

    Claims of a paper meet on the tokens they share, and what they share is counted, so no two claims without a common
    token are paired. Those can only score by the bonus: beside the index, each (paper, type) has its first claims of two
    reviews, of which one is another's for any claim. The earliest of equal scores counts.
    """
    rows = prepared(claims).select("task_id", "paper_id", "review_id", "claim_type", "turn", "claim_index", "tokens", F.size("tokens").alias("n"))
    rows = staged(rows, "consensus-claims")
    tokens = rows.select("task_id", "paper_id", "review_id", "claim_type", "turn", "claim_index", "n", F.explode("tokens").alias("token"))
    facts = ("task_id", "review_id", "claim_type", "turn", "claim_index", "n")
    other = tokens.select("paper_id", "token", *(F.col(c).alias(f"other_{c}") for c in facts))
    shared = tokens.select("paper_id", "token", "task_id", "review_id", "claim_type", "n").join(other, ["paper_id", "token"]).where("review_id <> other_review_id")
    pairs = shared.groupBy("task_id", "other_task_id").agg(
        F.count(F.lit(1)).alias("common"),
        F.max(F.col("token").isin(*L.ANCHORS)).alias("anchored"),
        *(F.first(c).alias(c) for c in ("claim_type", "n", *(f"other_{x}" for x in facts if x != "task_id"))),
    )
    bonus = F.when((F.col("claim_type") != "") & (F.col("claim_type") == F.col("other_claim_type")), 0.05).otherwise(0.0)
    score = F.least(F.lit(1.0), T.overlap_counted(F.col("common"), F.col("n"), F.col("other_n"), F.col("anchored")) + bonus)
    found = pairs.select("task_id", score.alias("score"), F.col("other_turn").alias("turn"), F.col("other_claim_index").alias("claim_index"), F.col("other_review_id").alias("other"))
    # the bonus alone: the first claim of a type in each of two reviews of a paper
    typed = rows.where("claim_type <> ''")
    firsts = typed.groupBy("paper_id", "claim_type", "review_id").agg(F.min(F.struct("turn", "claim_index")).alias("at"))
    order = Window.partitionBy("paper_id", "claim_type").orderBy("at", F.desc("review_id"))
    firsts = firsts.withColumn("place", F.row_number().over(order)).where("place <= 2")
    firsts = firsts.select("paper_id", "claim_type", F.col("review_id").alias("other"), "at.turn", "at.claim_index")
    by_type = typed.where("n > 0").select("task_id", "paper_id", "review_id", "claim_type").join(firsts, ["paper_id", "claim_type"]).where("review_id <> other")
    found = found.unionByName(by_type.select("task_id", F.lit(0.05).alias("score"), "turn", "claim_index", "other"))
    best = F.max(F.struct("score", (-F.col("turn")).alias("t"), (-F.col("claim_index")).alias("i"), "other"))
    best = found.where("score > 0").groupBy("task_id").agg(best.alias("best")).select("task_id", "best.score", "best.other")
    out = rows.select("task_id").join(best, "task_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return out.select("task_id", consensus_label(F.col("score")).alias("consensus_proxy"), T.round4(F.col("score")).alias("consensus_score"), F.coalesce("other", F.lit("")).alias("matched_review_id"))


def signals(claims: DataFrame, segments: DataFrame) -> DataFrame:
    """All four matches of each claim beside its own columns; claims and segments are tokenized and kept once."""
    claims, segments = staged(prepared(claims), "claims"), staged(pieces(segments), "segments")
    found = claims.join(best_segments(claims, segments), "task_id", "left").join(consensus(claims), "task_id")
    named = ("consensus_proxy", "consensus_score", "matched_review_id")
    return found.select(*(c for c in claims.columns if not c.endswith("_tokens")), *named, *_survival(), *_rebuttal(), *_discussion())
