"""Annotation tasks, label checks, training rows and scoring requests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlab.functions import text as T
from quorumlab.sources.files import staged


def annotation_tasks(claims: DataFrame, run: str) -> DataFrame:
    """One review task for each review, two tasks for each claim and a third where evidence is disputed, in one table."""

    def tasks(rows: DataFrame, kind: str, key: str) -> DataFrame:
        return rows.select(T.stable_id("task", F.lit(run), F.lit(kind), F.col(key), size=12).alias("task_id"), F.lit(kind).alias("task_type"), F.col(key).alias("item"), "review_id")

    reviews = claims.groupBy("review_id").agg(F.count(F.lit(1)).alias("n"))
    out = tasks(reviews, "review_quality", "review_id")
    for kind in ("claim_validity", "evidence_support"):
        out = out.unionByName(tasks(claims, kind, "claim_key"))
    return out.unionByName(tasks(claims.where("importance = 'major'"), "pairwise_preference", "claim_key"))


def label_errors(rows: DataFrame) -> DataFrame:
    """Errors of each label row: missing fields, unknown values, numbers out of range."""
    errors = F.array_compact(
        F.array(
            F.when(F.coalesce("task_id", F.lit("")) == "", "missing task_id"),
            F.when(F.col("verdict").isNull(), "missing verdict"),
            F.when(~F.col("verdict").isin("supported", "insufficient", "contradicted"), "unknown verdict"),
            F.when(F.col("score").isNull() | ~F.col("score").between(1, 5), "score out of range"),
        )
    )
    return rows.withColumn("errors", errors)


#: Fixed texts of training rows.
AUDITOR = "You audit reviewer claims using paper-review lifecycle evidence. Return concise JSON."
REJECTED_REASON = "This answer over-relies on superficial wording and does not track the provided evidence."
ASKED = ("title", "decision_label", "reviewer_claim", "claim_type", "importance", "source_sentence", "matched_meta_review_segment", "meta_review_text")
ANSWERED = ("meta_review_match", "ac_treatment", "concern_quality", "label_evidence_strength", "confidence", "rationale")
KNOWN = ("task_id", "paper_id", "review_id", "decision_label", "auto_survival_label", "auto_survival_score", "high_confidence_training_candidate")


def training_records(rows: DataFrame) -> DataFrame:
    """One record of each task (the one of the smallest ``ord``), missing texts empty, long meta-reviews cut."""
    first = rows.groupBy("task_id").agg(F.min(F.struct("ord", *(c for c in rows.columns if c not in ("ord", "task_id")))).alias("r"))
    rows = first.select("task_id", "r.*").drop("ord")
    texts = [f.name for f in rows.schema if f.dataType.typeName() == "string"]
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in texts})
    text = T.clean_text("meta_review_text")
    cut = F.when(F.length(text) <= 5000, text).otherwise(F.concat(F.rtrim(F.left(text, F.lit(4997))), F.lit("...")))
    return rows.withColumns({"meta_review_text": cut, "reviewer_claim": F.col("claim_text"), "matched_meta_review_segment": F.col("matched_segment")})


def _json(names: tuple[str, ...], **changed: Column) -> Column:
    return F.to_json(F.struct(*(changed.get(n, F.col(n)).alias(n) for n in names)))


def sft_rows(records: DataFrame) -> DataFrame:
    """Chat messages of labelled claims: an instruction, the evidence, the expected answer; with metadata."""
    said = (("system", F.lit(AUDITOR)), ("user", _json(ASKED)), ("assistant", _json(ANSWERED)))
    messages = F.array(*(F.struct(F.lit(r).alias("role"), t.alias("content")) for r, t in said))
    return records.select("task_id", F.to_json(F.struct(messages.alias("messages"), F.struct(*KNOWN).alias("metadata"))).alias("json"))


def preference_pairs(records: DataFrame) -> DataFrame:
    """The expected answer and one with the opposite match, the opposite quality and an empty reason."""
    match = F.when(F.col("meta_review_match").isin("survived", "partial"), "not_found").otherwise("survived")
    quality = F.when(F.col("concern_quality") == "low", "high").otherwise("low")
    rejected = _json(ANSWERED, meta_review_match=match, concern_quality=quality, rationale=F.lit(REJECTED_REASON))
    pair = F.struct(_json(ASKED).alias("prompt"), _json(ANSWERED).alias("chosen"), rejected.alias("rejected"), F.struct(*KNOWN).alias("metadata"))
    return records.select("task_id", F.to_json(pair).alias("json"))


def case_rows(records: DataFrame) -> DataFrame:
    """Case-memory rows with tags; a tag without a value is left out."""
    named = (("match", "meta_review_match"), ("quality", "concern_quality"), ("type", "claim_type"), ("decision", "decision_label"))
    tags = F.array_compact(F.array(*(F.when(F.col(c) != "", F.concat(F.lit(f"{k}:"), c)) for k, c in named)))
    claim = F.struct(F.col("claim_text").alias("text"), F.col("claim_type").alias("type"), "importance", "source_sentence")
    review = F.struct(F.col("meta_review_match").alias("match"), "ac_treatment", "matched_segment")
    quality = F.struct("concern_quality", "label_evidence_strength", "confidence")
    return records.select("task_id", F.to_json(F.struct(claim.alias("claim"), review.alias("meta_review"), quality.alias("quality"), "rationale", tags.alias("tags"))).alias("json"))


def scoring_requests(reviews: DataFrame, sent: DataFrame, limit_chars: int = 6000) -> DataFrame:
    """One JSON request for each review with text that was not sent before, under a stable id."""
    key = F.left(F.regexp_replace(F.concat_ws(":", "venue", "paper_id", "review_id"), "[^A-Za-z0-9_-]+", "_"), F.lit(64))
    rows = reviews.withColumns({"custom_id": key, "body": F.left(T.clean_ws("review_text"), F.lit(limit_chars))}).where(F.col("body") != "")
    rows = rows.join(sent, "custom_id", "left_anti")
    request = F.to_json(F.struct("custom_id", F.lit("/v1/chat").alias("url"), F.struct(F.col("body").alias("text"), F.lit(120).alias("max_tokens")).alias("body")))
    return rows.select("custom_id", "venue", request.alias("request"), F.greatest(F.lit(1), F.bround(F.length("body") / 4.0, 0).cast("bigint")).alias("tokens"))


def _jumps(tokens: np.ndarray, budget: int, most: int) -> np.ndarray:
    """For each row the first row of the next part, if a part begins at it; ``len(tokens)`` or more: beyond the block."""
    total = np.concatenate([[0], np.cumsum(tokens)])
    fits = np.searchsorted(total, total[:-1] + budget, "right") - 1
    return np.minimum(np.maximum(fits, np.arange(len(tokens)) + 1), np.arange(len(tokens)) + most)


def _first_part(tokens: np.ndarray, held: int, n: int, budget: int, most: int) -> int:
    """The row at which the part that is open with ``n`` rows and ``held`` tokens ends."""
    if not n:
        return 0
    return int(min(np.searchsorted(np.cumsum(tokens), budget - held, "right"), most - n, len(tokens)))


def split_batches(requests: DataFrame, group: str, budget: int, most: int, block_rows: int = 50_000) -> DataFrame:
    """Next-fit packing of each group's requests, in the order of their ids, into parts by tokens and count.

    A part starts when the next request would exceed ``budget`` tokens or ``most`` requests; a larger request is a
    part of its own. Requests are dealt by ranges of (group, id) into blocks of about ``block_rows``. However a
    block is entered, its first part begins within its first ``most`` rows, so each block sums up for these what
    it hands on (parts, and the open part's rows and tokens); only these sums are chained, and each block then
    numbers its own rows. Repeated ids count one by one; an empty table gives no rows.
    """
    blocks = max(1, math.ceil(requests.count() / block_rows))
    ranged = requests.select("custom_id", group, F.col("tokens").cast("bigint").alias("tokens")).repartitionByRange(blocks, group, "custom_id", "tokens")
    rows = staged(ranged.withColumn("block", F.spark_partition_id()), "requests")

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        tokens = part.sort_values(["custom_id", "tokens"])["tokens"].to_numpy()
        jump, size = _jumps(tokens, budget, most), len(tokens)
        ways = []
        for start in range(min(most, size)):
            at, parts = start, 1
            while jump[at] < size:
                at, parts = int(jump[at]), parts + 1
            ways.append((parts, size - at, int(tokens[at:].sum())))
        names = ("parts", "rows", "held")
        return pd.DataFrame({group: [part[group].iloc[0]], "block": [part["block"].iloc[0]], "size": [size], "lead": [tokens[:most].tolist()], **{n: [[w[i] for w in ways]] for i, n in enumerate(names)}})

    def chained(part: pd.DataFrame) -> pd.DataFrame:
        done, n, held, out = 0, 0, 0, []
        for _, b in part.sort_values("block").iterrows():
            lead = np.asarray(b["lead"], np.int64)
            first = _first_part(lead, held, n, budget, most)
            out.append((b[group], b["block"], done, n, held))
            if first >= b["size"]:
                n, held = n + int(b["size"]), held + int(lead.sum())
            else:
                done += int(b["parts"][first]) - (0 if n else 1)
                n, held = int(b["rows"][first]), int(b["held"][first])
        return pd.DataFrame(out, columns=[group, "block", "done", "n", "held_before"])

    def numbered(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["custom_id", "tokens"])
        tokens = part["tokens"].to_numpy()
        done, n, held = (int(part[c].iloc[0]) for c in ("done", "n", "held_before"))
        first = _first_part(tokens, held, n, budget, most)
        fresh = np.zeros(len(tokens), np.int64)
        jump, at = _jumps(tokens, budget, most), first
        while at < len(tokens):
            fresh[at], at = 1, int(jump[at])
        fresh[0] -= int(first == 0 and n == 0)  # the first part of a group begins without one before it
        return part.assign(part=done + np.cumsum(fresh))[["custom_id", group, "tokens", "part"]]

    kind = requests.schema[group].dataType.simpleString()
    sums = rows.groupBy(group, "block").applyInPandas(summed, f"{group} {kind}, block int, size bigint, lead array<bigint>, parts array<bigint>, rows array<bigint>, held array<bigint>")
    entries = staged(sums.groupBy(group).applyInPandas(chained, f"{group} {kind}, block int, done bigint, n bigint, held_before bigint"), "request-blocks")
    entered = rows.join(entries, [group, "block"])
    return entered.groupBy(group, "block").applyInPandas(numbered, f"custom_id string, {group} {kind}, tokens bigint, part int")
