"""Queries of samples, exports and corpus adapters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quorumlab.functions import lexicons as L
from quorumlab.functions import text as T
from quorumlab.operators import adapters, exports, matching, sampling
from quorumlab.plans import lifecycle_plans  # noqa: F401  (its stand-ins)
from quorumlab.plans import standins as S
from quorumlab.plans.registry import query
from quorumlab.sources.files import staged

LABELS = ("survived", "partial", "not_found")
S.add_cte("pool", "SELECT c.task_id, c.claim_type, c.importance, c.claim_text, s.survival_label, s.survival_score FROM claims c JOIN survival s USING (task_id)", "claims", "survival")


def _pool(spark: SparkSession, d: str) -> DataFrame:
    rows = S.claims(spark, d)
    found = matching.survival(rows, S.segments(spark, d)).select("task_id", "survival_label", "survival_score")
    return rows.select("task_id", "claim_type", "importance", "claim_text").join(found, "task_id")


S.add_cte("pool7", "SELECT *, md5('7:' || task_id) AS k FROM pool", "pool")
S.add_cte("quota7", "SELECT task_id FROM (SELECT *, row_number() OVER (PARTITION BY survival_label ORDER BY k) AS rn FROM pool7) WHERE rn <= CASE survival_label WHEN 'survived' THEN 67 WHEN 'partial' THEN 67 ELSE 66 END", "pool7")


@query(S.sql("SELECT task_id, 'quota' AS reason FROM quota7 UNION ALL (SELECT task_id, 'fill' FROM pool7 WHERE task_id NOT IN (SELECT task_id FROM quota7) ORDER BY k LIMIT (SELECT 200 - count(*) FROM quota7))", "quota7"))
def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.balanced(_pool(spark, d), "survival_label", LABELS, 200, 7).select("task_id", "reason")


S.add_cte("pool29", "SELECT *, md5('29:' || task_id) AS k FROM pool", "pool")
S.add_cte("t1", "SELECT task_id FROM pool29 WHERE survival_label = 'survived' ORDER BY k LIMIT 30", "pool29")
S.add_cte("t2", "SELECT task_id FROM pool29 WHERE importance = 'minor' AND task_id NOT IN (SELECT task_id FROM t1) ORDER BY k LIMIT 30", "pool29", "t1")
S.add_cte("t3", "SELECT task_id FROM pool29 WHERE claim_type = 'theory' AND task_id NOT IN (SELECT task_id FROM t1 UNION ALL SELECT task_id FROM t2) ORDER BY k LIMIT (SELECT 100 - (SELECT count(*) FROM t1) - (SELECT count(*) FROM t2))", "pool29", "t1", "t2")
S.add_cte("t123", "SELECT task_id, 'survivor' AS reason FROM t1 UNION ALL SELECT task_id, 'minor' FROM t2 UNION ALL SELECT task_id, 'theory' FROM t3", "t1", "t2", "t3")


@query(S.sql("SELECT * FROM t123 UNION ALL (SELECT task_id, 'fill_remaining' FROM pool29 WHERE task_id NOT IN (SELECT task_id FROM t123) ORDER BY k LIMIT (SELECT 100 - count(*) FROM t123))", "t123", "pool29"))
def targeted_sample(spark: SparkSession, d: str) -> DataFrame:
    buckets = [("survivor", 0.3, F.col("survival_label") == "survived"), ("minor", 0.3, F.col("importance") == "minor"), ("theory", 0.4, F.col("claim_type") == "theory")]
    return sampling.targeted(_pool(spark, d), buckets, 100, 29).select("task_id", "reason")


@query(S.sql("SELECT task_id FROM (SELECT task_id FROM pool WHERE survival_label = 'not_found' AND survival_score <= 0.16 ORDER BY survival_score, task_id LIMIT 120) ORDER BY md5('11:' || task_id) LIMIT 60", "pool"))
def negative_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.negative(_pool(spark, d), "survival_score", 60, 11).select("task_id")


@query(
    S.sql(
        """SELECT task_id FROM (SELECT *, CASE WHEN tier = 2 THEN row_number() OVER (PARTITION BY tier, importance ORDER BY k) ELSE 0 END AS turn, row_number() OVER (PARTITION BY tier, survival_label ORDER BY k) AS j
FROM (SELECT *, md5('5:' || task_id) AS k, CASE survival_label WHEN 'survived' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END AS tier FROM pool)) WHERE tier <> 1 OR j <= 2 ORDER BY tier, turn, importance, k LIMIT 90""",
        "pool",
    )
)
def stratified_pilot(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified(_pool(spark, d), "survival_label", ("survived",), "partial", "importance", 90, 5).select("task_id")


# exports


def _id_sql(kind: str, key: str) -> str:
    return f"'task_' || left(sha1('run1||{kind}||' || {key}), 12) AS task_id, '{kind}' AS task_type"


@query(S.sql(f"SELECT {_id_sql('review_quality', 'review_id')}, review_id AS item FROM (SELECT DISTINCT review_id FROM claims) UNION ALL SELECT {_id_sql('claim_validity', 'task_id')}, task_id FROM claims UNION ALL SELECT {_id_sql('evidence_support', 'task_id')}, task_id FROM claims UNION ALL SELECT {_id_sql('pairwise_preference', 'task_id')}, task_id FROM claims WHERE importance = 'major'", "claims"))
def annotation_tasks(spark: SparkSession, d: str) -> DataFrame:
    rows = S.claims(spark, d).withColumnRenamed("task_id", "claim_key")
    return exports.annotation_tasks(rows, "run1").select("task_id", "task_type", "item")


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN t = '' THEN 'missing task_id' END, CASE WHEN v IS NULL THEN 'missing verdict' END, CASE WHEN v NOT IN ('supported', 'insufficient', 'contradicted') THEN 'unknown verdict' END, CASE WHEN s IS NULL OR s NOT BETWEEN 1 AND 5 THEN 'score out of range' END], lambda x: x IS NOT NULL), '|') AS errors FROM (SELECT doc_id, CASE WHEN n_chars % 6 = 0 THEN '' ELSE 't' END AS t, CASE n_chars % 5 WHEN 0 THEN NULL WHEN 1 THEN 'odd' ELSE 'supported' END AS v, n_chars % 8 AS s FROM documents)")
def validate_labels(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    rows = S.table(spark, d, "documents").select("doc_id", F.when(n % 6 == 0, "").otherwise("t").alias("task_id"), F.when(n % 5 == 0, None).when(n % 5 == 1, "odd").otherwise("supported").alias("verdict"), (n % 8).alias("score"))
    return exports.label_errors(rows).select("doc_id", F.array_join("errors", "|").alias("errors"))


_QUALITY = "['high', 'medium', 'low', ''][length(claim_text) % 4 + 1]"
S.add_cte(
    "record",
    f"""SELECT c.task_id, c.paper_id, c.review_id, 'Paper ' || c.paper_id AS title, CASE WHEN c.turn % 2 = 0 THEN 'accept' ELSE '' END AS decision_label, c.claim_text, c.claim_type, c.importance, c.source_sentence,
  s.matched_segment, repeat(c.claim_text || ' ', 1 + 200 * (length(c.claim_text) % 2)) AS meta_review_text, l.meta_label AS meta_review_match, l.response_label AS ac_treatment, {_QUALITY} AS concern_quality,
  l.effect_label AS label_evidence_strength, l.confidence, 'because ' || c.claim_type AS rationale, s.survival_label AS auto_survival_label, s.survival_score AS auto_survival_score, l.confidence = 'high' AS high_confidence_training_candidate
FROM claims c JOIN survival s USING (task_id) JOIN claim_labels l USING (task_id)""",
    "claims", "survival", "claim_labels",
)
_TEXT5000 = f"CASE WHEN length({S.d_clean('meta_review_text')}) <= 5000 THEN {S.d_clean('meta_review_text')} ELSE rtrim(left({S.d_clean('meta_review_text')}, 4997)) || '...' END"
_ASKED = f"md5(concat_ws('|', title, decision_label, claim_text, claim_type, importance, source_sentence, matched_segment, {_TEXT5000}))"
_OPPOSITE = "CASE meta_review_match WHEN 'not_found' THEN 'survived' WHEN 'survived' THEN 'not_found' WHEN 'partial' THEN 'not_found' ELSE 'survived' END"
_KNOWN = "md5(concat_ws('|', task_id, paper_id, review_id, decision_label, auto_survival_label, CAST(round(auto_survival_score * 10000) AS BIGINT), CASE WHEN high_confidence_training_candidate THEN 'true' ELSE 'false' END))"
_TAGS = "array_to_string(list_filter(['match:' || meta_review_match, 'quality:' || concern_quality, 'type:' || claim_type, 'decision:' || decision_label], lambda t: NOT suffix(t, ':')), '|')"


@query(
    S.sql(
        f"""SELECT task_id, 'sft' AS kind, {_ASKED} AS asked, concat_ws('|', meta_review_match, ac_treatment, concern_quality, label_evidence_strength, confidence, rationale) AS answer, '' AS other, {_KNOWN} AS known FROM record
UNION ALL SELECT task_id, 'preference', {_ASKED}, concat_ws('|', meta_review_match, ac_treatment, concern_quality, label_evidence_strength, confidence, rationale),
  concat_ws('|', {_OPPOSITE}, ac_treatment, CASE WHEN concern_quality <> 'low' THEN 'low' ELSE 'high' END, label_evidence_strength, confidence, '{exports.REJECTED_REASON}'), {_KNOWN} FROM record
UNION ALL SELECT task_id, 'case', md5(concat_ws('|', claim_text, claim_type, importance, source_sentence)), concat_ws('|', meta_review_match, ac_treatment, md5(matched_segment), concern_quality, label_evidence_strength, confidence, rationale), {_TAGS}, '' FROM record""",
        "record",
    )
)
def training_exports(spark: SparkSession, d: str) -> DataFrame:
    """Messages, preference pairs and case rows, read back from their JSON; each record comes in twice."""
    n, claims = F.length("claim_text"), staged(S.claims(spark, d), "claims")
    found = matching.survival(claims, S.segments(spark, d)).select("task_id", "matched_segment", F.col("survival_label").alias("auto_survival_label"), F.col("survival_score").alias("auto_survival_score"))
    labels = S.claim_labels(spark, d).withColumnsRenamed({"meta_label": "meta_review_match", "response_label": "ac_treatment", "effect_label": "label_evidence_strength"}).drop("consensus_label")
    # each record comes in twice and goes out in three forms; texts are read and matched once
    rows = staged(claims.join(found, "task_id").join(labels, "task_id"), "labelled-claims").withColumns(
        {
            "title": F.concat(F.lit("Paper "), "paper_id"),
            "decision_label": F.when(F.col("turn") % 2 == 0, "accept"),
            "meta_review_text": F.repeat(F.concat("claim_text", F.lit(" ")), (1 + 200 * (n % 2)).cast("int")),
            "concern_quality": F.element_at(T.words_of(("high", "medium", "low", "")), n % 4 + 1),
            "rationale": F.concat(F.lit("because "), "claim_type"),
            "high_confidence_training_candidate": F.col("confidence") == "high",
        }
    )
    again = rows.withColumn("title", F.lit("a later record of the task"))
    records = exports.training_records(rows.withColumn("ord", F.lit(0)).unionByName(again.withColumn("ord", F.lit(1))).drop("turn", "claim_index", "source_field"))
    records = staged(records, "training-records")
    read = lambda c, names: F.from_json(c, ", ".join(f"{x} string" for x in names))
    joined = lambda c, names: F.concat_ws("|", *(read(c, names)[x] for x in names))
    digest = lambda c: F.md5(c.cast("binary"))

    def known(m) -> Column:
        score = F.round(m["auto_survival_score"] * 10000).cast("bigint").cast("string")
        return digest(F.concat_ws("|", *(score if x == "auto_survival_score" else m[x].cast("string") for x in exports.KNOWN)))

    meta = "metadata struct<" + ", ".join(f"{x}: {'double' if x.endswith('score') else 'boolean' if x.startswith('high') else 'string'}" for x in exports.KNOWN) + ">"
    sft = exports.sft_rows(records).select("task_id", F.from_json("json", f"messages array<struct<role: string, content: string>>, {meta}").alias("j"))
    sft = sft.where(F.transform("j.messages", lambda x: x["role"]) == T.words_of(("system", "user", "assistant")))
    sft = sft.select("task_id", F.lit("sft").alias("kind"), digest(joined(F.col("j.messages")[1]["content"], exports.ASKED)).alias("asked"), joined(F.col("j.messages")[2]["content"], exports.ANSWERED).alias("answer"), F.lit("").alias("other"), known(F.col("j.metadata")).alias("known"))
    pair = exports.preference_pairs(records).select("task_id", F.from_json("json", f"prompt string, chosen string, rejected string, {meta}").alias("j"))
    pair = pair.select("task_id", F.lit("preference").alias("kind"), digest(joined(F.col("j.prompt"), exports.ASKED)).alias("asked"), joined(F.col("j.chosen"), exports.ANSWERED).alias("answer"), joined(F.col("j.rejected"), exports.ANSWERED).alias("other"), known(F.col("j.metadata")).alias("known"))
    shape = "claim struct<text: string, type: string, importance: string, source_sentence: string>, meta_review struct<match: string, ac_treatment: string, matched_segment: string>, quality struct<concern_quality: string, label_evidence_strength: string, confidence: string>, rationale string, tags array<string>"
    case = exports.case_rows(records).select("task_id", F.from_json("json", shape).alias("j"))
    answer = F.concat_ws("|", "j.meta_review.match", "j.meta_review.ac_treatment", digest(F.col("j.meta_review.matched_segment")), "j.quality.concern_quality", "j.quality.label_evidence_strength", "j.quality.confidence", "j.rationale")
    case = case.select("task_id", F.lit("case").alias("kind"), digest(F.concat_ws("|", "j.claim.text", "j.claim.type", "j.claim.importance", "j.claim.source_sentence")).alias("asked"), answer.alias("answer"), F.array_join("j.tags", "|").alias("other"), F.lit("").alias("known"))
    return sft.unionByName(pair).unionByName(case)


@query(S.sql("SELECT task_id, response_label, effect_label FROM claim_labels WHERE response_label IN ('not_addressed', 'generic_or_unclear') OR effect_label IN ('does_not_address', 'partially_addresses', 'unclear')", "claim_labels"))
def addressability_tasks(spark: SparkSession, d: str) -> DataFrame:
    rows = S.claim_labels(spark, d)
    open_ = F.col("response_label").isin("not_addressed", "generic_or_unclear") | F.col("effect_label").isin("does_not_address", "partially_addresses", "unclear")
    return rows.where(open_).select("task_id", "response_label", "effect_label")


S.add_cte("requests", f"SELECT left(regexp_replace(concat_ws(':', venue, paper_id, review_id), '[^A-Za-z0-9_-]+', '_', 'g'), 64) AS custom_id, venue, left({S.d_clean_ws('review_text')}, 6000) AS body FROM v_review WHERE {S.d_clean_ws('review_text')} <> '' AND reviewer_index <> 2", "v_review")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    rows = S.view(spark, d, "v_review")
    key = F.left(F.regexp_replace(F.concat_ws(":", "venue", "paper_id", "review_id"), "[^A-Za-z0-9_-]+", "_"), F.lit(64))
    return exports.scoring_requests(rows, rows.where("reviewer_index = 2").select(key.alias("custom_id")))


@query(S.sql("SELECT custom_id, md5(body) AS digest, greatest(1, CAST(round_even(length(body) / 4.0, 0) AS BIGINT)) AS tokens FROM requests", "requests"))
def scoring_requests(spark: SparkSession, d: str) -> DataFrame:
    body = F.from_json("request", "body struct<text: string>")["body"]["text"]
    return _requests(spark, d).select("custom_id", F.md5(body.cast("binary")).alias("digest"), "tokens")


S.add_cte("ordered_requests", "SELECT *, row_number() OVER (PARTITION BY venue ORDER BY custom_id) AS rn FROM (SELECT custom_id, venue, greatest(1, CAST(round_even(length(body) / 4.0, 0) AS BIGINT)) AS tokens FROM requests)", "requests")


@query(
    S.sql(
        """SELECT custom_id, venue, tokens, part FROM (WITH RECURSIVE walk AS (
  SELECT custom_id, venue, tokens, rn, tokens AS held, 1 AS n, 0 AS part FROM ordered_requests WHERE rn = 1
  UNION ALL
  SELECT r.custom_id, r.venue, r.tokens, r.rn, CASE WHEN held + r.tokens > 20000 OR n >= 40 THEN r.tokens ELSE held + r.tokens END, CASE WHEN held + r.tokens > 20000 OR n >= 40 THEN 1 ELSE n + 1 END,
    part + CASE WHEN held + r.tokens > 20000 OR n >= 40 THEN 1 ELSE 0 END
  FROM walk w JOIN ordered_requests r ON r.venue = w.venue AND r.rn = w.rn + 1)
SELECT * FROM walk)""",
        "ordered_requests",
    )
)
def split_batches(spark: SparkSession, d: str) -> DataFrame:
    return exports.split_batches(_requests(spark, d), "venue", 20_000, 40)


# adapters

#: Labels of the stand-in corpora by dimension, with their mapped scores.
_CORPORA = {
    "actionability": {"yes": ("actionable", 0.9), "partial": ("partially_actionable", 0.55), "not_actionable": ("not_actionable", 0.15)},
    "specificity": {"concrete": ("specific", 0.9), "medium": ("partially_specific", 0.55), "generic": ("vague", 0.15)},
    "substantiation": {"supported": ("substantiated", 0.9), "partially_supported": ("partially_substantiated", 0.55), "no": ("unsubstantiated", 0.15)},
    "rebuttal_robustness": {"resolved_or_weakened": ("resolved_or_weakened", 0.1), "partially_addresses": ("partially_addresses", 0.5), "not_addressed": ("not_addressed", 0.9)},
    "professionalism": {"polite": ("polite", 0.85), "neutral": ("neutral", 0.55), "impolite": ("impolite", 0.15)},
}
_TAILS = ("", " Please clarify the tables.", " We compared every baseline", " nothing more")
_CONTEXTS = ("", "We added it.", "This will include a proof", "Thank you")


def _generic_sql(dimension: str) -> str:
    known = list(_CORPORA[dimension].values())
    gold = f"CASE n_chars % 4 WHEN 3 THEN NULL ELSE {S._list(x[0] for x in known)}[n_chars % 4 + 1] END"
    score = f"[{', '.join(f'{x[1]}::DOUBLE' for x in known)}][n_chars % 4 + 1]"
    tokens = f"list_distinct({S.d_token_list('whole')})"
    rule = {
        "actionability": f"CASE WHEN list_has_any({tokens}, {S._list(L.ACTION_TOKENS)}) THEN 'actionable' ELSE 'not_actionable' END",
        "specificity": f"CASE WHEN list_has_any({tokens}, {S._list(L.SPECIFIC_TOKENS)}) THEN 'specific' ELSE 'vague' END",
        "substantiation": "CASE WHEN context <> '' THEN 'substantiated' ELSE 'unsubstantiated' END",
        "rebuttal_robustness": "CASE WHEN regexp_matches(lower(context), 'will add|we added|revised|resolved|fixed') THEN 'resolved_or_weakened' WHEN regexp_matches(lower(context), 'clarify|partially|will include') THEN 'partially_addresses' WHEN context <> '' THEN 'generic_or_unclear' ELSE 'not_addressed' END",
    }.get(dimension, "gold")
    given = f"CASE n_chars % 7 WHEN 0 THEN '{known[0][0]}' END"
    return f"""SELECT '{dimension}:' || doc_id AS task_id, '{dimension}' AS dataset, '{dimension}' AS dimension, comment AS input_text, context AS context_text, gold AS gold_label, coalesce({given}, {rule}) AS predicted_label, {score} AS mapped_score
FROM (SELECT *, {gold} AS gold, concat_ws(' ', doc_id, comment, '', context, stance, predicted) AS whole FROM corpus_rows) WHERE gold IS NOT NULL AND comment <> ''"""


S.add_cte("corpus_rows", f"SELECT doc_id, n_chars, trim(coalesce(text, '') || {S._list(_TAILS)}[doc_id % 4 + 1]) AS comment, {S._list(_CONTEXTS)}[n_chars % 3 + doc_id % 2 + 1] AS context, '' AS stance, '' AS predicted FROM documents")
S.add_cte("generic", " UNION ALL ".join(map(_generic_sql, _CORPORA)), "corpus_rows")


def _generic(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as the comments of five corpora, one for each dimension."""
    n, out = F.col("n_chars"), None
    docs = S.table(spark, d, "documents")
    comment = F.trim(F.concat(F.coalesce("text", F.lit("")), F.element_at(T.words_of(_TAILS), (F.col("doc_id") % 4 + 1).cast("int"))))
    context = F.element_at(T.words_of(_CONTEXTS), (n % 3 + F.col("doc_id") % 2 + 1).cast("int"))
    for dimension, labels in _CORPORA.items():
        stance = F.when(n % 4 == 3, "other").otherwise(F.element_at(T.words_of(x.upper().replace("_", "-") for x in labels), (F.least(n % 4, F.lit(2)) + 1).cast("int")))
        given = F.when(n % 7 == 0, F.lit(f" {next(iter(labels))} ")).when(n % 7 == 1, "odd").otherwise("")
        source = docs.select(F.col("doc_id").alias("ID"), comment.alias("Review-Comment"), F.lit("").alias("input_text"), context.alias("rebuttalText"), stance.alias("Stance"), given.alias("Prediction"))
        rows = adapters.generic(source, dimension, dimension, labels)
        out = rows if out is None else out.unionByName(rows)
    return out


@query(S.sql("SELECT task_id, gold_label, predicted_label, mapped_score, context_text, md5(input_text) AS digest FROM (SELECT * REPLACE (trim(input_text) AS input_text) FROM generic)", "generic"))
def adapt_generic(spark: SparkSession, d: str) -> DataFrame:
    return _generic(spark, d).select("task_id", "gold_label", "predicted_label", "mapped_score", "context_text", F.md5(F.col("input_text").cast("binary")).alias("digest"))


_PAIR = "SELECT a.doc_id AS pair_id, a.text AS premise, b.text AS hypothesis, CASE a.n_chars % 3 WHEN 0 THEN 'C' WHEN 1 THEN '1' ELSE 'n' END AS label, a.n_chars % 2 AS s1, b.n_chars % 2 AS s2 FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1"
S.add_cte("pair_rows", f"SELECT *, {S.d_plain_tokens('premise')} AS pt, {S.d_plain_tokens('hypothesis')} AS ht FROM ({_PAIR})")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = S.table(spark, d, "documents")
    n = F.col("n_chars")
    a = docs.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("premise"), F.when(n % 3 == 0, "C").when(n % 3 == 1, "1").otherwise("n").alias("label"), (n % 2).alias("s1"))
    b = docs.select((F.col("doc_id") - 1).alias("pair_id"), F.col("text").alias("hypothesis"), (n % 2).alias("s2"))
    return adapters.pairs(a.join(b, "pair_id"))


@query(S.sql("SELECT pair_id, CASE WHEN lower(label) IN ('c', 'contradiction', '1') THEN 'contradiction' ELSE 'no_contradiction' END AS gold_label, overlap, CASE WHEN s1 <> s2 THEN 'contradiction' ELSE 'no_contradiction' END AS polarity, 'no_contradiction' AS majority, CASE WHEN overlap >= 0.1 THEN 'contradiction' ELSE 'no_contradiction' END AS by_overlap FROM (SELECT *, CASE WHEN len(list_distinct(list_concat(pt, ht))) > 0 THEN round(len(list_intersect(pt, ht))::DOUBLE / len(list_distinct(list_concat(pt, ht))), 4) ELSE 0 END AS overlap FROM pair_rows)", "pair_rows"))
def adapt_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


@F.pandas_udf(ArrayType(IntegerType()))
def _running(sizes: pd.Series) -> pd.Series:
    """Running sums of each array, in time that grows with its length (a fold over arrays copies what it has)."""
    return sizes.map(np.cumsum)


S.add_cte(
    "sentence_spans",
    f"""SELECT doc_id, text, i, CASE WHEN i % 3 = 2 THEN 'Jus_' || CAST(i // 3 AS VARCHAR) ELSE 'Eval_' || CAST(i // 3 AS VARCHAR) END AS tag, ends[i + 1] - length(parts[i + 1]) AS start, ends[i + 1] AS stop
FROM (SELECT doc_id, text, parts, list_transform(range(1, len(parts) + 1), lambda k: CAST(list_sum(list_transform(parts[1:k], lambda p: length(p))) AS BIGINT)) AS ends
  FROM (SELECT doc_id, text, regexp_extract_all(text, '[^.!?]*[.!?]+|[^.!?]+') AS parts FROM documents)), unnest(range(0, len(parts))) AS t(i)""",
)


@query(
    S.sql(
        "SELECT e.doc_id AS id, e.tag, md5(e.body) AS text, md5(coalesce(j.body, '')) AS evidence, CASE WHEN j.body IS NULL THEN 'unsubstantiated' ELSE 'substantiated' END AS gold_label FROM (SELECT *, trim(substring(text, CAST(start AS BIGINT) + 1, CAST(stop - start AS BIGINT))) AS body, regexp_replace(tag, '^[A-Za-z]+_', '') AS key FROM sentence_spans) e LEFT JOIN (SELECT doc_id, regexp_replace(tag, '^[A-Za-z]+_', '') AS key, string_agg(trim(substring(text, CAST(start AS BIGINT) + 1, CAST(stop - start AS BIGINT))), ' ' ORDER BY i) AS body FROM sentence_spans WHERE starts_with(tag, 'Jus_') AND trim(substring(text, CAST(start AS BIGINT) + 1, CAST(stop - start AS BIGINT))) <> '' GROUP BY ALL) j ON j.doc_id = e.doc_id AND j.key = e.key WHERE starts_with(e.tag, 'Eval_') AND e.body <> ''",
        "sentence_spans",
    )
)
def adapt_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans from the sentence offsets of whole documents: two evaluations and their justification in turn."""
    docs = S.table(spark, d, "documents").where("text is not null")
    parts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("review"), F.regexp_extract_all("text", F.lit("[^.!?]*[.!?]+|[^.!?]+"), F.lit(0)).alias("parts"))
    parts = parts.withColumn("stops", _running(F.transform("parts", F.length)))

    def span(p: Column, i: Column) -> Column:
        tag = F.concat(F.when(i % 3 == 2, "Jus_").otherwise("Eval_"), F.floor(i / 3).cast("string"))
        return F.struct((F.get("stops", i) - F.length(p)).alias("start"), F.get("stops", i).alias("stop"), tag.alias("tag"))

    found = adapters.spans(parts.select("id", "review", F.transform("parts", span).alias("label")))
    digest = lambda c: F.md5(F.col(c).cast("binary")).alias(c)
    return found.select("id", "tag", digest("text"), digest("evidence"), "gold_label")


_ACTIONS = ("rebuttal_done", "rebuttal_future", "rebuttal_answer", "Rebuttal_Resolved", "", "rebuttal_reject", "rebuttal_partial")
_STANCES = ("concur", "dispute", "Answer ", "mitigate", "nonarg")


@query(
    f"""WITH reply AS (
  SELECT l_orderkey AS doc, unnest([l_linenumber, l_linenumber + 1]) AS sentence, l_partkey AS pos, {S._list(_ACTIONS)}[l_suppkey % 7 + 1] AS act, {S._list(_STANCES)}[l_partkey % 5 + 1] AS stance,
         'about ' || l_partkey % 3 AS said FROM lineitem WHERE l_returnflag = 'N'),
grouped AS (
  SELECT doc, sentence, count(*) AS n, bool_or(lower(act) IN ('rebuttal_done', 'rebuttal_resolution', 'rebuttal_resolved')) AS a, bool_or(trim(lower(stance)) IN ('concur', 'answer')) AS b,
         bool_or(lower(act) IN ('rebuttal_future', 'rebuttal_partial', 'rebuttal_followup')) AS c FROM reply GROUP BY ALL),
texts AS (SELECT doc, sentence, string_agg(said, chr(10) ORDER BY pos) AS context_text FROM (SELECT doc, sentence, said, min(pos) AS pos FROM reply GROUP BY ALL) GROUP BY ALL)
SELECT r.doc, r.sentence, coalesce(n, 0) AS n, coalesce(context_text, '') AS context_text,
       CASE WHEN n IS NULL THEN 'not_addressed' WHEN a THEN 'resolved_or_weakened' WHEN b THEN 'specifically_addressed' WHEN c THEN 'partially_addresses' ELSE 'generic_or_unclear' END AS gold_label
FROM (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS sentence FROM lineitem WHERE l_linestatus = 'O') r LEFT JOIN grouped USING (doc, sentence) LEFT JOIN texts USING (doc, sentence)"""
)
def adapt_alignments(spark: SparkSession, d: str) -> DataFrame:
    lines = S.table(spark, d, "lineitem")
    review = lines.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("int").alias("sentence")).distinct()
    at, part = F.col("l_linenumber").cast("int"), F.col("l_partkey")
    rebuttal = lines.where("l_returnflag = 'N'").select(
        F.col("l_orderkey").alias("doc"),
        part.alias("pos"),
        F.array(at, at + 1).alias("targets"),
        F.element_at(T.words_of(_ACTIONS), (F.col("l_suppkey") % 7 + 1).cast("int")).alias("action"),
        F.element_at(T.words_of(_STANCES), (part % 5 + 1).cast("int")).alias("stance"),
        F.concat(F.lit("about "), part % 3).alias("text"),
    )
    return adapters.alignments(review, rebuttal)


@query("SELECT g AS \"group\", pair, coalesce(string_agg(text, ' ' ORDER BY event_id) FILTER (side = 'review'), '') AS review, coalesce(string_agg(text, ' ' ORDER BY event_id) FILTER (side = 'reply'), '') AS reply, coalesce(string_agg(text, ' ' ORDER BY event_id) FILTER (side = 'reply'), '') <> '' AS is_pair FROM (SELECT event_id, 'g' || user_id % 40 AS g, event_id % 9 AS pair0, CAST(event_id % 9 AS VARCHAR) AS pair, CASE WHEN event_id % 2 = 0 THEN 'review' ELSE 'reply' END AS side, event_type || event_id AS text FROM events) WHERE pair <> '0' GROUP BY g, pair HAVING coalesce(string_agg(text, ' ' ORDER BY event_id) FILTER (side = 'review'), '') <> ''")
def adapt_argument_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Tagged lines written as text and read back before they are parsed."""
    i = F.col("event_id")
    tag = F.when(i % 9 == 0, "O").otherwise(F.concat(F.lit("B-"), i % 9))
    line = F.concat_ws("\t", F.concat("event_type", i), F.lit("B-Review"), tag, F.when(i % 2 == 0, "Review").otherwise("Reply"), F.concat(F.lit("g"), F.col("user_id") % 40))
    return adapters.argument_pairs(S.table(spark, d, "events").select(i.alias("line_no"), line.alias("line")))


@query(S.sql("SELECT dataset, dimension, count(*) AS n, count(DISTINCT gold_label) AS labels FROM (SELECT dataset, dimension, gold_label FROM generic UNION ALL SELECT 'PAIRS', 'contradiction', CASE WHEN label = 'n' THEN 'no_contradiction' ELSE 'contradiction' END FROM pair_rows) GROUP BY ALL", "generic", "pair_rows"))
def corpus_union(spark: SparkSession, d: str) -> DataFrame:
    """All adapters as one corpus, and its counts by dataset."""
    names = ("dataset", "dimension", "gold_label")
    pairs = _pairs(spark, d).select(F.lit("PAIRS").alias("dataset"), F.lit("contradiction").alias("dimension"), "gold_label")
    return _generic(spark, d).select(*names).unionByName(pairs).groupBy("dataset", "dimension").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("gold_label").alias("labels"))
