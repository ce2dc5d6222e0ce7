"""Queries over texts: cleaning, splitting, tokens, numbers, rule scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumlab.functions import lexicons as L
from quorumlab.functions import text as T
from quorumlab.operators import scoring
from quorumlab.plans import standins as S
from quorumlab.plans.registry import query


#: Entities of all kinds, and what they stand for.
_ENTITIES = " caf&eacute; &#233;&#x1F600;&#128; &notit; &copy 2 &amp;lt; &CounterClockwiseContourIntegral; &nosuch; &#xD800;&"
_RESOLVED = " caf\u00e9 \u00e9\U0001f600\u20ac \u00acit; \u00a9 2 &amp;lt; \u2233 &nosuch; \ufffd&"


@query("SELECT page_id, " + S.d_clean(f"html || '{_RESOLVED}'") + " AS cleaned FROM pages")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "pages").select("page_id", T.clean_text(F.concat("html", F.lit(_ENTITIES))).alias("cleaned"))


@query("SELECT page_id, array_to_string(list_filter([url, NULL, html], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS content FROM pages")
def content_text(spark: SparkSession, d: str) -> DataFrame:
    """Joined text of an ordered key list of an open content map."""
    pages = S.table(spark, d, "pages")
    content = F.create_map(F.lit("title"), F.col("url"), F.lit("tldr"), F.lit(None).cast("string"), F.lit("abstract"), F.col("html"))
    keys = T.words_of(("title", "tldr", "abstract", "keywords"))
    values = F.filter(F.transform(keys, lambda k: F.try_element_at(content, k)), lambda v: v.isNotNull())
    return pages.select("page_id", F.array_join(values, "\n\n").alias("content"))


def _digest(array: str) -> list:
    return [F.size(array).cast("bigint").alias("n"), F.md5(F.array_join(array, "|").cast("binary")).alias("digest")]


def _d_digest(array: str) -> str:
    return f"CAST(len({array}) AS BIGINT) AS n, md5(array_to_string({array}, '|')) AS digest"


@query(f"SELECT doc_id, {_d_digest('x')} FROM (SELECT doc_id, {S.d_sentences('text')} AS x FROM documents)")
def split_sentences(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id", T.split_sentences("text").alias("x")).select("doc_id", *_digest("x"))


@query(f"SELECT doc_id, {_d_digest('x')} FROM (SELECT doc_id, {S.d_segments('text')} AS x FROM documents)")
def split_segments(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id", T.split_segments("text").alias("x")).select("doc_id", *_digest("x"))


@query(f"SELECT doc_id, {_d_digest('x')} FROM (SELECT doc_id, {S.d_token_list('text')} AS x FROM documents)")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id", T.token_list("text").alias("x")).select("doc_id", *_digest("x"))


@query(f"SELECT doc_id, {_d_digest('x')} FROM (SELECT doc_id, {S.d_concern_tokens('text')} AS x FROM documents)")
def concern_tokens(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id", T.concern_tokens("text").alias("x")).select("doc_id", *_digest("x"))


_RAW = "concat(CASE n_chars % 4 WHEN 0 THEN 'Rating: ' WHEN 1 THEN 'score ' ELSE '' END, CASE WHEN n_chars % 9 = 0 THEN 'none' ELSE concat(n_chars % 13, CASE n_chars % 3 WHEN 0 THEN '.5' ELSE '' END) END, CASE n_chars % 5 WHEN 0 THEN '/5' WHEN 1 THEN ' out of 5' ELSE '' END)"
_NUM = "TRY_CAST(nullif(regexp_extract(raw, '[-+]?\\d+(?:\\.\\d+)?', 0), '') AS DOUBLE)"


@query(f"SELECT doc_id, raw, CASE WHEN x <= 5 AND (contains(lower(raw), '/5') OR contains(lower(raw), 'out of 5')) THEN round(x / 5 * 10, 2) WHEN x <= 10 THEN round(x, 2) END AS rating FROM (SELECT *, {_NUM} AS x FROM (SELECT doc_id, {_RAW} AS raw FROM documents))")
def normalize_rating(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id", F.expr(_RAW).alias("raw")).withColumn("rating", T.normalize_rating("raw"))


@query(f"SELECT doc_id, raw, CASE WHEN x <= 5 THEN round(x / 5 * 10, 2) WHEN x <= 10 THEN round(x, 2) END AS confidence FROM (SELECT *, {_NUM} AS x FROM (SELECT doc_id, {_RAW} AS raw FROM documents))")
def normalize_confidence(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id", F.expr(_RAW).alias("raw")).withColumn("confidence", T.normalize_confidence("raw"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS seconds FROM events")
def parse_times(spark: SparkSession, d: str) -> DataFrame:
    """The same instants written as seconds, milliseconds and ISO text; broken text is null."""
    events = S.table(spark, d, "events")
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint")
    kind = F.col("event_id") % 4
    raw = F.when(kind == 0, seconds.cast("string")).when(kind == 1, (seconds * 1000).cast("string")).when(kind == 2, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("no date")
    return events.select("event_id", F.unix_seconds(T.parse_time(raw)).alias("seconds"))


_DECISION = "CASE n_chars % 6 WHEN 0 THEN 'Accept (Spotlight)' WHEN 1 THEN 'Reject' WHEN 2 THEN '' WHEN 3 THEN 'Withdrawn' WHEN 4 THEN 'Oral' ELSE NULL END"


@query(f"SELECT doc_id, CASE WHEN trim(coalesce(x, '')) = '' THEN 'unknown' WHEN contains(lower(x), 'reject') THEN 'reject' WHEN contains(lower(x), 'accept') OR contains(lower(x), 'spotlight') OR contains(lower(x), 'oral') THEN 'accept' ELSE 'other' END AS decision FROM (SELECT doc_id, {_DECISION} AS x FROM documents)")
def decision_class(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id", T.decision_class(F.expr(_DECISION)).alias("decision"))


@query(f"SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE CASE WHEN contains(h, ' ') THEN rtrim(regexp_replace(h, ' [^ ]*\\z', '')) ELSE h END || '...' END AS cut FROM (SELECT doc_id, t, rtrim(left(t, 79)) AS h FROM (SELECT doc_id, {S.d_clean_ws('text')} AS t FROM documents))")
def truncate_words(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id", T.truncate_words("text", 80).alias("cut"))


@query(
    rf"""SELECT doc_id, CASE WHEN length(t) <= 700 THEN t ELSE CASE WHEN p > 0 THEN '...' ELSE '' END || {S.d_strip("substring(t, p + 1, 700)")} || CASE WHEN p + 700 < length(t) THEN '...' ELSE '' END END AS snippet
FROM (SELECT doc_id, t, greatest(0, coalesce(list_min(list_filter(list_transform(['mentation', 'there', 'ion'], lambda w: CASE WHEN length(w) >= 4 THEN instr(lower(t), w) - 1 ELSE -1 END), lambda x: x >= 0)), 0) - 233) AS p
FROM (SELECT doc_id, {S.d_clean("text")} AS t FROM documents))"""
)
def snippet(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id", T.snippet("text", T.words_of(("mentation", "there", "ion"))).alias("snippet"))


@query("SELECT doc_id, 'claim_' || left(sha1(concat_ws('||', lang, source, CAST(doc_id AS VARCHAR))), 10) AS stable_id, left(regexp_replace(concat_ws(':', lang, source, CAST(doc_id AS VARCHAR)), '[^A-Za-z0-9_-]+', '_', 'g'), 64) AS custom_id FROM documents")
def stable_keys(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    custom = F.left(F.regexp_replace(F.concat_ws(":", "lang", "source", key), "[^A-Za-z0-9_-]+", "_"), F.lit(64))
    return S.table(spark, d, "documents").select("doc_id", T.stable_id("claim", F.col("lang"), F.col("source"), key).alias("stable_id"), custom.alias("custom_id"))


_H = {
    "specificity": f"CAST(round(least(1.0::DOUBLE, CASE WHEN a THEN 0.75::DOUBLE ELSE 0.6::DOUBLE END + CASE WHEN n >= 35 THEN 0.08::DOUBLE ELSE 0 END - CASE WHEN n < 12 THEN 0.18::DOUBLE ELSE 0 END), 4) AS DOUBLE)",
    "substantiation": "CASE WHEN a THEN 0.76::DOUBLE ELSE 0.55::DOUBLE END",
    "actionability": f"CASE WHEN regexp_matches(lower(claim_text), '{scoring.ACTION_WORDS}') THEN 0.82::DOUBLE ELSE 0.52::DOUBLE END",
    "consensus_conflict": "0.58::DOUBLE",
    "rebuttal_robustness": f"CASE WHEN regexp_matches(lower(claim_text), '{scoring.RISK_WORDS}') THEN 0.74::DOUBLE ELSE 0.5::DOUBLE END",
    "professionalism": f"CASE WHEN regexp_matches(lower(claim_text), '{scoring.RUDE_WORDS}') THEN 0.25::DOUBLE ELSE 0.82::DOUBLE END",
}


@query(S.sql(f"SELECT task_id, {', '.join(f'{v} AS {k}' for k, v in _H.items())} FROM (SELECT *, regexp_matches(lower(claim_text), '{scoring.ANCHOR_WORDS}') AS a, len(regexp_extract_all(claim_text, '[A-Za-z0-9_]+')) AS n FROM claims)", "claims"))
def heuristic_scores(spark: SparkSession, d: str) -> DataFrame:
    return S.claims(spark, d).select("task_id", *(v.alias(k) for k, v in scoring.heuristic(F.col("claim_text")).items()))


def _any(words) -> str:
    return f"(len(list_filter({S._list(words)}, lambda w: contains(low, w))) > 0)"


def _count(words) -> str:
    return f"len(list_filter({S._list(words)}, lambda w: contains(low, w)))"


S.add_cte(
    "ruled",
    f"""SELECT *, CASE WHEN hits >= 2 OR (hits >= 1 AND regexp_matches(claim_text, '[0-9]')) THEN 4 WHEN hits = 1 THEN 3 WHEN n >= 12 THEN 2 ELSE 1 END AS specificity,
  CASE WHEN claim_type = 'tone' THEN 4 WHEN claim_type IN ('novelty', 'theory') THEN 2 WHEN hits > 0 THEN 4 WHEN n >= 10 THEN 3 WHEN n >= 5 THEN 2 ELSE 1 END AS auditability,
  CASE WHEN {_any(L.ACTION_WORDS)} THEN CASE WHEN {_any(("because", "so that", "impact"))} THEN 4 ELSE 3 END WHEN {_any(("why", "how", "what"))} THEN 2 ELSE 1 END AS actionability,
  CASE WHEN rude >= 2 THEN 1 WHEN rude = 1 THEN 2 WHEN {_any(("clearly wrong", "obviously"))} THEN 3 ELSE 4 END AS tone
FROM (SELECT *, {_count(L.SPECIFICITY_WORDS)} AS hits, {_count(scoring.TONE_WORDS)} AS rude FROM (SELECT *, lower(claim_text) AS low, len({S.d_plain_tokens("claim_text")}) AS n,
  ['supported', 'partially_supported', 'insufficient', 'possibly_contradicted', 'vague_or_not_checkable', 'needs_human_check'][length(claim_text) % 6 + 1] AS verdict FROM claims))""",
    "claims",
)
VERDICTS = ("supported", "partially_supported", "insufficient", "possibly_contradicted", "vague_or_not_checkable", "needs_human_check")


def _ruled(spark: SparkSession, d: str) -> DataFrame:
    rows = S.claims(spark, d)
    rows = rows.withColumns(scoring.rule_scores(F.col("claim_text"), F.col("claim_type")))
    return rows.withColumn("verdict", F.element_at(T.words_of(VERDICTS), F.length("claim_text") % 6 + 1))


@query(S.sql("SELECT task_id, specificity, auditability, actionability, tone FROM ruled", "ruled"))
def claim_rule_scores(spark: SparkSession, d: str) -> DataFrame:
    return _ruled(spark, d).select("task_id", "specificity", "auditability", "actionability", "tone")


_FLAGS = """list_filter([CASE WHEN verdict = 'possibly_contradicted' THEN 'possibly-contradicted-by-paper' END, CASE WHEN verdict = 'insufficient' AND importance IN ('major', 'medium') THEN 'unsupported-major-claim' END,
  CASE WHEN verdict = 'vague_or_not_checkable' THEN 'vague-or-not-checkable' END, CASE WHEN specificity <= 1 THEN 'vague-criticism' END, CASE WHEN tone <= 2 THEN 'unprofessional-tone' END,
  CASE WHEN actionability <= 1 AND importance NOT IN ('tone-only', 'question') THEN 'missing-actionable-suggestions' END, CASE WHEN claim_type IN ('novelty', 'theory') THEN 'requires-human-expert-check' END], lambda x: x IS NOT NULL)"""


@query(S.sql(f"SELECT task_id, array_to_string({_FLAGS}, '|') AS flags FROM ruled", "ruled"))
def issue_flags(spark: SparkSession, d: str) -> DataFrame:
    return _ruled(spark, d).select("task_id", F.array_join(scoring.issue_flags(), "|").alias("flags"))


S.add_cte(
    "defaulted",
    """SELECT *, CASE WHEN support_score >= 82 THEN 'strongly_agree' WHEN support_score >= 62 THEN 'agree' WHEN support_score >= 40 THEN 'mixed' WHEN support_score >= 20 THEN 'disagree' ELSE 'strongly_disagree' END AS stance,
  CASE verdict WHEN 'supported' THEN 80 WHEN 'partially_supported' THEN 60 WHEN 'possibly_contradicted' THEN 35 WHEN 'vague_or_not_checkable' THEN 45 ELSE 50 END AS fairness,
  CASE verdict WHEN 'possibly_contradicted' THEN 1 WHEN 'needs_human_check' THEN 2 WHEN 'supported' THEN 4 ELSE 3 END AS severity,
  CASE WHEN point_type <> 'question' THEN 0 ELSE CASE verdict WHEN 'possibly_contradicted' THEN 80 WHEN 'supported' THEN 70 WHEN 'partially_supported' THEN 50 WHEN 'insufficient' THEN 20 ELSE support_score END END AS answer_coverage,
  CASE WHEN point_type <> 'question' THEN 0 ELSE CAST(round_even((specificity + actionability) / 8.0 * 100, 0) AS INTEGER) END AS question_value
FROM (SELECT *, CASE verdict WHEN 'supported' THEN 92 WHEN 'partially_supported' THEN 62 WHEN 'insufficient' THEN 32 WHEN 'possibly_contradicted' THEN 18 WHEN 'vague_or_not_checkable' THEN 40 ELSE 50 END AS support_score,
  CASE WHEN importance = 'question' OR source_field = 'questions' OR suffix(low, '?') THEN 'question' WHEN contains(low, 'i rate') OR contains(low, 'my score') OR contains(low, 'i give') OR contains(low, 'rating') OR contains(low, 'score is') THEN 'score_justification'
    WHEN contains(low, 'should') OR contains(low, 'could') OR contains(low, 'recommend') OR contains(low, 'suggest') THEN 'suggestion' WHEN source_field = 'summary' THEN 'summary' ELSE 'comment' END AS point_type FROM ruled)""",
    "ruled",
)
_DEFAULTS = ("task_id", "support_score", "point_type", "stance", "fairness", "severity", "answer_coverage", "question_value")


@query(S.sql(f"SELECT {', '.join(_DEFAULTS)} FROM defaulted", "defaulted"))
def claim_defaults(spark: SparkSession, d: str) -> DataFrame:
    return scoring.defaults(_ruled(spark, d)).select(*_DEFAULTS)


S.add_cte(
    "judged",
    f"""SELECT *, [claim_text, source_sentence || ' seen'][1:claim_index % 3] AS evidence, CASE claim_index % 4 WHEN 0 THEN '' WHEN 1 THEN claim_text ELSE claim_text || ' unseen words' END AS quote,
  CASE WHEN length(claim_text) % 2 = 0 THEN 'high' ELSE 'medium' END AS confidence, ['strongly_agree', 'agree', 'mixed', 'disagree', 'strongly_disagree', 'odd'][length(claim_text) % 5 + 1 + claim_index % 2] AS given,
  length(claim_text) % 101 AS given_support, CASE verdict WHEN 'supported' THEN 3 WHEN 'partially_supported' THEN 2 WHEN 'insufficient' THEN 1 WHEN 'vague_or_not_checkable' THEN 1 WHEN 'possibly_contradicted' THEN 0 END AS backing, {_FLAGS} AS flags FROM ruled""",
    "ruled",
)
_TOKJ = "array_to_string({}, ' ')"


@query(
    S.sql(
        f"""SELECT task_id, CASE WHEN lowered THEN CASE WHEN verdict IN ('insufficient', 'needs_human_check') OR len(evidence) = 0 THEN 'low' ELSE 'medium' END ELSE confidence END AS gated_confidence,
  CASE WHEN clash THEN CASE verdict WHEN 'supported' THEN 'agree' WHEN 'possibly_contradicted' THEN 'strongly_disagree' ELSE 'mixed' END ELSE given END AS gated_stance,
  CASE WHEN cut THEN CASE WHEN verdict = 'vague_or_not_checkable' THEN 40 ELSE 30 END ELSE given_support END AS gated_support,
  array_to_string(list_concat(flags, list_filter([CASE WHEN bad_quote THEN 'unverified-quoted-evidence' END, CASE WHEN lowered THEN 'confidence-downgraded-evidence-limited' END, CASE WHEN clash OR cut THEN 'stance-corrected-by-reliability-gate' END], lambda x: x IS NOT NULL)), '|') AS gated_flags
FROM (SELECT *, limited AND given_support > 60 AS cut, quote <> '' AND NOT coalesce(qt <> '' AND len(list_filter(evidence, lambda e: contains({_TOKJ.format(S.d_plain_tokens("e"))}, qt))) > 0, false) AS bad_quote,
  confidence = 'high' AND (limited OR backing IS NULL OR backing <= 1 OR len(evidence) = 0) AS lowered,
  (verdict = 'supported' AND given IN ('disagree', 'strongly_disagree')) OR (verdict = 'partially_supported' AND given IN ('strongly_agree', 'strongly_disagree')) OR (verdict = 'possibly_contradicted' AND given IN ('agree', 'strongly_agree')) OR (limited AND given = 'strongly_agree') OR given = 'odd' AS clash
FROM (SELECT *, verdict IN ('insufficient', 'vague_or_not_checkable', 'needs_human_check') AS limited, {_TOKJ.format(S.d_plain_tokens("quote"))} AS qt FROM judged))""",
        "judged",
    )
)
def reliability_gate(spark: SparkSession, d: str) -> DataFrame:
    n, at, text = F.length("claim_text"), F.col("claim_index"), F.col("claim_text")
    stances = T.words_of((*L.STANCES, "odd"))
    rows = _ruled(spark, d).withColumns(
        {
            "evidence": F.slice(F.array(text, F.concat("source_sentence", F.lit(" seen"))), F.lit(1), at % 3),
            "quote": F.when(at % 4 == 0, "").when(at % 4 == 1, text).otherwise(F.concat(text, F.lit(" unseen words"))),
            "confidence": F.when(n % 2 == 0, "high").otherwise("medium"),
            "stance": F.element_at(stances, n % 5 + 1 + at % 2),
            "support_score": (n % 101).cast("bigint"),
            "evidence_support": scoring.evidence_support(F.col("verdict")),
            "flags": scoring.issue_flags(),
        }
    )
    return scoring.gated(rows).select("task_id", "gated_confidence", "gated_stance", "gated_support", F.array_join("gated_flags", "|").alias("gated_flags"))


_SCORES = """SELECT doc_id AS row_id, CASE n_chars % 7 WHEN 0 THEN 'n/a' ELSE CAST((n_chars % 130) / CASE n_chars % 3 WHEN 0 THEN 13.0 ELSE 1.0 END AS VARCHAR) END AS outrage,
  CAST(n_chars % CASE n_chars % 3 WHEN 0 THEN 9 ELSE 90 END AS VARCHAR) AS toxicity, CAST(n_chars % CASE n_chars % 3 WHEN 0 THEN 10 ELSE 120 END AS VARCHAR) AS helpfulness,
  CASE n_chars % 5 WHEN 0 THEN '' WHEN 1 THEN 'two words' ELSE text END AS quote, CASE n_chars % 4 WHEN 0 THEN 'Mostly summary, too short' ELSE 'clear and useful' END AS verdict, n_chars % 2 = 0 AS actionable FROM documents"""


@query(
    rf"""WITH a AS ({_SCORES}), b AS (SELECT *, coalesce(least(100, greatest(0, CAST(round_even(TRY_CAST(outrage AS DOUBLE), 0) AS INTEGER))), 0) AS o, coalesce(least(100, greatest(0, CAST(round_even(TRY_CAST(toxicity AS DOUBLE), 0) AS INTEGER))), 0) AS t,
  coalesce(least(100, greatest(0, CAST(round_even(TRY_CAST(helpfulness AS DOUBLE), 0) AS INTEGER))), 0) AS h FROM a), e AS (SELECT *, greatest(o, t, h) BETWEEN 1 AND 10 AS tenths, {S.d_clean_ws("quote")} AS q FROM b),
f AS (SELECT row_id, CASE WHEN tenths THEN o * 10 ELSE o END AS outrage, CASE WHEN tenths THEN t * 10 ELSE t END AS toxicity,
  least(CASE WHEN tenths THEN h * 10 ELSE h END, CASE WHEN actionable THEN 100 ELSE 45 END, CASE WHEN contains(lower(verdict), 'mostly summary') THEN 35 ELSE 100 END, CASE WHEN q <> '' AND len(string_split(q, ' ')) <= 3 THEN 45 ELSE 100 END) AS helpfulness FROM e)
SELECT row_id, outrage, toxicity, helpfulness, CAST(round_even(round(0.75::DOUBLE * helpfulness + 0.15::DOUBLE * (100 - outrage) + 0.10::DOUBLE * (100 - toxicity), 6), 0) AS INTEGER) AS quality_score FROM f"""
)
def normalize_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = S.table(spark, d, "documents")
    n = F.col("n_chars")
    rows = docs.select(
        F.col("doc_id").alias("row_id"),
        F.when(n % 7 == 0, "n/a").otherwise(((n % 130) / F.when(n % 3 == 0, 13.0).otherwise(1.0)).cast("string")).alias("outrage"),
        (n % F.when(n % 3 == 0, 9).otherwise(90)).cast("string").alias("toxicity"),
        (n % F.when(n % 3 == 0, 10).otherwise(120)).cast("string").alias("helpfulness"),
        F.when(n % 5 == 0, "").when(n % 5 == 1, "two words").otherwise(F.col("text")).alias("quote"),
        F.when(n % 4 == 0, "Mostly summary, too short").otherwise("clear and useful").alias("verdict"),
        (n % 2 == 0).alias("actionable"),
    )
    return scoring.normalized_scores(rows).select("row_id", "outrage", "toxicity", "helpfulness", "quality_score")


OUTRAGE_TYPES = ("dismissive", "hostile", "contradictory", "unsupported")


@query(
    rf"""SELECT row_id, score, kind, CASE WHEN raw2 IN ({S._in(OUTRAGE_TYPES)}) AND raw2 <> kind THEN raw2 ELSE 'none' END AS second, score >= 70 AND kind <> 'none' AS outrageous,
  CASE WHEN length(t) <= 240 THEN t ELSE CASE WHEN contains(h, ' ') THEN rtrim(regexp_replace(h, ' [^ ]*\z', '')) ELSE h END || '...' END AS excerpt
FROM (SELECT doc_id AS row_id, CAST(least(100, n_chars % 120) AS INTEGER) AS score, CASE WHEN x IN ({S._in(OUTRAGE_TYPES)}) THEN x ELSE 'none' END AS kind, raw2, t, rtrim(left(t, 239)) AS h
FROM (SELECT *, ['dismissive', 'hostile', 'fine', 'unsupported'][n_chars % 4 + 1] AS x, ['hostile', 'unsupported', 'dismissive'][n_chars % 3 + 1] AS raw2, {S.d_clean_ws("text")} AS t FROM documents))"""
)
def normalize_outrage_result(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    rows = S.table(spark, d, "documents").select(
        F.col("doc_id").alias("row_id"), (n % 120).cast("string").alias("score"), F.element_at(T.words_of(("dismissive", "hostile", "fine", "unsupported")), (n % 4 + 1).cast("int")).alias("kind"),
        F.element_at(T.words_of(("hostile", "unsupported", "dismissive")), (n % 3 + 1).cast("int")).alias("second"), "text",
    )
    return scoring.outrage_result(rows, OUTRAGE_TYPES)


@query(S.sql("SELECT row_id, outrage, toxicity, helpfulness, CAST(round_even(round(0.75::DOUBLE * outrage + 0.15::DOUBLE * (100 - helpfulness) + 0.10::DOUBLE * toxicity, 6), 0) AS INTEGER) AS attention FROM v_score", "v_score"))
def reviewer_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of reviewers from an array of dimension structs, and their attention."""
    rows = S.view(spark, d, "v_score").select("row_id", F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("bigint").alias("score")) for k in ("outrage", "toxicity", "helpfulness"))).alias("dims"))
    by_key = F.map_from_entries("dims")
    rows = rows.select("row_id", *(F.try_element_at(by_key, F.lit(k)).alias(k) for k in ("outrage", "toxicity", "helpfulness")))
    return rows.withColumn("attention", scoring.attention(F.col("outrage"), F.col("helpfulness"), F.col("toxicity")))


_TYPE_SQL = "CASE WHEN n_chars % 3 = 0 THEN ' Accept ' WHEN n_chars % 3 = 1 THEN 'FULLY' ELSE 'Contradiction' END"


@query("SELECT doc_id, dataset, raw, label, score FROM (SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'stance' ELSE 'support' END AS dataset, CASE WHEN n_chars % 3 = 0 THEN ' Accept ' WHEN n_chars % 3 = 1 THEN 'FULLY' ELSE 'Contradiction' END AS raw FROM documents) LEFT JOIN (VALUES ('stance', 'accept', 'resolved', 0.1::DOUBLE), ('stance', 'contradiction', 'contested', 0.8::DOUBLE), ('support', 'fully', 'substantiated', 0.9::DOUBLE), ('support', 'contradiction', 'contradicted', 0.05::DOUBLE)) AS m(ds, key, label, score) ON dataset = ds AND lower(trim(raw)) = key")
def map_labels(spark: SparkSession, d: str) -> DataFrame:
    """Source labels to canonical labels and scores, by a label table per dataset."""
    entries = (("stance", "accept", "resolved", 0.1), ("stance", "contradiction", "contested", 0.8), ("support", "fully", "substantiated", 0.9), ("support", "contradiction", "contradicted", 0.05))
    rows = S.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "stance").otherwise("support").alias("dataset"), F.expr(_TYPE_SQL).alias("raw"))
    names = spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("ds", "key", "label", "score"), e, strict=True))) for e in entries))))
    # the label table is a fixed list of a few rows
    return rows.join(F.broadcast(names), (F.col("dataset") == F.col("ds")) & (F.lower(F.trim("raw")) == F.col("key")), "left").select("doc_id", "dataset", "raw", "label", "score")


S.add_cte(
    "reviewed",
    f"""SELECT review_id, left(review_text, 120) AS summary, CASE WHEN n_chars % 3 = 0 THEN lower(left(review_text, 120)) ELSE '' END AS strengths, right(review_text, 200) AS weaknesses,
  CASE WHEN n_chars % 5 = 0 THEN 'We thank the reviewers, see the rebuttal.' ELSE NULL END AS questions, CASE WHEN n_chars % 13 = 0 THEN '' ELSE review_text END AS body FROM v_review""",
    "v_review",
)


def _reviewed(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    return S.view(spark, d, "v_review").select(
        "review_id",
        F.left("review_text", F.lit(120)).alias("summary"),
        F.when(n % 3 == 0, F.lower(F.left("review_text", F.lit(120)))).otherwise("").alias("strengths"),
        F.right("review_text", F.lit(200)).alias("weaknesses"),
        F.when(n % 5 == 0, "We thank the reviewers, see the rebuttal.").alias("questions"),
        F.when(n % 13 == 0, "").otherwise(F.col("review_text")).alias("review_text"),
    )


def core_text() -> Column:
    """Labelled concatenation of five fields, repeated fields dropped, cut to 6000 characters."""
    fields = (("Summary", "summary"), ("Strengths", "strengths"), ("Weaknesses", "weaknesses"), ("Questions", "questions"), ("Review", "review_text"))
    parts = F.filter(F.array(*(F.struct(F.lit(k).alias("label"), T.clean_ws(v).alias("text")) for k, v in fields)), lambda p: p["text"] != "")
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("kept"))
    folded = F.aggregate(
        parts,
        start,
        lambda s, p: F.when(F.array_contains(s["seen"], F.lower(p["text"])), s).otherwise(F.struct(F.array_append(s["seen"], F.lower(p["text"])).alias("seen"), F.array_append(s["kept"], F.concat(p["label"], F.lit(": "), p["text"])).alias("kept"))),
    )
    return T.stripped(F.left(F.array_join(folded["kept"], "\n"), F.lit(6000)))


_F = (("Summary", "summary"), ("Strengths", "strengths"), ("Weaknesses", "weaknesses"), ("Questions", "questions"), ("Review", "body"))
S.add_cte("cored", "SELECT review_id, " + S.d_strip(
    "left(array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN f{i} <> '' " + "".join(f"AND lower(f{i}) <> lower(f{j}) " for j in range(i)) + f"THEN '{k}: ' || f{i} END" for i, (k, _) in enumerate(_F)) + "], lambda x: x IS NOT NULL), chr(10)), 6000)")
    + " AS core FROM (SELECT review_id, " + ", ".join(f"{S.d_clean_ws(v)} AS f{i}" for i, (_, v) in enumerate(_F)) + " FROM reviewed)", "reviewed")


@query(S.sql("SELECT review_id, length(core) AS n, md5(core) AS digest FROM cored", "cored"))
def core_review_text(spark: SparkSession, d: str) -> DataFrame:
    return _reviewed(spark, d).select("review_id", core_text().alias("core")).select("review_id", F.length("core").cast("bigint").alias("n"), F.md5(F.col("core").cast("binary")).alias("digest"))


_ADMIN = "(?is)" + "|".join(f"(?:{p})" for p in L.AUTHOR_OR_ADMIN)


@query(S.sql(f"SELECT review_id FROM cored WHERE core <> '' AND NOT regexp_matches(core, '{_ADMIN}')", "cored"))
def scoreable_reviews(spark: SparkSession, d: str) -> DataFrame:
    return _reviewed(spark, d).select("review_id", core_text().alias("core")).where((F.col("core") != "") & ~F.col("core").rlike(_ADMIN)).select("review_id")


@query("SELECT doc_id, word, n FROM (SELECT doc_id, word, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(i)) AS rn FROM (SELECT doc_id, x[i] AS word, i FROM (SELECT doc_id, " + S.d_token_list("text") + " AS x FROM documents), unnest(range(1, len(x) + 1)) AS t(i)) GROUP BY doc_id, word) WHERE rn <= 5")
def top_keywords(spark: SparkSession, d: str) -> DataFrame:
    """The five most frequent tokens of each text; ties go to the first seen."""
    # whole texts are dealt by document once, so words are grouped and ranked where they are
    docs = S.table(spark, d, "documents").select("doc_id", "text").repartition("doc_id")
    words = docs.select("doc_id", F.posexplode_outer(T.token_list("text")).alias("i", "word")).where("word is not null")
    counts = words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first"))
    return counts.withColumn("rn", rank).where("rn <= 5").select("doc_id", "word", "n")
