"""Queries of benchmarks, agreement, quality and cost reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumlab.functions import lexicons as L
from quorumlab.functions import text as T
from quorumlab.operators import audit, inventory, reports, scoring
from quorumlab.plans import standins as S
from quorumlab.plans import text_plans  # noqa: F401  (its stand-in of ruled claims)
from quorumlab.plans.registry import query

S.add_cte(
    "classed",
    """SELECT memory_id, dimension, dataset, ['train', 'dev', 'test'][ord % 3 + 1] AS split, gold_label AS gold,
  CASE dimension WHEN 'substantiation' THEN CASE WHEN length(input_text) % 7 > 1 THEN 'substantiated' ELSE 'unsubstantiated' END ELSE CASE WHEN length(input_text) % 5 > 0 THEN 'professional' ELSE 'unprofessional' END END AS predicted FROM v_memory""",
    "v_memory",
)


def _classed(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("input_text")
    predicted = F.when(F.col("dimension") == "substantiation", F.when(n % 7 > 1, "substantiated").otherwise("unsubstantiated")).otherwise(F.when(n % 5 > 0, "professional").otherwise("unprofessional"))
    split = F.element_at(T.words_of(("train", "dev", "test")), (F.col("ord") % 3 + 1).cast("int"))
    return S.view(spark, d, "v_memory").select("memory_id", "dimension", "dataset", split.alias("split"), F.col("gold_label").alias("gold"), predicted.alias("predicted"))


def _label_sql(source: str, key: str = "") -> str:
    k = f"{key}, " if key else ""
    return f"""SELECT {k}label, tp, fp, fn, precision, recall, CASE WHEN precision + recall > 0 THEN round(2 * precision * recall / (precision + recall), 4) ELSE 0 END AS f1 FROM (
SELECT *, CASE WHEN tp + fp > 0 THEN round(tp::DOUBLE / (tp + fp), 4) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp::DOUBLE / (tp + fn), 4) ELSE 0 END AS recall FROM (
SELECT {k}label, CAST(count(*) FILTER (gold = label AND predicted = label AND side = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (side = 2 AND gold <> label) AS BIGINT) AS fp, CAST(count(*) FILTER (side = 1 AND predicted <> label) AS BIGINT) AS fn
FROM (SELECT {k}gold, predicted, unnest([gold, predicted]) AS label, unnest([1, 2]) AS side FROM {source}) GROUP BY ALL))"""


def _class_sql(source: str, key: str = "") -> str:
    k, by = (f"{key}, ", f"GROUP BY {key}") if key else ("", "")
    join = f"JOIN ({_label_group(source, key)}) m USING ({key})" if key else f"CROSS JOIN ({_label_group(source, key)}) m"
    return f"""SELECT {k}records, accuracy, majority_baseline, balanced_accuracy, macro_f1 FROM (SELECT {k}CAST(sum(n) AS BIGINT) AS records, round(sum(hit)::DOUBLE / sum(n), 4) AS accuracy, round(max(n)::DOUBLE / sum(n), 4) AS majority_baseline
FROM (SELECT {k}gold, count(*) AS n, count(*) FILTER (gold = predicted) AS hit FROM {source} GROUP BY ALL) {by}) b {join}"""


def _label_group(source: str, key: str) -> str:
    k, by = (f"{key}, ", f"GROUP BY {key}") if key else ("", "")
    return f"SELECT {k}{S.d_mean4('recall')} AS balanced_accuracy, {S.d_mean4('f1')} AS macro_f1 FROM ({_label_sql(source, key)}) {by}"


@query(S.sql(_class_sql("classed"), "classed"))
def classification_benchmark(spark: SparkSession, d: str) -> DataFrame:
    return reports.classification(_classed(spark, d))


@query(S.sql(_label_sql("classed"), "classed"))
def classification_labels(spark: SparkSession, d: str) -> DataFrame:
    return reports.per_label(_classed(spark, d))


@query(S.sql("SELECT facet, value, count(*) AS records, round(count(*) FILTER (gold = predicted)::DOUBLE / count(*), 4) AS accuracy FROM (SELECT gold, predicted, unnest(['all', 'dataset', 'split']) AS facet, unnest(['all', dataset, split]) AS value FROM classed) GROUP BY ALL", "classed"))
def classification_facets(spark: SparkSession, d: str) -> DataFrame:
    return reports.facet_accuracy(_classed(spark, d), ("dataset", "split"))


@query(S.sql(_class_sql("classed", "dimension"), "classed"))
def scoring_suite(spark: SparkSession, d: str) -> DataFrame:
    return reports.classification(_classed(spark, d), ("dimension",))


S.add_cte("suite", _class_sql("classed", "dimension"), "classed")
S.add_cte("suite_before", _class_sql("(SELECT * FROM classed WHERE split <> 'test')", "dimension"), "classed")


@query(S.sql("SELECT dimension, metric, now, before, CASE WHEN now < 0.5 THEN 'fail' WHEN before IS NULL THEN 'skipped' WHEN round(before - now, 4) > 0.02 THEN 'fail' ELSE 'pass' END AS status FROM (SELECT dimension, unnest(['accuracy', 'macro_f1']) AS metric, unnest([accuracy, macro_f1]) AS now FROM suite) LEFT JOIN (SELECT dimension, unnest(['accuracy', 'macro_f1']) AS metric, unnest([accuracy, macro_f1]) AS before FROM suite_before WHERE dimension <> 'professionalism') USING (dimension, metric)", "suite", "suite_before"))
def metric_guardrail(spark: SparkSession, d: str) -> DataFrame:
    rows = _classed(spark, d)
    before = reports.classification(rows.where("split <> 'test'"), ("dimension",)).where("dimension <> 'professionalism'")
    return reports.guardrail(reports.classification(rows, ("dimension",)), before, ["dimension"], ("accuracy", "macro_f1"), 0.5, 0.02)


@query(S.sql("SELECT dataset, dimension, gold, predicted, count(*) AS n FROM classed GROUP BY GROUPING SETS ((dataset), (dimension), (dimension, gold), (dimension, predicted))", "classed"))
def normalized_summary(spark: SparkSession, d: str) -> DataFrame:
    sets = [["dataset"], ["dimension"], ["dimension", "gold"], ["dimension", "predicted"]]
    names = ["dataset", "dimension", "gold", "predicted"]
    return _classed(spark, d).groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(F.count(F.lit(1)).alias("n"))


S.add_cte("aligned", "SELECT l_orderkey AS task_id, l_orderkey % 5 AS dataset, list(l_linenumber) FILTER (l_returnflag = 'R') AS g, list(l_linenumber) FILTER (l_linestatus = 'F') AS p FROM lineitem GROUP BY ALL")
S.add_cte(
    "aligned_rows",
    """SELECT *, CASE WHEN precision + recall > 0 THEN round(2 * precision * recall / (precision + recall), 4) ELSE 0 END AS f1 FROM (SELECT task_id, dataset, len(gg) > 0 AND list_sort(gg) = list_sort(pp) AS exact_match, c > 0 AS any_overlap, CASE WHEN len(pp) > 0 THEN round(c::DOUBLE / len(pp), 4) ELSE 0 END AS precision, CASE WHEN len(gg) > 0 THEN round(c::DOUBLE / len(gg), 4) ELSE 0 END AS recall
FROM (SELECT *, len(list_intersect(gg, pp)) AS c FROM (SELECT task_id, dataset, list_distinct(coalesce(g, [])) AS gg, list_distinct(coalesce(p, [])) AS pp FROM aligned)))""",
    "aligned",
)


@query(S.sql(f"SELECT dataset, count(*) AS records, round(count(*) FILTER (exact_match)::DOUBLE / count(*), 4) AS exact_rate, round(count(*) FILTER (any_overlap)::DOUBLE / count(*), 4) AS overlap_rate, {S.d_mean4('precision')} AS mean_precision, {S.d_mean4('recall')} AS mean_recall, {S.d_mean4('f1')} AS mean_f1 FROM aligned_rows GROUP BY dataset", "aligned_rows"))
def alignment_benchmark(spark: SparkSession, d: str) -> DataFrame:
    lines = S.table(spark, d, "lineitem")
    ids = lines.groupBy(F.col("l_orderkey").alias("task_id")).agg(F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("gold_ids"), F.collect_list(F.when(F.col("l_linestatus") == "F", F.col("l_linenumber"))).alias("predicted_ids"))
    rows = reports.alignment(ids.withColumn("dataset", F.col("task_id") % 5))
    return rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("records"), T.rate(F.col("exact_match")).alias("exact_rate"), T.rate(F.col("any_overlap")).alias("overlap_rate"), *(T.mean4(k).alias(f"mean_{k}") for k in ("precision", "recall", "f1")))


_MATERIAL = "SELECT CASE importance WHEN 'major' THEN 'high' WHEN 'medium' THEN 'medium' ELSE 'low' END AS importance, response_label AS response, effect_label AS effect FROM claims JOIN claim_labels USING (task_id)"
S.add_cte("material", _MATERIAL, "claims", "claim_labels")


def _material(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("importance") == "major", "high").when(F.col("importance") == "medium", "medium").otherwise("low")
    return S.claims(spark, d).join(S.claim_labels(spark, d), "task_id").select("task_id", "paper_id", "review_id", "claim_text", level.alias("importance"), F.col("response_label").alias("response"), F.col("effect_label").alias("effect"), "confidence")


@query(S.sql("SELECT importance, effect, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY importance), 4) AS share FROM (SELECT importance, effect, count(*) AS n FROM material GROUP BY importance, effect)", "material"))
def materiality_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return reports.crosstab(_material(spark, d), "importance", "effect")



@query(S.sql("SELECT CASE WHEN abs(a - b) = 0 THEN 'exact' WHEN abs(a - b) = 1 THEN 'adjacent' ELSE 'conflict' END AS relation, count(*) AS n FROM (SELECT CASE response WHEN 'not_addressed' THEN 0 WHEN 'generic_or_unclear' THEN 1 WHEN 'specifically_addressed' THEN 2 ELSE 3 END AS a, CASE effect WHEN 'does_not_address' THEN 0 WHEN 'unclear' THEN 1 WHEN 'partially_addresses' THEN 2 ELSE 3 END AS b FROM material) GROUP BY 1", "material"))
def axis_relations(spark: SparkSession, d: str) -> DataFrame:
    """Response and effect as two ordered axes: exact, adjacent or in conflict."""
    a = F.when(F.col("response") == "not_addressed", 0).when(F.col("response") == "generic_or_unclear", 1).when(F.col("response") == "specifically_addressed", 2).otherwise(3)
    b = F.when(F.col("effect") == "does_not_address", 0).when(F.col("effect") == "unclear", 1).when(F.col("effect") == "partially_addresses", 2).otherwise(3)
    gap = F.abs(a - b)
    return _material(spark, d).groupBy(F.when(gap == 0, "exact").when(gap == 1, "adjacent").otherwise("conflict").alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@query(S.sql("SELECT count(DISTINCT paper_id) AS papers, count(DISTINCT review_id) AS reviews, count(*) AS claims, round(count(*) FILTER (source_sentence <> '')::DOUBLE / count(*), 4) AS grounded FROM claims", "claims"))
def nesting_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.claims(spark, d).agg(F.countDistinct("paper_id").alias("papers"), F.countDistinct("review_id").alias("reviews"), F.count(F.lit(1)).alias("claims"), T.rate(F.col("source_sentence") != "").alias("grounded"))


S.add_cte("addr_items", "SELECT task_id, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles FROM (SELECT task_id, 'main' AS role FROM claim_labels WHERE effect_label IN ('does_not_address', 'partially_addresses') UNION ALL SELECT task_id, 'control_resolved' FROM claim_labels WHERE effect_label = 'resolved_or_weakened' UNION ALL SELECT task_id, 'control_specific' FROM claim_labels WHERE response_label = 'specifically_addressed') GROUP BY task_id", "claim_labels")


@query(S.sql("SELECT * FROM addr_items", "addr_items"))
def addressability_items(spark: SparkSession, d: str) -> DataFrame:
    """Main candidates and controls with the roles of each claim."""
    labels = S.claim_labels(spark, d)
    roles = {"main": F.col("effect_label").isin("does_not_address", "partially_addresses"), "control_resolved": F.col("effect_label") == "resolved_or_weakened", "control_specific": F.col("response_label") == "specifically_addressed"}
    rows = labels.select("task_id", F.explode(F.array_compact(F.array(*(F.when(v, k) for k, v in roles.items())))).alias("role"))
    return rows.groupBy("task_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


S.add_cte("addressed", "SELECT task_id, importance, ['fixable_by_text', 'fixable_by_experiment', 'not_fixable', 'unclear'][length(claim_text) % 4 + 1] AS addressability, effect_label AS effect FROM claims JOIN claim_labels USING (task_id)", "claims", "claim_labels")


@query(S.sql("SELECT effect, count(*) AS n, count(*) FILTER (prefix(addressability, 'fixable')) AS fixable, count(*) FILTER (addressability = 'not_fixable') AS not_fixable, count(*) FILTER (addressability = 'unclear') AS unclear, CASE WHEN count(*) FILTER (addressability <> 'unclear') > 0 THEN round(count(*) FILTER (prefix(addressability, 'fixable'))::DOUBLE / count(*) FILTER (addressability <> 'unclear'), 4) ELSE 0 END AS determinate_rate, count(*) FILTER (importance = 'major' AND addressability = 'not_fixable') AS headline FROM addressed GROUP BY effect", "addressed"))
def addressability_report(spark: SparkSession, d: str) -> DataFrame:
    kinds = T.words_of(("fixable_by_text", "fixable_by_experiment", "not_fixable", "unclear"))
    rows = S.claims(spark, d).join(S.claim_labels(spark, d), "task_id").select("importance", F.element_at(kinds, F.length("claim_text") % 4 + 1).alias("addressability"), F.col("effect_label").alias("effect"))
    fix, kind = F.col("addressability").startswith("fixable"), F.col("addressability")
    return rows.groupBy("effect").agg(F.count(F.lit(1)).alias("n"), F.count_if(fix).alias("fixable"), F.count_if(kind == "not_fixable").alias("not_fixable"), F.count_if(kind == "unclear").alias("unclear"), T.rate(fix, kind != "unclear").alias("determinate_rate"), F.count_if((F.col("importance") == "major") & (kind == "not_fixable")).alias("headline"))


@query("SELECT claim_id, CAST(count(*) AS BIGINT) AS repeats, count(*) FILTER (flag = main) AS exact, count(DISTINCT flag) = 1 AS unanimous FROM (SELECT l_orderkey AS claim_id, l_returnflag AS flag, first_value(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS main FROM lineitem) GROUP BY claim_id")
def self_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Repeated labels of a claim against its first one."""
    lines = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_returnflag").alias("flag"), "l_linenumber")
    # counts of each label meet, not its lines: no join, and a claim has as many rows as labels
    labels = lines.groupBy("claim_id", "flag").agg(F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("at"))
    main = F.min(F.struct("at", "flag", "n"))
    found = labels.groupBy("claim_id").agg(F.sum("n").alias("repeats"), main.alias("main"), (F.count("flag") == 1).alias("unanimous"))
    return found.select("claim_id", "repeats", F.when(F.col("main.flag").isNotNull(), F.col("main.n")).otherwise(0).alias("exact"), "unanimous")


S.add_cte("majority", "SELECT claim_id, pair, addressability, CAST(sum(n) AS BIGINT) AS judgments, CASE WHEN max(n) >= floor(sum(n) / 2) + 1 THEN first(winner ORDER BY n DESC, winner DESC) ELSE 'unstable' END AS stable_winner FROM (SELECT claim_id, pair, addressability, winner, count(*) AS n FROM v_judgment GROUP BY ALL) GROUP BY claim_id, pair, addressability", "v_judgment")


@query(S.sql("SELECT pair, addressability, stable_winner, count(*) AS claims, CAST(sum(judgments) AS BIGINT) AS judgments FROM majority GROUP BY ALL", "majority"))
def pairwise_majority(spark: SparkSession, d: str) -> DataFrame:
    found = reports.pairwise_majority(S.view(spark, d, "v_judgment"))
    return found.groupBy("pair", "addressability", "stable_winner").agg(F.count(F.lit(1)).alias("claims"), F.sum("judgments").alias("judgments"))


@query(S.sql("SELECT arm_a AS arm, count(*) AS n, round(avg(words), 4) AS mean_words, min(words) AS least, max(words) AS most, (SELECT count(*) FROM (SELECT claim_id, avg(words) FILTER (arm_a = 'engage') AS e, avg(words) FILTER (arm_a = 'polished') AS p FROM v_judgment GROUP BY claim_id) WHERE abs(e - p) / greatest(e, p) > 0.15) AS unequal_pairs FROM v_judgment GROUP BY arm_a", "v_judgment"))
def arm_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Words of each arm, and claims whose two arms differ by more than 15 percent."""
    rows = S.view(spark, d, "v_judgment")
    arms = rows.groupBy(F.col("arm_a").alias("arm")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("words"), 4).alias("mean_words"), F.min("words").alias("least"), F.max("words").alias("most"))
    paired = rows.groupBy("claim_id").agg(F.avg(F.when(F.col("arm_a") == "engage", F.col("words"))).alias("e"), F.avg(F.when(F.col("arm_a") == "polished", F.col("words"))).alias("p"))
    unequal = paired.where(F.abs(F.col("e") - F.col("p")) / F.greatest("e", "p") > 0.15).agg(F.count(F.lit(1)).alias("unequal_pairs"))
    return arms.withColumn("k", F.lit(1)).join(unequal.withColumn("k", F.lit(1)), "k").drop("k")


@query(S.sql("SELECT addressability, count(*) AS n, round(avg(CASE WHEN arm_a = 'engage' THEN helpful_a - helpful_b ELSE helpful_b - helpful_a END), 3) AS mean_delta FROM v_judgment GROUP BY addressability", "v_judgment"))
def paired_deltas(spark: SparkSession, d: str) -> DataFrame:
    delta = (F.col("helpful_a") - F.col("helpful_b")).cast("double")
    rows = S.view(spark, d, "v_judgment")
    return rows.groupBy("addressability").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("arm_a") == "engage", delta).otherwise(-delta)), 3).alias("mean_delta"))


_FIELDS = ("verdict", "tone", "scope")
S.add_cte("human", "SELECT doc_id AS task_id, ['review', 'claim', 'evidence'][doc_id % 3 + 1] AS task_type, n_chars % 3 AS verdict, n_chars % 2 AS tone, n_chars % 5 AS scope FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
S.add_cte("model", "SELECT doc_id AS task_id, doc_id % 3 AS verdict, n_chars % 2 AS tone, doc_id % 5 AS scope FROM documents")


def _two_runs(spark: SparkSession, d: str) -> DataFrame:
    docs = S.table(spark, d, "documents")
    i, n = F.col("doc_id"), F.col("n_chars")
    kind = F.element_at(T.words_of(("review", "claim", "evidence")), (i % 3 + 1).cast("int"))
    human = docs.join(S.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select(i.alias("task_id"), kind.alias("task_type"), (n % 3).alias("h_verdict"), (n % 2).alias("h_tone"), (n % 5).alias("h_scope"))
    model = docs.select(i.alias("task_id"), (i % 3).alias("m_verdict"), (n % 2).alias("m_tone"), (i % 5).alias("m_scope"))
    return human.join(model, "task_id")


@query(S.sql("SELECT task_type, field, count(*) AS n, round(count(*) FILTER (a = b)::DOUBLE / count(*), 4) AS agreement FROM (SELECT h.task_type, unnest(['verdict', 'tone', 'scope']) AS field, unnest([h.verdict, h.tone, h.scope]) AS a, unnest([m.verdict, m.tone, m.scope]) AS b FROM human h JOIN model m USING (task_id)) GROUP BY ALL", "human", "model"))
def compare_annotations(spark: SparkSession, d: str) -> DataFrame:
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"h_{f}").alias("a"), F.col(f"m_{f}").alias("b")) for f in _FIELDS))
    return _two_runs(spark, d).select("task_type", F.inline(fields)).groupBy("task_type", "field").agg(F.count(F.lit(1)).alias("n"), T.rate(F.col("a") == F.col("b")).alias("agreement"))


@query(S.sql("SELECT task_type, count(*) AS n, round(count(*) FILTER (h.verdict = m.verdict AND h.tone = m.tone AND h.scope = m.scope)::DOUBLE / count(*), 4) AS exact_match, count(DISTINCT h.verdict) AS verdicts FROM human h JOIN model m USING (task_id) GROUP BY task_type", "human", "model"))
def pseudo_label_agreement(spark: SparkSession, d: str) -> DataFrame:
    same = (F.col("h_verdict") == F.col("m_verdict")) & (F.col("h_tone") == F.col("m_tone")) & (F.col("h_scope") == F.col("m_scope"))
    return _two_runs(spark, d).groupBy("task_type").agg(F.count(F.lit(1)).alias("n"), T.rate(same).alias("exact_match"), F.countDistinct("h_verdict").alias("verdicts"))


# quality, coverage and cost over reviews


_SAID = ("Accept (poster)", "Reject", "Unknown", "", "Accept (oral)", "Withdrawn")
S.add_cte(
    "v_paper",
    f"""SELECT venue, paper_id, {S._list(_SAID)}[n % 6 + 1] AS decision, CASE WHEN n % 5 = 0 THEN ' ' ELSE 'An abstract' END AS abstract FROM (SELECT venue, paper_id, CAST(sum(n_chars) AS BIGINT) AS n FROM v_review GROUP BY ALL)
UNION ALL SELECT 'en', 'x' || n_nationkey, 'Reject', '' FROM nation""",
    "v_review",
)
S.add_cte(
    "paper_quality",
    "SELECT * REPLACE (coalesce(n, 0) AS n, coalesce(empty, 0) AS empty, coalesce(rated, 0) AS rated, coalesce(sure, 0) AS sure, CASE WHEN decision NOT IN ('', 'Unknown') THEN decision END AS decision) FROM v_paper LEFT JOIN (SELECT venue, paper_id, count(*) AS n, count(*) FILTER (trim(coalesce(review_text, ''), ' ' || chr(10) || chr(9) || chr(13)) = '') AS empty, count(rating_normalized) AS rated, count(confidence_normalized) AS sure FROM v_review GROUP BY ALL) USING (venue, paper_id)",
    "v_paper",
)
_SHARE = "CASE WHEN {1} > 0 THEN round({0}::DOUBLE / {1}, 4) ELSE 0.0::DOUBLE END AS {2}"
S.add_cte(
    "venue_quality",
    "SELECT venue, count(*) AS papers, CAST(sum(n) AS BIGINT) AS reviews, min(n) AS least, max(n) AS most, round(sum(n)::DOUBLE / count(*), 3) AS mean_reviews, "
    + ", ".join(_SHARE.format(x, of, name) for x, of, name in (("sum(empty)", "sum(n)", "empty_rate"), ("sum(rated)", "sum(n)", "rating_coverage"), ("sum(sure)", "sum(n)", "confidence_coverage"), ("count(decision)", "count(*)", "decision_coverage"), ("count(*) FILTER (trim(abstract) <> '')", "count(*)", "abstract_coverage")))
    + " FROM paper_quality GROUP BY venue",
    "paper_quality",
)


@query(
    S.sql(
        """SELECT v.*, histogram, coalesce(top_decisions, '') AS top_decisions FROM venue_quality v
JOIN (SELECT venue, string_agg(n || ':' || k, ',' ORDER BY n) AS histogram FROM (SELECT venue, n, count(*) AS k FROM paper_quality GROUP BY ALL) GROUP BY venue) USING (venue)
LEFT JOIN (SELECT venue, string_agg(decision || ':' || k, ',' ORDER BY k DESC, decision) AS top_decisions FROM (SELECT venue, decision, count(*) AS k FROM paper_quality WHERE decision IS NOT NULL GROUP BY ALL) GROUP BY venue) USING (venue)""",
        "venue_quality",
        "paper_quality",
    )
)
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d)


def _quality(spark: SparkSession, d: str) -> DataFrame:
    reviews = S.view(spark, d, "v_review")
    n = F.sum("n_chars")
    papers = reviews.groupBy("venue", "paper_id").agg(F.element_at(T.words_of(_SAID), (n % 6 + 1).cast("int")).alias("decision"), F.when(n % 5 == 0, " ").otherwise("An abstract").alias("abstract"))
    bare = S.table(spark, d, "nation").select(F.lit("en").alias("venue"), F.concat(F.lit("x"), "n_nationkey").alias("paper_id"), F.lit("Reject").alias("decision"), F.lit("").alias("abstract"))
    return reports.quality_report(papers.unionByName(bare), reviews)


@query(S.sql("SELECT venue, CASE WHEN papers < 100 THEN 'fail' ELSE 'pass' END AS paper_gate, CASE WHEN reviews < 120 THEN 'fail' ELSE 'pass' END AS review_gate, CASE WHEN empty_rate > 0.05 THEN 'fail' ELSE 'pass' END AS empty_gate FROM venue_quality", "venue_quality"))
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return reports.quality_gate(_quality(spark, d))


@query(S.sql("SELECT source, venue, count(DISTINCT paper_id) AS papers, count(*) AS reviews, round(count(rating_normalized)::DOUBLE / count(*), 4) AS rating_coverage, round(count(confidence_normalized)::DOUBLE / count(*), 4) AS confidence_coverage FROM v_review GROUP BY ALL", "v_review"))
def venue_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = S.view(spark, d, "v_review")
    return rows.groupBy("source", "venue").agg(F.countDistinct("paper_id").alias("papers"), F.count(F.lit(1)).alias("reviews"), T.rate(F.col("rating_normalized").isNotNull()).alias("rating_coverage"), T.rate(F.col("confidence_normalized").isNotNull()).alias("confidence_coverage"))


@query(S.sql("SELECT source, count(*) AS requests, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, round(sum(tokens_in) * 0.10 / 1000000 + count(*) * 120 * 0.625 / 1000000, 6) AS cost FROM (SELECT source, greatest(1, CAST(round_even(n_chars / 4.0, 0) AS BIGINT)) AS tokens_in FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id < 3)) GROUP BY source"))
def batch_cost(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and cost of each manifest, manifests that were split into parts left out."""
    docs = S.table(spark, d, "documents")
    parents = docs.where("doc_id < 3").select("source").distinct()
    rows = docs.join(parents, "source", "left_anti").withColumn("tokens_in", reports.tokens_of(F.col("n_chars")))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens_in").alias("tokens_in"), F.round(F.sum("tokens_in") * 0.10 / 1_000_000 + F.count(F.lit(1)) * 120 * 0.625 / 1_000_000, 6).alias("cost"))


# threads


S.add_cte("first_response", "SELECT paper_id, min(created_ms) AS first_ms FROM v_reply WHERE note_type = 'author_response' GROUP BY paper_id", "v_reply")


@query(S.sql("SELECT paper_id, count(*) FILTER (note_type = 'official_review' AND modified_ms > first_ms AND modified_ms > created_ms) AS review_updates, count(*) FILTER (note_type = 'official_comment' AND created_ms > first_ms) AS reviewer_comments, count(*) FILTER (created_ms > first_ms AND regexp_matches(lower(text), '(score|rating|ing)')) AS rating_like FROM v_reply JOIN first_response USING (paper_id) GROUP BY paper_id", "v_reply", "first_response"))
def post_rebuttal(spark: SparkSession, d: str) -> DataFrame:
    """Reviews changed and comments made after the paper's first author response."""
    rows = S.view(spark, d, "v_reply")
    first = rows.where("note_type = 'author_response'").groupBy("paper_id").agg(F.min("created_ms").alias("first_ms"))
    after, kind = F.col("created_ms") > F.col("first_ms"), F.col("note_type")
    updated = (kind == "official_review") & (F.col("modified_ms") > F.col("first_ms")) & (F.col("modified_ms") > F.col("created_ms"))
    return rows.join(first, "paper_id").groupBy("paper_id").agg(F.count_if(updated).alias("review_updates"), F.count_if(after & (kind == "official_comment")).alias("reviewer_comments"), F.count_if(after & F.lower("text").rlike("(score|rating|ing)")).alias("rating_like"))


_KIND = "CASE WHEN note_type = 'meta_review' AND length(text) % 3 = 0 THEN 'decision' ELSE note_type END"
_NOTE = f"""SELECT paper_id, turn AS pos, {_KIND} AS note_type, CASE WHEN signer_role = 'authors' AND turn % 2 = 0 THEN 'reviewer' ELSE signer_role END AS signer_role, created_ms, modified_ms, CASE WHEN length(text) % 5 = 0 THEN '' ELSE text END AS text,
CASE WHEN length(text) % 4 = 0 THEN '' ELSE text END AS comment_text, CASE WHEN length(text) % 2 = 0 THEN 'Accept' ELSE '' END AS decision,
CASE WHEN length(text) % 3 = 0 THEN CAST(5 AS DOUBLE) END AS rating_normalized, CASE WHEN length(text) % 4 = 0 THEN CAST(2 AS DOUBLE) END AS confidence_normalized FROM v_reply"""
S.add_cte("inventory_note", _NOTE, "v_reply")
S.add_cte("first_note", "SELECT paper_id, min(created_ms) AS first_ms FROM inventory_note WHERE note_type = 'author_response' GROUP BY paper_id", "inventory_note")
_TALK = "note_type = 'official_comment' AND signer_role IN ('reviewer', 'area_chair', 'program_chair')"
S.add_cte(
    "inventory",
    f"""SELECT paper_id, count(pos) AS replies, count(*) FILTER (note_type = 'official_review') AS reviews, count(*) FILTER (note_type = 'author_response') AS author_responses, count(*) FILTER (note_type = 'meta_review') AS meta_reviews,
count(*) FILTER (note_type = 'decision') AS decisions, count(*) FILTER (note_type = 'official_comment') AS official_comments, count(*) FILTER ({_TALK}) AS discussion, count(*) FILTER ({_TALK} AND created_ms > first_ms) AS post_comments,
count(*) FILTER (note_type = 'official_review' AND modified_ms > first_ms AND modified_ms > created_ms) AS review_updates, min(first_ms) AS first_ms,
coalesce(first(decision ORDER BY pos) FILTER (note_type = 'decision' AND decision <> ''), first({S.d_clean("text")} ORDER BY pos) FILTER (note_type = 'decision' AND {S.d_clean("text")} <> ''), '') AS label,
count(*) FILTER (note_type = 'official_review' AND rating_normalized IS NOT NULL) AS ratings, count(*) FILTER (note_type = 'official_review' AND confidence_normalized IS NOT NULL) AS sure,
count(*) FILTER (note_type = 'meta_review' AND text <> '') AS meta_text, count(*) FILTER (note_type = 'decision' AND comment_text <> '') AS decision_comment
FROM (SELECT paper_id FROM inventory_note UNION SELECT 'empty' || r_regionkey FROM region) LEFT JOIN inventory_note USING (paper_id) LEFT JOIN first_note USING (paper_id) GROUP BY paper_id""",
    "inventory_note",
    "first_note",
)
_HAS = ("reviews > 0", "reviews >= 2", "ratings > 0", "sure > 0", "author_responses > 0", "meta_reviews > 0", "meta_text > 0", "decisions > 0", "label <> ''", "decision_comment > 0", "official_comments > 0", "discussion > 0", "post_comments > 0", "review_updates > 0")
_CAN = ("true", _HAS[4], _HAS[6], _HAS[9], f"({_HAS[6]} OR {_HAS[9]})", _HAS[11], _HAS[12], _HAS[13], _HAS[1], _HAS[2], _HAS[3])
_BITS = (*_HAS, *(f"reviews > 0 AND {c}" for c in _CAN))
S.add_cte("masked", "SELECT *, CAST(" + " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(_BITS)) + " AS INTEGER) AS mask FROM inventory", "inventory")


def _inventory(spark: SparkSession, d: str) -> DataFrame:
    notes = spark.sql(_NOTE.replace("FROM v_reply", "FROM {v}"), v=S.view(spark, d, "v_reply"))
    bare = S.table(spark, d, "region").select(F.concat(F.lit("empty"), "r_regionkey").alias("paper_id"))
    return inventory.paper_inventory(notes.select("paper_id").distinct().unionByName(bare), notes)


@query(S.sql(f"SELECT paper_id, replies, {', '.join(inventory.COUNTS)}, md5(CASE WHEN label = '' THEN 'Unknown' ELSE label END) AS decision, first_ms, mask FROM masked", "masked"))
def paper_inventory(spark: SparkSession, d: str) -> DataFrame:
    return _inventory(spark, d).withColumn("decision", F.md5(F.col("decision").cast("binary")))


@query(
    S.sql(
        f"""SELECT CASE WHEN i < 14 THEN 'availability' ELSE 'metric' END AS section, flag, papers, round(papers::DOUBLE / n, 4) AS rate,
CASE WHEN i < 14 THEN NULL WHEN papers = 0 THEN 'not_available' WHEN flag IN ({S._in(inventory.SPARSE)}) AND papers::DOUBLE / n < 0.2 THEN 'limited' WHEN papers::DOUBLE / n >= 0.8 THEN 'strong' WHEN papers::DOUBLE / n >= 0.4 THEN 'usable' ELSE 'limited' END AS status
FROM (SELECT unnest(range(0, 25)) AS i, unnest({S._list(inventory.NAMES)}) AS flag, unnest([{", ".join(f"count(*) FILTER (mask & {1 << i} > 0)" for i in range(25))}]) AS papers, count(*) AS n FROM masked)""",
        "masked",
    )
)
def inventory_report(spark: SparkSession, d: str) -> DataFrame:
    return inventory.inventory_report(_inventory(spark, d))


#: Stand-in files of 16 papers with four reviews each, and of request lines, some with keys that they must not have.
_REVIEW_JSON = """json_merge_patch('{}'::JSON, json_object('review_id', 'r' || doc_id, 'review_text', text, 'rating_raw', n_chars % 10, 'notes', CASE WHEN doc_id % 5 = 0 THEN source END, 'Body_Text', CASE WHEN doc_id % 7 = 0 THEN lang END,
  'meta', CASE WHEN doc_id % 11 = 0 THEN json_object('sections', json_array(json_object('paragraphs', n_chars), 1)) END))"""
S.add_cte("review_json", f"SELECT doc_id - doc_id % 4 AS paper, doc_id, {_REVIEW_JSON} AS r FROM documents")
S.add_cte(
    "paper_json",
    """SELECT paper, json_merge_patch('{}'::JSON, json_object('paper_id', 'p' || paper, 'venue', 'V', 'pdf_url', CASE WHEN paper % 3 = 0 THEN 'x' || paper WHEN paper % 3 = 1 THEN '' END, 'score', CASE WHEN paper % 8 = 0 THEN 1 END, 'reviews', list(r ORDER BY doc_id))) AS p FROM review_json GROUP BY paper""",
    "review_json",
)
S.add_cte("json_files", "SELECT 'f' || CAST(floor(paper / 64) AS BIGINT) AS file, json_object('papers', list(p ORDER BY paper), 'version', 1) AS j FROM paper_json GROUP BY 1", "paper_json")
_FORBIDDEN = f"lower(key) IN ({S._in(L.FORBIDDEN_KEYS)})"
S.add_cte("json_members", "SELECT file, key, substr(fullkey, 3) AS loc, fullkey, atom FROM json_files, json_tree(j) WHERE fullkey <> '$'", "json_files")
S.add_cte("forbidden", f"SELECT file, loc, row_number() OVER (PARTITION BY file ORDER BY loc) AS nr FROM json_members WHERE {_FORBIDDEN}", "json_members")
_EXTRA = "coalesce(string_agg(DISTINCT key, ',' ORDER BY key) FILTER (regexp_full_match(loc, '{0}') AND key NOT IN ({1})), '')"
_MARKED = ", ".join(f"count(*) FILTER (contains(lower(line), '{m}')) AS {m}" for m in L.FORBIDDEN_MARKERS)


@query(
    S.sql(
        rf"""SELECT * FROM (SELECT file, count(*) FILTER (regexp_full_match(loc, 'papers\[[0-9]+\]')) AS paper_count, count(*) FILTER (regexp_full_match(loc, 'papers\[[0-9]+\]\.reviews\[[0-9]+\]')) AS review_count,
  {_EXTRA.format(r"papers\[[0-9]+\]\.[^.\[]+", S._in(L.PAPER_KEYS))} AS paper_extra_keys, {_EXTRA.format(r"papers\[[0-9]+\]\.reviews\[[0-9]+\]\.[^.\[]+", S._in(L.REVIEW_KEYS))} AS review_extra_keys,
  count(*) FILTER (regexp_full_match(loc, 'papers\[[0-9]+\]\.pdf_url') AND atom <> '""') AS pdf_url_pointer_count FROM json_members GROUP BY file)
JOIN (SELECT file, count(loc) AS forbidden_path_count, coalesce(string_agg(loc, ';' ORDER BY loc) FILTER (nr <= 50), '') AS forbidden_paths, CASE WHEN count(loc) > 0 THEN 'failed' ELSE 'ok' END AS status FROM json_files LEFT JOIN forbidden USING (file) GROUP BY file) USING (file)""",
        "json_members",
        "forbidden",
    )
)
def minimization_audit(spark: SparkSession, d: str) -> DataFrame:
    """Forbidden and unexpected keys at any depth of files of papers."""
    docs, i, n = S.table(spark, d, "documents"), F.col("doc_id"), F.col("n_chars")
    inner = F.concat(F.lit('{"sections":[{"paragraphs":'), n, F.lit("},1]}"))
    review = F.to_json(F.struct(F.concat(F.lit("r"), i).alias("review_id"), F.col("text").alias("review_text"), (n % 10).alias("rating_raw"), F.when(i % 5 == 0, F.col("source")).alias("notes"), F.when(i % 7 == 0, F.col("lang")).alias("Body_Text")))
    review = F.when(i % 11 == 0, F.concat(F.substring(review, F.lit(1), F.length(review) - 1), F.lit(',"meta":'), inner, F.lit("}"))).otherwise(review)
    reviews = docs.select((i - i % 4).alias("paper"), i.alias("doc_id"), review.alias("r"))
    in_order = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), ",")
    papers = reviews.groupBy("paper").agg(in_order("doc_id", "r").alias("reviews"))
    at = F.col("paper")
    head = F.to_json(F.struct(F.concat(F.lit("p"), at).alias("paper_id"), F.lit("V").alias("venue"), F.when(at % 3 == 0, F.concat(F.lit("x"), at)).when(at % 3 == 1, "").alias("pdf_url"), F.when(at % 8 == 0, 1).alias("score")))
    papers = papers.withColumn("p", F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"reviews":['), "reviews", F.lit("]}")))
    files = papers.groupBy(F.concat(F.lit("f"), F.floor(at / 64)).alias("file")).agg(F.concat(F.lit('{"papers":['), in_order("paper", "p"), F.lit('],"version":1}')).alias("json"))
    return audit.normalized_files(files)


@query(f"SELECT *, CASE WHEN {' OR '.join(m + ' > 0' for m in L.FORBIDDEN_MARKERS)} THEN 'failed' ELSE 'ok' END AS status FROM (SELECT lang AS file, count(*) AS request_count, {_MARKED} FROM (SELECT lang, text || CASE doc_id % 9 WHEN 1 THEN ' PDF_URL' WHEN 2 THEN ' body_text' ELSE '' END AS line FROM documents WHERE trim(text) <> '') GROUP BY lang)")
def request_audit(spark: SparkSession, d: str) -> DataFrame:
    """Request lines that name what they must not."""
    docs, i = S.table(spark, d, "documents"), F.col("doc_id")
    tail = F.when(i % 9 == 1, " PDF_URL").when(i % 9 == 2, " body_text").otherwise("")
    return audit.request_files(docs.where(F.trim("text") != "").select(F.col("lang").alias("file"), F.concat("text", tail).alias("line")))


@query("SELECT paper_id, count(*) AS tasks, count(*) FILTER (ok) AS imported, count(*) FILTER (NOT ok) AS failed FROM (SELECT doc_id - doc_id % 4 AS paper_id, coalesce(quality, 0) = 1 AS ok FROM documents LEFT JOIN labels USING (doc_id)) WHERE paper_id IN (SELECT doc_id - doc_id % 4 FROM labels) GROUP BY paper_id")
def import_results(spark: SparkSession, d: str) -> DataFrame:
    """Manifest tasks with their parsed results; missing or bad results count as failed, unknown papers are skipped."""
    docs = S.table(spark, d, "documents").select("doc_id", (F.col("doc_id") - F.col("doc_id") % 4).alias("paper_id"))
    payload = F.to_json(F.struct(F.col("quality").alias("score")))
    results = S.table(spark, d, "labels").select("doc_id", F.from_json(payload, "score int")["score"].alias("score"))
    papers = results.select((F.col("doc_id") - F.col("doc_id") % 4).alias("paper_id")).distinct()
    rows = docs.join(results, "doc_id", "left").join(papers, "paper_id", "left_semi")
    ok = F.coalesce(F.col("score") == 1, F.lit(False))
    return rows.groupBy("paper_id").agg(F.count(F.lit(1)).alias("tasks"), F.count_if(ok).alias("imported"), F.count_if(~ok).alias("failed"))


@query(S.sql("SELECT task_id, CASE WHEN j IS NULL THEN verdict WHEN j IN ('supported', 'insufficient', 'possibly_contradicted') THEN j ELSE 'needs_human_check' END AS final_verdict, CASE WHEN j IS NULL THEN 'llm-judge-failed' WHEN j NOT IN ('supported', 'insufficient', 'possibly_contradicted') THEN 'judge-verdict-invalid' ELSE '' END AS added_flag FROM (SELECT *, CASE WHEN paper_id NOT IN (SELECT 'p' || doc_id FROM labels) THEN NULL WHEN claim_index % 3 = 0 THEN 'supported' WHEN claim_index % 3 = 1 THEN 'insufficient' ELSE 'nonsense' END AS j FROM ruled)", "ruled"))
def apply_judgements(spark: SparkSession, d: str) -> DataFrame:
    """Judged rows over rule verdicts: valid enums replace them, missing judgements leave a failure flag."""
    verdicts = T.words_of(("supported", "partially_supported", "insufficient", "possibly_contradicted", "vague_or_not_checkable", "needs_human_check"))
    claims = S.claims(spark, d).select("task_id", "paper_id", "claim_index", F.element_at(verdicts, F.length("claim_text") % 6 + 1).alias("verdict"))
    at = F.col("claim_index") % 3
    judged = S.labelled(spark, d, claims).select("task_id", F.when(at == 0, "supported").when(at == 1, "insufficient").otherwise("nonsense").alias("j"))
    rows = claims.join(judged, "task_id", "left")
    valid = F.col("j").isin("supported", "insufficient", "possibly_contradicted")
    final = F.when(F.col("j").isNull(), F.col("verdict")).when(valid, F.col("j")).otherwise("needs_human_check")
    flag = F.when(F.col("j").isNull(), "llm-judge-failed").when(~valid, "judge-verdict-invalid").otherwise("")
    return rows.select("task_id", final.alias("final_verdict"), flag.alias("added_flag"))


_AUD = ("specificity", "auditability", "actionability", "tone")


@query(S.sql("SELECT review_id, count(*) AS claims, " + ", ".join(f"round(avg({k}), 4) AS mean_{k}" for k in _AUD) + ", CAST(round_even(round(avg(specificity) * 0.3::DOUBLE * 25 + avg(auditability) * 0.2::DOUBLE * 25 + avg(actionability) * 0.3::DOUBLE * 25 + avg(tone) * 0.2::DOUBLE * 25, 4), 0) AS INTEGER) AS score, array_to_string(list_sort(list_distinct(list(verdict))), ',') AS verdicts FROM ruled GROUP BY review_id", "ruled"))
def review_audit(spark: SparkSession, d: str) -> DataFrame:
    """Mean claim dimensions of each review, their weighted score and the union of verdicts."""
    rows = S.claims(spark, d)
    verdicts = T.words_of(("supported", "partially_supported", "insufficient", "possibly_contradicted", "vague_or_not_checkable", "needs_human_check"))
    rows = rows.withColumns(scoring.rule_scores(F.col("claim_text"), F.col("claim_type"))).withColumn("verdict", F.element_at(verdicts, F.length("claim_text") % 6 + 1))
    weights = dict(zip(_AUD, (0.3, 0.2, 0.3, 0.2), strict=True))
    total = sum((F.avg(k) * w * 25 for k, w in weights.items()), F.lit(0.0))
    return rows.groupBy("review_id").agg(F.count(F.lit(1)).alias("claims"), *(F.round(F.avg(k), 4).alias(f"mean_{k}") for k in _AUD), F.bround(F.round(total, 4), 0).cast("int").alias("score"), F.array_join(F.array_sort(F.collect_set("verdict")), ",").alias("verdicts"))


_NICK = ("Assumption Mapper", "Baseline Hunter", "Table Reader")
S.add_cte("card", "SELECT paper_id, review_id, turn, ['Assumption Mapper', 'Baseline Hunter', 'Table Reader'][count(*) % 3 + 1] AS nick, CAST(round_even(round(avg((specificity + actionability + tone) / 12.0::DOUBLE * 100), 4), 0) AS INTEGER) AS score FROM ruled GROUP BY ALL", "ruled")


@query(S.sql("SELECT paper_id, review_id, score, CASE WHEN k = 1 THEN nick ELSE nick || ' ' || ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X'][k] END AS nickname, CASE WHEN score >= 70 THEN 'high' WHEN score >= 45 THEN 'medium' ELSE 'low' END AS signal FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, nick ORDER BY turn) AS k FROM card)", "card"))
def public_scorecard(spark: SparkSession, d: str) -> DataFrame:
    """Reviewer score, signal and a nickname that is unique within the paper."""
    rows = S.claims(spark, d).withColumns(scoring.rule_scores(F.col("claim_text"), F.col("claim_type")))
    mean = F.avg((F.col("specificity") + F.col("actionability") + F.col("tone")) / 12.0 * 100)
    nick = F.element_at(T.words_of(_NICK), (F.count(F.lit(1)) % 3 + 1).cast("int"))
    cards = rows.groupBy("paper_id", "review_id", "turn").agg(nick.alias("nick"), F.bround(F.round(mean, 4), 0).cast("int").alias("score"))
    cards = cards.withColumn("k", F.row_number().over(Window.partitionBy("paper_id", "nick").orderBy("turn")))
    roman = T.words_of(("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"))
    name = F.when(F.col("k") == 1, F.col("nick")).otherwise(F.concat_ws(" ", "nick", F.element_at(roman, F.least("k", F.lit(10)))))
    signal = F.when(F.col("score") >= 70, "high").when(F.col("score") >= 45, "medium").otherwise("low")
    return cards.select("paper_id", "review_id", "score", name.alias("nickname"), signal.alias("signal"))
