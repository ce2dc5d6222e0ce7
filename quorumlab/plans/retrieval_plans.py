"""Queries over memory, evidence and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumlab.functions import lexicons as L
from quorumlab.functions import text as T
from quorumlab.operators import retrieval
from quorumlab.plans import standins as S
from quorumlab.plans.registry import query

S.add_cte("q_tok", f"SELECT query_id, list_distinct({S.d_token_list('query_text')}) AS qt FROM v_query", "v_query")
S.add_cte("m_tok", f"SELECT memory_id, ord, dimension, mapped_score, gold_label, list_distinct({S.d_token_list('input_text')}) AS mt FROM v_memory", "v_memory")
S.add_cte(
    "topk",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, dimension ORDER BY similarity DESC, mapped_score DESC, ord) AS rank FROM (
SELECT query_id, memory_id, ord, dimension, mapped_score, gold_label, round(c::DOUBLE / (len(qt) + len(mt) - c), 4) AS similarity FROM (SELECT *, len(list_intersect(qt, mt)) AS c FROM q_tok, m_tok WHERE len(qt) > 0))) WHERE rank <= 5""",
    "q_tok", "m_tok",
)


def _topk(spark: SparkSession, d: str) -> DataFrame:
    # labelled texts are tokenized once; the view, which repeats a text for each dimension, only carries the names of their sets
    documents = S.table(spark, d, "documents").join(S.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    texts = retrieval.token_sets(documents, "text", "doc_id", "source")
    memory = S.view(spark, d, "v_memory", documents=texts.select("doc_id", "source", F.col("set_id").alias("text")))
    return retrieval.memory_topk(S.view(spark, d, "v_query"), memory.withColumnRenamed("input_text", "set_id"), sets=texts)


@query(S.sql("SELECT query_id, dimension, rank, memory_id, similarity FROM topk", "topk"))
def memory_topk(spark: SparkSession, d: str) -> DataFrame:
    return _topk(spark, d).select("query_id", "dimension", F.col("rank").cast("bigint").alias("rank"), "memory_id", "similarity")


S.add_cte("prior", f"SELECT query_id, dimension, round(CASE WHEN sum(similarity) > 0 THEN sum(mapped_score * similarity) / sum(similarity) ELSE avg(mapped_score) END, 3) AS prior, count(*) AS examples, {S.d_mean4('similarity')} AS mean_similarity FROM topk GROUP BY ALL", "topk")


@query(S.sql("SELECT * FROM prior", "prior"))
def memory_prior(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.memory_prior(_topk(spark, d))


@query(S.sql("SELECT query_id, dimension, CASE WHEN m IS NULL THEN 'memory_prior' ELSE 'hybrid' END AS source, round(CASE WHEN m IS NULL THEN prior ELSE 0.6::DOUBLE * m + 0.4::DOUBLE * prior END, 3) AS final FROM (SELECT *, CASE WHEN query_id % 3 = 0 THEN NULL ELSE (query_id % 10) / 10.0::DOUBLE END AS m FROM prior)", "prior"))
def hybrid_score(spark: SparkSession, d: str) -> DataFrame:
    rows = retrieval.memory_prior(_topk(spark, d))
    model = F.when(F.col("query_id") % 3 != 0, (F.col("query_id") % 10) / 10.0)
    final, source = retrieval.hybrid(model, F.col("prior"))
    return rows.select("query_id", "dimension", source.alias("source"), final.alias("final"))


@query(S.sql("SELECT memory_id, dimension, gold_label, mapped_score, len(list_distinct(mt)) AS n_tokens FROM m_tok WHERE len(mt) > 0", "m_tok"))
def build_memory(spark: SparkSession, d: str) -> DataFrame:
    """Memory rows with their token sets; records without text or label are dropped."""
    rows = S.view(spark, d, "v_memory").where("gold_label is not null")
    rows = rows.withColumn("tokens", F.array_distinct(T.token_list("input_text"))).where(F.size("tokens") > 0)
    return rows.select("memory_id", "dimension", "gold_label", "mapped_score", F.size("tokens").cast("bigint").alias("n_tokens"))


_SECTIONS = """SELECT paper_id, review_id AS section_id, CASE n_chars % 4 WHEN 0 THEN 'Title' WHEN 1 THEN 'Experiments and results' WHEN 2 THEN 'Method' ELSE 'Appendix A' END AS section,
  CASE WHEN n_chars % 4 = 3 THEN 'appendix' WHEN n_chars % 5 = 0 THEN 'rebuttal' ELSE 'paper' END AS source_type, review_text AS text FROM v_review"""
S.add_cte("sections", _SECTIONS, "v_review")
_CLAIMED = """SELECT concat('k', doc_id) AS task_id, concat('p', doc_id - (doc_id % 4)) AS paper_id, text AS claim_text,
  {kinds}[doc_id % 10 + 1] AS claim_type FROM documents""".format(kinds=S._list(L.CLAIM_TYPES))
S.add_cte("section_claims", _CLAIMED)


def _sections(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    return S.view(spark, d, "v_review").select(
        "paper_id",
        F.col("review_id").alias("section_id"),
        F.when(n % 4 == 0, "Title").when(n % 4 == 1, "Experiments and results").when(n % 4 == 2, "Method").otherwise("Appendix A").alias("section"),
        F.when(n % 4 == 3, "appendix").when(n % 5 == 0, "rebuttal").otherwise("paper").alias("source_type"),
        F.col("review_text").alias("text"),
    )


def _section_claims(spark: SparkSession, d: str) -> DataFrame:
    """Every review is a claim; the reviews of its paper are the sections."""
    docs = S.table(spark, d, "documents")
    return docs.select(
        F.concat(F.lit("k"), "doc_id").alias("task_id"),
        F.concat(F.lit("p"), F.col("doc_id") - F.col("doc_id") % 4).alias("paper_id"),
        F.col("text").alias("claim_text"),
        F.element_at(T.words_of(L.CLAIM_TYPES), (F.col("doc_id") % 10 + 1).cast("int")).alias("claim_type"),
    )


def _hint(kind: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {S._list(v)}" for k, v in L.CLAIM_HINTS.items())
    return f"CASE {kind} {cases} ELSE [] END"


_EXPAND = "CASE t " + " ".join(f"WHEN '{k}' THEN {S._list(v)}" for k, v in L.QUERY_EXPANSIONS.items()) + " ELSE [] END"
_LOWSEC = "lower(section)"


def _has(words) -> str:
    return f"len(list_filter({S._list(words)}, lambda w: contains({_LOWSEC}, w))) > 0"


_HINTED = " OR ".join(f"(claim_type = '{k}' AND {_has(v)})" for k, v in L.CLAIM_HINTS.items())
_WEIGHT = f"""CASE WHEN {_LOWSEC} = 'title' THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN source_type = 'rebuttal' THEN 1.08::DOUBLE ELSE 1.0::DOUBLE END
  * CASE WHEN source_type = 'appendix' OR contains({_LOWSEC}, 'appendix') THEN 1.12::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN {_HINTED} THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END
  * CASE WHEN claim_type IN ('ablation', 'baseline', 'experiment') AND {_has(("experiment", "result", "evaluation", "table", "appendix"))} THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END
  * CASE WHEN claim_type = 'methodology' AND {_has(("method", "model", "approach", "algorithm"))} THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END"""
_W = "ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.4::DOUBLE / (tf + 1.4::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / greatest(mean_length, 1.0::DOUBLE)))"
S.add_cte("sec_tok", f"SELECT *, {S.d_token_list(chr(115) + 'ection || chr(32) || section || chr(32) || text')} AS tk FROM sections", "sections")
S.add_cte(
    "evidence",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, section_id) AS rank FROM (SELECT *, round(weighted / (weighted + 3.0::DOUBLE), 3) AS score FROM (
SELECT *, raw * ({_WEIGHT}) * (0.75::DOUBLE + 0.25::DOUBLE * matched / n_terms) AS weighted FROM (
SELECT task_id, claim_type, n_terms, section_id, section, source_type, round(sum({_W}), 6) AS raw, count(*) AS matched
FROM (SELECT *, len(terms) AS n_terms, unnest(terms) AS term FROM (SELECT task_id, paper_id, claim_type, list_distinct(list_concat(b, flatten(list_transform(b, lambda t: {_EXPAND})))) AS terms
  FROM (SELECT *, list_distinct(list_concat({S.d_token_list("claim_text")}, {_hint("claim_type")})) AS b FROM section_claims))) q
JOIN (SELECT *, count(*) OVER (PARTITION BY paper_id, term) AS df FROM (SELECT paper_id, section_id, section, source_type, term, length, count(*) AS tf FROM (SELECT paper_id, section_id, section, source_type, len(tk) AS length, unnest(tk) AS term FROM sec_tok) GROUP BY ALL)) t USING (paper_id, term)
JOIN (SELECT paper_id, count(*) AS n_docs, avg(len(tk)) AS mean_length FROM sec_tok GROUP BY paper_id) USING (paper_id)
GROUP BY ALL)))) WHERE rank <= 3""",
    "sec_tok", "section_claims",
)


@query(S.sql("SELECT task_id, rank, section_id, score, CASE WHEN score >= 0.45 THEN 'supporting_candidate' ELSE 'partial_candidate' END AS verdict, matched FROM evidence", "evidence"))
def bm25_evidence(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.bm25_evidence(_section_claims(spark, d), _sections(spark, d))
    return found.select("task_id", F.col("rank").cast("bigint").alias("rank"), "section_id", "score", "verdict", "matched")


@query(S.sql("SELECT paper_id, section_id, source_type, section FROM sections WHERE trim(text) <> '' UNION ALL SELECT paper_id, section_id || ':title', 'title', 'Title' FROM sections WHERE section = 'Title'", "sections"))
def evidence_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = _sections(spark, d)
    named = ("paper_id", "section_id", "source_type", "section")
    titles = rows.where("section = 'Title'").select("paper_id", F.concat("section_id", F.lit(":title")).alias("section_id"), F.lit("title").alias("source_type"), "section")
    return rows.where(F.trim("text") != "").select(*named).unionByName(titles)


@query(S.sql(f"SELECT c.task_id, CASE WHEN c.claim_type IN ('novelty', 'theory') THEN 'needs_human_check' WHEN score IS NULL THEN 'insufficient' WHEN len(list_filter({S._list(L.ABSENCE_WORDS)}, lambda w: contains(lower(claim_text), w))) > 0 AND section <> 'title' AND score >= 0.35 AND matched >= 2 THEN 'possibly_contradicted' WHEN score >= 0.62 THEN 'supported' WHEN score >= 0.35 THEN 'partially_supported' ELSE 'insufficient' END AS verdict FROM section_claims c LEFT JOIN (SELECT * FROM evidence WHERE rank = 1) e USING (task_id)", "evidence", "section_claims"))
def evidence_verdict(spark: SparkSession, d: str) -> DataFrame:
    claims = _section_claims(spark, d)
    return retrieval.evidence_verdict(claims, retrieval.bm25_evidence(claims, _sections(spark, d)))


_CASES = "SELECT task_id AS case_id, paper_id, claim_type, claim_text AS text, CASE meta_label WHEN 'survived' THEN 'strong' ELSE 'weak' END AS label FROM claims JOIN claim_labels USING (task_id)"
S.add_cte("cases", f"SELECT *, {S.d_token_list('text')} AS tk FROM ({_CASES})", "claims", "claim_labels")
S.add_cte("case_tf", "SELECT case_id, paper_id, term, length, count(*) AS tf FROM (SELECT case_id, paper_id, len(tk) AS length, unnest(tk) AS term FROM cases) GROUP BY ALL", "cases")
S.add_cte(
    "case_found",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) AS rank FROM (
SELECT r.query_id, r.case_id, c.label, q.label AS query_label, round(raw + CASE WHEN c.claim_type = q.claim_type THEN 0.18::DOUBLE ELSE 0 END, 4) AS score FROM (
SELECT q.case_id AS query_id, t.case_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * t.tf * 2.4::DOUBLE / (t.tf + 1.4::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * t.length / greatest(mean_length, 1.0::DOUBLE)))) AS raw
FROM (SELECT a.case_id, a.paper_id, a.term, g.df - o.df AS df, (SELECT count(*) FROM cases) - p.n AS n, ((SELECT sum(len(tk)) FROM cases) - p.len)::DOUBLE / greatest((SELECT count(*) FROM cases) - p.n, 1) AS mean_length
  FROM case_tf a JOIN (SELECT term, count(*) AS df FROM case_tf GROUP BY term) g USING (term) JOIN (SELECT term, paper_id, count(*) AS df FROM case_tf GROUP BY ALL) o USING (term, paper_id)
  JOIN (SELECT paper_id, count(*) AS n, sum(len(tk)) AS len FROM cases GROUP BY paper_id) p USING (paper_id)) q
JOIN case_tf t ON t.term = q.term AND t.paper_id <> q.paper_id WHERE q.df > 0 GROUP BY ALL) r JOIN cases c ON c.case_id = r.case_id JOIN cases q ON q.case_id = r.query_id)) WHERE rank <= 5""",
    "cases", "case_tf",
)


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """Every labelled claim, whole, with its label."""
    rows = S.claims(spark, d).join(S.claim_labels(spark, d).select("task_id", "meta_label"), "task_id")
    label = F.when(F.col("meta_label") == "survived", "strong").otherwise("weak")
    return rows.select(F.col("task_id").alias("case_id"), "paper_id", "claim_type", F.col("claim_text").alias("text"), label.alias("label"))


@query(S.sql("SELECT query_id, rank, case_id, score FROM case_found", "case_found"))
def case_retrieval(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.case_retrieval(_cases(spark, d)).select("query_id", F.col("rank").cast("bigint").alias("rank"), "case_id", "score")


_FACTORIAL = "list_product(list_transform(range(0, least({k}, n)), lambda i: greatest(n - p - i, 0)::DOUBLE)) / list_product(list_transform(range(0, least({k}, n)), lambda i: (n - i)::DOUBLE))"
_RANDOM = ", ".join(f"round(avg(CASE WHEN n <= 0 OR p <= 0 THEN 0 ELSE 1 - {_FACTORIAL.format(k=k)} END), 4) AS random_{k}" for k in (1, 3, 5))


@query(
    S.sql(
        """SELECT * FROM (SELECT query_label, count(*) AS queries, """
        + ", ".join(f"round(count(*) FILTER (first <= {k})::DOUBLE / count(*), 4) AS hit_{k}" for k in (1, 3, 5))
        + ", round(avg(coalesce(round(1.0::DOUBLE / first, 4), 0)), 3) AS mrr, "
        + ", ".join(f"round(count(*) FILTER (major_{k} = query_label)::DOUBLE / count(*), 4) AS majority_accuracy_{k}" for k in (1, 3, 5))
        + " FROM (SELECT query_id, query_label, min(rank) FILTER (label = query_label) AS first FROM case_found GROUP BY ALL) JOIN (SELECT query_id, "
        + ", ".join(f"first(label ORDER BY n{k} DESC, met) AS major_{k}" for k in (1, 3, 5))
        + " FROM (SELECT query_id, label, "
        + ", ".join(f"count(*) FILTER (rank <= {k}) AS n{k}" for k in (1, 3, 5))
        + f""", min(rank) AS met FROM case_found GROUP BY ALL) GROUP BY query_id) USING (query_id) GROUP BY query_label)
JOIN (SELECT label AS query_label, {_RANDOM} FROM (SELECT q.label, (SELECT count(*) FROM cases c WHERE c.paper_id <> q.paper_id) AS n, (SELECT count(*) FROM cases c WHERE c.paper_id <> q.paper_id AND c.label = q.label) AS p FROM cases q) GROUP BY label) USING (query_label),
(SELECT round(max(n)::DOUBLE / sum(n), 4) AS majority_baseline FROM (SELECT label, count(*) AS n FROM cases GROUP BY label))""",
        "case_found",
        "cases",
    )
)
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    cases = _cases(spark, d)
    return retrieval.retrieval_metrics(retrieval.case_retrieval(cases), cases)


@query(S.sql(f"SELECT task_id, record_id, grade, rank FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY grade DESC, record_id) AS rank FROM (SELECT task_id, s.section_id AS record_id, round(10 * len(list_intersect({S.d_plain_tokens('claim_text')}, {S.d_plain_tokens('text')})) + least(length(text) % 90, 50) / 10.0::DOUBLE, 4) AS grade, len(list_intersect({S.d_plain_tokens('claim_text')}, {S.d_plain_tokens('text')})) AS overlap FROM section_claims c JOIN sections s USING (paper_id)) WHERE overlap > 0) WHERE rank <= 3", "section_claims", "sections"))
def grade_external(spark: SparkSession, d: str) -> DataFrame:
    records = _sections(spark, d).select("paper_id", F.col("section_id").alias("record_id"), (F.length("text") % 90).alias("citations"), "text")
    return retrieval.graded(_section_claims(spark, d), records).select("task_id", "record_id", "grade", F.col("rank").cast("bigint").alias("rank"))


@query(S.sql("SELECT task_id, n, claim_type || ' ' || left(claim_text, 60) AS search FROM (SELECT *, count(*) OVER (PARTITION BY review_id ORDER BY claim_index) AS n FROM claims WHERE claim_type IN ('novelty', 'baseline', 'theory')) WHERE n <= 5", "claims"))
def plan_queries(spark: SparkSession, d: str) -> DataFrame:
    """The first five claims of a review that need outside evidence, with a search string."""
    rows = S.claims(spark, d).where(F.col("claim_type").isin("novelty", "baseline", "theory"))
    running = F.sum(F.lit(1)).over(Window.partitionBy("review_id").orderBy("claim_index").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("n", running).where("n <= 5").select("task_id", "n", F.concat_ws(" ", "claim_type", F.left("claim_text", F.lit(60))).alias("search"))


@query(S.sql("SELECT task_id, paper_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY CASE importance WHEN 'major' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, length(claim_text) DESC, task_id) AS rn FROM claims) WHERE rn <= 5", "claims"))
def top_claims_per_paper(spark: SparkSession, d: str) -> DataFrame:
    priority = F.when(F.col("importance") == "major", 0).when(F.col("importance") == "medium", 1).otherwise(2)
    order = Window.partitionBy("paper_id").orderBy(priority, F.length("claim_text").desc(), "task_id")
    return S.claims(spark, d).withColumn("rn", F.row_number().over(order).cast("bigint")).where("rn <= 5").select("task_id", "paper_id", "rn")
