"""Queries of claim extraction, validation, grounding and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumlab.functions import lexicons as L
from quorumlab.functions import text as T
from quorumlab.operators import claims as C
from quorumlab.operators import lifecycle, matching
from quorumlab.plans import lifecycle_plans, retrieval_plans, text_plans  # noqa: F401  (their stand-ins)
from quorumlab.plans import standins as S
from quorumlab.plans.registry import query


def _d_claim(x: str) -> str:
    return S.d_strip(f"regexp_replace({S.d_clean_ws(x)}, '(?i)^(weaknesses?|questions?|concerns?|comments?) *[:=-] *', '')")


_MARKED = "regexp_replace({}, '([.!?]) ([A-Z(])', '\\1' || chr(1) || '\\2', 'g')"
S.add_cte(
    "pieces",
    f"SELECT doc_id, i, {_d_claim('x[i]')} AS claim FROM (SELECT doc_id, flatten(list_transform(string_split_regex(coalesce(text, ''), '\\n{{2,}}'), lambda b: string_split({_MARKED.format(_d_claim('b'))}, chr(1)))) AS x FROM documents), unnest(range(1, len(x) + 1)) AS t(i)",
)
S.add_cte(
    "ruled_claims",
    f"SELECT doc_id, claim, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS claim_index FROM (SELECT doc_id, min(i) AS i, first(claim ORDER BY i) AS claim FROM pieces WHERE length(claim) >= 24 AND (suffix(claim, '?') OR len(list_filter({S._list(L.CLAIM_MARKERS)}, lambda w: contains(lower(claim), w))) > 0) GROUP BY doc_id, trim(regexp_replace(lower(claim), '[^a-z0-9_]+', ' ', 'g')))",
    "pieces",
)


@query(S.sql(f"SELECT doc_id AS review_id, claim_index, claim FROM ruled_claims WHERE claim_index < 8 UNION ALL SELECT doc_id, 0, left({_d_claim('text')}, 600) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ruled_claims) AND {S.d_clean_ws('text')} <> ''", "ruled_claims"))
def extract_claims_rule(spark: SparkSession, d: str) -> DataFrame:
    found = C.extracted(S.table(spark, d, "documents").select(F.col("doc_id").alias("review_id"), "text"))
    return found.select("review_id", F.col("claim_index").cast("bigint").alias("claim_index"), "claim")


S.add_cte("candidates", f"SELECT task_id, review_id, claim_text, 'review_text' AS source_field, CASE claim_index % 4 WHEN 0 THEN replace(left(claim_text, 30), ' ', '  ') WHEN 1 THEN claim_text WHEN 2 THEN left(claim_text, 20) || ' zz' ELSE '' END AS quote, CASE WHEN claim_index % 3 = 0 THEN 'odd' ELSE claim_type END AS claim_type, CASE WHEN claim_index % 5 = 0 THEN 'odd' ELSE importance END AS importance, text AS field_text FROM claims JOIN (SELECT reply_id AS review_id, text FROM v_reply) USING (review_id)", "claims", "v_reply")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    at, text = F.col("claim_index"), F.col("claim_text")
    quote = F.when(at % 4 == 0, F.replace(F.left(text, F.lit(30)), F.lit(" "), F.lit("  "))).when(at % 4 == 1, text).when(at % 4 == 2, F.concat(F.left(text, F.lit(20)), F.lit(" zz"))).otherwise("")
    rows = S.claims(spark, d).withColumns({"quote": quote, "source_field": F.lit("review_text"), "claim_type": F.when(at % 3 == 0, "odd").otherwise(F.col("claim_type")), "importance": F.when(at % 5 == 0, "odd").otherwise(F.col("importance"))})
    reviews = S.view(spark, d, "v_reply").select(F.col("reply_id").alias("review_id"), F.col("text").alias("field_text"))
    return rows.join(reviews, "review_id")


_FOLD = lambda x: f"lower({S.d_clean_ws(x)})"
_TAILS = ("", " (implied)", " It should compare.", " rating of 5", " This is terrible.", " Why is it?", " A weak reject is given.", " source sentence", " (inferred from context).", " Fine.")
_KINDS, _WEIGHTS, _NAMED = (*L.AUDITED_TYPES, "odd"), (*L.AUDITED_WEIGHTS, "odd"), ("review_text", "weaknesses", "summary", "other")
S.add_cte(
    "proposed",
    f"""SELECT task_id, review_id, claim_text || {S._list(_TAILS)}[n % 10 + 1] AS claim_text, {S._list(_NAMED)}[n % 4 + 1] AS source_field, {S._list(_KINDS)}[n % 12 + 1] AS claim_type, {S._list(_WEIGHTS)}[n % 6 + 1] AS importance,
CASE n % 5 WHEN 0 THEN replace(left(claim_text, 30), ' ', '  ') WHEN 1 THEN claim_text WHEN 2 THEN left(claim_text, 20) || ' zz' WHEN 3 THEN '' ELSE left(claim_text, 25) END AS quote
FROM (SELECT *, length(claim_text) AS n FROM claims)""",
    "claims",
)
S.add_cte("quotable", "SELECT reply_id AS review_id, text AS review_text, 'Weaknesses: ' || text AS weaknesses, '' AS summary FROM v_reply", "v_reply")


def _d_phrase(x: str, words) -> str:
    listed = "|".join(words).replace("'", "''")
    return rf"regexp_matches({x}, '(^|[^\p{{L}}\p{{N}}_])({listed})($|[^\p{{L}}\p{{N}}_])')"


def _d_meta(x: str) -> str:
    return f"(len(list_filter({S._list(L.META_CUES)}, lambda w: contains({x}, w))) > 0 OR regexp_matches({x}, '\\brating of\\s+[0-9]'))"


def _d_question(x: str) -> str:
    low = f"lower({S.d_clean_ws(x)})"
    return f"(suffix({low}, '?') OR (split_part({low}, ' ', 1) IN ({S._in(L.QUESTION_STARTERS)}) AND contains({x}, '?')))"


_BOTH = f"{_FOLD('claim')} || ' ' || {_FOLD('sentence')}"
_LABEL, _ASIDE = r"(?i)^\s*(summary|strengths|weaknesses|questions|rating|confidence)\s*:\s*", r"(?i)\s*\((implied|implicit|inferred)[^)]*\)\.?\s*\z"
S.add_cte(
    "quoted",
    f"""SELECT task_id, {S.d_clean("claim_text")} AS claim, {S.d_clean("quote")} AS sentence, replace(claim_type, 'odd', 'general') AS kind, replace(importance, 'odd', 'medium') AS weight,
{S.d_clean("CASE source_field WHEN 'review_text' THEN review_text WHEN 'weaknesses' THEN weaknesses ELSE summary END")} AS field
FROM proposed JOIN quotable USING (review_id) WHERE source_field <> 'other'""",
    "proposed",
    "quotable",
)
S.add_cte("held", f"SELECT *, {S.d_strip(f"regexp_replace(sentence, '{_LABEL}', '')")} AS plain FROM quoted WHERE claim <> '' AND sentence <> '' AND field <> '' AND contains({_FOLD('field')}, {_FOLD('sentence')})", "quoted")
S.add_cte(
    "mended",
    f"SELECT task_id, sentence, kind, weight, {S.d_strip(f"regexp_replace(CASE WHEN NOT {_d_meta(_FOLD('claim'))} THEN claim WHEN NOT {_d_meta(_FOLD('plain'))} THEN plain ELSE '' END, '{_ASIDE}', '')")} AS claim FROM held",
    "held",
)


@query(
    S.sql(
        f"""SELECT task_id, kind AS claim_type, weight AS importance, md5(claim) AS digest FROM mended WHERE claim <> '' AND ({_d_phrase(_BOTH, L.TONE_CUES)}
OR (kind <> 'tone' AND weight <> 'tone-only' AND ({_d_question("claim")} OR {_d_question("sentence")} OR weight = 'question'
OR ({_d_phrase(_BOTH, L.SCORE_CUES)} AND {_d_phrase(_BOTH, L.REASON_CUES)}) OR {_d_phrase(_BOTH, L.LIMITATION_CUES)} OR {_d_phrase(_BOTH, L.REQUEST_CUES)})))""",
        "mended",
    )
)
def validate_claims(spark: SparkSession, d: str) -> DataFrame:
    text, n = F.col("claim_text"), F.length("claim_text")
    pick = lambda values: F.element_at(T.words_of(values), n % len(values) + 1)
    quote = F.when(n % 5 == 0, F.replace(F.left(text, F.lit(30)), F.lit(" "), F.lit("  "))).when(n % 5 == 1, text)
    quote = quote.when(n % 5 == 2, F.concat(F.left(text, F.lit(20)), F.lit(" zz"))).when(n % 5 == 3, "").otherwise(F.left(text, F.lit(25)))
    rows = S.claims(spark, d).select(
        "task_id", "review_id", F.concat(text, pick(_TAILS)).alias("claim_text"), pick(_NAMED).alias("source_field"),
        pick(_KINDS).alias("claim_type"), pick(_WEIGHTS).alias("importance"), quote.alias("source_sentence"),
    )
    fields = [F.col("text").alias("review_text"), F.concat(F.lit("Weaknesses: "), "text").alias("weaknesses"), F.lit("").alias("summary")]
    reviews = S.view(spark, d, "v_reply").select(F.col("reply_id").alias("review_id"), *fields)
    return C.validated(rows, reviews).select("task_id", "claim_type", "importance", F.md5(F.col("claim_text").cast("binary")).alias("digest"))


S.add_cte(
    "grounding",
    f"""SELECT task_id, exact, exact OR loose AS matched, overlap, list_filter([CASE WHEN {S.d_clean_ws("quote")} = '' THEN 'missing_source_sentence' END, CASE WHEN NOT (exact OR loose) THEN 'source_not_found' END, CASE WHEN overlap < 0.18 AND n >= 4 THEN 'low_token_overlap' END], lambda x: x IS NOT NULL) AS reasons
FROM (SELECT *, contains(field_text, quote) AS exact, contains({_FOLD("field_text")}, {_FOLD("quote")}) AS loose, len(ct) AS n, CASE WHEN len(ct) > 0 THEN round(len(list_intersect(ct, qt))::DOUBLE / len(ct), 4) ELSE 0 END AS overlap FROM (SELECT *, {S.d_plain_tokens("claim_text")} AS ct, {S.d_plain_tokens("quote")} AS qt FROM candidates))""",
    "candidates",
)


@query(S.sql("SELECT task_id, exact, matched, overlap, array_to_string(reasons, '|') AS reasons FROM grounding", "grounding"))
def grounding_checks(spark: SparkSession, d: str) -> DataFrame:
    return C.grounded(_candidates(spark, d)).select("task_id", "exact", "matched", "overlap", F.array_join("reasons", "|").alias("reasons"))


@query(S.sql("SELECT CASE WHEN len(reasons) = 0 THEN 'none' ELSE unnest_reason END AS reason, count(*) AS n FROM (SELECT reasons, unnest(CASE WHEN len(reasons) = 0 THEN ['none'] ELSE reasons END) AS unnest_reason FROM grounding) GROUP BY 1 UNION ALL SELECT CASE WHEN count(*) FILTER (matched)::DOUBLE / count(*) >= 0.95 THEN 'status:pass' ELSE 'status:fail' END, count(*) FILTER (matched) FROM grounding", "grounding"))
def grounding_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each failure reason, and the status against the target rate."""
    rows = C.grounded(_candidates(spark, d))
    reasons = rows.select(F.explode(F.when(F.size("reasons") == 0, F.array(F.lit("none"))).otherwise(F.col("reasons"))).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    status = rows.agg(F.count_if("matched").alias("n"), F.count(F.lit(1)).alias("all")).select(F.when(F.col("n") / F.col("all") >= 0.95, "status:pass").otherwise("status:fail").alias("reason"), "n")
    return reasons.unionByName(status)


_SAME = "CASE {t} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in L.DEDUPE_SYNONYMS.items()) + " ELSE {t} END"
_CUT = "CASE WHEN suffix(t, 'ing') AND length(t) > 5 THEN left(t, length(t) - 3) WHEN suffix(t, 'ed') AND length(t) > 4 THEN left(t, length(t) - 2) WHEN suffix(t, 's') AND length(t) > 4 THEN left(t, length(t) - 1) ELSE t END"


def _d_dedupe_tokens(x: str) -> str:
    words = f"regexp_extract_all(regexp_replace(lower({S.d_clean_ws(S.d_clean(x))}), '{L.FIELD_LABEL}', ' ', 'g'), '[a-z0-9]+')"
    for step in (_SAME.format(t="t"), _CUT, _SAME.format(t="t")):
        words = f"list_transform({words}, lambda t: {step})"
    return f"list_distinct(list_filter({words}, lambda t: t NOT IN ({S._in((*L.DEDUPE_STOPWORDS, *L.DEDUPE_ACTION_WORDS))})))"


#: The stand-in claims with each third one repeated in other words and joined with the one before it.
_VARIED = "CASE claim_index % 3 WHEN 1 THEN 'Weaknesses: ' || before_text || ' should' WHEN 2 THEN claim_text || ' ' || before_text ELSE claim_text END"
S.add_cte("varied", f"SELECT review_id, claim_index, {_VARIED} AS claim_text FROM (SELECT *, coalesce(lag(claim_text) OVER (PARTITION BY review_id ORDER BY claim_index), '') AS before_text FROM claims)", "claims")
S.add_cte("numbered", f"SELECT review_id, claim_index, claim_text, {_d_dedupe_tokens('claim_text')} AS tk, row_number() OVER (PARTITION BY review_id ORDER BY claim_index) AS rn FROM varied", "varied")
S.add_cte("greedy", """SELECT * FROM (WITH RECURSIVE walk AS (
  SELECT review_id, 0::BIGINT AS rn, []::STRUCT(i BIGINT, tk VARCHAR[])[] AS kept FROM (SELECT DISTINCT review_id FROM numbered)
  UNION ALL
  SELECT w.review_id, n.rn, CASE WHEN len(list_filter(w.kept, lambda k: len(list_intersect(k.tk, n.tk)) > 0 AND len(list_intersect(k.tk, n.tk)) >= 0.8::DOUBLE * least(len(k.tk), len(n.tk))
      AND len(list_intersect(k.tk, n.tk)) >= 0.6::DOUBLE * greatest(len(k.tk), len(n.tk)))) > 0 THEN w.kept ELSE list_append(w.kept, {'i': CAST(n.claim_index AS BIGINT), 'tk': n.tk}) END
  FROM walk w JOIN numbered n ON n.review_id = w.review_id AND n.rn = w.rn + 1)
SELECT review_id, arg_max(kept, rn)[1:8] AS kept FROM walk GROUP BY review_id)""", "numbered")
S.add_cte("whole_claims", """SELECT review_id, list_filter(kept, lambda x: NOT (len(x.tk) >= 5
  AND len(list_filter(kept, lambda k: k.i <> x.i AND len(list_intersect(x.tk, k.tk)) > 0 AND len(list_intersect(x.tk, k.tk)) >= 0.55::DOUBLE * least(len(x.tk), len(k.tk)))) >= 2
  AND len(list_distinct(flatten(list_transform(list_filter(kept, lambda k: k.i <> x.i AND len(list_intersect(x.tk, k.tk)) > 0 AND len(list_intersect(x.tk, k.tk)) >= 0.55::DOUBLE * least(len(x.tk), len(k.tk))), lambda k: list_intersect(x.tk, k.tk))))) >= 0.75::DOUBLE * len(x.tk))) AS kept FROM greedy""", "greedy")


@query(S.sql("SELECT review_id, claim_index, claim_text FROM (SELECT review_id, unnest(list_filter(kept, lambda x: NOT (len(x.tk) >= 2 AND len(list_filter(kept, lambda k: len(k.tk) > len(x.tk) AND len(list_intersect(x.tk, k.tk)) >= 0.85::DOUBLE * len(x.tk))) > 0))).i AS claim_index FROM whole_claims) JOIN varied USING (review_id, claim_index)", "whole_claims", "varied"))
def dedupe_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims, some of them restated or joined, without their duplicates."""
    before = F.coalesce(F.lag("claim_text").over(Window.partitionBy("review_id").orderBy("claim_index")), F.lit(""))
    at, text = F.col("claim_index") % 3, F.col("claim_text")
    rows = S.claims(spark, d).select("review_id", "claim_index", "claim_text", before.alias("before_text"))
    varied = F.when(at == 1, F.concat(F.lit("Weaknesses: "), "before_text", F.lit(" should"))).when(at == 2, F.concat_ws(" ", text, "before_text")).otherwise(text)
    found = C.deduplicated(rows.select("review_id", "claim_index", varied.alias("claim_text")))
    return found.select("review_id", F.col("claim_index").cast("bigint").alias("claim_index"), "claim_text")


_WORDS_OF = "array_to_string(list_transform(string_split_regex(q, '[ \\t\\n\\r\\f]+'), lambda w: regexp_escape(w)), '\\s+')"
_LINES = "length(left(t, {x})) - length(replace(left(t, {x}), chr(10), ''))"
#: Fields with bullets, paragraphs and several sentences around the claims' own texts.
_MARKED_UP = """'- A first point. It has two sentences.' || chr(10) || '2) ' || text || chr(10) || chr(10) || 'Plain words &amp; more.' || chr(10) || '* last: ' || text"""
S.add_cte("marked_up", f"SELECT task_id, {S.d_clean(_MARKED_UP.replace('text', 'field_text'))} AS t, {S.d_clean('quote')} AS q FROM candidates", "candidates")
_BULLET = "regexp_matches(x, '^\\s*([-*+]\\s+|[0-9]+[.)]\\s+)')"
S.add_cte(
    "spans",
    f"""SELECT *, CASE WHEN start >= 0 THEN CAST({_LINES.format(x="start")} AS INTEGER) END AS line_start, CASE WHEN start >= 0 THEN CAST({_LINES.format(x="start + n")} AS INTEGER) END AS line_end, string_split(t, chr(10)) AS ls,
  list_filter(string_split(regexp_replace(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: {S.d_clean_ws("x")} <> '') AS ss
FROM (SELECT *, CASE WHEN q <> '' AND contains(t, q) THEN instr(t, q) - 1 WHEN q <> '' AND loose <> '' THEN instr(t, loose) - 1 ELSE -1 END AS start,
  CASE WHEN contains(t, q) THEN length(q) ELSE length(loose) END AS n, CASE WHEN q <> '' AND contains(t, q) THEN 'exact' WHEN q <> '' AND loose <> '' THEN 'normalized' ELSE 'none' END AS strategy
FROM (SELECT *, CASE WHEN q <> '' THEN regexp_extract(t, '(?i)' || {_WORDS_OF}) ELSE '' END AS loose FROM marked_up))""",
    "marked_up",
)


@query(
    S.sql(
        f"""SELECT task_id, CAST(start AS INTEGER) AS start, CAST(CASE WHEN start < 0 THEN -1 ELSE start + n END AS INTEGER) AS stop, strategy, line_start, line_end,
  CASE WHEN start >= 0 THEN CAST(len(regexp_extract_all(left(t, start), '\\n[ \\t]*\\n')) AS INTEGER) END AS paragraph,
  CASE WHEN len(list_filter(ls[line_start + 1:line_end + 1], lambda x: {_BULLET})) > 0 THEN CAST(len(list_filter(ls[1:line_start], lambda x: {_BULLET})) AS INTEGER) END AS bullet,
  CAST(nullif(coalesce(list_position(list_transform(ss, lambda x: contains(lower({S.d_clean_ws("x")}), lower({S.d_clean_ws("q")}))), true), 0), 0) - 1 AS INTEGER) AS sentence FROM spans""",
        "spans",
    )
)
def locate_source(spark: SparkSession, d: str) -> DataFrame:
    parts = ("- A first point. It has two sentences.\n2) ", "\n\nPlain words &amp; more.\n* last: ")
    text = F.concat(F.lit(parts[0]), "field_text", F.lit(parts[1]), "field_text")
    rows = _candidates(spark, d).select("task_id", text.alias("field_text"), "quote")
    return C.located(rows).select("task_id", "start", "stop", "strategy", "line_start", "line_end", "paragraph", "bullet", "sentence")


#: Pages get headings: some open a section, some repeat the open one.
_PAGED = "array_to_string([['Abstract', '1 Introduction to It', 'References', 'Appendix', 'no heading'][page_id % 5 + 1], {text}, 'B.2 More of It: part (two)', left({text}, 40), 'APPENDIX'], chr(10))"
S.add_cte(
    "page_lines",
    f"""SELECT paper_id, page, pos, line, CASE WHEN starts_with(lower(line), 'abstract') THEN 'Abstract' WHEN starts_with(lower(line), 'appendix') THEN 'Appendix'
  WHEN lower(line) IN ('references', 'acknowledgements', 'acknowledgments') THEN upper(left(line, 1)) || lower(substring(line, 2)) WHEN regexp_matches(line, '{L.SECTION_HEADING}') THEN line END AS opened
FROM (SELECT paper_id, page, i AS pos, {S.d_clean("ls[i]")} AS line FROM (SELECT *, string_split(text, chr(10)) AS ls
  FROM (SELECT 'p' || (page_id - page_id % 3) AS paper_id, page_id AS page, {_PAGED.format(text="t")} AS text FROM (SELECT *, {S.d_clean("html")} AS t FROM pages))), unnest(range(1, len(ls) + 1)) AS u(i)) WHERE line <> ''""",
)
S.add_cte("page_before", "SELECT *, coalesce(last_value(opened IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY page, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'Unknown') AS before FROM page_lines", "page_lines")
S.add_cte("page_runs", "SELECT *, count(*) FILTER (turns) OVER (PARTITION BY paper_id ORDER BY page, pos) AS run, CASE WHEN turns THEN opened ELSE before END AS section FROM (SELECT *, coalesce(opened <> before, false) AS turns FROM page_before)", "page_before")
S.add_cte("page_texts", "SELECT *, row_number() OVER (PARTITION BY paper_id, page, run ORDER BY pos) AS rn FROM page_runs WHERE NOT turns", "page_runs")
S.add_cte("page_parts", """SELECT * FROM (WITH RECURSIVE walk AS (
  SELECT paper_id, page, run, rn, section, line, length(line) AS held, 0 AS part FROM page_texts WHERE rn = 1
  UNION ALL
  SELECT t.paper_id, t.page, t.run, t.rn, t.section, t.line, CASE WHEN w.held + length(t.line) <= 1200 THEN w.held + length(t.line) ELSE length(t.line) END, w.part + CASE WHEN w.held + length(t.line) <= 1200 THEN 0 ELSE 1 END
  FROM walk w JOIN page_texts t ON t.paper_id = w.paper_id AND t.page = w.page AND t.run = w.run AND t.rn = w.rn + 1)
SELECT * FROM walk)""", "page_texts")


@query(S.sql("SELECT paper_id, page, section, CASE WHEN contains(lower(section), 'appendix') THEN 'appendix' ELSE 'paper' END AS source_type, string_agg(line, chr(10) ORDER BY rn) AS body FROM page_parts GROUP BY paper_id, page, run, section, part", "page_parts"))
def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = S.table(spark, d, "pages").withColumn("t", T.clean_text("html"))
    opening = F.element_at(T.words_of(("Abstract", "1 Introduction to It", "References", "Appendix", "no heading")), (F.col("page_id") % 5 + 1).cast("int"))
    text = F.concat_ws("\n", opening, "t", F.lit("B.2 More of It: part (two)"), F.left("t", F.lit(40)), F.lit("APPENDIX"))
    return C.chunked_pages(pages.select(F.concat(F.lit("p"), F.col("page_id") - F.col("page_id") % 3).alias("paper_id"), F.col("page_id").alias("page"), text.alias("text")))


# joins of claims with other claims, labels, evidence and guidelines


S.add_cte("list_a", "SELECT review_id, claim_index AS a_index, claim_text AS a_text FROM claims", "claims")
S.add_cte("list_b", "SELECT review_id, claim_index AS b_index, CASE WHEN claim_index % 2 = 0 THEN claim_text ELSE 'changed ' || claim_text END AS b_text FROM claims WHERE paper_id IN (SELECT 'p' || doc_id FROM labels)", "claims")


@query(S.sql("SELECT review_id, a_index, b_index, how FROM (SELECT *, row_number() OVER (PARTITION BY review_id, a_index ORDER BY how DESC, b_index) AS rn FROM (SELECT a.review_id, a_index, b_index, CASE WHEN a_text = b_text THEN 'text' ELSE 'position' END AS how FROM list_a a JOIN list_b b ON a.review_id = b.review_id AND (a_text = b_text OR a_index = b_index))) WHERE rn = 1", "list_a", "list_b"))
def match_claim_sets(spark: SparkSession, d: str) -> DataFrame:
    """Two claim lists of a review: first candidate of equal text, else of the same position."""
    rows = S.claims(spark, d)
    a = rows.select("review_id", F.col("claim_index").cast("bigint").alias("a_index"), F.col("claim_text").alias("a_text"))
    changed = F.when(F.col("claim_index") % 2 == 0, F.col("claim_text")).otherwise(F.concat(F.lit("changed "), "claim_text"))
    b = S.labelled(spark, d, rows).select("review_id", F.col("claim_index").cast("bigint").alias("b_index"), changed.alias("b_text"))
    by_text = a.join(b, (a["review_id"] == b["review_id"]) & (a["a_text"] == b["b_text"])).select(a["review_id"], "a_index", "b_index", F.lit(0).alias("way"))
    by_place = a.join(b, (a["review_id"] == b["review_id"]) & (a["a_index"] == b["b_index"])).select(a["review_id"], "a_index", "b_index", F.lit(1).alias("way"))
    best = by_text.unionByName(by_place).groupBy("review_id", "a_index").agg(F.min(F.struct("way", "b_index")).alias("m"))
    return best.select("review_id", "a_index", "m.b_index", F.when(F.col("m.way") == 0, "text").otherwise("position").alias("how"))


@query("SELECT doc_id, comment_id, linked, edits, n_edits FROM (SELECT l_orderkey AS doc_id, l_linenumber AS comment_id, l_quantity, l_partkey FROM lineitem ) c LEFT JOIN (SELECT o_orderkey, 1 AS cid, true AS linked_, o_orderstatus AS edits_, 1 AS n FROM orders WHERE o_orderstatus <> 'P') e ON doc_id = o_orderkey AND comment_id = cid, LATERAL (SELECT coalesce(linked_, false) AS linked, coalesce(edits_, '') AS edits, coalesce(n, 0) AS n_edits)")
def join_edit_labels(spark: SparkSession, d: str) -> DataFrame:
    """Review comments with the edits made for them, and whether there are any."""
    comments = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("comment_id"))
    edits = S.table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("comment_id"), F.array("o_orderstatus").alias("positive"))
    rows = comments.join(edits, ["doc_id", "comment_id"], "left")
    return rows.select("doc_id", "comment_id", F.col("positive").isNotNull().alias("linked"), F.coalesce(F.array_join("positive", " "), F.lit("")).alias("edits"), F.coalesce(F.size("positive"), F.lit(0)).alias("n_edits"))


@query("SELECT paper_id, provider, count(*) AS n FROM (SELECT DISTINCT ON (paper_id, key) paper_id, key, provider FROM (SELECT doc_id - doc_id % 4 AS paper_id, source AS key, 'paper' AS provider, 0 AS rank FROM documents UNION ALL SELECT doc_id - doc_id % 4, 'src' || (doc_id * 7 % 25), 'index', 1 FROM documents) ORDER BY paper_id, key, rank) GROUP BY ALL")
def attach_evidence(spark: SparkSession, d: str) -> DataFrame:
    """External records beside a paper's sections, duplicates by key dropped, existing ones first."""
    docs = S.table(spark, d, "documents").withColumn("paper_id", F.col("doc_id") - F.col("doc_id") % 4)
    own = docs.select("paper_id", F.col("source").alias("key"), F.lit(0).alias("rank"), F.lit("paper").alias("provider"))
    found = docs.select("paper_id", F.concat(F.lit("src"), F.col("doc_id") * 7 % 25).alias("key"), F.lit(1).alias("rank"), F.lit("index").alias("provider"))
    kept = own.unionByName(found).groupBy("paper_id", "key").agg(F.min(F.struct("rank", "provider"))["provider"].alias("provider"))
    return kept.groupBy("paper_id", "provider").agg(F.count(F.lit(1)).alias("n"))


_GUIDES = (("en", "novelty", "g1"), ("en", "baseline", "g2"), ("en", "ethics", "g3"), ("en", "ablation", "g4"), ("fr", "novelty", "g5"), ("de", "clarity", "g6"))


@query(S.sql("SELECT paper_id, guide FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY guide) AS rn FROM (SELECT DISTINCT paper_id, guide FROM (SELECT 'p' || (doc_id - doc_id % 4) AS paper_id, lang, " + S._list(L.CLAIM_TYPES) + "[doc_id % 10 + 1] AS kind FROM documents) JOIN (VALUES " + ", ".join(map(str, _GUIDES)) + ") AS g(venue, of, guide) ON lang = venue AND kind = of)) WHERE rn <= 3"))
def guideline_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Up to three guidelines of each paper for its venue and claim types."""
    guides = spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("venue", "kind", "guide"), g, strict=True))) for g in _GUIDES))))
    rows = S.table(spark, d, "documents").select(F.concat(F.lit("p"), F.col("doc_id") - F.col("doc_id") % 4).alias("paper_id"), F.col("lang").alias("venue"), F.element_at(T.words_of(L.CLAIM_TYPES), (F.col("doc_id") % 10 + 1).cast("int")).alias("kind"))
    # a fixed list of six guidelines
    found = rows.join(F.broadcast(guides), ["venue", "kind"]).select("paper_id", "guide").distinct()
    return found.withColumn("rn", F.row_number().over(Window.partitionBy("paper_id").orderBy("guide"))).where("rn <= 3").select("paper_id", "guide")


S.add_cte("chain", "SELECT task_id, robustness, s_rebuttal, survival_label, CASE WHEN survival_label <> 'not_found' THEN 1 ELSE 0 END AS meta, CASE WHEN rebuttal_label <> 'not_addressed' THEN 1 ELSE 0 END AS rebuttal, CASE WHEN discussion_label = 'followed_up' THEN 1 ELSE 0 END AS discussion, CASE WHEN consensus_proxy <> 'none' THEN 1 ELSE 0 END AS consensus, round(1.0::DOUBLE - s_rebuttal, 4) AS resolution FROM scored_all", "scored_all")


def _chain(spark: SparkSession, d: str) -> DataFrame:
    rows = lifecycle.scored(lifecycle.with_labels(matching.signals(S.claims(spark, d), S.segments(spark, d)), S.claim_labels(spark, d)), F.lit(True), F.lit(True))
    flag = lambda c: F.when(c, 1).otherwise(0)
    return rows.select(
        "task_id", "robustness", flag(F.col("survival_label") != "not_found").alias("meta"), flag(F.col("rebuttal_label") != "not_addressed").alias("rebuttal"),
        flag(F.col("discussion_label") == "followed_up").alias("discussion"), flag(F.col("consensus_proxy") != "none").alias("consensus"), F.round(1.0 - F.col("s_rebuttal"), 4).alias("resolution"),
    )


@query(S.sql("SELECT task_id, meta, rebuttal, discussion, consensus, resolution, robustness, CASE WHEN robustness >= 0.45 AND resolution < 0.5 THEN 'high' WHEN robustness >= 0.3 THEN 'medium' ELSE 'low' END AS priority, CASE WHEN resolution >= 0.85 THEN 'cite_existing_response' WHEN meta = 1 THEN 'answer_meta_review' WHEN consensus = 1 THEN 'answer_jointly' ELSE 'clarify_briefly' END AS strategy FROM chain", "chain"))
def evidence_chain(spark: SparkSession, d: str) -> DataFrame:
    """Evidence kinds of each claim with priority and strategy of an answer by ordered rules."""
    priority = F.when((F.col("robustness") >= 0.45) & (F.col("resolution") < 0.5), "high").when(F.col("robustness") >= 0.3, "medium").otherwise("low")
    strategy = F.when(F.col("resolution") >= 0.85, "cite_existing_response").when(F.col("meta") == 1, "answer_meta_review").when(F.col("consensus") == 1, "answer_jointly").otherwise("clarify_briefly")
    return _chain(spark, d).select("task_id", "meta", "rebuttal", "discussion", "consensus", "resolution", "robustness", priority.alias("priority"), strategy.alias("strategy"))


@query(S.sql("SELECT kind, count(*) AS n, round(sum(v)::DOUBLE / count(*), 4) AS share FROM (SELECT unnest(['meta', 'rebuttal', 'discussion', 'consensus']) AS kind, unnest([meta, rebuttal, discussion, consensus]) AS v FROM chain) GROUP BY kind", "chain"))
def evidence_coverage(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("v")) for k in ("meta", "rebuttal", "discussion", "consensus")))
    return _chain(spark, d).select(F.inline(kinds)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), T.rate(F.col("v") == 1).alias("share"))
