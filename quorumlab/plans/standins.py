"""Stand-in inputs: peer-review shaped views over the given tables, as SQL that two engines accept unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlab.functions import lexicons as L
from quorumlab.functions import text as T
from quorumlab.sources.files import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "v_reply": """
SELECT concat('p', conv_id) AS paper_id, concat('p', conv_id, ':', turn) AS reply_id, turn, (turn + 1) * 1000 AS created_ms,
       (turn + 1) * 1000 + (length(text) % 4) * 1000 AS modified_ms,
       CASE role WHEN 'user' THEN 'reviewer' WHEN 'assistant' THEN 'authors' ELSE 'area_chair' END AS signer_role,
       CASE WHEN role = 'user' AND turn < 4 THEN 'official_review' WHEN role = 'user' THEN 'official_comment'
            WHEN role = 'assistant' THEN 'author_response' ELSE 'meta_review' END AS note_type, text
FROM conversations""",
    "v_review": """
SELECT concat('r', doc_id) AS review_id, concat('p', doc_id - (doc_id % 4)) AS paper_id, doc_id % 4 + 1 AS reviewer_index,
       lang AS venue, source, text AS review_text, n_chars,
       CASE WHEN n_chars % 11 = 0 THEN NULL ELSE CAST(n_chars % 10 + 1 AS DOUBLE) END AS rating_normalized,
       CASE WHEN n_chars % 7 = 0 THEN NULL ELSE CAST((n_chars % 5 + 1) * 2 AS DOUBLE) END AS confidence_normalized
FROM documents""",
    "v_score": """
SELECT d.doc_id AS row_id, concat('p', d.doc_id - (d.doc_id % 4)) AS paper_id, concat('R', d.doc_id % 4 + 1) AS reviewer_key,
       d.lang AS venue, d.n_chars % 101 AS outrage, l.toxic * 60 + d.n_chars % 41 AS toxicity, l.quality * 50 + d.n_chars % 51 AS helpfulness, d.text AS quote
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "v_activity": """
SELECT event_id, ts, concat('u', user_id) AS session_id, concat('p', CAST(floor(event_id / 7) AS BIGINT) % 100 * 4) AS paper_id,
       concat('R', event_id % 4 + 1) AS reviewer_key,
       CASE event_type WHEN 'click' THEN 'vote_up' WHEN 'error' THEN 'vote_down' WHEN 'signup' THEN 'vote_none'
            WHEN 'view' THEN 'comment' ELSE 'reaction' END AS action, value
FROM events""",
    "v_job": """
SELECT concat('j', o_orderkey) AS job_id, concat('p', o_custkey) AS paper_id,
       CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'queued' ELSE 'running' END AS status, o_orderdate AS created_at
FROM orders""",
    "v_memory": """
SELECT concat('m', d.doc_id, ':s') AS memory_id, d.doc_id AS ord, 'substantiation' AS dimension, d.text AS input_text, d.source AS dataset,
       CASE l.quality WHEN 1 THEN 'substantiated' ELSE 'unsubstantiated' END AS gold_label,
       CASE l.quality WHEN 1 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.15 AS DOUBLE) END AS mapped_score
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
UNION ALL
SELECT concat('m', d.doc_id, ':t'), d.doc_id, 'professionalism', d.text, d.source,
       CASE l.toxic WHEN 1 THEN 'unprofessional' ELSE 'professional' END,
       CASE l.toxic WHEN 1 THEN CAST(0.15 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "v_query": "SELECT item_id AS query_id, text AS query_text FROM benchmark",
    "v_judgment": """
SELECT concat('c', l_orderkey) AS claim_id, CASE l_linenumber % 3 WHEN 0 THEN 'engage_polished' WHEN 1 THEN 'engage_none' ELSE 'none_polished' END AS pair,
       CASE l_returnflag WHEN 'R' THEN 'arm_a' WHEN 'A' THEN 'arm_b' ELSE 'tie' END AS winner, l_linenumber AS repeat_no,
       CASE WHEN l_orderkey % 2 = 0 THEN 'fixable' ELSE 'not_fixable' END AS addressability,
       CAST(l_quantity AS BIGINT) AS words, CASE l_linestatus WHEN 'F' THEN 'engage' ELSE 'polished' END AS arm_a, l_discount AS helpful_a, l_tax AS helpful_b
FROM lineitem""",
}


#: Tables of texts, whose work is in their rows.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in TEXTS else found


def view(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A stand-in view over the tables of ``sf_dir``, or over those ``given`` in their place."""
    sql = VIEWS[name]
    used = {t: given[t] if t in given else table(spark, sf_dir, t) for t in TABLES if f" {t}" in sql.replace("\n", " ")}
    for t in used:
        sql = sql.replace(f" {t} ", f" {{{t}}} ").replace(f" {t}\n", f" {{{t}}}\n")
        sql = sql[: -len(t)] + f"{{{t}}}" if sql.endswith(f" {t}") else sql
    return spark.sql(sql, **used)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of official reviews as claims."""
    rows = view(spark, sf_dir, "v_reply").where("note_type = 'official_review'")
    rows = rows.select("paper_id", F.col("reply_id").alias("review_id"), "turn", F.posexplode(T.split_sentences("text")).alias("claim_index", "claim_text"))
    return rows.select(
        "paper_id",
        "review_id",
        "turn",
        "claim_index",
        "claim_text",
        F.element_at(T.words_of(L.CLAIM_TYPES), F.col("claim_index") % 10 + 1).alias("claim_type"),
        F.element_at(T.words_of(("major", "medium", "minor", "question")), F.length("claim_text") % 4 + 1).alias("importance"),
        F.when(F.col("claim_text").endswith("?"), "questions").otherwise("weaknesses").alias("source_field"),
        F.col("claim_text").alias("source_sentence"),
        F.concat_ws(":", "review_id", "claim_index").alias("task_id"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of responses, comments and meta-reviews; ``ord`` is their order in the paper."""
    rows = view(spark, sf_dir, "v_reply").where("note_type <> 'official_review'")
    rows = rows.select("paper_id", "note_type", "turn", F.posexplode(T.split_segments("text")).alias("pos", "segment"))
    return rows.select("paper_id", "note_type", (F.col("turn") * 10000 + F.col("pos")).alias("ord"), "segment")


def labelled(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """The rows of papers that the table of labels has."""
    known = table(spark, sf_dir, "labels").select(F.concat(F.lit("p"), "doc_id").alias("paper_id")).distinct()
    return rows.join(known, "paper_id", "left_semi")


def claim_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in model labels of the claims whose paper the table of labels knows."""
    n = F.length("claim_text")

    def pick(*values: str):
        return F.element_at(T.words_of(values), n % len(values) + 1)

    rows = labelled(spark, sf_dir, claims(spark, sf_dir))
    return rows.select(
        "task_id",
        pick("same_concern", "related_but_different", "not_same_concern", "unsure").alias("consensus_label"),
        pick("not_addressed", "generic_or_unclear", "specifically_addressed", "likely_resolved").alias("response_label"),
        pick("resolved_or_weakened", "partially_addresses", "does_not_address", "unclear", "does_not_address").alias("effect_label"),
        pick("survived", "partial", "not_found", "unsure", "not_found").alias("meta_label"),
        pick("high", "medium", "low", "high", "medium", "low", "high").alias("confidence"),
    )


# the same inputs for the second engine


def _in(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _list(words) -> str:
    return f"[{_in(words)}]"


def d_mean4(x: str) -> str:
    return f"round(sum(CAST(round({x} * 10000) AS BIGINT))::DOUBLE / count({x})) / 10000"


def d_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[ \t\n\r\f]+|[ \t\n\r\f]+\z', '', 'g')"


#: The entities of the given tables, ``&amp;`` last.
D_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&"))


def d_clean(x: str) -> str:
    t = f"coalesce({x}, '')"
    for a, b in D_ENTITIES:
        t = f"replace({t}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    t = rf"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    t = rf"replace({t}, chr(13), chr(10))"
    t = rf"regexp_replace(regexp_replace({t}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return d_strip(t)


def d_clean_ws(x: str) -> str:
    return d_strip(rf"regexp_replace(coalesce({x}, ''), '[ \t\n\r\f]+', ' ', 'g')")


def d_sentences(x: str) -> str:
    lines = f"list_filter(list_transform(string_split({d_clean(x)}, chr(10)), lambda s: trim(s, ' -*' || chr(9))), lambda s: s <> '')"
    flat = rf"regexp_replace(regexp_replace(array_to_string({lines}, ' '), '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), ';[ \t\n\r\f]+', chr(1), 'g')"
    return f"list_filter(list_transform(string_split({flat}, chr(1)), lambda s: {d_strip('s')}), lambda s: length(s) > 12)"


def d_segments(x: str) -> str:
    flat = rf"regexp_replace(regexp_replace(regexp_replace({d_clean(x)}, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), ';[ \t\n\r\f]+', chr(1), 'g'), '\n+', chr(1), 'g')"
    trimmed = d_strip("trim(s, ' -*' || chr(9))")
    pieces = f"list_filter(list_transform(string_split({flat}, chr(1)), lambda s: {trimmed}), lambda s: length(s) >= 20)"
    return f"CASE WHEN len({pieces}) > 0 THEN {pieces} WHEN {d_clean(x)} <> '' THEN [{d_clean(x)}] ELSE [] END"


def d_raw_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z][a-z0-9_-]{{2,}}')"


def d_plain_tokens(x: str) -> str:
    return f"list_sort(list_distinct(list_filter({d_raw_tokens(f'coalesce({x}, {chr(39) * 2})')}, lambda t: t NOT IN ({_in(L.STOPWORDS)}))))"


def d_singular(t: str) -> str:
    return (
        f"CASE WHEN length({t}) > 4 AND suffix({t}, 'ies') THEN left({t}, length({t}) - 3) || 'y' WHEN length({t}) > 4 AND suffix({t}, 'es') THEN left({t}, length({t}) - 2) "
        f"WHEN length({t}) > 3 AND suffix({t}, 's') THEN left({t}, length({t}) - 1) ELSE {t} END"
    )


def d_token_list(x: str) -> str:
    return f"list_transform(list_filter({d_raw_tokens(f'coalesce({x}, {chr(39) * 2})')}, lambda t: t NOT IN ({_in(L.STOPWORDS)})), lambda t: {d_singular('t')})"


def d_concern_tokens(x: str) -> str:
    same = "CASE {t} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in L.SYNONYMS.items()) + " ELSE {t} END"
    stem = "CASE WHEN suffix({t}, 'ing') AND length({t}) > 6 THEN left({t}, length({t}) - 3) WHEN suffix({t}, 'ed') AND length({t}) > 5 THEN left({t}, length({t}) - 2) WHEN suffix({t}, 's') AND length({t}) > 5 THEN left({t}, length({t}) - 1) ELSE {t} END"
    found = f"list_transform({d_raw_tokens(d_clean(x))}, lambda t: replace(t, '-', ''))"
    for step in (same, stem, same):
        found = f"list_transform({found}, lambda t: {step.format(t='t')})"
    return f"list_sort(list_distinct(list_filter({found}, lambda t: length(t) >= 3 AND t NOT IN ({_in(L.CONCERN_STOPWORDS)}))))"


def d_overlap(q: str, s: str) -> str:
    both = f"list_intersect({q}, {s})"
    return (
        f"CASE WHEN len({both}) > 0 THEN least(1.0::DOUBLE, 0.68::DOUBLE * (len({both})::DOUBLE / len({q})) + 0.32::DOUBLE * (len({both})::DOUBLE / sqrt((len({q}) * len({s}))::DOUBLE))"
        f" + CASE WHEN list_has_any({both}, {_list(L.ANCHORS)}) THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END) ELSE 0.0::DOUBLE END"
    )


def _pick(n: str, *values: str) -> str:
    return f"{_list(values)}[{n} % {len(values)} + 1]"


CTES = {
    **VIEWS,
    "claims": f"""
SELECT paper_id, reply_id AS review_id, turn, i - 1 AS claim_index, ss[i] AS claim_text, {_list(L.CLAIM_TYPES)}[(i - 1) % 10 + 1] AS claim_type,
       ['major', 'medium', 'minor', 'question'][length(ss[i]) % 4 + 1] AS importance,
       CASE WHEN suffix(ss[i], '?') THEN 'questions' ELSE 'weaknesses' END AS source_field, ss[i] AS source_sentence, reply_id || ':' || (i - 1) AS task_id
FROM (SELECT *, {d_sentences("text")} AS ss FROM v_reply WHERE note_type = 'official_review'), unnest(range(1, len(ss) + 1)) AS t(i)""",
    "segments": f"""
SELECT paper_id, note_type, turn * 10000 + i - 1 AS ord, ss[i] AS segment
FROM (SELECT *, {d_segments("text")} AS ss FROM v_reply WHERE note_type <> 'official_review'), unnest(range(1, len(ss) + 1)) AS t(i)""",
    "claim_labels": f"""
SELECT task_id, {_pick("length(claim_text)", "same_concern", "related_but_different", "not_same_concern", "unsure")} AS consensus_label,
       {_pick("length(claim_text)", "not_addressed", "generic_or_unclear", "specifically_addressed", "likely_resolved")} AS response_label,
       {_pick("length(claim_text)", "resolved_or_weakened", "partially_addresses", "does_not_address", "unclear", "does_not_address")} AS effect_label,
       {_pick("length(claim_text)", "survived", "partial", "not_found", "unsure", "not_found")} AS meta_label,
       {_pick("length(claim_text)", "high", "medium", "low", "high", "medium", "low", "high")} AS confidence
FROM claims WHERE paper_id IN (SELECT 'p' || doc_id FROM labels)""",
}
NEEDS = {"claims": ("v_reply",), "segments": ("v_reply",), "claim_labels": ("claims",)}


def add_cte(name: str, sql: str, *needs: str) -> None:
    CTES[name], NEEDS[name] = sql, needs


def sql(body: str, *names: str) -> str:
    """A query for the second engine over the named stand-ins."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in NEEDS.get(name, ()):
            visit(n)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order)
    return f"WITH {head}\n{body}" if order else body
