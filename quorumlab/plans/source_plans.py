"""Queries that write and read files of threads, and normalize them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlab.functions import lexicons as L
from quorumlab.functions import text as T
from quorumlab.operators import normalize
from quorumlab.plans import standins as S
from quorumlab.plans.registry import query
from quorumlab.sources import files

_SIGN = "CASE signer_role WHEN 'reviewer' THEN concat('V/', paper_id, '/Reviewer_', turn % 4) WHEN 'authors' THEN concat('V/', paper_id, '/Authors') ELSE concat('V/', paper_id, '/Area_Chair_1') END"
_INVITE = "CASE note_type WHEN 'official_review' THEN 'V/-/Official_Review' WHEN 'author_response' THEN 'V/-/Official_Comment' WHEN 'meta_review' THEN 'V/-/Meta_Review' ELSE 'V/-/Official_Comment' END"
S.add_cte("reply", f"SELECT *, {_SIGN} AS signer, {_INVITE} AS invitation FROM v_reply", "v_reply")


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """Nested threads of the stand-in replies."""
    rows = S.view(spark, d, "v_reply").select("paper_id", "reply_id", "turn", F.expr(_SIGN).alias("signer"), F.expr(_INVITE).alias("invitation"), "created_ms", "modified_ms", "text")
    reply = F.struct("reply_id", "turn", "signer", "invitation", "created_ms", "modified_ms", "text")
    by_turn = F.array_sort(F.collect_list(F.struct("turn", reply.alias("r"))))
    return rows.groupBy(F.col("paper_id").alias("id")).agg(F.transform(by_turn, lambda x: x["r"]).alias("replies")).withColumns({"forum": F.col("id"), "venue": F.lit("V")}).select("id", "forum", "venue", "replies")


def _read(spark: SparkSession, d: str) -> DataFrame:
    """The threads written as JSON pages and read back by the pages' manifest."""
    pages = _notes(spark, d).withColumn("page", F.pmod(F.xxhash64("id"), F.lit(5)))
    path = files.write_records(pages.groupBy("page").agg(F.collect_list(F.struct("id", "forum", "venue", "replies")).alias("notes")).drop("page"), files.shared_folder(spark, "pages"))
    manifest = [f"{path}/*.json"]
    return files.read_note_pages(spark, manifest)


@query(S.sql("SELECT paper_id AS id, count(*) AS replies, md5(string_agg(text, '|' ORDER BY turn)) AS digest FROM reply GROUP BY paper_id", "reply"))
def read_note_pages(spark: SparkSession, d: str) -> DataFrame:
    joined = F.array_join(F.transform("replies", lambda r: r["text"]), "|")
    return _read(spark, d).select("id", F.size("replies").cast("bigint").alias("replies"), F.md5(joined.cast("binary")).alias("digest"))


@query("SELECT unnest(['csv', 'json', 'jsonl', 'list']) AS kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, round(sum(quality)::DOUBLE, 4) AS score FROM documents JOIN labels USING (doc_id)")
def read_records(spark: SparkSession, d: str) -> DataFrame:
    """The same records by way of JSON lines, wrapped JSON, bare lists over many lines behind a byte-order mark, and CSV."""
    rows = S.table(spark, d, "documents").join(S.table(spark, d, "labels"), "doc_id").select(F.col("doc_id").cast("string").alias("id"), "text", F.lit("x").alias("label"), F.col("quality").cast("double").alias("score"))
    out = []
    groups = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(8)).alias("g")).agg(F.collect_list(F.struct("id", "text", "label", "score")).alias("items"))
    for kind in ("jsonl", "json", "csv", "list"):
        path = files.shared_folder(spark, f"records-{kind}")
        if kind == "csv":
            rows.write.csv(path, header=True, escape='"', quoteAll=True)
        elif kind == "jsonl":
            rows.write.json(path)
        else:
            wrapped = F.to_json(F.struct("items"))
            bare = F.concat(F.lit("\ufeff[\n"), F.array_join(F.transform("items", lambda x: F.to_json(x)), ",\n"), F.lit("\n]"))
            groups.select("g", (wrapped if kind == "json" else bare).alias("value")).repartition("g").write.partitionBy("g").text(path)
        out.append(files.read_records(spark, path, "json" if kind == "list" else kind).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.round(F.sum("score"), 4).alias("score")).select(F.lit(kind).alias("kind"), "n", "chars", "score"))
    return functools.reduce(DataFrame.unionByName, out)


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def write_records(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as JSON lines by language and read back by partition."""
    rows = S.table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    path = files.write_records(rows, files.shared_folder(spark, "by-language"), ("lang",))
    return spark.read.schema("doc_id bigint, source string, n_chars bigint, lang string").json(path).select("doc_id", "lang", "source", "n_chars")


_NESTED = "SELECT paper_id, doc_id, 'rev' || doc_id % 300 AS review_id, row_number() OVER (PARTITION BY paper_id ORDER BY doc_id) AS reviewer_index FROM (SELECT doc_id, 'p' || (doc_id - doc_id % 4) AS paper_id FROM documents)"


@query(f"SELECT review_id, paper_id, reviewer_index FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY CAST(substr(paper_id, 2) AS BIGINT) DESC, paper_id DESC, reviewer_index DESC) AS rn FROM ({_NESTED})) WHERE rn = 1")
def flatten_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Nested papers to reviews: positions become reviewer numbers, the last loaded row of an id wins."""
    docs = S.table(spark, d, "documents").select((F.col("doc_id") - F.col("doc_id") % 4).alias("load_order"), "doc_id", "lang", F.concat(F.lit("rev"), F.col("doc_id") % 300).alias("review_id"), "text")
    rows = F.array_sort(F.collect_list(F.struct("doc_id", "review_id", F.col("text").alias("review_text"))))
    nested = docs.groupBy("load_order").agg(F.transform(rows, lambda r: F.struct(r["review_id"].alias("review_id"), r["review_text"].alias("review_text"))).alias("reviews"), F.min("lang").alias("venue"))
    nested = nested.withColumn("paper_id", F.concat(F.lit("p"), "load_order"))
    _, reviews = files.flatten_dataset(nested)
    return reviews.select("review_id", "paper_id", F.col("reviewer_index").cast("bigint").alias("reviewer_index"))


@query(S.sql("SELECT paper_id, count(*) AS review_count, string_agg(review_id, ',' ORDER BY reviewer_index, review_id) AS reviews FROM v_review GROUP BY paper_id", "v_review"))
def wide_to_nested(spark: SparkSession, d: str) -> DataFrame:
    rows = files.nested_papers(S.view(spark, d, "v_review"))
    return rows.select("paper_id", "review_count", F.array_join(F.transform("reviews", lambda r: r["review_id"]), ",").alias("reviews"))


@query("SELECT work_id, title, abstract, 'work_' || left(sha1(work_id), 10) AS record_id FROM (SELECT 'w' || doc_id AS work_id, source AS title, array_to_string(regexp_extract_all(text, '[A-Za-z]+'), ' ') AS abstract FROM documents WHERE source <> 'src3') WHERE abstract <> ''")
def works_table(spark: SparkSession, d: str) -> DataFrame:
    """Inverted indexes made from texts and put together again; untitled works are dropped, each work comes twice."""
    # whole texts are dealt by document once, so words and positions are grouped where they are
    docs = S.table(spark, d, "documents").select("doc_id", "source", "text").repartition("doc_id")
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    rows = docs.select("doc_id", F.when(F.col("source") != "src3", F.col("source")).alias("title"), F.posexplode_outer(words).alias("pos", "token"))
    index = rows.where("token is not null").groupBy("doc_id", "title", "token").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    works = index.groupBy("doc_id", "title").agg(F.map_from_entries(F.collect_list(F.struct("token", "at"))).alias("inverted"))
    works = works.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"), F.concat(F.lit("w"), "doc_id").alias("work_id"), "title", "inverted")
    return files.works_table(works)


@query(S.sql("SELECT reply_id, signer_role AS role, note_type FROM v_reply", "v_reply"))
def classify_replies(spark: SparkSession, d: str) -> DataFrame:
    """Roles and types found from signatures and invitations of the written threads."""
    return normalize.classified(_read(spark, d)).select("reply_id", "role", "note_type")


@query(S.sql("SELECT paper_id, count(*) FILTER (note_type = 'official_review') AS reviews, count(*) FILTER (note_type = 'meta_review') AS decisions, coalesce(max_by(text, turn) FILTER (note_type = 'meta_review' AND text <> ''), '') AS decision_text FROM v_reply GROUP BY paper_id", "v_reply"))
def normalize_threads(spark: SparkSession, d: str) -> DataFrame:
    return normalize.papers_of(normalize.classified(_read(spark, d)))


_SIGNALS = ("", " The paper has weaknesses.", " We recommend a major revision.", " The authors thank nobody.", " Strengths are missing.", " We have updated the appendix and the paper.", " Thank you.")
_TITLES = ("", "Comment", "Response to Reviewer 2", "A concern", "Summary of changes")
_STATUSES = ("Accepted by V", "Under review for V", "Withdrawn by authors", "", "Rejected", "Submitted")
_YEAR_MS = 1_500_000_000_000
S.add_cte(
    "comments",
    f"""SELECT paper_id, reply_id, invitation, {S._list(_TITLES)}[length(text) % 5 + 1] AS title, text || {S._list(_SIGNALS)}[length(text) % 7 + 1] AS comment FROM reply""",
    "reply",
)
S.add_cte(
    "rolling_papers",
    f"SELECT paper_id, {S._list(_STATUSES)}[n % 6 + 1] AS status, {_YEAR_MS} + n * 2592000000 AS modified_ms FROM (SELECT paper_id, CAST(sum(length(text)) AS BIGINT) % 36 AS n FROM v_reply GROUP BY paper_id)",
    "v_reply",
)
_SAID = "CASE WHEN title = '' THEN {0} ELSE title || chr(10) || {0} END".format(S.d_strip("comment"))


@query(
    S.sql(
        f"""SELECT paper_id, reply_id AS review_id, CASE WHEN status = '' THEN 'Unknown' ELSE status END AS decision, md5({S.d_clean("said")}) AS review_text, {S.d_clean("title")} AS summary, md5({S.d_clean("comment")}) AS weaknesses
FROM (SELECT *, {_SAID} AS said FROM comments WHERE contains(invitation, '/-/Official_Comment')) JOIN rolling_papers USING (paper_id)
WHERE (contains(lower(status), 'accepted') OR contains(lower(status), 'rejected') OR contains(lower(status), 'withdrawn') OR year(make_timestamp(modified_ms * 1000)) = 2018)
AND length({S.d_clean_ws("said")}) >= 80 AND NOT regexp_matches({S.d_clean_ws("said")}, '{normalize.one_of(L.AUTHOR_OR_ADMIN)}') AND regexp_matches(said, '{normalize.one_of(L.REVIEWER_SIGNALS)}')""",
        "comments",
        "rolling_papers",
    )
)
def normalize_rolling_venue(spark: SparkSession, d: str) -> DataFrame:
    n, size = F.length("text"), F.sum(F.length("text")) % 36
    replies = _read(spark, d).select(F.col("id").alias("paper_id"), F.inline("replies"))
    pick = lambda values, at: F.element_at(T.words_of(values), (at + 1).cast("int"))
    papers = replies.groupBy("paper_id").agg(pick(_STATUSES, size % 6).alias("status"), (size * 2_592_000_000 + _YEAR_MS).alias("modified_ms"))
    comments = replies.select("paper_id", "reply_id", "invitation", pick(_TITLES, n % 5).alias("title"), F.concat("text", pick(_SIGNALS, n % 7)).alias("comment"))
    found = normalize.rolling_reviews(papers, comments, 2018)
    digest = [F.md5(F.col(c).cast("binary")).alias(c) for c in ("review_text", "weaknesses")]
    return found.select("paper_id", "review_id", "decision", "summary", *digest)


@query(S.sql("SELECT paper_id, count(*) FILTER (note_type = 'author_response') AS responses, CAST(coalesce(sum(length(text)) FILTER (note_type = 'author_response'), 0) AS BIGINT) AS response_chars, count(*) FILTER (note_type IN ('official_comment', 'meta_review')) AS discussions, CAST(coalesce(sum(length(text)) FILTER (note_type IN ('official_comment', 'meta_review')), 0) AS BIGINT) AS discussion_chars, array_to_string(list_sort(list_distinct(coalesce(list(left(sha1(paper_id || ':' || signer), 16)) FILTER (note_type = 'official_review'), []))), ',') AS reviewers FROM reply GROUP BY paper_id", "reply"))
def paper_auxiliary(spark: SparkSession, d: str) -> DataFrame:
    return normalize.auxiliary(normalize.classified(_read(spark, d)))


@query(
    """SELECT mode, accepted_only, count(*) AS papers, CAST(sum(c_custkey) AS BIGINT) AS ids FROM (SELECT *, unnest([false, true]) AS accepted_only FROM (SELECT *, unnest(['decision_year', 'activity_year', 'decision_or_activity_year']) AS mode FROM (
SELECT c_custkey, c_custkey % 3 = 0 AS decided, year(make_timestamp(CAST(1600000000 + c_custkey * 432000 AS BIGINT) * 1000000)) AS dy, year(make_timestamp(CAST(1590000000 + c_custkey * 432000 AS BIGINT) * 1000000)) AS ay, c_custkey % 4 < 2 AS accepted FROM customer)))
WHERE (NOT accepted_only OR accepted) AND CASE mode WHEN 'decision_year' THEN decided AND dy = 2021 WHEN 'activity_year' THEN ay = 2021 OR (decided AND dy = 2021) ELSE CASE WHEN decided THEN dy = 2021 ELSE ay = 2021 END END GROUP BY ALL"""
)
def filter_year_decision(spark: SparkSession, d: str) -> DataFrame:
    """Papers kept under the three year modes, with and without the accepted-only filter."""
    k = F.col("c_custkey")
    decided = F.timestamp_seconds(1_600_000_000 + k * 432_000)
    papers = S.table(spark, d, "customer").select(
        "c_custkey",
        F.when(k % 4 == 0, "Accepted (poster)").when(k % 4 == 1, "We accept this paper").when(k % 4 == 2, "Rejected").otherwise("accept, later rejected").alias("decision"),
        F.when(k % 3 == 0, F.array(decided)).otherwise(F.array().cast("array<timestamp>")).alias("decisions"),
        F.array_compact(F.array(F.timestamp_seconds(1_590_000_000 + k * 432_000), F.when(k % 3 == 0, decided))).alias("activity"),
    )
    out = None
    for mode in ("decision_year", "activity_year", "decision_or_activity_year"):
        for accepted in (False, True):
            rows = normalize.in_year(papers, 2021, mode, accepted).groupBy(F.lit(mode).alias("mode"), F.lit(accepted).alias("accepted_only")).agg(F.count(F.lit(1)).alias("papers"), F.sum("c_custkey").alias("ids"))
            out = rows if out is None else out.unionByName(rows)
    return out
