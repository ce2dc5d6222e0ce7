"""Registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlab.llm import chat, decontaminate, forest, language, lexical, packing, quality, repair, rules, secrets, simhash, substrings, token_files
from quorumlab.llm.shared import crc_fold, documents, sampled, staged, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False))
    model = language.train(docs.where(~held_out))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files_report(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secrets.scan(docs, secrets.train(docs))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    labels = staged(sampled(labels, "label", 2000), "label-sample")
    field = quality.train(docs.select("doc_id", "text").join(labels, "doc_id"))
    predicted = F.when(F.col("score") >= 0.3, 1).otherwise(0)
    return quality.scored(docs, field).select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_bytes(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), with_ids=False)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    back = chat.read_back(chat.format_chats(chat.events_of(talks.unionByName(planted), drafts=True)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    return repair.repair_report(talks, repair.damaged(talks))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return forest.nearest(rows, rows.where(F.col("vec_id") % 50 == 0))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_documents(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


OP5_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, n, substr(h, 2000 * n + 1, 2098) AS part FROM d, unnest(range(0, length(h) // 2000 + 1)) AS t(n)),
w AS (SELECT doc_id, 1000 * n + j AS i, substr(part, 2 * j - 1, 100) AS s FROM b, unnest(range(1, least(1001, length(part) // 2 - 48))) AS t(j)),
first_seen AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, i FROM w JOIN first_seen USING (s) WHERE least < doc_id),
runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 49 AS z
  FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run
        FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM gone))
  GROUP BY doc_id, run),
cuts AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(z - a + 1) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - 1 - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS k
  FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP9_SQL = r"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS row_no,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
  FROM item, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
place AS (
  SELECT row_no, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM doc, lens, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
found AS (SELECT row_no, i, place.n, item_id FROM place JOIN win ON place.s = win.s AND place.n = win.n),
hit AS (SELECT row_no, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, n)) AS t(k) GROUP BY row_no),
items AS (
  SELECT row_no, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS listed
  FROM (SELECT DISTINCT row_no, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY row_no)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (row_no) LEFT JOIN items USING (row_no)
"""

OP10_SQL = r"""
WITH talk AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ') + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ': ', '\c')) + length(': ')
         + length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t')) + length('</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM talk GROUP BY conv_id
"""

OP11_SQL = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations),
kinds AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(name, ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
              lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) % 20 AS kind
  FROM named),
rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS t(copy)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS written
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM rows)),
judged AS (
  SELECT conv_id, i, turn, role, text, written = '' AS blank, written <> '' AND seen > 1 AS duplicate,
         written <> '' AND seen = 1 AND right(written, 1) NOT IN ('.', '!', '?') AS truncated,
         left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal, max(i) AS n
  FROM judged GROUP BY conv_id),
moves(p, r, q) AS (VALUES ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
inserts AS (
  SELECT p, p AS q, 0 AS cost, '' AS letters FROM (SELECT DISTINCT p FROM moves)
  UNION ALL SELECT p, q, 2, 'I' FROM moves WHERE r <> 's'
  UNION ALL SELECT a.p, b.q, 4, 'II' FROM moves a JOIN moves b ON a.q = b.p WHERE a.r <> 's' AND b.r <> 's'),
ways AS (
  SELECT conv_id, i, e.p, CASE WHEN edit = 'D' THEN e.q ELSE m.q END AS q, CAST(e.cost + CASE edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN truncated AND edit <> 'D' THEN 1 ELSE 0 END AS BIGINT) AS cost, e.letters || edit AS letters
  FROM judged, inserts e, unnest(['D', 'K', 'R']) AS t(edit) LEFT JOIN moves m ON m.p = e.q
  WHERE CASE edit WHEN 'D' THEN m.r IS NULL OR m.r <> 's' WHEN 'K' THEN NOT blank AND NOT duplicate AND m.r = left(role, 1) ELSE NOT blank AND NOT duplicate AND m.r <> 's' END),
best AS (
  SELECT conv_id, n + 1 AS i, p, cost, audit FROM counts, (VALUES ('0', CAST(0 AS BIGINT), ''), ('s', 4, 'II'), ('u', 2, 'I'), ('a', 0, '')) AS v(p, cost, audit)
  UNION ALL
  SELECT conv_id, i, p, cost, audit FROM (
    SELECT w.conv_id, w.i, w.p, w.cost + b.cost AS cost, w.letters || b.audit AS audit, row_number() OVER (PARTITION BY w.conv_id, w.p ORDER BY w.cost + b.cost, w.letters || b.audit) AS place
    FROM best b JOIN ways w ON w.conv_id IS NOT DISTINCT FROM b.conv_id AND w.i = b.i - 1 AND w.q = b.p)
  WHERE place = 1),
chosen AS (SELECT conv_id, cost, audit FROM best WHERE i = 1 AND p = '0'),
letters AS (
  SELECT conv_id, k, substr(audit, k, 1) AS edit, length(regexp_replace(substr(audit, 1, k), 'I', '', 'g')) AS i, length(regexp_replace(substr(audit, 1, k), 'D', '', 'g')) AS made
  FROM chosen, unnest(range(1, length(audit) + 1)) AS t(k)),
made AS (
  SELECT l.conv_id, l.k, edit, role, text, made - max(CASE WHEN edit = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS nr
  FROM letters l LEFT JOIN judged j ON l.conv_id IS NOT DISTINCT FROM j.conv_id AND l.i = j.i AND edit <> 'I' WHERE edit <> 'D'),
digests AS (
  SELECT conv_id, sha256(string_agg(CASE edit WHEN 'K' THEN role ELSE CASE nr % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS sha
  FROM made GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN chosen b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN digests d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""

OP13_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT item_id, term, count(*) AS qtf FROM item GROUP BY item_id, term),
total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM doc WHERE len(w) > 0),
tfs AS (SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest(w) AS term FROM doc) GROUP BY row_no, term),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM dfs, total),
scored AS (
  SELECT item_id, row_no, CAST(sum(qtf * weights.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * CAST(len(doc.w) AS BIGINT) * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN doc USING (row_no), total GROUP BY item_id, row_no),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored JOIN doc USING (row_no) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_token_files, op3_secret_scan, op4_quality_classifier, op5_suffix_dedup, op6_quality_rules, op7_simhash,
        op8_packing, op9_decontamination, op10_chat_format, op11_conversation_repair, op12_nearest_neighbours, op13_lexical_search,
    )
}
ORACLES: dict[str, str] = {"op5_suffix_dedup": OP5_SQL, "op9_decontamination": OP9_SQL, "op10_chat_format": OP10_SQL, "op11_conversation_repair": OP11_SQL, "op13_lexical_search": OP13_SQL}
