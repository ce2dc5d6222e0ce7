"""Audits of data that must not leave: keys at any depth of schema-free JSON, and markers in request lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlab.functions import lexicons as L
from quorumlab.functions import text as T
from quorumlab.operators.extremes import two_ended
from quorumlab.sources.files import staged

CONTAINER = "(kind LIKE 'OBJECT<%' OR kind LIKE 'ARRAY<%')"


def walked(files: DataFrame) -> DataFrame:
    """Every member of every object and array of ``files`` (file, json): file, at, shape, keys, is_object, filled.

    ``at`` is the member's path with array indexes (``papers[0].reviews[2].body``), ``shape`` says for each step whether
    it is a key (k) or an index (i), ``keys`` has the keys alone. ``filled`` is false for null, false, zero and empty
    values. The walk goes level by level over VARIANT values, so any depth and any mix of types is read, and a level is
    one distributed step over what the level before has left; scalars are not handed on. Text that is no JSON has no
    members. Objects hold their keys in alphabetical order.
    """
    spark = files.sparkSession
    level = files.select("file", F.lit("").alias("at"), F.lit("").alias("shape"), F.expr("cast(array() as array<string>)").alias("keys"), F.expr("try_parse_json(json)").alias("v"))
    step = """
SELECT f.file, CASE WHEN e.key IS NULL THEN concat(f.at, '[', e.pos, ']') WHEN f.at = '' THEN e.key ELSE concat(f.at, '.', e.key) END AS at,
       concat(f.shape, CASE WHEN e.key IS NULL THEN 'i' ELSE 'k' END) AS shape, CASE WHEN e.key IS NULL THEN f.keys ELSE array_append(f.keys, e.key) END AS keys,
       e.value, schema_of_variant(e.value) AS kind
FROM {level} f, LATERAL variant_explode(f.v) AS e(pos, key, value)"""
    # the kind of a value is found once; containers are not written out to see whether they are empty
    step = f"""
SELECT file, at, shape, keys, kind LIKE 'OBJECT<%' AS is_object,
       ({CONTAINER} AND kind NOT IN ('OBJECT<>', 'ARRAY<VOID>')) OR to_json(value) NOT IN ('null', '""', '0', 'false', '[]', '{{{{}}}}') AS filled, CASE WHEN {CONTAINER} THEN value END AS v FROM ({step})"""
    found = []
    while True:
        level = staged(spark.sql(step, level=level), "json-level")
        found.append(level.drop("v"))
        level = level.where("v IS NOT NULL")
        if level.isEmpty():
            break
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


def normalized_files(files: DataFrame, listed: int = 50) -> DataFrame:
    """Per file of normalized papers: papers, reviews, keys beyond those allowed, the first forbidden paths and their
    number, papers with a pointer to a document, and whether the file passes. ``files``: file, json."""
    rows = walked(files)
    key = F.element_at("keys", -1)
    forbidden = F.col("shape").endswith("k") & F.lower(key).isin(*L.FORBIDDEN_KEYS)
    papers = (F.col("shape") == "ki") & (F.col("keys")[0] == "papers") & F.col("is_object")
    of_paper = (F.col("shape") == "kik") & (F.col("keys")[0] == "papers")
    of_review = (F.col("shape") == "kikik") & (F.col("keys")[0] == "papers") & (F.col("keys")[1] == "reviews")
    reviews = (F.col("shape") == "kiki") & (F.col("keys")[0] == "papers") & (F.col("keys")[1] == "reviews")
    extra = lambda where, allowed: F.array_join(F.array_sort(F.collect_set(F.when(where & ~key.isin(*allowed), key))), ",")
    counts = rows.groupBy("file").agg(
        F.count_if(papers).alias("paper_count"),
        F.count_if(reviews).alias("review_count"),
        extra(of_paper, L.PAPER_KEYS).alias("paper_extra_keys"),
        extra(of_review, L.REVIEW_KEYS).alias("review_extra_keys"),
        F.count_if(forbidden).alias("forbidden_path_count"),
        F.count_if(of_paper & (key == "pdf_url") & F.col("filled")).alias("pdf_url_pointer_count"),
    )
    hits = two_ended(rows.where(forbidden).select("file", F.lit(0).alias("first"), "at"), ["file"], "first", ["at"], lowest=listed)
    paths = hits.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("at")), ";").alias("forbidden_paths"))
    out = files.select("file", F.expr("try_parse_json(json) IS NULL").alias("unreadable")).join(counts, "file", "left").join(paths, "file", "left")
    numbers = {c: F.coalesce(c, F.lit(0)) for c in ("paper_count", "review_count", "forbidden_path_count", "pdf_url_pointer_count")}
    texts = {c: F.coalesce(c, F.lit("")) for c in ("paper_extra_keys", "review_extra_keys", "forbidden_paths")}
    status = F.when(F.col("unreadable"), "unreadable").when(F.col("forbidden_path_count") > 0, "failed").otherwise("ok")
    return out.withColumns(numbers | texts).withColumn("status", status).drop("unreadable")


def request_files(lines: DataFrame) -> DataFrame:
    """Per file of request lines (file, line): requests, those that hold each forbidden marker, and whether it passes."""
    rows = lines.where(T.clean_ws("line") != "").withColumn("low", F.lower("line"))
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("request_count"), *(F.count_if(F.contains("low", F.lit(m))).alias(m) for m in L.FORBIDDEN_MARKERS))
    hit = F.lit(False)
    for m in L.FORBIDDEN_MARKERS:
        hit = hit | (F.col(m) > 0)
    return counts.withColumn("status", F.when(hit, "failed").otherwise("ok"))
