"""Review corpora of different shapes to one record schema."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlab.functions import lexicons as L
from quorumlab.functions import text as T

RECORD = ("task_id", "dataset", "dimension", "input_text", "context_text", "gold_label", "predicted_label", "mapped_score")


def column_of(df: DataFrame, names: tuple[str, ...]) -> Column:
    """First non-empty of candidate columns, matched exactly, without case, then by letters and digits alone."""
    plain = lambda s: re.sub(r"[^a-z0-9]", "", s.lower())
    found = []
    for name in names:
        for same in (lambda a, b: a == b, lambda a, b: a.lower() == b.lower(), lambda a, b: plain(a) == plain(b)):
            found += [c for c in df.columns if same(c, name) and c not in found]
    values = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in found]
    return F.coalesce(*values, F.lit("")) if values else F.lit("")


def record(df: DataFrame, **fields: Column) -> DataFrame:
    return df.select(*(fields[k].alias(k) for k in RECORD))


def heuristic(row_text: Column, context: Column, dimension: str, gold: Column) -> Column:
    """A label by the rules of its dimension where a corpus brings no prediction; other dimensions repeat the gold label."""
    tokens, low = T.token_list(row_text), F.lower(context)
    if dimension == "actionability":
        return F.when(F.arrays_overlap(tokens, T.words_of(L.ACTION_TOKENS)), "actionable").otherwise("not_actionable")
    if dimension == "specificity":
        return F.when(F.arrays_overlap(tokens, T.words_of(L.SPECIFIC_TOKENS)), "specific").otherwise("vague")
    if dimension == "substantiation":
        return F.when(context != "", "substantiated").otherwise("unsubstantiated")
    if dimension == "rebuttal_robustness":
        settled = F.when(T.any_word(low, L.SETTLED_PHRASES), "resolved_or_weakened").when(T.any_word(low, L.HALF_SETTLED_PHRASES), "partially_addresses")
        return settled.when(context != "", "generic_or_unclear").otherwise("not_addressed")
    return gold


def generic(df: DataFrame, dataset: str, dimension: str, labels: dict[str, tuple[str, float]]) -> DataFrame:
    """Label, prediction, text and context by candidate column names; rows without text or known label are dropped.

    A prediction that the corpus brings is used if its label is known, else ``heuristic`` gives one.
    """
    text = column_of(df, ("input_text", "review_comment", "comment_text", "text", "claim"))
    context = column_of(df, ("context_text", "rebuttal_text", "context"))
    plain = lambda x: F.translate(F.lower(x), "- ", "__")
    gold = plain(column_of(df, ("gold_label", "label", "stance", "actionability_label")))
    names, scores = T.map_of({k: v[0] for k, v in labels.items()}), T.map_of({v[0]: v[1] for v in labels.values()})
    label = F.try_element_at(names, gold)
    whole = F.concat_ws(" ", *(F.col(f"`{c}`").cast("string") for c in df.columns))
    given = F.try_element_at(names, plain(column_of(df, ("predicted_label", "prediction"))))
    rows = record(
        df,
        task_id=F.concat_ws(":", F.lit(dataset), column_of(df, ("task_id", "id"))),
        dataset=F.lit(dataset),
        dimension=F.lit(dimension),
        input_text=text,
        context_text=context,
        gold_label=label,
        predicted_label=F.coalesce(given, heuristic(whole, context, dimension, label)),
        mapped_score=F.try_element_at(scores, label),
    )
    return rows.where((F.col("input_text") != "") & F.col("gold_label").isNotNull())


def pairs(df: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Premise and hypothesis pairs: gold polarity and three baselines."""
    # each token set is computed once: a column of its own is not repeated in what refers to it
    df = df.withColumns({"a_tokens": T.plain_tokens("premise"), "b_tokens": T.plain_tokens("hypothesis")})
    df = df.withColumn("common", F.size(F.array_intersect("a_tokens", "b_tokens")))
    union = F.size("a_tokens") + F.size("b_tokens") - F.col("common")
    df = df.withColumn("overlap", F.when(union > 0, F.round(F.col("common") / union, 4)).otherwise(0.0))
    overlap = F.col("overlap")
    gold = F.when(F.lower("label").isin("c", "contradiction", "1"), "contradiction").otherwise("no_contradiction")
    polarity = F.when(F.col("s1") != F.col("s2"), "contradiction").otherwise("no_contradiction")
    by_overlap = F.when(overlap >= threshold, "contradiction").otherwise("no_contradiction")
    return df.select("pair_id", gold.alias("gold_label"), "overlap", polarity.alias("polarity"), F.lit("no_contradiction").alias("majority"), by_overlap.alias("by_overlap"))


def spans(df: DataFrame) -> DataFrame:
    """Evaluation spans with the justifications of their pair key: substantiated or not.

    ``df``: id, review, label array<struct<start, stop, tag>>.
    """
    # an outer explode, as Spark computes the array of an inner one a second time to drop empty ones
    # texts are cut before rows multiply, so that no row carries the whole review
    cut = lambda s: F.struct(s["tag"].alias("tag"), F.trim(F.substring("review", s["start"] + 1, s["stop"] - s["start"])).alias("text"))
    rows = df.select("id", F.posexplode_outer(F.transform("label", cut)).alias("pos", "s")).select("id", "pos", "s.*")
    rows = rows.where("text <> ''").withColumn("key", F.regexp_replace("tag", "^[A-Za-z]+_", ""))
    # evaluations and justifications of a pair meet in one group, so texts are cut and shuffled once
    each = {"claims": F.when(F.col("tag").startswith("Eval_"), F.struct("tag", "text")), "proof": F.when(F.col("tag").startswith("Jus_"), F.struct("pos", "text"))}
    pairs = rows.groupBy("id", "key").agg(*(F.collect_list(x).alias(c) for c, x in each.items())).where("size(claims) > 0")
    proof = F.when(F.col("id").isNotNull() & (F.size("proof") > 0), F.array_join(F.transform(F.array_sort("proof"), lambda x: x["text"]), " "))
    found = pairs.select("id", proof.alias("evidence"), F.inline("claims"))
    label = F.when(F.col("evidence").isNull(), "unsubstantiated").otherwise("substantiated")
    return found.select("id", "tag", "text", F.coalesce("evidence", F.lit("")).alias("evidence"), label.alias("gold_label"))


def alignments(review: DataFrame, rebuttal: DataFrame) -> DataFrame:
    """Review sentences with the rebuttal sentences aligned to them, and how far these go towards the point.

    ``review``: doc, sentence. ``rebuttal``: doc, pos, targets (array of sentences), action, stance, text. The context
    is the aligned texts in order, repeated ones once; cases of actions and stances don't count.
    """
    plain = lambda c: F.lower(T.clean_ws(c))
    each = rebuttal.select("doc", F.explode("targets").alias("sentence"), "pos", plain("action").alias("action"), plain("stance").alias("stance"), T.clean_ws("text").alias("text"))
    some = lambda c, words: F.max(F.col(c).isin(*words))
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("pos", "text")))), lambda x: x["text"])
    found = each.groupBy("doc", "sentence").agg(
        F.count(F.lit(1)).alias("n"),
        some("action", L.SETTLING_ACTIONS).alias("settled"),
        some("stance", L.ANSWERING_STANCES).alias("answered"),
        some("action", L.HALF_ACTIONS).alias("half"),
        F.array_join(F.array_distinct(texts), "\n").alias("context"),
    )
    label = (
        F.when(F.col("n").isNull(), "not_addressed")
        .when(F.col("settled"), "resolved_or_weakened")
        .when(F.col("answered"), "specifically_addressed")
        .when(F.col("half"), "partially_addresses")
        .otherwise("generic_or_unclear")
    )
    rows = review.join(found, ["doc", "sentence"], "left")
    return rows.select("doc", "sentence", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("context", F.lit("")).alias("context_text"), label.alias("gold_label"))


def argument_pairs(lines: DataFrame) -> DataFrame:
    """Tagged lines (text, role, pair tag, side, group) to pairs with both sides' text in line order.

    ``lines``: line_no, line.
    """
    part = F.split("line", "\t")
    rows = lines.where(F.size(part) >= 5).select("line_no", F.trim(part[0]).alias("text"), F.trim(part[2]).alias("tag"), F.lower(F.trim(part[3])).alias("side"), F.trim(part[4]).alias("group"))
    rows = rows.withColumn("pair", F.when(F.col("tag").isin("", "O"), "").otherwise(F.regexp_replace("tag", "^[^-]*-", "")))
    rows = rows.where("text <> '' and pair <> '' and side in ('review', 'reply')")
    side = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("line_no", "text")))), lambda x: x["text"]), " ")
    out = rows.groupBy("group", "pair").agg(side("review").alias("review"), side("reply").alias("reply"))
    return out.where("review <> ''").withColumn("is_pair", F.col("reply") != "")
