"""Token-overlap and BM25 retrieval as inverted-index joins.

Queries and candidates meet on rare tokens only, so pairs without a common token never exist; what those give
bounds which further tokens a better candidate must have, and the last step keeps k rows of each query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlab.functions import lexicons as L
from quorumlab.functions import text as T
from quorumlab.sources.files import staged

K1, B = 1.4, 0.75


def least_common(t: Column, n: Column, size: Column) -> Column:
    """How many tokens sets of ``n`` and ``size`` must share for a Jaccard similarity of ``t``; one at least."""
    return F.greatest(F.ceil(t * (n + size) / (1 + t) - 1e-9), F.lit(1))


def token_sets(texts: DataFrame, text: str, *facts: str) -> DataFrame:
    """``facts`` of the texts with their token sets (``own``) and the names of these (``set_id``), staged."""
    rows = texts.select(*facts, T.token_set(text).alias("own"))
    return staged(rows.withColumn("set_id", F.md5(F.array_join("own", " "))), "token-sets")


def memory_topk(queries: DataFrame, memory: DataFrame, k: int = 5, rare: int = 20, *, near: float = 2.0, spare_hits: int = 2, sets: DataFrame | None = None) -> DataFrame:
    """Per (query, dimension) the k memories of highest Jaccard similarity, then score, then ordinal.

    ``queries``: query_id, query_text. ``memory``: memory_id, ord, dimension, input_text, mapped_score, gold_label. Where
    memories share texts, ``sets`` (of ``token_sets``: set_id, own) has them once, and ``memory`` has set_id for input_text.

    Equal token sets are indexed once, and only their k best members of a dimension are kept. The index has the tokens of
    queries only, as numbers; their list, the tokens asked for and the like are staged, so that Spark knows their sizes
    and need not move the index to small ones. Postings carry a class of
    the set's size (four to a doubling). Each query keeps the k-th best similarity of each dimension, t. A set of s tokens
    reaches t with a query of n only by ``c = t (n + s) / (1 + t)`` common tokens; so of a query's tokens, ordered from
    the rarest, all but the last c - p are joined with the postings of a size class, and pairs that meet fewer than
    p = ``spare_hits`` times are left out. Large sets need many common tokens, so they meet on rare ones only, and classes
    that need more than the query has are not joined. Bounds come from three passes: the tokens with up to ``rare``
    postings together; sets up to ``near`` times the query's size; the larger ones. What passes is verified by all indexed
    tokens, so results are exact. Memories without a common token have similarity 0 and fill up where a query has fewer
    than k others; only the first 2k - 1 of each dimension, a short list, can be needed for that. Queries without tokens
    get nothing; dimensions are few by nature (a list on the driver).
    """
    facts = ["memory_id", "ord", "dimension", "mapped_score", "gold_label"]
    if sets is None:
        memory = sets = token_sets(memory, "input_text", *facts)
    m = memory.select("set_id", *facts)
    merit = Window.partitionBy("set_id", "dimension").orderBy(F.desc("mapped_score"), "ord")
    members = m.withColumn("n", F.row_number().over(merit)).where(F.col("n") <= k).drop("n")
    members = staged(members, "memory-members")
    q = staged(queries.select("query_id", F.array_distinct(T.token_list("query_text")).alias("tokens")).where(F.size("tokens") > 0), "query-tokens")
    asked_tokens = q.select("query_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    vocabulary = staged(asked_tokens.select("token").distinct().withColumn("number", F.monotonically_increasing_id()), "query-vocabulary")
    lower_bits = "greatest(length(bin(size)) - 3, 0)"
    low = F.expr(f"shiftleft(shiftright(size, {lower_bits}), {lower_bits})")
    tokens = sets.select("set_id", F.size("own").alias("size"), F.explode("own").alias("token")).join(vocabulary, "token")
    sets = tokens.groupBy("set_id", "size").agg(F.collect_set("number").alias("own")).withColumn("low", low)
    sets = staged(sets.withColumn("set_no", F.monotonically_increasing_id()), "memory-sets")
    index = sets.select("set_no", "size", "low", F.explode("own").alias("number"))
    frequency = index.groupBy("number").agg(F.count(F.lit(1)).alias("df"))
    # a query's tokens that some memory has, the rarest first
    known = asked_tokens.join(vocabulary, "token").join(frequency, "number")
    order = Window.partitionBy("query_id").orderBy("df", "token")
    places = {"place": F.row_number().over(order), "postings": F.sum("df").over(order), "known": F.count(F.lit(1)).over(Window.partitionBy("query_id"))}
    known = staged(known.withColumns(places).drop("token"), "query-places")
    q_known = staged(known.groupBy("query_id", "n").agg(F.collect_list("number").alias("numbers")), "query-numbers")
    # the first 2k - 1 memories of each dimension
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("mapped_score"), "ord"))
    spare = staged(members.select(*facts).withColumn("rn", rank).where(F.col("rn") <= 2 * k - 1).drop("rn"), "memory-spares")
    fill = q.select("query_id").crossJoin(F.broadcast(spare))
    listed = {r["dimension"] for r in spare.select("dimension").distinct().collect()}
    dimensions = F.array(*(F.lit(d) for d in sorted(listed, key=str))).cast(f"array<{m.schema['dimension'].dataType.simpleString()}>")
    classes = staged(members.select("set_id", "dimension").join(sets.select("set_id", "low"), "set_id").select("dimension", "low").distinct(), "memory-classes")
    best = Window.partitionBy("query_id", "dimension").orderBy(F.desc("similarity"), F.desc("mapped_score"), "ord")
    names = ["query_id", *facts, "similarity"]

    def first_k(rows: DataFrame) -> DataFrame:
        return rows.select(*names).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def verified(pairs: DataFrame) -> DataFrame:
        """The k best members of the paired sets, by all tokens that they can share."""
        both = pairs.join(q_known, "query_id").join(sets.select("set_no", "set_id", "size", "own"), "set_no").withColumn("common", F.size(F.array_intersect("numbers", "own")))
        similarity = T.round4(F.col("common") / (F.col("n") + F.col("size") - F.col("common")))
        return first_k(both.select("query_id", "set_id", similarity.alias("similarity")).join(members, "set_id"))

    def met(found: DataFrame, sizes: Column) -> DataFrame:
        """Pairs of the size classes ``sizes`` that can still reach the k-th best of ``found``."""
        bounds = found.groupBy("query_id", "dimension").agg(F.count(F.lit(1)).alias("rows"), F.min("similarity").alias("t"))
        each = known.where("place = 1").select("query_id", "n", "known", F.explode(dimensions).alias("dimension"))
        # similarities are rounded to four decimals, so a tie with the bound may lie below it by as much
        t = F.when(F.col("rows") == k, F.greatest(F.col("t") - 0.0001, F.lit(0.0))).otherwise(0.0)
        need = each.join(bounds, ["query_id", "dimension"], "left").withColumn("t", t).join(classes, "dimension").where(sizes)
        need = need.groupBy("query_id", "n", "known", "low").agg(F.min("t").alias("t")).withColumn("need", least_common(F.col("t"), F.col("n"), F.col("low")))
        need = need.where(F.col("need") <= F.col("known")).withColumn("hits", F.least("need", F.lit(spare_hits)))
        asked = known.select("query_id", "number", "place").join(need, "query_id").where(F.col("place") <= F.col("known") - F.col("need") + F.col("hits"))
        asked = staged(asked.select("query_id", "number", "low", "n", "t", "need", "hits"), "query-bounds")
        seen = index.join(asked, ["number", "low"]).groupBy("query_id", "set_no").agg(F.count(F.lit(1)).alias("c"), *(F.first(x).alias(x) for x in ("n", "t", "need", "hits", "size")))
        enough = (F.col("c") >= F.col("hits")) & (F.col("c") + F.col("need") - F.col("hits") >= least_common(F.col("t"), F.col("n"), F.col("size")))
        return seen.where(enough).select("query_id", "set_no")

    rarest = known.where((F.col("place") == 1) | (F.col("postings") <= rare)).select("query_id", "number")
    found = staged(verified(index.join(rarest, "number").select("query_id", "set_no").distinct()), "best-memories")
    for sizes in (F.col("low") <= near * F.col("n"), F.col("low") > near * F.col("n")):
        more = verified(met(found, sizes)).join(found.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti")
        found = staged(first_k(found.select(*names).unionByName(more.select(*names))), "best-memories")
    fill = fill.join(found.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti").withColumn("similarity", F.lit(0.0))
    return first_k(found.select(*names).unionByName(fill.select(*names)))


def memory_prior(found: DataFrame) -> DataFrame:
    """Similarity-weighted mean score of each (query, dimension); the plain mean where all weights are 0."""
    weight = F.sum("similarity")
    prior = F.when(weight > 0, F.sum(F.col("mapped_score") * F.col("similarity")) / weight).otherwise(F.avg("mapped_score"))
    return found.groupBy("query_id", "dimension").agg(F.round(prior, 3).alias("prior"), F.count(F.lit(1)).alias("examples"), T.mean4("similarity").alias("mean_similarity"))


def hybrid(model: Column, prior: Column, weight: float = 0.6) -> tuple[Column, Column]:
    """(final score, source) of a model score and a memory prior, either of which may be missing."""
    final = F.when(model.isNull(), prior).when(prior.isNull(), model).otherwise(weight * model + (1.0 - weight) * prior)
    source = F.when(model.isNull() & prior.isNull(), "missing").when(model.isNull(), "memory_prior").when(prior.isNull(), "llm_only").otherwise("hybrid")
    return F.round(final, 3), source


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_weight(tf: Column, df: Column, n: Column, length: Column, mean_length: Column) -> Column:
    return idf(n, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.greatest(mean_length, F.lit(1.0))))


def expanded_terms(text: Column, kind: Column) -> Column:
    """Distinct query terms with hints of the claim's type and expansions, sorted."""
    hints = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in L.CLAIM_HINTS.items() for x in (F.lit(k), T.words_of(v)))), kind), F.array().cast("array<string>"))
    more = F.create_map(*(x for k, v in L.QUERY_EXPANSIONS.items() for x in (F.lit(k), T.words_of(v))))
    base = F.array_union(F.array_distinct(T.token_list(text)), hints)
    extra = F.flatten(F.transform(base, lambda t: F.coalesce(F.try_element_at(more, t), F.array().cast("array<string>"))))
    return F.array_sort(F.array_union(base, extra))


def section_weight(section: Column, source_type: Column, kind: Column) -> Column:
    low = F.lower(section)
    weight = F.when(low == "title", 0.6).otherwise(1.0) * F.when(source_type == "rebuttal", 1.08).otherwise(1.0)
    weight = weight * F.when((source_type == "appendix") | F.contains(low, F.lit("appendix")), 1.12).otherwise(1.0)
    hinted = F.lit(False)
    for k, words in L.CLAIM_HINTS.items():
        hinted = hinted | ((kind == k) & T.any_word(low, words))
    weight = weight * F.when(hinted, 1.25).otherwise(1.0)
    weight = weight * F.when(kind.isin("ablation", "baseline", "experiment") & T.any_word(low, ("experiment", "result", "evaluation", "table", "appendix")), 1.2).otherwise(1.0)
    return weight * F.when((kind == "methodology") & T.any_word(low, ("method", "model", "approach", "algorithm")), 1.2).otherwise(1.0)


def bm25_evidence(claims: DataFrame, sections: DataFrame, k: int = 3) -> DataFrame:
    """The k best sections of each claim's own paper. A claim has one paper; of a paper's rows the token lists lie in one task.

    ``claims``: task_id, paper_id, claim_text, claim_type. ``sections``: paper_id, section_id, section, source_type, text.
    """
    terms = expanded_terms(F.col("claim_text"), F.col("claim_type"))
    tokens = T.token_list(F.concat_ws(" ", "section", "section", "text"))
    asked = claims.select("paper_id", F.lit(True).alias("asks"), F.col("task_id").alias("id"), F.col("claim_type").alias("name"), F.lit(None).cast("string").alias("source"), terms.alias("tokens"))
    held = sections.select("paper_id", F.lit(False).alias("asks"), F.col("section_id").alias("id"), F.col("section").alias("name"), F.col("source_type").alias("source"), tokens.alias("tokens"))
    # claims and sections are dealt by paper once; all later groups lie inside a paper, so terms are never shuffled
    rows = asked.unionByName(held).where("paper_id is not null").repartition("paper_id").withColumn("size", F.size("tokens"))
    paper = Window.partitionBy("paper_id")
    rows = rows.withColumns({"n_docs": F.count_if(~F.col("asks")).over(paper), "mean_length": F.avg(F.when(~F.col("asks"), F.col("size"))).over(paper)})
    facts = ["asks", "id", "name", "source", "size", "n_docs", "mean_length"]
    counts = rows.select("paper_id", *facts, F.explode("tokens").alias("term")).groupBy("paper_id", "term", *facts).agg(F.count(F.lit(1)).alias("tf"))
    claim = F.struct(F.col("id").alias("task_id"), F.col("name").alias("claim_type"), F.col("size").alias("n_terms"))
    section = F.struct(F.col("id").alias("section_id"), F.col("name").alias("section"), F.col("source").alias("source_type"), F.col("size").alias("length"), "tf")
    sides = {"claim": F.collect_list(F.when(F.col("asks"), claim)), "held": F.collect_list(F.when(~F.col("asks"), section))}
    met = counts.groupBy("paper_id", "term", "n_docs", "mean_length").agg(*(v.alias(k) for k, v in sides.items())).where("size(claim) > 0 and size(held) > 0")
    hits = met.withColumn("df", F.size("held")).withColumn("held", F.explode("held")).withColumn("claim", F.explode("claim"))
    hits = hits.select("paper_id", "claim.*", "held.*", term_weight(F.col("held.tf"), F.col("df"), F.col("n_docs"), F.col("held.length"), F.col("mean_length")).alias("w"))
    found = hits.groupBy("paper_id", "task_id", "claim_type", "n_terms", "section_id", "section", "source_type").agg(F.round(F.sum("w"), 6).alias("raw"), F.count(F.lit(1)).alias("matched"))
    score = F.col("raw") * section_weight(F.col("section"), F.col("source_type"), F.col("claim_type")) * (0.75 + 0.25 * F.col("matched") / F.col("n_terms"))
    found = found.withColumn("weighted", score).withColumn("score", F.round(F.col("weighted") / (F.col("weighted") + 3.0), 3))
    order = Window.partitionBy("paper_id", "task_id").orderBy(F.desc("score"), "section_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.withColumn("verdict", F.when(F.col("score") >= 0.45, "supporting_candidate").otherwise("partial_candidate"))


def evidence_verdict(claims: DataFrame, best: DataFrame) -> DataFrame:
    """Verdict of each claim from its first evidence row."""
    first = best.where("rank = 1").select("task_id", "section", "score", "matched")
    rows = claims.select("task_id", "claim_text", "claim_type").join(first, "task_id", "left")
    absent = T.any_word(F.lower("claim_text"), L.ABSENCE_WORDS) & (F.col("section") != "title") & (F.col("score") >= 0.35) & (F.col("matched") >= 2)
    verdict = (
        F.when(F.col("claim_type").isin(*L.EXPERT_TYPES), "needs_human_check")
        .when(F.col("score").isNull(), "insufficient")
        .when(absent, "possibly_contradicted")
        .when(F.col("score") >= 0.62, "supported")
        .when(F.col("score") >= 0.35, "partially_supported")
        .otherwise("insufficient")
    )
    return rows.select("task_id", verdict.alias("verdict"))


#: Rows of one block of cases, and partial weights that a task holds at a time.
CASES, HELD = 131_072, 2_000_000


def kth_best(query: np.ndarray, score: np.ndarray, queries: int, k: int) -> np.ndarray:
    """The k-th best score of each of the queries 0 to ``queries`` - 1 (sorted), 0 where there are fewer."""
    if not len(query):
        return np.zeros(queries)
    order = np.argsort(query * (score.max() + 1.0) - score)
    begins = np.searchsorted(query, np.arange(queries))
    counts = np.diff(np.append(begins, len(query)))
    return np.where(counts >= k, score[order[np.minimum(begins + k - 1, len(query) - 1)]], 0.0)


def best_cases(asked: pa.Table, held: pa.Table, k: int, rare: int, bonus: float) -> tuple[np.ndarray, ...]:
    """(row of ``asked``, row of ``held``, summed weights) of the cases that can be among a query's k best of ``held``.

    The weights of common terms are summed for one batch of queries after another: those of the ``rare`` rarest terms for
    a bound, those of all terms that can lift a case over it, and the other terms' for the cases that these leave. Cases
    within the rounding of the k-th best score stay, of equal ones the k first by their id.
    """

    def flat(rows: pa.Table, name: str) -> np.ndarray:
        return rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)

    def codes(name: str) -> tuple[np.ndarray, np.ndarray]:
        both = pa.concat_arrays([c for rows in (asked, held) for c in rows.column(name).chunks]).dictionary_encode().indices
        numbers = both.fill_null(-1).to_numpy(zero_copy_only=False)
        return numbers[: len(asked)], numbers[len(asked) :]

    (paper, own_paper), (kind, own_kind) = codes("paper_id"), codes("claim_type")
    place = pc.rank(held.column("case_id"), tiebreaker="first").to_numpy()
    length, mean = held.column("length").to_numpy(), np.maximum(asked.column("mean_length").to_numpy(), 1.0)
    # postings by term, then case; ``at_term`` numbers the terms from 0
    number = flat(held, "number")
    order = np.argsort(number, kind="stable")
    doc = np.repeat(np.arange(len(held)), pc.list_value_length(held.column("number")).to_numpy())[order]
    number, tf = number[order], flat(held, "tf")[order]
    at_term = np.cumsum(np.append(False, number[1:] != number[:-1]))
    postings = at_term * len(held) + doc
    terms, idf, ceiling = flat(asked, "number"), flat(asked, "idf"), flat(asked, "ceiling")
    first = np.searchsorted(number, terms, "left")
    n = np.searchsorted(number, terms, "right") - first
    sizes = pc.list_value_length(asked.column("number")).to_numpy()
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(asked)), sizes)
    nth = np.arange(len(terms)) - (ends - sizes)[owner]
    total = np.cumsum(ceiling)
    rest = total[ends - 1][owner] - total + ceiling  # no case has more by this and the later terms
    load = np.append(0, np.cumsum(n))
    loads = load[ends]

    def weighed(term: np.ndarray, case: np.ndarray, count: np.ndarray) -> np.ndarray:
        return idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * length[case] / mean[owner[term]]))

    def extra(query: np.ndarray, case: np.ndarray) -> np.ndarray:
        return np.where((kind[query] == own_kind[case]) & (own_kind[case] >= 0), bonus, 0.0)

    def summed(some: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query, case, weight) over the postings of the terms ``some``, cases of the query's own paper left out."""
        term = np.repeat(some, n[some])
        at = np.arange(len(term)) - np.repeat(np.cumsum(n[some]) - n[some], n[some]) + first[term]
        other = paper[owner[term]] != own_paper[doc[at]]
        term, at = term[other], at[other]
        pair = owner[term] * len(held) + doc[at]
        order = np.argsort(pair, kind="stable")
        pair, weight = pair[order], weighed(term, doc[at], tf[at])[order]
        if not len(pair):
            return pair, pair, weight
        heads = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        return *np.divmod(pair[heads], len(held)), np.add.reduceat(weight, heads)

    out, done = [(owner[:0], doc[:0], idf[:0])], 0
    while done < len(asked):
        base, start = done, ends[done] - sizes[done]
        done = max(done + 1, int(np.searchsorted(loads, load[start] + HELD, "right")))
        some = np.arange(start, ends[done - 1])
        query, case, raw = summed(some[nth[some] < rare])
        bound = kth_best(query - base, raw + extra(query, case), done - base, k)
        lifts = rest[some] + bonus + 0.001 >= bound[owner[some] - base]
        query, case, raw = summed(some[lifts])
        # the other terms of a query are its last ones
        late = np.bincount(owner[some[~lifts]] - base, minlength=done - base)
        over = np.where(late > 0, rest[np.minimum(ends[base:done] - late, len(rest) - 1)], 0.0)
        left = raw + extra(query, case) + over[query - base] + 0.001 >= bound[query - base]
        query, case, raw = query[left], case[left], raw[left]
        times = late[query - base]
        pair = np.repeat(np.arange(len(query)), times)
        term = np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(ends[query] - times, times)
        pair, term = pair[n[term] > 0], term[n[term] > 0]
        wanted = at_term[first[term]] * len(held) + case[pair]
        at = np.minimum(np.searchsorted(postings, wanted), len(postings) - 1)
        pair, term, at = (x[postings[at] == wanted] for x in (pair, term, at))
        raw = raw + np.bincount(pair, weighed(term, case[pair], tf[at]), len(query))
        score = raw + extra(query, case)
        near = np.flatnonzero(score >= kth_best(query - base, score, done - base, k)[query - base] - 0.00011)
        near = near[np.lexsort((place[case[near]], -score[near], query[near]))]
        fresh = np.append(True, (np.diff(query[near]) != 0) | (np.diff(score[near]) != 0))[: len(near)]
        begun = np.maximum.accumulate(np.where(fresh, np.arange(len(near)), 0))
        near = near[np.arange(len(near)) - begun < k]
        out.append((query[near], case[near], raw[near]))
    return tuple(np.concatenate(x) for x in zip(*out))


def case_retrieval(cases: DataFrame, k: int = 5, rare: int = 3, bonus: float = 0.18, *, block_rows: int = CASES) -> DataFrame:
    """BM25 over labelled cases with a bonus for an equal type, leaving out the query's own paper.

    Corpus statistics of a query are the global ones less those of its paper, so none is recomputed. Every case is a
    query: cases are dealt to blocks, queries to slices, and each (block, slice) is one group that weighs common terms in
    memory (``best_cases``) and hands on the k best of each query; pairs of cases are never shuffled. A group has about
    ``block_rows`` cases and no more queries; groups count with the square of the table, as the exact search does. ``cases``: case_id, paper_id, claim_type, text, label. Cases without tokens find nothing and are not found.
    """
    docs = staged(cases.withColumn("tokens", T.token_list("text")).withColumn("length", F.size("tokens")), "cases")
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("len")).first()
    n_all, len_all = total["n"], total["len"] or 0
    own = docs.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_own"), F.sum("length").alias("len_own"))
    facts = ["case_id", "paper_id", "claim_type", "label", "length"]
    counts = docs.select(*facts, F.explode("tokens").alias("term")).groupBy(*facts, "term").agg(F.count(F.lit(1)).alias("tf"))
    counts = staged(counts, "case-terms")
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df_all"), F.max("tf").alias("most"))
    df = staged(df.withColumn("number", F.monotonically_increasing_id()), "case-term-numbers")
    df_own = counts.groupBy("term", "paper_id").agg(F.count(F.lit(1)).alias("df_own"))
    others = F.lit(n_all) - F.col("n_own")
    mean = (F.lit(len_all) - F.col("len_own")) / F.greatest(others, F.lit(1))
    rows = counts.join(df, "term").join(df_own, ["term", "paper_id"]).join(own, "paper_id")
    # a term that no other paper has is met by no query and in no case
    rows = rows.withColumn("df", F.col("df_all") - F.col("df_own")).where("df > 0").withColumn("mean_length", mean)
    # no case weighs a term more than one of the term's largest count and no length
    ceiling = term_weight(F.col("most"), F.col("df"), others, F.lit(0), F.col("mean_length"))
    term = F.struct("df", "number", F.col("tf").cast("double").alias("tf"), idf(others, F.col("df")).alias("idf"), ceiling.alias("ceiling"))
    rows = rows.groupBy(*facts, "mean_length").agg(F.sort_array(F.collect_list(term)).alias("terms"))
    rows = staged(rows.select(*facts, "mean_length", "terms.number", "terms.tf", "terms.idf", "terms.ceiling"), "case-rows")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n_all // block_rows))
    slices = max(blocks, -(-3 * cores // blocks))

    def dealt(side: DataFrame, own_part: str, n_own: int, other: str, n_other: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other)
        # renewed columns, as both sides come from one table
        side = side.select(*(F.col(c).alias(c) for c in side.columns), F.pmod(F.xxhash64("case_id"), F.lit(n_own)).cast("int").alias(own_part), every)
        return side.repartition(2 * blocks * slices, "block", "slice").groupBy("block", "slice")

    held = dealt(rows.drop("mean_length", "idf", "ceiling"), "block", blocks, "slice", slices)
    asked = dealt(rows.drop("length", "tf"), "slice", slices, "block", blocks)

    def met(asked: pa.Table, held: pa.Table) -> pa.Table:
        q, c, raw = best_cases(asked, held, k, rare, bonus) if len(asked) and len(held) else ([], [], [])
        q, c = asked.take(pa.array(q, pa.int64())), held.take(pa.array(c, pa.int64()))
        named = {"query_id": q["case_id"], "query_type": q["claim_type"], "query_label": q["label"], **{n: c[n] for n in ("case_id", "claim_type", "label")}}
        return pa.table({**named, "raw": pa.array(raw, pa.float64())})

    kinds = {n: rows.schema[n].dataType.simpleString() for n in facts}
    names = {"query_id": "case_id", "query_type": "claim_type", "query_label": "label", "case_id": "case_id", "claim_type": "claim_type", "label": "label"}
    found = asked.cogroup(held).applyInArrow(met, ", ".join(f"{n} {kinds[c]}" for n, c in names.items()) + ", raw double")
    same = F.when(F.col("claim_type") == F.col("query_type"), bonus).otherwise(0.0)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "case_id")
    return found.withColumn("score", F.round(F.col("raw") + same, 4)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def chance(positives: Column, n: Column, k: int) -> Column:
    """The probability that k of n rows drawn without return have a positive one: 1 - C(n - p, k) / C(n, k).

    The quotient is the product of (n - p - i) / (n - i) over i < k, exact for any n that a long holds."""
    draws = F.least(F.lit(k).cast("bigint"), n)
    miss = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), F.greatest(draws - 1, F.lit(0).cast("bigint"))),
        F.lit(1.0),
        lambda left, i: left * F.greatest(n - positives - i, F.lit(0).cast("bigint")) / F.greatest(n - i, F.lit(1).cast("bigint")),
    )
    return F.when((n <= 0) | (positives <= 0), 0.0).otherwise(1 - miss)


def retrieval_metrics(found: DataFrame, cases: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Per label: queries, hit rate at k, mean reciprocal rank, the share whose majority label among k is right (ties:
    the label met first), the hit rate of k random cases of other papers, and the share of the largest label.

    ``found``: query_id, query_label, label, rank. ``cases``: case_id, paper_id, label. Queries are the cases. The random
    rate is computed once for each (paper, label), as all of its queries draw from the same counts.
    """
    found = staged(found.select("query_id", "query_label", "label", "rank"), "found-cases")
    hit = F.col("label") == F.col("query_label")
    per = found.groupBy("query_id", "query_label").agg(F.min(F.when(hit, F.col("rank"))).alias("first"))
    votes = found.groupBy("query_id", "label").agg(*(F.count_if(F.col("rank") <= k).alias(f"n_{k}") for k in ks), F.min("rank").alias("met"))
    major = votes.groupBy("query_id").agg(*(F.max(F.struct(F.col(f"n_{k}").alias("n"), (-F.col("met")).alias("met"), "label"))["label"].alias(f"major_{k}") for k in ks))
    rows = per.join(major, "query_id")
    rates = rows.groupBy("query_label").agg(
        F.count(F.lit(1)).alias("queries"),
        *(T.rate(F.coalesce(F.col("first") <= k, F.lit(False))).alias(f"hit_{k}") for k in ks),
        F.round(F.avg(F.coalesce(F.round(1.0 / F.col("first"), 4), F.lit(0.0))), 3).alias("mrr"),
        *(T.rate(F.col(f"major_{k}") == F.col("query_label")).alias(f"majority_accuracy_{k}") for k in ks),
    )
    own = staged(cases.groupBy("paper_id", "label").agg(F.count(F.lit(1)).alias("own")), "cases-of-papers")
    paper = own.groupBy("paper_id").agg(F.sum("own").alias("of_paper"))
    label = own.groupBy("label").agg(F.sum("own").alias("of_label"))
    total = own.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0]
    drawn = own.join(paper, "paper_id").join(label, "label").withColumns({"n": F.lit(total) - F.col("of_paper"), "positives": F.col("of_label") - F.col("own")})
    drawn = drawn.groupBy("label", "n", "positives").agg(F.sum("own").alias("queries"))  # papers of equal counts are one
    mean = [F.round(F.sum(chance(F.col("positives"), F.col("n"), k) * F.col("queries")) / F.sum("queries"), 4).alias(f"random_{k}") for k in ks]
    drawn = drawn.groupBy(F.col("label").alias("query_label")).agg(*mean)
    largest = label.agg(F.round(F.max("of_label") / max(total, 1), 4).alias("majority_baseline")).first()["majority_baseline"]
    return rates.join(drawn, "query_label").withColumn("majority_baseline", F.lit(largest))


def graded(claims: DataFrame, records: DataFrame, k: int = 3) -> DataFrame:
    """Candidate records of each claim's paper: 10 per common term and a tenth of up to 50 citations; no common term, no place."""
    left = claims.select("task_id", "paper_id", T.plain_tokens("claim_text").alias("terms"))
    right = records.select("paper_id", "record_id", "citations", T.plain_tokens("text").alias("own"))
    rows = left.join(right, "paper_id").withColumn("overlap", F.size(F.array_intersect("terms", "own"))).where("overlap > 0")
    rows = rows.withColumn("grade", F.round(10 * F.col("overlap") + F.least("citations", F.lit(50)) / 10.0, 4))
    order = Window.partitionBy("task_id").orderBy(F.desc("grade"), "record_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
