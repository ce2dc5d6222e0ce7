"""Conversation repair, nearest neighbours and lexical search against brute force and the second engine."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlab.llm import forest, lexical, queries, repair

TALK = "conv_id bigint, turn bigint, role string, text string"


def same_rows(df, sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame.toArrow())
    theirs = con.sql(sql)
    names = sorted(theirs.columns)
    assert names == sorted(df.columns)
    at = [theirs.columns.index(c) for c in names]
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in theirs.fetchall())


# conversation repair


def all_repairs(codes, entry, leave, budget):
    """Every (cost, audit) within ``budget``, by trying all edits."""
    found = []

    def go(i, state, cost, audit):
        if cost > budget:
            return
        if i == len(codes):
            if state == leave:
                found.append((cost, audit))
            return
        go(i, repair.NEXT[state]["a" if state == 2 else "u"], cost + 2, audit + "I")
        go(i + 1, state, cost + 3, audit + "D")
        if codes[i] != "-":
            late = codes[i].isupper()
            for role, after in repair.NEXT[state].items():
                if role == codes[i].lower():
                    go(i + 1, after, cost + late, audit + "K")
                if role in "ua":
                    go(i + 1, after, cost + 2 + late, audit + "R")

    go(0, entry, 0, "")
    return min(found, default=None)


@pytest.mark.parametrize("seed", range(4))
def test_search_finds_the_cheapest_and_least_audit(seed):
    rng = random.Random(seed)
    for _ in range(60):
        codes = "".join(rng.choice("suaoSUAO-") for _ in range(rng.randint(1, 5)))
        for entry, leave in itertools.product(repair.STATES, repair.STATES):
            assert repair.searched(codes, entry, leave) == all_repairs(codes, entry, leave, 3 * len(codes) + 4), (codes, entry, leave)


def test_bounds_never_exceed_what_a_suffix_costs():
    rng = random.Random(9)
    for _ in range(80):
        codes = "".join(rng.choice("suaoSUAO-") for _ in range(rng.randint(1, 5)))
        bounds = repair.suffix_bounds(codes)
        for i in range(len(codes)):
            costs = [all_repairs(codes[i:], a, z, 20) for a in repair.STATES for z in repair.STATES]
            assert bounds[i] <= min(c[0] for c in costs if c)


def test_long_blocks_stay_cheap():
    rng = random.Random(3)
    codes = "".join(rng.choice("uuaasoUA-") for _ in range(400))
    cost, audit = repair.searched(codes, 0, 3)
    assert len(audit.replace("I", "")) == 400 and cost >= repair.suffix_bounds(codes)[0]


def odd_talks():
    rng = random.Random(5)
    rows = [
        (1, 0, "user", None), (1, 1, None, "who?"), (1, None, "assistant", "No."), (None, 0, "user", "hi."), (None, None, "user", "hi."),
        (2, 3, "user", "one."), (2, 3, "user", "one."), (2, 3, "assistant", "one."), (2, 9, "assistant", "x" * 100_000), (3, 1, "", " \n "),
        (4, 5, "user", "Ünïcode … end "), (4, 6, "assistant", "日本。"), (4, 7, "system", "late."), (5, 0, "system", "only."),
    ]
    for conv in range(10, 70):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b?", "c", "", "d!", "e"])))
    return rows


@pytest.mark.parametrize("block", [3, 64])
def test_repair_equals_second_engine(spark, block):
    talks = spark.createDataFrame(odd_talks(), TALK).withColumn("copies", F.lit("clash")).withColumn("audit", F.lit(1))
    found = repair.repair_report(talks, repair.damaged(talks), block=block)
    same_rows(found, queries.OP11_SQL, conversations=talks)


def test_one_conversation_with_most_rows(spark):
    rng = random.Random(2)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"{t}.") for t in range(3000)] + odd_talks()
    talks = spark.createDataFrame(rows, TALK)
    found = repair.repair_report(talks, repair.damaged(talks))
    same_rows(found, queries.OP11_SQL, conversations=talks)


def test_repaired_rows_are_a_legal_conversation(spark):
    talks = spark.createDataFrame(odd_talks(), TALK)
    rows = repair.diagnosed(repair.damaged(talks))
    out = repair.repaired(rows, repair.plans(rows)).collect()
    by = {}
    for r in out:
        by.setdefault(r["conv_id"], []).append(r)
    assert by
    for messages in by.values():
        messages.sort(key=lambda r: r["position"])
        assert re.fullmatch("s?(ua)+", "".join(r["role"][0] for r in messages))
        assert all(r["text"].strip(" \t\n\r\x0b\x0c") or r["edit"] == "insert" for r in messages)


def test_empty_conversations(spark):
    talks = spark.createDataFrame([], TALK)
    assert repair.repair_report(talks, repair.damaged(talks)).count() == 0


def test_a_conversation_whose_rows_all_go(spark):
    gone = [t for t in range(400) if zlib.crc32(f"5:{t}".encode()) % 20 == 0]
    talks = spark.createDataFrame([(5, t, "user", "x.") for t in gone], TALK)
    (row,) = repair.repair_report(talks, repair.damaged(talks)).collect()
    assert row["cost"] == row["gaps"] == 0 and row["audit"] == "" and row["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_damage(spark):
    talks = spark.createDataFrame([(1, t, "assistant", "A. b? c!") for t in range(200)], TALK)
    found = Counter((r["turn"], r["role"], r["text"]) for r in repair.damaged(talks).collect())
    for t in range(200):
        kind = zlib.crc32(f"1:{t}".encode()) % 20
        mine = {k: n for k, n in found.items() if k[0] == t}
        expected = {(t, "user" if kind == 4 else "assistant", {1: "", 2: "A b c"}.get(kind, "A. b? c!")): 2 if kind == 3 else 1}
        assert mine == ({} if kind == 0 else expected)


# nearest neighbours

VECTORS = "vec_id bigint, embedding array<float>"


def brute(rows, own, vector, k):
    def unit(v):
        v = np.array(v, float)
        return v / np.sqrt((v * v).sum())

    kept = {(i, tuple(v)) for i, v in rows if i != own and len(v) == len(vector)}
    scored = sorted(((float(unit(v) @ unit(vector)), i) for i, v in kept), key=lambda r: (-round(r[0], 12), r[1]))
    return scored[:k]


def test_neighbours_of_the_given_vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = [(r["vec_id"], r["embedding"]) for r in rows.collect()]
    found = {}
    for r in queries.op12_nearest_neighbours(spark, sf_dir).collect():
        found.setdefault(r["query_id"], []).append(r)
    asked = [v for v in vectors if v[0] % 50 == 0]
    assert sorted(found) == sorted(i for i, _ in asked)
    hit = 0
    for i, v in asked:
        mine = sorted(found[i], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        best = {j for _, j in brute(vectors, i, v, 5)}
        hit += len(best & {r["vec_id"] for r in mine})
    assert hit >= 0.9 * 5 * len(asked)


def test_neighbours_in_clusters_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 24))
    rows = [(i, (centres[i % 6] + 0.05 * rng.standard_normal(24)).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # a third are copies
    rows += [(2000, rows[7][1]), (2000, rows[7][1]), (2050, [1.0, 2.0]), (2051, [2.0, 4.0]), (2100, [1e30] * 24)]
    odd = [(3000, None), (3050, []), (3100, [0.0] * 24), (3150, [1.0, None] * 12), (3200, [float("nan")] * 24), (3250, [float("inf")] * 24), (None, rows[1][1])]
    table = spark.createDataFrame(rows + odd, VECTORS).withColumn("vector", F.lit("clash")).withColumn("block", F.lit(9))
    found = {}
    for r in forest.nearest(table, table.where("vec_id % 50 = 0"), per_block=200).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    asked = {i: v for i, v in rows if i % 50 == 0}
    assert set(found) == set(asked)
    hit = total = 0
    for i, v in asked.items():
        best = brute(rows, i, v, 5)
        assert sorted(found[i]) == list(range(1, len(best) + 1))
        mine = [found[i][n] for n in sorted(found[i])]
        scores = {j: s for s, j in brute(rows, i, v, 10_000)}
        assert all(math.isclose(s, scores[j], rel_tol=0, abs_tol=1e-12) for j, s in mine)
        hit += len({j for j, _ in mine} & {j for _, j in best})
        total += len(best)
    assert hit >= 0.97 * total
    assert [found[1000][n][0] for n in range(1, 6)] == [0, 1001, 1002, 1003, 1004]  # ties go to smaller ids


def test_neighbours_of_few_or_no_rows(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert forest.nearest(empty, empty).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], VECTORS)
    rows = forest.nearest(few, few.where("vec_id = 0")).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, 1, 0.0), (2, 2, -1.0)]


def test_a_forest_meets_every_vector_once():
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((500, 16))
    made = forest.Forest(vectors, [[i] for i in range(500)], trees=6)
    low, high = made.stretches(forest.units(vectors[:3]).astype(np.float32))
    for q in range(3):
        levels = list(made.levels(low[q], high[q]))
        met = np.concatenate([f for _, f in levels])
        assert sorted(met.tolist()) == list(range(500)) and q in levels[0][1] and levels[0][0] == forest.BITS
        made.mark[:] = False
        for length, nodes in levels[:4]:
            for n in nodes.tolist():
                strings = [made.hashed(made.near[[q, n]], t) for t in range(6)]
                assert any(int(a) >> (forest.BITS - length) == int(b) >> (forest.BITS - length) for a, b in strings)


# lexical search

DOC = "doc_id bigint, text string"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def odd_library():
    rng = random.Random(8)
    common, rare = ["the", "of", "and", "on"], [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choices(common, k=rng.randint(1, 40)) + rng.choices(rare, k=rng.randint(0, 6)))) for i in range(900)]
    docs += [(2000 + i, docs[3][1]) for i in range(400)]  # copies tie
    docs += [(5, docs[5][1]), (3000, None), (3001, ""), (3002, " .,; "), (None, "the w1 w2"), (3003, "the W1 " * 20_000), (3004, "Ünï ÜNÏ 日本 the_of w1-w2")]
    items = [(i, " ".join(rng.choices(common, k=3) + rng.choices(rare, k=4))) for i in range(30)]
    items += [(30, "the of and"), (31, None), (32, ""), (33, "absent words"), (34, "w1 w1 THE"), (34, "w1 w1 THE"), (34, "w2"), (None, "w1 日本 ünï")]
    return docs, items


@pytest.mark.parametrize("per_block", [100, 1 << 15])
def test_search_equals_second_engine(spark, per_block):
    docs, items = odd_library()
    docs = spark.createDataFrame(docs, DOC).withColumn("n", F.lit("clash")).withColumn("terms", F.lit(1))
    items = spark.createDataFrame(items, "item_id bigint, text string").withColumn("h", F.lit("clash"))
    same_rows(lexical.ranked_documents(docs, items, per_block=per_block), queries.OP13_SQL, documents=docs, benchmark=items)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "the")], "item_id bigint, text string")
    assert lexical.ranked_documents(docs, items).count() == 0
    assert lexical.ranked_documents(spark.createDataFrame([(1, "the")], DOC), items.where("false")).count() == 0


def test_windows_are_skipped(spark, monkeypatch):
    import pyarrow as pa

    rng = random.Random(1)
    n, common, rare = 64 * lexical.WINDOW, 11, 12
    rows = [{"doc_id": i, "m": 50, "terms": [common] + [rare] * (i % 700 == 0), "tfs": [rng.randint(1, 3)] + [1] * (i % 700 == 0)} for i in range(n)]
    kinds = pa.schema([("doc_id", pa.int64()), ("m", pa.int64()), ("terms", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32()))])
    lists = lexical.Lists([pa.RecordBatch.from_pylist(rows, kinds)])
    sought = []
    whole = np.searchsorted
    monkeypatch.setattr(lexical.np, "searchsorted", lambda a, v, *x: sought.append(1) or whole(a, v, *x))
    found = lists.best(np.array([common, rare]), np.array([10, 9000]), 10)
    assert [d % 700 for _, d in found] == [0] * 10 and len(sought) < 25
