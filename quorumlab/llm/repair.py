"""Conversation structure repair: the cheapest edits that give roles of the form (system?)(user assistant)+ or nothing.

Rows (conv_id, turn, role, text) of a conversation count in the order of (turn, role, text), nulls first; null roles
and texts are one space, rows with a null conv_id are one conversation, other columns are ignored. The first fault of
a row counts: ``blank`` (nothing but ASCII white space), ``duplicate`` (role and text seen earlier), ``truncated``
(its last other character is none of ``.!?``). Edits and costs: Keep 0, Rerole to user or assistant 2, Delete 3 (blank
and duplicate rows must go), Insert an empty user or assistant row 2; a truncated row that stays adds 1. Of the
cheapest edit lists the one whose initials (D, I, K, R) come first is taken. An empty table gives no rows.

The search is depth-first branch-and-bound over nodes (row, last role): an explicit stack, the incumbent (cost, audit),
suffix lower bounds, and for each node the best prefix that reached it, which dominates later ones. Prefixes may be
compared without their ends: of two prefixes of one node and equal cost none begins the other, as what it had more
would be insertions, which cost. Edits are tried in the order of their initials, so a later prefix of a node is only
better if it is cheaper, and a node is opened at most as often as its costs differ (``searched``).

A conversation of any length is cut into blocks of ``BLOCK`` rows, wherever its rows lie. Each block is searched for
every role before it and after it; what blocks hand on is then chained from the end. So a conversation that holds most
rows of the table is spread over tasks; one row then gathers some 20 bytes for each of its rows, as its audit is one
string by definition, and its texts are written (and hashed) as a sorted stream, a batch at a time.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlab.llm.shared import ASCII_SPACE, staged

BLOCK = 64
#: The last role: none yet, system, user, assistant; and where each next initial leads.
STATES = range(4)
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NAMED = {"u": "user", "a": "assistant"}
#: What the end of a conversation still needs after each last role.
CLOSING = ((0, ""), (4, "II"), (2, "I"), (0, ""))
LEGAL = ("su", "ua", "au")
NEVER = 1 << 60


def added(state: int) -> str:
    """The role that an insertion or a new role has after ``state``."""
    return "a" if state == 2 else "u"


def steps(code: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, last role after it) of the ways to use up a row, by initial."""
    yield "D", 3, state
    if code == "-":
        return
    extra = code.isupper()
    if code.lower() in NEXT[state]:
        yield "K", extra, NEXT[state][code.lower()]
    yield "R", 2 + extra, NEXT[state][added(state)]


def suffix_bounds(codes: str) -> list[int]:
    """For each row, a cost that all edits from it on reach: forced deletions, truncated rows, rows of no known role,
    and neighbouring rows that can't both stay unchanged (each row in one such pair at most)."""
    bounds, later = [0] * (len(codes) + 1), ""
    for i in range(len(codes) - 1, -1, -1):
        code = codes[i]
        bounds[i] = bounds[i + 1] + (3 if code == "-" else code.isupper())
        if code == "-":
            continue
        role = code.lower()
        clash = role == "o" or (later and role + later not in LEGAL)
        bounds[i] += 2 * bool(clash)
        later = "" if clash else role
    return bounds


def dive(codes: str, entry: int, leave: int) -> int:
    """The cost of one way through, row by row the cheapest; where the search starts to prune."""
    state, cost = entry, 0
    for i, code in enumerate(codes):
        ways, at, paid = [], state, 0
        for _ in range(3):
            ways += [(paid + price, after) for _, price, after in steps(code, at) if i + 1 < len(codes) or after == leave]
            at, paid = NEXT[at][added(at)], paid + 2
        if not ways:
            return NEVER
        price, state = min(ways)
        cost += price
    return cost


@functools.lru_cache(maxsize=1 << 16)
def searched(codes: str, entry: int, leave: int) -> tuple[int, str] | None:
    """The least (cost, audit) that uses up ``codes`` from the last role ``entry`` to ``leave``; None if there is none.

    A code is the initial of a row's role (``o``: another), in upper case if truncated, or ``-`` if it must go."""
    if leave < 2 and entry > leave:
        return None
    bounds, best = suffix_bounds(codes), (dive(codes, entry, leave), "~")  # "~" comes after every audit
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if (cost + bounds[i], audit) > best or (leave < 2 and state > leave):
            continue
        known = reached.get((i, state))
        if known and known <= (cost, audit):
            continue
        reached[i, state] = cost, audit
        if i == len(codes):
            if state == leave:
                best = cost, audit
            continue
        ways = [(i + 1, after, cost + price, audit + edit) for edit, price, after in steps(codes[i], state)]
        ways.insert(1, (i, NEXT[state][added(state)], cost + 2, audit + "I"))
        stack.extend(reversed(ways))
    return best if best[1] != "~" else None


def damaged(conversations: DataFrame) -> DataFrame:
    """Damage by crc32(``conv_id:turn``) modulo 20 (nulls: one space): 0 drops a row, 1 empties its text, 2 removes
    ``.!?`` from it, 3 repeats the row, 4 makes it the user's."""
    named = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind, text = F.crc32(named) % 20, F.coalesce("text", F.lit(" "))
    return conversations.where(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def diagnosed(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, fault): each distinct row once, with the fault of its first copy.

    Copies are counted before anything is sent; the first turn of a role and text is known by 128 bits of their hash."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    said = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    rows = staged(rows.withColumn("said", said), "distinct-turns")
    first = rows.groupBy("conv_id", "said").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn"))["turn"].alias("turn"))
    first = first.select(F.col("conv_id").alias("c"), F.col("said").alias("s"), F.col("turn").alias("t"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")) & F.col("turn").eqNullSafe(F.col("t"))
    written = F.rtrim("text", F.lit(ASCII_SPACE))
    fault = (
        F.when(written == "", "blank")
        .when(F.col("s").isNull(), "duplicate")
        .when(~F.right(written, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    return staged(rows.join(first, same, "left").select("conv_id", "turn", "role", "text", "copies", fault.alias("fault")), "diagnosed")


def in_order(columns: list[str]) -> list:
    return [F.col(c).asc_nulls_first() for c in columns]


TABLE = "array<struct<cost:bigint,audit:string>>"
SUMMARY = (
    "conv_id bigint, part int, nr int, first_role string, last_role string, first_turn bigint, last_turn bigint, turns bigint, "
    f"blank bigint, duplicate bigint, truncated bigint, illegal bigint, ways {TABLE}"
)


class Block:
    """Counts and codes of up to ``BLOCK`` rows of one conversation that follow each other."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.codes, self.initials = conv_id, [], []
        self.turns, self.faults = [], {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, turn: int | None, role: str, fault: str | None) -> None:
        initial = role[:1]
        code = initial if initial in ("s", "u", "a") else "o"
        self.codes.append("-" if fault in ("blank", "duplicate") else code.upper() if fault else code)
        self.initials.append(initial)
        if fault:
            self.faults[fault] += 1
        if turn is not None and self.turns[-1:] != [turn]:
            self.turns.append(turn)

    def summary(self, part: int, nr: int) -> dict:
        codes = "".join(self.codes)
        found = [searched(codes, entry, leave) for entry in STATES for leave in STATES]
        return {
            "conv_id": self.conv_id, "part": part, "nr": nr, "first_role": self.initials[0], "last_role": self.initials[-1],
            "first_turn": self.turns[0] if self.turns else None, "last_turn": self.turns[-1] if self.turns else None,
            "turns": len(self.turns), **self.faults,
            "illegal": sum(a + b not in LEGAL for a, b in zip(self.initials, self.initials[1:])),
            "ways": [{"cost": f[0], "audit": f[1]} if f else None for f in found],
        }


def summaries(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each block of the conversations of ``diagnosed`` rows, blocks in the order of (part, nr)."""
    fields = pa.schema([
        *((n, pa.int64()) for n in ("conv_id",)), *((n, pa.int32()) for n in ("part", "nr")), *((n, pa.string()) for n in ("first_role", "last_role")),
        *((n, pa.int64()) for n in ("first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal")),
        ("ways", pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))),
    ])

    def cut(batches):
        part, nr, held, done = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            for conv_id, turn, role, fault, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                again = fault if fault == "blank" else "duplicate"
                for k in range(copies):
                    if held and (held.conv_id != conv_id or len(held.codes) >= block):
                        done.append(held.summary(part, nr))
                        held, nr = None, nr + 1
                    held = held or Block(conv_id)
                    held.add(turn, role, again if k else fault)
                    if len(done) >= 2000:
                        yield pa.RecordBatch.from_pylist(done, fields)
                        done = []
        if held:
            done.append(held.summary(part, nr))
        yield pa.RecordBatch.from_pylist(done, fields)

    order = ["conv_id", "turn", "role", "text"]
    # a task of a range holds neighbours, so a long conversation is cut between tasks too
    sorted_rows = rows.repartitionByRange(*in_order(order)).sortWithinPartitions(*in_order(order))
    columns = [F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "fault", "copies"]
    return sorted_rows.select(*columns).mapInArrow(cut, SUMMARY)


def chained(blocks: list[dict]) -> dict:
    """A conversation's figures from those of its blocks, in order."""
    turns = [(b["first_turn"], b["last_turn"], b["turns"]) for b in blocks if b["turns"]]
    distinct = sum(t[2] for t in turns) - sum(a[1] == b[0] for a, b in zip(turns, turns[1:]))
    seams = sum(a["last_role"] + b["first_role"] not in LEGAL for a, b in zip(blocks, blocks[1:]))
    rest: list[tuple[int, str] | None] = list(CLOSING)
    for b in reversed(blocks):
        ways = b["ways"]
        rest = [
            min(((w["cost"] + end[0], w["audit"] + end[1]) for w, end in zip(ways[4 * s : 4 * s + 4], rest, strict=True) if w and end), default=None)
            for s in STATES
        ]
    return {
        "gaps": turns[-1][1] - turns[0][0] + 1 - distinct if turns else 0,
        **{f: sum(b[f] for b in blocks) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(b["illegal"] for b in blocks) + seams,
        "cost": rest[0][0],
        "audit": rest[0][1],
    }


def plans(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of the conversations of ``diagnosed`` rows."""
    blocks = staged(summaries(rows, block), "conversation-blocks")
    listed = F.array_sort(F.collect_list(F.struct("part", "nr", *blocks.columns[3:]))).alias("blocks")

    def chain(batches):
        for batch in batches:
            found = [{"conv_id": c, **chained(b)} for c, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            kinds = [("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())]
            yield pa.RecordBatch.from_pylist(found, pa.schema(kinds))

    fields = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
    return staged(blocks.groupBy("conv_id").agg(listed).mapInArrow(chain, fields), "conversation-plans")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the rows of each repaired conversation, as a stream in this order.

    ``rows`` are ``diagnosed``, ``found`` their ``plans``. Inserted rows have an empty text. Rows come sorted within
    partitions, a conversation in one of them."""
    heads = found.select("conv_id", F.lit(0).alias("kind"), "audit")
    body = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.lit(1).alias("kind"), "turn", "role", "text", "copies")
    both = heads.unionByName(body, allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions(*in_order(["conv_id", "kind", "turn", "role", "text"]))
    fields = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def edit(batches):
        conv_id, audit, at, state, position, out = None, "", 0, 0, 0, []

        def put(kind: str, role: str, text: str) -> None:
            nonlocal position, state
            out.append((conv_id, position, kind, role, text))
            position, state = position + 1, NEXT[state][role[:1]]

        def insertions() -> None:
            nonlocal at
            while audit[at : at + 1] == "I":
                put("insert", NAMED[added(state)], "")
                at += 1

        for batch in batches:
            for conv, kind, plan, role, text, copies in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "kind", "audit", "role", "text", "copies")), strict=True):
                if kind == 0:
                    insertions()  # those at the end of the conversation before
                    conv_id, audit, at, state, position = conv, plan, 0, 0, 0
                    continue
                for _ in range(copies):
                    insertions()
                    if audit[at] != "D":
                        put(*(("keep", role, text) if audit[at] == "K" else ("rerole", NAMED[added(state)], text)))
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, fields, strict=True)], schema=fields)
            out.clear()
        insertions()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), fields, strict=True)], schema=fields)

    return both.mapInArrow(edit, "conv_id bigint, position bigint, edit string, role string, text string")


def digests(messages: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the ``role:text`` lines of ``repaired`` rows, hashed as they stream by."""

    def hashed(batches):
        fields = pa.schema([("conv_id", pa.int64()), ("sha256", pa.string())])
        current, digest = None, None
        for batch in batches:
            done = []
            for conv_id, position, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "position", "role", "text")), strict=True):
                if position == 0:
                    if digest:
                        done.append({"conv_id": current, "sha256": digest.hexdigest()})
                    current, digest = conv_id, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_pylist(done, fields)
        if digest:
            yield pa.RecordBatch.from_pylist([{"conv_id": current, "sha256": digest.hexdigest()}], fields)

    return messages.mapInArrow(hashed, "conv_id bigint, sha256 string")


def repair_report(conversations: DataFrame, rows: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Per conv_id of ``conversations``: the faults of ``rows``, cost, audit and digest of their cheapest repair.

    A conversation without ``rows`` has zeros, an empty audit and the digest of an empty string."""
    rows = diagnosed(rows)
    found = plans(rows, block)
    hashes = digests(repaired(rows, found)).withColumnRenamed("conv_id", "h")
    every = conversations.select(F.col("conv_id").cast("bigint").alias("c")).distinct()
    out = every.join(found, F.col("c").eqNullSafe(F.col("conv_id")), "left").join(hashes, F.col("c").eqNullSafe(F.col("h")), "left")
    numbers = [F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("c").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(nothing)).alias("repaired_sha256")
    )
