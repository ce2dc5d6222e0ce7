"""Chat logs as events, folded into final messages and rendered with a loss mask. DataFrame functions only.

Events: (conv_id, seq, turn, kind, role, text), kind one of

- ``message``: sets the turn's text, replacing what the turn held;
- ``delta``: appends to the turn's text (streamed output);
- ``edit``: replaces the turn's text, later turns stay;
- ``regenerate``: drops the turn's text and every later turn recorded so far.

Within a conversation events count in the order of (seq, turn, kind, role, text). Null text is empty;
a turn's role is its first non-null one, else '' (an edit without one keeps it; regenerated events no
longer count). Turns that hold no live event are not rendered; turns with a null number come first. Rows with a null conv_id form one conversation. An empty log gives no rows.

A turn is rendered as ``### role: text</turn>`` and a line feed. Inside roles and texts a backslash
becomes two, ``###`` becomes ``\\h``, ``</turn>`` becomes ``\\t`` and (roles only) ``: `` becomes ``\\c``,
so control strings stand only where the template put them and the escape can be undone. One
conversation is one output string, so its events meet in one row by nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, COLON = "### ", "</turn>", ": "


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("###"), F.lit("\\h")), F.lit(CLOSE), F.lit("\\t"))
    return F.replace(out, F.lit(COLON), F.lit("\\c")) if role else out


def unescaped(text: Column) -> Column:
    """Undo ``escaped``: escapes are read from the left, so doubled backslashes are set aside first."""
    whole = F.split(text, r"\\\\", -1)
    plain = F.transform(whole, lambda x: F.replace(F.replace(F.replace(x, F.lit("\\h"), F.lit("###")), F.lit("\\t"), F.lit(CLOSE)), F.lit("\\c"), F.lit(COLON)))
    return F.array_join(plain, "\\")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final messages of each conversation."""
    order = [F.col(c).asc_nulls_first() for c in ("seq", "turn", "kind", "role", "text")]
    talk = Window.partitionBy("conv_id").orderBy(*order)
    later, one_turn = talk.rowsBetween(1, Window.unboundedFollowing), Window.partitionBy("conv_id", "turn")
    turn = F.coalesce(F.col("turn"), F.lit(-(1 << 62)))
    log = (
        events.select("conv_id", "seq", "turn", "kind", "role", "text")
        .withColumn("at", F.row_number().over(talk))
        .withColumn("cut_from", F.min(F.when(F.col("kind") == "regenerate", turn)).over(later))
        .where(F.col("cut_from").isNull() | (F.col("cut_from") > turn))
        .withColumn("reset_at", F.max(F.when(F.col("kind").isin("message", "edit", "regenerate"), F.col("at"))).over(one_turn))
        .withColumn("role", F.coalesce(F.min(F.when(F.col("role").isNotNull(), F.struct("at", "role"))).over(one_turn)["role"], F.lit("")))
        .where(F.col("reset_at").isNull() | (F.col("at") >= F.col("reset_at")))
    )
    parts = F.array_sort(F.collect_list(F.struct("at", F.coalesce("text", F.lit("")).alias("text"))))
    return log.groupBy("conv_id", "turn").agg(
        F.first("role").alias("role"),
        F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"),
    )


def render(messages: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_mask): the mask holds [start, stop) code points of the learned texts."""
    lead = F.concat(F.lit(OPEN), escaped(F.col("role"), True), F.lit(COLON))
    blocks = messages.select("conv_id", "turn", "role", lead.alias("lead"), escaped(F.col("text")).alias("body"))
    blocks = blocks.withColumn("block", F.concat("lead", "body", F.lit(CLOSE + "\n")))
    before = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("block").cast("long")).over(before), F.lit(0)) + F.length("lead")
    placed = blocks.withColumn("start", start)
    known = F.col("turn").isNotNull().alias("known")
    span = F.when(F.col("role").isin(*learned), F.struct(F.col("start"), (F.col("start") + F.length("body")).alias("stop")))
    whole = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(known, "turn", "block"))).alias("blocks"),
        F.array_sort(F.collect_list(span)).alias("loss_mask"),
    )
    return whole.select("conv_id", F.array_join(F.transform("blocks", lambda b: b["block"]), "").alias("formatted"), "loss_mask")


def format_chats(events: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    return render(fold_events(events), learned)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars) recovered from rendered strings and masks alone."""
    pieces = F.filter(F.split("formatted", CLOSE + "\n", -1), lambda x: F.startswith(x, F.lit(OPEN)))

    def parsed(piece: Column) -> Column:
        at = F.locate(COLON, piece, 1)
        return F.struct(
            unescaped(F.substring(piece, len(OPEN) + 1, at - len(OPEN) - 1)).alias("role"),
            unescaped(F.substring(piece, at + F.lit(len(COLON)), F.length(piece))).alias("text"),
        )

    learned = F.transform("loss_mask", lambda m: unescaped(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), (m["stop"] - m["start"]).cast("int"))))
    return formatted.select("conv_id", F.transform(pieces, parsed).alias("turns"), F.array_join(learned, "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def events_of(conversations: DataFrame, delta_chars: int = 400, *, drafts: bool = False) -> DataFrame:
    """Each stored row as a stream of deltas of ``delta_chars`` code points, one turn per row.

    Rows of a conversation count in the order of (turn, role, text); repeated rows are turns of their own. With
    ``drafts``, of three turns only the first is streamed at once: the second is first drafted and then regenerated,
    the third is streamed as a draft, and the stored text comes as an edit after the turn that follows has begun.
    """
    order = Window.partitionBy("conv_id").orderBy(*(F.col(c).asc_nulls_first() for c in ("turn", "role", "text")))
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.row_number().over(order).cast("long"))
    last = F.greatest(F.ceil(F.length("text") / F.lit(delta_chars)), F.lit(1)).cast("int") - 1

    def event(at: Column, kind: str, text: Column, role: Column | None = None) -> Column:
        fields = at.cast("long").alias("at"), F.lit(kind).alias("kind"), (F.col("role") if role is None else role).alias("role"), text.alias("text")
        return F.struct(*fields)

    def deltas(first: int) -> Column:
        return F.transform(F.sequence(F.lit(0), last), lambda i: event(i + first, "delta", F.substring(F.col("text"), i * delta_chars + 1, F.lit(delta_chars))))

    none = F.lit(None).cast("string")
    again = F.concat(F.array(event(F.lit(0), "delta", F.lit("draft")), event(F.lit(1), "regenerate", none, none)), deltas(2))
    edited = F.array(event(F.lit(0), "delta", F.reverse("text")), event(F.lit((1 << 24) + 1), "edit", F.col("text"), none))
    kinds = F.when(F.col("n") % 3 == 1, deltas(0)).when(F.col("n") % 3 == 2, again).otherwise(edited) if drafts else deltas(0)
    parts = rows.select("conv_id", F.col("n").alias("turn"), F.explode(kinds).alias("e"))
    return parts.select("conv_id", (F.col("turn") * F.lit(1 << 24) + F.col("e.at")).alias("seq"), "turn", "e.kind", "e.role", "e.text")
