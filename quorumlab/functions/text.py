"""Text columns: cleaning, splitting, tokens and numbers. Missing text is ''."""

from __future__ import annotations

import functools
import html.entities
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlab.functions import lexicons as L

EDGE = r"^[ \t\n\r\f]+|[ \t\n\r\f]+\z"
MARK = "\x01"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sql(value) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else f"{value!r}D"


def bound(x: Column, use) -> Column:
    """``use(x)`` with ``x`` computed once, however often ``use`` names it."""
    return F.transform(F.array(x), use)[0]


def words_of(values) -> Column:
    """An array of texts, built as one expression."""
    return F.expr(f"array({', '.join(map(_sql, values))})")


def map_of(values: dict) -> Column:
    """A map from texts to texts or numbers, built as one expression."""
    return F.expr(f"map({', '.join(_sql(x) for pair in values.items() for x in pair)})")


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns that are computed once, however often later steps name them."""
    return df.select("*", F.inline(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))))


def round4(x: Column) -> Column:
    return F.round(x, 4)


def rate(condition: Column, of: Column | None = None) -> Column:
    """Share of rows (of those where ``of`` holds) that meet a condition; 0 for an empty group."""
    hit = F.count_if(condition if of is None else condition & of)
    n = F.count(F.lit(1)) if of is None else F.count_if(of)
    return F.when(n > 0, F.round(hit / n, 4)).otherwise(F.lit(0.0))


def mean4(column: str) -> Column:
    """Mean of values of four decimals, rounded half up on exact sums."""
    return F.round(F.sum(F.round(F.col(column) * 10000).cast("bigint")) / F.count(column)) / 10000


def any_word(text: Column, words) -> Column:
    """Whether the text contains one of the words as a substring."""
    return functools.reduce(operator.or_, (F.contains(text, F.lit(w)) for w in words))


def count_words(text: Column, words) -> Column:
    return functools.reduce(operator.add, (F.contains(text, F.lit(w)).cast("int") for w in words))


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, EDGE, "")


@functools.cache
def _entities() -> tuple[str, str, int]:
    """Named entities that end with a semicolon, the old ones that need none, and the longest of these."""
    named = html.entities.html5
    old = {k: v for k, v in named.items() if not k.endswith(";")}
    return _packed({k: v for k, v in named.items() if k.endswith(";")}), _packed(old), max(map(len, old))


def _packed(values: dict) -> str:
    return "\x02".join(f"{k}\x01{v}" for k, v in values.items())


def _literal_map(packed: str) -> Column:
    """A map of any size as one literal, which Spark folds."""
    return F.str_to_map(F.lit(packed), F.lit("\x02"), F.lit("\x01"))


@functools.cache
def _numbered() -> str:
    """Numbers that stand for another character or for none: the upper control block means Windows-1252 letters."""
    fixed = {0: "\ufffd", 0x0D: "\r"} | {n: bytes([n]).decode("cp1252", "replace") for n in range(0x80, 0xA0)}
    fixed = {n: chr(n) if v == "\ufffd" and n else v for n, v in fixed.items()}
    controls = [*range(1, 9), 0x0B, *range(0x0E, 0x20), 0x7F, *range(0xFDD0, 0xFDF0), *(plane + last for plane in range(0, 0x110000, 0x10000) for last in (0xFFFE, 0xFFFF))]
    return _packed(fixed | {n: "" for n in controls})


def _number(digits: Column, base: int) -> Column:
    value = F.conv(F.when(F.length(digits) <= 12, digits).otherwise("ffffffff" if base == 16 else "4294967295"), base, 10).cast("bigint")
    plain = F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")
    odd = ((value >= 0xD800) & (value <= 0xDFFF)) | (value > 0x10FFFF)
    return F.coalesce(F.try_element_at(_literal_map(_numbered()), value.cast("string")), F.when(odd, "\ufffd").otherwise(plain))


def unescaped(x: Column | str) -> Column:
    """Named and numeric entities replaced, each once and from the left: of names the longest that is known.

    The pieces after each ``&`` are looked at one by one; texts without one are left alone."""
    closed, open_ended, longest = _entities()
    full, old = _literal_map(closed), _literal_map(open_ended)

    def entity(piece: Column) -> Column:
        word = F.regexp_extract(piece, r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)", 1)
        return bound(word, lambda word: resolved(word, piece))

    def resolved(word: Column, piece: Column) -> Column:
        rest = F.substring(piece, F.length(word) + 1, F.length(piece))
        digits = F.regexp_extract(word, r"^#[xX]?([0-9a-fA-F]+)", 1)
        number = F.when(F.lower(F.substring(word, 2, 1)) == "x", _number(digits, 16)).otherwise(_number(digits, 10))
        sizes = F.filter(F.sequence(F.lit(longest), F.lit(2), F.lit(-1)), lambda n: (n <= F.length(word)) & F.map_contains_key(old, F.substring(word, F.lit(1), n)))
        begun = lambda size: F.when(size.isNotNull(), F.concat(F.try_element_at(old, F.substring(word, F.lit(1), size)), F.substring(piece, size + 1, F.length(piece)))).otherwise(F.concat(F.lit("&"), piece))
        named = bound(F.try_element_at(full, word), lambda known: F.when(known.isNotNull(), F.concat(known, rest)).otherwise(bound(F.get(sizes, 0), begun)))
        return F.when(word == "", F.concat(F.lit("&"), piece)).when(word.startswith("#"), F.concat(number, rest)).otherwise(named)

    def joined(pieces: Column) -> Column:
        return F.array_join(F.concat(F.slice(pieces, 1, 1), F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), entity)), "")

    return F.when(F.contains(c(x), F.lit("&")), bound(F.split(c(x), "&", -1), joined)).otherwise(c(x))


def clean_text(x: Column | str) -> Column:
    """Entities and tags resolved, line ends and blanks folded."""
    t = bound(F.coalesce(c(x), F.lit("")), unescaped)
    t = F.regexp_replace(t, "<[^>]+>", " ")
    t = F.replace(t, F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), "\n{3,}", "\n\n")
    return stripped(t)


def clean_ws(x: Column | str) -> Column:
    return stripped(F.regexp_replace(F.coalesce(c(x), F.lit("")), r"[ \t\n\r\f]+", " "))


def split_sentences(x: Column | str) -> Column:
    """Review sentences longer than 12 characters, without bullet marks."""
    lines = F.filter(F.transform(F.split(clean_text(x), "\n"), lambda s: F.btrim(s, F.lit(" -*\t"))), lambda s: s != "")
    flat = F.regexp_replace(F.regexp_replace(F.array_join(lines, " "), r"([.!?])[ \t\n\r\f]+", "$1" + MARK), r";[ \t\n\r\f]+", MARK)
    return F.filter(F.transform(F.split(flat, MARK), stripped), lambda s: F.length(s) > 12)


def split_segments(x: Column | str) -> Column:
    """Pieces of at least 20 characters of a meta-review; the whole text if there are none."""
    def of(text: Column) -> Column:
        flat = F.regexp_replace(text, r"([.!?])[ \t\n\r\f]+", "$1" + MARK)
        flat = F.regexp_replace(F.regexp_replace(flat, r";[ \t\n\r\f]+", MARK), "\n+", MARK)
        pieces = F.filter(F.transform(F.split(flat, MARK), lambda s: stripped(F.btrim(s, F.lit(" -*\t")))), lambda s: F.length(s) >= 20)
        whole = F.when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))
        return bound(pieces, lambda pieces: F.when(F.size(pieces) > 0, pieces).otherwise(whole))

    return bound(clean_text(x), of)


def raw_tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z][a-z0-9_-]{2,}"), F.lit(0))


def singular(t: Column) -> Column:
    n = F.length(t)
    return (
        F.when((n > 4) & t.endswith("ies"), F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & t.endswith("es"), F.substring(t, F.lit(1), n - 2))
        .when((n > 3) & t.endswith("s"), F.substring(t, F.lit(1), n - 1))
        .otherwise(t)
    )


def plain_tokens(x: Column | str) -> Column:
    """Distinct tokens without stop words, sorted."""
    return F.array_sort(F.array_distinct(F.filter(raw_tokens(F.coalesce(c(x), F.lit(""))), lambda t: ~t.isin(*L.STOPWORDS))))


def token_list(x: Column | str) -> Column:
    """Tokens in order, plural endings removed."""
    return F.transform(F.filter(raw_tokens(F.coalesce(c(x), F.lit(""))), lambda t: ~t.isin(*L.STOPWORDS)), singular)


def token_set(x: Column | str) -> Column:
    """Distinct tokens of ``token_list``, sorted. Equal words are looked at once, and endings only where there is an s."""
    words = F.array_except(raw_tokens(F.coalesce(c(x), F.lit(""))), words_of(L.STOPWORDS))
    return F.sort_array(F.array_distinct(F.transform(words, lambda t: F.when(t.endswith("s"), singular(t)).otherwise(t))))


def stem(t: Column) -> Column:
    n = F.length(t)
    return (
        F.when(t.endswith("ing") & (n > 6), F.substring(t, F.lit(1), n - 3))
        .when(t.endswith("ed") & (n > 5), F.substring(t, F.lit(1), n - 2))
        .when(t.endswith("s") & (n > 5), F.substring(t, F.lit(1), n - 1))
        .otherwise(t)
    )


def concern_tokens(x: Column | str) -> Column:
    """Distinct stemmed tokens with synonyms folded, sorted."""
    same = map_of(L.SYNONYMS)

    def folded(t: Column) -> Column:
        return F.coalesce(F.try_element_at(same, t), t)

    # a step for each change, as a token is named several times in each; equal tokens are looked at once
    found = F.array_distinct(F.transform(raw_tokens(clean_text(x)), lambda t: F.replace(t, F.lit("-"), F.lit(""))))
    found = F.transform(F.transform(F.transform(found, folded), stem), folded)
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(*L.CONCERN_STOPWORDS))))


def overlap_score(query: Column, segment: Column) -> Column:
    """Coverage, cosine and anchor bonus of two token sets, at most 1; 0 without a common token."""
    return overlap_of(F.array_intersect(query, segment), query, segment)


def overlap_of(both: Column, query: Column, segment: Column) -> Column:
    """``overlap_score`` of two sets whose common tokens are known."""
    return overlap_counted(F.size(both), F.size(query), F.size(segment), F.arrays_overlap(both, words_of(L.ANCHORS)))


def overlap_counted(common: Column, query: Column, segment: Column, anchored: Column) -> Column:
    """``overlap_score`` from the sizes of two sets and of what they share, and whether that holds an anchor."""
    n = common.cast("double")
    score = F.lit(0.68) * (n / query) + F.lit(0.32) * (n / F.sqrt((query * segment).cast("double")))
    score = score + F.when(anchored, F.lit(0.08)).otherwise(F.lit(0.0))
    return F.when(n > 0, F.least(F.lit(1.0), score)).otherwise(F.lit(0.0))


def first_number(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"[-+]?\d+(?:\.\d+)?", 0), F.lit("")).cast("double")


def normalize_rating(x: Column | str) -> Column:
    """First number of a rating; ``/5`` scales to 10, more than 10 is null."""
    n, low = first_number(c(x)), F.lower(c(x))
    fifths = (n <= 5) & (F.contains(low, F.lit("/5")) | F.contains(low, F.lit("out of 5")))
    return F.when(fifths, F.round(n / 5 * 10, 2)).when(n <= 10, F.round(n, 2))


def normalize_confidence(x: Column | str) -> Column:
    n = first_number(c(x))
    return F.when(n <= 5, F.round(n / 5 * 10, 2)).when(n <= 10, F.round(n, 2))


def parse_time(x: Column | str) -> Column:
    """Epoch seconds, epoch milliseconds or ISO text to a UTC timestamp; anything else is null."""
    text = stripped(c(x))
    number = F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), text.cast("double"))
    millis = F.when(number > 10_000_000_000, number).otherwise(number * 1000)
    return F.coalesce(F.timestamp_millis(millis.cast("bigint")), F.when(number.isNull(), F.try_to_timestamp(text)))


def truncate_words(x: Column | str, size: int) -> Column:
    """Cut at a word boundary and mark the cut."""
    text = clean_ws(x)
    head = F.rtrim(F.substring(text, 1, size - 1))
    cut = F.when(F.contains(head, F.lit(" ")), F.rtrim(F.regexp_replace(head, r" [^ ]*\z", ""))).otherwise(head)
    return F.when(F.length(text) <= size, text).otherwise(F.concat(cut, F.lit("...")))


def snippet(x: Column | str, terms: Column, size: int = 700) -> Column:
    """A window that begins a third of its size before the first matched term of four letters or more."""
    def of(text: Column) -> Column:
        def marked(start: Column) -> Column:
            body = stripped(F.substring(text, start + 1, F.lit(size)))
            return F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(start + size < F.length(text), "...").otherwise(""))

        long = F.filter(terms, lambda t: F.length(t) >= 4)
        places = bound(F.lower(text), lambda low: F.filter(F.transform(long, lambda t: F.position(t, low) - 1), lambda p: p >= 0))
        start = F.greatest(F.lit(0), F.coalesce(F.array_min(places), F.lit(0)) - size // 3)
        return F.when(F.length(text) <= size, text).otherwise(bound(start, marked))

    return bound(clean_text(x), of)


def stable_id(prefix: str, *parts: Column, size: int = 10) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(F.concat_ws("||", *parts).cast("binary")), 1, size))


def decision_class(x: Column | str) -> Column:
    low = F.lower(F.coalesce(c(x), F.lit("")))
    return (
        F.when(stripped(low) == "", "unknown")
        .when(F.contains(low, F.lit("reject")), "reject")
        .when(any_word(low, ("accept", "spotlight", "oral")), "accept")
        .otherwise("other")
    )
