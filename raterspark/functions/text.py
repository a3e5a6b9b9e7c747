"""Text column expressions: accent folding, match keys, token lists, JSON extraction.

Everything here is a built-in Spark expression.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that Latin-to-ASCII transliteration spells in a way that neither their
# name nor their decomposition tells. In natural order, source -> target.
FOLD_LISTED = [
    ("Æ", "AE"), ("Ð", "D"), ("Ø", "O"), ("Þ", "TH"), ("ß", "ss"), ("æ", "ae"), ("ð", "d"), ("ø", "o"), ("þ", "th"),
    ("ı", "i"), ("ĸ", "q"), ("ŉ", "'n"), ("Ŋ", "N"), ("ŋ", "n"), ("Œ", "OE"), ("œ", "oe"), ("ẞ", "SS"),
]

# Code points of letters that are folded: Latin-1 Supplement and Latin Extended-A/B, Latin
# Extended Additional, ligatures, fullwidth forms.
_FOLD_BLOCKS = [(0x00C0, 0x024F), (0x1E00, 0x1EFF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)]


def _ascii_letters(ch: str) -> str:
    """The ASCII letters a Latin letter stands for, or '': by compatibility decomposition
    without marks (é, ĳ, ŀ, ſ, ﬁ), else by a name like LATIN SMALL LETTER H WITH STROKE."""
    parts = [c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c) and c.isalpha()]
    if parts and all(c.isascii() for c in parts):
        return "".join(parts)
    named = re.fullmatch(r"LATIN (SMALL|CAPITAL) LETTER ([A-Z]) WITH .*", unicodedata.name(ch, ""))
    return (named[2].lower() if named[1] == "SMALL" else named[2]) if named else ""


def _fold_table() -> dict[str, str]:
    found = {chr(cp): _ascii_letters(chr(cp)) for lo, hi in _FOLD_BLOCKS for cp in range(lo, hi + 1)}
    return {ch: to for ch, to in (found | dict(FOLD_LISTED)).items() if to}


_FOLD = _fold_table()
FOLD_SRC = "".join(ch for ch, to in _FOLD.items() if len(to) == 1)
FOLD_DST = "".join(to for to in _FOLD.values() if len(to) == 1)
FOLD_MULTI = [(ch, to) for ch, to in _FOLD.items() if len(to) > 1]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once however often ``use`` names it: it is the
    variable of a lambda over a one-element array, which the optimiser does not write out."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold_ascii(col: Column | str) -> Column:
    """Latin -> ASCII transliteration (``é`` -> ``e``, ``ß`` -> ``ss``) as built-ins.

    One ``translate`` for the 1:1 letters plus a literal ``replace`` per multi-letter one.
    """
    out = F.translate(_c(col), FOLD_SRC, FOLD_DST)
    multi = out
    for src, dst in FOLD_MULTI:
        multi = F.replace(multi, F.lit(src), F.lit(dst))
    # Most texts hold none of the multi-letter characters: one scan decides whether the
    # literal replacements run at all.
    return F.when(out.rlike("[" + "".join(s for s, _ in FOLD_MULTI) + "]"), multi).otherwise(out)


def title_key(col: Column | str) -> Column:
    """Match key for titles: fold accents, lower-case, drop everything that is not a
    letter, digit or space, trim. Inner runs of spaces are kept as they are."""
    return F.trim(F.regexp_replace(F.lower(fold_ascii(col)), r"[^\p{L}\p{N} ]+", ""))


def trim_ws(col: Column | str) -> Column:
    """Trim any whitespace (Spark ``trim`` strips only the space character)."""
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def remove_spaces(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), r"\s+", "")


def tokens(col: Column | str, sep: str = r"\s*[;,]\s*") -> Column:
    """Split into a clean token list: split on ``sep``, trim, drop empty tokens.

    A NULL input gives NULL; an empty string gives an empty array.
    """
    parts = F.split(_c(col), sep)
    return F.filter(F.transform(parts, lambda t: trim_ws(t)), lambda t: t != F.lit(""))


def first_line(col: Column | str) -> Column:
    """Text up to the first line break (the title line of a document)."""
    return F.regexp_extract(_c(col), r"^([^\n]*)", 1)


def after_first_line(col: Column | str) -> Column:
    """Text after the first line break ('' when there is none)."""
    return F.regexp_extract(_c(col), r"(?s)^[^\n]*\n(.*)$", 1)


def capitalize_first(col: Column | str) -> Column:
    """Upper-case the first character only ("very high" -> "Very high"), unlike initcap."""
    c = _c(col)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2147483647))


def compose_text(title: Column | str, abstract: Column | str, *keywords: Column | str) -> Column:
    """Title + ' ' + abstract, then ' ' + the first keyword field that is not blank.

    Missing title/abstract count as ''. Only the blank test trims; appended text is kept
    as it is.
    """
    base = F.concat(F.coalesce(_c(title), F.lit("")), F.lit(" "), F.coalesce(_c(abstract), F.lit("")))
    kw = None
    for k in reversed(keywords):
        kc = _c(k)
        branch = F.when(kc.isNotNull() & (trim_ws(kc) != F.lit("")), F.concat(F.lit(" "), kc))
        kw = branch if kw is None else branch.otherwise(kw)
    if kw is None:
        return base
    return F.concat(base, F.coalesce(kw, F.lit("")))


#: Characters for ``translate``: what a printed list has besides its labels, and what ``\s`` matches.
LIST_MARKS = "[]'\""
SPACES = " \t\n\x0b\f\r"


def strip_list_marks(col: Column | str) -> Column:
    """Remove ``[``, ``]``, single and double quotes from a printed list."""
    return F.regexp_replace(_c(col), r"[\[\]'\"]", "")


def keep_name_chars(col: Column | str) -> Column:
    """Keep Latin letters (with Latin-1 accents), comma, space and hyphen only."""
    return F.regexp_replace(_c(col), r"[^A-Za-zÀ-ÿ ,\-]", "")


def first_json_block(col: Column | str) -> Column:
    """First ``{...}`` span, non-greedy, dot matches newlines; NULL when there is none."""
    block = F.regexp_extract(_c(col), r"(?s)\{.*?\}", 0)
    return F.when(block != F.lit(""), block)


def first_balanced_block(col: Column | str, quotes: str = "inside") -> Column:
    """First brace block with balanced braces, braces inside quoted spans ignored.

    ``quotes='literal'`` treats any quote character in the text as the start of a quoted
    span (so an apostrophe in prose can hide a later block); ``quotes='inside'`` (default)
    tracks quotes only inside braces. NULL when no block closes. The text is split into
    braces, quotes, backslash pairs and runs of other characters, which one fold reads.
    """
    zero = F.lit(0)
    begin = F.struct(
        zero.alias("at"), zero.alias("depth"), F.lit("").alias("quote"), zero.alias("first"), zero.alias("last")
    )

    def read(seen: Column, piece: Column) -> Column:
        size, mark = F.length(piece), F.right(piece, F.lit(1))
        pair = (size == 2) & piece.startswith("\\")
        quoted, at = seen["quote"] != "", seen["at"] + size
        opens = ~quoted & mark.isin("'", '"') & (F.lit(quotes == "literal") | (seen["depth"] > 0))
        up = ~quoted & (mark == "{")
        down = ~quoted & (mark == "}") & (seen["depth"] > 0)
        quote = F.when(opens, mark).when(quoted & ~pair & (mark == seen["quote"]), "").otherwise(seen["quote"])
        nxt = F.struct(
            at.alias("at"),
            (seen["depth"] + up.cast("int") - down.cast("int")).alias("depth"),
            quote.alias("quote"),
            F.when(up & (seen["depth"] == 0), at).otherwise(seen["first"]).alias("first"),
            F.when(down & (seen["depth"] == 1), at).otherwise(zero).alias("last"),
        )
        return F.when(seen["last"] > 0, seen).otherwise(nxt)

    def block(text: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(r"(?s)\\.|['\"{}]|[^\\'\"{}]+|\\"), F.lit(0))
        cut = lambda at: F.when(at["last"] > 0, F.substring(text, at["first"], at["last"] - at["first"] + 1))
        return bound(F.aggregate(pieces, begin, read), cut)

    text = _c(col)
    # inside braces is the only place where quotes count: what stands before the first one goes
    return bound(text if quotes == "literal" else F.regexp_replace(text, r"(?s)^[^{]+", ""), block)


# A quoted span, a run without quotes, or a lone quote.
_QUOTED_OR_NOT = r"""(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|[^"']++|["']"""


# What makes a block no JSON where it stands outside quotes.
_NO_JSON = r",\s*[\]}]|\bNone\b|\b[Tt]rue\b|\b[Ff]alse\b"


def _tolerant(block: Column) -> Column:
    """A block as JSON: outside quoted spans a trailing comma before a closing bracket goes,
    ``None`` is null, and true or false (of either spelling) is the text True or False."""

    def bare(part: Column) -> Column:
        out = F.regexp_replace(part, r",\s*([\]}])", "$1")
        for pattern, text in ((r"\bNone\b", "null"), (r"\b[Tt]rue\b", '"True"'), (r"\b[Ff]alse\b", '"False"')):
            out = F.regexp_replace(out, pattern, text)
        return out

    parts = F.regexp_extract_all(block, F.lit(_QUOTED_OR_NOT), F.lit(0))
    mended = F.array_join(
        F.transform(parts, lambda p: F.when(p.startswith('"') | p.startswith("'"), p).otherwise(bare(p))), ""
    )
    return F.when(block.rlike(_NO_JSON), mended).otherwise(block)


def json_key(block: Column | str, key: str) -> Column:
    """Read ``key`` from a JSON-ish object text: a struct (value, status).

    A list value is joined with ``", "``, a null element being ``None``; a scalar is
    returned as text; a missing key, a JSON null or an unparsable block gives NULL. Single
    quotes and Python's literals are accepted. status is 'no_block', 'unparsed', 'no_key' or
    'ok'. The block is mended once and parsed once for a scalar, once more for a list and
    once more to tell why there is no value.
    """

    def parsed(json: Column, kind: T.DataType) -> Column:
        return F.from_json(json, T.StructType([T.StructField(key, kind)]))[key]

    def read(json: Column) -> Column:
        listed = F.array_join(F.transform(parsed(json, T.ArrayType(T.StringType())), lambda x: F.coalesce(x, F.lit("None"))), ", ")

        def judged(value: Column) -> Column:
            broken = F.from_json(json, T.MapType(T.StringType(), T.StringType())).isNull()
            status = (
                F.when(json.isNull(), F.lit("no_block"))
                .when(value.isNotNull(), F.lit("ok"))
                .when(broken, F.lit("unparsed"))
                .otherwise(F.lit("no_key"))
            )
            text = F.when(value.startswith("["), F.coalesce(listed, value)).otherwise(value)
            return F.struct(text.alias("value"), status.alias("status"))

        return bound(parsed(json, T.StringType()), judged)

    return bound(_c(block), lambda b: bound(_tolerant(b), read))


def json_key_text(block: Column | str, key: str) -> Column:
    """The value of :func:`json_key`."""
    return json_key(block, key)["value"]


def parse_status(block: Column | str, value: Column) -> Column:
    """'no_block' | 'unparsed' | 'no_key' | 'ok' for an extraction step whose value is given."""

    def judged(b: Column) -> Column:
        parsed = F.from_json(_tolerant(b), T.MapType(T.StringType(), T.StringType()))
        return F.when(b.isNull(), F.lit("no_block")).when(parsed.isNull(), F.lit("unparsed")).when(
            value.isNull(), F.lit("no_key")).otherwise(F.lit("ok"))

    return bound(_c(block), judged)


def pattern_flag(col: Column | str, pattern: str, also_equal: str | None = None, ignore_case: bool = True) -> Column:
    """0/1 flag: the text matches ``pattern`` (case-insensitive by default) or equals
    ``also_equal``. A NULL text gives 0 for the pattern part (``grepl`` semantics)."""
    c = _c(col)
    hit = F.coalesce(c.rlike(("(?i)" if ignore_case else "") + pattern), F.lit(False))
    if also_equal is not None:
        hit = hit | F.coalesce(c == F.lit(also_equal), F.lit(False))
    return hit.cast("int")
