"""Text expressions: folding, spans of a pattern, lines. All are Catalyst expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import folding

SPAN = "array<struct<start:int,end:int>>"


def _bases() -> tuple[str, str]:
    """Accented small letters, and the one letter each becomes without its marks."""
    pairs = {"đ": "d"}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if c == c.lower() and len(plain) == 1 and plain != c:
            pairs[c] = plain
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _bases()


def fold(text: Column) -> Column:
    """Lower case without diacritics, one character for each of the original, so that offsets stay."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def changes_length(text: Column) -> Column:
    """True where full case folding would not be one to one: sharp s, ligatures, bare combining marks."""
    return text.rlike("[\\u00DF\\u1E9E\\u0130\\u0149\\u01F0\\uFB00-\\uFB06\\u0300-\\u036F]")


def exactly_folded(text: Column) -> Column:
    """The folded text where folding need not be one to one; offsets are those of functions.folding. Only the texts that
    changes_length() tells leave the JVM."""
    run = F.pandas_udf(lambda s: s.map(folding.fold, na_action="ignore"), "string")
    return F.coalesce(run(F.when(changes_length(text), text)), fold(text))


def spans(text: Column, pattern: str | Column) -> Column:
    """array<struct<start,end>> of all leftmost matches, half-open, in characters. No match may be empty.

    Matches and what lies between them give the offsets, so the text is scanned by the JVM's matcher alone.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    found, between = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, p, -1)
    pairs = F.arrays_zip(found.alias("m"), between.alias("b"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["b"])
        end = start + F.length(pair["m"])
        here = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.concat(state["out"], here).alias("out"))

    walked = F.aggregate(F.slice(pairs, F.lit(1), F.size(found)), zero, step, lambda s: s["out"])
    return F.when(text.isNull() | (F.size(found) == 0), F.array().cast(SPAN)).otherwise(walked)


def cut(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] in characters."""
    return F.substring(text, start + 1, end - start)


def any_of(words: tuple[str, ...] | list[str]) -> str:
    """A pattern for the words, longest first."""
    return "|".join(re.escape(w) for w in sorted(words, key=lambda x: (-len(x), x)))


def lines(parts: DataFrame) -> DataFrame:
    """document_id, part_seq, line_no, start, end, line of every line; empty lines stay, nothing is trimmed."""
    pieces = F.split("text", "\n", -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    starts = F.aggregate(pieces, zero, lambda s, x: F.struct((s["at"] + F.length(x) + 1).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
    each = parts.select("document_id", "part_seq", F.posexplode(F.arrays_zip(pieces.alias("line"), starts.alias("start"))).alias("line_no", "l"))
    return each.select("document_id", "part_seq", "line_no", F.col("l.start").alias("start"), (F.col("l.start") + F.length("l.line")).alias("end"), F.col("l.line").alias("line"))
