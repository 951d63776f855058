"""Where matches of a pattern are in a text: offset, line, column, and a bounded excerpt of the line.

The text is split at the matches once. Offsets, lines and line starts are running sums (and a running maximum) over the parts, so a long line or many
matches cost no more than the text is long; nothing looks back into the text for each match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions.arrays import let, running

BEFORE, SHOWN, AFTER = 40, 120, 40
PLACE = "struct<start: int, line: int, column: int, hit: string, excerpt: string>"
NONE = f"CAST(array() AS array<{PLACE}>)"


def _feeds(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))


def _tail(s: Column) -> Column:
    """The part after the last line feed."""
    return F.substring_index(s, "\n", -1)


def places(text: Column, pattern: Column | str, most: Column | int | None = None) -> Column:
    """The first `most` matches, or all, in order, as PLACE: start from 0, line and column from 1, in code points; hit whole.

    excerpt: of the match's first line at most SHOWN code points, with at most BEFORE before it and AFTER behind it on that line, up to the matches beside it.
    Null texts give null; texts without a match an empty array. A pattern must not match empty strings.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, F.lit(-1) if most is None else F.lit(most) + 1)
    return let(hits if most is None else F.slice(hits, 1, most), lambda h: let(gaps, lambda g: of_parts(h, g)))


def starts(hits: Column, gaps: Column) -> Column:
    """Where each hit starts; gaps: the texts before each and after the last."""
    return running(F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.coalesce(F.length(F.get(hits, i - 1)), F.lit(0))))


def feeds_before(hits: Column, gaps: Column) -> Column:
    """Line feeds before each hit."""
    return running(F.transform(hits, lambda h, i: _feeds(F.get(gaps, i)) + F.coalesce(_feeds(F.get(hits, i - 1)), F.lit(0))))


def begins(hits: Column, gaps: Column, at: Column) -> Column:
    """Where the line of each hit begins; at: where the hits start."""

    def begin(start, i):
        gap, last = F.get(gaps, i), F.get(hits, i - 1)
        inside = F.when(_feeds(last) > 0, start - F.length(gap) - F.length(_tail(last))).otherwise(0)
        return F.when(_feeds(gap) > 0, start - F.length(_tail(gap))).otherwise(inside)

    return running(F.transform(at, begin), lambda a, b: F.greatest(a, b))


def placed(hits: Column, gaps: Column, at: Column, feeds: Column, begin: Column) -> Column:
    def excerpt(h, i):
        after = F.when(_feeds(h) > 0, F.lit("")).otherwise(F.left(F.substring_index(F.coalesce(F.get(gaps, i + 1), F.lit("")), "\n", 1), F.lit(AFTER)))
        return F.concat(F.right(_tail(F.get(gaps, i)), F.lit(BEFORE)), F.left(F.substring_index(h, "\n", 1), F.lit(SHOWN)), after)

    return F.transform(
        hits,
        lambda h, i: F.struct(F.get(at, i).alias("start"), (F.get(feeds, i) + 1).alias("line"), (F.get(at, i) - F.get(begin, i) + 1).alias("column"), h.alias("hit"), excerpt(h, i).alias("excerpt")),
    )


def of_parts(hits: Column, gaps: Column) -> Column:
    """The same of hits and gaps."""
    return let(starts(hits, gaps), lambda at: let(feeds_before(hits, gaps), lambda feeds: let(begins(hits, gaps, at), lambda begin: placed(hits, gaps, at, feeds, begin))))
