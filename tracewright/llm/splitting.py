"""Splitting oversized items at natural boundaries, with overlap.

A text is cut by one regex with bounded quantifiers, matched again and again from the
end of the previous match.  Its alternatives are ordered by the strength of the boundary
they end at; each consumes up to the limit and at least ``least`` characters, the last
one is the plain character fallback, so the matches tile the text without a gap.  The
pieces are then read off with array functions: the ends are running sums of the match
lengths, a piece starts ``overlap`` characters before its own cut.

All of it is SQL expressions inside one stage: no Python, no shuffle.  Java's ``.`` with a
bounded greedy quantifier is matched by a loop, so long texts need no deep stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters a piece may have, its overlap included.
LIMIT = 8000
#: Characters each piece repeats of the one before.
OVERLAP = 200

#: Boundaries of Java text from strong to weak; each matches the cut position.
JAVA_BOUNDARIES = (
    r"(?<=\n\}\r?\n)(?!\})",  # after a top-level closing brace
    r"(?<=\n {4}\}\r?\n)(?! {0,4}\})|(?<=\n\t\}\r?\n)(?!\t?\})",  # after a member
    r"(?<=\n\r?\n)(?!\r?\n)",  # after a blank line
    r"(?<=[;{}]\r?\n)",  # after a statement or block line
    r"(?<=\n)",  # after a line
    r"(?<=[;{}])(?![\r\n])",  # after a statement within a line
    r"(?<=[,)\s])(?![\r\n\s])",  # after a comma, bracket or blank
)


def pattern(body: int, least: int, boundaries: tuple[str, ...] = JAVA_BOUNDARIES) -> str:
    """The tiling regex: what is left if it fits, else the strongest boundary in reach, else ``body`` characters.

    The fallback never parts a carriage return from its line feed.
    """
    ends = [rf".{{1,{body}}}\z", *(rf".{{{least},{body}}}(?:{b})" for b in boundaries), rf".{{1,{body - 1}}}(?:\r(?!\n)|[^\r])"]
    return "(?s)" + "|".join(ends)


def cut_lengths(text: Column, limit: int = LIMIT, overlap: int = OVERLAP, boundaries: tuple[str, ...] = JAVA_BOUNDARIES) -> Column:
    """Array of the lengths into which a text is cut; every piece with its overlap stays within ``limit``."""
    body = limit - overlap
    pieces = F.regexp_extract_all(text, F.lit(pattern(body, max(1, body // 2), boundaries)), F.lit(0))
    return F.transform(pieces, lambda p: F.char_length(p))


def split_text(text: Column, limit: int = LIMIT, overlap: int = OVERLAP, boundaries: tuple[str, ...] = JAVA_BOUNDARIES) -> Column:
    """Array of struct<start, length, overlap, piece>: ``start`` counts from 0, ``overlap`` is what the piece repeats.

    A null text gives null, an empty one the empty array, a text within ``limit`` one piece.
    Without their overlaps the pieces give back the text exactly.
    """
    lengths = cut_lengths(text, limit, overlap, boundaries)
    whole = F.array(F.char_length(text))
    lens = F.when(F.char_length(text) <= limit, F.filter(whole, lambda n: n > 0)).otherwise(lengths)
    # running starts: [0, l0, l0+l1, ..]
    starts = F.aggregate(
        lens, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
    )
    cuts = F.zip_with(F.slice(starts, 1, F.greatest(F.size(lens), F.lit(0))), lens, lambda s, n: F.struct(s.alias("s"), n.alias("n")))

    def piece(c: Column) -> Column:
        back = F.least(c["s"], F.lit(overlap))
        return F.struct(
            (c["s"] - back).alias("start"),
            (c["n"] + back).alias("length"),
            back.alias("overlap"),
            F.substring(text, c["s"] - back + 1, c["n"] + back).alias("piece"),
        )

    return F.when(text.isNotNull(), F.transform(cuts, piece))


def sizes(units: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Per unit: ``total`` characters of source and ``large``, the indexes of the classes that alone exceed ``limit``."""
    n = F.transform(F.coalesce("classes", F.array()), lambda c: F.coalesce(F.char_length(c["source"]), F.lit(0)))
    return units.withColumn("__sizes", n).select(
        "*",
        F.aggregate("__sizes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("__total"),
    )


def oversized(units: DataFrame, *, limit: int = LIMIT) -> DataFrame:
    """(unit_id, class_pos) of what :func:`split_units` cuts: -1 for the unit, else the class's index.

    Read off the tilings: of the unit's text, and of each class by itself; what is cut into more
    than one tile and exceeds ``limit`` has a row.
    """
    s = sizes(units.select("unit_id", "classes"), limit).where(F.col("__total") > limit)
    unit = F.size(cut_lengths(_joined(), limit, boundaries=_UNIT_BOUNDARIES)) > 1
    large = F.filter(F.sequence(F.lit(0), F.size("__sizes") - 1), lambda i: F.get("__sizes", i) > limit)
    tiles = F.filter(large, lambda i: F.size(cut_lengths(F.get("classes", i)["source"], limit)) > 1)
    rows = F.concat(F.when(unit, F.array(F.lit(-1).cast("bigint"))).otherwise(F.array().cast("array<bigint>")), F.transform(tiles, lambda i: i.cast("bigint")))
    return s.select(F.col("unit_id").cast("bigint").alias("unit_id"), F.explode(rows).alias("class_pos"))


#: A unit may also be cut before a class.
_UNIT_BOUNDARIES = (r"(?<=\n)(?=package )", *JAVA_BOUNDARIES)


def _joined() -> Column:
    """The text of a unit: its sources with a line feed between them."""
    return F.array_join(F.transform("classes", lambda c: F.coalesce(c["source"], F.lit(""))), "\n")


def split_units(units: DataFrame, *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Labelled pieces of every unit whose classes exceed ``limit`` characters in all.

    The classes of a unit follow one another as one text with a line feed between them, which
    is the text the pieces' offsets count in; it is tiled by :func:`split_text`, where the
    beginning of a class is the strongest boundary.  Every piece but the first repeats the
    last ``overlap`` characters of the one before.

    Columns: ``unit_id``, ``label`` (``<label>_piece<k>``), ``piece_no`` from 1, ``pieces``,
    ``start``, ``length``, ``overlap``, ``class_from``, ``class_to`` (indexes of the first and
    last class it touches), ``piece``.

    Null or empty ``classes`` and null sources have size 0; a null label gives
    ``unit<unit_id>_piece<k>``.  Copies are cut each under their own id.
    """
    s = sizes(units.select("unit_id", "label", "classes"), limit).where(F.col("__total") > limit)
    joined = s.select(
        "unit_id", "label", _joined().alias("text"), F.transform("__sizes", lambda n: n + 1).alias("strides")
    )
    cut = joined.withColumn("cuts", split_text(F.col("text"), limit, overlap, _UNIT_BOUNDARIES))
    ends = F.aggregate("strides", F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    out = cut.withColumn("begins", F.slice(ends, 1, F.size("strides"))).select(
        "unit_id", "label", "begins", F.size("cuts").alias("pieces"), F.posexplode("cuts").alias("k", "c")
    )

    def class_at(offset: Column) -> Column:
        return F.size(F.filter("begins", lambda b: b <= offset)) - 1

    return out.select(
        "unit_id",
        F.concat(F.coalesce("label", F.concat(F.lit("unit"), F.col("unit_id").cast("string"))), F.lit("_piece"), (F.col("k") + 1).cast("string")).alias("label"),
        (F.col("k") + 1).alias("piece_no"),
        "pieces",
        F.col("c.start").alias("start"),
        F.col("c.length").alias("length"),
        F.col("c.overlap").alias("overlap"),
        class_at(F.col("c.start")).alias("class_from"),
        class_at(F.col("c.start") + F.col("c.length") - 1).alias("class_to"),
        F.col("c.piece").alias("piece"),
    )
