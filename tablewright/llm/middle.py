"""Fill-in-the-middle transformation by counted quantifiers.

A text is a row of units (code points, surrogate pairs kept whole). ``regexp_count`` gives their number n; hashes of the
document's id choose two cuts a <= b and the form. One pattern a row, ``\\A(unit{a}+)(unit{b-a}+)(unit*+)\\z``, then takes
prefix, middle and suffix in a single match, whose groups the replacement puts in the order of the form. All quantifiers
are possessive over a single unit, so the match runs straight through in a loop: no backtracking, no recursion, at any length.

Forms, with the marks of ``Marks``: ``psm`` is prefix, suffix, middle, ``spm`` is suffix, prefix, middle; ``plain`` is the
text as it is, for texts that are empty, hold a mark, or are not chosen. A mark begins with a character that it holds only
once, so none can arise where a mark meets a piece of text, and the first occurrence in an output is the mark.

Everything is an expression on the row: nothing is shuffled, and output columns are added to all others. NULL texts count as
empty; a NULL id is hashed as an empty one; rows of equal ids and lengths are cut alike. Texts are valid UTF-8. Of a text
no more than a few copies are in memory at a time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.common import fresh_name

UNIT = "(?s:.)"        # one code point, line breaks too
BLOCK = 4_096          # units counted at a time: the count never holds one value for each unit


@dataclass(frozen=True)
class Marks:
    """The strings before prefix, suffix and middle."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        for mark in self.all:
            if not mark or any(mark[0] in other[1:] for other in self.all):
                raise ValueError("a mark needs a first character that no mark holds further on")
            if "$" in mark or "\\" in mark:
                raise ValueError("marks may not hold $ or a backslash")
        if any(a != b and a.startswith(b) for a in self.all for b in self.all) or len(set(self.all)) < 3:
            raise ValueError("no mark may begin with another")

    @property
    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def count_units(text: Column) -> Column:
    """The number of units: whole blocks first, then the units behind the last one."""
    blocks = F.regexp_count(text, F.lit(f"{UNIT}{{{BLOCK}}}+"))
    rest = F.regexp_replace(text, F.lit(rf"\A(?:{UNIT}{{{BLOCK}}}+)*+"), F.lit(""))
    return blocks.cast("bigint") * BLOCK + F.regexp_count(rest, F.lit(UNIT))


def hash_numbers(key: Column, seed: str, count: int) -> list[Column]:
    """The first ``count`` groups of eight hex digits of the SHA-256 of ``seed:key``, as unsigned integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * n, 8), 16, 10).cast("bigint") for n in range(count)]


def transform(docs: DataFrame, seed: str = "1", percent: int = 90, spm_percent: int = 20, marks: Marks = Marks(),
              key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` (NULL if plain) and ``output``.

    ``percent`` of the texts are cut, ``spm_percent`` of these in the form spm. Names that ``docs`` has already are made fresh.
    """
    n, form, first, second, output = (
        fresh_name(docs, name) for name in ("n", "form", "prefix_chars", "middle_chars", "output"))
    whole, hashes = fresh_name(docs, "_whole"), fresh_name(docs, "_hashes")
    rows = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumns({n: count_units(F.col(whole)), hashes: F.array(*hash_numbers(F.col(key), seed, 4))})
    one, two, chosen, order = (F.col(hashes)[place] for place in range(4))
    one, two = (F.pmod(cut, F.col(n) + 1) for cut in (one, two))
    marked = F.lit(False)
    for mark in marks.all:
        marked = marked | F.contains(F.col(whole), F.lit(mark))
    rows = rows.withColumn(form, F.when((F.col(n) == 0) | marked | (F.pmod(chosen, F.lit(100)) >= percent), "plain")
                           .when(F.pmod(order, F.lit(100)) < spm_percent, "spm").otherwise("psm"))
    cut = F.col(form) != "plain"
    rows = rows.withColumns({first: F.when(cut, F.least(one, two)), second: F.when(cut, F.greatest(one, two) - F.least(one, two))})
    pattern = F.concat(F.lit(rf"\A({UNIT}{{"), F.col(first), F.lit(f"}}+)({UNIT}{{"), F.col(second), F.lit(rf"}}+)({UNIT}*+)\z"))
    p, s, m = marks.all
    moved = F.regexp_replace(F.col(whole), pattern, F.when(F.col(form) == "psm", f"{p}$1{s}$3{m}$2").otherwise(f"{s}$3{p}$1{m}$2"))
    rows = rows.withColumn(output, F.when(cut, moved).otherwise(F.col(whole)))
    return rows.select(*docs.columns, n, form, first, second, output)


def restore(rows: DataFrame, output: str = "output", form: str = "form", marks: Marks = Marks(), name: str = "restored") -> DataFrame:
    """``rows`` with the exact text, rebuilt from the output and the form alone; NULL where the output is no output of its form."""
    name = fresh_name(rows, name)

    def back(marks_in_order: tuple[str, str, str], text: str) -> Column:
        a, b, c = map(re.escape, marks_in_order)
        pattern = rf"(?s)\A{a}(.*?){b}(.*?){c}(.*+)\z"
        return F.when(F.regexp_like(F.col(output), F.lit(pattern)), F.regexp_replace(F.col(output), F.lit(pattern), F.lit(text)))

    p, s, m = marks.all
    return rows.withColumn(name, F.when(F.col(form) == "plain", F.col(output))
                           .when(F.col(form) == "psm", back((p, s, m), "$1$3$2"))
                           .when(F.col(form) == "spm", back((s, p, m), "$2$3$1")))


def digests(docs: DataFrame) -> DataFrame:
    """Each document's cut, and the checksums of its output and of the text rebuilt from that."""
    rows = restore(transform(docs.select("doc_id", "text")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))
