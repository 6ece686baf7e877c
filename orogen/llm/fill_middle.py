"""Fill-in-middle by marker injection, in column expressions alone.

A delimiter is escaped out of the text and appended after each unit by one regexp_replace; counting it counts the units,
and substring_index cuts the marked text at ranked delimiters. The parts lose their delimiters, are unescaped and put
together around the form's marks. Nothing is shuffled and no Python runs on the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_or_empty

#: A unit: a run of other characters with the blanks before it, or blanks that nothing follows.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Marks:
    """What stands before each part. No proper end of one may begin another, so that none arises where parts meet."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        own = (self.prefix, self.suffix, self.middle)
        if not all(own) or any(a in b for a in own for b in own if a is not b):
            raise ValueError("marks must not be empty, and none may hold another")
        if any(a.endswith(b[:n]) for a in own for b in own for n in range(1, len(b)) if n < len(a)):
            raise ValueError("an end of a mark begins another mark")


#: Delimiter and escape sign. Neither is a blank, nor are the letters behind the escape sign, so units stay the same.
_CUT, _ESCAPE = "\x1e", "\x1b"


def _replaced(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escaped(text: Column) -> Column:
    """``text`` without a delimiter in it; ``unescaped`` is the way back."""
    return _replaced(_replaced(text, _ESCAPE, f"{_ESCAPE}e"), _CUT, f"{_ESCAPE}c")


def unescaped(text: Column) -> Column:
    return _replaced(_replaced(text, f"{_ESCAPE}c", _CUT), f"{_ESCAPE}e", _ESCAPE)


def marked(text: Column, unit: str = UNIT) -> Column:
    """Escaped ``text`` with a delimiter after every unit."""
    return F.regexp_replace(escaped(text), f"({unit})", f"$1{_CUT}")


def n_units(of: Column) -> Column:
    return F.length(of) - F.length(_replaced(of, _CUT, ""))


def units_between(of: Column, first: Column, last: Column, n: Column) -> Column:
    """Text of units ``first`` (excluded, so 0 for the start) to ``last`` of ``n``, from marked text."""
    upto = F.when(last == n, of).otherwise(F.call_function("substring_index", of, F.lit(_CUT), last))
    # A full text ends in a delimiter, behind which substring_index sees one more, empty part.
    cut = F.call_function("substring_index", upto, F.lit(_CUT), -(last - first + F.when(last == n, 1).otherwise(0)))
    return F.when(first < last, unescaped(_replaced(cut, _CUT, ""))).otherwise("")


def transform(
    docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, marks: Marks = Marks(), unit: str = UNIT, into: str = "fim"
) -> DataFrame:
    """``docs`` with a struct column ``into``: ``n, form, prefix_chars, middle_chars, output``.

    Both cuts come from the hash of seed and doc_id, so they don't depend on how rows are dealt. Out of a hundred
    documents ``rate`` are transformed, and out of a hundred of these ``spm_rate`` put the suffix first (``spm``), the
    others the prefix (``psm``). The form is ``plain``, and the output the text, for the other documents, for empty
    texts and for texts that hold a mark; the numbers of characters (code points) are null there.

    A null text is an empty one. Very long texts are cut whole. A null doc_id counts as an empty text in the hash, rows
    that repeat are transformed alike, an empty table stays empty, and all other columns stay, whatever their names; one
    called like ``into`` is replaced.
    """
    whole, hashed, cut, n, low, high, form, prefix, middle, suffix = fresh(
        docs, "whole", "hashed", "cut", "n", "low", "high", "form", "prefix", "middle", "suffix"
    )
    c = F.col
    draw = lambda k: F.conv(F.substring(c(hashed), 8 * k - 7, 8), 16, 10).cast("long")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(c("doc_id").cast("string"), F.lit("")))
    rows = docs.withColumns({whole: text_or_empty(), hashed: F.sha2(key, 256)})
    rows = rows.withColumn(cut, marked(c(whole), unit)).withColumn(n, n_units(c(cut)))
    a, b = draw(1) % (c(n) + 1), draw(2) % (c(n) + 1)
    holds = lambda mark: F.contains(c(whole), F.lit(mark))
    plain = (c(n) == 0) | holds(marks.prefix) | holds(marks.suffix) | holds(marks.middle) | (draw(3) % 100 >= rate)
    chosen = F.when(plain, "plain").when(draw(4) % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.withColumns({low: F.least(a, b).cast("int"), high: F.greatest(a, b).cast("int"), form: chosen})
    part = lambda first, last: F.when(c(form) != "plain", units_between(c(cut), first, last, c(n)))
    rows = rows.withColumns({prefix: part(F.lit(0), c(low)), middle: part(c(low), c(high)), suffix: part(c(high), c(n))})
    first, second, last = F.lit(marks.prefix), F.lit(marks.suffix), F.lit(marks.middle)
    output = (
        F.when(c(form) == "plain", c(whole))
        .when(c(form) == "psm", F.concat(first, c(prefix), second, c(suffix), last, c(middle)))
        .otherwise(F.concat(second, c(suffix), first, c(prefix), last, c(middle)))
    )
    found = F.struct(
        c(n).cast("long").alias("n"),
        c(form).alias("form"),
        F.length(prefix).cast("long").alias("prefix_chars"),
        F.length(middle).cast("long").alias("middle_chars"),
        output.alias("output"),
    )
    return rows.withColumn(into, found).drop(whole, hashed, cut, n, low, high, form, prefix, middle, suffix)


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text that ``output`` of a ``form`` was made from."""
    ahead, behind = (lambda text, mark: F.substring_index(text, mark, 1)), (lambda text, mark: F.substring_index(text, mark, -1))
    middle, rest = behind(output, marks.middle), ahead(output, marks.middle)
    psm = F.concat(behind(ahead(rest, marks.suffix), marks.prefix), middle, behind(rest, marks.suffix))
    spm = F.concat(behind(rest, marks.prefix), middle, behind(ahead(rest, marks.prefix), marks.suffix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
