"""Column functions that turn raw survey cells into values and ids; text that does not parse gives null, never an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells that count as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
_DIGITS = "[0-9](?:_?[0-9])*"
#: How a number may be spelled: decimal, with an exponent, single underscores between digits; or infinite.
SPELLED = rf"^[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?|(?i:inf(?:inity)?))$"
#: White space at a cell's ends.
SPACES = " \t\n\x0b\x0c\r"
#: Units of a size text.
UNITS = {"B": 1, "KB": 10**3, "MB": 10**6, "GB": 10**9}


def blank_to_null(x: Column) -> Column:
    """x without spaces at its ends; null if nothing is left."""
    return F.nullif(F.trim(x), F.lit(""))


def present(x: Column) -> Column:
    """x, or null where it is one of the cells that count as missing."""
    return F.when(~x.isin(*MISSING), x)


def number(x: Column) -> Column:
    """The double that a cell spells; null for anything else, and for NaN. Casts alone would also read 0.5d or 0x1p-1."""
    cell = F.trim(x, F.lit(SPACES))
    return F.when(cell.rlike(SPELLED), F.replace(cell, F.lit("_"), F.lit("")).try_cast("double"))


def number_or(x: Column, default: float = 0.0) -> Column:
    return F.coalesce(number(x), F.lit(default))


def whole_number(x: Column) -> Column:
    """The number that a cell spells, cut towards zero."""
    return number(x).cast("long")


def first_integer(x: Column) -> Column:
    """The first run of digits in a text."""
    return F.nullif(F.regexp_extract(x, "[0-9]+", 0), F.lit("")).try_cast("long")


def composite_id(prefix: str, *parts: Column) -> Column:
    """prefix and parts joined by underscores; null parts are left out."""
    return F.concat_ws("_", F.lit(prefix), *[p.cast("string") for p in parts])


def padded_id(prefix: str, n: Column, width: int) -> Column:
    """prefix and n with leading zeros up to width; longer numbers stay whole."""
    return F.format_string(f"{prefix}%0{width}d", n)


def asset_id(x: Column, strip_ext: bool = False) -> Column:
    """The panorama of a recording's segment: _segment_ and what follows gone, then _360.

    The extension .wav stays where no segment follows it, unless strip_ext is set.
    """
    stem = F.regexp_replace(x, r"\.wav$", "") if strip_ext else x
    return F.concat(F.regexp_replace(stem, "_segment_.*$", ""), F.lit("_360"))


def model_name(x: Column) -> Column:
    """A model's name with a hyphen for the slash of its patch size."""
    return F.regexp_replace(x, "^(ViT-[BL])/", "$1-")


def size_bytes(x: Column) -> Column:
    """Bytes of a size text such as 1.4 MB."""
    unit = F.upper(F.regexp_extract(x, r"([A-Za-z]+)\s*$", 1))
    factor = reduce(lambda e, kv: e.when(unit == kv[0], F.lit(kv[1])), UNITS.items(), F.when(F.lit(False), F.lit(1)))
    return F.rint(F.regexp_extract(x, r"[0-9]+(?:\.[0-9]+)?", 0).try_cast("double") * factor).cast("long")


def short_name(x: Column) -> Column:
    """What stands in parentheses at the end of a dataset's name, else the name."""
    return F.coalesce(F.nullif(F.regexp_extract(x, r"\(([^)]+)\)$", 1), F.lit("")), x)
