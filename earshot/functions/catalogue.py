"""Column functions of a dataset catalogue: nested values, free text to controlled values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot.functions.scores import seconds_of
from earshot.functions.texts import first_integer
from earshot.operators.samples import given, is_object, kind_is, members, plain

# Licences by what a description says, in the order in which it is asked.
LICENCES = (("cc by-nc-sa", "CC-BY-NC-SA-4.0"), ("cc by-nc", "CC-BY-NC-4.0"), ("cc by-sa", "CC-BY-SA-4.0"), ("cc by", "CC-BY-4.0"))
# Visual formats by what a text says, in order.
VISUAL_FORMATS = (("360", "360 Video"), ("image", "Images"), ("video", "Video"), ("mixed", "Mixed"))
NO_LINK, MISSPELT, PARTLY = "no available link", "Partilally", "Partially"


def at(v: Column, *keys: str) -> Column:
    """The value below some keys of nested objects; null where a key is missing, holds null, or is asked of no object."""
    path = "$" + "".join(f'["{k}"]' for k in keys)
    found = F.try_variant_get(v, path, "variant")
    return F.when(~kind_is(found, "VOID"), found)


def has_key(v: Column, key: str) -> Column:
    """Whether an object has a key, be its value null."""
    return F.map_contains_key(members(v), key)


def first_given(*values: Column) -> Column:
    """The first value that is neither null, zero, false nor empty, else the last."""
    return F.coalesce(*[F.when(given(v), v) for v in values[:-1]], values[-1])


def number_of(v: Column) -> Column:
    return plain(v).try_cast("double")


def count_of(v: Column) -> Column:
    """A whole number, cut towards zero; the first one in a text."""
    return F.when(kind_is(v, "STRING"), first_integer(plain(v))).otherwise(number_of(v).cast("long"))


def duration_of(v: Column) -> Column:
    """Seconds: a number as it is, a text by its unit, null for an empty one."""
    return F.when(kind_is(v, "STRING"), seconds_of(plain(v))).otherwise(number_of(v))


def by_words(text: Column, table: tuple[tuple[str, str], ...], otherwise: str) -> Column:
    low, out = F.lower(text), F.lit(otherwise)
    for words, value in reversed(table):
        out = F.when(low.contains(words), value).otherwise(out)
    return F.when(text.isNull(), otherwise).otherwise(out)


def licence(description: Column) -> Column:
    return by_words(description, LICENCES, "Unknown")


def visual_format(text: Column) -> Column:
    return by_words(text, VISUAL_FORMATS, "")


def setting(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(F.when(low.contains("site"), "On-site").when(low.contains("lab") | low.contains("vr"), "Lab-based").when(low == "online", "Online").when(low.contains("mixed"), "Mixed"), F.lit("Other"))


def visual_object(v: Column) -> Column:
    """A visual block as a map: a text is its Format, an object is itself, anything else is empty."""
    none = F.create_map().cast("map<string,variant>")
    return F.when(kind_is(v, "STRING"), F.create_map(F.lit("Format"), v)).when(is_object(v), members(v)).otherwise(none)


def access(text: Column) -> Column:
    return F.when(text == MISSPELT, PARTLY).otherwise(text)


def link(text: Column) -> Column:
    return F.when(text.isNull() | (text == NO_LINK), "").otherwise(text)
