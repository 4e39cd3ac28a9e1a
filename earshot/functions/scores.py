"""Column functions of survey scores, names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The eight perceived affective qualities of ISO 12913, in questionnaire order.
ITEMS = ("pleasant", "vibrant", "eventful", "chaotic", "annoying", "monotonous", "uneventful", "calm")
#: cos(45 degrees) and 4 + sqrt(32).
COS45, SCALE = 0.7071067811865476, 9.65685424949238


def half_even(x: Column, digits: int) -> Column:
    """x rounded to digits decimals: scaled, rounded half to even, scaled back."""
    return F.rint(x * F.lit(float(10**digits))) / F.lit(float(10**digits))


def pleasantness(of: dict[str, Column]) -> Column:
    """The pleasantness coordinate of eight items; null if any is."""
    return ((of["pleasant"] - of["annoying"]) + F.lit(COS45) * ((of["calm"] - of["chaotic"]) + (of["vibrant"] - of["monotonous"]))) / F.lit(SCALE)


def eventfulness(of: dict[str, Column]) -> Column:
    """The eventfulness coordinate of eight items; null if any is."""
    return ((of["eventful"] - of["uneventful"]) + F.lit(COS45) * ((of["chaotic"] - of["calm"]) + (of["vibrant"] - of["monotonous"]))) / F.lit(SCALE)


def items(prefix: str = "") -> dict[str, Column]:
    return {i: F.col(prefix + i) for i in ITEMS}


def within(x: Column, low: float, high: float) -> Column:
    """x, or null outside [low, high]."""
    return F.when(x.between(low, high), x)


def safe_id(x: Column, prefix: str = "") -> Column:
    """Runs other than ASCII letters and digits as one underscore, none at the ends, after prefix."""
    return F.concat(F.lit(prefix), F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def canonical_class(x: Column, aliases: dict[str, str] | None = None) -> Column:
    """Lower case, hyphens and runs of white space as one space, none at the ends; then its alias, or underscores for
    spaces."""
    plain = F.trim(F.regexp_replace(F.replace(F.lower(x), F.lit("-"), F.lit(" ")), r"(?U)\s+", " "))
    return F.coalesce(literal_map(aliases or {}, plain), F.replace(plain, F.lit(" "), F.lit("_")))


def literal_map(pairs: dict[str, str], x: Column) -> Column:
    """What a literal of the plan names for x, null if nothing."""
    if not pairs:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv]), x)


def split_of(fold: Column, dev_fold: Column) -> Column:
    """Auxiliary (-1), test (0, 6, 7), dev (the dev fold) or train."""
    return F.when(fold == -1, "aux").when(fold.isin(0, 6, 7), "test").when(fold == dev_fold, "dev").otherwise("train")


def seconds_of(x: Column) -> Column:
    """Seconds in a duration text: its first run of digits and points, in hours or minutes if it says so; null where
    there is none or it spells no number."""
    low = F.lower(x)
    value = F.nullif(F.regexp_extract(low, "([0-9.]+)", 1), F.lit("")).try_cast("double")
    return value * F.when(low.contains("hour"), 3600.0).when(low.contains("min"), 60.0).otherwise(1.0)


def center_frame(start: Column, end: Column, fps: Column, frames: Column) -> tuple[Column, Column]:
    """(time, index) of the frame in the middle of a segment; without frames or a rate, the middle and 0."""
    t = F.greatest((start + end) / 2, F.lit(0.0))
    bad = (fps <= 0) | (frames <= 0)
    index = F.when(bad, F.lit(0)).otherwise(F.least(F.greatest(F.rint(t * fps).cast("long"), F.lit(0)), frames - 1)).cast("long")
    return F.when(bad, t).otherwise(index / fps), index
