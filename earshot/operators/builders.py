"""Builders of harmonised tables from raw survey cells: responses, clips, embedding and summary records."""

from __future__ import annotations

import base64
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions import scores, texts
from earshot.functions.scores import ITEMS, eventfulness, half_even, pleasantness
from earshot.operators.aggregates import with_coordinates
from earshot.operators.numbering import dense_numbers
from earshot.operators.tables import saved


def require_columns(df: DataFrame, columns: Sequence[str], table: str) -> None:
    """An error that names the columns which a table lacks."""
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise ValueError(f"{table} lacks columns: {', '.join(gone)}")


def synonyms(item: str) -> list[str]:
    """Names under which sources keep an item, the one that decides last."""
    n = ITEMS.index(item) + 1
    return [item, f"PAQ{n}_{item}", f"mean_PAQ{n}_{item}"]


def canonical_items(df: DataFrame) -> dict[str, Column]:
    """The eight items of a table by their own names: of several columns for one item the last in the table decides,
    even where it is null; an item without a column is null."""
    out = {}
    for item in ITEMS:
        named = [c for c in df.columns if c in synonyms(item)]
        out[item] = F.col(f"`{named[-1]}`").cast("double") if named else F.lit(None).cast("double")
    return out


def six_digits(x: Column) -> Column:
    """x as its six leading digits give it, halves by the exact value of the double (Java's %g rounds its shortest text).

    x times a power of ten is rounded; where that product is a half, the error of the multiplication, found by splitting
    both numbers in two, says on which side the exact product lies.
    """
    ten = lambda n: F.rint(F.pow(F.lit(10.0), n))
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  (computed once)

    def halves(n: Column) -> Column:
        """a (size), b (scale): the parts of both, and their product."""
        high = lambda v: v * 134217729.0 - (v * 134217729.0 - v)
        return F.struct(n["a"].alias("a"), n["b"].alias("b"), high(n["a"]).alias("ah"), high(n["b"]).alias("bh"), (n["a"] * n["b"]).alias("p"))

    def rounded(n: Column) -> Column:
        down, al, bl = F.floor(n["p"]), n["a"] - n["ah"], n["b"] - n["bh"]
        error = ((n["ah"] * n["bh"] - n["p"]) + n["ah"] * bl + al * n["bh"]) + al * bl
        up = F.when(error > 0, down + 1.0).when(error < 0, down + 0.0).otherwise(F.rint(n["p"]))
        return F.when(n["p"] - down == 0.5, up).otherwise(F.rint(n["p"])) / n["b"]

    def scaled(a: Column, tens: Column) -> Column:
        small = let(F.struct(a.alias("a"), ten(5 - tens).alias("b")), lambda n: let(halves(n), rounded))
        return F.when(tens > 5, F.rint(a / ten(tens - 5)) * ten(tens - 5)).otherwise(small)

    def placed(a: Column, guess: Column) -> Column:
        tens = F.when(a >= F.pow(F.lit(10.0), guess + 1), guess + 1).when(a < F.pow(F.lit(10.0), guess), guess - 1).otherwise(guess)
        return let(tens, lambda t: scaled(a, t))

    sized = let(F.abs(x), lambda a: let(F.floor(F.log10(a)).cast("int"), lambda g: placed(a, g)))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * sized)


def label_column(label: str) -> str:
    """The column of a source label: lower case, runs of other signs as underscores."""
    return "source_" + re.sub("[^a-z0-9]+", "_", label.lower()).strip("_")


def likert(raw: Column) -> Column:
    return 1 + 4 * raw / 100


def site_responses(rows: DataFrame) -> DataFrame:
    """Responses on site with ids and coordinates to four decimals, null where an item is: one narrow pass."""
    of = canonical_items(rows)
    clip = F.concat_ws("_", F.lit("SITE"), *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in ("location", "session", "grp")])
    return rows.select(clip.alias("clip_id"), F.concat(clip, F.lit("_R"), F.col("response_key").cast("string")).alias("response_id"), *[c.alias(i) for i, c in of.items()],
                       half_even(pleasantness(of), 4).alias("iso_pleasant"), half_even(eventfulness(of), 4).alias("iso_eventful"))


def site_clips(rows: DataFrame, first: Sequence[str]) -> DataFrame:
    """Clips of responses on site: count, item means to three decimals, the coordinates of those, and columns of the
    first response (smallest response_key), nulls kept. Rows with a null key are left out."""
    keys = ["location", "session", "grp"]
    head = F.min_by(F.struct(*first), "response_key").alias("_first")
    means = [half_even(F.avg(i), 3).alias(i) for i in ITEMS]
    out = rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n"), *means, head)
    of = {i: F.col(i) for i in ITEMS}
    clip = F.concat_ws("_", F.lit("SITE"), *keys).alias("clip_id")
    return out.select(clip, "n", *ITEMS, half_even(pleasantness(of), 4).alias("iso_pleasant"), half_even(eventfulness(of), 4).alias("iso_eventful"), *[F.col(f"_first.{c}").alias(f"first_{c}") for c in first])


def sequential_ids(rows: DataFrame, order: list[str], prefix: str, name: str) -> DataFrame:
    """rows with prefix and their number in order (six digits at least)."""
    numbered = dense_numbers(rows, order, "_number")
    return numbered.withColumn(name, texts.padded_id(prefix, F.col("_number"), 6)).drop("_number")


STIMULUS_KEYS = ["fold", "soundscape", "masker", "smr"]


def stimulus_tables(responses: DataFrame, people: DataFrame, announced: DataFrame, prefix: str, shared: bool = True) -> tuple[DataFrame, DataFrame]:
    """Responses with their person's columns, coordinates and clip_id, and one clip for each stimulus that was announced or
    answered: its keys, n, mean_calm and iso_pleasant, n 0 and no means where nobody answered.

    Both read one table, written once, which stays until the application ends; with shared=False, for a single reader,
    none is written. Clips are numbered in the order of their keys, nulls last. Coordinates are summed in whole millionths, so that reruns agree.
    """
    listed = responses.select(*STIMULUS_KEYS).unionByName(announced.select(*STIMULUS_KEYS)).distinct()
    clips = sequential_ids(listed, STIMULUS_KEYS, prefix, "clip_id")
    keys = clips.select(*[F.col(k).alias(f"_{k}") for k in STIMULUS_KEYS], "clip_id")
    scored = with_coordinates(responses.join(people, "participant", "left"))
    same = [scored[k].eqNullSafe(keys[f"_{k}"]) for k in STIMULUS_KEYS]
    placed = scored.join(keys, same, "left").drop(*keys.columns[:-1])
    placed = saved(placed) if shared else placed
    micro = F.sum(F.rint(F.col("iso_pleasant") * 1_000_000).cast("long")) / (F.count("iso_pleasant") * 1_000_000)
    means = placed.groupBy("clip_id").agg(F.count("*").alias("n"), F.avg("calm").alias("mean_calm"), micro.alias("iso_pleasant"))
    return placed, clips.join(means, "clip_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rated_rows(rows: DataFrame) -> DataFrame:
    """Raw ratings (text, 0 to 100) as five-point values, nulls for blanks and for ratings out of range; rows of a blank
    recording are left out. One narrow pass."""
    kept = rows.filter(F.trim(F.coalesce("recording", F.lit(""))) != "")
    raw = {i: scores.within(texts.number(F.col(i)), 0, 100) for i in ITEMS}
    of = {i: likert(x) for i, x in raw.items()}
    return kept.select("row", F.trim("recording").alias("recording"), F.trim("participant").alias("participant"), F.trim("language").alias("language"), scores.safe_id(F.trim("recording"), "RATED_").alias("clip_id"),
                      *[c.alias(i) for i, c in of.items()], texts.number(F.col("loud")).alias("loud"))


def rated_responses(rows: DataFrame) -> DataFrame:
    """rated_rows() with ids in order of their rows, and coordinates."""
    named = {i: F.col(i) for i in ITEMS}
    return sequential_ids(rated_rows(rows), ["row"], "RATED_", "response_id").withColumns({"iso_pleasant": pleasantness(named), "iso_eventful": eventfulness(named)})


def rated_clips(responses: DataFrame) -> DataFrame:
    """Clips of rated responses: counts, distinct participants and languages, means of what is there, the coordinates of
    the means. Ratings are whole hundredths of points, so sums are exact and reruns agree."""
    mean = lambda c, scale: (F.sum(F.rint(F.col(c) * scale).cast("long")) / (F.count(c) * scale)).alias(c)
    out = responses.groupBy("clip_id").agg(F.count("*").alias("n_responses"), F.count_distinct("participant").alias("n_participants"), F.count_distinct("language").alias("n_languages"), F.min_by("recording", "row").alias("recording"),
                                           *[mean(i, 10_000) for i in ITEMS], mean("loud", 100))
    of = {i: F.col(i) for i in ITEMS}
    scored = out.withColumns({"iso_pleasant": pleasantness(of), "iso_eventful": eventfulness(of)})
    return scored.withColumn("audio_asset", F.concat(F.lit("rated/"), "recording", F.lit(".wav")))


def flagged_responses(rows: DataFrame, labels: Sequence[str], text: str) -> DataFrame:
    """rows with a column for each source label: 1 where the text names it, else 0."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return rows.select("*", *[low.contains(label.lower()).cast("int").alias(label_column(label)) for label in labels])


def item_objects(rows: DataFrame, keys: Sequence[str], value_type: str, aggregation: str | None) -> DataFrame:
    """keys, item, value, original_field, value_type, aggregation: the eight items as records of their own, apart from
    derived coordinates."""
    said = {"original_field": F.col("item"), "value_type": F.lit(value_type), "aggregation": F.lit(aggregation).cast("string")}
    return rows.unpivot(list(keys), list(ITEMS), "item", "value").withColumns(said)


def feature_groups(rows: DataFrame, key: str, groups: dict[str, Sequence[tuple[str, str]]], provenance: str) -> DataFrame:
    """key, feature_group, name, value, unit, provenance: columns named with their units in groups; nulls stay."""
    listed = [F.struct(F.lit(g).alias("feature_group"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value"), F.lit(u).alias("unit"), F.lit(provenance).alias("provenance")) for g, fields in groups.items() for c, u in fields]
    return rows.select(key, F.explode(F.array(*listed)).alias("f")).select(key, "f.*")


def view_status(present: Column, complete: Column | None = None) -> Column:
    """How far a view of a record is there."""
    whole = F.lit(True) if complete is None else complete
    return F.when(present & whole, "available").when(present, "partial").otherwise("not_reported")


def embedding_records(clips: DataFrame, vectors: DataFrame, model: str, missing: str = "skip") -> tuple[DataFrame, DataFrame]:
    """Feature records of clips(clip_id, ...) that have a vector in vectors(clip_id, embedding), and the clips without.

    Vectors are kept as base64 of little-endian 32-bit numbers. With missing="raise", a clip without one is an error.
    """

    def encoded(column: pd.Series) -> pd.Series:
        return column.map(lambda v: base64.b64encode(np.asarray(v, "<f4").tobytes()).decode("ascii"))

    lost = clips.join(vectors.select("clip_id"), "clip_id", "left_anti")
    if missing == "raise" and not lost.isEmpty():
        raise ValueError("some clips have no vector")
    joined = clips.select("clip_id").join(vectors.filter("embedding IS NOT NULL").select("clip_id", "embedding"), "clip_id")
    text = F.pandas_udf(encoded, "string")
    out = joined.select(F.concat(F.lit("clipemb_"), F.col("clip_id").cast("string")).alias("feature_id"), "clip_id", F.lit("visual_clip_embedding").alias("feature_type"), F.lit("base64").alias("value_format"),
                        F.size("embedding").alias("embedding_dim"), F.lit("float32").alias("dtype"), F.lit("center_frame").alias("pooling"), texts.model_name(F.lit(model)).alias("model_name"), text("embedding").alias("embedding_base64"))
    return out, lost


def replaced(old: DataFrame, new: DataFrame, feature_type: str, scope: str = "type") -> DataFrame:
    """old without the records of a type that name a clip (scope "type") or those of new's clips (scope "clip"), and new."""
    mine = (F.col("feature_type") == feature_type) & (F.coalesce("clip_id", F.lit("")) != "")
    mine = F.coalesce(mine, F.lit(False))
    if scope == "type":
        kept = old.filter(~mine)
    else:
        kept = old.filter(~mine).unionByName(old.filter(mine).join(new.select("clip_id").distinct(), "clip_id", "left_anti").select(*old.columns))
    return kept.unionByName(new.select(*old.columns))


def replaced_by_id(old: DataFrame, new: DataFrame, feature_type: str) -> DataFrame:
    """old without the records of a type and without those whose feature_id new has, and new, of whose rows with one id
    the last (largest pos) stays."""
    last = new.groupBy("feature_id").agg(F.max_by(F.struct(*new.columns), "pos").alias("r")).select("r.*")
    kept = old.filter(~F.coalesce(F.col("feature_type") == feature_type, F.lit(False)))
    return kept.join(last.select("feature_id"), "feature_id", "left_anti").select(*old.columns).unionByName(last.select(*old.columns))


def first_of(candidates: DataFrame, key: str, priority: str) -> DataFrame:
    """Of the candidates of each key, that of the smallest priority; partial minima come before the shuffle."""
    return candidates.groupBy(key).agg(F.min_by(F.struct(*candidates.columns), priority).alias("r")).select("r.*")


def head_of(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows in order."""
    return df.orderBy(*order).limit(n)


def row_numbers(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """df with the number of each row in its file: its place in order, and one for the header."""
    return dense_numbers(df, order, "_n").withColumn(name, F.col("_n") + 1).drop("_n")


