"""Table descriptors read as data: their fields and constraints are rows, joined to cells, whatever their number.

A descriptor is a JSON object with `fields` (name, type, format, constraints), `primaryKey` and `foreignKeys`. Cells of all
tables are rows (resource, row_key, field, value): one join and one pass check every rule of single cells, so that a plan
does not grow with the fields. What compares cells (unique values, keys of other tables) is one shuffle for all fields.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions import texts
from earshot.operators.checks import TRUTHS

_TEXT = "array<string>"
CONSTRAINTS = f"struct<required: boolean, unique: boolean, minimum: double, maximum: double, enum: {_TEXT}, pattern: string>"
FIELD = f"struct<name: string, type: string, format: string, constraints: {CONSTRAINTS}>"
#: primaryKey is a name or a list of names; a foreign key's fields too. Both are read as text and told apart.
DESCRIPTOR = f"fields array<{FIELD}>, primaryKey string, foreignKeys array<struct<fields: string, reference: struct<resource: string, fields: string>>>"


def names_in(text: Column) -> Column:
    """One name, or the names of a JSON list."""
    return F.when(text.startswith("["), F.from_json(text, _TEXT)).otherwise(F.array(text))


def parsed(descriptors: DataFrame) -> DataFrame:
    """resource, doc of descriptors(resource, value); doc is null where the value is no JSON object."""
    return descriptors.select("resource", F.from_json("value", DESCRIPTOR, {"mode": "PERMISSIVE"}).alias("doc"))


def schema_fields(descriptors: DataFrame) -> DataFrame:
    """A row for each declared field: resource, position (from 1), field, kind, format and its constraints. A field of a
    primary key is required; where the key is that field alone, unique too. Missing constraints are null, or false."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    key = parsed(descriptors).select("resource", names_in(F.col("doc.primaryKey")).alias("key"))
    key = key.select("resource", F.explode("key").alias("field"), (F.size("key") == 1).alias("alone")).groupBy("resource", "field").agg(F.bool_or("alone").alias("alone"))
    rows = parsed(descriptors).select("resource", F.col("doc.fields").alias("fields")).select("resource", F.posexplode("fields").alias("pos", "f"))
    c = F.col("f.constraints")
    rows = rows.select("resource", (F.col("pos") + 1).alias("position"), F.col("f.name").alias("field"), F.coalesce("f.type", F.lit("any")).alias("kind"), F.col("f.format").alias("format"), flag(c["required"]).alias("required"), flag(c["unique"]).alias("unique"), *[c[n].alias(n) for n in ("minimum", "maximum", "enum", "pattern")])
    both = {"required": F.col("required") | F.col("alone").isNotNull(), "unique": F.col("unique") | flag(F.col("alone"))}
    return rows.join(key, ["resource", "field"], "left").withColumns(both).drop("alone")


def foreign_keys(descriptors: DataFrame) -> DataFrame:
    """resource, field, parent, parent_field of the foreign keys of single fields; an empty parent is the resource itself."""
    keys = parsed(descriptors).select("resource", F.explode("doc.foreignKeys").alias("k"))
    pairs = keys.select("resource", "k.reference.resource", F.arrays_zip(names_in(F.col("k.fields")).alias("a"), names_in(F.col("k.reference.fields")).alias("b")).alias("p")).toDF("resource", "other", "p")
    return pairs.filter(F.size("p") == 1).select("resource", F.col("p")[0]["a"].alias("field"), F.coalesce(F.nullif("other", F.lit("")), "resource").alias("parent"), F.col("p")[0]["b"].alias("parent_field"))


def cells_of(resource: str, rows: DataFrame, row_key: str) -> DataFrame:
    """resource, row_key, field, value of a table's columns but its row key; nulls and empty texts are null cells."""
    cells = [F.struct(F.lit(c).alias("field"), F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")).alias("value")) for c in rows.columns if c != row_key]
    return rows.select(F.lit(resource).alias("resource"), F.col(row_key).cast("long").alias("row_key"), F.explode(F.array(*cells)).alias("c")).select("resource", "row_key", "c.*")


def headers_of(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """resource, field of the columns of tables {resource: (rows, row key)}."""
    spark = next(iter(tables.values()))[0].sparkSession
    return spark.createDataFrame([(r, c) for r, (df, key) in tables.items() for c in df.columns if c != key], "resource string, field string")


def cell_rules() -> dict[str, Column]:
    """Whether a cell breaks each rule of its field (columns of cells joined to schema_fields()); others than required
    pass nulls. Patterns match the whole cell; enumerations of numbers compare numbers."""
    v, kind = F.col("value"), F.col("kind")
    whole = F.when(F.trim(v).rlike("^[+-]?[0-9]+$"), F.trim(v).try_cast("bigint"))
    number = F.when(kind == "integer", whole.cast("double")).when(kind == "number", texts.number(v))
    typed = F.when(kind == "integer", whole.isNotNull()).when(kind == "number", texts.number(v).isNotNull()).when(kind == "boolean", v.isin(*TRUTHS)).otherwise(True)
    listed = F.when(kind.isin("integer", "number"), F.exists("enum", lambda e: e.try_cast("double") == number)).otherwise(F.array_contains("enum", v))
    return {
        "required": F.col("required") & v.isNull(),
        "type": ~typed & v.isNotNull(),
        "minimum": number < F.col("minimum"),
        "maximum": number > F.col("maximum"),
        "enum": F.when(typed, ~listed),
        "pattern": ~F.regexp_like(v, F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")$"))),
        "format": (F.col("format") == "uri") & ~v.rlike("^[A-Za-z][A-Za-z0-9+.-]*:[^ ]"),
    }


def described_findings(cells: DataFrame, headers: DataFrame, descriptors: DataFrame) -> DataFrame:
    """resource, row_key, field, rule of all that cells(resource, row_key, field, value) break of descriptors(resource, value).

    headers(resource, field) are the columns that tables have: declared ones that are missing, and others, are findings
    without a row key. Cells of fields or resources that no descriptor names break nothing else; a descriptor that is no
    JSON object declares nothing. Of rows that share a unique value all but that of the smallest row key are findings. A
    foreign key to a resource without such cells finds every cell. Empty tables give no findings.
    """
    fields, keys = schema_fields(descriptors), foreign_keys(descriptors)
    named = descriptors.select("resource").distinct()
    have, want = headers.select("resource", "field"), fields.select("resource", "field")
    parts = [
        want.join(have, ["resource", "field"], "left_anti").withColumn("rule", F.lit("missing_column")),
        have.join(named, "resource", "left_semi").join(want, ["resource", "field"], "left_anti").withColumn("rule", F.lit("extra_column")),
    ]
    parts = [p.select("resource", F.lit(None).cast("long").alias("row_key"), "field", "rule") for p in parts]
    marks = [F.when(F.coalesce(bad, F.lit(False)), F.lit(rule)) for rule, bad in cell_rules().items()]
    known = cells.join(fields, ["resource", "field"])
    parts.append(known.select("resource", "row_key", "field", F.explode(F.array_compact(F.array(*marks))).alias("rule")))
    single = cells.filter("value IS NOT NULL").join(fields.filter("unique").select("resource", "field"), ["resource", "field"])
    firsts = single.groupBy("resource", "field", "value").agg(F.min("row_key").alias("first"), F.count("*").alias("n")).filter("n > 1")
    parts.append(single.join(firsts, ["resource", "field", "value"]).filter("row_key > first").select("resource", "row_key", "field", F.lit("unique").alias("rule")))
    ends = cells.filter("value IS NOT NULL").join(keys, ["resource", "field"])
    parents = keys.select("parent", "parent_field").distinct().join(cells.select(F.col("resource").alias("parent"), F.col("field").alias("parent_field"), "value"), ["parent", "parent_field"]).distinct()
    parts.append(ends.join(parents, ["parent", "parent_field", "value"], "left_anti").select("resource", "row_key", "field", F.lit("foreign_key").alias("rule")))
    return reduce(DataFrame.unionByName, parts)
