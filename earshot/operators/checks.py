"""Declared constraints of tables, checked into findings; packages of tables rolled up."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from earshot.functions import texts

# Texts of truth values.
TRUTHS = ("true", "True", "TRUE", "1", "false", "False", "FALSE", "0")


@dataclass(frozen=True)
class Field:
    """A column and its constraints. `kind` (string, number, integer or boolean) is of columns that hold raw text: their
    cells are read by it, and an empty one counts as null."""

    name: str
    kind: str | None = None
    required: bool = False
    unique: bool = False
    minimum: float | None = None
    maximum: float | None = None
    enum: tuple = ()
    pattern: str | None = None
    format: str | None = None

    def raw(self) -> Column:
        c = F.col(f"`{self.name}`")
        return F.nullif(c, F.lit("")) if self.kind else c

    def value(self) -> Column:
        """The cell by its kind; null where it is not of it."""
        raw = self.raw()
        if self.kind == "integer":
            return F.when(F.trim(raw).rlike("^[+-]?[0-9]+$"), F.trim(raw).try_cast("bigint"))
        if self.kind == "number":
            return texts.number(raw)
        return raw

    def broken(self) -> list[tuple[str, Column]]:
        """(rule, whether a row breaks it); other rules than required pass nulls."""
        c, rules = self.value(), []
        if self.required:
            rules.append(("required", self.raw().isNull()))
        if self.kind == "boolean":
            rules.append(("type", ~self.raw().isin(*TRUTHS)))
        elif self.kind in ("number", "integer"):
            rules.append(("type", self.raw().isNotNull() & c.isNull()))
        if self.minimum is not None:
            rules.append(("minimum", c < self.minimum))
        if self.maximum is not None:
            rules.append(("maximum", c > self.maximum))
        if self.enum:
            rules.append(("enum", ~c.isin(*self.enum)))
        if self.pattern:
            rules.append(("pattern", ~c.rlike(f"^({self.pattern})$")))
        if self.format == "uri":
            rules.append(("format", ~c.rlike("^[A-Za-z][A-Za-z0-9+.-]*:[^ ]")))
        return rules

    def constraints(self) -> dict:
        names = ("required", "unique", "minimum", "maximum", "enum", "pattern", "format")
        return {k: v for k in names if (v := getattr(self, k)) not in (None, False, ())}


def row_findings(df: DataFrame, key: str, fields: list[Field]) -> DataFrame:
    """row_key, field, rule of every broken constraint of single rows, in one pass."""
    marks = [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(f.name).alias("field"), F.lit(rule).alias("rule"))) for f in fields for rule, bad in f.broken()]
    return df.select(F.col(key).alias("row_key"), F.explode(F.array_compact(F.array(*marks))).alias("f")).select("row_key", "f.field", "f.rule")


def later_repeats(df: DataFrame, key: str, field: Field) -> DataFrame:
    """row_key, field, rule of all rows of a value but the one of the smallest row key; nulls repeat nothing."""
    rows = df.select(F.col(key).alias("row_key"), field.raw().alias("_v")).filter("_v IS NOT NULL")
    firsts = rows.groupBy("_v").agg(F.min("row_key").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").select("_v", "_first")
    return rows.join(firsts, "_v").filter("row_key > _first").select("row_key", F.lit(field.name).alias("field"), F.lit("unique").alias("rule"))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose key is not null and not in parent."""
    keys = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.filter(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


@dataclass
class Resource:
    """A table of a package with its schema: fields, primary key and foreign keys (column, resource, its column)."""

    name: str
    rows: DataFrame
    row_key: str
    fields: list[Field]
    primary_key: str | None = None
    foreign_keys: tuple[tuple[str, str, str], ...] = ()


def header_findings(resource: Resource) -> list[tuple[str, str]]:
    """(field, rule) of declared columns that the table lacks and of others that it has beside its row key."""
    have, want = [c for c in resource.rows.columns if c != resource.row_key], [f.name for f in resource.fields]
    return [(c, "missing_column") for c in want if c not in have] + [(c, "extra_column") for c in have if c not in want]


def package_findings(resources: list[Resource]) -> DataFrame:
    """resource, row_key, field, rule of all broken constraints of a package; header findings have no row key.

    Fields whose column is missing break nothing else. A primary key is required and unique. Row rules are one pass;
    unique fields and foreign keys are a shuffle each. A foreign key to a resource that is not there is an error.
    """
    spark, by_name, found = resources[0].rows.sparkSession, {r.name: r for r in resources}, []
    for r in resources:
        header = header_findings(r)
        fields = [f for f in r.fields if (f.name, "missing_column") not in header]
        parts = []
        if header:
            parts.append(spark.createDataFrame([(None, *h) for h in header], "row_key long, field string, rule string"))
        keyed = [Field(**(f.__dict__ | {"required": True, "unique": True})) if f.name == r.primary_key else f for f in fields]
        parts.append(row_findings(r.rows, r.row_key, keyed))
        parts += [later_repeats(r.rows, r.row_key, f) for f in keyed if f.unique]
        for column, other, target in r.foreign_keys:
            child = r.rows.select(F.col(r.row_key).alias("row_key"), F.nullif(F.col(column).cast("string"), F.lit("")).alias("_k"))
            lost = orphans(child, by_name[other].rows.select(F.col(target).cast("string").alias("_t")), "_k", "_t")
            parts.append(lost.select("row_key", F.lit(column).alias("field"), F.lit("foreign_key").alias("rule")))
        found += [p.select(F.lit(r.name).alias("resource"), F.col("row_key").cast("long"), "field", "rule") for p in parts]
    return reduce(DataFrame.unionByName, found)


def roll_up(package: str, resources: list[Resource], findings: DataFrame) -> DataFrame:
    """package, resource, findings, valid: one row for each resource, whether anything was found or not."""
    listed = findings.sparkSession.createDataFrame([(package, r.name) for r in resources], "package string, resource string")
    counts = findings.groupBy("resource").agg(F.count("*").alias("findings"))
    joined = listed.join(counts, "resource", "left").withColumn("findings", F.coalesce("findings", F.lit(0)))
    return joined.select("package", "resource", "findings", (F.col("findings") == 0).alias("valid"))


def written_with_counts(findings: DataFrame, path: str, counts: dict[str, Column]) -> dict[str, int]:
    """Write findings, and count what holds of them in the same pass: no second job, nor one for each count."""
    seen = Observation()
    findings.observe(seen, *[F.count_if(cond).alias(name) for name, cond in counts.items()]).write.mode("overwrite").parquet(path)
    return seen.get


def described(spark: SparkSession, package: str, resources: list[Resource]) -> DataFrame:
    """package, resource, position, field, kind, constraints (JSON): what the schemas declare, one row for each field."""
    rows = [(package, r.name, i, f.name, f.kind or "any", json.dumps(f.constraints(), sort_keys=True)) for r in resources for i, f in enumerate(r.fields, 1)]
    return spark.createDataFrame(rows, "package string, resource string, position long, field string, kind string, constraints string")
