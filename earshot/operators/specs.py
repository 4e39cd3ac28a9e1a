"""Mapping specs read as data: one job maps the rows of many datasets, each by its own spec.

A spec is a JSON object with dataset_id and mappings: original_field, mosaiq_field (a dotted path in the record),
transformation, required, missingness_rule and what reviewers said. Rows come as maps of texts and meet the mappings of
their dataset as one list; the record, what is missing and what is wrong are read off in the same pass.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

MAPPING = "struct<original_field: string, mosaiq_field: string, transformation: string, required: boolean, missingness_rule: string, mapping_confidence: string, evidence_type: string, review_status: string>"
# Transformations, both of which take the value as it is.
COPIED = ("direct_mapping", "direct_mapping_from_existing_derived_value")
# How rules of missing values begin, and the status that each gives.
STATUSES = {"not_accessible": "not_accessible", "not_reported": "not_reported"}
ERROR = "error if absent"


def spec_mappings(specs: DataFrame) -> DataFrame:
    """dataset_id, pos and the members of MAPPING of every mapping of specs(value); of several specs for a dataset all count."""
    doc = specs.select(F.from_json("value", f"dataset_id string, mappings array<{MAPPING}>").alias("s"))
    return doc.select("s.dataset_id", F.posexplode("s.mappings").alias("pos", "m")).select("dataset_id", "pos", "m.*").filter("mosaiq_field IS NOT NULL")


#: A record's layout: what stands before each value, which value (place in the paths) comes there, and what ends it.
LAYOUT = StructType().add("heads", ArrayType(StringType())).add("places", ArrayType(IntegerType())).add("tail", StringType())


@F.pandas_udf(LAYOUT)
def layout(paths: pd.Series) -> pd.DataFrame:
    """How a JSON object holds values at dotted paths, members in the order of first use; all null where two paths clash,
    as one is given twice or holds a value and has paths below it. It is asked once a spec, not once a row."""

    def build(own_paths):
        tree: dict = {}
        for place, path in enumerate(own_paths):
            at, parts = tree, path.split(".")
            for part in parts[:-1]:
                at = at.setdefault(part, {})
                if not isinstance(at, dict):
                    return None, None, None
            if parts[-1] in at:
                return None, None, None
            at[parts[-1]] = place
        heads, places, text = [], [], []

        def walk(node):
            if isinstance(node, dict):
                for i, (k, v) in enumerate(node.items()):
                    text.append(("," if i else "{") + json.dumps(k, ensure_ascii=False) + ":")
                    walk(v)
                text.append("}" if node else "{}")
            else:
                heads.append("".join(text))
                places.append(node)
                text.clear()

        walk(tree)
        return heads, places, "".join(text)

    return pd.DataFrame([build(p) for p in paths], columns=["heads", "places", "tail"])


def as_json(kind: Column, text: Column) -> Column:
    """A cell as JSON text: numbers and truth values as they are, other texts quoted."""
    quoted = F.rtrim(F.substring(F.to_json(F.struct(text.alias("v"))), 6, 2**31 - 1), F.lit("}"))  # {"v":"..."} ends with one } after a quote
    return F.when(text.isNull(), F.lit(None)).when(kind.isin("number", "boolean"), text).otherwise(quoted)


def planned(specs: DataFrame) -> DataFrame:
    """What the mappings of each dataset come to, whatever its rows hold: dataset_id; laid (head, original_field), the copied
    values in the record's order, and its tail, null where paths clash; soft (original_field, field, status, reason) and hard
    (original_field, field), the mappings that may and may not be absent; wrong (field, reason), errors of every row."""
    m = F.struct("pos", "original_field", "mosaiq_field", "transformation", "required", "missingness_rule")
    own = spec_mappings(specs).groupBy("dataset_id").agg(F.array_sort(F.collect_list(m)).alias("own"))  # a spec's mappings
    rule = lambda x: F.coalesce(x["missingness_rule"], F.lit(""))
    known = lambda x: F.coalesce(x["transformation"].isin(*COPIED), F.lit(False))
    fatal = lambda x: rule(x).startswith(ERROR) | F.coalesce(x["required"], F.lit(False))

    def status(x: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for start, name in STATUSES.items():
            out = out.when(rule(x).startswith(start), F.lit(name))
        return out.otherwise("unknown")

    copied = own.withColumn("copied", F.filter("own", known))
    laid = copied.withColumn("l", layout(F.transform("copied", lambda x: x["mosaiq_field"])))
    values = F.zip_with("l.heads", "l.places", lambda head, place: F.struct(head.alias("head"), F.get("copied", place)["original_field"].alias("original_field")))
    soft = F.transform(F.filter("own", lambda x: ~fatal(x)), lambda x: F.struct(x["original_field"].alias("original_field"), x["mosaiq_field"].alias("field"), status(x).alias("status"), rule(x).alias("reason")))
    hard = F.transform(F.filter("own", fatal), lambda x: F.struct(x["original_field"].alias("original_field"), x["mosaiq_field"].alias("field")))
    odd = F.transform(F.filter("own", lambda x: ~known(x)), lambda x: F.struct(x["mosaiq_field"].alias("field"), F.concat(F.lit("transformation "), F.coalesce(x["transformation"], F.lit("null"))).alias("reason")))
    clash = F.array(F.struct(F.lit("").alias("field"), F.lit("clashing paths").alias("reason")))
    wrong = F.when(F.col("l.tail").isNull(), F.concat(odd, clash)).otherwise(odd)
    return laid.select("dataset_id", values.alias("laid"), F.col("l.tail").alias("tail"), soft.alias("soft"), hard.alias("hard"), wrong.alias("wrong"))


def apply_specs(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """dataset_id, row_key, record (JSON), missing and errors of rows(dataset_id, row_key, cells, kinds).

    cells is a map of texts by field; kinds says which fields hold numbers or truth values (others are texts). Null cells
    and those that a row lacks are absent. missing has (field, status, reason) for each absent one by the rule of its
    mapping; errors has (field, reason): absent where the rule or `required` says so, transformations that are unknown,
    paths that clash (then the record is null). A dataset without a spec gives no rows here: see unmapped(). An empty table
    gives an empty table; repeated rows stay.
    """
    plan = planned(specs)
    value = lambda x: F.element_at("cells", x["original_field"])
    text = lambda x: as_json(F.coalesce(F.element_at("kinds", x["original_field"]), F.lit("string")), value(x))
    met = rows.join(plan, "dataset_id")
    record = F.concat(F.array_join(F.transform("laid", lambda x: F.concat(x["head"], F.coalesce(text(x), F.lit("null")))), ""), "tail")
    missing = F.transform(F.filter("soft", lambda x: value(x).isNull()), lambda x: F.struct(x["field"].alias("field"), x["status"].alias("status"), x["reason"].alias("reason")))
    lost = F.transform(F.filter("hard", lambda x: value(x).isNull()), lambda x: F.struct(x["field"].alias("field"), F.lit("absent").alias("reason")))
    return met.select("dataset_id", "row_key", record.alias("record"), missing.alias("missing"), F.concat(lost, "wrong").alias("errors"))


def unmapped(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """Rows of datasets that have no spec."""
    return rows.join(spec_mappings(specs).select("dataset_id").distinct(), "dataset_id", "left_anti")


def cells_map(rows: DataFrame, dataset: str, row_key: str) -> DataFrame:
    """dataset_id, row_key, cells, kinds of a table: its columns as texts, empty ones absent."""
    kinds = {"string": "string", "boolean": "boolean"}
    pairs = [(c, t) for c, t in rows.dtypes]
    listed = F.map_from_arrays(F.array(*[F.lit(c) for c, _ in pairs]), F.array(*[F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c, _ in pairs]))
    said = F.map_from_arrays(F.array(*[F.lit(c) for c, _ in pairs]), F.array(*[F.lit(kinds.get(t, "number")) for _, t in pairs]))
    return rows.select(F.lit(dataset).alias("dataset_id"), F.col(row_key).cast("string").alias("row_key"), listed.alias("cells"), said.alias("kinds"))


def audit(specs: DataFrame, rows: DataFrame) -> DataFrame:
    """mapping_confidence, evidence_type, review_status, mappings, and values: how many cells of rows such mappings carry."""
    of = spec_mappings(specs)
    told = ["mapping_confidence", "evidence_type", "review_status"]
    there = rows.select("dataset_id", F.explode(F.map_keys(F.map_filter("cells", lambda k, v: v.isNotNull()))).alias("original_field")).groupBy("dataset_id", "original_field").agg(F.count("*").alias("n"))
    return of.join(there, ["dataset_id", "original_field"], "left").groupBy(*told).agg(F.count("*").alias("mappings"), F.coalesce(F.sum("n"), F.lit(0)).alias("values"))
