"""Harmonised records: mapping specs applied, missingness, long items, graph view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.operators.tables import saved


def nested(spec: Sequence[tuple[str, str]]) -> list[Column]:
    """Columns that place source columns at dotted target paths: one struct for each first part of a path.

    spec: (source column, target path) pairs. A path must not both hold a value and have paths below it.
    """
    tree: dict = {}
    for source, target in spec:
        at, parts = tree, target.split(".")
        for part in parts[:-1]:
            at = at.setdefault(part, {})
            if not isinstance(at, dict):
                raise ValueError(f"{target}: a value and a group share a path")
        if parts[-1] in at:
            raise ValueError(f"{target} is given twice")
        at[parts[-1]] = F.col(f"`{source}`")

    def build(node) -> Column:
        return F.struct(*[build(v).alias(k) for k, v in node.items()]) if isinstance(node, dict) else node

    return [build(v).alias(k) for k, v in tree.items()]


def missingness(rules: Sequence[tuple[str, str, str]]) -> Column:
    """array<struct<field, status, reason>>: one entry for each (column, status, reason) whose column is null."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("field"), F.lit(status).alias("status"), F.lit(reason).alias("reason"))) for c, status, reason in rules]))


def long_items(df: DataFrame, keys: list[str], items: Sequence[str]) -> DataFrame:
    """keys, item, value: one row for each item; nulls stay rows."""
    return df.unpivot(keys, list(items), "item", "value")


def graph(df: DataFrame, links: Sequence[tuple[str, str, str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, type), edges(source, relation, target)) of links (type, column, relation, type, column).

    Ids are type:value. Rows with a null end give no edge of that link, but the other end stays a node.
    """
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    ends = [F.struct(name(k, c).alias("id"), F.lit(k).alias("type")) for a, x, _, b, y in links for k, c in ((a, x), (b, y))]
    nodes = df.select(F.explode(F.array(*ends)).alias("n")).select("n.*").filter("id IS NOT NULL").distinct()
    lines = [F.struct(name(a, x).alias("source"), F.lit(r).alias("relation"), name(b, y).alias("target")) for a, x, r, b, y in links]
    edges = df.select(F.explode(F.array(*lines)).alias("e")).select("e.*").filter("source IS NOT NULL AND target IS NOT NULL").distinct()
    return nodes, edges


def loose_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node; `side` says which. A null end is none.

    Distinct ends, far fewer than edges, are looked up among the nodes, and those that are none are saved, so that their
    size is known: edges are only shuffled to them where they are too many to broadcast.
    """
    sides = ("source", "target")
    ends = [edges.select(F.col(side).alias("id")).distinct().select(F.lit(side).alias("side"), "id") for side in sides]
    loose = saved(ends[0].unionByName(ends[1]).join(nodes.select("id"), "id", "left_anti"))
    found = []
    for side in sides:
        lost = loose.filter(F.col("side") == side).select(F.col("id").alias("_end"))
        found.append(edges.join(lost, edges[side].eqNullSafe(lost["_end"]), "left_semi").withColumn("side", F.lit(side)))
    return found[0].unionByName(found[1])


def uncovered(wanted: DataFrame, spec: DataFrame, column: str) -> DataFrame:
    """Rows of wanted whose column is in no row of spec."""
    return wanted.join(spec.select(column).distinct(), column, "left_anti")
