"""Queries of nested-record validation; their SQL says which row has which planted fault, and what that must give."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.operators import samples
from earshot.plans.base import query
from earshot.sources import documents as docs
from earshot.sources.surveys import table

_LABEL = "CASE o_orderkey % {n} {cases} ELSE o_orderkey::VARCHAR END".format(n=len(docs.SAMPLES), cases=" ".join(f"WHEN {i} THEN '{x}'" for i, x in docs.SAMPLE_LABELS.items()))
SAMPLE_SQL = docs.findings_sql("orders", "o_orderkey", docs.SAMPLES, docs.SAMPLE_FINDINGS, _LABEL)
MAPPING_SQL = docs.findings_sql("customer", "c_custkey", docs.MAPPINGS, docs.MAPPING_FINDINGS)
CHECKLIST_SQL = docs.findings_sql("supplier", "s_suppkey", docs.CHECKLISTS, docs.CHECKLIST_FINDINGS)
MODEL_SQL = docs.findings_sql("part", "p_partkey", docs.MODELS, docs.MODEL_FINDINGS)


def sample_documents(spark, sf_dir) -> DataFrame:
    return docs.documents_of(table(spark, sf_dir, "orders"), F.col("o_orderkey"), docs.SAMPLES)


@query(SAMPLE_SQL)
def r01_sample_findings(spark, sf_dir):
    """Rules R01 to R35, R41 and R42."""
    return samples.sample_findings(sample_documents(spark, sf_dir), ("SURVEY",))


@query(MAPPING_SQL)
def r36_mapping_findings(spark, sf_dir):
    """Rules R36 to R38."""
    return samples.mapping_findings(docs.documents_of(table(spark, sf_dir, "customer"), F.col("c_custkey"), docs.MAPPINGS))


@query(CHECKLIST_SQL)
def r39_checklist_findings(spark, sf_dir):
    return samples.checklist_findings(docs.documents_of(table(spark, sf_dir, "supplier"), F.col("s_suppkey"), docs.CHECKLISTS))


@query(MODEL_SQL)
def r40_graph_model_findings(spark, sf_dir):
    return samples.graph_model_findings(docs.documents_of(table(spark, sf_dir, "part"), F.col("p_partkey"), docs.MODELS))


_KINDS = {"sample": (r01_sample_findings, SAMPLE_SQL), "mapping": (r36_mapping_findings, MAPPING_SQL), "checklist": (r39_checklist_findings, CHECKLIST_SQL), "graph_model": (r40_graph_model_findings, MODEL_SQL)}


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, s AS severity, count(*) FILTER (severity = s) AS n FROM ({sql}), (VALUES ('error'), ('warning')) t(s) GROUP BY s" for k, (_, sql) in _KINDS.items()))
def b13_validation_totals(spark, sf_dir):
    """Errors and warnings of all kinds of documents."""
    totals = [samples.severity_totals(f(spark, sf_dir)).select(F.lit(k).alias("kind"), "severity", "n") for k, (f, _) in _KINDS.items()]
    return reduce(DataFrame.unionByName, totals)
