"""What the two classifiers share: folds and a bounded training sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import fold_of

#: Labels are learned from rows whose fold is not 0.
FOLDS = 5


def held_out() -> F.Column:
    return (fold_of(F.col("doc_id"), FOLDS) == 0).alias("held_out")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], max_chars: int) -> list[tuple[str, int]]:
    """(text, label) of at most per_class[label] training documents of each label, in order of a hash of doc_id.

    The bound holds in rows (per_class) and in characters of each (max_chars; longer ones are not sampled, never
    cut). The ids come from the labels alone, so that documents are only filtered by a broadcast of bounded size.
    Contradicting or repeated labels of a doc_id count as the largest, of several texts of one the smallest is taken;
    null labels and ids are ignored.
    """
    clean = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), FOLDS) != 0))
    clean = clean.groupBy("doc_id").agg(F.max(label).alias("y"))
    picked = {}
    for y, n in per_class.items():
        picked |= {r["doc_id"]: y for r in clean.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()}
    if not picked:
        return []
    ids = docs.sparkSession.createDataFrame(list(picked.items()), "doc_id long, y int")
    rows = docs.select("doc_id", "text").filter(F.length("text") <= max_chars).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    return [(r["text"], r["y"]) for r in sorted(rows, key=lambda r: r["doc_id"])]
