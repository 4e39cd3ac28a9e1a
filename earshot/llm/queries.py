"""The registered queries opN_<name> and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import brown, filters, forest, mixing, negatives, neighbours, packing, pii, prefix_bpe, simhash, suffixes, tiff, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.scored(documents(spark, sf_dir))


def op5_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(documents(spark, sf_dir))


def op7_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digest(documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = mixing.mix_counts(documents(spark, sf_dir))
    return counts.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.digest(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_suffix_dedup, op3_toxicity, op4_brown_classes, op5_projection_forest, op6_simhash, op7_tiff, op8_quality, op9_pii, op10_mixing,
                                   op11_hard_negatives, op12_filter_audit, op13_prefix_bpe)}

ORACLE_SQL = {
    "op10_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':0') AS u,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM totals),
ratios AS (SELECT *, (source_size * 3)::DOUBLE / weight AS ratio FROM weighted),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER w, 0))::DOUBLE
                     / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
           FROM ratios WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
settled AS (SELECT level AS s FROM levels WHERE level < ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN s IS NULL OR ratio <= s THEN (source_size * 3)::DOUBLE ELSE s * weight END AS target
            FROM levels LEFT JOIN settled ON true),
queued AS (SELECT d.*, source_size, target,
                  sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
                  row_number() OVER (PARTITION BY d.source ORDER BY u, doc_id, size) AS copy
           FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
timed AS (SELECT *, CASE WHEN target > 0 THEN (epoch * source_size + cum)::DOUBLE / target ELSE 0 END AS finish
          FROM queued, (VALUES (0), (1), (2)) e(epoch)),
line AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, u, doc_id, size, copy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                   <= (SELECT sum(size) FROM sized) AS taken FROM timed)
SELECT doc_id, size, source_size::BIGINT AS source_size, target::DOUBLE AS target,
       (size * count(*) FILTER (WHERE taken))::BIGINT AS taken
FROM line GROUP BY doc_id, source, u, size, source_size, target, copy
""",
    "op11_hard_negatives": """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))), true)),
scored AS (
  SELECT a.vec_id AS anchor_id, e.vec_id, e.label = a.label AS same, list_dot_product(a.q, e.q)::BIGINT AS score
  FROM e a, e WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
""",
    "op12_filter_audit": r"""
WITH plain AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents),
split AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY body) AS first FROM plain),
said AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, list_filter([
    CASE WHEN len(words) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) THEN 'C' END,
    CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > first THEN 'E' END], lambda x: x IS NOT NULL) AS fails
  FROM split LEFT JOIN said USING (doc_id)),
counted AS (SELECT part, good, toxic, fails, count(*) AS n FROM failing GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, s.step, o[s.step] AS f, o[1:s.step - 1] AS before FROM orders, (SELECT unnest(range(1, 6)) AS step) s),
marked AS (SELECT c.*, s.*, list_has_any(fails, before) AS gone, list_contains(fails, f) AS bad FROM counted c, steps s),
report AS (
  SELECT part, array_to_string(o, '') AS filter_order, step::INT AS step, f, sum(CASE WHEN NOT gone AND NOT bad THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN NOT gone AND bad THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN gone AND bad THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = [f] THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN NOT gone AND bad AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN NOT gone AND bad AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM marked GROUP BY part, o, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM report
""",
}


def _spans(kind: str, pattern: str) -> str:
    """SQL for the spans of a base kind: what regexp_extract_all finds, placed by the text between."""
    return rf"""
  SELECT doc_id, '{kind}' AS kind, i, found,
         list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(all_found[1:i - 1], lambda g: length(g))), 0) AS start
  FROM (SELECT doc_id, unnest(range(1, len(all_found) + 1)) AS i, unnest(all_found) AS found, all_found, gaps
        FROM (SELECT doc_id, regexp_extract_all(body, '{pattern}') AS all_found, string_split_regex(body, '{pattern}') AS gaps FROM body))"""


_LUHN = r"""list_sum(list_transform(range(1, length(digits) + 1), lambda k: CASE WHEN k % 2 = 1 THEN substr(reverse(digits), k::INT, 1)::INT
        ELSE substr(reverse(digits), k::INT, 1)::INT * 2 - CASE WHEN substr(reverse(digits), k::INT, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""

# op9's base columns, for tests/llm/test_sql.py; its column of all spans, with those that the method adds, has no SQL.
PII_BASE_SQL = rf"""
WITH body AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
found AS ({_spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")}
  UNION ALL {_spans("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")}
  UNION ALL {_spans("card", r"[0-9]([\x20-]?[0-9])+")}
  UNION ALL {_spans("phone", r"\+[0-9][\x20().0-9-]+[0-9]")}),
checked AS (SELECT *, regexp_replace(found, '[^0-9]', '', 'g') AS digits FROM found),
valid AS (SELECT doc_id, kind, start, start + length(found) AS stop FROM checked WHERE CASE kind
  WHEN 'ip' THEN list_bool_and(list_transform(string_split(found, '.'), lambda p: p::HUGEINT <= 255))
  WHEN 'card' THEN CASE WHEN length(digits) BETWEEN 14 AND 19 THEN {_LUHN} ELSE false END
  WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15 ELSE true END),
joined AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
  count(*) FILTER (kind = 'phone') AS n_phone, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, list_position(['email', 'ip', 'card', 'phone'], kind)) AS spans
  FROM valid GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card,
  coalesce(n_phone, 0)::BIGINT AS n_phone, sha256(coalesce(spans, '')) AS base_sha256 FROM body LEFT JOIN joined USING (doc_id)
"""
