"""One query for each operator of this subpackage, over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.llm import language, mixing, neighbours, ngram_join, packing, preference, quality_rules, substring, token_counts, toxicity
from citeflow.llm.common import documents


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": lambda spark, d: packing.pack(documents(spark, d)),
        "op2_source_mixing": lambda spark, d: mixing.report(documents(spark, d)),
        "op3_ngram_jaccard_join": lambda spark, d: ngram_join.join_documents(documents(spark, d)),
        "op4_language_id": lambda spark, d: language.identify(documents(spark, d)),
        "op5_token_counts": lambda spark, d: token_counts.count_tokens(documents(spark, d)),
        "op6_substring_dedup": lambda spark, d: substring.repeated_spans(documents(spark, d)),
        "op7_preference_ranking": lambda spark, d: preference.rank(documents(spark, d), _labels(spark, d)),
        "op8_toxicity": lambda spark, d: toxicity.score(documents(spark, d), _labels(spark, d)),
        "op9_quality_rules": lambda spark, d: quality_rules.score(documents(spark, d)),
        "op10_nearest_neighbours": lambda spark, d: neighbours.knn(spark.read.parquet(f"{d}/embeddings.parquet"), asked=F.col("vec_id") % 20 == 0),
    }


_JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS g FROM w WHERE len(w) > 0),
c AS (SELECT g, len(g) AS n, count(*) AS copies, min(doc_id) AS least FROM s GROUP BY g),
k AS (SELECT row_number() OVER (ORDER BY g) AS k, g, n, copies, least FROM c),
e AS (SELECT k, n, unnest(g) AS t FROM k),
p AS (SELECT a.k AS ka, b.k AS kb, a.n AS na, b.n AS nb, count(*) AS met FROM e a JOIN e b ON a.t = b.t AND a.k <> b.k AND 10 * a.n >= 7 * b.n AND 10 * b.n >= 7 * a.n GROUP BY ALL),
l AS (SELECT ka, kb FROM p WHERE 10 * met >= 7 * (na + nb - met)),
r AS (SELECT k AS k, k AS o FROM k UNION SELECT r.k, l.kb FROM r JOIN l ON r.o = l.ka),
root AS (SELECT r.k, min(k.least) AS class_id FROM r JOIN k ON k.k = r.o GROUP BY r.k),
links AS (SELECT ka, sum(copies) AS n FROM l JOIN k ON k.k = kb GROUP BY ka)
SELECT s.doc_id, root.class_id, CAST(k.copies - 1 AS BIGINT) AS n_copies, CAST(coalesce(links.n, 0) AS BIGINT) AS n_links
FROM s JOIN k ON s.g = k.g JOIN root ON root.k = k.k LEFT JOIN links ON links.ka = k.k
UNION ALL SELECT doc_id, doc_id, 0::BIGINT, 0::BIGINT FROM w WHERE w IS NULL OR len(w) = 0
"""

_SPANS = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\f\r]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM w WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS h FROM i),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS FIRST, i) AS nth FROM h),
b AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS fresh FROM r WHERE nth > 1),
g AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM b)
SELECT doc_id, CAST(min(i) AS INT) AS start_word, CAST(max(i) + 50 AS INT) AS end_word FROM g GROUP BY doc_id, g
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express."""
    return {"op2_source_mixing": mixing.SQL, "op3_ngram_jaccard_join": _JACCARD, "op6_substring_dedup": _SPANS}
