"""Expressions of the library as functions of SQL. They are inlined into the plan of the query that calls them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import ACCENTED, PLAIN

_DOT = "aggregate(zip_with(slice({0}, 1, least(size(a), size(b))), slice({1}, 1, least(size(a), size(b))), (x, y) -> x * y), 0D, (s, x) -> s + x)"
_NORMS = f"sqrt({_DOT.format('a', 'a')}) * sqrt({_DOT.format('b', 'b')})"

#: Name -> (parameters and result, expression). The same values as functions.vector.cosine, text.tr_lower and text.tokens.
FUNCTIONS = {
    "cosine_similarity": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE", f"coalesce(CASE WHEN size(a) > 0 AND size(b) > 0 THEN try_divide({_DOT.format('a', 'b')}, {_NORMS}) END, 0D)"),
    "tr_lower": ("x STRING) RETURNS STRING", "lower(translate(x, 'Iİ', 'ıi'))"),
    "search_tokens": ("x STRING) RETURNS ARRAY<STRING>", f"regexp_extract_all(translate(lower(coalesce(x, '')), '{ACCENTED}', '{PLAIN}'), r'[\\p{{L}}\\p{{N}}]+', 0)"),
}


def register(spark: SparkSession) -> None:
    """Make them functions of this session."""
    for name, (signature, expression) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({signature} RETURN {expression}")
