"""SQL names for the vector functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameters and body of each SQL function.
FUNCTIONS = {
    "vec_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "vec_unit": ("v ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "transform(v, x -> x / greatest(sqrt(aggregate(v, 0D, (s, y) -> s + y * y)), 1e-6D))"),
    "vec_distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"),
}


def register(spark: SparkSession) -> list[str]:
    """Add the functions to the session; again does no harm. Their names."""
    for name, (parameters, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    return list(FUNCTIONS)
