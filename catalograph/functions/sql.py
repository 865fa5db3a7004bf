"""Functions that SQL text can call after :func:`register_functions`."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register_functions(spark: SparkSession) -> None:
    """Temporary SQL functions of this session, defined by expressions so that they stay in the JVM."""
    defs = {
        "great_circle_m(lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE) RETURNS DOUBLE": "2 * 6367435.0 * asin(sqrt(least(1.0, pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2))))",
        "to_meters(v DOUBLE, unit STRING) RETURNS DOUBLE": "v * CASE unit WHEN 'Decimal Degrees' THEN 111195.0 WHEN 'Kilometers' THEN 1000.0 WHEN 'Statute Miles' THEN 1609.344 WHEN 'Nautical Miles' THEN 1852.001 ELSE 1.0 END",
        "bin_score(score DOUBLE) RETURNS DOUBLE": "floor(floor(score / 2 / 0.2 + 0.5) * 0.2 * 100 + 0.5) / 100",
        "bin_usage(usage DOUBLE) RETURNS DOUBLE": "floor(floor(coalesce(usage, 0) / 400 + 0.5) * 400 * 100 + 0.5) / 100",
        "concept_seq(id STRING) RETURNS BIGINT": "try_cast(regexp_extract(id, '^[A-Z]+([0-9]+)-', 1) AS BIGINT)",
        "version_key(v STRING) RETURNS STRING": "coalesce(CAST(try_cast(v AS BIGINT) AS STRING), v)",
    }
    for head, body in defs.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
