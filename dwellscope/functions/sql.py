"""SQL functions of the reusable scalars, as expressions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Name, parameters, type and body of each.
FUNCTIONS = (
    ("service_date", "ts TIMESTAMP_NTZ, zone STRING", "DATE", "to_date(convert_timezone('UTC', zone, ts) - INTERVAL 4 HOURS)"),
    ("service_hour", "ts TIMESTAMP_NTZ, zone STRING", "INT", "cast(floor((unix_seconds(cast(convert_timezone('UTC', zone, ts) as timestamp)) - unix_seconds(cast(to_date(convert_timezone('UTC', zone, ts) - INTERVAL 4 HOURS) as timestamp))) / 3600) as int)"),
    ("norm_id", "id STRING", "STRING", "nullif(regexp_extract(trim(id), '^0*([0-9]+)', 1), '')"),
    ("haversine_m", "lat0 DOUBLE, lon0 DOUBLE, lat1 DOUBLE, lon1 DOUBLE", "DOUBLE", "2 * 6371008.8D * asin(sqrt(least(1D, greatest(0D, pow(sin(radians(lat1 - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat1)) * pow(sin(radians(lon1 - lon0) / 2), 2)))))"),
    ("has_flag", "flags INT, bit INT", "BOOLEAN", "(flags & bit) <> 0"),
    ("kmh", "opp DOUBLE, len_m DOUBLE, tick_s DOUBLE", "DOUBLE", "least(80D, 3.6D * len_m / greatest(opp * tick_s, 1e-9D))"),
)


def register(spark: SparkSession) -> list[str]:
    """Registers them for the session; gives their names."""
    for name, params, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
