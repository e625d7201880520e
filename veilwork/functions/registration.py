"""The validators and transforms as SQL functions, which the optimiser inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "luhn_ok(s STRING) RETURNS BOOLEAN": "length(regexp_replace(s, '[^0-9]', '')) >= 10 AND luhn_check(regexp_replace(s, '[^0-9]', ''))",
    "ssn_ok(s STRING) RETURNS BOOLEAN": "length(regexp_replace(s, '[^0-9]', '')) = 9 AND substr(regexp_replace(s, '[^0-9]', ''), 1, 3) NOT IN ('000', '666') AND substr(regexp_replace(s, '[^0-9]', ''), 1, 3) < '900' "
    "AND substr(regexp_replace(s, '[^0-9]', ''), 4, 2) <> '00' AND substr(regexp_replace(s, '[^0-9]', ''), 6, 4) <> '0000'",
    "npi_ok(s STRING) RETURNS BOOLEAN": "length(regexp_replace(s, '[^0-9]', '')) = 10 AND substr(regexp_replace(s, '[^0-9]', ''), 1, 1) IN ('1', '2') AND luhn_check(concat('80840', regexp_replace(s, '[^0-9]', '')))",
    "lookup_hash(s STRING) RETURNS STRING": "sha2(lower(trim(s)), 256)",
    "date_offset(conversation STRING) RETURNS INT": "cast(cast(conv(substr(sha2(conversation, 256), 1, 8), 16, 10) AS BIGINT) % 335 + 30 AS INT)",
    "short_type(t STRING) RETURNS STRING": "regexp_replace(t, '^(?:NAME_|DATE_|ID_)', '')",
    "overlap_ratio(s1 INT, e1 INT, s2 INT, e2 INT) RETURNS DOUBLE": "greatest(least(e1, e2) - greatest(s1, s2), 0) / least(e1 - s1, e2 - s2)",
}


def register(spark: SparkSession) -> list[str]:
    """Create them as temporary functions of the session; their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in FUNCTIONS]
