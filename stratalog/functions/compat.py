"""Scalar functions of the MySQL dialect, as column expressions and as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

VERSION = "8.0.11-stratalog"


def log_base(base: Column, x: Column) -> Column:
    """Null unless x > 0 and base > 1."""
    return F.when((x > 0) & (base > 1), F.log(x) / F.log(base))


def square_root(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def split_literal(text: Column, separator: Column) -> Column:
    """Splits at a literal separator; an empty one splits into characters."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(separator, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.when(separator == "", F.filter(F.split(text, ""), lambda x: x != "")).otherwise(F.split(text, quoted))


def greatest_strict(*columns: Column) -> Column:
    """Null if any is null."""
    return F.when(~_any_null(columns), F.greatest(*columns))


def least_strict(*columns: Column) -> Column:
    return F.when(~_any_null(columns), F.least(*columns))


def _any_null(columns: tuple[Column, ...]) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | c.isNull()
    return found


def json_extract(document: Column, *paths: str) -> Column:
    """JSON text at a path, strings in quotes; of several paths an array of what is there."""
    at = [F.to_json(F.variant_get(F.try_parse_json(document), p, "variant")) for p in paths]
    if len(at) == 1:
        return at[0]
    return F.concat(F.lit("["), F.concat_ws(",", *at), F.lit("]"))


def json_unquote(value: Column) -> Column:
    return F.get_json_object(F.concat(F.lit("["), value, F.lit("]")), "$[0]")


def regexp_matches(text: Column, pattern: str, flags: str = "") -> Column:
    if set(flags) - {"i"}:
        raise ValueError(f"unknown flags {flags!r}")
    return F.regexp_extract_all(text, F.lit(f"(?i){pattern}" if flags else pattern), F.lit(0))


def year_week(day: Column) -> Column:
    """ISO year and week as yyyyww."""
    return F.extract(F.lit("YEAROFWEEK"), day) * 100 + F.weekofyear(day)


#: SQL functions (name, arguments, result, body) that Spark lacks or spells otherwise.
SQL_FUNCTIONS = (
    ("mid", "s STRING, p INT, n INT", "STRING", "CASE WHEN p = 0 THEN '' ELSE substring(s, p, n) END"),
    ("is_tag", "ref STRING", "BOOLEAN", "coalesce(startswith(ref, 'refs/tags/'), false)"),
    ("is_remote", "ref STRING", "BOOLEAN", "coalesce(startswith(ref, 'refs/remotes/'), false)"),
    ("is_binary", "b BINARY", "BOOLEAN", "locate('\\0', cast(substring(b, 1, 8000) AS STRING)) > 0"),
    ("array_length", "a ARRAY<STRING>", "INT", "size(a)"),
    ("json_extract", "j STRING, p STRING", "STRING", "to_json(variant_get(try_parse_json(j), p, 'variant'))"),
    ("json_unquote", "j STRING", "STRING", "get_json_object(concat('[', j, ']'), '$[0]')"),
    ("log_base", "b DOUBLE, x DOUBLE", "DOUBLE", "CASE WHEN x > 0 AND b > 1 THEN ln(x) / ln(b) END"),
    ("yearweek", "d TIMESTAMP", "INT", "cast(extract(YEAROFWEEK FROM d) * 100 + weekofyear(d) AS INT)"),
    ("dayofmonth_", "d TIMESTAMP", "INT", "day(d)"),
    ("to_base64", "s STRING", "STRING", "base64(cast(s AS BINARY))"),
    ("from_base64", "s STRING", "STRING", "cast(unbase64(s) AS STRING)"),
    ("server_version", "", "STRING", f"'{VERSION}'"),
)


def register(spark: SparkSession) -> None:
    """Makes the SQL functions known to the session; the names stay until it ends."""
    for name, arguments, result, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
