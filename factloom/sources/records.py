"""Study files: JSON lines, attempt records, CSV with token columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events: file, line number's text, value as text; counts: file, n, n_invalid). Blank lines are no events."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value").where(F.trim("value") != "")
    checked = lines.withColumn("valid", F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{"))
    counts = checked.groupBy("file").agg(F.count("*").alias("n"), F.count_if(~F.col("valid")).alias("n_invalid"))
    return checked.where("valid").select("file", "value"), counts


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_tokens_csv(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """A CSV whose key columns may only hold plain tokens; reading another value fails the query."""
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    for key in keys:
        fine = F.col(key).rlike(r"^[A-Za-z0-9._:-]+$")
        df = df.withColumn(key, F.when(fine, F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"bad {key}: "), F.coalesce(F.col(key), F.lit("null"))))))
    return df
