"""Reading and writing trajectory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, sep: str = ",", header: bool = True, encoding: str = "utf-8", schema: str | None = None) -> DataFrame:
    """A parquet table where the path ends so, else a delimited one (give a schema to read it once)."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("sep", sep).option("header", header).option("encoding", encoding)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write(df: DataFrame, path: str, sep: str = ",") -> None:
    """Parquet where the path ends so, else delimited text with a header; a folder of part files."""
    if path.rstrip("/").endswith(".parquet"):
        df.write.parquet(path)
    else:
        df.write.option("sep", sep).option("header", True).csv(path)


def read_geolife(spark: SparkSession, path: str, user_ids: list[str] | None = None) -> DataFrame:
    """uid, lat, lng, datetime of all .plt files below path: seven fields a line, so header lines drop out.

    uid is the last path component of three digits.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.plt").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    part = F.split("value", ",")
    rows = lines.where(F.size(part) == 7).select(
        F.regexp_extract("file", r"/(\d{3})/(?!.*/\d{3}/)", 1).alias("uid"),
        part[0].try_cast("double").alias("lat"),
        part[1].try_cast("double").alias("lng"),
        F.expr("try_cast(concat(split(value, ',')[5], ' ', split(value, ',')[6]) AS TIMESTAMP_NTZ)").alias("datetime"),
    )
    rows = rows.where("lat is not null and lng is not null and datetime is not null")
    return rows.where(F.col("uid").isin(user_ids)) if user_ids else rows
