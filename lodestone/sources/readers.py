"""Readers of the formats a document collection arrives in; every reader states its schema, so that nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text or markdown files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def binary_documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, size_bytes, checksum, content) of binary files; decoding them is left to a caller's function."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("checksum"), "content")


def pasted_abstracts(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, abstract) of files whose abstracts are separated by blank lines; empty ones are dropped."""
    docs = text_documents(spark, path)
    parts = docs.select("path", F.posexplode(F.split("text", r"\n\s*\n")).alias("position", "abstract"))
    return parts.select("path", "position", F.trim("abstract").alias("abstract")).where("abstract <> ''")


def term_counts(spark: SparkSession, path: str, term: str = "term", count: str = "count") -> DataFrame:
    """(term, n) of a CSV of counts: headers are lower-cased, names fall back to the first two columns, bad counts are 0."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    t = term if term in raw.columns else raw.columns[0]
    n = count if count in raw.columns else raw.columns[min(1, len(raw.columns) - 1)]
    return raw.select(F.trim(F.col(f"`{t}`")).alias("term"), F.coalesce(F.col(f"`{n}`").try_cast("double").cast("long"), F.lit(0)).alias("n"))


def material_lines(spark: SparkSession, path: str, model: str) -> DataFrame:
    """(model, doc, material) of lines ``name.pdf: a, b`` or ``doi,a,b``; the header line is skipped, repeats are dropped."""
    lines = spark.read.text(path).select(F.trim("value").alias("l")).where(~F.upper("l").startswith("DOI,") & (F.col("l") != ""))
    named = F.col("l").rlike(r"^\S+\.pdf\s*:")
    doc = F.when(named, F.regexp_extract("l", r"^(\S+\.pdf)\s*:", 1)).otherwise(F.split_part("l", F.lit(","), F.lit(1)))
    rest = F.when(named, F.regexp_replace("l", r"^\S+\.pdf\s*:", "")).otherwise(F.regexp_replace("l", "^[^,]*,", ""))
    items = lines.select(F.lit(model).alias("model"), F.trim(doc).alias("doc"), F.explode(F.split(F.regexp_replace(rest, '"', ""), ",")).alias("material"))
    return items.select("model", "doc", F.trim("material").alias("material")).where("material <> ''").distinct()


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; lines that do not fit the schema are kept apart in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def field_grid(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value) of a CSV matrix: one long row per cell; the row is the line's number within its file order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")).alias("row", "line"))
    return lines.select("row", F.posexplode(F.split("line", ",")).alias("col", "value")).select("row", "col", F.col("value").try_cast("double").alias("value"))
